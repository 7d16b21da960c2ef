"""Unions, distinct lists, projections and filters."""

from pyspark.sql import functions as F

from demandloom import PAIR, schema
from demandloom.functions import scalars as X
from demandloom.operators import aggregates as A
from demandloom.operators import joins as J
from demandloom.operators import sets as S
from demandloom.plans.common import levels, rounded
from demandloom.plans.registry import query
from demandloom.session import materialize, scratch_path
from demandloom.sources import files, panels


def _requests(panel):
    return panel.where(F.col("date") >= F.lit(panels.TEST_START).cast("date")).select("date", *PAIR)


@query(
    "set1_union_years",
    """SELECT year(date) AS year, count(*) AS n, sum(units) AS units FROM sales GROUP BY 1""",
)
def _(spark, d):
    panel = panels.sales(spark, d, province=False)
    # One table per year, written once by month; each member of the union reads its own folder.
    path = scratch_path(spark, "yearly")
    yearly = panel.withColumn("year", F.year("date"))
    files.write_table(yearly.repartition("year", F.month("date")), path, partition_by=["year"])
    table = files.read_table(spark, path)
    years = [table.where(F.col("year") == y).drop("year") for y in levels(table, "year")]
    return S.union_all(years).groupBy(F.year("date").alias("year")).agg(F.count("*").alias("n"), F.sum("units").alias("units"))


@query(
    "set2_stack_requests",
    """SELECT date, store_nbr, item_nbr, units, false AS is_kaggle_test FROM sales WHERE date < DATE '2001-01-01'
       UNION ALL SELECT date, store_nbr, item_nbr, NULL, true FROM sales WHERE date >= DATE '2001-01-01'""",
)
def _(spark, d):
    panel = panels.sales(spark, d, province=False)
    history = panel.where(F.col("date") < F.lit(panels.TEST_START).cast("date")).select("date", *PAIR, "units")
    return S.stack_requests(history, _requests(panel))


@query(
    "set3_drop_incomplete_history",
    """WITH f AS (SELECT date, store_nbr, item_nbr, units, date >= DATE '2001-01-01' AS is_kaggle_test,
         lag(units, 7) OVER (PARTITION BY store_nbr, item_nbr ORDER BY date) AS lag_7 FROM sales_dirty)
       SELECT * FROM f WHERE is_kaggle_test OR (units IS NOT NULL AND lag_7 IS NOT NULL)""",
)
def _(spark, d):
    from demandloom.operators.windows import lags

    panel = panels.sales_dirty(spark, d).select("date", *PAIR, "units")
    flagged = panel.withColumn("is_kaggle_test", F.col("date") >= F.lit(panels.TEST_START).cast("date"))
    return S.drop_incomplete_history(lags(flagged, "units", [7]).withColumnRenamed("units_lag_7", "lag_7"))


@query(
    "set4_flattened_frames",
    """SELECT category, concat_ws('_', store_nbr, item_nbr) AS store_item, date, y, round(yhat, 6) + 0 AS yhat
       FROM predictions WHERE date >= DATE '2001-01-01'""",
)
def _(spark, d):
    """Forecasts kept as frames by series, one map per category, as one table again."""
    recent = panels.predictions(spark, d).where(F.col("date") >= F.lit(panels.TEST_START).cast("date"))
    return rounded(S.flatten_frames(S.keyed_frames(recent, PAIR, ["date", "y", "yhat"], ["category"])), ["yhat"])


@query("set5_distinct_pairs", "SELECT DISTINCT store_nbr, item_nbr FROM sales")
def _(spark, d):
    return S.distinct_pairs(panels.sales(spark, d, province=False))


@query("set6_distinct_values", "SELECT DISTINCT category FROM sales ORDER BY 1")
def _(spark, d):
    return S.distinct_values(panels.sales(spark, d, province=False), "category")


@query(
    "set7_name_map",
    """SELECT item_nbr, max_by(p_name, (date, p_name)) AS name FROM (
         SELECT CAST(substr(p.p_brand, 7) AS INT) AS item_nbr, p.p_name, CAST(l.l_shipdate AS DATE) AS date
         FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey) t GROUP BY 1""",
)
def _(spark, d):
    lines = panels.table(spark, d, "lineitem").select("l_partkey", F.col("l_shipdate").cast("date").alias("date"))
    part = panels.table(spark, d, "part").select(
        "p_partkey", F.substring("p_brand", 7, 10).cast("int").alias("item_nbr"), F.col("p_name").alias("name")
    )
    named = lines.join(part, lines.l_partkey == part.p_partkey)
    return S.name_map(named.withColumn("at", F.struct("date", "name")), "item_nbr", "name", "at")


@query("set8_items_of_store", "SELECT DISTINCT item_nbr FROM sales WHERE store_nbr = 7")
def _(spark, d):
    return S.items_of_store(panels.sales(spark, d, province=False), 7)


@query(
    "set9_event_days",
    """SELECT DISTINCT CAST(date + CAST(k AS INT) AS DATE) AS date
       FROM weather_numeric, (SELECT unnest([-3, -2, -1, 0, 1, 2, 3]) AS k) o WHERE preciptotal > 1""",
)
def _(spark, d):
    return J.event_windows(S.storm_days(panels.weather_numeric(spark, d)), keys=())


@query(
    "set10_feature_columns",
    "SELECT item_nbr, units FROM sales",
)
def _(spark, d):
    panel = panels.sales(spark, d)
    return panel.select(*schema.feature_columns(panel, ["date", "province", "category", "store_nbr"]))


@query("prj1_prune", "SELECT date, units FROM sales")
def _(spark, d):
    return panels.sales(spark, d, province=False).select("date", "units")


@query("prj2_rename", "SELECT date AS ds, concat_ws('_', store_nbr, item_nbr) AS store_item, units AS y FROM sales")
def _(spark, d):
    keyed = panels.sales(spark, d, province=False).withColumn("store_item", X.pair_id(*PAIR))
    return keyed.select("date", "store_item", "units").withColumnsRenamed({"date": "ds", "units": "y"})


@query("prj3_canonical_names", "SELECT store_nbr, item_nbr, sum(units) AS units FROM sales GROUP BY 1, 2")
def _(spark, d):
    other = panels.sales(spark, d).withColumnsRenamed({"store_nbr": "store_id", "item_nbr": "item_id", "units": "sales"})
    return A.total_by(schema.canonical_panel(other), PAIR, name="units")


@query("flt1_one_series", "SELECT date, units FROM sales WHERE store_nbr = 3 AND item_nbr = 12")
def _(spark, d):
    return S.of_store(panels.sales(spark, d, province=False), 3, 12).select("date", "units")


@query(
    "flt2_dashboard_filter",
    """SELECT date, store_nbr, item_nbr, category, units FROM sales
       WHERE date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' AND category IN ('Dairy', 'Baby')""",
)
def _(spark, d):
    panel = panels.sales(spark, d, province=False)
    return S.dashboard_filter(panel, "1997-01-01", "1999-12-31", "All", ["Dairy", "Baby"])


@query("flt3_membership", "SELECT date, store_nbr, item_nbr, units FROM sales WHERE store_nbr IN (1, 4, 9) AND item_nbr = 11")
def _(spark, d):
    return S.of_store(panels.sales(spark, d, province=False), [1, 4, 9], 11).drop("category")


@query(
    "flt4_test_flag",
    """SELECT date, store_nbr, item_nbr, date >= DATE '2001-01-01' AS is_test,
              date >= DATE '2000-07-01' AND NOT date >= DATE '2001-01-01' AS is_valid FROM sales""",
)
def _(spark, d):
    panel = panels.sales(spark, d, province=False).select("date", *PAIR)
    return S.hold_out_flags(panel, panels.VALID_START, panels.TEST_START)


@query(
    "flt5_three_way_split",
    """SELECT CASE WHEN date >= DATE '2001-01-01' THEN 'test' WHEN date >= DATE '2000-07-01' THEN 'valid' ELSE 'train' END
              AS part, count(*) AS n, sum(units) AS units FROM sales GROUP BY 1""",
)
def _(spark, d):
    flagged = S.hold_out_flags(panels.sales(spark, d, province=False), panels.VALID_START, panels.TEST_START)
    return flagged.groupBy(S.split_name().alias("part")).agg(F.count("*").alias("n"), F.sum("units").alias("units"))


@query(
    "flt6_trailing_days",
    """SELECT date, store_nbr, item_nbr, units FROM sales WHERE date >= (SELECT max(date) FROM sales) - 60""",
)
def _(spark, d):
    return S.trailing_days(panels.sales(spark, d, province=False), 60).drop("category")


@query(
    "flt6_trailing_days_per_pair",
    """SELECT date, store_nbr, item_nbr, units FROM (
         SELECT *, max(date) OVER (PARTITION BY store_nbr, item_nbr) AS m FROM sales) t WHERE date >= m - 60""",
)
def _(spark, d):
    return S.trailing_days(panels.sales(spark, d, province=False), 60, PAIR).select("date", *PAIR, "units")


@query("flt7_cap", "SELECT date, store_nbr, item_nbr, units FROM sales WHERE units < 30")
def _(spark, d):
    return panels.sales(spark, d, province=False).where(F.col("units") < 30).drop("category")


@query("flt8_dropna", "SELECT date, store_nbr, item_nbr, units FROM sales_dirty WHERE units IS NOT NULL")
def _(spark, d):
    return panels.sales_dirty(spark, d).select("date", *PAIR, "units").dropna()


@query("flt9_positive_count", "SELECT count(*) AS n FROM predictions WHERE yhat > 0")
def _(spark, d):
    return panels.predictions(spark, d).where(F.col("yhat") > 0).agg(F.count("*").alias("n"))


@query("flt10_event_predicate", "SELECT station_nbr, date, preciptotal FROM weather_numeric WHERE preciptotal > 1")
def _(spark, d):
    return S.storm_days(panels.weather_numeric(spark, d)).select("station_nbr", "date", "preciptotal")


@query("flt11_slice_to_date", "SELECT date, sum(units) AS units FROM sales WHERE date <= DATE '1998-12-31' GROUP BY 1")
def _(spark, d):
    return A.total_by(S.dashboard_filter(panels.sales(spark, d, province=False), end="1998-12-31"), "date", name="units")


@query(
    "top1_multi_key_sort",
    "SELECT date, store_nbr, item_nbr, units, item_nbr * 10000 + store_nbr AS packed FROM sales ORDER BY packed, date",
)
def _(spark, d):
    panel = panels.sales(spark, d, province=False).drop("category")
    return panel.withColumn("packed", F.col("item_nbr") * 10000 + F.col("store_nbr")).orderBy("packed", "date")


@query(
    "cv1_hold_out",
    """SELECT date >= DATE '2001-01-01' AS is_test, min(date) AS first_date, max(date) AS last_date, count(*) AS n
       FROM sales GROUP BY 1""",
)
def _(spark, d):
    flagged = S.hold_out_flags(panels.sales(spark, d, province=False), panels.VALID_START, panels.TEST_START)
    return flagged.groupBy("is_test").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n")
    )


@query(
    "cv2_position_folds",
    """WITH p AS (SELECT date, store_nbr, item_nbr, row_number() OVER (ORDER BY date, store_nbr, item_nbr) - 1 AS position,
                         count(*) OVER () AS n FROM sales)
       SELECT date, store_nbr, item_nbr, position,
              CASE WHEN position >= n - 5 * (n // 6) THEN CAST((position - (n - 5 * (n // 6))) // (n // 6) AS INT) END AS fold
       FROM p""",
)
def _(spark, d):
    return S.position_folds(materialize(panels.sales(spark, d, province=False).select("date", *PAIR), "panel"))


@query(
    "cv2_date_folds",
    """WITH p AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS position, count(*) OVER () AS n
                  FROM (SELECT DISTINCT date FROM sales) t)
       SELECT s.date, s.store_nbr, s.item_nbr,
              CASE WHEN position >= n - 5 * (n // 6) THEN CAST((position - (n - 5 * (n // 6))) // (n // 6) AS INT) END AS fold
       FROM sales s JOIN p ON s.date = p.date""",
)
def _(spark, d):
    return S.date_folds(materialize(panels.sales(spark, d, province=False).select("date", *PAIR), "panel"))

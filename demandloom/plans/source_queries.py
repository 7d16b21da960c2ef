"""Scans and sinks."""

from pyspark.sql import functions as F

from demandloom import schema
from demandloom.functions import scalars as X
from demandloom.plans.common import levels
from demandloom.plans.registry import query
from demandloom.session import materialize, scratch_path
from demandloom.sources import files, panels


@query(
    "src3_thousands_measure",
    """SELECT CAST(o_orderdate AS DATE) AS date, CAST(sum(floor(o_totalprice)) AS DOUBLE) AS hit FROM orders GROUP BY 1""",
)
def _(spark, d):
    """Daily traffic printed with thousands separators and read back as numbers."""
    orders = panels.table(spark, d, "orders")
    printed = orders.groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(
        F.format_number(F.sum(F.floor("o_totalprice").cast("double")), 0).alias("hit")
    )
    return printed.withColumn("hit", X.thousands_number(F.col("hit"))).dropna(subset=["hit"])


@query(
    "src4_columnar_scan",
    """SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'""",
)
def _(spark, d):
    scan = files.read_table(spark, f"{d}/orders.parquet", ["o_orderkey", "o_totalprice", "o_orderstatus"])
    return scan.where((F.col("o_totalprice") > 100000) & (F.col("o_orderstatus") == "F")).drop("o_orderstatus")


@query(
    "src6_date_coercion",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date,
              CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS text_date FROM orders""",
)
def _(spark, d):
    """Timestamps and dotted text dates as DATE, unreadable text as NULL."""
    orders = panels.table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("date"))
    dotted = F.date_format("date", "yyyy. MM. dd.")
    texts = orders.withColumn("text_date", F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(dotted))
    return files.coerce_date(files.coerce_date(texts, "date"), "text_date", "yyyy. MM. dd.")


@query(
    "snk3_feature_table_name",
    """SELECT 'sales_6_features' AS name, count(*) AS n FROM sales""",
)
def _(spark, d):
    panel = panels.sales(spark, d)
    return panel.agg(F.count("*").alias("n")).select(F.lit(files.feature_table_name("sales", panel)).alias("name"), "n")


@query(
    "snk4_submission",
    """SELECT concat_ws('_', store_nbr, item_nbr, strftime(date, '%Y-%m-%d')) AS id, units FROM sales
       WHERE date >= DATE '2001-01-01'""",
)
def _(spark, d):
    panel = panels.sales(spark, d, province=False).where(F.col("date") >= F.lit(panels.TEST_START).cast("date"))
    return files.submission_rows(panel)


@query("snk5_chart_extract", "SELECT date, province, sum(units) AS total FROM sales GROUP BY 1, 2")
def _(spark, d):
    return panels.sales(spark, d).groupBy("date", "province").agg(F.sum("units").alias("total"))


def _panel(spark, d):
    return panels.sales_dirty(spark, d).select("date", "store_nbr", "item_nbr", "units")


@query("src1_snk1_csv_round_trip", "SELECT date, store_nbr, item_nbr, units FROM sales_dirty")
def _(spark, d):
    """The panel written as CSV with header and read back under its declared schema, dates parsed."""
    path = scratch_path(spark, "tables")
    files.write_csv(_panel(spark, d), path)
    return files.read_csv(spark, path, schema.SALES)


@query(
    "src2_two_files_with_dates",
    "SELECT date, store_nbr, item_nbr, units FROM sales_dirty",
)
def _(spark, d):
    """One file set per year with dotted dates, scanned together."""
    panel, paths = materialize(_panel(spark, d), "panel"), []
    for year in levels(panel.select(F.year("date").alias("year")), "year"):
        paths.append(scratch_path(spark, "tables"))
        rows = panel.where(F.year("date") == year)
        files.write_csv(rows.withColumn("date", F.date_format("date", "yyyy.MM.dd")), paths[-1])
    return files.read_csv(spark, paths, schema.SALES, date_format="yyyy.MM.dd")


@query(
    "src3_headerless_file",
    "SELECT strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS date, CAST(sum(floor(o_totalprice)) AS DOUBLE) AS hit FROM orders GROUP BY 1",
)
def _(spark, d):
    orders = panels.table(spark, d, "orders")
    printed = orders.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")).agg(
        F.format_number(F.sum(F.floor("o_totalprice").cast("double")), 0).alias("hit")
    )
    path = scratch_path(spark, "tables")
    printed.write.csv(path)
    return files.read_measure_csv(spark, path, ["date", "hit"], "hit")


@query("snk2_partitioned_table", "SELECT date, store_nbr, item_nbr, units, CAST(year(date) AS INT) AS year FROM sales_dirty WHERE year(date) >= 2000")
def _(spark, d):
    """A Parquet table laid out by year; the scan reads two years' folders only."""
    path = scratch_path(spark, "tables")
    yearly = _panel(spark, d).withColumn("year", F.year("date"))
    # Salted by month, so that a year is written by several tasks.
    files.write_table(yearly.repartition("year", F.month("date")), path, partition_by=["year"])
    return files.read_table(spark, path).where(F.col("year") >= 2000)


@query("src5_missing_input", "SELECT CAST(NULL AS DATE) AS date, CAST(NULL AS VARCHAR) AS store, sum(units) AS sales FROM sales")
def _(spark, d):
    """A missing file gives an empty table of the declared columns; here it is stacked under the panel's total."""
    empty = files.read_or_empty(spark, f"{d}/no_such_file.csv")
    total = panels.sales(spark, d, province=False).agg(F.sum("units").alias("sales"))
    return empty.unionByName(total, allowMissingColumns=True)


@query(
    "src7_feature_stats",
    """SELECT '1.0.0' AS model_version, date_part('year', max(date))::INT AS last_year, 6 AS columns FROM sales""",
)
def _(spark, d):
    """Model metadata saved as one JSON row and read back."""
    panel = panels.sales(spark, d)
    path = scratch_path(spark, "stats")
    last = panel.agg(F.max("date").cast("string").alias("d")).first()["d"]
    files.write_feature_stats(
        spark,
        path,
        {
            "model_version": "1.0.0",
            "last_trained": last,
            "required_columns": panel.columns,
            "column_order": panel.columns,
            "default_values": {"year": 2017, "month": 11, "day": 15},
            "temperature_bins": list(X.TRAINING_TEMPERATURE[0]),
            "temperature_labels": list(X.TRAINING_TEMPERATURE[1]),
            "humidity_bins": list(X.TRAINING_HUMIDITY[0]),
            "humidity_labels": list(X.TRAINING_HUMIDITY[1]),
        },
    )
    stats = spark.read.schema(schema.FEATURE_STATS).json(path)
    return stats.select(
        "model_version", F.year(F.to_date("last_trained")).alias("last_year"), F.size("column_order").alias("columns")
    )

"""Roll-ups, reports and rankings."""

from pyspark.sql import functions as F

from demandloom import PAIR
from demandloom.functions import dates as D
from demandloom.operators import aggregates as A
from demandloom.plans.common import levels, r6, rounded
from demandloom.plans.registry import query
from demandloom.sources import panels

# The test tables' levels, spelled out for the SQL twins; the queries take theirs from the data.
STORES = tuple(range(25))
ITEMS = tuple(range(1, 26))
YEARS = tuple(range(1995, 2002))


def _sales(spark, d):
    return panels.sales(spark, d, province=False)


def _quantiles(column, probs, names):
    return ", ".join(r6(f"quantile_cont({column}, {p})", n) for p, n in zip(probs, names))


@query("agg1_selling_pairs", "SELECT store_nbr, item_nbr FROM sales_dirty GROUP BY 1, 2 HAVING sum(units) > 0")
def _(spark, d):
    return A.selling_pairs(panels.sales_dirty(spark, d))


@query("agg2_selling_pairs_by_mean", "SELECT store_nbr, item_nbr FROM sales_dirty GROUP BY 1, 2 HAVING avg(units) > 0")
def _(spark, d):
    return A.selling_pairs(panels.sales_dirty(spark, d), by_mean=True)


@query(
    "agg3_stores_per_item",
    """SELECT item_nbr, count(*) AS stores FROM (SELECT DISTINCT store_nbr, item_nbr FROM sales) t
       GROUP BY 1 ORDER BY stores DESC, item_nbr LIMIT 20""",
)
def _(spark, d):
    return A.stores_per_item(A.selling_pairs(_sales(spark, d)))


@query(
    "agg4_availability_matrix",
    "SELECT item_nbr, "
    + ", ".join(f"CAST(max(CASE WHEN store_nbr = {s} THEN 1 ELSE 0 END) AS INT) AS store_{s}" for s in STORES)
    + " FROM sales GROUP BY 1",
)
def _(spark, d):
    return A.availability(A.selling_pairs(_sales(spark, d)), levels(panels.store_key(spark, d), "store_nbr"))


@query(
    "agg4_coverage",
    f"""SELECT count(*) AS pairs, count(DISTINCT store_nbr) AS stores, count(DISTINCT item_nbr) AS items,
        {r6('count(*) / (count(DISTINCT store_nbr) * count(DISTINCT item_nbr)) * 100.0::DOUBLE', 'coverage_pct')}
        FROM (SELECT DISTINCT store_nbr, item_nbr FROM sales) t""",
)
def _(spark, d):
    return rounded(A.coverage(A.selling_pairs(_sales(spark, d))))


@query(
    "agg5_distribution_report",
    f"""WITH p AS (SELECT DISTINCT store_nbr, item_nbr FROM sales),
        c AS (SELECT count(*) AS pairs, count(DISTINCT store_nbr) AS stores, count(DISTINCT item_nbr) AS items FROM p)
        SELECT item_nbr, count(*) AS stores, {r6('count(*) / max(c.stores) * 100.0::DOUBLE', 'store_pct')},
               {r6('max(c.pairs) / (max(c.stores) * max(c.items)) * 100.0::DOUBLE', 'coverage_pct')}
        FROM p, c GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
)
def _(spark, d):
    return rounded(A.distribution_report(_sales(spark, d)))


@query(
    "agg6_null_report",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS nulls,
            {r6(f"round_even((count(*) - count({c})) / count(*)::DOUBLE, 4) * 100", 'ratio_pct')} FROM sales_dirty"""
        for c in ("date", "store_nbr", "item_nbr", "units")
    ),
)
def _(spark, d):
    return rounded(A.null_report(panels.sales_dirty(spark, d).select("date", *PAIR, "units")))


@query(
    "agg7_column_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(*) - count({c}) AS nulls, count({c}) AS non_nulls,
            count(DISTINCT {c}) + CAST(count(*) > count({c}) AS INT) AS "distinct" FROM sales_dirty"""
        for c, t in (("date", "date"), ("store_nbr", "int"), ("item_nbr", "int"), ("category", "string"), ("units", "double"))
    ),
)
def _(spark, d):
    return A.column_profile(panels.sales_dirty(spark, d).select("date", *PAIR, "category", "units"))


@query(
    "agg8_describe",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {r6(f'avg({c})', 'mean')}, {r6(f'stddev_samp({c})', 'std')},
            CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
            {_quantiles(f'CAST({c} AS DOUBLE)', A.DESCRIBE_PROBS, [f'q{i}' for i in range(7)])} FROM sales_dirty"""
        for c in ("units", "item_nbr")
    ),
)
def _(spark, d):
    return rounded(A.describe(panels.sales_dirty(spark, d), ["units", "item_nbr"]))


@query(
    "agg8_describe_prices",
    f"""SELECT 'l_extendedprice' AS "column", {r6('avg(l_extendedprice)', 'mean')}, {r6('stddev_samp(l_extendedprice)', 'std')},
        min(l_extendedprice) AS min, max(l_extendedprice) AS max,
        {_quantiles('l_extendedprice', A.DESCRIBE_PROBS, [f'q{i}' for i in range(7)])} FROM lineitem""",
)
def _(spark, d):
    """The same over a column with as many values as rows."""
    return rounded(A.describe(panels.table(spark, d, "lineitem").select("l_extendedprice"), ["l_extendedprice"]))


@query(
    "agg9_extent",
    """SELECT min(date) AS first_date, max(date) AS last_date, count(DISTINCT date) AS n_date,
              count(DISTINCT store_nbr) AS n_store_nbr, count(DISTINCT item_nbr) AS n_item_nbr FROM sales""",
)
def _(spark, d):
    return A.extent(_sales(spark, d), ["date", *PAIR])


@query("agg10_daily_total", "SELECT date, sum(units) AS total FROM sales GROUP BY 1")
def _(spark, d):
    return A.total_by(_sales(spark, d), "date")


_WEEKDAYS = """week AS (SELECT CAST(unnest(range(7)) AS INT) AS weekday,
    unnest(['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday']) AS weekday_name),
  means AS (SELECT CAST(isodow(date) - 1 AS INT) AS weekday, avg(units) AS mean FROM sales GROUP BY 1),
  m AS (SELECT week.weekday, weekday_name, mean FROM week LEFT JOIN means ON week.weekday = means.weekday)"""


@query("agg11_weekday_means", f"WITH {_WEEKDAYS} SELECT weekday, weekday_name, {r6('mean', 'mean')} FROM m")
def _(spark, d):
    return rounded(A.weekday_means(_sales(spark, d)))


@query(
    "agg12_weekday_extremes",
    f"""WITH {_WEEKDAYS} SELECT {r6('avg(mean)', 'overall')}, max_by(weekday_name, mean) AS best_day, {r6('max(mean)', 'best_mean')},
        min_by(weekday_name, mean) AS worst_day, {r6('min(mean)', 'worst_mean')} FROM m""",
)
def _(spark, d):
    return rounded(A.weekday_extremes(A.weekday_means(_sales(spark, d))))


@query("agg13_ranked_totals", "SELECT category, sum(units) AS total FROM sales GROUP BY 1 ORDER BY 2 DESC")
def _(spark, d):
    return A.ranked_totals(_sales(spark, d), "category")


@query(
    "agg14_share",
    "SELECT category, sum(units) AS total, round(sum(units) / sum(sum(units)) OVER () * 100, 1) AS share_pct FROM sales GROUP BY 1",
)
def _(spark, d):
    return A.with_share(A.total_by(_sales(spark, d), "category"))


@query(
    "agg15_kpi_block",
    f"""WITH f AS (SELECT date, sum(units) AS v, count(*) AS n FROM sales WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' GROUP BY 1),
        k AS (SELECT DATE '1996-01-01' + CAST((DATE '1999-12-31' - DATE '1996-01-01') // 2 AS INT) AS mid)
        SELECT sum(v) AS total, {r6('avg(v)', 'mean_daily')},
          {r6("(sum(v) FILTER (date > mid) - sum(v) FILTER (date <= mid)) / sum(v) FILTER (date <= mid) * 100", 'change_pct')},
          CAST(sum(n) AS BIGINT) AS transactions, {r6('sum(v) / sum(n)', 'per_transaction')} FROM f, k""",
)
def _(spark, d):
    from demandloom.operators.sets import dashboard_filter

    period = ("1996-01-01", "1999-12-31")
    return rounded(A.kpi_block(dashboard_filter(_sales(spark, d), *period), *period))


@query(
    "agg16_monthly_error",
    f"""SELECT monthname(date) AS month, {r6('avg(y - yhat)', 'error')}, {r6('avg(abs(y - yhat))', 'abs_error')},
        {r6('avg(y)', 'actual')}, {r6('100 * avg(abs(y - yhat)) / avg(y)', 'error_pct')} FROM predictions WHERE yhat IS NOT NULL GROUP BY 1""",
)
def _(spark, d):
    from demandloom.operators.evaluation import monthly_error

    return rounded(monthly_error(panels.predictions(spark, d)))


@query(
    "agg17_mixed_functions",
    f"""SELECT date, store_nbr, sum(units) AS units, max(province) AS province, {r6('avg(item_nbr)', 'mean_item')}, count(*) AS n
        FROM sales GROUP BY 1, 2""",
)
def _(spark, d):
    mixed = panels.sales(spark, d).groupBy("date", "store_nbr").agg(
        F.sum("units").alias("units"), F.max("province").alias("province"), F.avg("item_nbr").alias("mean_item"), F.count("*").alias("n")
    )
    return rounded(mixed, ["mean_item"])


@query(
    "agg18_sibling_rollups",
    f"""SELECT CASE WHEN grouping(store_nbr) = 0 THEN 'store' WHEN grouping(item_nbr) = 0 THEN 'item' ELSE 'all' END AS level,
        date, store_nbr, item_nbr, sum(y) AS actual, {r6('sum(yhat)', 'forecast')} FROM predictions
        GROUP BY GROUPING SETS ((date), (store_nbr, date), (item_nbr, date))""",
)
def _(spark, d):
    return rounded(A.actual_and_forecast(panels.predictions(spark, d)), ["forecast"])


@query(
    "agg19_error_matrix",
    "SELECT store_nbr, "
    + ", ".join(r6(f"avg(abs((y - yhat) / y)) FILTER (item_nbr = {i}) * 100", f"item_{i}") for i in ITEMS)
    + " FROM predictions GROUP BY 1",
)
def _(spark, d):
    return rounded(A.error_matrix(panels.predictions(spark, d), levels(panels.items(spark, d), "item_nbr")))


@query(
    "agg20_station_day_means",
    f"SELECT date, {r6('avg(tmax)', 'tmax')}, {r6('avg(tmin)', 'tmin')}, {r6('avg(preciptotal)', 'preciptotal')} FROM weather_numeric GROUP BY 1",
)
def _(spark, d):
    return rounded(A.mean_by(panels.weather_numeric(spark, d), ["date"], ["tmax", "tmin", "preciptotal"]))


@query("agg21_value_counts", "SELECT item_nbr, count(*) AS n FROM sales GROUP BY 1 ORDER BY 1")
def _(spark, d):
    return A.value_counts(_sales(spark, d), "item_nbr")


@query("agg22_present_counts", "SELECT store_nbr, count(date) AS n_date, count(units) AS n_units FROM sales_dirty GROUP BY 1")
def _(spark, d):
    return A.present_counts(panels.sales_dirty(spark, d), "store_nbr", ["date", "units"])


@query(
    "agg23_items_by_store",
    """SELECT store_nbr, item_nbr, count(*) AS item_rows, CAST(sum(count(*)) OVER (PARTITION BY store_nbr) AS BIGINT) AS store_rows,
              count(*) OVER (PARTITION BY store_nbr) AS store_items FROM sales GROUP BY 1, 2""",
)
def _(spark, d):
    return A.items_by_store(_sales(spark, d))


@query(
    "agg24_top_and_others",
    """WITH t AS (SELECT item_nbr, sum(units) AS total FROM sales GROUP BY 1),
            r AS (SELECT *, row_number() OVER (ORDER BY total DESC, item_nbr) AS rn FROM t)
       SELECT CASE WHEN rn <= 5 THEN CAST(item_nbr AS VARCHAR) ELSE 'Others' END AS item_nbr, sum(total) AS total FROM r GROUP BY 1""",
)
def _(spark, d):
    return A.top_and_others(_sales(spark, d), "item_nbr")


@query(
    "agg25_histogram",
    """WITH s AS (SELECT min(units) AS a, (max(units) - min(units)) / 30 AS w FROM sales),
            c AS (SELECT CAST(least(floor((units - a) / w), 29) AS INT) AS bin, count(*) AS n FROM sales, s GROUP BY 1)
       SELECT CAST(i AS INT) AS bin, round(a + i * w, 6) AS low, round(a + (i + 1) * w, 6) AS high, coalesce(n, 0) AS n
       FROM (SELECT unnest(range(30)) AS i) r CROSS JOIN s LEFT JOIN c ON c.bin = i""",
)
def _(spark, d):
    return rounded(A.histogram(_sales(spark, d), "units", 30))


@query("agg25_mean_median", f"SELECT {r6('avg(units)', 'mean')}, {r6('median(units)', 'median')} FROM sales")
def _(spark, d):
    return rounded(A.center(_sales(spark, d), "units"))


_BOX = """WITH q AS (SELECT {key} AS k, quantile_cont({v}, 0.25) AS q1, median({v}) AS m, quantile_cont({v}, 0.75) AS q3 FROM {t} WHERE {v} IS NOT NULL GROUP BY 1)
  SELECT k AS {name}, round(min(q1), 6) AS q1, round(min(m), 6) AS median, round(min(q3), 6) AS q3,
    min({v}) FILTER ({v} BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5) AS whisker_low,
    max({v}) FILTER ({v} BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5) AS whisker_high,
    count(*) FILTER ({v} NOT BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5) AS outliers
  FROM {t} JOIN q ON q.k = {key} GROUP BY 1"""


@query("agg26_box_by_weekday", _BOX.format(key="CAST(isodow(date) - 1 AS INT)", name="weekday", v="units", t="sales"))
def _(spark, d):
    panel = _sales(spark, d).select(D.weekday0("date").alias("weekday"), "units")
    return rounded(A.box_summary(panel, "units", ["weekday"]))


@query("agg26_box_by_station", _BOX.format(key="station_nbr", name="station_nbr", v="tmax", t="weather_numeric"))
def _(spark, d):
    return rounded(A.box_summary(panels.weather_numeric(spark, d), "tmax", ["station_nbr"]))


_CORR_COLUMNS = ("units", "store_nbr", "item_nbr", "temperature", "humidity")
_CORR_JOIN = "sales s LEFT JOIN climate c ON s.date = c.date AND s.province = c.province"


def _numeric_panel(spark, d):
    from demandloom.operators.joins import with_climate

    return with_climate(panels.sales(spark, d), panels.climate(spark, d)).select(*_CORR_COLUMNS)


@query(
    "agg27_correlations",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {r6(f'corr({a}, {b})', 'corr')} FROM {_CORR_JOIN}"
        for i, a in enumerate(_CORR_COLUMNS)
        for b in _CORR_COLUMNS[i + 1 :]
    ),
)
def _(spark, d):
    return rounded(A.correlations(_numeric_panel(spark, d), _CORR_COLUMNS))


@query(
    "agg28_correlation_ranking",
    "SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT '{a}' AS feature, {r6(f'corr({a}, units)', 'corr')} FROM {_CORR_JOIN}" for a in _CORR_COLUMNS)
    + ") t ORDER BY corr DESC, feature LIMIT 3",
)
def _(spark, d):
    return rounded(A.correlation_with(_numeric_panel(spark, d), "units", _CORR_COLUMNS, 3))


@query(
    "agg29_trend_line",
    f"""SELECT s.province, {r6('regr_slope(units, temperature)', 'slope')}, {r6('regr_intercept(units, temperature)', 'intercept')},
        {r6('regr_r2(units, temperature)', 'r2')}, CAST(regr_count(units, temperature) AS BIGINT) AS n FROM {_CORR_JOIN} GROUP BY 1""",
)
def _(spark, d):
    from demandloom.operators.joins import with_climate

    joined = with_climate(panels.sales(spark, d), panels.climate(spark, d))
    return rounded(A.trend_line(joined, "units", "temperature", ["province"]))


@query(
    "agg30_year_profile",
    "SELECT CAST(month(date) AS INT) AS month, CAST(day(date) AS INT) AS day, "
    + ", ".join(f"sum(units) FILTER (year(date) = {y}) AS y{y}" for y in YEARS)
    + " FROM sales GROUP BY 1, 2",
)
def _(spark, d):
    sales = _sales(spark, d)
    return A.year_profile(sales, levels(sales.select(F.year("date").alias("year")), "year"))


@query("top2_top_items", "SELECT item_nbr, sum(units) AS total FROM sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, d):
    return A.ranked_totals(_sales(spark, d), "item_nbr", n=10)


@query("top2_bottom_items", "SELECT item_nbr, sum(units) AS total FROM sales GROUP BY 1 ORDER BY 2, 1 LIMIT 5")
def _(spark, d):
    return A.ranked_totals(_sales(spark, d), "item_nbr", n=5, ascending=True)


@query(
    "top3_latest_rows",
    """SELECT date, store_nbr, item_nbr, units, CAST(rn AS INT) AS recency FROM (SELECT *, row_number() OVER
       (PARTITION BY store_nbr, item_nbr ORDER BY date DESC) AS rn FROM sales) t WHERE rn <= 5""",
)
def _(spark, d):
    return A.latest_rows(_sales(spark, d)).drop("category")


@query(
    "top4_history_stats",
    f"""SELECT store_nbr, item_nbr, max_by(units, date) AS last_value, max(date) AS last_date, {r6('avg(units)', 'mean')},
        max(units) AS max, min(date) FILTER (units = m) AS max_date, min(date) AS first_date, count(*) AS n
        FROM (SELECT *, max(units) OVER (PARTITION BY store_nbr, item_nbr) AS m FROM sales) t GROUP BY 1, 2""",
)
def _(spark, d):
    return rounded(A.history_stats(_sales(spark, d)), ["mean"])


@query("top7_detail_descending", "SELECT date, store_nbr, item_nbr, category, units FROM sales ORDER BY date DESC")
def _(spark, d):
    return _sales(spark, d).orderBy(F.desc("date"))

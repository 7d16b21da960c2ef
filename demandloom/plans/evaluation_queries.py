"""Forecast error tables over the naive forecast."""

from pyspark.sql import functions as F

from demandloom import PAIR
from demandloom.functions import metrics as M
from demandloom.operators import evaluation as E
from demandloom.operators import sets as S
from demandloom.operators import windows as Wn
from demandloom.plans.aggregate_queries import ITEMS
from demandloom.plans.common import levels, r6, rounded
from demandloom.plans.registry import query
from demandloom.sources import panels

_WAPE = "sum(abs(y - yhat)) / sum(abs(y)) FILTER (yhat IS NOT NULL) * 100"
_SCORES = f"{r6('avg(abs(y - yhat))', 'mae')}, {r6('sqrt(avg((y - yhat) ** 2))', 'rmse')}, {r6(_WAPE, 'wape')}, count(yhat) AS n"
_TOP = """top AS (SELECT p.* FROM predictions p JOIN (SELECT store_nbr, item_nbr FROM predictions GROUP BY 1, 2
  ORDER BY sum(y) DESC, 1, 2 LIMIT 20) t ON p.store_nbr = t.store_nbr AND p.item_nbr = t.item_nbr)"""


@query("fc11_naive_by_store", f"SELECT store_nbr, {_SCORES} FROM predictions GROUP BY 1")
def _(spark, d):
    """The previous seven rows' mean as forecast, scored by store."""
    return rounded(E.score(panels.predictions(spark, d), ["store_nbr"]))


@query(
    "fc11_naive_comparison",
    f"""WITH f AS (SELECT units AS y, lag(units, 1) OVER w AS lag_1, lag(units, 7) OVER w AS lag_7,
          avg(units) OVER (PARTITION BY store_nbr, item_nbr ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS mean_7
          FROM sales WINDOW w AS (PARTITION BY store_nbr, item_nbr ORDER BY date)),
        t AS (SELECT 'lag_1' AS model, y, lag_1 AS yhat FROM f UNION ALL SELECT 'lag_7', y, lag_7 FROM f UNION ALL SELECT 'mean_7', y, mean_7 FROM f)
        SELECT model, {_SCORES} FROM t GROUP BY 1""",
)
def _(spark, d):
    panel = panels.sales(spark, d, province=False)
    features = Wn.rolling_stats(Wn.lags(panel, "units", [1, 7]), "units", [7], ["mean"])
    tall = features.select(
        F.col("units").alias("y"), F.col("units_lag_1").alias("lag_1"), F.col("units_lag_7").alias("lag_7"), F.col("units_mean_7d").alias("mean_7")
    ).unpivot(["y"], ["lag_1", "lag_7", "mean_7"], "model", "yhat")
    return rounded(E.score(tall, ["model"]))


@query("ev1_wape", f"SELECT store_nbr, item_nbr, {r6(_WAPE, 'wape')} FROM predictions GROUP BY 1, 2")
def _(spark, d):
    return rounded(panels.predictions(spark, d).groupBy(*PAIR).agg(M.wape().alias("wape")))


@query("ev2_mae_rmse", f"SELECT {r6('avg(abs(y - yhat))', 'mae')}, {r6('sqrt(avg((y - yhat) ** 2))', 'rmse')} FROM predictions")
def _(spark, d):
    return rounded(panels.predictions(spark, d).agg(M.mae().alias("mae"), M.rmse().alias("rmse")))


@query("ev3_rmsle", f"SELECT store_nbr, {r6('sqrt(avg((ln(1 + yhat) - ln(1 + y)) ** 2))', 'rmsle')} FROM predictions GROUP BY 1")
def _(spark, d):
    return rounded(panels.predictions(spark, d).groupBy("store_nbr").agg(M.rmsle().alias("rmsle")))


@query(
    "ev4_mape",
    f"""SELECT store_nbr, item_nbr, {r6('avg(abs((y - yhat) / nullif(y, 0))) * 100', 'mape')},
        count(*) FILTER (y = 0 AND yhat IS NOT NULL) AS zero_actuals
        FROM (SELECT * REPLACE (CASE WHEN day(date) = 1 THEN 0 ELSE y END AS y) FROM predictions) t GROUP BY 1, 2""",
)
def _(spark, d):
    """With the first of each month set to zero sales, so that zero actuals occur."""
    closed = panels.predictions(spark, d).withColumn("y", F.when(F.day("date") == 1, 0.0).otherwise(F.col("y")))
    return rounded(E.mape_by(closed))


@query(
    "ev5_two_level_summary",
    f"""WITH p AS (SELECT avg(abs(y - yhat)) AS mae, sqrt(avg((y - yhat) ** 2)) AS rmse FROM predictions GROUP BY store_nbr, item_nbr)
        SELECT {r6('avg(mae)', 'mae')}, {r6('avg(rmse)', 'rmse')}, {r6(f'(SELECT {_WAPE} FROM predictions)', 'wape')},
               count(mae) AS series FROM p""",
)
def _(spark, d):
    return rounded(E.two_level_summary(panels.predictions(spark, d)))


@query(
    "ev6_fold_summary",
    f"""WITH p AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS position, count(*) OVER () AS n
                   FROM (SELECT DISTINCT date FROM predictions) t),
        f AS (SELECT CAST((position - (n - 5 * (n // 6))) // (n // 6) AS INT) AS fold, date FROM p WHERE position >= n - 5 * (n // 6)),
        s AS (SELECT fold, avg(abs(y - yhat)) AS mae, sqrt(avg((y - yhat) ** 2)) AS rmse, {_WAPE} AS wape
              FROM predictions p JOIN f ON p.date = f.date GROUP BY 1)
        SELECT {r6('avg(mae)', 'mae')}, {r6('avg(rmse)', 'rmse')}, {r6('avg(wape)', 'wape')}, count(*) AS folds FROM s""",
)
def _(spark, d):
    return rounded(E.fold_summary(S.date_folds(panels.predictions(spark, d))))


@query(
    "ev7_residuals",
    f"""SELECT date, store_nbr, item_nbr, {r6('y - yhat', 'error')}, {r6('abs(y - yhat)', 'abs_error')},
        {r6('(y - yhat) / nullif(y, 0) * 100', 'pct_error')} FROM predictions""",
)
def _(spark, d):
    return rounded(E.with_errors(panels.predictions(spark, d)).select("date", *PAIR, "error", "abs_error", "pct_error"))


@query("ev8_error_by_date", f"SELECT date, {r6('avg(y - yhat)', 'error')} FROM predictions GROUP BY 1")
def _(spark, d):
    return rounded(E.error_by_date(panels.predictions(spark, d)))


@query(
    "ev8_error_by_weekday",
    f"""SELECT CAST(isodow(date) - 1 AS INT) AS weekday, dayname(date) AS weekday_name,
        {r6('avg((y - yhat) / nullif(y, 0) * 100)', 'pct_error')} FROM predictions GROUP BY 1, 2""",
)
def _(spark, d):
    return rounded(E.error_by_weekday(panels.predictions(spark, d)))


@query("ev8_error_by_category", f"SELECT category, {r6('avg((y - yhat) / nullif(y, 0) * 100)', 'pct_error')} FROM predictions GROUP BY 1")
def _(spark, d):
    return rounded(E.error_by_category(panels.predictions(spark, d)))


@query(
    "ev9_error_histogram",
    """WITH e AS (SELECT y - yhat AS e FROM predictions WHERE yhat IS NOT NULL),
            s AS (SELECT min(e) AS a, (max(e) - min(e)) / 50 AS w FROM e),
            c AS (SELECT CAST(least(floor((e - a) / w), 49) AS INT) AS bin, count(*) AS n FROM e, s GROUP BY 1)
       SELECT CAST(i AS INT) AS bin, round(a + i * w, 6) + 0 AS low, round(a + (i + 1) * w, 6) + 0 AS high, coalesce(n, 0) AS n
       FROM (SELECT unnest(range(50)) AS i) r CROSS JOIN s LEFT JOIN c ON c.bin = i""",
)
def _(spark, d):
    return rounded(E.error_histogram(panels.predictions(spark, d)))


@query("ev9_error_against_actual", f"SELECT store_nbr, item_nbr, date, y AS actual, {r6('y - yhat', 'error')} FROM predictions")
def _(spark, d):
    return rounded(E.error_against_actual(panels.predictions(spark, d)), ["error"])


def _report(spark, d):
    return E.forecast_report(panels.predictions(spark, d), levels(panels.items(spark, d), "item_nbr"))


@query("ev10_report_scores", f"WITH {_TOP} SELECT store_nbr, item_nbr, {_SCORES} FROM top GROUP BY 1, 2")
def _(spark, d):
    return rounded(_report(spark, d)["scores"])


@query(
    "ev10_report_rollups",
    f"""WITH {_TOP} SELECT CASE WHEN grouping(store_nbr) = 0 THEN 'store' WHEN grouping(item_nbr) = 0 THEN 'item' ELSE 'all' END AS level,
        date, store_nbr, item_nbr, sum(y) AS actual, {r6('sum(yhat)', 'forecast')} FROM top
        GROUP BY GROUPING SETS ((date), (store_nbr, date), (item_nbr, date))""",
)
def _(spark, d):
    return rounded(_report(spark, d)["rollups"], ["forecast"])


@query(
    "ev10_report_matrix",
    f"WITH {_TOP} SELECT store_nbr, " + ", ".join(r6(f"avg(abs((y - yhat) / y)) FILTER (item_nbr = {i}) * 100", f"item_{i}") for i in ITEMS) + " FROM top GROUP BY 1",
)
def _(spark, d):
    return rounded(_report(spark, d)["matrix"])


@query("ev11_store_overlay", f"SELECT item_nbr, date, y, {r6('yhat', 'yhat')} FROM predictions WHERE store_nbr = 2")
def _(spark, d):
    return rounded(E.store_overlay(panels.predictions(spark, d), 2), ["yhat"])

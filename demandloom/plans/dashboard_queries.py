"""Dashboard queries: named compositions of the other operators."""

from demandloom.operators import dashboards as DQ
from demandloom.plans.common import r6, rounded
from demandloom.plans.registry import query
from demandloom.sources import panels

_RANGE = "date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND category IN ('Dairy', 'Baby', 'Staples')"
_FILTER = DQ.Selection("1996-01-01", "1999-12-31", "All", ("Dairy", "Baby", "Staples"))


def _sales(spark, d):
    return panels.sales(spark, d, province=False)


@query(
    "dq1_historical_kpis",
    f"""WITH f AS (SELECT date, sum(units) AS v, count(*) AS n FROM sales WHERE {_RANGE} GROUP BY 1),
        k AS (SELECT DATE '1996-01-01' + CAST((DATE '1999-12-31' - DATE '1996-01-01') // 2 AS INT) AS mid)
        SELECT sum(v) AS total, {r6('avg(v)', 'mean_daily')},
          {r6("(sum(v) FILTER (date > mid) - sum(v) FILTER (date <= mid)) / sum(v) FILTER (date <= mid) * 100", 'change_pct')},
          CAST(sum(n) AS BIGINT) AS transactions, {r6('sum(v) / sum(n)', 'per_transaction')} FROM f, k""",
)
def _(spark, d):
    return rounded(DQ.historical_view(_sales(spark, d), _FILTER)["kpis"])


@query("dq1_historical_detail", f"SELECT date, store_nbr, item_nbr, category, units FROM sales WHERE {_RANGE} ORDER BY date DESC")
def _(spark, d):
    return DQ.historical_view(_sales(spark, d), _FILTER)["detail"]


@query(
    "dq2_trend",
    f"""WITH t AS (SELECT date, sum(units) AS total FROM sales WHERE {_RANGE} GROUP BY 1)
        SELECT date, total, CASE WHEN count(total) OVER w = 7 THEN round(avg(total) OVER w, 6) END AS ma7 FROM t
        WINDOW w AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
)
def _(spark, d):
    return rounded(DQ.historical_view(_sales(spark, d), _FILTER)["trend"], ["ma7"])


@query(
    "dq2_weekday_pattern",
    f"""WITH t AS (SELECT date, sum(units) AS total FROM sales WHERE {_RANGE} GROUP BY 1),
        m AS (SELECT CAST(isodow(date) - 1 AS INT) AS weekday, dayname(date) AS weekday_name, avg(total) AS mean FROM t GROUP BY 1, 2)
        SELECT weekday, weekday_name, round(mean, 6) AS mean FROM m WHERE (SELECT count(*) FROM t) >= 7""",
)
def _(spark, d):
    return rounded(DQ.historical_view(_sales(spark, d), _FILTER)["weekday_pattern"])


@query(
    "dq3_category_breakdown",
    f"""SELECT category, sum(units) AS total, round(sum(units) / sum(sum(units)) OVER () * 100, 1) AS share_pct FROM sales
        WHERE {_RANGE} GROUP BY 1""",
)
def _(spark, d):
    return DQ.historical_view(_sales(spark, d), _FILTER)["categories"]


@query("dq3_top_stores", f"SELECT store_nbr, sum(units) AS total FROM sales WHERE {_RANGE} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, d):
    return DQ.historical_view(_sales(spark, d), _FILTER)["stores"]


@query(
    "dq4_pair_recent_trend",
    """WITH r AS (SELECT date, store_nbr, item_nbr, units FROM (SELECT *, max(date) OVER (PARTITION BY store_nbr, item_nbr) AS m FROM sales) t
         WHERE date >= m - 60)
       SELECT date, store_nbr, item_nbr, units, CASE WHEN count(units) OVER w = 7 THEN round(avg(units) OVER w, 6) END AS ma7 FROM r
       WINDOW w AS (PARTITION BY store_nbr, item_nbr ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
)
def _(spark, d):
    return rounded(DQ.pair_context(_sales(spark, d))["trend"], ["ma7"])


@query(
    "dq4_pair_weekday_means",
    """WITH r AS (SELECT date, store_nbr, item_nbr, units FROM (SELECT *, max(date) OVER (PARTITION BY store_nbr, item_nbr) AS m FROM sales) t
         WHERE date >= m - 60),
       c AS (SELECT store_nbr, item_nbr, count(*) AS n FROM r GROUP BY 1, 2 HAVING count(*) >= 7)
       SELECT r.store_nbr, r.item_nbr, CAST(isodow(date) - 1 AS INT) AS weekday, round(avg(units), 6) AS mean
       FROM r JOIN c ON r.store_nbr = c.store_nbr AND r.item_nbr = c.item_nbr GROUP BY 1, 2, 3""",
)
def _(spark, d):
    return rounded(DQ.pair_context(_sales(spark, d))["weekday_means"])


@query("dq5_forecast_overlay", "SELECT date, sum(units) AS total FROM sales WHERE store_nbr = 4 GROUP BY 1")
def _(spark, d):
    return DQ.history_overlay(_sales(spark, d), store=4)


@query(
    "dq6_item_history",
    "SELECT store_nbr, item_nbr, date, sum(units) AS total FROM sales WHERE item_nbr IN (11, 23) GROUP BY 1, 2, 3",
)
def _(spark, d):
    return DQ.item_history(_sales(spark, d), item=[11, 23])


@query("dq7_weather_trend", "SELECT station_nbr, date, tmax, tmin FROM weather_numeric ORDER BY station_nbr, date")
def _(spark, d):
    return DQ.weather_trend(panels.weather_numeric(spark, d), ["tmax", "tmin"])

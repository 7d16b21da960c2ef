"""Joins."""

from pyspark.sql import functions as F

from demandloom import PAIR
from demandloom.functions import dates as D
from demandloom.operators import aggregates as A
from demandloom.operators import cleaning as C
from demandloom.operators import joins as J
from demandloom.operators import sets as S
from demandloom.operators import windows as Wn
from demandloom.plans.common import r6, rounded
from demandloom.plans.registry import query
from demandloom.sources import panels

_WEATHER = "tmax, tmin, preciptotal"


def _slim(spark, d):
    return panels.sales(spark, d, province=False).drop("category")


@query(
    "jn1_selling_pairs_only",
    """SELECT date, store_nbr, item_nbr, units FROM sales_dirty WHERE (store_nbr, item_nbr) IN
       (SELECT (store_nbr, item_nbr) FROM sales_dirty GROUP BY store_nbr, item_nbr HAVING sum(units) > 0)""",
)
def _(spark, d):
    panel = panels.sales_dirty(spark, d).select("date", *PAIR, "units")
    return J.keep_pairs(panel, A.selling_pairs(panel))


@query(
    "jn2_weather_by_store",
    f"SELECT w.station_nbr, store_nbr, date, {_WEATHER} FROM weather_numeric w JOIN store_key k ON w.station_nbr = k.station_nbr",
)
def _(spark, d):
    return J.weather_by_store(panels.weather_numeric(spark, d), panels.store_key(spark, d))


@query(
    "jn3_sales_with_weather_inner",
    f"""SELECT s.date, s.store_nbr, item_nbr, units, w.station_nbr, {_WEATHER} FROM sales s
        JOIN store_key k ON s.store_nbr = k.store_nbr JOIN weather_numeric w ON w.station_nbr = k.station_nbr AND w.date = s.date""",
)
def _(spark, d):
    return J.with_store_weather(_slim(spark, d), panels.weather_numeric(spark, d), panels.store_key(spark, d))


@query(
    "jn4_sales_with_climate_left",
    """SELECT s.date, s.store_nbr, item_nbr, s.province, units, temperature, humidity, season FROM sales s
       LEFT JOIN climate c ON s.date = c.date AND s.province = c.province""",
)
def _(spark, d):
    return J.with_climate(panels.sales(spark, d).drop("category"), panels.climate(spark, d))


@query(
    "jn5_sales_key_weather_left",
    f"""SELECT s.date, s.store_nbr, item_nbr, units, k.station_nbr, {_WEATHER} FROM sales s
        LEFT JOIN store_key k ON s.store_nbr = k.store_nbr
        LEFT JOIN weather_numeric w ON w.station_nbr = k.station_nbr AND w.date = s.date""",
)
def _(spark, d):
    return J.with_store_weather(_slim(spark, d), panels.weather_numeric(spark, d), panels.store_key(spark, d), "left")


@query(
    "jn6_weather_with_station_sales",
    """SELECT w.station_nbr, w.date, tmax, sum(units) AS units, count(*) AS n FROM weather_numeric w
       JOIN store_key k ON w.station_nbr = k.station_nbr JOIN sales s ON s.store_nbr = k.store_nbr AND s.date = w.date
       GROUP BY 1, 2, 3""",
)
def _(spark, d):
    joined = J.with_store_weather(_slim(spark, d), panels.weather_numeric(spark, d), panels.store_key(spark, d))
    return joined.groupBy("station_nbr", "date", "tmax").agg(F.sum("units").alias("units"), F.count("*").alias("n"))


@query(
    "jn7_totals_with_climate",
    """SELECT t.date, t.province, total, temperature FROM
       (SELECT date, province, sum(units) AS total FROM sales GROUP BY 1, 2) t
       JOIN climate c ON t.date = c.date AND t.province = c.province""",
)
def _(spark, d):
    totals = A.total_by(panels.sales(spark, d), ["date", "province"])
    return totals.join(panels.climate(spark, d).select("date", "province", "temperature"), ["date", "province"])


@query(
    "jn8_calendar_without_fanout",
    """SELECT s.date, store_nbr, item_nbr, units, coalesce(holiday, 0) AS holiday, coalesce(blackfriday, 0) AS blackfriday,
              coalesce(isbf, 0) AS isbf FROM sales s LEFT JOIN (SELECT date, max(holiday) AS holiday,
              max(blackfriday) AS blackfriday, max(isbf) AS isbf FROM calendar GROUP BY 1) c ON s.date = c.date""",
)
def _(spark, d):
    return J.with_calendar(_slim(spark, d), panels.calendar(spark))


@query(
    "jn9_merge_calendars",
    """WITH h AS (SELECT date AS ds, 0 AS lower_window, 1 AS upper_window, count(*) AS orders FROM ship_days JOIN
              (SELECT CAST(o_orderdate AS DATE) AS od FROM orders) o ON od = date GROUP BY 1),
            b AS (SELECT date AS ds, 0 AS lower_window, 1 AS upper_window, blackfriday FROM calendar WHERE isbf = 1)
       SELECT ds, lower_window, upper_window, orders, blackfriday FROM h FULL JOIN b USING (ds, lower_window, upper_window)""",
)
def _(spark, d):
    """Days with orders fully merged with the long weekends."""
    effect = {"lower_window": F.lit(0), "upper_window": F.lit(1)}
    ordered = panels.table(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(F.count("*").alias("orders"))
    busy = ordered.join(panels.ship_days(spark, d), "date").withColumnRenamed("date", "ds").withColumns(effect)
    weekends = panels.calendar(spark).where("isbf = 1").select(F.col("date").alias("ds"), "blackfriday").withColumns(effect)
    return J.merge_calendars(busy, weekends)


@query(
    "dt10_holiday_calendar",
    """WITH h AS (SELECT DISTINCT s.date AS ds, 1 AS holiday FROM ship_days s JOIN calendar c ON s.date = c.date WHERE c.holiday = 1),
            t AS (SELECT date, make_date(year(date), 11, 1) + CAST((11 - isodow(make_date(year(date), 11, 1))) % 7 + 21 AS INT) AS turkey
                  FROM ship_days),
            b AS (SELECT date AS ds, CAST(date - turkey AS INT) AS blackfriday FROM t WHERE date - turkey BETWEEN 1 AND 4)
       SELECT ds, 0 AS lower_window, 1 AS upper_window, holiday, blackfriday FROM h FULL JOIN b USING (ds)""",
)
def _(spark, d):
    """Holidays and the long weekend after Thanksgiving among the sales days, merged on day and effect window."""
    effect = {"lower_window": F.lit(0), "upper_window": F.lit(1)}
    days = panels.ship_days(spark, d)
    listed = panels.calendar(spark).where("holiday = 1").select("date").distinct()
    holidays = days.join(listed, "date").select(F.col("date").alias("ds"), F.lit(1).alias("holiday")).withColumns(effect)
    ranked = days.select(F.col("date").alias("ds"), D.black_friday_rank("date").alias("blackfriday")).withColumns(effect)
    return J.merge_calendars(holidays, ranked.where(F.col("blackfriday") > 0))


@query(
    "jn10_forecast_to_actuals",
    f"""SELECT p.store_nbr, p.item_nbr, p.date, units, {r6('yhat', 'yhat')} FROM predictions p
        JOIN sales s ON p.store_nbr = s.store_nbr AND p.item_nbr = s.item_nbr AND p.date = s.date WHERE yhat IS NOT NULL""",
)
def _(spark, d):
    forecast = panels.predictions(spark, d).select(*PAIR, "date", "yhat").where(F.col("yhat").isNotNull())
    return rounded(J.with_forecast(_slim(spark, d), forecast), ["yhat"])


@query(
    "jn11_top_pairs",
    """SELECT date, s.store_nbr, s.item_nbr, units FROM sales s JOIN
       (SELECT store_nbr, item_nbr FROM sales GROUP BY 1, 2 ORDER BY sum(units) DESC, 1, 2 LIMIT 20) t
       ON s.store_nbr = t.store_nbr AND s.item_nbr = t.item_nbr""",
)
def _(spark, d):
    panel = _slim(spark, d)
    return J.keep_pairs(panel, J.top_pairs(panel, "units", 20))


@query(
    "jn12_peer_join",
    f"""SELECT w.station_nbr, w.date, {r6('coalesce(w.tmax, p.tmax)', 'tmax')} FROM weather_numeric w LEFT JOIN
        (SELECT date, avg(tmax) AS tmax FROM weather_numeric WHERE station_nbr NOT IN (5, 8) GROUP BY 1) p ON w.date = p.date""",
)
def _(spark, d):
    weather = panels.weather_numeric(spark, d).select("station_nbr", "date", "tmax")
    return rounded(C.peer_fill(weather, ["tmax"], ~F.col("station_nbr").isin(5, 8)))


_EVENT_SQL = """WITH e AS (SELECT DISTINCT {key} CAST(date + CAST(k AS INT) AS DATE) AS date FROM weather_numeric,
              (SELECT unnest([-3, -2, -1, 0, 1, 2, 3]) AS k) o WHERE preciptotal > 1)
       SELECT w.station_nbr, w.date, CAST(e.date IS NOT NULL AS INT) AS event FROM weather_numeric w LEFT JOIN e ON w.date = e.date {on}"""


@query("jn13_storm_window_by_station", _EVENT_SQL.format(key="station_nbr,", on="AND w.station_nbr = e.station_nbr"))
def _(spark, d):
    weather = panels.weather_numeric(spark, d)
    return J.event_flag(weather, S.storm_days(weather)).select("station_nbr", "date", "event")


@query("jn13_storm_window_pooled", _EVENT_SQL.format(key="", on=""))
def _(spark, d):
    weather = panels.weather_numeric(spark, d)
    return J.event_flag(weather, S.storm_days(weather), keys=()).select("station_nbr", "date", "event")


@query(
    "jn14_dense_panel",
    """WITH span AS (SELECT CAST(unnest(generate_series(CAST((SELECT min(date) FROM sales) AS TIMESTAMP),
              CAST((SELECT max(date) FROM sales) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date),
            cells AS (SELECT DISTINCT province, category FROM sales),
            t AS (SELECT province, category, date, sum(units) AS units FROM sales GROUP BY 1, 2, 3)
       SELECT c.province, c.category, s.date, coalesce(units, 0.0) AS units FROM cells c CROSS JOIN span s
       LEFT JOIN t ON t.province = c.province AND t.category = c.category AND t.date = s.date""",
)
def _(spark, d):
    """Units of every province and category on every day, zero where nothing was sold."""
    keys = ("province", "category")
    return J.densify(A.total_by(panels.sales(spark, d), [*keys, "date"], name="units"), "units", keys)


@query(
    "jn15_fallback_zero",
    """SELECT s.date, s.store_nbr, s.item_nbr, coalesce(m.mean, 0.0) > 0 AS known, count(*) OVER () AS n FROM sales s
       LEFT JOIN (SELECT store_nbr, item_nbr, avg(units) AS mean FROM sales WHERE date < DATE '2001-01-01' GROUP BY 1, 2
                  HAVING count(*) >= 20) m ON s.store_nbr = m.store_nbr AND s.item_nbr = m.item_nbr""",
)
def _(spark, d):
    from demandloom.operators import forecast as Fc

    panel = _slim(spark, d)
    early = panel.where(F.col("date") < F.lit(panels.TEST_START).cast("date"))
    models = early.groupBy(*PAIR).agg(F.avg("units").alias("yhat"), F.count("*").alias("_n")).where("_n >= 20").drop("_n")
    total = panel.select(F.count("*")).scalar()
    return Fc.with_fallback(panel, models).select("date", *PAIR, (F.col("yhat") > 0).alias("known"), total.alias("n"))


@query(
    "jn15_pairs_without_model",
    """SELECT DISTINCT store_nbr, item_nbr FROM sales EXCEPT SELECT store_nbr, item_nbr FROM sales
       WHERE date < DATE '2001-01-01' GROUP BY 1, 2 HAVING count(*) >= 20""",
)
def _(spark, d):
    panel = _slim(spark, d)
    early = panel.where(F.col("date") < F.lit(panels.TEST_START).cast("date"))
    models = early.groupBy(*PAIR).agg(F.count("*").alias("_n")).where("_n >= 20")
    return S.distinct_pairs(panel).join(models, list(PAIR), "left_anti")


@query(
    "jn16_unique_key",
    """SELECT k.store_nbr, min(k.station_nbr) AS station_nbr, count(*) AS n FROM store_key k JOIN sales s
       ON s.store_nbr = k.store_nbr GROUP BY 1""",
)
def _(spark, d):
    key = J.unique_key(panels.store_key(spark, d))
    counts = _slim(spark, d).groupBy("store_nbr").agg(F.count("*").alias("n"))
    return key.join(counts, "store_nbr")


@query(
    "jn18_shift_pairs",
    """SELECT date, store_nbr, item_nbr, units, """
    + ", ".join(f"lag(units, {k}) OVER (PARTITION BY store_nbr, item_nbr ORDER BY date) AS units_lag_{k}" for k in (1, 2, 7, 14))
    + " FROM sales",
)
def _(spark, d):
    return Wn.lags(_slim(spark, d), "units", [1, 2, 7, 14])


@query(
    "jn17_positional_join",
    """WITH a AS (SELECT row_number() OVER (ORDER BY date, store_nbr, item_nbr) - 1 AS position, date, store_nbr, item_nbr, units FROM sales),
            b AS (SELECT row_number() OVER (ORDER BY date, province) - 1 AS position, date AS date_right, province, temperature FROM climate)
       SELECT coalesce(a.position, b.position) AS position, date, store_nbr, item_nbr, units, date_right, province, temperature
       FROM a FULL JOIN b ON a.position = b.position""",
)
def _(spark, d):
    """Two tables side by side by row number, the longer one to its end."""
    panel = panels.sales(spark, d, province=False).drop("category")
    climate = panels.climate(spark, d).select("date", "province", "temperature")
    return J.positional_join(panel, climate, ["date", *PAIR], ["date", "province"])

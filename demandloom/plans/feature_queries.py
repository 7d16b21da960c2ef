"""Whole feature tables."""

from demandloom import PAIR, schema
from demandloom.functions import dates as D
from demandloom.operators import features as Ft
from demandloom.plans.common import r6, rounded
from demandloom.plans.registry import query
from demandloom.session import materialize
from demandloom.sources import panels

_W = "PARTITION BY store_nbr, item_nbr ORDER BY date"
_STATS = {"mean": "avg", "min": "min", "max": "max", "std": "stddev_samp"}
_EWMA = """list_sum(list_transform(p, lambda x, i: x * pow({k}::DOUBLE, len(p) - i)))
  / list_sum(list_transform(p, lambda x, i: pow({k}::DOUBLE, len(p) - i)))"""
_LISTED = ("1998-01-01", "1998-07-04", "1999-12-25")

_PROVINCE_SQL = (
    """WITH f AS (SELECT date, store_nbr, item_nbr, province, category, coalesce(units, (SELECT avg(units) FROM sales_dirty)) AS u FROM sales_dirty),
  z AS (SELECT avg(u) AS m, stddev_samp(u) AS s FROM f),
  c AS (SELECT f.* EXCLUDE (u), CASE WHEN abs(u - m) > 3 * s THEN m ELSE u END AS sales FROM f, z),
  j AS (SELECT c.*, temperature, humidity, season FROM c LEFT JOIN climate k ON c.date = k.date AND c.province = k.province),
  h AS (SELECT *, """
    + ", ".join(f"lag(sales, {k}) OVER ({_W}) AS sales_lag_{k}" for k in (1, 7, 14, 28))
    + ", "
    + ", ".join(f"{fn}(sales) OVER ({_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS sales_{s}_{n}d" for n in (7, 14, 28) for s, fn in _STATS.items())
    + f""", list(sales) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
      avg(sales) OVER (PARTITION BY store_nbr, date) AS store_mean_sameday, sum(sales) OVER (PARTITION BY store_nbr, date) AS store_sum_sameday,
      avg(sales) OVER (PARTITION BY item_nbr, date) AS item_mean_sameday, sum(sales) OVER (PARTITION BY item_nbr, date) AS item_sum_sameday FROM j)
SELECT date, store_nbr, item_nbr, province, category, {r6('sales', 'sales')}, {r6('temperature', 'temperature')}, humidity, """
    + ", ".join(r6(f"sales_lag_{k}", f"sales_lag_{k}") for k in (1, 7, 14, 28))
    + ", "
    + ", ".join(r6(f"sales_{s}_{n}d", f"sales_{s}_{n}d") for n in (7, 14, 28) for s in _STATS)
    + ", "
    + ", ".join(r6(_EWMA.format(k=k), f"sales_ewma_{a}_{n}d") for a, k in ((5, 0.5), (75, 0.25)) for n in (7, 14, 28))
    + ", "
    + ", ".join(r6(f"{k}_{s}_sameday", f"{k}_{s}_sameday") for k in ("store", "item") for s in ("mean", "sum"))
    + """, date >= DATE '2001-01-01' AS is_test, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, CAST(day(date) AS INT) AS day,
  CAST(quarter(date) AS INT) AS quarter, CAST(isodow(date) - 1 AS INT) AS day_of_week, CAST(isodow(date) >= 6 AS INT) AS is_weekend,
  CAST(date IN (DATE '1998-01-01', DATE '1998-07-04', DATE '1999-12-25') AS INT) AS is_holiday, concat_ws('_', store_nbr, item_nbr) AS store_item, """
    + ", ".join(f"CAST(season = '{s}' AS INT) AS season_{s}" for s in Ft.SEASONS[1:])
    + """, CAST(temperature > 20 AND temperature <= 25 AS INT) AS temp_category_Cool, CAST(temperature > 25 AND temperature <= 30 AS INT) AS temp_category_Warm,
  CAST(temperature > 30 AS INT) AS temp_category_Hot, CAST(humidity > 60 AND humidity <= 75 AS INT) AS humidity_level_Medium,
  CAST(humidity > 75 AS INT) AS humidity_level_High FROM h WHERE sales_lag_28 IS NOT NULL AND temperature IS NOT NULL AND sales_std_7d IS NOT NULL"""
)


@query("features_by_province", _PROVINCE_SQL)
def _(spark, d):
    """Cleaned demand with all features of the province edition, complete rows only."""
    panel = Ft.clean_demand(materialize(panels.sales_dirty(spark, d), "panel"))
    table = Ft.province_features(panel, panels.climate(spark, d), panels.TEST_START, D.listed_day("date", _LISTED))
    return rounded(table)


_DENSE = ("tmax", "tmin")


def _interpolated(c):
    p = "PARTITION BY station_nbr ORDER BY date"
    return f"""{c}_b AS (SELECT station_nbr, date, lo, hi, row_number() OVER ({p}) AS rn, CASE WHEN {c} BETWEEN lo AND hi THEN {c} END AS v FROM weather_numeric,
      (SELECT q1 - 3 * (q3 - q1) AS lo, q3 + 3 * (q3 - q1) AS hi FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM weather_numeric) q) b),
    {c}_k AS (SELECT *, CASE WHEN v IS NOT NULL THEN rn END AS kr FROM {c}_b),
    {c}_n AS (SELECT *, last_value(v IGNORE NULLS) OVER p AS v0, last_value(kr IGNORE NULLS) OVER p AS r0, first_value(v IGNORE NULLS) OVER f AS v1,
      first_value(kr IGNORE NULLS) OVER f AS r1 FROM {c}_k WINDOW p AS ({p} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      f AS ({p} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    {c}_i AS (SELECT station_nbr, date, CASE WHEN v IS NOT NULL THEN v WHEN r1 IS NULL THEN v0 ELSE v0 + (v1 - v0) / (r1 - r0) * (rn - r0) END AS {c} FROM {c}_n)"""


_READINGS = ("tmax", "tmin", "preciptotal")
_REPAIRED_SQL = f"""{_interpolated('tmax')}, {_interpolated('tmin')},
  w AS (SELECT r.station_nbr, r.date, codesum, a.tmax, b.tmin, n.preciptotal FROM weather_raw r JOIN tmax_i a ON a.station_nbr = r.station_nbr AND a.date = r.date
        JOIN tmin_i b ON b.station_nbr = r.station_nbr AND b.date = r.date JOIN weather_numeric n ON n.station_nbr = r.station_nbr AND n.date = r.date),
  s AS (SELECT * REPLACE (coalesce(tmax, avg(tmax) OVER g) AS tmax, coalesce(tmin, avg(tmin) OVER g) AS tmin, coalesce(preciptotal, avg(preciptotal) OVER g) AS preciptotal)
        FROM w WINDOW g AS (PARTITION BY station_nbr))"""
_FILLED = {c: f"coalesce({c}, (SELECT avg({c}) FROM s))" for c in _READINGS}
_CODES_SQL = ", ".join(f"""CAST(list_contains(string_split(coalesce(codesum, ''), ' '), '{c}') AS INT) AS "{c}\"""" for c in schema.WEATHER_CODES)
_DATE_PARTS_SQL = """CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, CAST(day(date) AS INT) AS day,
         CAST(isodow(date) - 1 AS INT) AS day_of_week, CAST(dayofyear(date) AS INT) AS day_of_year, CAST(weekofyear(date) AS INT) AS week_of_year,
         CAST(quarter(date) AS INT) AS quarter, CAST(isodow(date) >= 6 AS INT) AS is_weekend, CAST(month(date) % 12 // 3 AS INT) AS season,
         CAST(month(date) % 12 // 3 = 1 AS INT) AS "season_Spring", CAST(month(date) % 12 // 3 = 2 AS INT) AS "season_Summer",
         CAST(month(date) % 12 // 3 = 0 AS INT) AS "season_Winter",
         CAST(date - (make_date(year(date), 11, 1) + CAST((11 - isodow(make_date(year(date), 11, 1))) % 7 + 21 AS INT)) BETWEEN 1 AND 4 AS INT) AS is_blackfriday"""


@query("weather_by_station_cleaned", f"WITH {_REPAIRED_SQL} SELECT station_nbr, date, {', '.join(r6(_FILLED[c], c) for c in _READINGS)}, {_CODES_SQL} FROM s")
def _(spark, d):
    """Station readings ready to join: indicators, numbers, repaired and filled."""
    return rounded(Ft.clean_station_weather(panels.weather_raw(spark, d), _DENSE, codes=schema.WEATHER_CODES))


_STATION_LAGS = (1, 2, 3, 4, 5, 6, 7, 14, 21, 28)
_FLAGS = ("holiday", "blackfriday", "isbf")


def _smooth(a):
    """Recursive mean with weight `a` of the newest value over the values `p` before a row; none of them is missing."""
    return f"CASE WHEN len(p) > 0 THEN list_reduce(p, lambda s, v: ({1 - a} * s + {a} * v) / ({1 - a} + {a})) END"


def _rows_before(key, tie):
    return f"OVER (PARTITION BY {key}_nbr ORDER BY date, {tie}_nbr ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"


_STATION_SQL = (
    f"""WITH {_REPAIRED_SQL},
  x AS (SELECT station_nbr, date, {', '.join(f'{e} AS {c}' for c, e in _FILLED.items())}, {_CODES_SQL} FROM s),
  f AS (SELECT date, store_nbr, item_nbr, coalesce(units, avg(units) OVER (PARTITION BY store_nbr, item_nbr)) AS u FROM sales_dirty
        WHERE (store_nbr, item_nbr) IN (SELECT (store_nbr, item_nbr) FROM sales_dirty GROUP BY store_nbr, item_nbr HAVING sum(units) > 0)),
  z AS (SELECT avg(u) AS m, stddev_samp(u) AS sd FROM f),
  c AS (SELECT date, store_nbr, item_nbr, CASE WHEN abs(u - m) > 3 * sd THEN m ELSE u END AS units FROM f, z),
  k AS (SELECT store_nbr, min(station_nbr) AS station_nbr FROM store_key GROUP BY 1),
  e AS (SELECT date, {', '.join(f'max({c}) AS {c}' for c in _FLAGS)} FROM calendar GROUP BY 1),
  j AS (SELECT c.*, k.station_nbr, x.* EXCLUDE (station_nbr, date), {', '.join(f'CAST(coalesce(e.{c}, 0) AS INT) AS {c}' for c in _FLAGS)}
        FROM c JOIN k ON k.store_nbr = c.store_nbr JOIN x ON x.date = c.date AND x.station_nbr = k.station_nbr LEFT JOIN e ON e.date = c.date),
  h AS (SELECT *, """
    + ", ".join(f"lag(units, {n}) OVER ({_W}) AS units_lag_{n}" for n in _STATION_LAGS)
    + ", "
    + ", ".join(f"{fn}(units) OVER ({_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS units_{s}_{n}d" for n in (7, 14, 28) for s, fn in _STATS.items())
    + f""", coalesce(list(units) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS p, """
    + ", ".join(
        f"{fn}(units) {_rows_before(*pair)} AS {pair[0]}_{s}_7r" for pair in (("store", "item"), ("item", "store")) for s, fn in (("sum", "sum"), ("mean", "avg"))
    )
    + """ FROM j)
SELECT date, store_nbr, item_nbr, station_nbr, """
    + ", ".join(
        r6(c, c)
        for c in (
            "units",
            *_READINGS,
            *(f"units_lag_{n}" for n in _STATION_LAGS),
            *(f"units_{s}_{n}d" for n in (7, 14, 28) for s in _STATS),
            *(f"{key}_{s}_7r" for key in ("store", "item") for s in ("sum", "mean")),
        )
    )
    + f", {r6('ln(1 + units)', 'logunits')}, {r6(_smooth(0.5), 'units_ewma_5')}, {r6(_smooth(0.75), 'units_ewma_75')}, "
    + ", ".join(f'"{c}"' for c in (*schema.WEATHER_CODES, *_FLAGS))
    + f", {_DATE_PARTS_SQL} FROM h"
)


@query("features_by_station", _STATION_SQL)
def _(spark, d):
    """Selling series with weather, calendar, date parts and leak-free history of the station edition."""
    raw = materialize(panels.weather_raw(spark, d), "weather")
    weather = materialize(Ft.clean_station_weather(raw, _DENSE, codes=schema.WEATHER_CODES), "weather")
    panel = materialize(panels.sales_dirty(spark, d).select("date", *PAIR, "units"), "panel")
    return rounded(Ft.station_features(panel, weather, panels.store_key(spark, d), panels.calendar(spark)))


@query("date_parts_table", f"SELECT date, {_DATE_PARTS_SQL} FROM ship_days")
def _(spark, d):
    return D.with_date_parts(panels.ship_days(spark, d))

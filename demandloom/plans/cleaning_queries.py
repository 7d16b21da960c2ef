"""Imputation, outlier repair, fault injection."""

from pyspark.sql import functions as F

from demandloom import PAIR
from demandloom.operators import cleaning as C
from demandloom.operators import joins as J
from demandloom.plans.common import r6, rounded
from demandloom.plans.registry import query
from demandloom.sources import panels

_KEYS = "date, store_nbr, item_nbr"
_PAIR_W = "PARTITION BY store_nbr, item_nbr ORDER BY date"


def _dirty(spark, d):
    return panels.sales_dirty(spark, d).select("date", *PAIR, "units")


@query("imp1_global_mean", f"SELECT {_KEYS}, {r6('coalesce(units, (SELECT avg(units) FROM sales_dirty))', 'units')} FROM sales_dirty")
def _(spark, d):
    return rounded(C.fill_global_mean(_dirty(spark, d)))


@query(
    "imp2_series_mean",
    f"SELECT {_KEYS}, {r6('coalesce(units, avg(units) OVER (PARTITION BY store_nbr, item_nbr))', 'units')} FROM sales_dirty",
)
def _(spark, d):
    return rounded(C.fill_group_mean(_dirty(spark, d)))


# Station 5's thermometer counts as dead, so that the second stage has something to fill.
_DEAD = "(SELECT station_nbr, date, CASE WHEN station_nbr <> 5 THEN tmax END AS tmax, tmin FROM weather_numeric)"


@query(
    "imp3_station_then_global",
    f"""WITH s AS (SELECT station_nbr, date, coalesce(tmax, avg(tmax) OVER (PARTITION BY station_nbr)) AS tmax,
          coalesce(tmin, avg(tmin) OVER (PARTITION BY station_nbr)) AS tmin FROM {_DEAD} w)
        SELECT station_nbr, date, {r6('coalesce(tmax, (SELECT avg(tmax) FROM s))', 'tmax')},
               {r6('coalesce(tmin, (SELECT avg(tmin) FROM s))', 'tmin')} FROM s""",
)
def _(spark, d):
    weather = panels.weather_numeric(spark, d).drop("preciptotal")
    dead = weather.withColumn("tmax", F.when(F.col("station_nbr") != 5, F.col("tmax")))
    return rounded(C.fill_station_then_global(dead, ["tmax", "tmin"]))


_CARRY = "PARTITION BY station_nbr ORDER BY date ROWS BETWEEN"


@query(
    "imp4_mean_then_carry",
    f"""WITH m AS (SELECT station_nbr, date, coalesce(tmax, (SELECT avg(tmax) FROM weather_numeric)) AS tmax,
          last_value(tmin IGNORE NULLS) OVER ({_CARRY} UNBOUNDED PRECEDING AND CURRENT ROW) AS f, tmin FROM weather_numeric)
        SELECT station_nbr, date, {r6('tmax', 'tmax')},
          coalesce(f, first_value(f IGNORE NULLS) OVER ({_CARRY} CURRENT ROW AND UNBOUNDED FOLLOWING)) AS tmin FROM m""",
)
def _(spark, d):
    weather = panels.weather_numeric(spark, d).drop("preciptotal")
    return rounded(C.fill_mean_then_carry(weather, ["tmax"], ["tmin"], ["station_nbr"]), ["tmax"])


def _interpolated(table, keys, value, partition):
    """SQL of a linear interpolation by row position."""
    return f"""n AS (SELECT *, row_number() OVER ({partition}) AS rn FROM {table}),
      k AS (SELECT *, CASE WHEN {value} IS NOT NULL THEN rn END AS kr FROM n),
      b AS (SELECT *, last_value({value} IGNORE NULLS) OVER p AS v0, last_value(kr IGNORE NULLS) OVER p AS r0,
            first_value({value} IGNORE NULLS) OVER f AS v1, first_value(kr IGNORE NULLS) OVER f AS r1 FROM k
            WINDOW p AS ({partition} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                   f AS ({partition} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
      SELECT {keys}, {r6(f'CASE WHEN {value} IS NOT NULL THEN {value} WHEN r1 IS NULL THEN v0 ELSE v0 + (v1 - v0) / (r1 - r0) * (rn - r0) END', value)} FROM b"""


@query("imp5_interpolate", "WITH " + _interpolated("sales_dirty", _KEYS, "units", _PAIR_W))
def _(spark, d):
    return rounded(C.interpolate(_dirty(spark, d), ["units"]))


@query(
    "imp6_carry_both_ways",
    f"""WITH f AS (SELECT {_KEYS}, units, last_value(units IGNORE NULLS) OVER ({_PAIR_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ffill,
          first_value(units IGNORE NULLS) OVER ({_PAIR_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bfill FROM sales_dirty)
        SELECT * FROM f""",
)
def _(spark, d):
    marked = _dirty(spark, d).withColumns({"ffill": F.col("units"), "bfill": F.col("units")})
    return C.carry(C.carry(marked, ["ffill"], PAIR), ["bfill"], PAIR, back=True)


@query(
    "imp7_peer_mean",
    f"""SELECT w.station_nbr, w.date, {r6('CASE WHEN w.station_nbr IN (1, 5, 7) THEN coalesce(w.tmax, p.tmax) ELSE w.tmax END', 'tmax')}
        FROM weather_numeric w LEFT JOIN (SELECT date, avg(tmax) AS tmax FROM weather_numeric
          WHERE station_nbr IN (2, 3, 4, 6, 11, 14, 15, 18, 19) GROUP BY 1) p ON w.date = p.date""",
)
def _(spark, d):
    weather = panels.weather_numeric(spark, d).select("station_nbr", "date", "tmax")
    station = F.col("station_nbr")
    return rounded(C.peer_fill(weather, ["tmax"], station.isin(2, 3, 4, 6, 11, 14, 15, 18, 19), station.isin(1, 5, 7)))


@query(
    "imp8_replace_station",
    f"""SELECT w.station_nbr, w.date, {r6('CASE WHEN w.station_nbr = 8 THEN p.tmin ELSE w.tmin END', 'tmin')}
        FROM weather_numeric w LEFT JOIN (SELECT date, avg(tmin) AS tmin FROM weather_numeric
          WHERE station_nbr NOT IN (5, 8) GROUP BY 1) p ON w.date = p.date""",
)
def _(spark, d):
    weather = panels.weather_numeric(spark, d).select("station_nbr", "date", "tmin")
    return rounded(C.peer_replace(weather, "tmin", F.col("station_nbr") == 8, ~F.col("station_nbr").isin(5, 8)))


@query(
    "imp10_missing_points",
    f"""SELECT store_nbr, item_nbr, date, carried FROM (SELECT *, last_value(units IGNORE NULLS) OVER
        ({_PAIR_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM sales_dirty) t WHERE units IS NULL""",
)
def _(spark, d):
    return C.missing_points(_dirty(spark, d))


@query(
    "out1_flatten_outliers",
    f"""SELECT {_KEYS}, {r6('CASE WHEN abs(units - m) > 3 * s THEN m ELSE units END', 'units')} FROM sales_dirty,
        (SELECT avg(units) AS m, stddev_samp(units) AS s FROM sales_dirty) z""",
)
def _(spark, d):
    return rounded(C.flatten_outliers(_dirty(spark, d)))


@query(
    "out1_flatten_outliers_by_series",
    f"""SELECT {_KEYS}, {r6('CASE WHEN abs(units - m) > 3 * s THEN m ELSE units END', 'units')} FROM
        (SELECT *, avg(units) OVER w AS m, stddev_samp(units) OVER w AS s FROM sales_dirty
         WINDOW w AS (PARTITION BY store_nbr, item_nbr)) t""",
)
def _(spark, d):
    return rounded(C.flatten_outliers(_dirty(spark, d), by=PAIR))


# A factor below the usual 3, since the readings are even enough to have no value beyond three widths.
_FACTOR = 0.4
_BOUNDS = f"""bnd AS (SELECT quantile_cont(tmax, 0.25) - {_FACTOR} * (quantile_cont(tmax, 0.75) - quantile_cont(tmax, 0.25)) AS lo,
                         quantile_cont(tmax, 0.75) + {_FACTOR} * (quantile_cont(tmax, 0.75) - quantile_cont(tmax, 0.25)) AS hi FROM weather_numeric)"""


@query(
    "out2_repair_outliers",
    f"WITH {_BOUNDS}, w AS (SELECT station_nbr, date, CASE WHEN tmax BETWEEN lo AND hi THEN tmax END AS tmax FROM weather_numeric, bnd), "
    + _interpolated("w", "station_nbr, date", "tmax", "PARTITION BY station_nbr ORDER BY date"),
)
def _(spark, d):
    weather = panels.weather_numeric(spark, d).select("station_nbr", "date", "tmax")
    return rounded(C.repair_outliers(weather, ["tmax"], factor=_FACTOR))


@query(
    "out2_outlier_report",
    f"""WITH {_BOUNDS} SELECT 'tmax' AS "column", {r6('min(lo)', 'low')}, {r6('min(hi)', 'high')},
        count(*) FILTER (tmax < lo OR tmax > hi) AS outliers FROM weather_numeric, bnd""",
)
def _(spark, d):
    return rounded(C.outlier_report(panels.weather_numeric(spark, d), ["tmax"], factor=_FACTOR))


@query(
    "out2_outlier_report_zscore",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {r6('min(m - 1.5 * s)', 'low')}, {r6('min(m + 1.5 * s)', 'high')},
            count(*) FILTER (abs({c} - m) > 1.5 * s) AS outliers FROM weather_numeric,
            (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM weather_numeric) z"""
        for c in ("tmax", "tmin")
    ),
)
def _(spark, d):
    return rounded(C.outlier_report(panels.weather_numeric(spark, d), ["tmax", "tmin"], "zscore", 1.5))


@query(
    "out3_dense_columns_only",
    """SELECT 'tmax' AS "column", count(*) AS n FROM weather_numeric UNION ALL SELECT 'tmin', count(*) FROM weather_numeric""",
)
def _(spark, d):
    """Columns that outlier repair may touch, with their row counts."""
    weather = panels.weather_numeric(spark, d)
    dense = C.repairable_columns([c for c in weather.columns if c not in ("station_nbr", "date")])
    names = F.explode(F.array(*map(F.lit, dense)))
    return weather.agg(F.count("*").alias("n")).select(names.alias("column"), "n")

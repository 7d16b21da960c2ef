"""Lags, rolling statistics, context features and autocorrelation."""

from pyspark.sql import functions as F

from demandloom import PAIR
from demandloom.operators import aggregates as A
from demandloom.operators import windows as Wn
from demandloom.plans.common import r6, rounded
from demandloom.plans.registry import query
from demandloom.sources import panels

_PAIR_W = "PARTITION BY store_nbr, item_nbr ORDER BY date"
_KEYS = "date, store_nbr, item_nbr"


def _slim(spark, d):
    return panels.sales(spark, d, province=False).drop("category")


def _dirty(spark, d):
    return panels.sales_dirty(spark, d).select("date", *PAIR, "units")


def _rolling_sql(sizes):
    functions = {"mean": "avg", "min": "min", "max": "max", "std": "stddev_samp"}
    return ", ".join(
        r6(f"{fn}(units) OVER ({_PAIR_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)", f"units_{s}_{n}d")
        for n in sizes
        for s, fn in functions.items()
    )


@query(
    "win1_lags",
    f"SELECT {_KEYS}, units, "
    + ", ".join(f"lag(units, {k}) OVER ({_PAIR_W}) AS units_lag_{k}" for k in (1, 2, 3, 4, 5, 6, 7, 14, 21, 28))
    + " FROM sales_dirty",
)
def _(spark, d):
    return Wn.lags(_dirty(spark, d), "units", [1, 2, 3, 4, 5, 6, 7, 14, 21, 28])


@query("win2_rolling_stats", f"SELECT {_KEYS}, {_rolling_sql((7, 14, 28))} FROM sales")
def _(spark, d):
    return rounded(Wn.rolling_stats(_slim(spark, d), "units").drop("units"))


@query("win2_rolling_stats_with_gaps", f"SELECT {_KEYS}, {_rolling_sql((7,))} FROM sales_dirty")
def _(spark, d):
    return rounded(Wn.rolling_stats(_dirty(spark, d), "units", [7]).drop("units"))


def _ewma_sql(view, alphas, adjust):
    """Over all earlier known values with their places in the series."""
    def mean(a):
        if adjust:
            weight = f"pow({1 - a}::DOUBLE, p[len(p)].n - v.n)"
            return f"list_sum(list_transform(p, lambda v: {weight} * v.m)) / list_sum(list_transform(p, lambda v: {weight}))"
        aged = f"pow({1 - a}::DOUBLE, v.n - s.n)"
        return f"CASE WHEN len(p) > 0 THEN list_reduce(p, lambda s, v: {{'n': v.n, 'm': ({aged} * s.m + {a} * v.m) / ({aged} + {a})}}).m END"

    return f"""WITH r AS (SELECT {_KEYS}, units::DOUBLE AS x, row_number() OVER ({_PAIR_W}) AS n FROM {view}),
        t AS (SELECT {_KEYS}, coalesce(list({{'n': n::DOUBLE, 'm': x}}) FILTER (WHERE x IS NOT NULL)
              OVER ({_PAIR_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS p FROM r)
        SELECT {_KEYS}, {", ".join(r6(mean(a), f"ewma_{int(a * 100)}") for a in alphas)} FROM t"""


def _ewma(df, adjust):
    smooth = Wn.ewma(df, "units", (0.5, 0.75), adjust=adjust)
    return rounded(
        smooth.select("date", *PAIR, F.col("`units_ewma_0.5`").alias("ewma_50"), F.col("`units_ewma_0.75`").alias("ewma_75"))
    )


def _gappy(spark, d):
    """Half of the series have no figures for five years."""
    lost = F.col("date").between("1996-01-01", "2000-12-31") & ((F.col("store_nbr") + F.col("item_nbr")) % 2 == 0)
    return _slim(spark, d).withColumn("units", F.when(~lost, F.col("units")))


_GAPPY = """(SELECT * REPLACE (CASE WHEN NOT (date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' AND (store_nbr + item_nbr) % 2 = 0)
              THEN units END AS units) FROM sales) g"""


@query("win3_ewma", _ewma_sql("sales", (0.5, 0.75), False))
def _(spark, d):
    return _ewma(_slim(spark, d), False)


@query("win3_ewma_long_gaps", _ewma_sql(_GAPPY, (0.5, 0.75), False))
def _(spark, d):
    return _ewma(_gappy(spark, d), False)


@query("win4_ewma_adjusted", _ewma_sql("sales", (0.5, 0.75), True))
def _(spark, d):
    return _ewma(_slim(spark, d), True)


@query("win4_ewma_adjusted_long_gaps", _ewma_sql(_GAPPY, (0.5, 0.75), True))
def _(spark, d):
    return _ewma(_gappy(spark, d), True)


@query(
    "win5_store_same_day",
    f"""SELECT {_KEYS}, {r6('avg(units) OVER (PARTITION BY store_nbr, date)', 'store_mean_sameday')},
        sum(units) OVER (PARTITION BY store_nbr, date) AS store_sum_sameday FROM sales""",
)
def _(spark, d):
    return rounded(Wn.same_day_context(_slim(spark, d), "store_nbr").drop("units"), ["store_mean_sameday"])


@query(
    "win6_item_same_day",
    f"""SELECT {_KEYS}, {r6('avg(units) OVER (PARTITION BY item_nbr, date)', 'item_mean_sameday')},
        sum(units) OVER (PARTITION BY item_nbr, date) AS item_sum_sameday FROM sales""",
)
def _(spark, d):
    return rounded(Wn.same_day_context(_slim(spark, d), "item_nbr").drop("units"), ["item_mean_sameday"])


def _row_context_sql(key, tie):
    w = f"OVER (PARTITION BY {key}_nbr ORDER BY date, {tie} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"
    return f"SELECT {_KEYS}, sum(units) {w} AS {key}_sum_7r, {r6(f'avg(units) {w}', f'{key}_mean_7r')} FROM sales"


@query("win7_store_row_context", _row_context_sql("store", "item_nbr"))
def _(spark, d):
    return rounded(Wn.row_context(_slim(spark, d), "store_nbr", "item_nbr").drop("units"), ["store_mean_7r"])


@query("win8_item_row_context", _row_context_sql("item", "store_nbr"))
def _(spark, d):
    return rounded(Wn.row_context(_slim(spark, d), "item_nbr", "store_nbr").drop("units"), ["item_mean_7r"])


def _calendar_context_sql(key):
    w = f"OVER (PARTITION BY {key}_nbr ORDER BY date RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)"
    return f"SELECT {_KEYS}, sum(units) {w} AS {key}_sum_7d, {r6(f'avg(units) {w}', f'{key}_mean_7d')} FROM sales"


@query("win9_store_calendar_context", _calendar_context_sql("store"))
def _(spark, d):
    return rounded(Wn.calendar_context(_slim(spark, d), "store_nbr").drop("units"), ["store_mean_7d"])


@query("win9_item_calendar_context", _calendar_context_sql("item"))
def _(spark, d):
    return rounded(Wn.calendar_context(_slim(spark, d), "item_nbr").drop("units"), ["item_mean_7d"])


@query(
    "win10_moving_average",
    f"""WITH t AS (SELECT province, date, sum(units) AS total FROM sales GROUP BY 1, 2)
        SELECT province, date, total, CASE WHEN count(total) OVER w = 7 THEN round(avg(total) OVER w, 6) END AS ma7 FROM t
        WINDOW w AS (PARTITION BY province ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
)
def _(spark, d):
    totals = A.total_by(panels.sales(spark, d), ["province", "date"])
    return rounded(Wn.moving_average(totals, "total", 7, keys=["province"]), ["ma7"])


@query(
    "win11_rolling_band",
    f"""SELECT station_nbr, date, tmax, {r6('avg(tmax) OVER w', 'tmax_mean')},
        {r6('avg(tmax) OVER w - stddev_samp(tmax) OVER w', 'tmax_low')}, {r6('avg(tmax) OVER w + stddev_samp(tmax) OVER w', 'tmax_high')}
        FROM weather_numeric WINDOW w AS (PARTITION BY station_nbr ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
)
def _(spark, d):
    weather = panels.weather_numeric(spark, d).select("station_nbr", "date", "tmax")
    return rounded(Wn.rolling_band(weather, ["tmax"], 30))


@query(
    "win12_rolling_fill",
    f"""WITH r AS (SELECT {_KEYS}, row_number() OVER ({_PAIR_W}) AS rn,
          CASE WHEN count(units) OVER w = 7 THEN avg(units) OVER w END AS s FROM sales_dirty
          WINDOW w AS ({_PAIR_W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
        n AS (SELECT *, CASE WHEN s IS NOT NULL THEN rn END AS kr FROM r),
        b AS (SELECT *, last_value(s IGNORE NULLS) OVER p AS s0, last_value(kr IGNORE NULLS) OVER p AS r0,
              first_value(s IGNORE NULLS) OVER f AS s1, first_value(kr IGNORE NULLS) OVER f AS r1 FROM n
              WINDOW p AS ({_PAIR_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                     f AS ({_PAIR_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
        SELECT {_KEYS}, {r6('CASE WHEN s IS NOT NULL THEN s WHEN s0 IS NULL THEN s1 WHEN s1 IS NULL THEN s0 ELSE s0 + (s1 - s0) / (r1 - r0) * (rn - r0) END', 'smooth')} FROM b""",
)
def _(spark, d):
    return rounded(Wn.rolling_fill(_dirty(spark, d)).select("date", *PAIR, "smooth"))


@query(
    "win13_lag_correlation",  # a constant side has no correlation: NULL
    " UNION ALL ".join(
        f"""SELECT store_nbr, item_nbr, {k} AS lag,
            {r6('CASE WHEN var_pop(l) > 0 AND var_pop(units) FILTER (l IS NOT NULL) > 0 THEN corr(units, l) END', 'rho')} FROM
            (SELECT *, lag(units, {k}) OVER ({_PAIR_W}) AS l FROM sales) t GROUP BY 1, 2"""
        for k in range(1, 13)
    ),
)
def _(spark, d):
    return rounded(Wn.lag_correlation(_slim(spark, d), "units", 12))


@query(
    "win14_acf",
    f"""WITH c AS (SELECT store_nbr, item_nbr, date, units - avg(units) OVER (PARTITION BY store_nbr, item_nbr) AS x FROM sales),
        p AS (SELECT store_nbr, item_nbr, sum(x * x) AS v, count(*) AS n FROM c GROUP BY 1, 2),
        l AS ("""
    + " UNION ALL ".join(
        f"SELECT store_nbr, item_nbr, {k} AS lag, sum(x * y) AS s FROM (SELECT *, lag(x, {k}) OVER ({_PAIR_W}) AS y FROM c) t GROUP BY 1, 2"
        for k in range(0, 41)
    )
    + f""") SELECT l.store_nbr, l.item_nbr, lag, {r6('coalesce(s, 0) / v', 'acf')}, round(1.959963984540054::DOUBLE / sqrt(n), 6) AS band
        FROM l JOIN p ON l.store_nbr = p.store_nbr AND l.item_nbr = p.item_nbr""",
)
def _(spark, d):
    return rounded(Wn.acf(_slim(spark, d), "units", 40))


def _pacf_sql(lags):
    """Partial autocorrelations `q_1 …` per series by the Durbin recursion, one common table expression per lag."""
    keys = "store_nbr, item_nbr, n"
    shifted = ", ".join(f"lag(x, {k}) OVER ({_PAIR_W}) AS l{k}" for k in range(1, lags + 1))
    ratios = ", ".join(f"coalesce(sum(x * l{k}), 0) / sum(x * x) AS r{k}" for k in range(1, lags + 1))
    r = ", ".join(f"r{k}" for k in range(1, lags + 1))
    steps = [
        "c AS (SELECT store_nbr, item_nbr, date, units - avg(units) OVER (PARTITION BY store_nbr, item_nbr) AS x FROM sales)",
        f"s AS (SELECT store_nbr, item_nbr, x, {shifted} FROM c)",
        f"d0 AS MATERIALIZED (SELECT store_nbr, item_nbr, count(*) AS n, {ratios}, CAST(1 AS DOUBLE) AS v FROM s GROUP BY 1, 2 HAVING count(*) // 2 > {lags})",
    ]
    for k in range(1, lags + 1):
        done = "".join(f", q_{j}" for j in range(1, k))
        old = "".join(f", p{j}" for j in range(1, k))
        gap = " ".join([f"r{k}"] + [f"- p{j} * r{k - j}" for j in range(1, k)])
        new = "".join(f", p{j} - q * p{k - j} AS p{j}" for j in range(1, k))
        steps.append(f"e{k} AS MATERIALIZED (SELECT {keys}, {r}, v{old}{done}, ({gap}) / v AS q FROM d{k - 1})")
        steps.append(f"d{k} AS MATERIALIZED (SELECT {keys}, {r}, v * (1 - q * q) AS v{new}, q AS p{k}{done}, q AS q_{k} FROM e{k})")
    tall = " UNION ALL ".join(f"SELECT {keys}, {k} AS lag, q_{k} AS pacf FROM d{lags}" for k in range(1, lags + 1))
    return ", ".join(steps) + f", pacf AS ({tall})"


@query("win15_pacf", f"WITH {_pacf_sql(30)} SELECT store_nbr, item_nbr, n, lag, {r6('pacf', 'pacf')} FROM pacf WHERE isfinite(pacf)")
def _(spark, d):
    return rounded(Wn.pacf(_slim(spark, d), "units", 30))


@query(
    "win16_significant_lags",
    f"""WITH {_pacf_sql(30)} SELECT lag, count(*) FILTER (abs(pacf) > 1.959963984540054::DOUBLE / sqrt(n)) AS series_hit, count(*) AS series_analyzed,
        {r6('avg(n)', 'mean_n')}, (SELECT count(*) FROM (SELECT DISTINCT store_nbr, item_nbr FROM sales) t) AS series_total,
        {r6('1.959963984540054::DOUBLE / sqrt(avg(n))', 'mean_band')} FROM pacf WHERE isfinite(pacf) GROUP BY 1
        HAVING series_hit > 0 AND series_hit >= 0.02 * series_total""",
)
def _(spark, d):
    # Random demand clears a band about one time in twenty, so the share that a lag must reach is a parameter here.
    return rounded(Wn.significant_lags(_slim(spark, d), "units", 30, share=0.02))


@query(
    "win17_test_span_marker",
    f"""SELECT {_KEYS}, units, CASE WHEN units IS NULL THEN max(units) OVER (PARTITION BY store_nbr, item_nbr) END AS istest
        FROM sales_dirty""",
)
def _(spark, d):
    return Wn.test_span_marker(_dirty(spark, d))

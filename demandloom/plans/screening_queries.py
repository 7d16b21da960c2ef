"""Feature screening queries."""

from pyspark.sql import functions as F

from demandloom import schema
from demandloom.functions import dates as D
from demandloom.functions import scalars as X
from demandloom.operators import screening as Sc
from demandloom.operators import unit_roots as U
from demandloom.operators import windows as Wn
from demandloom.plans.common import r6, rounded
from demandloom.plans.least_squares_sql import least_squares
from demandloom.plans.registry import query
from demandloom.sources import panels

_SCREEN = """WITH f AS (SELECT units, store_nbr, item_nbr, item_nbr * 2.0 + day(date) / 100.0 AS item_code,
    lag(units, 1) OVER w AS lag_1, avg(units) OVER (PARTITION BY store_nbr, item_nbr ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS mean_7,
    avg(units) OVER (PARTITION BY store_nbr, item_nbr ORDER BY date ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS mean_8
  FROM sales WINDOW w AS (PARTITION BY store_nbr, item_nbr ORDER BY date))"""
_SCREENED = ("store_nbr", "item_nbr", "item_code", "lag_1", "mean_7", "mean_8")


def _screen_panel(spark, d):
    panel = panels.sales(spark, d, province=False)
    w = Wn.series()
    return panel.select(
        "units",
        "store_nbr",
        "item_nbr",
        (F.col("item_nbr") * F.lit(2.0) + F.day("date") / 100).alias("item_code"),
        F.lag("units", 1).over(w).alias("lag_1"),
        F.avg("units").over(w.rowsBetween(-7, -1)).alias("mean_7"),
        F.avg("units").over(w.rowsBetween(-8, -1)).alias("mean_8"),
    )


@query(
    "fs1_collinear_columns",
    _SCREEN
    + ", c AS ("
    + " UNION ALL ".join(
        f"SELECT '{b}' AS feature, abs(corr({a}, {b})) AS r FROM f" for i, a in enumerate(_SCREENED) for b in _SCREENED[i + 1 :]
    )
    + ") SELECT DISTINCT feature FROM c WHERE r > 0.9",
)
def _(spark, d):
    """Names of the columns that the screen drops, the target protected."""
    dropped = Sc.collinear_columns(_screen_panel(spark, d), 0.9, ["units"])
    return spark.createDataFrame([(c,) for c in dropped], "feature string")


@query(
    "fs1_screened_panel",
    _SCREEN + f" SELECT units, store_nbr, item_nbr, lag_1, {r6('mean_7', 'mean_7')} FROM f",
)
def _(spark, d):
    kept, _ = Sc.drop_collinear(_screen_panel(spark, d), 0.9, ["units"])
    return rounded(kept, ["mean_7"])


_LEVELS = {"store_nbr": "store_nbr", "item_nbr": "item_nbr", "category": "category", "weekday": "isodow(date)", "month": "month(date)"}


@query(
    "fs2_anova",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS feature, round((b / (k - 1)) / (w / (n - k)), 5) AS f, k - 1 AS df_between, CAST(n - k AS BIGINT) AS df_within FROM (
          SELECT sum(n * (m - g) * (m - g)) AS b, sum(v) AS w, count(*) AS k, sum(n) AS n FROM (
            SELECT {e} AS level, count(*) AS n, avg(ln(1 + units)) AS m, sum((ln(1 + units)) ** 2) - count(*) * avg(ln(1 + units)) ** 2 AS v
            FROM sales GROUP BY 1) l, (SELECT avg(ln(1 + units)) AS g FROM sales) a) t"""
        for name, e in _LEVELS.items()
    ),
)
def _(spark, d):
    return rounded(_anova(spark, d).drop("p"), ["f"], 5)


def _anova(spark, d):
    panel = panels.sales(spark, d, province=False).withColumns({"weekday": D.weekday0("date"), "month": F.month("date")})
    return Sc.anova(panel, list(_LEVELS), X.log_units(F.col("units")))


@query("fs2_anova_p_values")
def _(spark, d):
    return _anova(spark, d)


_REGRESSORS = ("temperature", "humidity", "store_nbr", "item_nbr")
_CLIMATE = "sales s JOIN climate c ON s.date = c.date AND s.province = c.province"


def _weather_panel(spark, d):
    return panels.sales(spark, d).join(panels.climate(spark, d), ["date", "province"])


@query(
    "fs3_univariate_ranking",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, {r6(f'regr_r2(units, {c})', 'r2')}, count(*) AS n,
            {r6(f'1 - (1 - regr_r2(units, {c})) * (count(*) - 1) / (count(*) - 2)', 'r2_adj')} FROM {_CLIMATE}"""
        for c in _REGRESSORS
    ),
)
def _(spark, d):
    return rounded(Sc.univariate_ranking(_weather_panel(spark, d), "units", _REGRESSORS))


@query("fs4_subset_search")
def _(spark, d):
    """5 features in powers 1 to 3: 15 terms, 4,928 subsets of two to five."""
    terms = Sc.power_terms(list(_SCALED_TERMS))
    return Sc.subset_search(_term_panel(spark, d), X.log_units(F.col("units")), terms)


_SCALED_TERMS = {"temperature": "temperature / 10", "humidity": "humidity / 100", "store": "store_nbr / 10.0::DOUBLE", "item": "item_nbr / 10.0::DOUBLE",
                 "month": "month(s.date) / 10.0::DOUBLE"}
_POWERS = [(f"{c}^{k}" if k > 1 else c, f"pow({e}, {k})") for c, e in _SCALED_TERMS.items() for k in (1, 2, 3)]
_PAIRS = [(i, j) for i in range(len(_POWERS)) for j in range(i + 1, len(_POWERS))]


def _term_panel(spark, d):
    panel = _weather_panel(spark, d).withColumn("month", F.month("date"))
    return panel.withColumns({"temperature": F.col("temperature") / 10, "humidity": F.col("humidity") / 100, "store": F.col("store_nbr") / 10,
                              "item": F.col("item_nbr") / 10, "month": F.col("month") / 10})


@query(
    "fs4_pairs_of_terms",
    "WITH t AS (SELECT ln(1 + units) AS y, "
    + ", ".join(f"{e} AS t{i}" for i, (_, e) in enumerate(_POWERS))
    + " FROM sales s JOIN climate c ON s.date = c.date AND s.province = c.province), a AS (SELECT count(*) AS n, "
    + ", ".join(f"corr(y, t{i}) AS y{i}" for i in range(len(_POWERS)))
    + ", "
    + ", ".join(f"corr(t{i}, t{j}) AS c{i}_{j}" for i, j in _PAIRS)
    + " FROM t)\n"
    + " UNION ALL ".join(
        f"""SELECT '{_POWERS[i][0]} + {_POWERS[j][0]}' AS terms, 2 AS size,
        round(1 - (1 - (y{i} * y{i} + y{j} * y{j} - 2 * y{i} * y{j} * c{i}_{j}) / (1 - c{i}_{j} * c{i}_{j})) * (n - 1) / (n - 3), 6) + 0 AS r2_adj FROM a"""
        for i, j in _PAIRS
    ),
)
def _(spark, d):
    """The subsets of two terms, whose fits have a closed form in their correlations."""
    pairs = Sc.subset_search(_term_panel(spark, d), X.log_units(F.col("units")), Sc.power_terms(list(_SCALED_TERMS)), 2, 2)
    return rounded(pairs.select("terms", "size", "r2_adj"))


_TREE_FEATURES = ("temperature", "humidity", "store_nbr", "item_nbr", "weekday", "month")


def _tree_panel(spark, d):
    return _weather_panel(spark, d).withColumns({"weekday": D.weekday0("date"), "month": F.month("date")})


@query("fs5_forest_importances")
def _(spark, d):
    return Sc.importances(_tree_panel(spark, d), _TREE_FEATURES, "units", trees=250)


@query("fs5_single_tree_importances")
def _(spark, d):
    return Sc.importances(_tree_panel(spark, d), _TREE_FEATURES, "units", trees=1)


@query("fs6_feature_elimination")
def _(spark, d):
    panel = _tree_panel(spark, d).withColumn("busy", (F.col("units") > 30).cast("int"))
    return Sc.eliminate_features(panel, _TREE_FEATURES, "busy", 3)


@query(
    "fs7_chi2_scores",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, round(sum((o - e) ** 2 / e), 4) AS chi2 FROM (SELECT sum({c}) AS o,
          count(*) / CAST(max(t.n) AS DOUBLE) * max(t.s) AS e FROM sales s JOIN climate c ON s.date = c.date AND s.province = c.province,
          (SELECT count(*) AS n, sum({c}) AS s FROM {_CLIMATE}) t GROUP BY category) x"""
        for c in ("temperature", "humidity", "units")
    ),
)
def _(spark, d):
    return rounded(Sc.chi2_scores(_weather_panel(spark, d), ["temperature", "humidity", "units"], "category", 4), None, 4)


@query("fs8_principal_components")
def _(spark, d):
    return Sc.principal_components(_tree_panel(spark, d), _TREE_FEATURES, 3)


@query("fs9_stationarity")
def _(spark, d):
    return U.stationarity(panels.weather_numeric(spark, d), ["tmax", "tmin"])


@query(
    "fs10_column_kinds",
    """SELECT 'category' AS "column", 'categorical' AS kind, count(*) AS n FROM sales UNION ALL
       SELECT 'province', 'categorical', count(*) FROM sales UNION ALL SELECT 'units', 'numeric', count(*) FROM sales""",
)
def _(spark, d):
    panel = panels.sales(spark, d)
    categorical, numeric = schema.split_columns(panel, (), ["store_nbr", "item_nbr"])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind")) for k, cs in (("categorical", categorical), ("numeric", numeric)) for c in cs]
    return panel.agg(F.count("*").alias("n")).select(F.inline(F.array(*rows)), "n")


_T = "((date - DATE '1995-01-01') / 1000.0::DOUBLE)"


@query(
    "fs11_polynomial_trends",
    "WITH daily AS (SELECT province, date, sum(units) AS units FROM sales GROUP BY 1, 2),\n"
    + ",\n".join(least_squares("daily", ["province"], {f"x{k}": f"{_T} ** {k}" for k in range(1, g + 1)}, "units", f"fit{g}") for g in (1, 2, 3))
    + "\n"
    + " UNION ALL ".join(f"SELECT province, {g} AS degree, round(sqrt(ssr / n), 5) AS rmse, round(b1, 3) + 0 AS slope FROM fit{g}" for g in (1, 2, 3)),
)
def _(spark, d):
    daily = panels.sales(spark, d).groupBy("province", "date").agg(F.sum("units").alias("units"))
    t = F.datediff("date", F.lit("1995-01-01").cast("date")) / F.lit(1000.0)
    fits = Sc.polynomial_fits(daily, t, F.col("units"), (1, 2, 3), ["province"])
    out = fits.select("province", "degree", "rmse", F.col("coef")[1].alias("slope"))
    return rounded(rounded(out, ["rmse"], 5), ["slope"], 3)

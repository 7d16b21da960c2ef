"""Contribution tables and their roll-ups."""

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from demandloom.operators import attribution as At
from demandloom.operators import gram as G
from demandloom.operators import screening as Sc
from demandloom.plans.common import r6, rounded
from demandloom.plans.registry import query
from demandloom.session import materialize
from demandloom.sources import panels

_FEATURES = panels.LINEAR_FEATURES
_MODEL = " + ".join(
    ["(SELECT b0 FROM attribution_model)"] + [f"(SELECT b{i} FROM attribution_model) * {c}" for i, c in enumerate(_FEATURES, 1)]
)


def _rows(spark, d):
    return panels.attribution_features(spark, d)


def _model(spark, d):
    """The rows, written once, and a least-squares model of those before the test period: intercept and slopes."""
    rows = materialize(_rows(spark, d), "attribution")
    train = rows.where(F.col("date") < F.lit(panels.TEST_START).cast("date"))
    coef = G.fit(train, {c: F.col(c) for c in _FEATURES}, F.col("y")).select("fit.coef").first()[0]
    return rows, round(coef[0], 4), {c: round(b, 4) for c, b in zip(_FEATURES, coef[1:])}


def _phi(spark, d):
    rows, _, slopes = _model(spark, d)
    return At.linear_contributions(rows, slopes, ("row_id", "date", "y"))


@query("xa0_linear_contributions", f"SELECT row_id, feature, {r6('value', 'value')}, {r6('phi', 'phi')} FROM attribution")
def _(spark, d):
    return rounded(_phi(spark, d).select("row_id", "feature", "value", "phi"))


@query(
    "xa0_additivity",
    f"""SELECT row_id, {r6(f"{_MODEL} - avg({_MODEL}) OVER ()", 'above_mean')} FROM attribution_features""",
)
def _(spark, d):
    """Contributions of a row sum to its prediction minus the mean prediction."""
    return rounded(_phi(spark, d).groupBy("row_id").agg(F.sum("phi").alias("above_mean")))


def _forest(spark, d):
    """The rows, written once, as the passes of the fit, the samples and the explained rows all read them, and the forest."""
    rows = materialize(_rows(spark, d), "attribution")
    stages = [
        VectorAssembler(inputCols=list(_FEATURES), outputCol="features"),
        RandomForestRegressor(labelCol="y", predictionCol="yhat", numTrees=100, maxDepth=5, seed=7),
    ]
    return rows, Pipeline(stages=stages).fit(rows)


@query("xa0_sampled_contributions")
def _(spark, d):
    """Permutation-sampled contributions of a forest for the whole test period."""
    rows, model = _forest(spark, d)
    test = F.col("date") >= F.lit(panels.TEST_START).cast("date")
    return At.sampled_contributions(model, rows.where(test), At.sample_rows(rows.where(~test), 100, seed=7), _FEATURES)


_SAMPLE_SQL = """SELECT row_id, y FROM (SELECT row_id, y, row_number() OVER (PARTITION BY date >= DATE '2001-01-01'
  ORDER BY md5(concat_ws('|', 42, row_id)), row_id) AS rn FROM attribution_features) t WHERE rn <= 500"""


@query("xa1_sampled_rows", _SAMPLE_SQL)
def _(spark, d):
    rows = _rows(spark, d).select("row_id", "date", "y")
    test = F.col("date") >= F.lit(panels.TEST_START).cast("date")
    return At.sample_splits(rows.where(~test), rows.where(test)).select("row_id", "y")


@query("xa2_global_importance", f"SELECT feature, {r6('avg(abs(phi))', 'importance')} FROM attribution GROUP BY 1")
def _(spark, d):
    return rounded(At.global_importance(_phi(spark, d)))


_TYPE = """CASE WHEN feature IN ('day_of_week', 'month') THEN 'date_time' WHEN feature = 'temperature' THEN 'weather'
  WHEN feature LIKE 'sales%' THEN 'sales_history' WHEN feature LIKE 'store%' THEN 'store' WHEN feature LIKE 'item%' THEN 'item' ELSE 'other' END"""


@query(
    "xa3_importance_by_type",
    f"""WITH g AS (SELECT feature, avg(abs(phi)) AS i FROM attribution GROUP BY 1)
        SELECT {_TYPE} AS type, {r6('sum(i)', 'importance')}, count(*) AS features,
               {r6('sum(i) / (SELECT sum(i) FROM g) * 100', 'share_pct')} FROM g GROUP BY 1""",
)
def _(spark, d):
    return rounded(At.importance_by_type(_phi(spark, d)))


@query("mth13_feature_types", f"SELECT DISTINCT feature, {_TYPE} AS type FROM attribution")
def _(spark, d):
    from demandloom.functions import scalars as X

    return _phi(spark, d).select("feature", X.feature_type(F.col("feature")).alias("type")).distinct()


@query(
    "xa4_strength_by_month",
    f"""WITH r AS (SELECT row_id, CAST(month(date) AS INT) AS month, avg(abs(phi)) AS s FROM attribution GROUP BY 1, 2)
        SELECT month, {r6('avg(s)', 'mean_abs_phi')} FROM r GROUP BY 1""",
)
def _(spark, d):
    return rounded(At.strength_by_period(_phi(spark, d), F.month("date"), "month"))


@query(
    "xa4_strength_by_weekday",
    f"""WITH r AS (SELECT row_id, CAST(isodow(date) - 1 AS INT) AS weekday, dayname(date) AS day_name, avg(abs(phi)) AS s
          FROM attribution GROUP BY 1, 2, 3)
        SELECT weekday, day_name, {r6('avg(s)', 'mean_abs_phi')} FROM r GROUP BY 1, 2""",
)
def _(spark, d):
    return rounded(At.strength_by_weekday(_phi(spark, d)))


@query(
    "xa5_weather_effect",
    f"SELECT feature, {r6('avg(phi)', 'mean_phi')} FROM attribution WHERE feature = 'temperature' AND date >= DATE '2001-01-01' GROUP BY 1",
)
def _(spark, d):
    return rounded(At.weather_effect(_phi(spark, d).where(F.col("date") >= F.lit(panels.TEST_START).cast("date"))))


_FACTORS = f"""p AS (SELECT row_id, y, feature, value, phi FROM attribution),
  f AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY phi DESC, feature) AS hi,
               row_number() OVER (PARTITION BY row_id ORDER BY phi, feature) AS lo FROM p),
  u AS (SELECT row_id, y, feature, value, phi, 'up' AS direction, CAST(hi AS INT) AS place FROM f WHERE hi <= 5
        UNION ALL SELECT row_id, y, feature, value, phi, 'down', CAST(lo AS INT) FROM f WHERE lo <= 5)"""


@query("top6_strongest_factors", f"WITH {_FACTORS} SELECT row_id, feature, {r6('phi', 'phi')}, direction, place FROM u")
def _(spark, d):
    return rounded(At.strongest_factors(_phi(spark, d)).select("row_id", "feature", "phi", "direction", "place"))


@query(
    "xa6_local_explanations",
    f"""WITH {_FACTORS}, r AS (SELECT row_id, y AS actual, {_MODEL} AS predicted FROM attribution_features)
        SELECT r.row_id, actual, {r6('predicted', 'predicted')}, feature, {r6('value', 'value')}, {r6('phi', 'phi')}, direction, place
        FROM r JOIN u ON r.row_id = u.row_id""",
)
def _(spark, d):
    rows, intercept, slopes = _model(spark, d)
    predicted = sum((F.lit(b) * F.col(c) for c, b in slopes.items()), F.lit(intercept))
    results = rows.select("row_id", F.col("y").alias("actual"), predicted.alias("predicted"))
    return rounded(At.local_explanations(At.linear_contributions(rows, slopes), results), ["predicted", "value", "phi"])


@query("xa7_dependence", f"SELECT row_id, {r6('value', 'value')}, {r6('phi', 'phi')} FROM attribution WHERE feature = 'sales_mean_7d'")
def _(spark, d):
    return rounded(At.dependence(_phi(spark, d), "sales_mean_7d"))


@query(
    "xa7_binned_dependence",
    f"""SELECT floor(value / 10) * 10 AS low, {r6('avg(phi)', 'mean_phi')}, count(*) AS n FROM attribution
        WHERE feature = 'sales_mean_7d' GROUP BY 1""",
)
def _(spark, d):
    return rounded(At.binned_dependence(_phi(spark, d), "sales_mean_7d", 10.0))


@query(
    "top5_largest_importances",
    f"""SELECT feature, {r6('importance', 'importance')} FROM (SELECT feature, avg(abs(phi)) AS importance FROM attribution GROUP BY 1) t
        ORDER BY importance DESC, feature LIMIT 5""",
)
def _(spark, d):
    return rounded(At.global_importance(_phi(spark, d)).limit(5))


@query("xa8_model_importances")
def _(spark, d):
    """A forest's own importances, the eight largest, names made readable."""
    _, model = _forest(spark, d)
    return At.readable_importances(Sc.importance_table(spark, model.stages[-1], _FEATURES))

"""Fitting, scoring and what-if queries."""

import datetime as dt

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from demandloom import PAIR
from demandloom.functions import scalars as X
from demandloom.operators import aggregates as A
from demandloom.operators import changes as Ch
from demandloom.operators import evaluation as E
from demandloom.operators import forecast as Fc
from demandloom.operators import sets as S
from demandloom.plans.common import r6, rounded
from demandloom.plans.least_squares_sql import dot_sql, least_squares, seasonal_sql
from demandloom.plans.registry import query
from demandloom.session import materialize, scratch_path
from demandloom.sources import panels

_TERMS = seasonal_sql()
_TRAIN = "(SELECT * FROM sales WHERE date < DATE '2001-01-01')"


def _split(spark, d):
    panel = panels.sales(spark, d, province=False)
    cut = F.lit(panels.TEST_START).cast("date")
    return panel.where(F.col("date") < cut), panel.where(F.col("date") >= cut)


@query(
    "fc1_seasonal_by_pair",
    f"""WITH {least_squares(_TRAIN, ['store_nbr', 'item_nbr'], _TERMS, 'units', least=60)}
        SELECT s.date, s.store_nbr, s.item_nbr, units, round({dot_sql(_TERMS, 'o.')}, 4) + 0 AS yhat
        FROM sales s JOIN ols o ON s.store_nbr = o.store_nbr AND s.item_nbr = o.item_nbr WHERE s.date >= DATE '2001-01-01'""",
)
def _(spark, d):
    """Trend, weekday and yearly effects per series, fitted before the cut-off and applied after it."""
    train, test = _split(spark, d)
    predicted = Fc.predict_seasonal(test, Fc.fit_seasonal(train, least=60))
    return rounded(predicted.select("date", *PAIR, "units", "yhat"), ["yhat"], 4)


_WEATHER_TERMS = seasonal_sql("s.date") | {"temperature": "temperature"}
_WEATHER_SOURCE = """(SELECT s.date AS date, province, category, units, temperature FROM (SELECT date, province, category, sum(units) AS units
  FROM sales GROUP BY 1, 2, 3) s JOIN climate c USING (date, province)) s"""


@query(
    "fc1_multiplicative_with_weather",
    f"""WITH {least_squares(_WEATHER_SOURCE, ['province', 'category'], _WEATHER_TERMS, 'ln(1 + units)', least=60)}
        SELECT province, category, CAST(n AS BIGINT) AS n, round(1 - ssr / sst, 6) AS r2, round(b14 * 1000, 4) + 0 AS per_degree FROM ols""",
)
def _(spark, d):
    """Effects that multiply, with temperature as a regressor, by province and category."""
    keys = ["province", "category"]
    totals = A.total_by(panels.sales(spark, d), [*keys, "date"], name="units")
    joined = totals.join(panels.climate(spark, d).select("date", "province", "temperature"), ["date", "province"])
    terms = Fc.seasonal_terms(regressors=["temperature"])
    models = Fc.fit_seasonal(joined, keys, terms=terms, multiplicative=True, least=60)
    place = list(terms).index("temperature") + 1
    out = models.select(*keys, "n", F.col("fit.r2").alias("r2"), (F.col("fit.coef")[place] * 1000).alias("per_degree"))
    return rounded(rounded(out, ["r2"]), ["per_degree"], 4)


_HINGES = (dt.date(1997, 1, 1), dt.date(1999, 7, 1))
_HINGE_TERMS = seasonal_sql() | {f"change_{i}": f"greatest((date - DATE '{d}') / 365.25::DOUBLE, 0)" for i, d in enumerate(_HINGES)}
_DAILY_TOTALS = "(SELECT province, category, date, sum(units) AS units FROM sales GROUP BY 1, 2, 3)"


def _daily_totals(spark, d):
    return A.total_by(panels.sales(spark, d), ["province", "category", "date"], name="units")


@query(
    "fc1_fixed_trend_changes",
    f"""WITH {least_squares(_DAILY_TOTALS, ['province', 'category'], _HINGE_TERMS, 'units', least=60)}
        SELECT province, category, n, round(b1, 4) + 0 AS slope, round(b14, 4) + 0 AS change_1997, round(b15, 4) + 0 AS change_1999 FROM ols""",
)
def _(spark, d):
    """The slope of each province's and category's demand and its changes at two given dates."""
    terms = Fc.seasonal_terms() | Ch.hinge_terms(_HINGES)
    models = Fc.fit_seasonal(_daily_totals(spark, d), ["province", "category"], terms=terms, least=60)
    coef = lambda i, name: F.col("fit.coef")[i].alias(name)
    return rounded(models.select("province", "category", "n", coef(1, "slope"), coef(14, "change_1997"), coef(15, "change_1999")), None, 4)


@query("fc1_trend_changes")
def _(spark, d):
    """Where the trend of each province and category changes: up to five of ten candidate dates, by forward selection."""
    totals = materialize(_daily_totals(spark, d), "totals")
    span = totals.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
    dates = Ch.candidate_dates(span["a"], span["b"]) if span["a"] else [dt.date(1995, 1, 1)]
    models, terms = Ch.fit_with_changes(totals, dates, F.col("units"), ["province", "category"])
    at = len(terms) - len(dates) + 1
    change = F.transform("fit.changes", lambda i: F.struct(F.get(F.array(*map(F.lit, dates)), i).alias("date"), F.get("fit.coef", i + at).alias("slope")))
    return models.select("province", "category", "n", F.col("fit.sigma").alias("sigma"), F.size("fit.changes").alias("n_changes"), change.alias("changes"))


@query(
    "fc2_intervals",
    f"""WITH {least_squares(_TRAIN, ['store_nbr', 'item_nbr'], _TERMS, 'units', least=60)},
        p AS (SELECT s.date, s.store_nbr, s.item_nbr, units, {dot_sql(_TERMS, 'o.')} AS yhat, sqrt(ssr / (n - {len(_TERMS) + 1})) AS sigma
          FROM sales s JOIN ols o ON s.store_nbr = o.store_nbr AND s.item_nbr = o.item_nbr WHERE s.date >= DATE '2001-01-01')
        SELECT store_nbr, count(*) AS n, count(*) FILTER (units BETWEEN yhat - 1.2815515655446004::DOUBLE * sigma
               AND yhat + 1.2815515655446004::DOUBLE * sigma) AS covered, round(avg(2 * 1.2815515655446004::DOUBLE * sigma), 4) AS width
        FROM p GROUP BY 1""",
)
def _(spark, d):
    """Width and coverage of the 80 % interval by store."""
    train, test = _split(spark, d)
    p = Fc.predict_seasonal(test, Fc.fit_seasonal(train, least=60))
    inside = F.col("units").between(F.col("yhat_lower"), F.col("yhat_upper"))
    out = p.groupBy("store_nbr").agg(
        F.count("*").alias("n"), F.count_if(inside).alias("covered"), F.avg(F.col("yhat_upper") - F.col("yhat_lower")).alias("width")
    )
    return rounded(out, ["width"], 4)


@query(
    "fc3_future_frame",
    """SELECT store_nbr, item_nbr, date FROM sales UNION ALL
       SELECT store_nbr, item_nbr, CAST(m + CAST(k AS INT) AS DATE) FROM (SELECT store_nbr, item_nbr, max(date) AS m FROM sales GROUP BY 1, 2) t,
         (SELECT unnest(range(1, 61)) AS k) o""",
)
def _(spark, d):
    return Fc.future_frame(panels.sales(spark, d, province=False), 60)


_LOG_MODELS = """(SELECT store_nbr, item_nbr, avg(ln(1 + units)) AS yhat FROM sales WHERE date < DATE '2001-01-01' GROUP BY 1, 2 HAVING count(*) >= 20)"""


@query(
    "fc7_mean_log_by_series",
    f"""SELECT concat_ws('_', s.store_nbr, s.item_nbr, strftime(s.date, '%Y-%m-%d')) AS id,
        {r6('greatest(exp(coalesce(yhat, 0)) - 1, 0)', 'units')} FROM sales s LEFT JOIN {_LOG_MODELS} m
        ON s.store_nbr = m.store_nbr AND s.item_nbr = m.item_nbr WHERE s.date >= DATE '2001-01-01'""",
)
def _(spark, d):
    """A model of each series' mean log demand before the test period; series with fewer than 20 rows get none."""
    panel = panels.sales(spark, d, province=False)
    early = panel.where(F.col("date") < F.lit(panels.TEST_START).cast("date"))
    models = early.groupBy(*PAIR).agg(F.avg(X.log_units(F.col("units"))).alias("yhat"), F.count("*").alias("_n"))
    requests = panel.where(F.col("date") >= F.lit(panels.TEST_START).cast("date")).select("date", *PAIR)
    return rounded(Fc.scored_requests(requests, models.where("_n >= 20").drop("_n")))


_SCALED = """(SELECT s.store_nbr, units, (temperature - avg(temperature) OVER w) / stddev_pop(temperature) OVER w AS temperature,
    (humidity - avg(humidity) OVER w) / stddev_pop(humidity) OVER w AS humidity, isodow(s.date) - 1 AS weekday
  FROM sales s JOIN climate c ON s.date = c.date AND s.province = c.province WINDOW w AS (PARTITION BY s.store_nbr))"""
_STORE_TERMS = {"temperature": "temperature", "humidity": "humidity"} | {f"weekday_{k}": f"CAST(weekday = {k} AS DOUBLE)" for k in range(1, 7)}


def _store_models(spark, d):
    from demandloom.functions import dates as D

    joined = panels.sales(spark, d).join(panels.climate(spark, d), ["date", "province"]).withColumn("weekday", D.weekday0("date"))
    return Fc.store_models(joined, ["temperature", "humidity"], {"weekday": list(range(7))}, X.log_units(F.col("units")))


@query(
    "fc8_store_models",
    f"""WITH {least_squares(_SCALED, ['store_nbr'], _STORE_TERMS, 'ln(1 + units)')}
        SELECT store_nbr, n, round(1 - ssr / sst, 6) AS r2, round(b1, 5) + 0 AS temperature, round(b2, 5) + 0 AS humidity FROM ols""",
)
def _(spark, d):
    models, _ = _store_models(spark, d)
    out = models.select(
        "store_nbr", "n", F.col("fit.r2").alias("r2"), F.col("fit.coef")[1].alias("temperature"), F.col("fit.coef")[2].alias("humidity")
    )
    return rounded(rounded(out, ["r2"]), ["temperature", "humidity"], 5)


@query("fc8_store_condition_numbers")
def _(spark, d):
    models, _ = _store_models(spark, d)
    return models.select("store_nbr", F.col("fit.r2").alias("r2"), F.col("fit.condition").alias("condition_number"))


@query("fc9_refit_significant")
def _(spark, d):
    models, terms = _store_models(spark, d)
    return Fc.refit_significant(models, terms, 0.1)


@query(
    "fc10_scaled_terms",
    f"""SELECT date, province, {r6('(temperature - avg(temperature) OVER ()) / stddev_pop(temperature) OVER ()', 'temperature')},
        {r6('(humidity - avg(humidity) OVER ()) / stddev_pop(humidity) OVER ()', 'humidity')} FROM climate""",
)
def _(spark, d):
    return rounded(Fc.scale_columns(panels.climate(spark, d).drop("season"), ["temperature", "humidity"]))


@query(
    "imp9_seasonal_fill",
    f"""WITH tall AS (SELECT station_nbr, date, 'tmax' AS c, tmax AS y FROM weather_numeric WHERE station_nbr <> 5
          UNION ALL SELECT station_nbr, date, 'tmin', tmin FROM weather_numeric WHERE station_nbr <> 5),
        {least_squares('tall', ['station_nbr', 'c'], _TERMS, 'y', least=60)},
        f AS (SELECT t.station_nbr, t.date, t.c, coalesce(y, {dot_sql(seasonal_sql('t.date'), 'o.')}) AS y
              FROM tall t LEFT JOIN ols o ON t.station_nbr = o.station_nbr AND t.c = o.c
              UNION ALL SELECT station_nbr, date, 'tmax', tmax FROM weather_numeric WHERE station_nbr = 5
              UNION ALL SELECT station_nbr, date, 'tmin', tmin FROM weather_numeric WHERE station_nbr = 5)
        SELECT station_nbr, date, round(max(y) FILTER (c = 'tmax'), 4) + 0 AS tmax, round(max(y) FILTER (c = 'tmin'), 4) + 0 AS tmin
        FROM f GROUP BY 1, 2""",
)
def _(spark, d):
    """Missing readings from the station's own trend and seasons; station 5 is skipped."""
    weather = panels.weather_numeric(spark, d).drop("preciptotal")
    return rounded(Fc.trend_fill(weather, ["tmax", "tmin"], skip=[5]), None, 4)


def _features(spark, d):
    """The model table, written once: splits and boosting passes read pruned parts of it."""
    panel = Fc.engineered(panels.sales(spark, d), panels.climate(spark, d))
    return materialize(S.hold_out_flags(panel, panels.VALID_START, panels.TEST_START), "features")


@query("fc4_boosted_test_scores")
def _(spark, d):
    """Boosted trees over all series, scored on the hold-out by category."""
    train, valid, test = S.three_way_split(_features(spark, d))
    model = Fc.boosted().fit(train.unionByName(valid))
    return E.score(model.transform(test), ["category"], y="units")


@query("fc4_cross_validation")
def _(spark, d):
    """Mean scores of an expanding five-fold split by day."""
    train, valid, _ = S.three_way_split(_features(spark, d))
    folded = materialize(S.date_folds(train.unionByName(valid)), "folds")
    out = Fc.cross_validate(folded, Fc.boosted)
    return E.fold_summary(out, y="units")


@query("fc5_boosted_with_skips")
def _(spark, d):
    """Early stop on the validation part; series with fewer than 20 training rows are not modelled and get 0."""
    flagged = _features(spark, d)
    train, _, test = S.three_way_split(flagged)
    modelled = Fc.long_enough(train)
    fitting = flagged.where(~F.col("is_test")).join(modelled, list(PAIR), "left_semi")
    model = Fc.boosted(validation="is_valid").fit(fitting)
    return E.two_level_summary(Fc.score_with_skips(model, test, modelled), y="units")


@query("fc6_grid_search")
def _(spark, d):
    """Trials ranked by WAPE on the validation part."""
    train, valid, _ = S.three_way_split(_features(spark, d))
    grid = [{"depth": depth, "rate": rate} for depth in (2, 3, 4, 5) for rate in (0.05, 0.1, 0.15, 0.2, 0.3)]
    return Fc.trials_table(spark, Fc.search(train, valid, grid))


SCENARIOS = (
    {"date": "2001-12-08", "temperature": 31.0, "humidity": 55.0, "event_pct": 20.0, "weather_condition": "Clear"},
    {"date": "2001-12-12", "temperature": 18.0, "humidity": 80.0, "weather_condition": "Rainy", "competition_level": "High"},
    {"date": "2001-12-25", "temperature": 24.0, "humidity": 65.0, "is_holiday": 1, "supply_chain": "Constrained"},
)

_SCENARIO_SQL = """(SELECT * FROM (VALUES (0, DATE '2001-12-08', 0, 31.0::DOUBLE, 'Hot', 'Low', 1.2 * 1.15),
  (1, DATE '2001-12-12', 0, 18.0::DOUBLE, 'Cold', 'High', 0.9 * 0.9), (2, DATE '2001-12-25', 1, 24.0::DOUBLE, 'Cool', 'Medium', 0.9))
  AS t(scenario_id, date, is_holiday, temperature, temp_category, humidity_level, factor))"""


@query(
    "mth11_scenario_rows",
    f"""SELECT p.store_nbr, p.item_nbr, p.units, c.scenario_id, c.date, c.is_holiday, c.temperature, c.temp_category, c.humidity_level,
          round(CAST(c.factor AS DOUBLE), 6) AS factor, CAST(isodow(c.date) - 1 AS INT) AS day_of_week, CAST(month(c.date) AS INT) AS month
        FROM (SELECT *, row_number() OVER (PARTITION BY store_nbr, item_nbr ORDER BY date DESC) AS rn FROM sales) p, {_SCENARIO_SQL} c
        WHERE rn = 1""",
)
def _(spark, d):
    latest = A.latest_rows(panels.sales(spark, d, province=False).drop("category"), 1)
    rows = Fc.scenario_rows(latest, SCENARIOS)
    return rounded(
        rows.select(
            *PAIR, "units", "scenario_id", "date", "is_holiday", "temperature", "temp_category", "humidity_level", "factor", "day_of_week", "month"
        )
    )


@query("fc12_what_if")
def _(spark, d):
    """The newest row of every series under three scenarios, scored and adjusted."""
    features = _features(spark, d)
    train, _, _ = S.three_way_split(features)
    model = Fc.boosted().fit(train)
    return Fc.what_if(model, A.latest_rows(features, 1), SCENARIOS)


def _linear_model(spark, d):
    """A linear model of the features, saved and reloaded: in memory, from disk, and the hold-out."""
    train, _, test = S.three_way_split(_features(spark, d))
    stages = [VectorAssembler(inputCols=list(Fc.FEATURES), outputCol="features"), LinearRegression(labelCol="units", predictionCol="yhat", regParam=0.01)]
    path, model = scratch_path(spark, "models"), Pipeline(stages=stages).fit(train)
    Fc.save_model(model, path)
    return model, Fc.load_model(path), test


@query("fc13_reloaded_model")
def _(spark, d):
    """A saved and reloaded linear model scores the hold-out."""
    _, reloaded, test = _linear_model(spark, d)
    return E.score(reloaded.transform(test), ["store_nbr"], y="units")


@query(
    "fc13_reload_differences",
    """SELECT store_nbr, count(*) AS n, 0::BIGINT AS differ FROM (SELECT store_nbr, date, lag(units) OVER (PARTITION BY store_nbr, item_nbr ORDER BY date) AS l
       FROM sales) t WHERE l IS NOT NULL AND date >= DATE '2001-01-01' GROUP BY 1""",
)
def _(spark, d):
    """Hold-out rows by store, and those whose forecast by the reloaded model differs from the one in memory: none."""
    model, reloaded, test = _linear_model(spark, d)
    both = reloaded.transform(model.transform(test).withColumnRenamed("yhat", "kept").drop("features"))
    return both.groupBy("store_nbr").agg(F.count("*").alias("n"), F.count_if(~F.col("yhat").eqNullSafe(F.col("kept"))).alias("differ"))

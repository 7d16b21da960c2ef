"""Panel forecasts: seasonal least squares per series, boosted trees over the panel, scoring, scenarios."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from statistics import NormalDist

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom import PAIR
from demandloom.functions import dates as D
from demandloom.functions import metrics as M
from demandloom.functions import scalars as X
from demandloom.operators import gram as G
from demandloom.operators import windows as Wn
from demandloom.session import materialize
from demandloom.sources.files import submission_rows

ORIGIN = "1995-01-01"


def seasonal_terms(
    date: str = "date", *, yearly: int = 3, weekly: bool = True, regressors: Sequence[str] = (), origin: str = ORIGIN
) -> dict[str, Column]:
    """Linear trend in years since `origin`, weekday effects against Monday, yearly sine and cosine pairs, further columns."""
    years = F.datediff(F.col(date), F.lit(origin).cast("date")) / F.lit(365.25)
    terms: dict[str, Column] = {"trend": years}
    if weekly:
        terms |= {f"weekday_{k}": (D.weekday0(date) == k).cast("double") for k in range(1, 7)}
    for k in range(1, yearly + 1):
        terms |= {f"sin_{k}": F.sin(years * (2 * math.pi * k)), f"cos_{k}": F.cos(years * (2 * math.pi * k))}
    return terms | {r: F.col(r).cast("double") for r in regressors}


def fit_seasonal(
    train: DataFrame, keys: Sequence[str] = PAIR, value: str = "units", *, terms: Mapping[str, Column] | None = None,
    multiplicative: bool = False, least: int = 1,
) -> DataFrame:
    """One seasonal model per series. `multiplicative` fits the logarithm, where effects multiply."""
    target = X.log_units(F.col(value)) if multiplicative else F.col(value)
    return G.fit(train, terms or seasonal_terms(), target, keys, least)


def predict_seasonal(
    df: DataFrame, models: DataFrame, keys: Sequence[str] = PAIR, *, terms: Mapping[str, Column] | None = None,
    multiplicative: bool = False, width: float = 0.8, how: str = "inner",
) -> DataFrame:
    """`yhat` with its interval from the residual deviation; `inner` leaves series without a model out."""
    z = NormalDist().inv_cdf((1 + width) / 2)
    centre = G.dot(F.col("fit.coef"), terms or seasonal_terms())
    back = F.expm1 if multiplicative else (lambda c: c)
    joined = df.join(models.drop("n"), list(keys), how).withColumn("_m", centre)
    return joined.withColumns(
        {
            "yhat": back(F.col("_m")),
            "yhat_lower": back(F.col("_m") - F.col("fit.sigma") * z),
            "yhat_upper": back(F.col("_m") + F.col("fit.sigma") * z),
        }
    ).drop("_m", "fit")


def trend_fill(
    df: DataFrame, columns: Sequence[str], key: str = "station_nbr", *, date: str = "date", skip: Sequence[int] = (), least: int = 30
) -> DataFrame:
    """Missing readings take a seasonal fit of their own station and column; skipped stations and thin columns stay open.

    All stations and columns are fitted in one pass over a long table.
    """
    known = df.where(~F.col(key).isin(list(skip)))
    tall = known.select(key, date, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([key, date], list(columns), "column", "y")
    terms = seasonal_terms(date)
    models = G.fit(tall, terms, F.col("y"), [key, "column"], least)
    wide = models.groupBy(key).pivot("column", list(columns)).agg(F.first("fit.coef"))  # one row per station and column
    coefs = wide.withColumnsRenamed({c: f"_coef_{c}" for c in columns})
    joined = df.join(coefs, key, "left")
    filled = {c: F.coalesce(F.col(c), G.dot(F.col(f"_coef_{c}"), terms)) for c in columns}
    return joined.withColumns(filled).select(*df.columns)


def future_frame(df: DataFrame, days: int, keys: Sequence[str] = PAIR, date: str = "date", *, history: bool = True) -> DataFrame:
    """Every series extended by `days` days after its last one, after its own days when `history` is kept."""
    last = df.groupBy(*keys).agg(F.max(date).alias("_last"))
    if days < 1:
        ahead = df.select(*keys, date).limit(0)
    else:
        ahead = last.select(*keys, F.explode(F.sequence(F.date_add("_last", 1), F.date_add("_last", days))).alias(date))
    return df.select(*keys, date).unionByName(ahead) if history else ahead


def with_fallback(df: DataFrame, models: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Forecasts joined by series; a series without a model gets 0."""
    return df.join(models, list(keys), "left").withColumn("yhat", F.coalesce("yhat", F.lit(0.0)))


def scored_requests(requests: DataFrame, models: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Submission rows from models on the log scale: fallback 0, inverse transform, floor at 0."""
    scored = with_fallback(requests, models, keys).withColumn("units", X.unlog_floor(F.col("yhat")))
    return submission_rows(scored)


def scale_columns(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """z-scores (population deviation), overall or per group; statistics are aggregated and joined back."""
    stats = [F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(f"_z_{c}") for c in columns]
    if by:
        joined = df.join(df.groupBy(*by).agg(*stats), list(by), "left")
    else:
        both = df.select(F.struct(*stats)).scalar()
        joined = df.withColumn("_z", both).select("*", "_z.*").drop("_z")
    z = {c: F.try_divide(F.col(c) - F.col(f"_z_{c}.m"), F.col(f"_z_{c}.s")) for c in columns}
    return joined.withColumns(z).drop(*[f"_z_{c}" for c in columns])


def store_models(
    df: DataFrame, numeric: Sequence[str], categorical: Mapping[str, Sequence], target: Column, key: str = "store_nbr"
) -> tuple[DataFrame, list[str]]:
    """Per-store least squares on scaled numbers and level indicators; also the names of the terms."""
    scaled = scale_columns(df, numeric, [key])
    terms = {c: F.col(c) for c in numeric}
    for column, levels in categorical.items():
        terms |= {f"{column}_{v}": (F.col(column) == v).cast("double") for v in levels[1:]}
    sums = G.gram(scaled, terms, target, [key])
    return sums.withColumn("fit", G.solve("n", "xx", "xy", "yy")), list(terms)


def refit_significant(models: DataFrame, terms: Sequence[str], level: float = 0.1, key: str = "store_nbr") -> DataFrame:
    """Second fit with the terms whose p-value was below `level`: a sub-matrix of the same sums, no second scan."""
    mask = G.significant_mask("fit.pvalue", len(terms), level)
    again = models.withColumn("mask", mask).withColumn("again", G.solve_subset("n", "xx", "xy", "yy", "mask"))
    return again.select(
        key, "n", _chosen(terms).alias("terms"), F.col("again.r2").alias("r2"), F.col("again.condition").alias("condition"), F.col("again.kept").alias("kept")
    )


def _chosen(terms: Sequence[str]) -> Column:
    flags = [F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, F.lit(t)) for i, t in enumerate(terms)]
    return F.array_compact(F.array(*flags))


FEATURES = (
    "units_lag_1", "units_lag_7", "units_mean_7d", "units_mean_28d", "units_std_7d", "units_ewma", "store_mean_7d",
    "item_mean_7d", "day_of_week", "month", "is_weekend", "temperature", "humidity", "store_nbr", "item_nbr",
)


def engineered(panel: DataFrame, climate: DataFrame) -> DataFrame:
    """The panel with the model features, unknown ones 0; rows before a series' first lag are left out."""
    from demandloom.operators.joins import with_climate

    df = with_climate(panel, climate)
    df = Wn.lags(df, "units", [1, 7])
    df = Wn.rolling_stats(df, "units", [7, 28], ["mean"])
    df = Wn.rolling_stats(df, "units", [7], ["std"])
    df = Wn.ewma(df, "units", [0.5]).withColumnRenamed("units_ewma_0.5", "units_ewma")
    df = Wn.calendar_context(Wn.calendar_context(df, "store_nbr"), "item_nbr")
    df = df.where(F.col("units_lag_1").isNotNull()).withColumns(
        {"day_of_week": D.weekday0("date"), "month": F.month("date"), "is_weekend": D.is_weekend("date")}
    )
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in FEATURES if c not in PAIR})


def _trees(label: str, rounds: int, rate: float, depth: int, sample: float, validation: str | None, seed: int) -> GBTRegressor:
    trees = GBTRegressor(
        featuresCol="features", labelCol=label, predictionCol="yhat", maxIter=rounds, stepSize=rate, maxDepth=depth,
        subsamplingRate=sample, seed=seed, maxBins=64,
    )
    return trees.setValidationIndicatorCol(validation) if validation else trees


def boosted(
    features: Sequence[str] = FEATURES, label: str = "units", *, rounds: int = 100, rate: float = 0.05, depth: int = 5,
    sample: float = 0.9, validation: str | None = None, seed: int = 42,
) -> Pipeline:
    """Boosted trees over the whole panel; `validation` names a flag column whose rows stop the boosting early."""
    trees = _trees(label, rounds, rate, depth, sample, validation, seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), trees])


def long_enough(train: DataFrame, least: int = 20, keys: Sequence[str] = PAIR) -> DataFrame:
    """Series with at least `least` training rows."""
    return train.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(*keys)


def score_with_skips(model: PipelineModel, test: DataFrame, modelled: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Predictions, floored at 0; a series that was not modelled gets 0."""
    known = modelled.withColumn("_known", F.lit(True))
    scored = model.transform(test.join(known, list(keys), "left"))
    return scored.withColumn("yhat", F.when(F.col("_known"), F.greatest("yhat", F.lit(0.0))).otherwise(0.0)).drop("_known", "features")


def cross_validate(df: DataFrame, make, folds: int = 5, fold: str = "fold", label: str = "units", *, at_once: int = 5) -> DataFrame:
    """Out-of-fold predictions of an expanding-window split: fold k is predicted by a model of the rows before it.

    Up to `at_once` folds are fitted side by side: boosting runs hundreds of short jobs, one after another, in each fit.
    """

    def fitted(k: int):
        return make().fit(df.where(F.col(fold).isNull() | (F.col(fold) < k)))

    with ThreadPoolExecutor(at_once) as pool:
        # The longest fits begin first.
        jobs = [pool.submit(inheritable_thread_target(df.sparkSession)(fitted), k) for k in reversed(range(folds))][::-1]
        parts = [job.result().transform(df.where(F.col(fold) == k)).select(fold, label, "yhat") for k, job in enumerate(jobs)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


class ErrorEvaluator(Evaluator):
    """WAPE or RMSE of `yhat`, the smaller the better; usable in Spark's own validators as well."""

    def __init__(self, objective: str = "wape", label: str = "units"):
        super().__init__()
        self.measure = {"wape": M.wape, "rmse": M.rmse}[objective](label, "yhat")

    def _evaluate(self, dataset: DataFrame) -> float:
        value = dataset.agg(self.measure.alias("v")).first()["v"]
        return math.inf if value is None else float(value)

    def isLargerBetter(self) -> bool:
        return False


def search(
    train: DataFrame, valid: DataFrame, grid: Sequence[dict], objective: str = "wape", label: str = "units", *,
    rounds: int = 100, heats: int = 3, short: int = 10, at_once: int = 4,
) -> list[tuple[float, dict]]:
    """Grid trials scored on the validation part, which also stops their boosting early, best first.

    Successive halving: all trials run a short boosting, the better half one of twice the rounds, until the last heat has
    `rounds` (or the trial's own); trials that left earlier rank after those that stayed. No heat has fewer than `short`
    rounds: the first trees tell little about the rate, and where all rounds are as few, the first heat is the last. The table is assembled and
    written once per set of features, and `at_once` trials run side by side, each a distributed fit and one aggregate row.
    """
    both = train.withColumn("_stop", F.lit(False)).unionByName(valid.withColumn("_stop", F.lit(True)))
    tables: dict[tuple, DataFrame] = {}
    for options in grid:
        features = tuple(options.get("features", FEATURES))
        if features not in tables:
            assembled = VectorAssembler(inputCols=list(features), outputCol="features").transform(both)
            tables[features] = materialize(assembled.select("features", label, "_stop"), "trials")
    evaluator = ErrorEvaluator(objective, label)

    def trial(options: dict, heat: int) -> float:
        table = tables[tuple(options.get("features", FEATURES))]
        full = options.get("rounds", rounds)
        given = {"rate": 0.05, "depth": 5, "sample": 0.9, "seed": 42} | {k: v for k, v in options.items() if k not in ("features", "rounds")}
        model = _trees(label, rounds=max(min(full, short), full >> (heats - 1 - heat)), validation="_stop", **given).fit(table)
        return evaluator.evaluate(model.transform(table.where("_stop")))

    running, ranked = list(grid), []
    heats = 1 if all(o.get("rounds", rounds) <= short for o in grid) else heats
    with ThreadPoolExecutor(at_once) as pool:
        for heat in range(heats):
            job = inheritable_thread_target(train.sparkSession)(lambda options, heat=heat: trial(options, heat))
            scores = list(pool.map(job, running))
            order = sorted(range(len(running)), key=scores.__getitem__)
            stay = len(running) if heat == heats - 1 else -(-len(running) // 2)
            left = [(scores[i], running[i]) for i in order]
            ranked = (left if heat == heats - 1 else left[stay:]) + ranked
            running = [o for _, o in left[:stay]]
    return ranked


def trials_table(spark: SparkSession, trials: Sequence[tuple[float, dict]]) -> DataFrame:
    rows = [(i + 1, ", ".join(f"{k}={v}" for k, v in sorted(o.items())), float(s)) for i, (s, o) in enumerate(trials)]
    return spark.createDataFrame(rows, "rank int, options string, score double")


def scenario_rows(template: DataFrame, scenarios: Sequence[dict]) -> DataFrame:
    """Every template row under every scenario: date parts, climate and flags replaced, `factor` the multiplier.

    The scenarios are a short literal list exploded onto each row. Temperature and humidity are binned by the
    training edges. A season column follows the template's own climate table.
    """
    entries = [
        F.struct(
            F.lit(i).alias("scenario_id"),
            F.lit(s["date"]).cast("date").alias("date"),
            F.lit(int(s.get("is_holiday", 0))).alias("is_holiday"),
            F.lit(float(s["temperature"])).alias("temperature"),
            F.lit(float(s["humidity"])).alias("humidity"),
            F.lit(float(s.get("event_pct", 0.0))).alias("event_pct"),
            F.lit(s.get("weather_condition", "Clear")).alias("weather_condition"),
            F.lit(s.get("competition_level", "Medium")).alias("competition_level"),
            F.lit(s.get("supply_chain", "Normal")).alias("supply_chain"),
        )
        for i, s in enumerate(scenarios)
    ]
    replaced = {
        "date", "is_holiday", "temperature", "humidity", "year", "month", "day", "quarter", "day_of_week", "is_weekend",
        "temp_category", "humidity_level",
    }
    kept = template.drop(*[c for c in template.columns if c in replaced])
    return (
        kept.select("*", F.inline(F.array(*entries)))
        .withColumns(
            {
                "year": F.year("date"),
                "month": F.month("date"),
                "day": F.day("date"),
                "quarter": F.quarter("date"),
                "day_of_week": D.weekday0("date"),
                "is_weekend": D.is_weekend("date"),
                "temp_category": X.bin_label(F.col("temperature"), *X.TRAINING_TEMPERATURE),
                "humidity_level": X.bin_label(F.col("humidity"), *X.TRAINING_HUMIDITY),
                "factor": X.scenario_factor(
                    F.col("event_pct"), F.col("weather_condition"), F.col("competition_level"), F.col("supply_chain"), F.col("date")
                ),
            }
        )
        .drop("event_pct", "weather_condition", "competition_level", "supply_chain")
    )


def what_if(model: PipelineModel, latest: DataFrame, scenarios: Sequence[dict]) -> DataFrame:
    """Model output for the newest row of every series under every scenario, times the scenario's factor."""
    scored = model.transform(scenario_rows(latest, scenarios))
    return scored.select(*PAIR, "scenario_id", "date", F.col("yhat").alias("base"), "factor", (F.col("yhat") * F.col("factor")).alias("adjusted"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)

"""Boosted trees and what is built on them, on small frames with a known answer."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandloom.operators import forecast as Fc

FEATURES = ("a", "b")


@pytest.fixture(scope="module")
def frame(spark):
    """units = 5 for small a, 20 for large a, plus b; two series, the second with few rows."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        a, b = float(rng.random()), float(rng.integers(0, 3))
        rows.append((dt.date(2020, 1, 1) + dt.timedelta(days=i), 1 if i % 40 else 2, 1, a, b, (20.0 if a > 0.5 else 5.0) + b))
    return spark.createDataFrame(rows, "date date, store_nbr int, item_nbr int, a double, b double, units double").cache()


def error(df):
    return df.select(F.avg(F.abs(F.col("units") - F.col("yhat")))).first()[0]


def test_boosting_beats_the_mean(frame):
    train, test = frame.where("date < '2020-11-01'"), frame.where("date >= '2020-11-01'")
    model = Fc.boosted(FEATURES, rounds=20, rate=0.3, depth=3).fit(train)
    mean = train.agg(F.avg("units")).first()[0]
    assert error(model.transform(test)) < 0.2 * error(test.withColumn("yhat", F.lit(mean)))


def test_validation_rows_stop_the_boosting(frame):
    """With validation targets that contradict the training ones, hardly a round helps."""
    flagged = frame.withColumn("hold", F.col("date") >= "2020-09-01").withColumn("units", F.when(F.col("hold"), 25 - F.col("units")).otherwise(F.col("units")))
    early = Fc.boosted(FEATURES, rounds=30, rate=0.3, depth=3, validation="hold").fit(flagged)
    assert early.stages[-1].getNumTrees < 30


def test_folds_are_predicted_by_models_of_the_rows_before(frame):
    folded = frame.withColumn("fold", F.when(F.month("date") > 6, (F.month("date") - 7).cast("int")))
    out = Fc.cross_validate(folded.where("fold IS NULL OR fold < 3"), lambda: Fc.boosted(FEATURES, rounds=10, rate=0.3, depth=3), folds=3)
    assert out.select("fold").distinct().count() == 3 and error(out) < 2.0


def test_folds_are_fitted_side_by_side(frame):
    """Each of three fits waits until all three run; the predictions stay those of each fold's own model."""
    import threading

    from pyspark.ml import Estimator

    together = threading.Barrier(3, timeout=60)

    class Waiting(Estimator):
        def _fit(self, dataset):
            together.wait()
            return Fc.boosted(FEATURES, rounds=2, rate=0.3, depth=2).fit(dataset)

    folded = frame.withColumn("fold", F.when(F.month("date") > 6, (F.month("date") - 7).cast("int"))).where("fold IS NULL OR fold < 3")
    out = Fc.cross_validate(folded, Waiting, folds=3)
    alone = Fc.boosted(FEATURES, rounds=2, rate=0.3, depth=2).fit(folded.where("fold IS NULL OR fold < 1")).transform(folded.where("fold = 1"))
    key = ["units", "yhat"]
    assert sorted(map(tuple, out.where("fold = 1").select(key).collect())) == sorted(map(tuple, alone.select(key).collect()))


@pytest.mark.parametrize("objective", ["wape", "rmse"])
def test_search_ranks_trials(frame, objective):
    train, valid = frame.where("date < '2020-09-01'"), frame.where("date >= '2020-09-01'")
    grid = [{"features": FEATURES, "rounds": 5, "rate": r, "depth": 3} for r in (0.01, 0.5)]
    ranked = Fc.search(train, valid, grid, objective)
    assert [o["rate"] for _, o in ranked] == [0.5, 0.01] and ranked[0][0] < ranked[1][0]


def test_short_series_get_zero(frame):
    train, test = frame.where("date < '2020-09-01'"), frame.where("date >= '2020-09-01'")
    modelled = Fc.long_enough(train, 20)
    assert [r["store_nbr"] for r in modelled.collect()] == [1]
    model = Fc.boosted(FEATURES, rounds=5, rate=0.5, depth=3).fit(train.join(modelled, ["store_nbr", "item_nbr"], "left_semi"))
    scored = {r["store_nbr"]: r["m"] for r in Fc.score_with_skips(model, test, modelled).groupBy("store_nbr").agg(F.max("yhat").alias("m")).collect()}
    assert scored[2] == 0.0 and scored[1] > 10

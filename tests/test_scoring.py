"""Scoring, penalised paths, validation by sums, trend changes, unit roots and searches against plain computations."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from demandloom.functions import scalars as X
from demandloom.operators import changes as Ch
from demandloom.operators import forecast as Fc
from demandloom.operators import joins as J
from demandloom.operators import quantiles as Q
from demandloom.operators import ridge as R
from demandloom.operators import scoring as Sg
from demandloom.operators import sets as S
from demandloom.operators import unit_roots as U

PAIRED = "date date, store_nbr int, item_nbr int, units double"


def days(n, start=dt.date(2019, 1, 1)):
    return [start + dt.timedelta(days=i) for i in range(n)]


def test_requests_see_history_only(spark):
    """Every request of a series has the means of the last known values, however far ahead."""
    past = spark.createDataFrame([(d, 1, 1, None if i == 8 else float(i)) for i, d in enumerate(days(10))], PAIRED)
    asked = spark.createDataFrame([(d, 1, 1) for d in days(40, dt.date(2019, 1, 11))], "date date, store_nbr int, item_nbr int")
    got = Sg.known_means(S.stack_requests(past, asked, "is_request"), "units", (1, 3)).where("is_request").select("known_1", "known_3").distinct().collect()
    assert [tuple(r) for r in got] == [(9.0, (9 + 7 + 6) / 3)]
    first = Sg.known_means(past, "units", (1, 3)).orderBy("date").collect()
    assert first[0]["known_1"] is None and first[9]["known_1"] == 7.0 and first[1]["known_3"] == 0.0


def test_boosted_submission_end_to_end(spark):
    """Two series with a plain level each, one too short for a model: scored, un-logged, floored, written, read back."""
    history = [(d, s, 1, 10.0 * s) for s in (1, 2) for d in days(60)] + [(d, 3, 1, 7.0) for d in days(5)]
    asked = [(d, s, 1) for s in (1, 2, 3) for d in days(3, dt.date(2019, 3, 2))]
    past = spark.createDataFrame(history, PAIRED).withColumn("logunits", X.log_units(F.col("units"))).drop("units")
    requests = spark.createDataFrame(asked, "date date, store_nbr int, item_nbr int")
    rows = Sg.known_means(S.stack_requests(past, requests, "is_request"), "logunits").where("known_1 IS NOT NULL")
    modelled = Fc.long_enough(rows.where("NOT is_request"))
    model = Fc.boosted(("known_1", "known_7"), label="logunits", rounds=5, rate=0.5, depth=2).fit(rows.where("NOT is_request"))
    out = Sg.submit(Sg.demand_of_logs(model.transform(rows.where("is_request")), F.col("yhat"), modelled)).collect()
    assert [r["id"] for r in out] == sorted((r["id"] for r in out), key=lambda x: (x.split("_")[2], x))
    units = {r["id"].split("_")[0]: r["units"] for r in out}
    assert len(out) == 9 and units["1"] == pytest.approx(10, rel=0.05) and units["2"] == pytest.approx(20, rel=0.05) and units["3"] == 0.0


def panel(spark, stores=3, n=200, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(s, i, float(a), float(2 * a + rng.normal(0, 0.1)), 4.0, float(3 * s + 2 * a + rng.normal())) for s in range(stores) for i, a in enumerate(rng.normal(size=n))]
    return pd.DataFrame(rows, columns=["store_nbr", "i", "a", "b", "c", "y"])


def ridge_by_hand(x, y, penalty):
    """Minimum over the rows: the intercept is free, each term's penalty its centred sum of squares."""
    centred = x - x.mean(axis=0)
    weights = np.diag((centred**2).sum(axis=0))
    slope = np.linalg.pinv(centred.T @ centred + penalty * weights) @ centred.T @ (y - y.mean())
    return np.array([y.mean() - x.mean(axis=0) @ slope, *slope])


def test_path_equals_refits(spark):
    pdf = panel(spark)
    df = spark.createDataFrame(pdf)
    terms = {c: F.col(c) for c in "abc"}
    fits = R.fit_paths(df, terms, F.col("y"), F.col("i") >= 150, ["store_nbr"], least=20).collect()
    assert len(fits) == 3
    for row in fits:
        part = pdf[pdf.store_nbr == row["store_nbr"]]
        x, y = part[list("abc")].to_numpy(), part.y.to_numpy()
        train, valid = x[:150], x[150:]
        by_penalty = {v: ridge_by_hand(train, y[:150], v) for v in R.PENALTIES}
        error = {v: math.sqrt(((y[150:] - k[0] - valid @ k[1:]) ** 2).mean()) for v, k in by_penalty.items()}
        best = min(error, key=error.get)
        assert row["fit"]["penalty"] == best and row["fit"]["valid_rmse"] == pytest.approx(error[best], rel=1e-9)
        assert row["fit"]["coef"] == pytest.approx(by_penalty[best], abs=1e-8)
        assert row["fit"]["coef"][3] == 0.0  # a constant term


def test_path_without_validation_and_short_series(spark):
    df = spark.createDataFrame(panel(spark)).where("store_nbr < 2 AND (store_nbr = 0 OR i < 10)")
    fits = R.fit_paths(df, {"a": F.col("a")}, F.col("y"), F.lit(None).cast("boolean"), ["store_nbr"]).collect()
    assert [(r["store_nbr"], r["fit"]["penalty"], r["fit"]["valid_rmse"]) for r in fits] == [(0, min(R.PENALTIES), None)]


def test_fold_scores_from_sums_equal_rows(spark):
    pdf = panel(spark, 2, 120)
    pdf["fold"] = np.where(pdf.i < 20, np.nan, (pdf.i - 20) // 20)
    df = spark.createDataFrame(pdf).withColumn("fold", F.when(~F.isnan("fold"), F.col("fold").cast("int")))
    terms = {"a": F.col("a"), "b": F.col("b")}
    got = R.expanding_fits(df, terms, F.col("y"), keys=["store_nbr"])
    rows = {(r["store_nbr"], r["fold"]): r for r in got.collect()}
    assert len(rows) == 10
    for (store, fold), row in rows.items():
        part = pdf[pdf.store_nbr == store]
        train, own = part[~(part.fold >= fold)], part[part.fold == fold]
        design = np.column_stack([np.ones(len(train)), train.a, train.b])
        coef = np.linalg.lstsq(design, train.y, rcond=None)[0]
        gap = own.y - np.column_stack([np.ones(len(own)), own.a, own.b]) @ coef
        assert (row["n_train"], row["n"]) == (len(train), len(own))
        assert row["rmse"] == pytest.approx(math.sqrt((gap**2).mean()), rel=1e-8) and row["bias"] == pytest.approx(gap.mean(), abs=1e-9)
    by_row = R.out_of_fold(df, got, terms, keys=["store_nbr"]).groupBy("store_nbr", "fold").agg(F.sqrt(F.avg((F.col("y") - F.col("yhat")) ** 2)).alias("rmse"))
    assert all(r["rmse"] == pytest.approx(rows[r["store_nbr"], r["fold"]]["rmse"], rel=1e-8) for r in by_row.collect())


def test_planted_trend_changes_are_found(spark):
    rng = np.random.default_rng(4)
    span = days(1500)
    dates = Ch.candidate_dates(span[0], span[-1], 10)
    rows = []
    for store, slopes in ((1, {2: 30.0, 6: -50.0}), (2, {}), (3, {4: 20.0})):
        for d in span:
            y = 100 + 5 * (d - span[0]).days / 365.25 + sum(v * max(0, (d - dates[k]).days) / 365.25 for k, v in slopes.items())
            rows.append((d, store, 1, float(y + 8 * math.sin(2 * math.pi * (d - span[0]).days / 365.25) + rng.normal(0, 2))))
    df = spark.createDataFrame(rows, PAIRED)
    models, terms = Ch.fit_with_changes(df, dates, F.col("units"), ["store_nbr"])
    found = {r["store_nbr"]: r["fit"] for r in models.collect()}
    assert [found[s]["changes"] for s in (1, 2, 3)] == [[2, 6], [], [4]]
    at = len(terms) - len(dates) + 1
    assert found[1]["coef"][at + 2] == pytest.approx(30, abs=3) and found[1]["coef"][at + 6] == pytest.approx(-50, abs=3)
    assert found[2]["coef"][at:] == [0.0] * 10 and found[2]["sigma"] == pytest.approx(2, rel=0.1)
    predicted = Fc.predict_seasonal(df, models, ["store_nbr"], terms=terms)
    assert predicted.select(F.avg(F.abs(F.col("units") - F.col("yhat")))).first()[0] < 2


def unit_root_by_regressions(y):
    """Every lag count fitted on its own."""
    n = len(y)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    if most < 0 or np.ptp(y) == 0:
        return None
    change = np.diff(y)

    def fit(lags, first):
        rows = np.arange(first, n - 1)
        design = np.column_stack([y[rows], np.ones(len(rows)), *[change[rows - k] for k in range(1, lags + 1)]])
        coef, *_ = np.linalg.lstsq(design, change[rows], rcond=None)
        return coef, np.linalg.pinv(design.T @ design), float(((change[rows] - design @ coef) ** 2).sum()), len(rows), design.shape[1]

    def aic(lags):
        _, _, rss, count, p = fit(lags, most)
        return count * (math.log(2 * math.pi * rss / count) + 1) + 2 * p

    best = min(range(most + 1), key=aic)
    coef, inverse, rss, count, p = fit(best, best)
    return None if count <= p else (coef[0] / math.sqrt(rss / (count - p) * inverse[0, 0]), best, count)


def test_unit_roots_equal_separate_regressions(spark):
    rng = np.random.default_rng(6)
    series = {k: np.cumsum(rng.normal(size=n)) * 0.3 + rng.normal(size=n) for k, n in enumerate((3, 5, 6, 9, 14, 40, 117, 300, 801))}
    cyclic = [40 + 20 * math.sin(i / 58) + 5 * (i % 7 == 0) + rng.normal() for i in range(500)]
    series |= {20: np.array(cyclic), 21: np.ones(30)}
    rows = [(k, d, float(v)) for k, y in series.items() for d, v in zip(days(len(y)), y)] + [(20, dt.date(2030, 1, 1), None), (22, dt.date(2030, 1, 1), None)]
    got = {r["station_nbr"]: r for r in U.stationarity(spark.createDataFrame(rows, "station_nbr int, date date, v double"), ["v"]).collect()}
    assert set(got) == {*series}
    for k, y in series.items():
        want = unit_root_by_regressions(y)
        if want is None:
            assert got[k]["statistic"] is None and got[k]["lags"] is None and got[k]["stationary"] is None
        else:
            assert (got[k]["lags"], got[k]["n"]) == want[1:] and got[k]["statistic"] == pytest.approx(want[0], rel=1e-6)


def test_search_with_halving_finds_the_sequential_winner(spark):
    rng = np.random.default_rng(9)
    a = rng.random(300)
    pdf = pd.DataFrame({"a": a, "b": rng.random(300), "units": 20 + 30 * np.sin(6 * a) + rng.normal(0, 1, 300), "i": range(300)})
    df = spark.createDataFrame(pdf)
    train, valid = df.where("i < 200"), df.where("i >= 200")
    grid = [{"features": ("a", "b"), "rate": r, "depth": d} for r in (0.02, 0.4) for d in (1, 3)]
    ranked = Fc.search(train, valid, grid, rounds=12, short=6)
    both = train.withColumn("_stop", F.lit(False)).unionByName(valid.withColumn("_stop", F.lit(True)))
    plain = {}
    for options in grid:
        model = Fc.boosted(validation="_stop", rounds=12, **options).fit(both)
        plain[options["rate"], options["depth"]] = Fc.ErrorEvaluator().evaluate(model.transform(valid))
    assert [(o["rate"], o["depth"]) for _, o in ranked] == sorted(plain, key=plain.get)


def test_positional_join_of_unequal_tables(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    left = spark.createDataFrame([(i * 7 % 101, f"l{i * 7 % 101}") for i in range(101)], "k int, v string").repartition(7)
    right = spark.createDataFrame([(-i, i) for i in range(60)], "k int, w int")
    got = J.positional_join(left, right, ["k"], ["w"]).orderBy("position").collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [tuple(r) for r in got] == [(i, i, f"l{i}", -i if i < 60 else None, i if i < 60 else None) for i in range(101)]
    assert J.positional_join(left.limit(0), right, ["k"], ["w"]).where("k IS NULL").count() == 60


def test_frames_by_key_come_back(spark):
    df = spark.createDataFrame([(1, 1, 5, 2.0), (1, 1, 3, None), (2, 1, 4, 1.0)], "store_nbr int, item_nbr int, t int, yhat double")
    maps = S.keyed_frames(df, ["store_nbr", "item_nbr"], ["t", "yhat"])
    assert maps.count() == 1
    flat = S.flatten_frames(maps.withColumn("run", F.lit(7)))
    assert sorted(tuple(r) for r in flat.collect()) == [(7, "1_1", 3, None), (7, "1_1", 5, 2.0), (7, "2_1", 4, 1.0)]
    united = S.union_frames({"a": df.select("t"), "b": df.select("t", "yhat")})
    assert united.where("store_item = 'a' AND yhat IS NULL").count() == 3 and united.count() == 6


@pytest.mark.parametrize("kind", ["spread", "ties", "one"])
def test_quantiles_rank_only_what_they_need(spark, kind):
    rng = np.random.default_rng(3)
    values = {"spread": rng.normal(size=20000), "ties": np.floor(rng.exponential(2, 20000)), "one": np.full(5000, 3.5)}[kind]
    df = spark.createDataFrame(pd.DataFrame({"g": np.arange(len(values)) % 2, "v": values}))
    for r in Q.exact_quantiles(df, "v", (0, 0.1, 0.25, 0.5, 0.999, 1), ["g"]).collect():
        own = values[r["g"] :: 2]
        assert [r[f"q{i}"] for i in range(6)] == pytest.approx(np.quantile(own, (0, 0.1, 0.25, 0.5, 0.999, 1)), rel=1e-12) and r["n"] == len(own)

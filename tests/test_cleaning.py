import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from demandloom.functions import scalars as X
from demandloom.operators import cleaning as C
from demandloom.operators import sets as S
from demandloom.operators.quantiles import exact_quantiles
from tests.conftest import rows


def series(spark, values, store=1):
    data = [(dt.date(2020, 1, 1) + dt.timedelta(days=i), store, 7, v) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "date date, store_nbr int, item_nbr int, units double")


def values(df):
    return [r["units"] for r in df.orderBy("store_nbr", "date").collect()]


def test_interpolation_fills_inner_gaps_carries_tail_leaves_head(spark):
    assert values(C.interpolate(series(spark, [None, 1.0, None, 3.0, None]), ["units"])) == [None, 1.0, 2.0, 3.0, 3.0]


def test_interpolation_matches_pandas_and_is_idempotent(spark):
    rng = np.random.default_rng(1)
    raw = [None if rng.random() < 0.4 else float(rng.integers(0, 50)) for _ in range(80)]
    filled = C.interpolate(series(spark, raw), ["units"])
    expected = pd.Series(raw, dtype=float).interpolate()
    got = pd.Series(values(filled), dtype=float)
    pd.testing.assert_series_equal(got, expected)
    assert values(C.interpolate(filled, ["units"])) == values(filled)


def test_series_do_not_leak_into_each_other(spark):
    both = series(spark, [5.0, None], 1).unionByName(series(spark, [None, 9.0], 2))
    assert values(C.interpolate(both, ["units"])) == [5.0, 5.0, None, 9.0]
    assert values(C.carry(both, ["units"], ["store_nbr", "item_nbr"])) == [5.0, 5.0, None, 9.0]


def test_sentinels(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["T", "  T", "M", "-", " 5"])], "i int, v string")
    trimmed = df.select("i", X.sentinel_number(F.col("v")).alias("n"))
    assert [r[1] for r in rows(trimmed, "i")] == [0.01, 0.01, None, None, 5.0]
    as_is = df.select("i", X.sentinel_number(F.col("v"), trim=False).alias("n"))
    assert [r[1] for r in rows(as_is, "i")] == [0.01, None, None, None, 5.0]


def test_bin_edges(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([20.0, 20.1, 25.0, 30.0, None])], "i int, v double")
    labels = df.select("i", X.bin_label(F.col("v"), *X.TRAINING_TEMPERATURE).alias("b"))
    assert [r[1] for r in rows(labels, "i")] == ["Cold", "Cool", "Cool", "Warm", None]


def test_tokens(spark):
    df = spark.createDataFrame([(0, " RA  SN "), (1, ""), (2, None), (3, "FG+")], "i int, c string")
    flags = df.select("i", *[c.alias(k) for k, c in X.token_indicators("c", ["FG+", "RA", "SN"]).items()])
    assert rows(flags, "i") == [(0, 0, 1, 1), (1, 0, 0, 0), (2, 0, 0, 0), (3, 1, 0, 0)]


def test_all_null_series_stays_null_under_its_own_mean(spark):
    both = series(spark, [None, None], 1).unionByName(series(spark, [2.0, None], 2))
    assert values(C.fill_group_mean(both)) == [None, None, 2.0, 2.0]
    assert values(C.fill_global_mean(both)) == [2.0, 2.0, 2.0, 2.0]


def test_outliers_become_the_mean(spark):
    raw = [10.0] * 30 + [1000.0]
    mean = sum(raw) / len(raw)
    assert values(C.flatten_outliers(series(spark, raw)))[-1] == pytest.approx(mean)


def test_repair_keeps_earlier_gaps_open_on_request(spark):
    raw = [10.0, 11.0, None, 12.0, 500.0, 13.0, 12.0]
    df = series(spark, raw).withColumnRenamed("units", "tmax").withColumnRenamed("store_nbr", "station_nbr").drop("item_nbr")
    get = lambda d: [r["tmax"] for r in d.orderBy("date").collect()]
    assert get(C.repair_outliers(df, ["tmax"])) == [10.0, 11.0, 11.5, 12.0, 12.5, 13.0, 12.0]
    assert get(C.repair_outliers(df, ["tmax"], fill_missing=False))[2] is None


@pytest.mark.parametrize("shape", ["one_value", "hot_value", "spread", "short"])
def test_exact_quantiles_equal_numpy(spark, shape):
    rng = np.random.default_rng(3)
    data = {
        "one_value": np.full(50, 4.0),
        "hot_value": np.concatenate([np.zeros(2000), rng.normal(size=900)]),
        "spread": rng.exponential(size=5000) * 1000,
        "short": np.array([3.0, 1.0]),
    }[shape]
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0]
    pdf = pd.DataFrame({"g": np.where(np.arange(len(data)) % 3 == 0, "a", None), "v": data})
    df = spark.createDataFrame(pdf, "g string, v double").repartition(5)
    whole = exact_quantiles(df, "v", probs).first()
    assert [whole[f"q{i}"] for i in range(len(probs))] == pytest.approx(list(np.quantile(data, probs)))
    for r in exact_quantiles(df, "v", probs, ["g"]).collect():
        part = pdf[pdf.g.isna() if r["g"] is None else pdf.g == r["g"]].v
        assert [r[f"q{i}"] for i in range(len(probs))] == pytest.approx(list(np.quantile(part, probs)))
        assert r["n"] == len(part)


def test_position_folds_follow_the_total_order(spark):
    data = [(dt.date(2020, 1, 1 + d), s, i) for d in range(5) for s in range(3) for i in range(4)]
    df = spark.createDataFrame(data, "date date, store_nbr int, item_nbr int").repartition(3)
    folded = S.position_folds(df, 5).orderBy("date", "store_nbr", "item_nbr").collect()
    assert [r["position"] for r in folded] == list(range(60))
    assert [r["fold"] for r in folded] == [None] * 10 + [k for k in range(5) for _ in range(10)]

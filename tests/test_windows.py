import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from demandloom.operators import windows as Wn
from tests.conftest import rows

KEYS = ["store_nbr", "item_nbr"]


@pytest.fixture(scope="module")
def gappy():
    rng = np.random.default_rng(5)
    parts = []
    for store, item, n in ((1, 1, 120), (1, 2, 60), (2, 1, 1)):
        units = np.where(rng.random(n) < 0.2, np.nan, rng.integers(0, 60, n).astype(float))
        parts.append(pd.DataFrame({"date": pd.date_range("2020-01-01", periods=n).date, "store_nbr": store, "item_nbr": item, "units": units}))
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="module")
def panel(spark, gappy):
    clean = gappy.astype(object).where(gappy.notna(), None)
    return spark.createDataFrame(clean.values.tolist(), "date date, store_nbr int, item_nbr int, units double").repartition(5)


def aligned(df, column):
    pdf = df.select(*KEYS, "date", F.col(f"`{column}`").alias("v")).toPandas().sort_values([*KEYS, "date"])
    return pdf["v"].astype(float).to_numpy()


def grouped(gappy, fn):
    return gappy.sort_values([*KEYS, "date"]).groupby(KEYS)["units"].transform(fn).to_numpy()


def same(a, b):
    np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-9, equal_nan=True)


@pytest.mark.parametrize("stat", ["mean", "min", "max", "std"])
def test_rolling_equals_pandas(panel, gappy, stat):
    got = aligned(Wn.rolling_stats(panel, "units", [7], [stat]), f"units_{stat}_7d")
    same(got, grouped(gappy, lambda s: getattr(s.shift(1).rolling(7, min_periods=1), stat)()))


@pytest.mark.parametrize("adjust", [False, True])
@pytest.mark.parametrize("alpha", [0.5, 0.75, 0.2])
def test_ewma_equals_pandas_with_gaps(panel, gappy, adjust, alpha):
    got = aligned(Wn.ewma(panel, "units", [alpha], adjust=adjust), f"units_ewma_{alpha}")
    same(got, grouped(gappy, lambda s: s.shift(1).ewm(alpha=alpha, adjust=adjust).mean()))


@pytest.mark.parametrize("adjust", [False, True])
@pytest.mark.parametrize("gap", [60, 70, 500])
def test_ewma_carries_over_long_gaps(spark, gap, adjust):
    known = [3.0, 17.0, 5.5, 21.0]
    values = known + [None] * gap + [8.0, None, 2.0] + [float(i % 9) for i in range(90)]
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(len(values))]
    df = spark.createDataFrame([(d, 1, 1, v) for d, v in zip(days, values)], "date date, store_nbr int, item_nbr int, units double")
    expected = pd.Series(values, dtype=float).shift(1).ewm(alpha=0.5, adjust=adjust).mean().to_numpy()
    same(aligned(Wn.ewma(df, "units", [0.5], adjust=adjust), "units_ewma_0.5"), expected)


def test_ewma_aliases_repeat_the_column(panel):
    df = Wn.ewma(panel, "units", [0.5], aliases=[7, 14])
    assert df.where(~F.col("`units_ewma_0.5_7d`").eqNullSafe(F.col("`units_ewma_0.5`"))).count() == 0


def test_moving_average_waits_for_a_full_window(panel, gappy):
    got = aligned(Wn.moving_average(panel, "units", 7, keys=KEYS), "ma7")
    same(got, grouped(gappy, lambda s: s.rolling(7).mean()))


def test_rolling_fill_equals_pandas(panel, gappy):
    got = aligned(Wn.rolling_fill(panel), "smooth")
    same(got, grouped(gappy, lambda s: s.rolling(7).mean().interpolate().ffill().bfill()))


@pytest.mark.parametrize("chunk", ["month", "week", "year"])
def test_row_context_is_the_same_under_any_chunking(spark, chunk):
    rng = np.random.default_rng(9)
    data = []
    for store in (1, 2):
        for day in range(0, 400, 1 if store == 1 else 37):
            for item in range(int(rng.integers(1, 5))):
                data.append((dt.date(2020, 1, 1) + dt.timedelta(days=day), store, item, float(rng.integers(0, 40))))
    pdf = pd.DataFrame(data, columns=["date", "store_nbr", "item_nbr", "units"]).sort_values(["store_nbr", "date", "item_nbr"])
    df = spark.createDataFrame(pdf, "date date, store_nbr int, item_nbr int, units double").repartition(6)
    got = Wn.row_context(df, "store_nbr", "item_nbr", chunk=chunk).toPandas().sort_values(["store_nbr", "date", "item_nbr"])
    past = pdf.groupby("store_nbr")["units"].transform(lambda s: s.shift(1).rolling(7, min_periods=1).sum())
    same(got["store_sum_7r"].astype(float).to_numpy(), past.to_numpy())
    assert len(got) == len(pdf)


def test_features_never_look_at_the_current_row(spark, panel):
    """Changing the last row of a series leaves all its own features unchanged."""
    def features(df):
        df = Wn.rolling_stats(Wn.lags(df, "units", [1, 7]), "units", [7])
        df = Wn.ewma(df, "units", [0.5])
        df = Wn.calendar_context(Wn.row_context(df, "store_nbr", "item_nbr"), "store_nbr")
        return rows(df.where("store_nbr = 1 and item_nbr = 1 and date = date'2020-04-29'").drop("units"))

    changed = panel.withColumn(
        "units", F.when((F.col("date") >= F.lit(dt.date(2020, 4, 29))) & (F.col("store_nbr") == 1), 999.0).otherwise(F.col("units"))
    )
    assert features(panel) == features(changed)


def brute_pacf(x, k):
    x = x - x.mean()
    r = np.array([(x[: len(x) - j] * x[j:]).sum() for j in range(k + 1)]) / (x * x).sum()
    toeplitz = r[np.abs(np.subtract.outer(np.arange(k), np.arange(k)))]
    return np.linalg.solve(toeplitz, r[1:])[-1]


def test_pacf_equals_the_direct_solution(spark):
    rng = np.random.default_rng(2)
    x = np.zeros(200)
    for t in range(2, 200):
        x[t] = 0.6 * x[t - 1] - 0.3 * x[t - 2] + rng.normal()
    data = [(dt.date(2020, 1, 1) + dt.timedelta(days=i), 1, 1, float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(data, "date date, store_nbr int, item_nbr int, units double")
    found = {r["lag"]: r["pacf"] for r in Wn.pacf(df, "units", 10).collect()}
    assert [found[k] for k in range(1, 11)] == pytest.approx([brute_pacf(x, k) for k in range(1, 11)])
    vote = rows(Wn.significant_lags(df, "units", 10).select("lag", "series_hit", "series_total"))
    assert vote[0][1:] == (1, 1) and {1, 2} <= {r[0] for r in vote}


def test_short_series_have_no_pacf(spark):
    data = [(dt.date(2020, 1, 1) + dt.timedelta(days=i), 1, 1, float(i % 3)) for i in range(20)]
    df = spark.createDataFrame(data, "date date, store_nbr int, item_nbr int, units double")
    assert Wn.pacf(df, "units", 10).count() == 0
    assert Wn.pacf(df, "units", 9).count() == 9


def test_constant_series_has_no_correlation(spark):
    data = [(dt.date(2020, 1, 1) + dt.timedelta(days=i), 1, 1, 4.0) for i in range(30)]
    df = spark.createDataFrame(data, "date date, store_nbr int, item_nbr int, units double")
    assert {r["rho"] for r in Wn.lag_correlation(df, "units", 3).collect()} == {None}


def test_station_history_is_sorted_without_the_readings(spark, small):
    """Readings come to the rows after all windows over them; no order is sorted by string aggregates on the way."""
    from demandloom.operators import features as Ft
    from demandloom.sources import panels

    raw = panels.weather_raw(spark, small)
    assert "SortAggregate" not in raw._jdf.queryExecution().executedPlan().toString()
    weather = panels.weather_numeric(spark, small).select("station_nbr", "date", F.col("tmax").alias("a_reading"))
    panel = panels.sales_dirty(spark, small).select("date", "store_nbr", "item_nbr", "units")
    table = Ft.station_features(panel, weather, panels.store_key(spark, small), panels.calendar(spark))
    lines = table._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joined = next(i for i, line in enumerate(lines) if "Join" in line and "station_nbr" in line)
    assert "a_reading" in table.columns and joined < next(i for i, line in enumerate(lines) if "Window" in line)

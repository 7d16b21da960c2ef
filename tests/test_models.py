import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from demandloom.functions import stats
from demandloom.operators import attribution as At
from demandloom.operators import evaluation as E
from demandloom.operators import forecast as Fc
from demandloom.operators import gram as G
from demandloom.operators import screening as Sc
from demandloom.operators import unit_roots as U


def frame(spark, pdf, schema):
    return spark.createDataFrame(pdf, schema).repartition(4)


def test_tail_probabilities_have_known_values():
    # Closed forms: F(2, d2) tail is (1 + 2f/d2)^(-d2/2); T with one degree is Cauchy; with two x/sqrt(2 + x²).
    f = np.array([0.1, 1.0, 3.0, 20.0])
    assert stats.f_pvalue(f, 2, 10) == pytest.approx((1 + 2 * f / 10) ** -5.0, rel=1e-10)
    t = np.array([0.0, 0.5, 2.0, 12.0])
    assert stats.t_pvalue(t, 1) == pytest.approx(1 - 2 * np.arctan(t) / math.pi, rel=1e-9)
    assert stats.t_pvalue(t, 2) == pytest.approx(1 - t / np.sqrt(2 + t * t), rel=1e-9)
    assert stats.t_pvalue(1.959964, 1e7) == pytest.approx(0.05, abs=1e-5)


def test_fits_equal_direct_least_squares(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 600), "a": rng.normal(size=600), "b": rng.normal(size=600)})
    pdf["y"] = 2 + pdf.a * 3 - pdf.b + pdf.k + rng.normal(size=600)
    got = {r["k"]: r for r in G.fit(frame(spark, pdf, "k int, a double, b double, y double"), {"a": F.col("a"), "b": F.col("b")}, F.col("y"), ["k"]).collect()}
    for k, part in pdf.groupby("k"):
        design = np.column_stack([np.ones(len(part)), part.a, part.b])
        coef, rss, _, _ = np.linalg.lstsq(design, part.y, rcond=None)
        fit = got[k]["fit"]
        assert fit["coef"] == pytest.approx(list(coef))
        assert fit["r2"] == pytest.approx(1 - rss[0] / ((part.y - part.y.mean()) ** 2).sum())
        assert fit["condition"] == pytest.approx(np.linalg.cond(design))


def test_empty_direction_gets_zero(spark):
    pdf = pd.DataFrame({"a": np.arange(10.0), "z": np.zeros(10), "y": 5 + 2 * np.arange(10.0)})
    fit = G.fit(frame(spark, pdf, "a double, z double, y double"), {"a": F.col("a"), "z": F.col("z")}, F.col("y")).first()["fit"]
    assert fit["coef"] == pytest.approx([5, 2, 0])


def test_seasonal_model_recovers_its_own_signal(spark):
    days = [dt.date(2000, 1, 1) + dt.timedelta(days=i) for i in range(900)]
    y = [20 + 3 * math.sin(2 * math.pi * (d - dt.date(1995, 1, 1)).days / 365.25) + (5 if d.weekday() == 5 else 0) for d in days]
    pdf = pd.DataFrame({"date": days, "store_nbr": 1, "item_nbr": 1, "units": y})
    df = frame(spark, pdf, "date date, store_nbr int, item_nbr int, units double")
    cut = F.lit(dt.date(2002, 1, 1))
    models = Fc.fit_seasonal(df.where(F.col("date") < cut))
    worst = Fc.predict_seasonal(df.where(F.col("date") >= cut), models).agg(F.max(F.abs(F.col("units") - F.col("yhat")))).first()[0]
    assert worst < 1e-6
    logs = Fc.predict_seasonal(df, Fc.fit_seasonal(df, multiplicative=True), multiplicative=True)
    assert logs.where((F.col("yhat_lower") > F.col("yhat")) | (F.col("yhat_upper") < F.col("yhat"))).count() == 0


def test_second_fit_keeps_only_significant_terms(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"store_nbr": 1, "t": rng.normal(size=500), "h": rng.normal(size=500), "w": rng.integers(0, 3, 500)})
    pdf["units"] = 4 + 2 * pdf.t + rng.normal(size=500) * 0.1 + 3 * (pdf.w == 2)
    models, terms = Fc.store_models(frame(spark, pdf, "store_nbr int, t double, h double, w int, units double"), ["t", "h"], {"w": [0, 1, 2]}, F.col("units"))
    kept = Fc.refit_significant(models, terms, 0.001).first()
    assert kept["terms"] == ["t", "w_2"] and kept["kept"] == 2 and kept["r2"] > 0.99


def test_subset_search_ranks_the_true_terms_first(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame(rng.normal(size=(400, 4)), columns=list("abcd"))
    pdf["y"] = pdf.a - 2 * pdf.b**2 + rng.normal(size=400) * 0.01
    terms = Sc.power_terms(list("abcd"), 2)
    found = Sc.subset_search(frame(spark, pdf, "a double, b double, c double, d double, y double"), F.col("y"), terms, 2, 3)
    assert found.count() == math.comb(8, 2) + math.comb(8, 3)
    assert found.where("size = 2").first()["terms"] == "a + b^2"


def test_subset_count_of_fifteen_terms():
    assert sum(math.comb(15, k) for k in range(2, 6)) == 4928


def test_collinear_screen_counts_dropped_columns_too(spark):
    x = np.arange(100.0)
    pdf = pd.DataFrame({"units": x, "a": x, "b": x * 2, "c": -x + 0.001 * x**2, "d": np.sin(x)})
    df = frame(spark, pdf, "units double, a double, b double, c double, d double")
    kept, dropped = Sc.drop_collinear(df, 0.95, ["units"])
    assert dropped == ["b", "c"] and kept.columns == ["units", "a", "d"]


def test_stationarity_tells_noise_from_walks(spark):
    """Noise is stationary; of forty random walks about one in twenty is taken for it."""
    rng = np.random.default_rng(11)
    days = pd.date_range("2020-01-01", periods=300).date
    columns = {1: rng.normal(size=300), 3: np.ones(300)} | {k: np.cumsum(rng.normal(size=300)) for k in range(10, 50)}
    pdf = pd.concat([pd.DataFrame({"station_nbr": k, "date": days, "v": v}) for k, v in columns.items()])
    got = {r["station_nbr"]: r for r in U.stationarity(frame(spark, pdf, "station_nbr int, date date, v double"), ["v"]).collect()}
    assert got[1]["stationary"] and got[1]["pvalue"] < 1e-6
    assert sum(got[k]["stationary"] for k in range(10, 50)) <= 6
    assert got[3]["statistic"] is None
    # Critical values for long samples tend to the published limits.
    assert got[1]["crit_5"] == pytest.approx(-2.87, abs=0.01)
    assert U.adf_pvalue(-2.86154) == pytest.approx(0.05, abs=0.001)


def test_chi2_equals_hand_computation(spark):
    df = spark.createDataFrame([("p", 1.0), ("p", 3.0), ("q", 8.0), ("q", 0.0)], "y string, x double")
    # Observed 4 and 8, expected 6 and 6.
    assert Sc.chi2_scores(df, ["x"], "y").first()["chi2"] == pytest.approx(4 / 6 + 4 / 6)


def test_tree_importances_find_the_driver(spark):
    rng = np.random.default_rng(12)
    pdf = pd.DataFrame(rng.normal(size=(300, 3)), columns=list("abc"))
    pdf["y"] = (pdf.b > 0) * 10.0
    df = frame(spark, pdf, "a double, b double, c double, y double")
    assert Sc.importances(df, list("abc"), "y", trees=5).first()["feature"] == "b"
    assert Sc.importances(df, list("abc"), "y", trees=1).first()["importance"] > 0.9
    ranks = {r["feature"]: r["rank"] for r in Sc.eliminate_features(df.withColumn("z", (F.col("b") > 0).cast("int")), list("abc"), "z", 1).collect()}
    assert ranks["b"] == 1 and sorted(ranks.values()) == [1, 2, 3]


def test_zero_actuals(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 5.0), (1, 1, 10.0, 5.0)], "store_nbr int, item_nbr int, y double, yhat double")
    got = E.mape_by(df).first()
    assert got["mape"] == 50.0 and got["zero_actuals"] == 1
    assert E.score(df.where("y = 0")).first()["wape"] is None


def test_unknown_series_is_predicted_zero(spark):
    requests = spark.createDataFrame([(dt.date(2020, 1, 1), 1, 1), (dt.date(2020, 1, 1), 2, 9)], "date date, store_nbr int, item_nbr int")
    models = spark.createDataFrame([(1, 1, math.log1p(7.0))], "store_nbr int, item_nbr int, yhat double")
    got = {r["id"]: r["units"] for r in Fc.scored_requests(requests, models).collect()}
    assert got["2_9_2020-01-01"] == 0.0 and got["1_1_2020-01-01"] == pytest.approx(7.0)


def test_sampled_contributions_sum_to_the_prediction_gap(spark):
    """For a linear model the sampled values of a single background row are exact."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rng = np.random.default_rng(13)
    pdf = pd.DataFrame(rng.normal(size=(60, 3)), columns=list("abc"))
    pdf["row_id"] = [f"r{i}" for i in range(60)]
    pdf["y"] = 1 + 2 * pdf.a - 3 * pdf.b + 0.5 * pdf.c
    df = frame(spark, pdf[["row_id", "a", "b", "c", "y"]], "row_id string, a double, b double, c double, y double")
    stages = [VectorAssembler(inputCols=list("abc"), outputCol="features"), LinearRegression(labelCol="y", predictionCol="yhat")]
    model = Pipeline(stages=stages).fit(df)
    base = df.where("row_id = 'r0'")
    phi = At.sampled_contributions(model, df, base, list("abc"), permutations=3)
    origin = pdf.iloc[0]
    slopes = {"a": 2.0, "b": -3.0, "c": 0.5}
    for r in phi.collect():
        x = pdf[pdf.row_id == r["row_id"]].iloc[0][r["feature"]]
        assert r["value"] == pytest.approx(x)
        assert r["phi"] == pytest.approx(slopes[r["feature"]] * (x - origin[r["feature"]]), abs=1e-6)
    assert phi.count() == 180
    # With a background of many rows the sums still meet the prediction less the common mean.
    mean = model.transform(df).agg({"yhat": "avg"}).first()[0]
    sums = {r["row_id"]: r["s"] for r in At.sampled_contributions(model, df, df, list("abc")).groupBy("row_id").agg(F.sum("phi").alias("s")).collect()}
    for r in model.transform(df).collect():
        assert sums[r["row_id"]] == pytest.approx(r["yhat"] - mean, abs=1e-9)


def test_sampled_contributions_near_exact_shapley_values(spark):
    """A feature that the model never uses gets 0; the others come near the values over all orders."""
    from itertools import permutations

    from pyspark.ml.feature import SQLTransformer

    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.normal(size=(48, 4)), columns=list("abcd"))
    pdf.insert(0, "row_id", [f"r{i}" for i in range(48)])
    df = frame(spark, pdf, "row_id string, a double, b double, c double, d double")
    model = SQLTransformer(statement="SELECT *, a * b + exp(c / 2) * a AS yhat FROM __THIS__")
    f = lambda x: x[:, 0] * x[:, 1] + np.exp(x[:, 2] / 2) * x[:, 0]
    rows, base = pdf.iloc[:8], pdf.iloc[8:, 1:].to_numpy()
    asked = df.where(F.col("row_id").isin(list(rows.row_id)))
    got = At.sampled_contributions(model, asked, df.join(asked, "row_id", "left_anti"), list("abcd")).collect()
    got = {(r["row_id"], r["feature"]): r["phi"] for r in got}
    assert len(got) == 32
    errors, sizes = [], []
    for _, row in rows.iterrows():
        x, exact = row[list("abcd")].to_numpy(float), np.zeros(4)
        for order in permutations(range(4)):
            z, at = base.copy(), f(base)
            for i in order:
                z[:, i] = x[i]
                exact[i] += (f(z) - at).mean() / 24
                at = f(z)
        mine = np.array([got[row.row_id, c] for c in "abcd"])
        assert abs(mine[3]) < 1e-12 and mine.sum() == pytest.approx(f(x[None])[0] - f(base).mean())
        errors.append(np.abs(mine - exact).max())
        sizes.append(np.abs(exact).max())
    assert np.mean(errors) < 0.1 * np.mean(sizes)


def test_condition_number_of_a_collinear_design_is_undefined():
    x = np.random.default_rng(4).normal(size=(50, 2))
    good = np.column_stack([np.ones(50), x])
    bad = np.column_stack([good, x[:, 0] + x[:, 1]])
    assert stats.condition_number((good.T @ good)[None])[0] == pytest.approx(np.linalg.cond(good))
    assert np.isnan(stats.condition_number((bad.T @ bad)[None])[0])


@pytest.mark.parametrize("boosting", [False, True])
def test_tree_contributions_equal_those_of_the_transformed_mixtures(spark, boosting):
    """Bit sets of leaves give what the model itself predicts, in as many tasks as there are cores, however few the rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    rng = np.random.default_rng(17)
    pdf = pd.DataFrame(rng.integers(0, 9, size=(300, 4)).astype(float), columns=list("abcd"))
    pdf.insert(0, "row_id", [f"r{i}" for i in range(300)])
    pdf["y"] = pdf.a * pdf.b + np.sin(pdf.c)
    df = frame(spark, pdf, "row_id string, a double, b double, c double, d double, y double")
    options = {"labelCol": "y", "predictionCol": "yhat", "seed": 3}
    learner = GBTRegressor(maxIter=6, maxDepth=6, **options) if boosting else RandomForestRegressor(numTrees=7, maxDepth=4, **options)
    # The model's own order of features differs from the one asked for, and one of them is not in the model.
    model = Pipeline(stages=[VectorAssembler(inputCols=["c", "a", "b"], outputCol="features"), learner]).fit(df)
    asked, base = df.limit(12), df.where("row_id > 'r28'").limit(5)
    for permutations in (1, 3):
        fast = At.sampled_contributions(model, asked, base, list("abcd"), permutations=permutations)
        slow = At._mixed_contributions(model, asked, base, list("abcd"), permutations, "row_id", 42, "yhat")
        fast, slow = ({(r["row_id"], r["feature"]): (r["value"], r["phi"]) for r in x.collect()} for x in (fast, slow))
        assert len(fast) == 48 and fast.keys() == slow.keys()
        assert all(fast[k] == pytest.approx(slow[k], abs=1e-9) for k in slow)
        assert all(v[1] == 0 for k, v in fast.items() if k[1] == "d")
    assert At.sampled_contributions(model, asked, base, list("abcd")).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism

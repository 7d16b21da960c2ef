"""Feature screening: collinearity, variance analysis, regression rankings, tree importances, stationarity."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandloom.functions import stats
from demandloom.operators import aggregates as A
from demandloom.operators import gram as G
from demandloom.operators.quantiles import long_columns
from demandloom.schema import numeric_columns


def collinear_columns(df: DataFrame, threshold: float = 0.95, protect: Sequence[str] = ()) -> list[str]:
    """Numeric columns too close to any earlier one, an already dropped one included. Collects one p × p matrix."""
    columns = numeric_columns(df, exclude=protect)
    close = A.correlations(df, columns).where(F.abs("corr") > threshold).select("b").distinct()
    late = {row["b"] for row in close.collect()}
    return [c for c in columns if c in late]


def drop_collinear(df: DataFrame, threshold: float = 0.95, protect: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    dropped = collinear_columns(df, threshold, protect)
    return df.drop(*dropped), dropped


@F.pandas_udf(T.DoubleType())
def _f_tail(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return pd.Series(stats.f_pvalue(f, df1, df2))


def anova(df: DataFrame, features: Sequence[str], target: Column) -> DataFrame:
    """One-way variance analysis per categorical feature: `feature, f, df_between, df_within, p`.

    Level sums of all features come from one pass over a long table; the rest works on one row per level.
    """
    entries = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("level")) for c in features]
    tall = df.select(target.cast("double").alias("_y"), F.inline(F.array(*entries))).where(
        F.col("_y").isNotNull() & F.col("level").isNotNull()
    )
    levels = tall.groupBy("feature", "level").agg(
        F.count("*").alias("n"), F.sum("_y").alias("s"), F.sum(F.col("_y") * F.col("_y")).alias("q")
    )
    explained = F.sum(F.col("s") * F.col("s") / F.col("n")) - F.sum("s") * F.sum("s") / F.sum("n")
    within = F.sum("q") - F.sum(F.col("s") * F.col("s") / F.col("n"))
    sums = levels.groupBy("feature").agg(
        explained.alias("between"), within.alias("within"), (F.count("*") - 1).alias("df_between"), (F.sum("n") - F.count("*")).alias("df_within")
    )
    ratio = F.try_divide(F.col("between") / F.nullif(F.col("df_between"), F.lit(0)), F.try_divide("within", "df_within"))
    return sums.withColumn("f", ratio).select(
        "feature", "f", "df_between", "df_within", F.when(F.col("f").isNotNull(), _f_tail("f", "df_between", "df_within")).alias("p")
    )


def significant_features(table: DataFrame, level: float = 0.05) -> DataFrame:
    return table.where(F.col("p") < level).orderBy("p", "feature")


def univariate_ranking(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Adjusted R² of the target on each feature alone, best first."""
    one = df.agg(*[F.struct(F.regr_r2(target, c).alias("r2"), F.regr_count(target, c).alias("n")).alias(c) for c in features])
    entries = [F.struct(F.lit(c).alias("feature"), F.col(f"{c}.r2").alias("r2"), F.col(f"{c}.n").alias("n")) for c in features]
    tall = one.select(F.inline(F.array(*entries)))
    adjusted = 1 - (1 - F.col("r2")) * F.try_divide(F.col("n") - 1, F.col("n") - 2)
    return tall.withColumn("r2_adj", adjusted).orderBy(F.desc_nulls_last("r2_adj"), "feature")


def power_terms(features: Sequence[str], powers: int = 3) -> dict[str, Column]:
    return {f"{c}^{k}" if k > 1 else c: F.pow(F.col(c).cast("double"), F.lit(k)) for c in features for k in range(1, powers + 1)}


def subset_search(df: DataFrame, target: Column, terms: Mapping[str, Column], least: int = 2, most: int = 5) -> DataFrame:
    """Every subset of `least` to `most` terms as a regression, best adjusted R² first, with its condition number.

    One pass over the data sums the products of all terms; each subset is a sub-matrix of them.
    """
    names = list(terms)
    sums = G.gram(df, terms, target).select(F.struct("n", "xx", "xy", "yy")).scalar()
    masks = df.sparkSession.range(1 << len(names)).where(F.bit_count("id").between(least, most)).select(F.col("id").alias("mask"))
    fits = masks.withColumn("g", sums).withColumn("fit", G.solve_subset("g.n", "g.xx", "g.xy", "g.yy", "mask"))
    flags = [F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, F.lit(t)) for i, t in enumerate(names)]
    chosen = F.array_join(F.array_compact(F.array(*flags)), " + ")
    return fits.select(
        chosen.alias("terms"), F.col("fit.kept").alias("size"), F.col("fit.r2_adj").alias("r2_adj"), F.col("fit.condition").alias("condition_number")
    ).orderBy(F.desc_nulls_last("r2_adj"), "terms")


def polynomial_fits(df: DataFrame, x: Column, y: Column, degrees: Sequence[int] = (1, 2, 3), keys: Sequence[str] = ()) -> DataFrame:
    """`keys, degree, coef, rmse`: trend polynomials of several degrees from one set of power sums."""
    top = max(degrees)
    sums = G.gram(df, {f"x{k}": F.pow(x, F.lit(k)) for k in range(1, top + 1)}, y, keys)
    tall = sums.withColumn("degree", F.explode(F.array(*map(F.lit, degrees))))
    mask = F.pow(F.lit(2), F.col("degree")).cast("int") - 1
    return tall.withColumn("fit", G.solve_subset("n", "xx", "xy", "yy", mask)).select(
        *keys, "degree", F.col("fit.coef").alias("coef"), F.col("fit.rmse").alias("rmse")
    )


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def importances(df: DataFrame, features: Sequence[str], label: str, *, trees: int = 250, depth: int = 5, seed: int = 0) -> DataFrame:
    """`feature, importance` of a forest (or, with one tree, a single tree), largest first."""
    if trees == 1:
        learner = DecisionTreeRegressor(featuresCol="features", labelCol=label, maxDepth=depth, seed=seed)
    else:
        learner = RandomForestRegressor(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)
    model = learner.fit(_assembled(df, features).select("features", label))
    return importance_table(df.sparkSession, model, features)


def importance_table(spark, model, features: Sequence[str]) -> DataFrame:
    """Built-in importances of a fitted tree model by feature name."""
    rows = [(f, float(v)) for f, v in zip(features, model.featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def eliminate_features(df: DataFrame, features: Sequence[str], label: str, keep: int = 3) -> DataFrame:
    """Recursive elimination: refit a logistic regression without its smallest standardised coefficient until `keep` remain.

    `feature, rank`: 1 for the kept ones, then the reverse order of elimination.
    """
    left, gone = list(features), []
    data = df.select(label, *[F.col(c).cast("double").alias(c) for c in features]).persist()
    while len(left) > keep:
        stages = [
            VectorAssembler(inputCols=left, outputCol="_raw"),
            StandardScaler(inputCol="_raw", outputCol="features", withMean=True),
            LogisticRegression(featuresCol="features", labelCol=label, maxIter=20, standardization=False),
        ]
        weights = np.abs(Pipeline(stages=stages).fit(data).stages[-1].coefficientMatrix.toArray()).sum(axis=0)
        gone.insert(0, left.pop(int(np.argmin(weights))))
    data.unpersist()
    rows = [(c, 1) for c in left] + [(c, i + 2) for i, c in enumerate(gone)]
    return df.sparkSession.createDataFrame(rows, "feature string, rank int")


def chi2_scores(df: DataFrame, features: Sequence[str], label: str, k: int | None = None) -> DataFrame:
    """Chi-square of each non-negative feature's sum per class against the class shares; the `k` best when given."""
    tall = long_columns(df, features, [label])
    cells = tall.groupBy("column", label).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("o"), F.count("*").alias("n"))
    totals = cells.groupBy("column").agg(F.sum("o").alias("all_o"), F.sum("n").alias("all_n"))
    expected = F.col("n") / F.col("all_n") * F.col("all_o")
    gap = F.try_divide((F.col("o") - expected) * (F.col("o") - expected), expected)
    scores = cells.join(totals, "column").groupBy(F.col("column").alias("feature")).agg(F.sum(gap).alias("chi2"))
    ordered = scores.orderBy(F.desc_nulls_last("chi2"), "feature")
    return ordered if k is None else ordered.limit(k)


def principal_components(df: DataFrame, features: Sequence[str], k: int = 3) -> DataFrame:
    """`component, explained_ratio` of the first k components of the centred features."""
    data = _assembled(df.select(*[F.col(c).cast("double").alias(c) for c in features]), features)
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(data)
    rows = [(i + 1, float(v)) for i, v in enumerate(model.explainedVariance.toArray())]
    return df.sparkSession.createDataFrame(rows, "component int, explained_ratio double")

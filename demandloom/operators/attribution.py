"""Per-row feature contributions as one long table `row_id, feature, value, phi`, and roll-ups over it."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandloom.functions import dates as D
from demandloom.functions import scalars as X
from demandloom.functions.trees import MOST_LEAVES, LeafSets
from demandloom.operators.aggregates import with_share
from demandloom.session import scratch_path


def linear_contributions(df: DataFrame, slopes: Mapping[str, float], keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """Exact contributions of a linear model: slope × (value − mean). They sum to prediction minus mean prediction."""
    means = df.select(F.struct(*[F.avg(c).alias(c) for c in slopes])).scalar()
    entries = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(c).cast("double").alias("value"),
            (F.lit(float(b)) * (F.col(c) - F.col("_mean").getField(c))).alias("phi"),
        )
        for c, b in slopes.items()
    ]
    return df.withColumn("_mean", means).select(*keep, F.inline(F.array(*entries)))


def _digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def sample_rows(df: DataFrame, n: int = 500, *, key: str = "row_id", seed: int = 42) -> DataFrame:
    """At most `n` rows by the smallest seeded key hashes: the same rows under any partitioning."""
    return df.withColumn("_h", _digest(F.lit(seed), F.col(key))).orderBy("_h", key).limit(n).drop("_h")


def sample_splits(train: DataFrame, test: DataFrame, n: int = 500, *, key: str = "row_id", seed: int = 42) -> DataFrame:
    return sample_rows(train, n, key=key, seed=seed).unionByName(sample_rows(test, n, key=key, seed=seed))


def _spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt over all cores: each costs thousands of predictions, so few bytes are much work."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)


def _leaf_sets(spark: SparkSession, model: Transformer, features: Sequence[str], output: str) -> LeafSets | None:
    """The trees of an assembler with a forest or boosted trees, by their saved form; None for any other model."""
    stages = model.stages if isinstance(model, PipelineModel) else []
    kinds = (RandomForestRegressionModel, GBTRegressionModel)
    if len(stages) != 2 or not isinstance(stages[0], VectorAssembler) or not isinstance(stages[1], kinds):
        return None
    assembler, trees = stages
    inputs = assembler.getInputCols()
    if not set(inputs) <= set(features) or trees.getPredictionCol() != output or trees.getFeaturesCol() != assembler.getOutputCol():
        return None
    path = scratch_path(spark, "trees")
    trees.write().save(path)
    nodes: list[dict[int, tuple]] = [{} for _ in range(trees.getNumTrees)]
    for tree, node in spark.read.parquet(f"{path}/data").select("treeID", "nodeData").toLocalIterator():
        feature, threshold = -1, 0.0
        if node.leftChild >= 0:
            if node.split.numCategories != -1:
                return None
            feature, threshold = features.index(inputs[node.split.featureIndex]), node.split.leftCategoriesOrThreshold[0]
        nodes[tree][node.id] = (node.prediction, node.leftChild, node.rightChild, feature, threshold)
    if max(sum(n[1] < 0 for n in tree.values()) for tree in nodes) > MOST_LEAVES:
        return None
    shared = trees.getNumTrees if isinstance(trees, RandomForestRegressionModel) else 1.0
    return LeafSets(nodes, [w / shared for w in trees.treeWeights], len(features))


def _tree_contributions(
    trees: LeafSets, rows: DataFrame, background: DataFrame, features: Sequence[str], permutations: int, key: str, seed: int
) -> DataFrame:
    """The sampled contributions of trees. A task gets a row with its draws and needs nothing of other rows."""
    x = F.array(*[F.col(f).cast("double") for f in features])
    met = background.select(F.col(key).cast("string").alias("k"), x.alias("v")).collect()
    halves, n = -(-permutations // 2), len(features)
    hashes = [(F.lit(h).cast("long"), F.lit(i)) for h in range(halves) for i in range(n)]
    drawn = F.transform(F.array(*[F.lit(m.k) for m in met]), lambda k: F.array(*[F.xxhash64(F.lit(seed), F.col(key), k, *h) for h in hashes]))
    asked = _spread(rows.select(key, x.alias("_x")), key).withColumn("_drawn", F.flatten(drawn))
    values = np.array([m.v for m in met], dtype=float)
    if np.isnan(values).any():
        raise ValueError("a feature of the background is missing")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # By row of the background, then by permutation, as the draws are.
        base = np.repeat(trees.open(values), permutations, axis=0)
        for batch in batches:
            given = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            if np.isnan(given).any():
                raise ValueError("a feature is missing")
            draws = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(met), halves, n)
            phi = np.empty_like(given)
            for at in range(len(given)):
                order = np.argsort(draws[at], axis=-1, kind="stable")
                order = np.stack([order, order[..., ::-1]], axis=2).reshape(len(met), 2 * halves, n)[:, :permutations]
                phi[at] = trees.switched(trees.open(given[at : at + 1])[0], base, order.reshape(-1, n))
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(len(given)), n)))
            names = pa.array(list(features) * len(given), pa.string())
            yield pa.RecordBatch.from_arrays([keys, names, pa.array(given.ravel()), pa.array(phi.ravel())], ["key", "feature", "value", "phi"])

    kind = T.StructType([T.StructField("key", rows.schema[key].dataType)])
    kind = kind.add("feature", "string").add("value", "double").add("phi", "double")
    return asked.mapInArrow(run, kind).withColumnRenamed("key", key)


def _mixed_contributions(
    model: Transformer, rows: DataFrame, background: DataFrame, features: Sequence[str], permutations: int, key: str, seed: int, output: str
) -> DataFrame:
    """The sampled contributions of any model, which transforms one row per step of each permutation."""
    names = F.array(*map(F.lit, features))
    x = F.array(*[F.col(f).cast("double") for f in features])
    # The background is a sample of bounded size that goes along with every row.
    base = background.select(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), x.alias("v")))).scalar()
    asked = _spread(rows, key).select(key, x.alias("_x"), F.explode(base).alias("_b"))
    asked = asked.withColumn("_perm", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    draw = [F.struct(F.xxhash64(F.lit(seed), F.col(key), F.col("_b.k"), F.floor(F.col("_perm") / 2), F.lit(i)).alias("h"), F.lit(i).alias("i")) for i in range(len(features))]
    order = F.transform(F.array_sort(F.array(*draw)), lambda e: e["i"])
    order = F.when(F.col("_perm") % 2 == 1, F.reverse(order)).otherwise(order)
    staged = asked.withColumn("_order", order).withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(len(features)))))
    mixed = staged.select(
        key,
        "_x",
        "_order",
        "_step",
        *[
            F.when(F.array_position("_order", F.lit(i)) <= F.col("_step"), F.col("_x")[i]).otherwise(F.col("_b.v")[i]).alias(f)
            for i, f in enumerate(features)
        ],
    )
    # A prediction ends the change of the feature just switched and starts that of the next.
    ends = F.when(F.col("_step") > 0, F.struct(F.get("_order", F.col("_step") - 1).alias("i"), F.col(output).alias("d")))
    starts = F.when(F.col("_step") < len(features), F.struct(F.get("_order", F.col("_step")).alias("i"), (-F.col(output)).alias("d")))
    moved = model.transform(mixed).select(key, "_x", F.inline(F.array_compact(F.array(ends, starts))).alias("_i", "_d"))
    met = background.select(F.count("*")).scalar() * permutations
    phi = moved.groupBy(key, "_i").agg(F.first(F.get("_x", F.col("_i"))).alias("value"), (F.sum("_d") / met).alias("phi"))
    return phi.select(key, F.get(names, F.col("_i")).alias("feature"), "value", "phi")


def sampled_contributions(
    model: Transformer, rows: DataFrame, background: DataFrame, features: Sequence[str], *, permutations: int = 2, key: str = "row_id",
    seed: int = 42, output: str = "yhat",
) -> DataFrame:
    """Shapley values of any fitted model by permutation sampling, from two bounded samples.

    Each row meets every background row `permutations` times, each time along a permutation of its own; every second
    one is the reverse of the one before. Along a permutation the features switch one by one from the background's value
    to the row's; the change of the prediction belongs to the feature switched. As the whole background is met,
    contributions sum to the prediction minus its mean over the background, and a feature the model never uses gets 0.

    Forests and boosted trees with at most 64 leaves a tree are evaluated on bit sets of open leaves, one row at a time
    with all its mixtures; any other model transforms a table of the mixtures. Draws and results are the same.
    """
    trees = _leaf_sets(rows.sparkSession, model, features, output)
    if trees is not None and not background.isEmpty():
        return _tree_contributions(trees, rows, background, features, permutations, key, seed)
    return _mixed_contributions(model, rows, background, features, permutations, key, seed, output)


def global_importance(phi: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature, largest first."""
    return phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("importance")).orderBy(F.desc("importance"), "feature")


def importance_by_type(phi: DataFrame) -> DataFrame:
    """Importance, number of features and share per feature type."""
    typed = global_importance(phi).groupBy(X.feature_type(F.col("feature")).alias("type")).agg(
        F.sum("importance").alias("importance"), F.count("*").alias("features")
    )
    return with_share(typed, "importance", 6).orderBy(F.desc("importance"), "type")


def strength_by_period(phi: DataFrame, period: Column, name: str, row: str = "row_id") -> DataFrame:
    """Mean over rows of the row's mean absolute contribution, per period."""
    per_row = phi.groupBy(row, period.alias(name)).agg(F.avg(F.abs("phi")).alias("strength"))
    return per_row.groupBy(name).agg(F.avg("strength").alias("mean_abs_phi"))


def strength_by_weekday(phi: DataFrame, date: str = "date") -> DataFrame:
    by_day = strength_by_period(phi, D.weekday0(date), "weekday")
    return by_day.withColumn("day_name", F.element_at(F.array(*map(F.lit, D.WEEKDAY_NAMES)), F.col("weekday") + 1))


def weather_effect(phi: DataFrame) -> DataFrame:
    """Mean signed contribution of the weather features, highest first."""
    weather = phi.where(X.feature_type(F.col("feature"), X.FEATURE_TYPE_RULES[1:2]) == "weather")
    return weather.groupBy("feature").agg(F.avg("phi").alias("mean_phi")).orderBy(F.desc("mean_phi"), "feature")


def strongest_factors(phi: DataFrame, n: int = 5, row: str = "row_id") -> DataFrame:
    """Per row the `n` highest and the `n` lowest contributions; `direction` up or down, `place` from 1."""
    high = F.row_number().over(W.partitionBy(row).orderBy(F.desc("phi"), "feature"))
    low = F.row_number().over(W.partitionBy(row).orderBy(F.asc("phi"), "feature"))
    up = phi.withColumn("place", high).where(F.col("place") <= n).withColumn("direction", F.lit("up"))
    down = phi.withColumn("place", low).where(F.col("place") <= n).withColumn("direction", F.lit("down"))
    return up.unionByName(down)


def local_explanations(phi: DataFrame, results: DataFrame, n: int = 5, row: str = "row_id") -> DataFrame:
    """The strongest factors beside the row's actual and predicted value."""
    return results.join(strongest_factors(phi, n, row).select(row, "feature", "value", "phi", "direction", "place"), row)


def dependence(phi: DataFrame, feature: str) -> DataFrame:
    """Value and contribution of one feature."""
    return phi.where(F.col("feature") == feature).select("row_id", "value", "phi")


def binned_dependence(phi: DataFrame, feature: str, width: float) -> DataFrame:
    """Mean contribution by value bin."""
    low = (F.floor(F.col("value") / width) * width).cast("double")
    return dependence(phi, feature).groupBy(low.alias("low")).agg(F.avg("phi").alias("mean_phi"), F.count("*").alias("n"))


def readable_importances(table: DataFrame, n: int = 8) -> DataFrame:
    """The `n` largest importances with names made readable."""
    return table.orderBy(F.desc("importance"), "feature").limit(n).withColumn("label", X.title_text(F.col("feature")))

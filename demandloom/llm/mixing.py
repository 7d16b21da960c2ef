"""Mixing sources to target weights: hash-random order, distributed prefix sums, a cut at each source's budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.llm.common import word_count
from demandloom.session import materialize

#: A source's order is cut into so many hash buckets, so that no window holds a whole source.
PREFIX = 3


def random_key(doc_id: Column, seed: str) -> Column:
    """Hash-random hex key of a document."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def sizes(docs: DataFrame, seed: str) -> DataFrame:
    """Slim table of documents: id, source (null told apart from empty), number of words and random key."""
    return docs.select(
        F.col("doc_id"),
        F.coalesce("source", F.lit("")).alias("_source"),
        F.col("source").isNull().alias("_unnamed"),
        word_count(F.col("text")).alias("size"),
        random_key(F.col("doc_id"), seed).alias("_key"),
    )


def targets(sized: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """One row per source: size, weight and target.

    Targets are weight times one level, stopped at `cap` times the source's size, and sum to `share` of all sizes. The
    level follows from sums over the sources in the order in which they reach their stop.
    """
    sources = sized.groupBy("_source", "_unnamed").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy("_unnamed", "_source")
    turn = (F.row_number().over(order) - 1) % len(weights) + 1
    sources = sources.withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int")))
    sources = sources.withColumn("_cap", cap * F.col("source_size"))
    total = F.sum("source_size").over(Window.partitionBy()) * share
    stops = Window.orderBy(F.col("_cap") / F.col("_weight"), "_unnamed", "_source").rowsBetween(Window.unboundedPreceding, -1)
    left = total - F.coalesce(F.sum("_cap").over(stops), F.lit(0.0))
    weight_left = F.sum("_weight").over(Window.partitionBy()) - F.coalesce(F.sum("_weight").over(stops), F.lit(0.0))
    sources = sources.withColumn("_level", left / weight_left)
    open_level = F.min(F.when(F.col("_cap") >= F.col("_weight") * F.col("_level"), F.struct("_stop", "_level")))
    sources = sources.withColumn("_stop", F.col("_cap") / F.col("_weight"))
    level = open_level.over(Window.partitionBy())["_level"]
    goal = F.coalesce(F.least(F.col("_weight") * level, F.col("_cap")), F.col("_cap"))
    sources = sources.withColumn("target", goal)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    return sources.withColumn("_epochs", epochs.cast("long")).withColumn(
        "_rest", F.floor(F.col("target")).cast("long") - F.col("_epochs") * F.col("source_size")
    )


def mix(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), *, share: float = 1.5, cap: float = 2.0, seed: str = "mix"
) -> DataFrame:
    """Decide how many words of each document the mix takes, repeats counted.

    Returns one row per document: doc_id, source, size, source_size, target, `taken`, and `copies`, the number of times
    to write the whole document (a document cut by the budget is written when at least half of it is wanted).

    Sources are ordered by code point, null last, and take the weights in turn. A source's documents are put in
    hash-random order; whole epochs are taken first, then the documents whose prefix sum stays within the rest of the
    budget, the one at the cut in part, so that a source's taken words are its target rounded down. Documents without
    words, null texts and sources without words take nothing. Rows with the same doc_id are documents of their own;
    a null doc_id takes the key of the empty string. Columns other than doc_id, text and source are not read.
    """
    sized = materialize(sizes(docs, seed), "mix-sizes")
    goals = materialize(targets(sized, weights, share, cap), "mix-targets")
    bucketed = sized.withColumn("_bucket", F.substring("_key", 1, PREFIX))
    of_source = ["_source", "_unnamed"]
    earlier = Window.partitionBy(*of_source).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        bucketed.groupBy(*of_source, "_bucket")
        .agg(F.sum("size").alias("_sum"))
        .select(*of_source, "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    )
    inside = Window.partitionBy(*of_source, "_bucket").orderBy("_key", "doc_id", "size")
    reached = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rest = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - (F.col("_reached") - F.col("size"))))
    placed = bucketed.join(bases, [*of_source, "_bucket"]).withColumn("_reached", F.col("_base") + reached)
    return (
        placed.join(goals.select(*of_source, "source_size", "target", "_epochs", "_rest"), of_source)
        .withColumn("taken", F.col("_epochs") * F.col("size") + rest)
        .select(
            "doc_id",
            F.when(~F.col("_unnamed"), F.col("_source")).alias("source"),
            "size",
            "source_size",
            "target",
            "taken",
            F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.lit(0)).cast("int").alias("copies"),
        )
    )


def write_out(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The mixed corpus: every document as often as the plan says, with the columns it came with.

    Ids are taken as unique here; where the plan lists an id more than once, its largest number of copies holds.
    """
    wanted = plan.where("copies > 0").groupBy(F.col("doc_id").alias("id")).agg(F.max("copies").alias("times"))
    # One column holds the whole row, so that no column of it can clash.
    rows = docs.select(F.struct("*").alias("row"))
    joined = rows.join(wanted, F.col("row.doc_id").eqNullSafe(F.col("id")))
    return joined.select(F.inline(F.array_repeat("row", F.col("times"))))

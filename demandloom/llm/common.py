"""Helpers shared by the corpus operators: word splitting, prefix sums and neighbours in a global order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space as every operator here understands it: space and tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]+"
#: A 64-bit id is cut into digits of so many bits; a window over one digit holds at most 2^16 distinct ids.
DIGIT = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{BLANKS}|{BLANKS}$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, BLANKS))).cast("long")


def before(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """One row per distinct `key` with the sum of `value` over all smaller keys, for keys of any spread.

    Sums go up a tree whose nodes are ids without their last 16 bits, and the offsets come down again. A window holds
    the children of one node, so it never has more than 65,536 rows, whatever the number of keys. No key is null.
    """
    levels = [df.groupBy(F.col(key).alias("_k")).agg(F.sum(value).alias("_v"))]
    while len(levels) < 4:
        up = F.shiftright("_k", DIGIT).alias("_k")
        levels.append(levels[-1].groupBy(up).agg(F.sum("_v").alias("_v")))
    above = None
    for level in reversed(levels):
        level = level.withColumn("_up", F.shiftright("_k", DIGIT))
        rows = Window.partitionBy("_up").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
        inside = F.coalesce(F.sum("_v").over(rows), F.lit(0))
        if above is None:  # the ids without 48 bits: at most 65,536 nodes
            whole = Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
            above = level.select("_k", F.coalesce(F.sum("_v").over(whole), F.lit(0)).alias("_at"))
            continue
        parents = above.select(F.col("_k").alias("_up"), F.col("_at").alias("_base"))
        above = level.join(parents, "_up").select("_k", (F.col("_base") + inside).alias("_at"))
    return above.select(F.col("_k").alias(key), F.col("_at").alias(out))


def key_above(df: DataFrame, key: str, out: str) -> DataFrame:
    """One row per distinct `key` with the next larger key; null at the largest. Bounded windows, as in `before`."""
    levels = [df.select(F.col(key).alias("_k")).distinct()]
    while len(levels) < 4:
        levels.append(levels[-1].select(F.shiftright("_k", DIGIT).alias("_k")).distinct())
    found = None
    for depth, level in reversed(list(enumerate(levels))):
        node = level.withColumn("_up", F.shiftright("_k", DIGIT))
        siblings = Window.partitionBy("_up").orderBy("_k")
        if found is None:
            found = node.select("_k", F.lead("_k").over(Window.orderBy("_k")).alias("_next"))
            continue
        # The last child's successor is the smallest child of its parent's successor.
        least = node.groupBy("_up").agg(F.min("_k").alias("_least"))
        cousins = found.join(least.withColumnRenamed("_up", "_next"), "_next", "left").select(
            F.col("_k").alias("_up"), F.col("_least").alias("_cousin")
        )
        found = node.join(cousins, "_up").select(
            "_k", F.coalesce(F.lead("_k").over(siblings), F.col("_cousin")).alias("_next")
        )
    return found.select(F.col("_k").alias(key), F.col("_next").alias(out))

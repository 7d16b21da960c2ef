"""Exact interpolated quantiles without holding a column's values in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandloom.session import materialize

BINS = 256


def _with_bin(df: DataFrame, splitters: str, value: str, name: str) -> DataFrame:
    """Number of splitters below a value, by halving: one comparison per bit, each its own projection in generated code."""
    df = df.withColumn(name, F.lit(0))
    step = BINS // 2
    while step:
        above = F.get(F.col(splitters), F.col(name) + (step - 1)) < F.col(value)
        df = df.withColumn(name, F.when(above, F.col(name) + step).otherwise(F.col(name)))
        step //= 2
    return df


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), *, prefix: str = "q"
) -> DataFrame:
    """Linear-interpolated quantiles of `value` per group as columns `q0, q1, …` plus the non-NULL count `n`.

    Sketches of the values, combined map-side, cut each group into bins; bin counts, combined map-side as well, tell
    which bins hold a wanted position. Only their values are shuffled and ranked, equal ones as one row: about two bins
    of 256 per quantile, exact for any distribution, and no task sorts more than one bin of a group.
    """
    # Structs compare their NULL fields as equal, so one struct key joins NULL groups like any other.
    key = F.struct(*[F.col(k) for k in by], F.lit(0).alias("_all"))
    known = df.where(F.col(value).isNotNull()).select(key.alias("_k"), F.col(value).cast("double").alias("_v"))
    known = materialize(known, "quantile-values")
    cuts = [i / BINS for i in range(1, BINS)]
    splitters = known.groupBy("_k").agg(F.percentile_approx("_v", cuts, F.lit(10000)).alias("_s"))
    splitters = materialize(splitters, "quantile-splitters")
    binned = _with_bin(known.join(splitters, "_k"), "_s", "_v", "_b").drop("_s")

    # At most BINS rows per group reach these windows.
    order = W.partitionBy("_k").orderBy("_b")
    offsets = binned.groupBy("_k", "_b").agg(F.count("*").alias("_bn")).select(
        "_k",
        "_b",
        "_bn",
        (F.sum("_bn").over(order) - F.col("_bn")).alias("_before"),
        F.sum("_bn").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_total"),
    )
    wanted = F.lit(False)
    for p in probs:
        position = (F.col("_total") - 1) * F.lit(float(p))
        for at in (F.floor(position), F.ceil(position)):
            wanted = wanted | ((F.col("_before") <= at) & (at < F.col("_before") + F.col("_bn")))
    held = materialize(offsets.where(wanted).drop("_bn"), "quantile-bins")
    counts = binned.join(held.select("_k", "_b"), ["_k", "_b"], "left_semi").groupBy("_k", "_b", "_v").agg(F.count("*").alias("_n"))
    running = counts.withColumn("_run", F.sum("_n").over(W.partitionBy("_k", "_b").orderBy("_v")))
    ranked = running.join(held, ["_k", "_b"]).withColumn("_upto", F.col("_before") + F.col("_run"))

    aggregates = [F.max("_total").alias("n")]
    for i, p in enumerate(probs):
        position = (F.col("_total") - 1) * F.lit(float(p))
        aggregates += [
            F.min(F.when(F.col("_upto") > F.floor(position), F.col("_v"))).alias(f"_lo{i}"),
            F.min(F.when(F.col("_upto") > F.ceil(position), F.col("_v"))).alias(f"_hi{i}"),
        ]
    found = ranked.groupBy("_k").agg(*aggregates)
    rest = lambda p: (F.col("n") - 1) * F.lit(float(p)) - F.floor((F.col("n") - 1) * F.lit(float(p)))
    return found.select(
        *[F.col("_k").getField(k).alias(k) for k in by],
        "n",
        *[
            (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * rest(p)).alias(f"{prefix}{i}")
            for i, p in enumerate(probs)
        ],
    )


def long_columns(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """`keys, column, value`: one row per row and column, values as DOUBLE."""
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(keys), list(columns), "column", "value"
    )

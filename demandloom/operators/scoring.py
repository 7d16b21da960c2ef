"""Scoring requests for days to come: history features, a fitted model, inverse transform and the submission file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandloom import PAIR
from demandloom.functions import scalars as X
from demandloom.operators import windows as Wn
from demandloom.session import scratch_path
from demandloom.sources import files

SUBMISSION = "id string, units double"


def known_means(
    df: DataFrame, value: str, sizes: Sequence[int] = (1, 7, 28), *, keys: Sequence[str] = PAIR, date: str = "date", prefix: str = "known"
) -> DataFrame:
    """`known_n`: mean of the last n known values before each row, from the first value on.

    Frames count known values, not rows: a request several days ahead sees the last n days of history, like the first
    one, and never another request.
    """
    before = F.count(value).over(Wn.series(keys, date).rowsBetween(W.unboundedPreceding, -1))
    order = W.partitionBy(*keys).orderBy("_before")
    means = {f"{prefix}_{n}": F.avg(value).over(order.rangeBetween(-n, -1)) for n in sizes}
    return df.withColumn("_before", before).withColumns(means).drop("_before")


def demand_of_logs(requests: DataFrame, yhat: Column, modelled: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """`units` from forecasts on the log scale, floored at 0; series outside `modelled` and unknown forecasts get 0."""
    known = requests.join(modelled.select(*keys, F.lit(True).alias("_known")), list(keys), "left")
    return known.withColumn("units", X.unlog_floor(F.when(F.col("_known"), F.coalesce(yhat, F.lit(0.0))).otherwise(0.0))).drop("_known")


def submit(scored: DataFrame) -> DataFrame:
    """Write the submission to a fresh folder, range-sorted by day, store and item, and read the files back."""
    spark = scored.sparkSession
    path = scratch_path(spark, "submission")
    files.write_submission(scored.select("date", *PAIR, "units"), path)
    return spark.read.schema(SUBMISSION).option("header", True).csv(path)

"""Imputation and outlier repair. Order-dependent steps run inside one series, which is at most a calendar long."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandloom import PAIR
from demandloom.functions import scalars as X
from demandloom.operators.quantiles import exact_quantiles, long_columns


def clean_weather(df: DataFrame, columns: Sequence[str], *, trace_value: float = 0.01, trim: bool = True) -> DataFrame:
    """Numeric readings from marked text."""
    return df.withColumns({c: X.sentinel_number(F.col(c), trace_value=trace_value, trim=trim) for c in columns})


def fill_global_mean(df: DataFrame, value: str = "units") -> DataFrame:
    mean = df.select(F.avg(value)).scalar()
    return df.withColumn(value, F.coalesce(F.col(value), mean))


def fill_group_mean(df: DataFrame, value: str = "units", keys: Sequence[str] = PAIR) -> DataFrame:
    """Mean of the series; an all-NULL series stays NULL. The series window shares its exchange with other series steps."""
    return df.withColumn(value, F.coalesce(F.col(value), F.avg(value).over(W.partitionBy(*keys))))


def fill_station_then_global(df: DataFrame, columns: Sequence[str], key: str = "station_nbr") -> DataFrame:
    """Station mean first; what a dead sensor leaves open takes the mean of the once-filled column."""
    staged = df.withColumns({c: F.coalesce(F.col(c), F.avg(c).over(W.partitionBy(key))) for c in columns})
    means = staged.select(F.struct(*[F.avg(c).alias(c) for c in columns])).scalar()
    return staged.withColumns({c: F.coalesce(F.col(c), means.getField(c)) for c in columns})


def carry(df: DataFrame, columns: Sequence[str], keys: Sequence[str], date: str = "date", *, back: bool = False) -> DataFrame:
    """Last known value carried forward (or, with `back`, next known value carried backward)."""
    order = F.col(date).desc() if back else F.col(date).asc()
    frame = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(frame) for c in columns})


def fill_mean_then_carry(
    df: DataFrame, mean_columns: Sequence[str], carry_columns: Sequence[str], keys: Sequence[str], date: str = "date"
) -> DataFrame:
    """Global mean for some columns, then forward and backward carry of the others."""
    for column in mean_columns:
        df = fill_global_mean(df, column)
    return carry(carry(df, carry_columns, keys, date), carry_columns, keys, date, back=True)


def interpolate(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = PAIR, date: str = "date") -> DataFrame:
    """Linear by row position between known values; the tail carries the last one, the head stays NULL.

    Both neighbours come from running frames (ascending and descending), so a series costs linear time.
    """
    up = W.partitionBy(*keys).orderBy(F.col(date).asc())
    down = W.partitionBy(*keys).orderBy(F.col(date).desc())
    back, ahead = up.rowsBetween(W.unboundedPreceding, 0), down.rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("_row", F.row_number().over(up))
    for c in columns:
        point = F.when(F.col(c).isNotNull(), F.struct(F.col("_row").alias("r"), F.col(c).alias("v")))
        df = df.withColumns(
            {"_p": F.last(point, ignorenulls=True).over(back), "_q": F.last(point, ignorenulls=True).over(ahead)}
        )
        slope = (F.col("_q.v") - F.col("_p.v")) / F.nullif(F.col("_q.r") - F.col("_p.r"), F.lit(0))
        filled = F.when(F.col("_q").isNull(), F.col("_p.v")).otherwise(
            F.col("_p.v") + slope * (F.col("_row") - F.col("_p.r"))
        )
        df = df.withColumn(c, F.coalesce(F.col(c), filled)).drop("_p", "_q")
    return df.drop("_row")


def missing_points(df: DataFrame, value: str = "units", keys: Sequence[str] = PAIR, date: str = "date") -> DataFrame:
    """Rows whose target was missing, with the carried-forward value to plot them at."""
    marked = df.withColumn("carried", F.col(value))
    return carry(marked, ["carried"], keys, date).where(F.col(value).isNull()).select(*keys, date, "carried")


def peer_means(df: DataFrame, columns: Sequence[str], donors: Column, date: str = "date") -> DataFrame:
    """Daily mean over the donor stations, columns prefixed `peer_`."""
    return df.where(donors).groupBy(date).agg(*[F.avg(c).alias(f"peer_{c}") for c in columns])


def peer_fill(df: DataFrame, columns: Sequence[str], donors: Column, targets: Column | None = None, date: str = "date") -> DataFrame:
    """Missing readings of the target stations take the same day's donor mean."""
    chosen = F.lit(True) if targets is None else targets
    joined = df.join(peer_means(df, columns, donors, date), date, "left")
    filled = {c: F.when(chosen, F.coalesce(F.col(c), F.col(f"peer_{c}"))).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(filled).select(*df.columns)


def peer_replace(df: DataFrame, column: str, target: Column, donors: Column, date: str = "date") -> DataFrame:
    """A broken sensor's whole column takes the donor mean."""
    joined = df.join(peer_means(df, [column], donors, date), date, "left")
    return joined.withColumn(column, F.when(target, F.col(f"peer_{column}")).otherwise(F.col(column))).select(*df.columns)


def flatten_outliers(df: DataFrame, value: str = "units", factor: float = 3.0, by: Sequence[str] = ()) -> DataFrame:
    """Values further than `factor` sample deviations from the mean become the mean; statistics are global unless `by`."""
    stats = F.struct(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    if by:
        scaled = df.join(df.groupBy(*by).agg(stats.alias("_z")), list(by), "left").select(*df.columns, "_z")
    else:
        scaled = df.withColumn("_z", df.select(stats).scalar())
    far = F.abs(F.col(value) - F.col("_z.m")) > F.col("_z.s") * factor
    return scaled.withColumn(value, F.when(far, F.col("_z.m")).otherwise(F.col(value))).drop("_z")


def outlier_bounds(df: DataFrame, columns: Sequence[str], method: str = "iqr", factor: float = 3.0) -> DataFrame:
    """`column, low, high`: quartiles ± factor·IQR, or mean ± factor·std."""
    tall = long_columns(df, columns)
    if method == "iqr":
        width = (F.col("q1") - F.col("q0")) * factor
        return exact_quantiles(tall, "value", [0.25, 0.75], ["column"]).select(
            "column", (F.col("q0") - width).alias("low"), (F.col("q1") + width).alias("high")
        )
    if method == "zscore":
        width = F.stddev_samp("value") * factor
        return tall.groupBy("column").agg((F.avg("value") - width).alias("low"), (F.avg("value") + width).alias("high"))
    raise ValueError(f"unknown method {method!r}; use 'iqr' or 'zscore'")


def outlier_report(df: DataFrame, columns: Sequence[str], method: str = "iqr", factor: float = 3.0) -> DataFrame:
    """Bounds and number of values outside them, per column."""
    tall = long_columns(df, columns)
    outside = (F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))
    return (
        tall.join(outlier_bounds(df, columns, method, factor), "column")
        .groupBy("column")
        .agg(F.max("low").alias("low"), F.max("high").alias("high"), F.count_if(outside).alias("outliers"))
    )


def repair_outliers(
    df: DataFrame,
    columns: Sequence[str],
    *,
    method: str = "iqr",
    factor: float = 3.0,
    keys: Sequence[str] = ("station_nbr",),
    date: str = "date",
    fill_missing: bool = True,
) -> DataFrame:
    """Values outside the bounds are interpolated along their station; `fill_missing` treats earlier NULLs alike."""
    bounds = outlier_bounds(df, columns, method, factor).select(
        F.map_from_entries(F.collect_list(F.struct("column", F.struct("low", "high")))).alias("m")
    )
    limits = bounds.scalar()  # one entry per column
    marked = df.withColumns({f"_was_{c}": F.col(c) for c in columns}).withColumn("_limits", limits)
    marked = marked.withColumns(
        {c: F.when(F.col(c).between(F.col("_limits")[c]["low"], F.col("_limits")[c]["high"]), F.col(c)) for c in columns}
    ).drop("_limits")
    filled = interpolate(marked, columns, keys, date)
    if not fill_missing:
        filled = filled.withColumns({c: F.when(F.col(f"_was_{c}").isNotNull(), F.col(c)) for c in columns})
    return filled.select(*df.columns)


def repairable_columns(columns: Sequence[str], sparse: Sequence[str] = ("snowfall", "preciptotal"), indicators: Sequence[str] = ()) -> list[str]:
    """Dense measures only: sparse ones and indicators keep their rare values."""
    return [c for c in columns if c not in set(sparse) | set(indicators)]

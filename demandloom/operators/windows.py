"""Time-series features. `rolling n` counts rows of the series and leaves the current row out unless stated."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandloom import PAIR
from demandloom.functions import scalars as X


def series(keys: Sequence[str] = PAIR, date: str = "date") -> WindowSpec:
    """One series in date order. Every feature built on it shares one exchange and one sort."""
    return W.partitionBy(*keys).orderBy(date)


def lags(df: DataFrame, value: str, steps: Sequence[int], *, keys=PAIR, date="date", prefix: str | None = None) -> DataFrame:
    w, name = series(keys, date), prefix or value
    return df.withColumns({f"{name}_lag_{k}": F.lag(value, k).over(w) for k in steps})


_ROLLING = {"mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp}


def rolling_stats(
    df: DataFrame, value: str, sizes: Sequence[int] = (7, 14, 28), stats: Sequence[str] = ("mean", "min", "max", "std"),
    *, keys=PAIR, date="date", prefix: str | None = None,
) -> DataFrame:
    """Statistics over the previous n rows, from the first value on; `std` of one value is NULL."""
    w, name = series(keys, date), prefix or value
    return df.withColumns(
        {f"{name}_{s}_{n}d": _ROLLING[s](value).over(w.rowsBetween(-n, -1)) for n in sizes for s in stats}
    )


#: Nats of decay after which a value no longer changes a double.
FADED = 40.0


def ewma(
    df: DataFrame, value: str, alphas: Sequence[float] = (0.5, 0.75), *, adjust: bool = False, keys=PAIR, date="date",
    prefix: str | None = None, aliases: Sequence[int] = (),
) -> DataFrame:
    """One column per alpha over the rows before; `aliases` repeats it per window name, as the length has no effect.

    A value's weight falls by 1 − α with every row, missing ones included. Adjusted means divide by the sum of the
    weights; unadjusted ones blend the aged mean, whose weight is 1 before it ages, with the next value. A row inside a
    gap carries the mean of the values before the gap; a row with no earlier value has none.

    Each known value is a step (decay, gain) of a scan. Decays add up along the series and cut it into chunks of 40 nats:
    inside a chunk weights are running sums of growing powers, which stay in range; of the chunk before only the total is
    needed, and what lies further back has faded. No row carries the values before it. The corrections that gaps need
    cost precision; unadjusted means therefore add up the values since the last gap once more, by whole powers of 1 − α,
    and take only what lies before the gap from the scan.
    """
    name, rows = prefix or value, series(keys, date)
    upto = rows.rowsBetween(W.unboundedPreceding, W.currentRow)
    df = df.withColumns({"_x": X.null_if_nan(F.col(value).cast("double")), "_row": F.row_number().over(rows)})
    df = df.withColumn("_at", F.last(F.when(F.col("_x").isNotNull(), F.col("_row")), ignorenulls=True).over(upto))
    df = df.withColumn("_gap", F.when(F.col("_x").isNotNull(), F.col("_at") - F.lag("_at").over(rows)))
    df = df.withColumn("_run", F.col("_at") - F.count("_x").over(upto))
    for i, alpha in enumerate(alphas):
        keep = 1 - alpha
        if keep <= 0:
            df = df.withColumn(f"_mean{i}", F.last("_x", ignorenulls=True).over(upto))
            continue
        fade = -math.log(keep)
        both = F.pow(F.lit(keep), F.col("_gap")) + alpha  # weight of the aged mean plus that of the value
        slower = F.lit(0.0) if adjust else F.coalesce(F.sum(F.log(both)).over(upto), F.lit(0.0))
        df = df.withColumn("_slower", slower)
        df = df.withColumn("_chunk", F.floor((F.col("_at") * fade + F.col("_slower")) / FADED))
        own = W.partitionBy(*keys, "_chunk").orderBy(date).rowsBetween(W.unboundedPreceding, W.currentRow)
        past = W.partitionBy(*keys).orderBy("_chunk").rangeBetween(-1, -1)
        # The first row of a chunk, and of the chunk before, from which its weights grow.
        df = df.withColumns({"_at0": F.min("_at").over(own), "_slower0": F.max("_slower").over(own)})
        grown = F.pow(F.lit(keep), F.col("_at0") - F.col("_at")) * F.exp(F.col("_slower") - F.col("_slower0"))
        gain = F.lit(1.0) if adjust else F.when(F.col("_gap").isNull(), 1.0).otherwise(alpha / both)
        df = df.withColumn("_w", F.when(F.col("_x").isNotNull(), gain * grown))
        df = df.withColumn("_wx", F.col("_w") * F.col("_x"))
        aged = F.pow(F.lit(keep), F.col("_at0") - F.min("_at").over(past)) * F.exp(F.max("_slower").over(past) - F.col("_slower0"))
        total = lambda c: F.sum(c).over(own) + F.coalesce(F.sum(c).over(past) * aged, F.lit(0.0))
        if adjust:
            df = df.withColumn(f"_mean{i}", F.try_divide(total("_wx"), total("_w")))
            continue
        # Unadjusted weights sum to 1 at the last known value. A run has no gap: places and values count up together.
        df = df.withColumn("_scan", total("_wx") / grown).withColumn("_entry", F.lag("_scan").over(rows) * F.pow(F.lit(keep), F.col("_gap")) / both)
        df = df.withColumn("_block", F.floor(F.col("_at") / max(1, int(600 / fade))))
        run = W.partitionBy(*keys, "_run", "_block").orderBy(date).rowsBetween(W.unboundedPreceding, W.currentRow)
        df = df.withColumn("_start", F.min("_at").over(run))
        inside = F.sum(gain * F.pow(F.lit(keep), F.col("_start") - F.col("_at")) * F.col("_x")).over(run)
        entry = F.coalesce(F.first("_entry").over(run), F.lit(0.0))
        df = df.withColumn(f"_mean{i}", (inside + entry) * F.pow(F.lit(keep), F.col("_at") - F.col("_start")))
    df = df.withColumns({f"{name}_ewma_{a}": F.lag(f"_mean{i}").over(rows) for i, a in enumerate(alphas)})
    inner = ("_x", "_row", "_at", "_gap", "_slower", "_chunk", "_at0", "_slower0", "_w", "_wx", "_run", "_scan", "_entry", "_block", "_start")
    df = df.drop(*inner, *[f"_mean{i}" for i in range(len(alphas))])
    return df.withColumns({f"{name}_ewma_{a}_{n}d": F.col(f"`{name}_ewma_{a}`") for a in alphas for n in aliases})


def same_day_context(df: DataFrame, key: str, value: str = "units", date: str = "date") -> DataFrame:
    """Mean and sum of the key's rows of the same day, the current row included (it leaks the target).

    Pre-aggregated and joined back, so that a busy key-day is combined map-side instead of landing in one task.
    """
    name = key.removesuffix("_nbr")
    daily = df.groupBy(key, date).agg(F.avg(value).alias(f"{name}_mean_sameday"), F.sum(value).alias(f"{name}_sum_sameday"))
    return df.join(daily, [key, date], "left")


def row_context(
    df: DataFrame, key: str, tie: str, value: str = "units", size: int = 7, *, date: str = "date", chunk: str = "month"
) -> DataFrame:
    """Sum and mean of the key's previous `size` rows in (date, tie) order.

    A key may hold a large share of all rows, so its rows are cut by calendar chunk. Each chunk receives the last
    `size` rows before it: chunks keep their own last rows, and a window over those short tails (one row per key and
    chunk) hands them on. A chunk has at least one row, so `size` tails always suffice.
    """
    name = key.removesuffix("_nbr")
    rows = df.withColumns({"_chunk": F.trunc(date, chunk), "_own": F.lit(True)})
    newest = F.row_number().over(W.partitionBy(key, "_chunk").orderBy(F.desc(date), F.desc(tie)))
    tails = (
        rows.select(key, "_chunk", date, tie, value)
        .withColumn("_n", newest)
        .where(F.col("_n") <= size)
        .groupBy(key, "_chunk")
        .agg(F.sort_array(F.collect_list(F.struct(date, tie, value))).alias("_tail"))
    )
    earlier = F.flatten(F.collect_list("_tail").over(W.partitionBy(key).orderBy("_chunk").rowsBetween(-size, -1)))
    halo = (
        tails.withColumn("_all", earlier)
        .select(key, "_chunk", F.explode(F.slice("_all", F.greatest(F.size("_all") - size + 1, F.lit(1)), size)).alias("_h"))
        .select(key, "_chunk", "_h.*", F.lit(False).alias("_own"))
    )
    frame = W.partitionBy(key, "_chunk").orderBy(date, tie).rowsBetween(-size, -1)
    return (
        rows.unionByName(halo, allowMissingColumns=True)
        .withColumns({f"{name}_sum_{size}r": F.sum(value).over(frame), f"{name}_mean_{size}r": F.avg(value).over(frame)})
        .where("_own")
        .drop("_own", "_chunk")
    )


def calendar_context(df: DataFrame, key: str, value: str = "units", days: int = 7, *, date: str = "date") -> DataFrame:
    """Sum and mean per row of the key over the `days` calendar days before the current one."""
    name = key.removesuffix("_nbr")
    daily = df.groupBy(key, date).agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
    frame = W.partitionBy(key).orderBy(F.unix_date(date)).rangeBetween(-days, -1)
    context = daily.select(
        key,
        date,
        F.sum("_s").over(frame).alias(f"{name}_sum_{days}d"),
        F.try_divide(F.sum("_s").over(frame), F.sum("_c").over(frame)).alias(f"{name}_mean_{days}d"),
    )
    return df.join(context, [key, date], "left")


def moving_average(df: DataFrame, value: str, size: int = 7, *, keys: Sequence[str] = (), date: str = "date", name: str = "ma7") -> DataFrame:
    """Mean of the last `size` rows, the current one included, NULL until there are so many values."""
    frame = W.partitionBy(*keys).orderBy(date).rowsBetween(-(size - 1), 0)
    return df.withColumn(name, F.when(F.count(value).over(frame) == size, F.avg(value).over(frame)))


def rolling_band(df: DataFrame, columns: Sequence[str], size: int, *, keys: Sequence[str] = ("station_nbr",), date: str = "date") -> DataFrame:
    """Rolling mean and one-deviation band, the current row included."""
    frame = series(keys, date).rowsBetween(-(size - 1), 0)
    added = {}
    for c in columns:
        mean, std = F.avg(c).over(frame), F.stddev_samp(c).over(frame)
        added |= {f"{c}_mean": mean, f"{c}_low": mean - std, f"{c}_high": mean + std}
    return df.withColumns(added)


def test_span_marker(df: DataFrame, value: str = "units", keys: Sequence[str] = PAIR) -> DataFrame:
    """Where the target is missing, the series maximum, so that the span shows on a chart."""
    return df.withColumn("istest", F.when(F.col(value).isNull(), F.max(value).over(W.partitionBy(*keys))))


def lag_correlation(df: DataFrame, value: str, max_lag: int = 12, keys: Sequence[str] = PAIR, date: str = "date") -> DataFrame:
    """`keys, lag, rho`: correlation of a series with itself k rows earlier."""
    w = series(keys, date)
    shifted = df.select(*keys, F.col(value).alias("y"), *[F.lag(value, k).over(w).alias(f"_l{k}") for k in range(1, max_lag + 1)])
    rho = [safe_corr("y", f"_l{k}").alias(f"_r{k}") for k in range(1, max_lag + 1)]
    return _tall(shifted.groupBy(*keys).agg(*rho), keys, "_r", range(1, max_lag + 1), "rho")


def safe_corr(a: str, b: str) -> Column:
    """Pairwise-complete correlation, NULL for a constant side."""
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(x) * F.stddev_pop(y))


def _tall(df: DataFrame, keys: Sequence[str], stem: str, lags_: Sequence[int], name: str) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"{stem}{k}").alias(name)) for k in lags_])
    kept = [c for c in df.columns if not c.startswith(stem)]
    return df.select(*kept, F.inline(entries))


def acf_arrays(df: DataFrame, value: str, max_lag: int, keys: Sequence[str] = PAIR, date: str = "date") -> DataFrame:
    """`keys, n, acf`: autocorrelations of lags 0…max_lag over the non-NULL values (biased denominator)."""
    w = series(keys, date)
    centred = df.where(F.col(value).isNotNull()).select(
        *keys, date, (F.col(value) - F.avg(value).over(W.partitionBy(*keys))).alias("_d")
    )
    shifted = centred.select(*keys, "_d", *[F.lag("_d", k).over(w).alias(f"_l{k}") for k in range(1, max_lag + 1)])
    power = F.sum(F.col("_d") * F.col("_d"))
    # A lag no shorter than the series has no products: its correlation is zero, as in the biased estimate.
    rho = [F.coalesce(F.sum(F.col("_d") * F.col(f"_l{k}")), F.lit(0.0)) for k in range(1, max_lag + 1)]
    sums = shifted.groupBy(*keys).agg(F.count("*").alias("n"), power.alias("_p"), F.array(*rho).alias("_s"))
    ratios = F.transform("_s", lambda s: F.try_divide(s, F.col("_p")))
    return sums.select(*keys, "n", F.concat(F.array(F.lit(1.0)), ratios).alias("acf"))


def acf(df: DataFrame, value: str, max_lag: int = 40, keys: Sequence[str] = PAIR, date: str = "date", confidence: float = 0.95) -> DataFrame:
    """`keys, lag, acf, band`: autocorrelation and its flat confidence band z/√n."""
    z = NormalDist().inv_cdf((1 + confidence) / 2)
    return acf_arrays(df, value, max_lag, keys, date).select(
        *keys, F.posexplode("acf").alias("lag", "acf"), (F.lit(z) / F.sqrt("n")).alias("band")
    )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _partial_from_acf(acfs: pd.Series) -> pd.Series:
    """Durbin recursion for all series of a batch at once; a NULL or singular series gives NULLs."""
    if len(acfs) == 0:
        return pd.Series([], dtype=object)
    r = np.array([np.asarray(a, dtype=float) for a in acfs])
    count, order = r.shape[0], r.shape[1] - 1
    phi, out, variance = np.zeros((count, order + 1)), np.ones((count, order + 1)), np.ones(count)
    with np.errstate(all="ignore"):
        for k in range(1, order + 1):
            new = (r[:, k] - (phi[:, 1:k] * r[:, k - 1 : 0 : -1]).sum(axis=1)) / variance
            phi[:, 1:k] -= new[:, None] * phi[:, k - 1 : 0 : -1]
            phi[:, k] = out[:, k] = new
            variance = variance * (1 - new**2)
    return pd.Series([[None if not np.isfinite(v) else float(v) for v in row] for row in out])


def pacf(df: DataFrame, value: str, max_lag: int = 30, keys: Sequence[str] = PAIR, date: str = "date") -> DataFrame:
    """`keys, n, lag, pacf`: partial autocorrelations (Yule-Walker, biased) of lags 1…max_lag.

    Spark reduces a series to max_lag + 1 numbers; the recursion runs on those, batched. The lags must
    stay below half the series length.
    """
    usable = acf_arrays(df, value, max_lag, keys, date).where(F.floor(F.col("n") / 2) > max_lag)
    return (
        usable.select(*keys, "n", F.posexplode(_partial_from_acf("acf")).alias("lag", "pacf"))
        .where((F.col("lag") > 0) & F.col("pacf").isNotNull())
    )


def significant_lags(
    df: DataFrame, value: str = "units", max_lag: int = 30, keys: Sequence[str] = PAIR, *, date: str = "date",
    confidence: float = 0.95, share: float = 0.3,
) -> DataFrame:
    """Lags whose partial autocorrelation leaves the band z/√n in at least `share` of all series, most frequent first.

    Only series with more than `max_lag` + 10 rows vote; the share counts all series. Columns: lag, series_hit,
    series_total, series_analyzed, mean_n, mean_band (z over the root of the mean length, repeated on each row).
    """
    z = NormalDist().inv_cdf((1 + confidence) / 2)
    long_enough = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    voters = pacf(df, value, max_lag, keys, date).join(long_enough.where(F.col("_rows") > max_lag + 10), list(keys))
    total = long_enough.select(F.count("*")).scalar()
    votes = voters.groupBy("lag").agg(
        F.count_if(F.abs("pacf") > F.lit(z) / F.sqrt("n")).alias("series_hit"),
        F.count("*").alias("series_analyzed"),
        F.avg("n").alias("mean_n"),
    )
    return (
        votes.withColumn("series_total", total)
        .where((F.col("series_hit") > 0) & (F.col("series_hit") >= F.col("series_total") * share))
        .withColumn("mean_band", F.lit(z) / F.sqrt("mean_n"))
        .orderBy(F.desc("series_hit"), "lag")
    )


def rolling_fill(df: DataFrame, value: str = "units", size: int = 7, keys: Sequence[str] = PAIR, date: str = "date") -> DataFrame:
    """Smoothed series: full-window mean, gaps interpolated, ends carried."""
    from demandloom.operators.cleaning import carry, interpolate

    smooth = moving_average(df, value, size, keys=keys, date=date, name="smooth")
    # The tail is carried by the interpolation already; the head takes the first known value.
    return carry(interpolate(smooth, ["smooth"], keys, date), ["smooth"], keys, date, back=True)

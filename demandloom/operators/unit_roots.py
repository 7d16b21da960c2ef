"""Unit-root tests of many series from one pass of summed products.

The regression of a change on the level before it and on its own lags is nested in the number of lags: leading parts of
one factorised product matrix give the residuals of every lag count. Spark sums the products per series and picks the
lags by AIC; Python only factorises p × p arrays, all series of a batch at once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandloom.operators import gram as G
from demandloom.session import materialize

# Published response surfaces of the unit-root test with a constant.
ADF_CRITICAL = {
    "crit_1": (-3.43035, -6.5393, -16.786, -79.433),
    "crit_5": (-2.86154, -2.8903, -4.234, -40.040),
    "crit_10": (-2.56677, -1.5384, -2.809, 0.0),
}
ADF_SMALL_P = (2.1659, 1.4412, 0.038269)
ADF_LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_BOUNDS = (-18.83, -1.61, 2.74)

#: What is left of a term, relative to it, below which it depends on the terms before it.
DEPENDENT = 1e-11


def adf_pvalue(t: float) -> float:
    low, switch, high = ADF_BOUNDS
    if t > high:
        return 1.0
    if t < low:
        return 0.0
    powers = ADF_SMALL_P if t <= switch else ADF_LARGE_P
    z = sum(c * t**i for i, c in enumerate(powers))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def nested_residuals(a: np.ndarray, b: np.ndarray, yy: np.ndarray) -> np.ndarray:
    """Residual sums of squares of the fits on the first 1, 2, … p terms of stacked systems, from one Cholesky factor.

    A term that depends on those before it changes nothing.
    """
    scale = np.sqrt(np.maximum(np.einsum("bii->bi", a), 0))
    scale = np.where(scale > 0, scale, 1.0)
    unit, side = a / scale[:, :, None] / scale[:, None, :], b / scale
    p = b.shape[1]
    factor, turned = np.zeros_like(unit), np.zeros_like(side)
    for j in range(p):
        pivot = unit[:, j, j] - (factor[:, j, :j] ** 2).sum(1)
        free = pivot > DEPENDENT
        root = np.sqrt(np.where(free, pivot, 1.0))
        below = unit[:, j:, j] - np.einsum("bik,bk->bi", factor[:, j:, :j], factor[:, j, :j])
        factor[:, j:, j] = np.where(free[:, None], below / root[:, None], 0.0)
        turned[:, j] = np.where(free, (side[:, j] - (factor[:, j, :j] * turned[:, :j]).sum(1)) / root, 0.0)
    left = yy[:, None] - np.cumsum(turned**2, axis=1)
    return np.where(left > 1e-12 * yy[:, None], left, 0.0)


def _stack(xx: pd.Series, xy: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    b = np.array([np.asarray(v, float) for v in xy])
    return np.array([np.asarray(v, float) for v in xx]).reshape(len(b), b.shape[1], b.shape[1]), b


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def residuals_by_lags(xx: pd.Series, xy: pd.Series, yy: pd.Series) -> pd.Series:
    """Residual sums of squares with 0, 1, 2 … lags; constant and level always in."""
    if len(xx) == 0:
        return pd.Series([], dtype=object)
    return pd.Series(list(nested_residuals(*_stack(xx, xy), yy.to_numpy(float))[:, 1:]))


_RESULT = T.StructType([T.StructField("statistic", T.DoubleType()), T.StructField("pvalue", T.DoubleType()), T.StructField("n", T.LongType())])


@F.pandas_udf(_RESULT)
def level_statistic(n: pd.Series, xx: pd.Series, xy: pd.Series, yy: pd.Series, head: pd.Series, most: pd.Series, lags: pd.Series) -> pd.DataFrame:
    """t value of the level with the chosen lags.

    With fewer lags the regression starts earlier: the products of the rows before the common start are added from the
    series' first values.
    """
    rows = []
    for count, flat, side, square, first, start, k in zip(n, xx, xy, yy, head, most, lags):
        p = int(k) + 2
        b = np.asarray(side, float)
        a = np.asarray(flat, float).reshape(len(b), len(b))[:p, :p].copy()
        b, count = b[:p].copy(), int(count)
        y = np.asarray(first, float)
        change = np.diff(y)
        for r in range(int(k), int(start)):
            x = np.array([1.0, y[r], *change[r - int(k) : r][::-1]])
            a += np.outer(x, x)
            b += x * change[r]
            square, count = square + change[r] ** 2, count + 1
        scale = np.sqrt(np.diagonal(a))
        scale = np.where(scale > 0, scale, 1.0)
        inverse = np.linalg.pinv(a / scale / scale[:, None], rcond=DEPENDENT, hermitian=True) / scale / scale[:, None]
        coef = inverse @ b
        rss = square - coef @ b
        if count <= p or rss <= 1e-12 * square or inverse[1, 1] <= 0:
            rows.append((None, None, None))
            continue
        t = float(coef[1] / math.sqrt(rss / (count - p) * inverse[1, 1]))
        rows.append((t, adf_pvalue(t), count))
    out = pd.DataFrame(rows, columns=["statistic", "pvalue", "n"])
    return out.astype({"statistic": float, "pvalue": float, "n": "Int64"})


def _aic(residual: Column, count: Column, lags: Column) -> Column:
    fitted = count * (F.log(2 * math.pi * residual / count) + 1) + 2 * (lags + 2)
    return F.when(residual > 0, fitted).otherwise(F.lit(float("-inf")))


def stationarity(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("station_nbr",), date: str = "date") -> DataFrame:
    """Augmented Dickey-Fuller test with a constant for every series and column, p < 0.05 called stationary.

    Missing values are left out. Up to 12 (n / 100)^¼ lags are tried on the rows that all of them have, the least AIC
    wins, and the statistic takes every row the chosen lags allow. Series of fewer than four values and constant ones
    keep their row, without figures.
    """
    names = [*keys, "column"]
    tall = df.select(*keys, date, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([*keys, date], list(columns), "column", "y")
    series, whole = W.partitionBy(*names).orderBy(date), W.partitionBy(*names)
    total = F.count("*").over(whole)
    most = F.least(F.ceil(12 * F.pow(total / 100, F.lit(0.25))), F.floor(total / 2) - 2).cast("int")
    rows = tall.where("y IS NOT NULL").select(
        *names, date, "y", (F.row_number().over(series) - 1).alias("r"), (F.lead("y").over(series) - F.col("y")).alias("change"), most.alias("most")
    )
    rows = materialize(rows, "unit-root-rows")
    longest = rows.agg(F.max("most")).first()[0]
    level = rows.withColumns({f"lag_{k}": F.coalesce(F.lag("change", k).over(series), F.lit(0.0)) for k in range(1, max(longest or 0, 0) + 1)})
    terms = {c: F.col(c) for c in ("y", *[c for c in level.columns if c.startswith("lag_")])}
    sums = G.gram(level.where("r >= most AND most >= 0"), terms, F.col("change"), names).withColumnRenamed("n", "rows")
    first = F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= F.col("most"), F.struct("r", "y")))), lambda s: s["y"])
    every = rows.groupBy(*names).agg(F.max("most").alias("most"), (F.min("y") < F.max("y")).alias("varies"), first.alias("head"))
    usable = every.where("varies AND most >= 0").join(sums, names)
    usable = usable.withColumn("_rss", F.slice(residuals_by_lags("xx", "xy", "yy"), 1, F.col("most") + 1))
    usable = usable.withColumn("_aic", F.transform("_rss", lambda s, i: _aic(s, F.col("rows"), i)))
    usable = usable.withColumn("lags", (F.array_position("_aic", F.array_min("_aic")) - 1).cast("int"))
    tested = usable.withColumn("_t", level_statistic("rows", "xx", "xy", "yy", "head", "most", "lags")).select(*names, "lags", "_t.*")
    tested = tested.withColumn("lags", F.when(F.col("statistic").isNotNull(), F.col("lags")))
    limits = {c: sum((F.lit(v) / F.pow("n", F.lit(i)) for i, v in enumerate(surface)), F.lit(0.0)) for c, surface in ADF_CRITICAL.items()}
    return (
        every.select(*names)
        .join(tested, names, "left")
        .select(*names, "statistic", "pvalue", "lags", F.col("n").cast("int").alias("n"), *[v.alias(c) for c, v in limits.items()], (F.col("pvalue") < 0.05).alias("stationary"))
    )

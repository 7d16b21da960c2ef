"""Least squares from sufficient statistics: Spark sums the products per key, a batched solver works on p × p arrays.

One pass over the data with map-side combining; a key's rows are never gathered, so its size does not matter.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandloom.functions import stats

_DOUBLES = T.ArrayType(T.DoubleType())

FIT = T.StructType(
    [
        T.StructField("coef", _DOUBLES),
        T.StructField("pvalue", _DOUBLES),
        T.StructField("r2", T.DoubleType()),
        T.StructField("r2_adj", T.DoubleType()),
        T.StructField("sigma", T.DoubleType()),
        T.StructField("rmse", T.DoubleType()),
        T.StructField("condition", T.DoubleType()),
        T.StructField("kept", T.IntegerType()),
    ]
)


def gram(df: DataFrame, terms: Mapping[str, Column], target: Column, keys: Sequence[str] = ()) -> DataFrame:
    """`keys, n, xx, xy, yy`: products of intercept and terms over the rows where all are known.

    `xx` is the full matrix row by row, the intercept first.
    """
    # One array column with one test on it: a NULL test per term would multiply the optimizer's inferred constraints.
    vector = F.array(F.lit(1.0), *[c.cast("double") for c in terms.values()])
    rows = df.select(*keys, vector.alias("_x"), target.cast("double").alias("_y"))
    rows = rows.where(F.forall("_x", lambda v: v.isNotNull()) & F.col("_y").isNotNull())
    x = [F.col("_x")[i] for i in range(len(terms) + 1)]
    products = {(i, j): F.sum(x[i] * x[j]) for i in range(len(x)) for j in range(i, len(x))}
    matrix = F.array(*[products[min(i, j), max(i, j)] for i in range(len(x)) for j in range(len(x))])
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        matrix.alias("xx"),
        F.array(*[F.sum(a * F.col("_y")) for a in x]).alias("xy"),
        F.sum(F.col("_y") * F.col("_y")).alias("yy"),
    )


def _stack(n: pd.Series, xx: pd.Series, xy: pd.Series, yy: pd.Series):
    b = np.array([np.asarray(v, float) for v in xy])
    p = b.shape[1]
    a = np.array([np.asarray(v, float) for v in xx]).reshape(-1, p, p)
    return n.to_numpy(float), a, b, yy.to_numpy(float)


def _fit(n, a, b, yy) -> dict[str, np.ndarray]:
    """Fits of stacked systems that share one set of terms."""
    coef, inverse, rank = stats.solve_normal(a, b)
    residual = np.maximum(yy - np.einsum("bi,bi->b", coef, b), 0.0)
    total = yy - b[:, 0] ** 2 / n
    free = n - rank
    with np.errstate(all="ignore"):
        sigma2 = np.where(free > 0, residual / free, np.nan)
        r2 = np.where(total > 0, 1 - residual / total, np.nan)
        spread = np.sqrt(sigma2[:, None] * np.einsum("bii->bi", inverse))
        t = np.where(spread > 0, coef / spread, np.nan)
        pvalue = stats.t_pvalue(np.nan_to_num(t), np.maximum(free, 1)[:, None])
        return {
            "coef": coef,
            "pvalue": np.where(np.isnan(t), np.nan, pvalue),
            "r2": r2,
            "r2_adj": np.where(free > 0, 1 - (1 - r2) * (n - 1) / free, np.nan),
            "sigma": np.sqrt(sigma2),
            "rmse": np.sqrt(residual / n),
            "condition": stats.condition_number(a),
        }


def _number(v):
    return float(v) if np.isfinite(v) else None


def _frame(fit: dict[str, np.ndarray], kept) -> pd.DataFrame:
    out = {k: [_number(v) for v in fit[k]] for k in ("r2", "r2_adj", "sigma", "rmse", "condition")}
    out |= {k: [[_number(v) for v in row] for row in fit[k]] for k in ("coef", "pvalue")}
    return pd.DataFrame(out | {"kept": kept}, columns=[f.name for f in FIT.fields])


@F.pandas_udf(FIT)
def solve(n: pd.Series, xx: pd.Series, xy: pd.Series, yy: pd.Series) -> pd.DataFrame:
    """Ordinary least squares with p-values, R², residual deviation and condition number."""
    if len(n) == 0:
        return pd.DataFrame(columns=[f.name for f in FIT.fields])
    counts, a, b, squares = _stack(n, xx, xy, yy)
    return _frame(_fit(counts, a, b, squares), [b.shape[1] - 1] * len(n))


@F.pandas_udf(FIT)
def solve_subset(n: pd.Series, xx: pd.Series, xy: pd.Series, yy: pd.Series, mask: pd.Series) -> pd.DataFrame:
    """The same with the terms whose bit is set in `mask` (bit 0 the first term), the intercept always in."""
    if len(n) == 0:
        return pd.DataFrame(columns=[f.name for f in FIT.fields])
    counts, a, b, squares = _stack(n, xx, xy, yy)
    terms = np.arange(b.shape[1] - 1)
    chosen = (mask.to_numpy(np.int64)[:, None] >> terms & 1).astype(bool)
    sizes, parts = chosen.sum(axis=1), []
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        idx = np.column_stack([np.zeros(len(rows), int), np.nonzero(chosen[rows])[1].reshape(len(rows), size) + 1])
        r = rows[:, None]
        part = _fit(counts[rows], a[r[:, :, None], idx[:, :, None], idx[:, None, :]], b[r, idx], squares[rows])
        parts.append(_frame(part, [int(size)] * len(rows)).set_axis(rows))
    return pd.concat(parts).sort_index()


def fit(df: DataFrame, terms: Mapping[str, Column], target: Column, keys: Sequence[str] = (), least: int = 1) -> DataFrame:
    """`keys, n, fit`: one model per key with at least `least` rows."""
    sums = gram(df, terms, target, keys).where(F.col("n") >= least)
    return sums.select(*keys, "n", solve("n", "xx", "xy", "yy").alias("fit"))


def significant_mask(pvalues: str, terms: int, level: float) -> Column:
    """Bits of the terms with a p-value below `level`; an undefined one does not count."""
    mask = F.lit(0)
    for i in range(terms):
        mask = mask + F.when(F.col(pvalues)[i + 1] < level, F.lit(1 << i)).otherwise(0)
    return mask


def dot(coef: Column, terms: Mapping[str, Column]) -> Column:
    """Intercept plus coefficients times terms."""
    total = coef[0]
    for i, term in enumerate(terms.values(), 1):
        total = total + coef[i] * term
    return total

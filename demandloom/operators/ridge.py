"""Penalised fits and expanding-window validation from summed products alone.

One scan sums the products per series and part (or fold). Penalties, choices and scores are arithmetic on p × p arrays:
the sums of the validation rows give the squared error of any coefficients without a second scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandloom import PAIR
from demandloom.operators import gram as G

#: Relative to the sums of squares of the centred terms, largest first.
PENALTIES = (10.0, 1.0, 0.1, 0.01, 0.001)

PATH = "coef array<double>, penalty double, sigma double, valid_rmse double"
_SUMS = ("n", "xx", "xy", "yy")


def _matrices(xx: pd.Series, xy: pd.Series, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Stacked products; rows without sums become zeros."""
    a = np.array([np.zeros(p * p) if v is None else np.asarray(v, float) for v in xx]).reshape(-1, p, p)
    return a, np.array([np.zeros(p) if v is None else np.asarray(v, float) for v in xy]).reshape(-1, p)


def squared_error(coef: np.ndarray, a: np.ndarray, b: np.ndarray, yy: np.ndarray) -> np.ndarray:
    """Sum of squared errors of coefficients (… × p) on the rows behind the sums (… × p × p)."""
    return np.maximum(yy - 2 * (coef * b).sum(-1) + np.einsum("...i,...ij,...j->...", coef, a, coef), 0.0)


def path_coefficients(n: np.ndarray, a: np.ndarray, b: np.ndarray, penalties: Sequence[float]) -> np.ndarray:
    """Coefficients (systems × penalties × p), the intercept first and free of penalty, from one decomposition each.

    The penalty of a term is a multiple of its centred sum of squares, so it does not depend on units. A term that is
    constant gets the coefficient 0.
    """
    mean_x, mean_y = a[:, 0, 1:] / n[:, None], b[:, 0] / n
    centred = a[:, 1:, 1:] - n[:, None, None] * mean_x[:, :, None] * mean_x[:, None, :]
    spread = np.sqrt(np.maximum(np.einsum("bii->bi", centred), 0))
    # Rounding leaves a constant term a little spread.
    real = spread > 1e-7 * np.sqrt(np.einsum("bii->bi", a[:, 1:, 1:]))
    scale = np.where(real, spread, 1.0)
    unit = np.where(real[:, :, None] & real[:, None, :], centred / scale[:, :, None] / scale[:, None, :], 0.0)
    side = np.where(real, (b[:, 1:] - n[:, None] * mean_x * mean_y[:, None]) / scale, 0.0)
    values, vectors = np.linalg.eigh(unit)
    turned = np.einsum("bij,bi->bj", vectors, side)
    weights = np.maximum(values, 0)[:, None, :] + np.asarray(penalties, float)[None, :, None]
    slopes = np.einsum("bij,bkj->bki", vectors, turned[:, None, :] / weights) / scale[:, None, :]
    first = mean_y[:, None] - np.einsum("bki,bi->bk", slopes, mean_x)
    return np.concatenate([first[:, :, None], slopes], axis=2)


def ridge_path(penalties: Sequence[float] = PENALTIES):
    """Pandas UDF over the training and the validation sums: the fit of the penalty with the least validation error.

    Ties go to the larger penalty; a series without validation rows takes the smallest.
    """
    ordered = sorted(penalties, reverse=True)
    if not ordered or ordered[-1] <= 0:
        raise ValueError("penalties are positive")

    @F.pandas_udf(PATH)
    def choose(
        n: pd.Series, xx: pd.Series, xy: pd.Series, yy: pd.Series, vn: pd.Series, vxx: pd.Series, vxy: pd.Series, vyy: pd.Series
    ) -> pd.DataFrame:
        names = ["coef", "penalty", "sigma", "valid_rmse"]
        if len(n) == 0:
            return pd.DataFrame(columns=names)
        p, rows = len(xy.iloc[0]), np.arange(len(n))
        a, b = _matrices(xx, xy, p)
        coef = path_coefficients(n.to_numpy(float), a, b, ordered)
        va, vb = _matrices(vxx, vxy, p)
        count = vn.fillna(0).to_numpy(float)
        errors = squared_error(coef, va[:, None], vb[:, None], vyy.fillna(0).to_numpy(float)[:, None])
        best = np.where(count > 0, errors.argmin(axis=1), len(ordered) - 1)
        chosen = coef[rows, best]
        train = squared_error(chosen, a, b, yy.to_numpy(float))
        valid = [float(np.sqrt(e / c)) if c else None for e, c in zip(errors[rows, best], count)]
        found = [list(map(float, c)) for c in chosen], np.array(ordered)[best], np.sqrt(train / n.to_numpy(float)), valid
        return pd.DataFrame(dict(zip(names, found)))

    return choose


def fit_paths(
    df: DataFrame, terms: Mapping[str, Column], target: Column, valid: Column, keys: Sequence[str] = PAIR, *,
    penalties: Sequence[float] = PENALTIES, least: int = 20,
) -> DataFrame:
    """`keys, n, fit`: one model per series with at least `least` training rows, its penalty chosen on the rows where
    `valid` holds. One scan for both parts and all penalties."""
    sums = G.gram(df.withColumn("_valid", F.coalesce(valid, F.lit(False))), terms, target, [*keys, "_valid"])
    part = lambda flag: F.any_value(F.when(F.col("_valid") == flag, F.struct(*_SUMS)), F.lit(True))
    both = sums.groupBy(*keys).agg(part(False).alias("t"), part(True).alias("v")).where(F.col("t.n") >= least)
    columns = [F.col(f"{side}.{c}") for side in "tv" for c in _SUMS]
    return both.select(*keys, F.col("t.n").alias("n"), ridge_path(penalties)(*columns).alias("fit"))


@F.pandas_udf(T.StructType([T.StructField("rmse", T.DoubleType()), T.StructField("bias", T.DoubleType())]))
def _error_of_sums(coef: pd.Series, n: pd.Series, xx: pd.Series, xy: pd.Series, yy: pd.Series) -> pd.DataFrame:
    """Root mean squared and mean error (actual less forecast) on the rows behind the sums."""
    if len(n) == 0:
        return pd.DataFrame({"rmse": [], "bias": []})
    p = len(xy.iloc[0])
    a, b = _matrices(xx, xy, p)
    c, count = np.array([np.asarray(v, float) for v in coef]), n.to_numpy(float)
    return pd.DataFrame({"rmse": np.sqrt(squared_error(c, a, b, yy.to_numpy(float)) / count), "bias": (b[:, 0] - (c * a[:, 0]).sum(1)) / count})


def expanding_fits(
    df: DataFrame, terms: Mapping[str, Column], target: Column, *, folds: int = 5, fold: str = "fold", keys: Sequence[str] = ()
) -> DataFrame:
    """`keys, fold, n_train, fit, n, rmse, bias`: the model of all rows before each fold and its scores on the fold.

    One scan sums the products of each fold; the head (fold NULL) and every fold count in the systems of all later
    ones, and a fold's own sums give its errors. Folds without rows before them, or without rows, are left out.
    """
    p = len(terms) + 1
    sums = G.gram(df.withColumn("_at", F.coalesce(F.col(fold), F.lit(-1))), terms, target, [*keys, "_at"])
    later = sums.where(F.col("_at") < folds - 1).withColumn(fold, F.explode(F.sequence(F.col("_at") + 1, F.lit(folds - 1))))
    added = lambda c, size: F.array(*[F.sum(F.col(c)[i]) for i in range(size)]).alias(c)
    running = later.groupBy(*keys, fold).agg(F.sum("n").alias("n"), added("xx", p * p), added("xy", p), F.sum("yy").alias("yy"))
    models = running.select(*keys, fold, F.col("n").alias("n_train"), G.solve("n", "xx", "xy", "yy").alias("fit"))
    own = sums.where("_at >= 0").withColumnRenamed("_at", fold)
    scored = models.join(own, [*keys, fold]).withColumn("_e", _error_of_sums("fit.coef", *_SUMS))
    return scored.select(*keys, fold, "n_train", "fit", "n", "_e.rmse", "_e.bias")


def out_of_fold(df: DataFrame, models: DataFrame, terms: Mapping[str, Column], *, fold: str = "fold", keys: Sequence[str] = ()) -> DataFrame:
    """`yhat` of every row of a fold by the model of the rows before it."""
    return df.join(models.select(*keys, fold, "fit.coef"), [*keys, fold]).withColumn("yhat", G.dot(F.col("coef"), terms)).drop("coef")

"""Trends that change their slope: hinge terms at candidate dates, chosen per series from one set of summed products."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom import PAIR
from demandloom.operators import gram as G
from demandloom.operators.forecast import seasonal_terms

FIT = "coef array<double>, sigma double, changes array<int>"
#: What the earlier terms leave of a hinge, relative to it, below which it cannot be told from them.
DEPENDENT = 1e-7


def candidate_dates(first: dt.date, last: dt.date, count: int = 10, share: float = 0.8) -> list[dt.date]:
    """`count` evenly spread dates inside the first `share` of a span."""
    step = (last - first).days * share / count
    return [first + dt.timedelta(days=round(step * i)) for i in range(1, count + 1)]


def hinge_terms(dates: Sequence[dt.date], date: str = "date") -> dict[str, Column]:
    """Years since each date, 0 before it: its coefficient is the change of the yearly slope."""
    return {f"change_{d:%Y_%m_%d}": F.greatest(F.datediff(F.col(date), F.lit(d)) / F.lit(365.25), F.lit(0.0)) for d in dates}


def _sweep(m: np.ndarray, rows: np.ndarray, at: np.ndarray, sign: int = 1) -> None:
    """Bring term `at[i]` of system `rows[i]` into its fit (or, with sign -1, take it out again), in place."""
    part = m[rows]
    line = np.arange(len(rows))
    column = part[line, :, at]
    pivot = part[line, at, at]
    part -= column[:, :, None] * column[:, None, :] / pivot[:, None, None]
    part[line, :, at] = part[line, at, :] = sign * column / pivot[:, None]
    part[line, at, at] = -1 / pivot
    m[rows] = part


def select_hinges(n: np.ndarray, a: np.ndarray, b: np.ndarray, yy: np.ndarray, base: int, most: int) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """Coefficients (0 where not chosen), residual deviation and chosen hinges of stacked systems.

    The first `base` columns are always in. Forward selection: of the remaining ones the one that lowers the residual
    most comes in while n ln(rss) falls by more than 2 ln n, as a change has a slope and a date. At the end those that
    later ones have made needless, by the same measure, go out again.
    """
    count, p = b.shape
    m = np.zeros((count, p + 1, p + 1))
    scale = np.sqrt(np.maximum(np.column_stack([np.einsum("bii->bi", a), yy]), 0))
    scale = np.where(scale > 0, scale, 1.0)
    m[:, :p, :p], m[:, :p, p], m[:, p, :p], m[:, p, p] = a, b, b, yy
    m /= scale[:, :, None] * scale[:, None, :]
    inside = np.zeros((count, p), bool)
    everyone = np.arange(count)

    def bring(rows: np.ndarray, at: np.ndarray) -> None:
        _sweep(m, rows, at)
        inside[rows, at] = True

    for j in range(base):
        rows = everyone[m[:, j, j] > 1e-11]
        bring(rows, np.full(len(rows), j))
    open_rows = everyone
    for _ in range(min(most, p - base)):
        left = np.diagonal(m[open_rows], axis1=1, axis2=2)[:, base:p]
        free = ~inside[open_rows, base:] & (left > DEPENDENT)
        gain = np.where(free, m[open_rows, base:p, p] ** 2 / np.where(free, left, 1.0), 0.0)
        best = gain.argmax(axis=1)
        rss = np.maximum(m[open_rows, p, p], 1e-300)
        after = np.maximum(rss - gain[np.arange(len(open_rows)), best], 1e-300)
        size = n[open_rows]
        better = (size * np.log(after / rss) + 2 * np.log(size) < 0) & (size > inside[open_rows].sum(1) + 1)
        open_rows, best = open_rows[better], best[better]
        if not len(open_rows):
            break
        bring(open_rows, best + base)
    for _ in range(min(most, p - base)):
        hinges = slice(base, p)
        loss = np.where(inside[:, hinges], m[:, hinges, p] ** 2 / np.maximum(-np.diagonal(m, axis1=1, axis2=2)[:, hinges], 1e-300), np.inf)
        least = loss.min(axis=1)
        needless = np.isfinite(least) & (n * np.log1p(np.where(np.isfinite(least), least, 0) / np.maximum(m[:, p, p], 1e-300)) < 2 * np.log(n))
        rows, at = everyone[needless], loss.argmin(axis=1)[needless] + base
        if not len(rows):
            break
        _sweep(m, rows, at, -1)
        inside[rows, at] = False
    coef = np.where(inside, m[:, :p, p], 0.0) / scale[:, :p] * scale[:, p:]
    free = n - inside.sum(1)
    rss = np.maximum(m[:, p, p], 0) * scale[:, p] ** 2
    return coef, np.sqrt(np.where(free > 0, rss / np.maximum(free, 1), np.nan)), [np.flatnonzero(row).tolist() for row in inside[:, base:]]


def fit_with_changes(
    df: DataFrame, dates: Sequence[dt.date], target: Column, keys: Sequence[str] = PAIR, *, terms: Mapping[str, Column] | None = None,
    date: str = "date", most: int = 5, least: int = 60,
) -> tuple[DataFrame, dict[str, Column]]:
    """`keys, n, fit` with up to `most` changes of slope per series, and the terms that `fit.coef` belongs to.

    `fit.changes` numbers the chosen dates. One scan serves all series, candidates and steps of the selection;
    `forecast.predict_seasonal` takes the result.
    """
    base = dict(terms or seasonal_terms(date))
    every, always = base | hinge_terms(dates, date), len(base) + 1

    @F.pandas_udf(FIT)
    def choose(n: pd.Series, xx: pd.Series, xy: pd.Series, yy: pd.Series) -> pd.DataFrame:
        if len(n) == 0:
            return pd.DataFrame(columns=["coef", "sigma", "changes"])
        b = np.array([np.asarray(v, float) for v in xy])
        a = np.array([np.asarray(v, float) for v in xx]).reshape(len(b), b.shape[1], b.shape[1])
        coef, sigma, changes = select_hinges(n.to_numpy(float), a, b, yy.to_numpy(float), always, most)
        return pd.DataFrame({"coef": list(coef), "sigma": sigma, "changes": changes})

    sums = G.gram(df, every, target, keys).where(F.col("n") >= least)
    return sums.select(*keys, "n", choose("n", "xx", "xy", "yy").alias("fit")), every

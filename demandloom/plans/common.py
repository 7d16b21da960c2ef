"""Small helpers of the query modules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rounded(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 6) -> DataFrame:
    """Doubles (all, or the listed ones) to fixed digits, negative zero made plain."""
    chosen = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)] if columns is None else columns
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) + F.lit(0.0) for c in chosen})


def r6(expression: str, name: str) -> str:
    """The SQL counterpart of `rounded`."""
    return f"round({expression}, 6) + 0 AS {name}"


def levels(df: DataFrame, column: str, most: int = 1000) -> list:
    """The distinct values of a column that become columns of a matrix, in order; an error beyond `most` of them."""
    found = sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect())
    if len(found) > most:
        raise ValueError(f"more than {most} values of {column}: use the long form")
    return found

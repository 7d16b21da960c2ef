"""Declared schemas and planning-time column resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T


DATE, INT, DOUBLE, STRING = T.DateType(), T.IntegerType(), T.DoubleType(), T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


SALES = _struct(date=DATE, store_nbr=INT, item_nbr=INT, units=DOUBLE)
STORE_KEY = _struct(store_nbr=INT, station_nbr=INT)
SUBMISSION = _struct(id=STRING, units=DOUBLE)
FALLBACK_SALES = _struct(date=DATE, store=STRING, sales=DOUBLE)
FEATURE_STATS = _struct(
    model_version=STRING,
    last_trained=STRING,
    required_columns=T.ArrayType(STRING),
    column_order=T.ArrayType(STRING),
    default_values=T.MapType(STRING, INT),
    temperature_bins=T.ArrayType(DOUBLE),
    temperature_labels=T.ArrayType(STRING),
    humidity_bins=T.ArrayType(DOUBLE),
    humidity_labels=T.ArrayType(STRING),
)

# The names one logical column goes by in the inputs.
VALUE_NAMES = ("sales", "units")
STORE_NAMES = ("store_id", "store_nbr", "store_name", "store")
ITEM_NAMES = ("item_id", "item_nbr", "item_name", "item")

# The 28 weather codes.
WEATHER_CODES = (
    "BCFG", "BLDU", "BLSN", "BR", "DU", "DZ", "FG", "FG+", "FU", "FZDZ", "FZFG", "FZRA", "GR", "GS",
    "HZ", "MIFG", "PL", "PRFG", "RA", "SG", "SN", "SQ", "TS", "TSRA", "TSSN", "UP", "VCFG", "VCTS",
)


def resolve_column(df: DataFrame, candidates: Sequence[str], *, required: bool = True) -> str | None:
    """The first of `candidates` present in `df`; raise (or None) when there is none."""
    present = set(df.columns)
    for name in candidates:
        if name in present:
            return name
    if required:
        raise ValueError(f"none of {list(candidates)} among columns {df.columns}")
    return None


def canonical_panel(df: DataFrame) -> DataFrame:
    """Rename store, item and value columns to `store_nbr`, `item_nbr`, `units`."""
    return df.withColumnsRenamed(
        {
            resolve_column(df, STORE_NAMES): "store_nbr",
            resolve_column(df, ITEM_NAMES): "item_nbr",
            resolve_column(df, VALUE_NAMES): "units",
        }
    )


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns in schema order; booleans are not numeric."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def split_columns(df: DataFrame, categorical: Sequence[str], ids: Sequence[str]) -> tuple[list[str], list[str]]:
    """(categorical, numeric) feature columns: strings and the listed codes against the other numbers, minus ids."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]
    chosen = [c for c in df.columns if (c in strings or c in set(categorical)) and c not in set(ids)]
    return chosen, numeric_columns(df, exclude=[*chosen, *ids])


def feature_columns(df: DataFrame, drop: Sequence[str]) -> list[str]:
    """All columns but the dropped ones, in schema order."""
    return [c for c in df.columns if c not in set(drop)]

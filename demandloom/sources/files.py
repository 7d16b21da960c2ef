"""File scans and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandloom import schema as S
from demandloom.functions import scalars as X


def read_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType, *, date_format: str = "yyyy-MM-dd"
) -> DataFrame:
    """CSV with header under a declared schema, dates parsed by `date_format`."""
    return spark.read.schema(schema).option("header", True).option("dateFormat", date_format).csv(path)


def read_measure_csv(
    spark: SparkSession, path: str, names: Sequence[str], measure: str, *, encoding: str = "UTF-8"
) -> DataFrame:
    """Headerless CSV with given column names; the measure loses its thousands separators, empty measures go."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.schema(schema).option("header", False).option("encoding", encoding).csv(path)
    return raw.withColumn(measure, X.thousands_number(F.col(measure))).dropna(subset=[measure])


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet scan, pruned to `columns` when given."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_or_empty(spark: SparkSession, path: str, fallback: T.StructType = S.FALLBACK_SALES) -> DataFrame:
    """CSV scan, or an empty table of the declared columns when the path is missing."""
    try:
        return read_csv(spark, path, fallback)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], fallback)


def coerce_date(df: DataFrame, column: str = "date", fmt: str = "yyyy-MM-dd") -> DataFrame:
    """Text or timestamp column as DATE if it is there; unreadable text gives NULL."""
    if column not in df.columns:
        return df
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        return df.withColumn(column, F.try_to_timestamp(column, F.lit(fmt)).cast("date"))
    return df.withColumn(column, F.col(column).cast("date"))


def write_csv(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", *, mode: str = "overwrite", partition_by: Sequence[str] = ()
) -> None:
    """Parquet or CSV by `fmt`, optionally laid out by partition columns."""
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unknown format {fmt!r}; use 'parquet' or 'csv'")
    writer = df.write.mode(mode).partitionBy(*partition_by).format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def feature_table_name(prefix: str, df: DataFrame) -> str:
    return f"{prefix}_{len(df.columns)}_features"


def write_feature_stats(spark: SparkSession, path: str, stats: dict) -> None:
    """One JSON row of model metadata: versions, bins, labels, defaults, column order."""
    spark.createDataFrame([stats], S.FEATURE_STATS).write.mode("overwrite").json(path)


def read_feature_stats(spark: SparkSession, path: str) -> dict:
    """The metadata row as a dict, `{}` when nothing was saved."""
    try:
        row = spark.read.schema(S.FEATURE_STATS).json(path).first()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    return row.asDict(recursive=True) if row else {}


def submission_rows(df: DataFrame, value: str = "units") -> DataFrame:
    """`id, units`: the id spells store, item and day. A total order belongs to the sink."""
    return df.select(X.request_id().alias("id"), F.col(value).cast("double").alias("units"))


def write_submission(df: DataFrame, path: str, value: str = "units") -> None:
    """Submission CSV sorted by day, store and item (range-partitioned sort, any number of files)."""
    ordered = df.orderBy("date", "store_nbr", "item_nbr")
    write_csv(submission_rows(ordered, value), path)

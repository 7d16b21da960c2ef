"""Unions, distinct lists, filters and splits."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom import PAIR


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def stack_requests(train: DataFrame, requests: DataFrame, flag: str = "is_kaggle_test") -> DataFrame:
    """History and forecast requests in one table: requests carry the flag and a NULL target."""
    return train.withColumn(flag, F.lit(False)).unionByName(
        requests.withColumn(flag, F.lit(True)), allowMissingColumns=True
    )


def drop_incomplete_history(df: DataFrame, flag: str = "is_kaggle_test") -> DataFrame:
    """History rows must be complete, requests stay as they are: one filter instead of split and re-union."""
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in df.columns])
    return df.where(F.col(flag) | complete)


def keyed_frames(df: DataFrame, keys: Sequence[str], columns: Sequence[str], by: Sequence[str] = (), name: str = "frames") -> DataFrame:
    """`by, frames`: a map from the text of the keys (`a_b`) to the key's rows, an array of `columns` in order.

    For keys with few rows each (a series' forecasts); `by` says which keys share a map.
    """
    key = F.concat_ws("_", *[F.col(k).cast("string") for k in keys])
    rows = df.groupBy(*by, key.alias("_key")).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("_rows"))
    return rows.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_key", "_rows"))).alias(name))


def flatten_frames(df: DataFrame, key: str = "store_item", name: str = "frames") -> DataFrame:
    """One row per row of every frame in the maps, with its key and the columns beside the map; keys without rows vanish."""
    kept = [c for c in df.columns if c != name]
    return df.select(*kept, F.explode(name).alias(key, "_rows")).select(*kept, key, F.inline("_rows"))


def union_frames(frames: Mapping[str, DataFrame], key: str = "store_item") -> DataFrame:
    """Frames by key as one table with the key as a column; a column that a frame lacks is NULL there."""
    tagged = [df.withColumn(key, F.lit(k)) for k, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def distinct_pairs(df: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    return df.select(*keys).distinct()


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def name_map(df: DataFrame, key: str, name: str, date: str = "date") -> DataFrame:
    """key → its latest name."""
    return df.groupBy(key).agg(F.max_by(name, date).alias(name))


def items_of_store(df: DataFrame, store: int) -> DataFrame:
    return df.where(F.col("store_nbr") == store).select("item_nbr").distinct()


def of_store(df: DataFrame, store: int | Sequence[int] | None = None, item: int | Sequence[int] | None = None) -> DataFrame:
    """Rows of one or several stores and items; None keeps all."""
    for column, wanted in (("store_nbr", store), ("item_nbr", item)):
        if wanted is not None:
            df = df.where(F.col(column).isin([wanted] if isinstance(wanted, int) else list(wanted)))
    return df


def dashboard_filter(
    df: DataFrame, start: str | dt.date | None = None, end: str | dt.date | None = None, store: int | str | None = "All",
    categories: Sequence[str] = (),
) -> DataFrame:
    """Date range, one store unless "All", categories unless the list is empty."""
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(end).cast("date"))
    if store not in (None, "All"):
        df = df.where(F.col("store_nbr") == store)
    if categories:
        df = df.where(F.col("category").isin(list(categories)))
    return df


def trailing_days(df: DataFrame, days: int, keys: Sequence[str] = (), date: str = "date") -> DataFrame:
    """Rows no more than `days` days before the last one, overall or per key."""
    if keys:
        last = df.groupBy(*keys).agg(F.max(date).alias("_last"))
        return df.join(last, list(keys)).where(F.col(date) >= F.date_sub("_last", days)).drop("_last")
    return df.where(F.col(date) >= F.date_sub(df.select(F.max(date)).scalar(), days))


def hold_out_flags(df: DataFrame, valid_from: str, test_from: str, date: str = "date") -> DataFrame:
    """`is_test` from one cut-off on, `is_valid` from an earlier one up to it."""
    test = F.col(date) >= F.lit(test_from).cast("date")
    return df.withColumns({"is_test": test, "is_valid": (F.col(date) >= F.lit(valid_from).cast("date")) & ~test})


def split_name() -> Column:
    return F.when(F.col("is_test"), "test").when(F.col("is_valid"), "valid").otherwise("train")


def three_way_split(flagged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        flagged.where(~F.col("is_test") & ~F.col("is_valid")),
        flagged.where("is_valid"),
        flagged.where("is_test"),
    )


def storm_days(df: DataFrame, rain: float = 1.0, snow: float = 2.0) -> DataFrame:
    """Days with rain above or snow above a threshold; an unknown reading does not count."""
    hit = F.col("preciptotal") > rain
    if "snowfall" in df.columns:
        hit = hit | (F.col("snowfall") > snow)
    return df.where(hit)


def position_folds(df: DataFrame, folds: int = 5, order: Sequence[str] = ("date", "store_nbr", "item_nbr")) -> DataFrame:
    """Expanding-window folds by row position: `position` (0-based) and `fold`, NULL for the first, train-only block.

    Fewer rows than folds + 1 make no block and no fold. The last `folds` blocks of ⌊n/(folds+1)⌋ rows are the validation parts; fold k trains on every row before its block.
    Positions come from counts per day and per day and store plus a rank inside one store's day, so no task orders
    the whole table.
    """
    first, second, third = order
    from pyspark.sql import Window as W

    per_cell = df.groupBy(first, second).count()
    per_day = per_cell.groupBy(first).agg(F.sum("count").alias("_day"))
    # One row per day.
    day_start = per_day.select(first, (F.sum("_day").over(W.orderBy(first)) - F.col("_day")).alias("_before"))
    cells = per_cell.join(day_start, first).select(
        first,
        second,
        (F.col("_before") + F.sum("count").over(W.partitionBy(first).orderBy(second)) - F.col("count")).alias("_start"),
    )
    inside = F.row_number().over(W.partitionBy(first, second).orderBy(third)) - 1
    n = df.select(F.count("*")).scalar()
    block = F.floor(n / (folds + 1))
    placed = df.withColumn("_in", inside).join(cells, [first, second])
    placed = placed.withColumn("position", F.col("_start") + F.col("_in")).drop("_in", "_start")
    head = n - F.lit(folds) * block
    return placed.withColumn(
        "fold", F.when(F.col("position") >= head, F.floor(F.try_divide(F.col("position") - head, block)).cast("int"))
    )


def date_folds(df: DataFrame, folds: int = 5, date: str = "date") -> DataFrame:
    """The same by distinct day, so that a day is never split between train and validation.

    Fewer days than folds + 1 make no fold.
    """
    from pyspark.sql import Window as W

    days = df.select(date).distinct().withColumn("position", F.row_number().over(W.orderBy(date)) - 1)  # a calendar
    n = days.select(F.count("*")).scalar()
    block = F.floor(n / (folds + 1))
    head = n - F.lit(folds) * block
    numbered = days.withColumn(
        "fold", F.when(F.col("position") >= head, F.floor(F.try_divide(F.col("position") - head, block)).cast("int"))
    )
    return df.join(numbered.drop("position"), date)

"""Joins of sales with weather, stations, calendars and forecasts. Spark chooses broadcast or shuffle by size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandloom import PAIR
from demandloom.functions import dates as D
from demandloom.session import materialize


def keep_pairs(df: DataFrame, pairs: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Rows of the listed series only."""
    return df.join(pairs, list(keys), "left_semi")


def weather_by_store(weather: DataFrame, key: DataFrame) -> DataFrame:
    """Station readings for every store the station serves."""
    return weather.join(key, "station_nbr")


def with_store_weather(df: DataFrame, weather: DataFrame, key: DataFrame, how: str = "inner") -> DataFrame:
    """Sales with their station's readings; `inner` loses days without any, `left` keeps them."""
    stationed = df.join(unique_key(key), "store_nbr", how)
    return stationed.join(weather, ["date", "station_nbr"], how)


def with_climate(df: DataFrame, climate: DataFrame) -> DataFrame:
    return df.join(climate, ["date", "province"], "left")


def unique_key(key: DataFrame, column: str = "store_nbr") -> DataFrame:
    """One row per store, the smallest station where the table lists several."""
    return key.groupBy(column).agg(*[F.min(c).alias(c) for c in key.columns if c != column])


def duplicate_keys(key: DataFrame, column: str = "store_nbr") -> DataFrame:
    """Keys the look-up table lists more than once."""
    return key.groupBy(column).agg(F.count("*").alias("rows")).where("rows > 1")


def flat_calendar(calendar: DataFrame) -> DataFrame:
    """One row per day; the flags of days listed twice are merged."""
    flags = [c for c in calendar.columns if c != "date"]
    return calendar.groupBy("date").agg(*[F.max(c).alias(c) for c in flags])


def with_calendar(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """Calendar flags, 0 on ordinary days, without growing the table."""
    flags = [c for c in calendar.columns if c != "date"]
    joined = df.join(flat_calendar(calendar), "date", "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("int") for c in flags})


def holiday_flag(df: DataFrame, holidays: DataFrame) -> DataFrame:
    """`is_holiday` by a holiday table; an empty table gives 0."""
    days = holidays.select("date").distinct().withColumn("is_holiday", F.lit(1))
    return df.join(days, "date", "left").withColumn("is_holiday", F.coalesce("is_holiday", F.lit(0)))


def merge_calendars(holidays: DataFrame, long_weekends: DataFrame) -> DataFrame:
    """Full outer merge of two calendars on day and effect window."""
    return holidays.join(long_weekends, ["ds", "lower_window", "upper_window"], "full")


def with_forecast(df: DataFrame, forecast: DataFrame, how: str = "inner", keys: Sequence[str] = (*PAIR, "date")) -> DataFrame:
    """Forecasts next to actuals (`inner`) or requests (`left`)."""
    return df.join(forecast, list(keys), how)


def top_pairs(df: DataFrame, value: str, n: int = 20, keys: Sequence[str] = PAIR) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(value).alias("_t")).orderBy(F.desc("_t"), *keys).limit(n).select(*keys)


def event_windows(events: DataFrame, before: int = 3, after: int = 3, keys: Sequence[str] = ("station_nbr",), date: str = "date") -> DataFrame:
    """Distinct days within the window around any event, per key or (no keys) pooled."""
    return events.select(*keys, F.explode(D.window_days(date, before, after)).alias(date)).distinct()


def event_flag(df: DataFrame, events: DataFrame, before: int = 3, after: int = 3, keys: Sequence[str] = ("station_nbr",), date: str = "date") -> DataFrame:
    """`event` = 1 on days near an event."""
    days = event_windows(events, before, after, keys, date).withColumn("event", F.lit(1))
    return df.join(days, [*keys, date], "left").withColumn("event", F.coalesce("event", F.lit(0)))


def panel_spine(pairs: DataFrame, start, end, keys: Sequence[str] = PAIR) -> DataFrame:
    """Every day between two dates for every listed series."""
    return pairs.select(*keys, F.explode(F.sequence(start, end)).alias("date"))


def densify(df: DataFrame, value: str = "units", keys: Sequence[str] = PAIR) -> DataFrame:
    """The panel on every day between its first and last, zero where nothing was sold."""
    span = df.select(F.struct(F.min("date").alias("a"), F.max("date").alias("b"))).scalar()
    spine = panel_spine(df.select(*keys).distinct(), span["a"], span["b"], keys)
    return spine.join(df.select(*keys, "date", value), [*keys, "date"], "left").withColumn(
        value, F.coalesce(value, F.lit(0.0))
    )


def with_positions(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """0-based row number of the whole table in the given order, ties in no particular order.

    Rows are range-partitioned, sorted inside their partition and written with their place in it; the partitions' sizes,
    one row each, give the offsets. No task sees more than one range.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = materialize(placed, "positions").withColumns({"_part": F.shiftright("_id", 33), "_in": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    return placed.join(starts, "_part").withColumn(name, F.col("_start") + F.col("_in")).drop("_id", "_part", "_in", "_start")


def positional_join(
    left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str], *, name: str = "position", suffix: str = "_right"
) -> DataFrame:
    """Rows of two tables side by side by their place in the given orders; the shorter one's columns are NULL after its end.

    Columns of the right table that the left one has too get `suffix`.
    """
    a, b = with_positions(left, left_order, name), with_positions(right, right_order, name)
    b = b.withColumnsRenamed({c: c + suffix for c in right.columns if c in left.columns})
    return a.join(b, name, "full")

"""Dashboard queries as dictionaries of lazy tables."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom import PAIR
from demandloom.functions import dates as D
from demandloom.operators import aggregates as A
from demandloom.operators import sets as S
from demandloom.operators import windows as Wn


class Selection(NamedTuple):
    """What the viewer picked; "All" stores and an empty category list mean no restriction."""

    start: str
    end: str
    store: int | str = "All"
    categories: Sequence[str] = ()


def daily_trend(df: DataFrame, value: str = "units", size: int = 7) -> DataFrame:
    """Daily total with its moving average, on an aggregate of one row per day."""
    return Wn.moving_average(A.total_by(df, "date", value), "total", size)


def weekday_pattern(daily: DataFrame, least: int = 7) -> DataFrame:
    """Weekday means of daily totals; nothing when there are fewer than `least` days."""
    days = daily.select(F.count("*")).scalar()
    return A.weekday_means(daily, "total").where(days >= least)


def category_shares(df: DataFrame, value: str = "units") -> DataFrame:
    """Totals and shares by category; nothing when there is only one."""
    shares = A.with_share(A.total_by(df, "category", value))
    several = shares.select(F.count("*")).scalar()
    return shares.where(several > 1)


def historical_view(df: DataFrame, pick: Selection, value: str = "units") -> dict[str, DataFrame]:
    """KPIs, trend, weekday pattern with its extremes, breakdowns, distribution and detail of a selection."""
    chosen = S.dashboard_filter(df, *pick)
    trend = daily_trend(chosen, value)
    pattern = weekday_pattern(trend)
    tables = {
        "kpis": A.kpi_block(chosen, pick.start, pick.end, value),
        "trend": trend,
        "weekday_pattern": pattern,
        "weekday_extremes": A.weekday_extremes(pattern),
        "categories": category_shares(chosen, value),
        "top_categories": A.top_and_others(chosen, "category", value),
        "distribution": A.histogram(chosen, value, 30),
        "center": A.center(chosen, value),
        "detail": chosen.orderBy(F.desc("date")),
    }
    if pick.store in (None, "All"):
        tables["stores"] = A.ranked_totals(chosen, "store_nbr", value, 10)
    return tables


def pair_context(df: DataFrame, days: int = 60, value: str = "units", least: int = 7) -> dict[str, DataFrame]:
    """Recent history of every series: last days with moving average, weekday means where there are enough rows."""
    recent = S.trailing_days(df.select(*PAIR, "date", value), days, PAIR)
    counted = recent.groupBy(*PAIR).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")
    weekday = recent.join(counted, list(PAIR)).groupBy(*PAIR, D.weekday0("date").alias("weekday")).agg(F.avg(value).alias("mean"))
    return {
        "trend": Wn.moving_average(recent, value, 7, keys=PAIR),
        "weekday_means": weekday,
        "stats": A.history_stats(df, value),
    }


def history_overlay(df: DataFrame, store: int | None = None, value: str = "units") -> DataFrame:
    return A.total_by(S.of_store(df, store), "date", value)


def item_history(df: DataFrame, store=None, item=None, value: str = "units") -> DataFrame:
    return A.total_by(S.of_store(df, store, item), [*PAIR, "date"], value)


def weather_trend(weather: DataFrame, columns: Sequence[str], station: int | None = None) -> DataFrame:
    kept = weather if station is None else weather.where(F.col("station_nbr") == station)
    return kept.select("station_nbr", "date", *columns).orderBy("station_nbr", "date")

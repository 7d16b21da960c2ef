"""Calendar expressions on a DATE column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEASON_NAMES = ("Winter", "Spring", "Summer", "Fall")
WEEKDAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def _c(d: str | Column) -> Column:
    return F.col(d) if isinstance(d, str) else d


def weekday0(d: str | Column) -> Column:
    """Monday = 0 … Sunday = 6."""
    return F.weekday(_c(d))


def is_weekend(d: str | Column) -> Column:
    return (weekday0(d) >= 5).cast("int")


def late_week(d: str | Column) -> Column:
    """Friday to Sunday."""
    return (weekday0(d) > 3).cast("int")


def warm_half(d: str | Column) -> Column:
    """April to September."""
    return F.month(_c(d)).between(4, 9).cast("int")


def season_code(d: str | Column) -> Column:
    """Meteorological season: Dec-Feb 0, Mar-May 1, Jun-Aug 2, Sep-Nov 3."""
    return (F.floor(F.month(_c(d)) / 3) % 4).cast("int")


def season_name(d: str | Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEASON_NAMES)), season_code(d) + 1)


def weekday_name(d: str | Column) -> Column:
    return F.date_format(_c(d), "EEEE")


def month_name(d: str | Column) -> Column:
    return F.date_format(_c(d), "MMMM")


def year_month(d: str | Column) -> Column:
    return F.date_format(_c(d), "yyyy-MM")


def midpoint(start: str | Column, end: str | Column) -> Column:
    """Day halfway between two days, fraction dropped."""
    return F.date_add(_c(start), F.floor(F.datediff(_c(end), _c(start)) / 2).cast("int"))


def window_days(d: str | Column, before: int, after: int) -> Column:
    """Array of the days from `before` days ahead of `d` to `after` days behind it."""
    return F.sequence(F.date_sub(_c(d), before), F.date_add(_c(d), after))


def thanksgiving(year: Column) -> Column:
    """Fourth Thursday of November."""
    return F.date_add(F.next_day(F.make_date(year, F.lit(10), F.lit(31)), "THU"), 21)


def black_friday_rank(d: str | Column) -> Column:
    """1 on the Friday after Thanksgiving to 4 on the Monday, else 0."""
    gap = F.datediff(_c(d), thanksgiving(F.year(_c(d))))
    return F.when(gap.between(1, 4), gap).otherwise(0).cast("int")


def listed_day(d: str | Column, days: tuple[str, ...]) -> Column:
    """1 when the date is among a short literal list."""
    return _c(d).isin([F.lit(x).cast("date") for x in days]).cast("int")


def with_date_parts(df, date: str = "date"):
    """Year, month, day, weekday, day of year, ISO week, quarter, weekend, season and its indicators."""
    name = season_name(date)
    return df.withColumns(
        {
            "year": F.year(date),
            "month": F.month(date),
            "day": F.day(date),
            "day_of_week": weekday0(date),
            "day_of_year": F.dayofyear(date),
            "week_of_year": F.weekofyear(date),
            "quarter": F.quarter(date),
            "is_weekend": is_weekend(date),
            "season": season_code(date),
            # Indicators without the alphabetically first level, Fall.
            "season_Spring": (name == "Spring").cast("int"),
            "season_Summer": (name == "Summer").cast("int"),
            "season_Winter": (name == "Winter").cast("int"),
            "is_blackfriday": (black_friday_rank(date) > 0).cast("int"),
        }
    )

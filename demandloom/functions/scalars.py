"""Row-level expressions: binning, sentinels, indicators, scenario and demand factors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.functions import dates as D

# Bin edges and labels.
TRAINING_TEMPERATURE = ((20.0, 25.0, 30.0), ("Cold", "Cool", "Warm", "Hot"))
TRAINING_HUMIDITY = ((60.0, 75.0), ("Low", "Medium", "High"))
SCENARIO_TEMPERATURE = ((15.0, 25.0), ("Cool", "Warm", "Hot"))
SCENARIO_HUMIDITY = ((40.0, 70.0), ("Low", "Medium", "High"))

# Scenario multipliers.
WEATHER_FACTOR = {"Clear": 1.0, "Cloudy": 0.95, "Rainy": 0.9, "Snowy": 0.8, "Stormy": 0.7}
COMPETITION_FACTOR = {"Low": 1.1, "Medium": 1.0, "High": 0.9}
SUPPLY_FACTOR = {"Constrained": 0.9, "Normal": 1.0, "Abundant": 1.05}
EVENT_DEFAULT_PCT = {"Sale/Promotion": 20, "Local Event": 10, "Inventory Clearance": -10, "New Product Launch": 50}
WEEKEND_FACTOR = 1.15


def bin_label(value: Column, edges: Sequence[float], labels: Sequence[str], *, right_closed: bool = True) -> Column:
    """Label of the interval `value` falls in; NULL stays NULL. `right_closed` puts an edge in the lower bin."""
    branch = F.when(value.isNull(), F.lit(None).cast("string"))
    for edge, label in zip(edges, labels):
        branch = branch.when((value <= edge) if right_closed else (value < edge), label)
    return branch.otherwise(labels[-1])


def level_indicators(column: str, levels: Sequence[str], *, drop_first: bool = True) -> dict[str, Column]:
    """0/1 columns `column_level`, the first level left out; NULL gives zeros everywhere."""
    return {
        f"{column}_{level}": F.coalesce((F.col(column) == level).cast("int"), F.lit(0))
        for level in levels[1 if drop_first else 0 :]
    }


def token_set(text: Column) -> Column:
    """Distinct non-empty tokens of a space-separated string; NULL gives an empty set."""
    return F.array_distinct(F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda t: t != ""))


def token_indicators(text: str, codes: Sequence[str]) -> dict[str, Column]:
    tokens = token_set(F.col(text))
    return {code: F.array_contains(tokens, code).cast("int") for code in codes}


def sentinel_number(
    text: Column, *, missing: Sequence[str] = ("M", "-"), trace: str = "T", trace_value: float = 0.01, trim: bool = True
) -> Column:
    """Number of a weather reading: missing marks and junk give NULL, the trace mark its value."""
    mark = F.trim(text) if trim else text
    return (
        F.when(mark.isin(list(missing)), F.lit(None).cast("double"))
        .when(mark == trace, F.lit(trace_value))
        .otherwise(text.try_cast("double"))
    )


def coerce_numeric(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every column but the keys as DOUBLE, unreadable text as NULL."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in df.columns if c not in set(keys)})


def thousands_number(text: Column) -> Column:
    """`1,234.5` → 1234.5."""
    return F.regexp_replace(F.trim(text), ",", "").try_cast("double")


def null_if_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def zscore(value: Column, mean: Column | float | None, std: Column | float | None) -> Column:
    """(value − mean) / std where both statistics are there, else the value as it is."""
    m = mean if isinstance(mean, Column) else F.lit(mean).cast("double")
    s = std if isinstance(std, Column) else F.lit(std).cast("double")
    return F.when(m.isNotNull() & s.isNotNull(), F.try_divide(value - m, s)).otherwise(value)


def log_units(value: Column) -> Column:
    return F.log1p(value)


def unlog_floor(value: Column) -> Column:
    """Inverse of `log_units`, never below zero."""
    return F.greatest(F.expm1(value), F.lit(0.0))


def pair_id(*parts: str) -> Column:
    return F.concat_ws("_", *[F.col(p).cast("string") for p in parts])


def request_id(store: str = "store_nbr", item: str = "item_nbr", date: str = "date") -> Column:
    """`store_item_yyyy-MM-dd`."""
    return F.concat_ws("_", F.col(store).cast("string"), F.col(item).cast("string"), F.date_format(date, "yyyy-MM-dd"))


def money_text(value: Column, digits: int = 2) -> Column:
    return F.concat(F.lit("$"), F.format_number(value, digits))


def percent_text(value: Column, digits: int = 1) -> Column:
    return F.concat(F.format_number(value, digits), F.lit("%"))


def title_text(name: Column) -> Column:
    """`sales_mean_7d` → `Sales Mean 7d`."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def file_token(name: Column) -> Column:
    return F.regexp_replace(name, "[ /]", "_")


def leading_id(option: Column) -> Column:
    """Integer before the first ` - `."""
    return F.split(option, " - ")[0].try_cast("int")


def lookup(value: Column, table: Mapping[str, float], default: float = 1.0) -> Column:
    """Value of a short literal table, `default` when the key is absent."""
    branch = None
    for key, number in table.items():
        branch = (F if branch is None else branch).when(value == key, F.lit(float(number)))
    return branch.otherwise(F.lit(float(default)))


def scenario_factor(event_pct: Column, weather: Column, competition: Column, supply: Column, day: Column) -> Column:
    """Product of the event, weather, competition, supply and weekend multipliers."""
    event = F.coalesce(event_pct, F.lit(0.0)) / 100 + 1
    weekend = F.when(D.is_weekend(day) == 1, F.lit(WEEKEND_FACTOR)).otherwise(F.lit(1.0))
    return (
        event
        * lookup(weather, WEATHER_FACTOR)
        * lookup(competition, COMPETITION_FACTOR)
        * lookup(supply, SUPPLY_FACTOR)
        * weekend
    )


# Name fragments that decide a feature's type, tried in this order.
FEATURE_TYPE_RULES = (
    ("date_time", ("day_of_week", "month", "year", "is_weekend", "is_holiday")),
    ("weather", ("temp", "humidity", "season")),
    ("sales_history", ("sales_lag", "sales_mean", "sales_min", "sales_max", "sales_std", "sales_ewma")),
    ("store", ("store_",)),
    ("item", ("item_",)),
)


def feature_type(name: Column, rules=FEATURE_TYPE_RULES) -> Column:
    """First type one of whose fragments occurs in the feature name, else `other`."""
    branch = None
    for kind, fragments in rules:
        hit = F.contains(name, F.lit(fragments[0]))
        for fragment in fragments[1:]:
            hit = hit | F.contains(name, F.lit(fragment))
        branch = (F if branch is None else branch).when(hit, F.lit(kind))
    return branch.otherwise(F.lit("other"))

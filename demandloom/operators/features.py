"""Feature tables: the single operators put together, one series exchange for all series features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom import PAIR
from demandloom.functions import dates as D
from demandloom.functions import scalars as X
from demandloom.operators import cleaning as C
from demandloom.operators import joins as J
from demandloom.operators import windows as Wn
from demandloom.operators.aggregates import selling_pairs
from demandloom.session import materialize

SEASONS = ("dry", "fall", "spring", "summer", "wet", "winter")


def clean_demand(panel: DataFrame, factor: float = 3.0) -> DataFrame:
    """Missing targets take the global mean, far ones are flattened to it."""
    return C.flatten_outliers(C.fill_global_mean(panel), factor=factor)


def province_features(panel: DataFrame, climate: DataFrame, test_from: str, holiday: Column) -> DataFrame:
    """Calendar, climate, history and context features of a panel with a climate by province; complete rows only.

    `panel` has `units` already cleaned. All lags, rolling and weighted means hang on one series window.
    """
    df = J.with_climate(panel, climate).withColumnRenamed("units", "sales")
    df = Wn.lags(df, "sales", [1, 7, 14, 28])
    df = Wn.rolling_stats(df, "sales", [7, 14, 28])
    df = Wn.ewma(df, "sales", [0.5, 0.75], adjust=True, aliases=[7, 14, 28]).drop("sales_ewma_0.5", "sales_ewma_0.75")
    df = df.withColumnsRenamed({c: c.replace("0.", "") for c in df.columns if "_ewma_0." in c})
    df = df.withColumns(
        {
            "is_test": F.col("date") >= F.lit(test_from).cast("date"),
            "year": F.year("date"),
            "month": F.month("date"),
            "day": F.day("date"),
            "quarter": F.quarter("date"),
            "day_of_week": D.weekday0("date"),
            "is_weekend": D.is_weekend("date"),
            "is_holiday": holiday,
            "store_item": X.pair_id(*PAIR),
            "temp_category": X.bin_label(F.col("temperature"), *X.TRAINING_TEMPERATURE),
            "humidity_level": X.bin_label(F.col("humidity"), *X.TRAINING_HUMIDITY),
        }
    )
    df = df.withColumns(
        X.level_indicators("season", SEASONS)
        | X.level_indicators("temp_category", X.TRAINING_TEMPERATURE[1])
        | X.level_indicators("humidity_level", X.TRAINING_HUMIDITY[1])
    ).drop("season", "temp_category", "humidity_level")
    df = Wn.same_day_context(Wn.same_day_context(df, "store_nbr", "sales"), "item_nbr", "sales")
    # One test on one array: a NULL test per column would multiply the optimizer's inferred constraints.
    unknown = F.array(*[F.col(c).isNull() for c in df.columns])
    return df.where(~F.exists(unknown, lambda v: v))


def clean_station_weather(
    raw: DataFrame, dense: Sequence[str], sparse: Sequence[str] = ("preciptotal",), codes: Sequence[str] = (), factor: float = 3.0
) -> DataFrame:
    """Code indicators, numbers from marked text, outlier repair of the dense measures, two-stage filling of all."""
    df = raw.withColumns(X.token_indicators("codesum", codes)).drop("codesum")
    df = C.clean_weather(df, [*dense, *sparse])
    df = C.repair_outliers(df, C.repairable_columns([*dense, *sparse], sparse), factor=factor)
    return C.fill_station_then_global(df, [*dense, *sparse])


def station_features(panel: DataFrame, weather: DataFrame, key: DataFrame, calendar: DataFrame) -> DataFrame:
    """Selling series joined with their station's weather, calendar flags, date parts and leak-free history.

    The series that never sell go first, before anything is joined to them. Days without weather go next, by the weather's
    keys alone, and the rest is written once with the columns that history needs. Series and both row contexts are sorted
    as such slim rows; readings, flags and date parts come to them last, by joins with the small tables.
    """
    selling = J.keep_pairs(panel, selling_pairs(panel))
    slim = C.flatten_outliers(materialize(C.fill_group_mean(selling), "filled"))
    rows = materialize(J.with_store_weather(slim, weather.select("date", "station_nbr"), key).select("date", "station_nbr", *PAIR, "units"), "cleaned")
    df = Wn.lags(rows, "units", [1, 2, 3, 4, 5, 6, 7, 14, 21, 28])
    df = Wn.rolling_stats(df, "units", [7, 14, 28])
    df = Wn.ewma(df, "units", [0.5, 0.75])
    df = df.withColumnsRenamed({c: c.replace("0.", "") for c in df.columns if "_ewma_0." in c})
    history = [c for c in df.columns if c not in rows.columns]
    contexts = []
    for key, tie in (PAIR, PAIR[::-1]):
        context = Wn.row_context(rows.drop("station_nbr"), key, tie).drop("units")
        df, contexts = df.join(context, ["date", *PAIR]), contexts + [c for c in context.columns if c not in rows.columns]
    df = df.withColumn("logunits", X.log_units(F.col("units"))).join(weather, ["date", "station_nbr"])
    df = D.with_date_parts(J.with_calendar(df, calendar))
    last = [c for c in df.columns if c not in ("date", *PAIR, *history, *contexts)]
    return df.select("date", *PAIR, *[F.col(f"`{c}`") for c in (*last, *history, *contexts)])

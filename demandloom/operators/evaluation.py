"""Forecast error tables. `y` is the actual, `yhat` the forecast; rows without a forecast are left out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom import PAIR
from demandloom.functions import dates as D
from demandloom.functions import metrics as M
from demandloom.operators import aggregates as A
from demandloom.operators import joins as J


def score(df: DataFrame, by: Sequence = (), y: str = "y", yhat: str = "yhat") -> DataFrame:
    """MAE, RMSE, WAPE and row count, per group when given."""
    return df.groupBy(*by).agg(
        M.mae(y, yhat).alias("mae"), M.rmse(y, yhat).alias("rmse"), M.wape(y, yhat).alias("wape"), M.scored(y, yhat).alias("n")
    )


def mape_by(df: DataFrame, by: Sequence = PAIR, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """MAPE with the number of zero actuals it skips."""
    return df.groupBy(*by).agg(M.mape(y, yhat).alias("mape"), M.zero_actuals(y, yhat).alias("zero_actuals"))


def two_level_summary(df: DataFrame, keys: Sequence[str] = PAIR, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """MAE and RMSE as plain means over the series, WAPE pooled over all rows. One pass: series sums, then their sums."""
    e = M.error(y, yhat)
    per_series = df.groupBy(*keys).agg(
        M.mae(y, yhat).alias("mae"),
        M.rmse(y, yhat).alias("rmse"),
        F.sum(F.abs(e)).alias("_e"),
        F.sum(F.when(e.isNotNull(), F.abs(F.col(y)))).alias("_y"),
    )
    return per_series.agg(
        F.avg("mae").alias("mae"),
        F.avg("rmse").alias("rmse"),
        (F.try_divide(F.sum("_e"), F.sum("_y")) * 100).alias("wape"),
        F.count("mae").alias("series"),
    )


def fold_summary(df: DataFrame, fold: str = "fold", y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Mean of the fold scores."""
    folds = score(df.where(F.col(fold).isNotNull()), [fold], y, yhat)
    return folds.agg(F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"), F.avg("wape").alias("wape"), F.count("*").alias("folds"))


def with_errors(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    return df.withColumns(
        {"error": M.error(y, yhat), "abs_error": F.abs(M.error(y, yhat)), "pct_error": M.percent_error(y, yhat)}
    )


def monthly_error(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Mean errors by month name and the ratio of mean error to mean actual."""
    scored = with_errors(df.where(F.col(yhat).isNotNull()), y, yhat)
    return scored.groupBy(D.month_name("date").alias("month")).agg(
        F.avg("error").alias("error"),
        F.avg("abs_error").alias("abs_error"),
        F.avg(y).alias("actual"),
        (F.try_divide(F.avg("abs_error"), F.avg(y)) * 100).alias("error_pct"),
    )


def error_by_date(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    return df.groupBy("date").agg(F.avg(M.error(y, yhat)).alias("error"))


def error_by_weekday(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Mean percent error, Monday first; a weekday without rows is there with NULL."""
    return A.weekday_means(df.withColumn("_p", M.percent_error(y, yhat)), "_p").withColumnRenamed("mean", "pct_error")


def error_by_category(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    scores = df.groupBy("category").agg(F.avg(M.percent_error(y, yhat)).alias("pct_error"))
    return scores.orderBy(F.desc("pct_error"), "category")


def error_histogram(df: DataFrame, bins: int = 50, y: str = "y", yhat: str = "yhat") -> DataFrame:
    return A.histogram(df.select(M.error(y, yhat).alias("error")), "error", bins)


def error_against_actual(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    return df.select(*PAIR, "date", F.col(y).alias("actual"), M.error(y, yhat).alias("error"))


def forecast_report(df: DataFrame, items: Sequence[int], n: int = 20, y: str = "y", yhat: str = "yhat") -> dict[str, DataFrame]:
    """Evaluation tables of the `n` largest series: roll-ups, errors by period and group, distribution, error matrix."""
    largest = J.keep_pairs(df, J.top_pairs(df, y, n))
    return {
        "scores": score(largest, PAIR, y, yhat),
        "rollups": A.actual_and_forecast(largest, y, yhat),
        "by_date": error_by_date(largest, y, yhat),
        "by_weekday": error_by_weekday(largest, y, yhat),
        "by_category": error_by_category(largest, y, yhat),
        "distribution": error_histogram(largest, 50, y, yhat),
        "pairs": error_against_actual(largest, y, yhat),
        "matrix": A.error_matrix(largest, items, y, yhat),
    }


def store_overlay(df: DataFrame, store: int, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Actual and forecast of all items of a store, ready for small multiples."""
    return df.where(F.col("store_nbr") == store).select("item_nbr", "date", y, yhat).orderBy("item_nbr", "date")

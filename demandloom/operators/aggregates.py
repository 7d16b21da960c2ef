"""Roll-ups, reports and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandloom import PAIR
from demandloom.functions import dates as D
from demandloom.functions import metrics as M
from demandloom.operators.quantiles import exact_quantiles, long_columns
from demandloom.operators.windows import safe_corr


def selling_pairs(df: DataFrame, value: str = "units", keys: Sequence[str] = PAIR, *, by_mean: bool = False) -> DataFrame:
    """Series whose total (or mean) is positive."""
    measure = F.avg(value) if by_mean else F.sum(value)
    return df.groupBy(*keys).agg(measure.alias("_m")).where(F.col("_m") > 0).select(*keys)


def stores_per_item(pairs: DataFrame, n: int = 20) -> DataFrame:
    return pairs.groupBy("item_nbr").agg(F.count("*").alias("stores")).orderBy(F.desc("stores"), "item_nbr").limit(n)


def availability(pairs: DataFrame, stores: Sequence[int]) -> DataFrame:
    """Item × store matrix of 0/1 for the listed stores."""
    wide = pairs.groupBy("item_nbr").pivot("store_nbr", list(stores)).agg(F.max(F.lit(1)))
    return wide.select("item_nbr", *[F.coalesce(F.col(str(s)), F.lit(0)).alias(f"store_{s}") for s in stores])


def coverage(pairs: DataFrame) -> DataFrame:
    """Pairs, stores, items and the share of all combinations sold."""
    full = F.count_distinct("store_nbr") * F.count_distinct("item_nbr")
    return pairs.agg(
        F.count("*").alias("pairs"),
        F.count_distinct("store_nbr").alias("stores"),
        F.count_distinct("item_nbr").alias("items"),
        (F.try_divide(F.count("*"), full) * 100).alias("coverage_pct"),
    )


def distribution_report(df: DataFrame, n: int = 20) -> DataFrame:
    """Per item: stores carrying it and share of stores; only the `n` widest, with the overall coverage on each row."""
    pairs = selling_pairs(df)
    total = coverage(pairs).select(F.struct("stores", "coverage_pct")).scalar()
    return (
        stores_per_item(pairs, n)
        .withColumn("_t", total)
        .select(
            "item_nbr",
            "stores",
            (F.col("stores") / F.col("_t.stores") * 100).alias("store_pct"),
            F.col("_t.coverage_pct").alias("coverage_pct"),
        )
    )


def null_report(df: DataFrame) -> DataFrame:
    """`column, nulls, ratio_pct` in one pass."""
    counts = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot(["_n"], list(df.columns), "column", "nulls").select(
        "column", "nulls", (F.bround(F.col("nulls") / F.col("_n"), 4) * 100).alias("ratio_pct")
    )


def column_profile(df: DataFrame, *, approximate: bool = False) -> DataFrame:
    """Type, NULLs, non-NULLs and distinct values (NULL counting as one) per column.

    Exact distinct counts are taken from per-column value counts, two plain aggregations for any number of columns.
    """
    entries = F.array(
        *[F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.col(c).cast("string").alias("v")) for c, t in df.dtypes]
    )
    tall = df.select(F.inline(entries))
    if approximate:
        return tall.groupBy("column", "dtype").agg(
            F.count_if(F.col("v").isNull()).alias("nulls"),
            F.count("v").alias("non_nulls"),
            (F.approx_count_distinct("v") + F.max(F.col("v").isNull().cast("int"))).alias("distinct"),
        )
    return (
        tall.groupBy("column", "dtype", "v")
        .agg(F.count("*").alias("n"))
        .groupBy("column", "dtype")
        .agg(
            F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
            F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("non_nulls"),
            F.count("*").alias("distinct"),
        )
    )


# Percentiles of the description table.
DESCRIBE_PROBS = (0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 0.999)


def describe(df: DataFrame, columns: Sequence[str], probs: Sequence[float] = DESCRIBE_PROBS) -> DataFrame:
    """Mean, deviation, extremes and exact percentiles (`q0` …) per column."""
    tall = long_columns(df, columns)
    moments = tall.groupBy("column").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    return moments.join(exact_quantiles(tall, "value", probs, ["column"]).drop("n"), "column")


def extent(df: DataFrame, columns: Sequence[str], date: str = "date") -> DataFrame:
    """First and last day and distinct counts."""
    return df.agg(
        F.min(date).alias("first_date"), F.max(date).alias("last_date"), *[F.count_distinct(c).alias(f"n_{c}") for c in columns]
    )


def total_by(df: DataFrame, keys: str | Sequence[str], value: str = "units", name: str = "total") -> DataFrame:
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*keys).agg(F.sum(value).alias(name))


def ranked_totals(df: DataFrame, key: str, value: str = "units", n: int | None = None, *, ascending: bool = False) -> DataFrame:
    """Totals from the largest down (or up), ties by key; the first `n` when given."""
    ordered = total_by(df, key, value).orderBy(F.asc("total") if ascending else F.desc("total"), key)
    return ordered if n is None else ordered.limit(n)


def weekday_means(df: DataFrame, value: str = "units", date: str = "date") -> DataFrame:
    """Mean by weekday, Monday first; a weekday without rows is there with NULL."""
    names = F.element_at(F.array(*map(F.lit, D.WEEKDAY_NAMES)), (F.col("id") + 1).cast("int"))
    spine = df.sparkSession.range(7).select(F.col("id").cast("int").alias("weekday"), names.alias("weekday_name"))
    means = df.groupBy(D.weekday0(date).alias("weekday")).agg(F.avg(value).alias("mean"))
    return spine.join(means, "weekday", "left")


def weekday_extremes(means: DataFrame) -> DataFrame:
    """Mean of the weekday means, best and worst weekday; the earlier one on a tie."""
    early, late = F.struct("mean", -F.col("weekday")), F.struct("mean", "weekday")
    return means.where(F.col("mean").isNotNull()).agg(
        F.avg("mean").alias("overall"),
        F.max_by("weekday_name", early).alias("best_day"),
        F.max("mean").alias("best_mean"),
        F.min_by("weekday_name", late).alias("worst_day"),
        F.min("mean").alias("worst_mean"),
    )


def with_share(totals: DataFrame, value: str = "total", digits: int = 1) -> DataFrame:
    """Percent of the column sum."""
    whole = totals.select(F.sum(value)).scalar()
    return totals.withColumn("share_pct", F.round(F.try_divide(F.col(value), whole) * 100, digits))


def kpi_block(df: DataFrame, start: str, end: str, value: str = "units") -> DataFrame:
    """Total, mean daily total, change between the halves of the period, row count and value per row."""
    middle = D.midpoint(F.lit(start).cast("date"), F.lit(end).cast("date"))
    rows = F.sum("transactions") if "transactions" in df.columns else F.count("*")
    daily = df.groupBy("date").agg(F.sum(value).alias("v"), rows.alias("rows"))
    first = F.coalesce(F.sum(F.when(F.col("date") <= middle, F.col("v"))), F.lit(0.0))
    second = F.coalesce(F.sum(F.when(F.col("date") > middle, F.col("v"))), F.lit(0.0))
    change = F.when((F.count("*") >= 2) & (first > 0), F.try_divide(second - first, first) * 100).otherwise(0.0)
    return daily.agg(
        F.sum("v").alias("total"),
        F.avg("v").alias("mean_daily"),
        change.alias("change_pct"),
        F.sum("rows").alias("transactions"),
        F.coalesce(F.try_divide(F.sum("v"), F.sum("rows")), F.lit(0.0)).alias("per_transaction"),
    )


def actual_and_forecast(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Totals by day, by store and day and by item and day in one grouping-sets pass; `level` names the set."""
    sums = df.groupingSets(
        [["date"], ["store_nbr", "date"], ["item_nbr", "date"]], "date", "store_nbr", "item_nbr"
    ).agg(
        F.sum(y).alias("actual"), F.sum(yhat).alias("forecast"), F.grouping("store_nbr").alias("_s"), F.grouping("item_nbr").alias("_i")
    )
    level = F.when(F.col("_s") == 0, "store").when(F.col("_i") == 0, "item").otherwise("all")
    return sums.select(level.alias("level"), "date", "store_nbr", "item_nbr", "actual", "forecast")


def error_matrix(df: DataFrame, items: Sequence[int], y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Store × item matrix of MAPE for the listed items."""
    wide = df.groupBy("store_nbr").pivot("item_nbr", list(items)).agg(M.mape(y, yhat))
    return wide.select("store_nbr", *[F.col(str(i)).alias(f"item_{i}") for i in items])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(column)


def present_counts(df: DataFrame, key: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(*[F.count(c).alias(f"n_{c}") for c in columns])


def items_by_store(df: DataFrame) -> DataFrame:
    """One row per store and item with its rows, beside the store's row and item counts (long instead of a list)."""
    cells = df.groupBy(*PAIR).agg(F.count("*").alias("item_rows"))
    stores = cells.groupBy("store_nbr").agg(F.sum("item_rows").alias("store_rows"), F.count("*").alias("store_items"))
    return cells.join(stores, "store_nbr")


def top_and_others(df: DataFrame, key: str, value: str = "units", n: int = 5) -> DataFrame:
    """The `n` largest totals and the rest as "Others", which is left out unless positive."""
    totals = total_by(df, key, value)
    top = totals.orderBy(F.desc("total"), key).limit(n).select(key, F.lit(True).alias("_top"))
    label = F.when(F.col("_top"), F.col(key).cast("string")).otherwise("Others")
    grouped = totals.join(top, key, "left").groupBy(label.alias(key), F.coalesce("_top", F.lit(False)).alias("_top")).agg(
        F.sum("total").alias("total")
    )
    return grouped.where(F.col("_top") | (F.col("total") > 0)).drop("_top")


def histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between the extremes, the last one closed: `bin, low, high, n`; empty bins included."""
    span = df.select(F.struct(F.min(value).alias("a"), F.max(value).alias("b"))).scalar()
    width = (F.col("_span.b") - F.col("_span.a")) / bins
    place = F.least(F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("_span.a"), width)), F.lit(0)), F.lit(bins - 1))
    counts = (
        df.where(F.col(value).isNotNull()).withColumn("_span", span).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    )
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    edges = spine.withColumn("_span", span).select(
        "bin", (F.col("_span.a") + F.col("bin") * width).alias("low"), (F.col("_span.a") + (F.col("bin") + 1) * width).alias("high")
    )
    return edges.join(counts, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def center(df: DataFrame, value: str) -> DataFrame:
    """Mean and exact median."""
    middle = exact_quantiles(df, value, [0.5]).select("q0").scalar()
    return df.agg(F.avg(value).alias("mean")).withColumn("median", middle)


def box_summary(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Quartiles, whiskers at the last values within 1.5·IQR, and the number of values beyond."""
    keys = list(by)
    quartiles = exact_quantiles(df, value, [0.25, 0.5, 0.75], keys).select(
        *keys, F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3")
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        df.select(*keys, value)
        .join(quartiles, keys)
        .groupBy(*keys)
        .agg(
            F.max("q1").alias("q1"),
            F.max("median").alias("median"),
            F.max("q3").alias("q3"),
            F.min(F.when(inside, F.col(value))).alias("whisker_low"),
            F.max(F.when(inside, F.col(value))).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`a, b, corr` for every pair of columns, a before b, over the rows where both are known. One pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[safe_corr(a, b).alias(f"_c{k}") for k, (a, b) in enumerate(pairs)])
    entries = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_c{k}").alias("corr")) for k, (a, b) in enumerate(pairs)]
    return one.select(F.inline(F.array(*entries)))


def correlation_with(df: DataFrame, target: str, columns: Sequence[str], n: int | None = None) -> DataFrame:
    """Features by signed correlation with the target, highest first; with `n`, the n largest, the target among them."""
    features = [c for c in columns if c != target] + ([target] if n else [])
    one = df.agg(*[safe_corr(c, target).alias(c) for c in features])
    tall = one.unpivot([], features, "feature", "corr").orderBy(F.desc_nulls_last("corr"), "feature")
    return tall if n is None else tall.limit(n)


def trend_line(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Slope, intercept and R² of y on x."""
    return df.groupBy(*by).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n")
    )


def year_profile(df: DataFrame, years: Sequence[int], value: str = "units") -> DataFrame:
    """Totals by month and day with one column per year."""
    wide = (
        df.select(F.month("date").alias("month"), F.day("date").alias("day"), F.year("date").alias("_y"), value)
        .groupBy("month", "day")
        .pivot("_y", list(years))
        .agg(F.sum(value))
    )
    return wide.select("month", "day", *[F.col(str(y)).alias(f"y{y}") for y in years])


def latest_rows(df: DataFrame, n: int = 5, keys: Sequence[str] = PAIR, date: str = "date") -> DataFrame:
    """The newest `n` rows of every series, `recency` 1 the newest."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(date)))
    return df.withColumn("recency", place).where(F.col("recency") <= n)


def history_stats(df: DataFrame, value: str = "units", keys: Sequence[str] = PAIR, date: str = "date") -> DataFrame:
    """Last value and day, mean, maximum and its (first) day, period."""
    first_high = F.struct(F.col(value), -F.unix_date(date))
    return df.groupBy(*keys).agg(
        F.max_by(value, date).alias("last_value"),
        F.max(date).alias("last_date"),
        F.avg(value).alias("mean"),
        F.max(value).alias("max"),
        F.max_by(date, first_high).alias("max_date"),
        F.min(date).alias("first_date"),
        F.count("*").alias("n"),
    )


def mean_by(df: DataFrame, keys: Sequence[str | Column], columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])

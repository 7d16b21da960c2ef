"""Demand panels over the order tables: sales by day, store and item, weather, calendar and their derivatives.

A panel holds one row per (date, store, item), so a single series is never longer than the calendar, however many
order lines one store or item draws. The pre-aggregation runs map-side before its one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandloom import PAIR
from demandloom.functions import dates as D

TEST_START = "2001-01-01"
VALID_START = "2000-07-01"

# Holidays and long weekends of the panel's years; three days are listed twice.
CALENDAR_ROWS = (
    ("1995-01-02", 1, 0), ("1995-07-04", 1, 0), ("1995-11-23", 1, 0), ("1995-11-24", 1, 0), ("1995-11-24", 0, 1),
    ("1995-11-25", 0, 2), ("1995-12-25", 1, 0), ("1996-01-01", 1, 0), ("1996-07-04", 1, 0), ("1996-11-28", 1, 0),
    ("1996-11-29", 0, 1), ("1996-12-25", 1, 0), ("1997-01-01", 1, 0), ("1997-07-04", 1, 0), ("1997-11-27", 1, 0),
    ("1997-11-28", 1, 0), ("1997-11-28", 0, 1), ("1997-12-25", 1, 0), ("1998-01-01", 1, 0), ("1998-07-04", 1, 0),
    ("1998-11-26", 1, 0), ("1998-11-27", 0, 1), ("1998-12-25", 1, 0), ("1999-01-01", 1, 0), ("1999-07-04", 1, 0),
    ("1999-11-25", 1, 0), ("1999-11-26", 1, 0), ("1999-11-26", 0, 1), ("1999-12-25", 1, 0), ("2000-01-01", 1, 0),
    ("2000-07-04", 1, 0), ("2000-11-23", 1, 0), ("2000-11-24", 0, 1), ("2000-12-25", 1, 0), ("2001-01-01", 1, 0),
    ("2001-07-04", 1, 0),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def category_of(item: Column) -> Column:
    """Category by item number; the five names repeat."""
    names = F.array(*map(F.lit, ("Staples", "Dairy", "Beverages", "Household", "Baby")))
    return F.element_at(names, (item % 5 + 1).cast("int"))


def provinces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """store_nbr → province."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("store_nbr"), "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("province"))
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select("store_nbr", "province")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue: one row per item number."""
    return table(spark, sf_dir, "part").select(F.substring("p_brand", 7, 10).cast("int").alias("item_nbr")).distinct()


def sales(spark: SparkSession, sf_dir: str, *, province: bool = True) -> DataFrame:
    """Units by day, store and item, with category and (on request) province.

    Store and item attributes hang on the aggregate, not on the order lines, so that only the two key look-ups
    touch the large side.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_partkey", F.col("l_shipdate").cast("date").alias("date"), "l_quantity"
    )
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("store_nbr"))
    part = table(spark, sf_dir, "part").select(
        "p_partkey", F.substring("p_brand", 7, 10).cast("int").alias("item_nbr")
    )
    daily = (
        lines.join(supplier, lines.l_suppkey == supplier.s_suppkey)
        .join(part, lines.l_partkey == part.p_partkey)
        .groupBy("date", "store_nbr", "item_nbr")
        .agg(F.sum("l_quantity").alias("units"))
        .withColumn("category", category_of(F.col("item_nbr")))
    )
    if province:
        daily = daily.join(provinces(spark, sf_dir), "store_nbr")
    columns = ["date", "store_nbr", "item_nbr", *(["province"] if province else []), "category", "units"]
    return daily.select(*columns)


def ship_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days with at least one order line."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("date")).distinct()


def sales_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with some targets missing and some tripled."""
    mark = F.day("date") * 31 + F.col("store_nbr") * 7 + F.col("item_nbr") * 13
    return sales(spark, sf_dir).withColumn(
        "units",
        F.when(mark % 101 == 0, F.lit(None).cast("double"))
        .when(mark % 197 == 5, F.col("units") * 3)
        .otherwise(F.col("units")),
    )


def weather_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station readings by day as text with missing and trace marks and a code set."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("date"), "o_totalprice", "o_orderpriority"
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") % 20).alias("station_nbr"))

    def code(priority: str, token: str) -> Column:
        # A flag is kept in place by hash aggregation; the greatest string would sort all orders.
        return F.when(F.max(F.col("o_orderpriority") == priority), token)

    def reading(amount: str) -> Column:
        return F.floor(F.col(amount) / 5000).cast("int").cast("string")

    daily = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .groupBy("station_nbr", "date")
        .agg(
            F.max("o_orderkey").alias("k"),
            F.max("o_totalprice").alias("high"),
            F.min("o_totalprice").alias("low"),
            F.concat_ws(
                " ", code("1-URGENT", "RA"), code("2-HIGH", "SN"), code("3-MEDIUM", "BR"), code("4-NOT SPECIFIED", "FG+")
            ).alias("codesum"),
        )
    )
    k11 = F.col("k") % 11
    return daily.select(
        "station_nbr",
        "date",
        F.when(F.col("k") % 23 == 0, "M").otherwise(reading("high")).alias("tmax"),
        F.when(F.col("k") % 29 == 0, "-").otherwise(reading("low")).alias("tmin"),
        F.when(k11 == 0, "  T").when(k11 == 1, "T").when(k11 == 2, "M").when(k11 == 3, "2").otherwise("0").alias(
            "preciptotal"
        ),
        "codesum",
    )


def weather_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station readings as numbers, unreadable ones NULL, a trace counting 0.01."""
    from demandloom.operators.cleaning import clean_weather

    return clean_weather(weather_raw(spark, sf_dir), ["tmax", "tmin", "preciptotal"]).drop("codesum")


def store_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """store → station, many stores to one station."""
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("store_nbr"), (F.col("n_nationkey") % 20).alias("station_nbr")
    )


def climate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temperature, humidity and season by day and province."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("date")
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("store_nbr"))
    by_store = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .groupBy("date", "store_nbr")
        .agg(F.max("o_orderkey").alias("high"), F.min("o_orderkey").alias("low"))
    )
    wet = F.month("date").between(5, 10)
    return (
        by_store.join(provinces(spark, sf_dir), "store_nbr")
        .groupBy("date", "province")
        .agg(F.max("high").alias("high"), F.min("low").alias("low"))
        .select(
            "date",
            "province",
            ((F.col("high") % 250).cast("double") / 10 + 10).alias("temperature"),
            (F.col("low") % 56 + 40).cast("double").alias("humidity"),
            F.when(F.col("province") == "ASIA", F.when(wet, "wet").otherwise("dry"))
            .otherwise(F.lower(D.season_name("date")))
            .alias("season"),
        )
    )


def calendar(spark: SparkSession) -> DataFrame:
    """Holiday and long-weekend days; some days have two rows."""
    rows = spark.createDataFrame(list(CALENDAR_ROWS), "d string, holiday int, blackfriday int")
    return rows.select(
        F.col("d").cast("date").alias("date"),
        "holiday",
        "blackfriday",
        (F.col("blackfriday") > 0).cast("int").alias("isbf"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with `y` and a forecast: the mean of the series' previous seven rows."""
    w = W.partitionBy(*PAIR).orderBy("date")
    return sales(spark, sf_dir).select(
        "date",
        *PAIR,
        "province",
        "category",
        F.col("units").alias("y"),
        F.avg("units").over(w.rowsBetween(-7, -1)).alias("yhat"),
    )


# The features of the linear attribution model.
LINEAR_FEATURES = (
    "sales_lag_1",
    "sales_mean_7d",
    "day_of_week",
    "month",
    "temperature",
    "store_nbr",
    "item_nbr",
    "quarter",
)


def attribution_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sale with the features of the linear attribution model, as doubles, no NULLs."""
    w = W.partitionBy(*PAIR).orderBy("date")
    panel = sales(spark, sf_dir).join(climate(spark, sf_dir).select("date", "province", "temperature"), ["date", "province"])
    return (
        panel.withColumns(
            {
                "sales_lag_1": F.lag("units", 1).over(w),
                "sales_mean_7d": F.avg("units").over(w.rowsBetween(-7, -1)),
                "day_of_week": D.weekday0("date").cast("double"),
                "month": F.month("date").cast("double"),
                "quarter": F.quarter("date").cast("double"),
            }
        )
        .dropna(subset=["sales_lag_1"])
        .select(
            F.concat_ws("_", "store_nbr", "item_nbr", F.date_format("date", "yyyy-MM-dd")).alias("row_id"),
            "date",
            F.col("units").alias("y"),
            *[F.col(c).cast("double").alias(c) for c in LINEAR_FEATURES],
        )
    )

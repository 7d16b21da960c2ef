"""Scalar transforms, calendar parts, binning and factors."""

from pyspark.sql import functions as F

from demandloom import PAIR, schema
from demandloom.functions import dates as D
from demandloom.functions import scalars as X
from demandloom.operators import joins as J
from demandloom.plans.common import r6, rounded
from demandloom.plans.registry import query
from demandloom.sources import panels


def _days(spark, d):
    return panels.ship_days(spark, d)


@query("prj4_log1p", f"SELECT date, store_nbr, item_nbr, {r6('ln(1 + units)', 'logunits')} FROM sales")
def _(spark, d):
    panel = panels.sales(spark, d, province=False)
    return rounded(panel.select("date", *PAIR, X.log_units(F.col("units")).alias("logunits")))


@query("prj5_expm1_floor", f"SELECT date, store_nbr, item_nbr, {r6('greatest(exp((units - 20) / 10) - 1, 0)', 'units')} FROM sales")
def _(spark, d):
    panel = panels.sales(spark, d, province=False)
    return rounded(panel.select("date", *PAIR, X.unlog_floor((F.col("units") - 20) / 10).alias("units")))


@query("prj6_pair_key", "SELECT DISTINCT concat_ws('_', store_nbr, item_nbr) AS store_item FROM sales")
def _(spark, d):
    return panels.sales(spark, d, province=False).select(X.pair_id(*PAIR).alias("store_item")).distinct()


@query("prj7_label_cast", "SELECT CAST(item_nbr AS VARCHAR) AS label, sum(units) AS total FROM sales GROUP BY 1")
def _(spark, d):
    panel = panels.sales(spark, d, province=False)
    return panel.groupBy(F.col("item_nbr").cast("string").alias("label")).agg(F.sum("units").alias("total"))


@query(
    "prj8_display_format",
    """SELECT store_nbr, '$' || format('{:,.2f}', sum(units)) AS total, format('{:,}', count(*)) AS n,
              'Sales Mean 7d' AS title FROM sales GROUP BY 1""",
)
def _(spark, d):
    totals = panels.sales(spark, d, province=False).groupBy("store_nbr").agg(F.sum("units").alias("t"), F.count("*").alias("n"))
    return totals.select(
        "store_nbr",
        X.money_text(F.col("t")).alias("total"),
        F.format_number("n", 0).alias("n"),
        X.title_text(F.lit("sales_mean_7d")).alias("title"),
    )


@query("prj9_file_token", "SELECT p_partkey, regexp_replace(p_name || '/' || p_type, '[ /]', '_', 'g') AS token FROM part")
def _(spark, d):
    part = panels.table(spark, d, "part")
    return part.select("p_partkey", X.file_token(F.concat_ws("/", "p_name", "p_type")).alias("token"))


@query("prj10_leading_id", "SELECT p_partkey, CAST(p_partkey AS INT) AS id FROM part")
def _(spark, d):
    option = F.concat_ws(" - ", F.col("p_partkey").cast("string"), "p_name")
    return panels.table(spark, d, "part").select("p_partkey", X.leading_id(option).alias("id"))


@query(
    "dt1_date_parts",
    """SELECT date, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, CAST(day(date) AS INT) AS day,
              CAST(quarter(date) AS INT) AS quarter FROM ship_days""",
)
def _(spark, d):
    return _days(spark, d).select("date", F.year("date").alias("year"), F.month("date").alias("month"), F.day("date").alias("day"), F.quarter("date").alias("quarter"))


@query("dt2_weekday", "SELECT date, CAST(isodow(date) - 1 AS INT) AS day_of_week FROM ship_days")
def _(spark, d):
    return _days(spark, d).select("date", D.weekday0("date").alias("day_of_week"))


@query(
    "dt3_year_day_week",
    "SELECT date, CAST(dayofyear(date) AS INT) AS day_of_year, CAST(weekofyear(date) AS INT) AS week_of_year FROM ship_days",
)
def _(spark, d):
    return _days(spark, d).select("date", F.dayofyear("date").alias("day_of_year"), F.weekofyear("date").alias("week_of_year"))


@query(
    "dt4_week_and_half_flags",
    """SELECT date, CAST(isodow(date) >= 6 AS INT) AS is_weekend, CAST(isodow(date) > 4 AS INT) AS weekindicator,
              CAST(month(date) > 3 AND month(date) < 10 AS INT) AS half FROM ship_days""",
)
def _(spark, d):
    return _days(spark, d).select(
        "date", D.is_weekend("date").alias("is_weekend"), D.late_week("date").alias("weekindicator"), D.warm_half("date").alias("half")
    )


@query(
    "dt5_season",
    """SELECT date, CASE WHEN month(date) IN (12, 1, 2) THEN 0 WHEN month(date) IN (3, 4, 5) THEN 1
              WHEN month(date) IN (6, 7, 8) THEN 2 ELSE 3 END AS season,
              CASE WHEN month(date) IN (12, 1, 2) THEN 'Winter' WHEN month(date) IN (3, 4, 5) THEN 'Spring'
              WHEN month(date) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END AS season_name FROM ship_days""",
)
def _(spark, d):
    return _days(spark, d).select("date", D.season_code("date").alias("season"), D.season_name("date").alias("season_name"))


@query(
    "dt6_names",
    "SELECT date, dayname(date) AS weekday, monthname(date) AS month, strftime(date, '%Y-%m') AS ym FROM ship_days",
)
def _(spark, d):
    return _days(spark, d).select("date", D.weekday_name("date").alias("weekday"), D.month_name("date").alias("month"), D.year_month("date").alias("ym"))


@query(
    "dt7_listed_holidays",
    """SELECT date, CAST(date IN (DATE '1998-01-01', DATE '1998-07-04', DATE '1999-12-25') AS INT) AS is_holiday
       FROM ship_days""",
)
def _(spark, d):
    listed = ("1998-01-01", "1998-07-04", "1999-12-25")
    return _days(spark, d).select("date", D.listed_day("date", listed).alias("is_holiday"))


@query(
    "dt8_holiday_table",
    """SELECT s.date, s.store_nbr, s.item_nbr, CAST(h.date IS NOT NULL AS INT) AS is_holiday
       FROM sales s LEFT JOIN (SELECT DISTINCT date FROM calendar WHERE holiday = 1) h ON s.date = h.date""",
)
def _(spark, d):
    panel = panels.sales(spark, d, province=False).select("date", *PAIR)
    return J.holiday_flag(panel, panels.calendar(spark).where("holiday = 1"))


@query(
    "dt9_black_friday",
    """WITH t AS (
         SELECT date, make_date(year(date), 11, 1) + CAST((11 - isodow(make_date(year(date), 11, 1))) % 7 + 21 AS INT) AS turkey
         FROM ship_days)
       SELECT date, CASE WHEN date - turkey BETWEEN 1 AND 4 THEN CAST(date - turkey AS INT) ELSE 0 END AS blackfriday,
              CASE WHEN date - turkey BETWEEN 1 AND 4 THEN 1 ELSE 0 END AS isbf FROM t""",
)
def _(spark, d):
    rank = D.black_friday_rank("date")
    return _days(spark, d).select("date", rank.alias("blackfriday"), (rank > 0).cast("int").alias("isbf"))


@query(
    "dt11_date_range",
    """SELECT CAST(unnest(generate_series(CAST((SELECT min(date) FROM sales) AS TIMESTAMP),
              CAST((SELECT max(date) FROM sales) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date""",
)
def _(spark, d):
    span = panels.sales(spark, d, province=False).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    return span.select(F.explode(F.sequence("a", "b")).alias("date"))


@query(
    "dt12_offset_window",
    """SELECT date AS event_date, CAST(date + CAST(k AS INT) AS DATE) AS date FROM ship_days,
              (SELECT unnest([-3, -2, -1, 0, 1, 2, 3]) AS k) o""",
)
def _(spark, d):
    return _days(spark, d).select(F.col("date").alias("event_date"), F.explode(D.window_days("date", 3, 3)).alias("date"))


@query(
    "dt13_midpoint",
    """SELECT store_nbr, item_nbr, min(date) + CAST((max(date) - min(date)) // 2 AS INT) AS mid FROM sales GROUP BY 1, 2""",
)
def _(spark, d):
    span = panels.sales(spark, d, province=False).groupBy(*PAIR).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    return span.select(*PAIR, D.midpoint("a", "b").alias("mid"))


@query(
    "mth1_right_closed_bins",
    """SELECT date, province, CASE WHEN temperature <= 20 THEN 'Cold' WHEN temperature <= 25 THEN 'Cool'
              WHEN temperature <= 30 THEN 'Warm' ELSE 'Hot' END AS temp_category,
              CASE WHEN humidity <= 60 THEN 'Low' WHEN humidity <= 75 THEN 'Medium' ELSE 'High' END AS humidity_level
       FROM climate""",
)
def _(spark, d):
    return panels.climate(spark, d).select(
        "date",
        "province",
        X.bin_label(F.col("temperature"), *X.TRAINING_TEMPERATURE).alias("temp_category"),
        X.bin_label(F.col("humidity"), *X.TRAINING_HUMIDITY).alias("humidity_level"),
    )


@query(
    "mth2_left_closed_bins",
    """SELECT date, province, CASE WHEN temperature < 15 THEN 'Cool' WHEN temperature < 25 THEN 'Warm' ELSE 'Hot' END
              AS temp_category,
              CASE WHEN humidity < 40 THEN 'Low' WHEN humidity < 70 THEN 'Medium' ELSE 'High' END AS humidity_level
       FROM climate""",
)
def _(spark, d):
    return panels.climate(spark, d).select(
        "date",
        "province",
        X.bin_label(F.col("temperature"), *X.SCENARIO_TEMPERATURE, right_closed=False).alias("temp_category"),
        X.bin_label(F.col("humidity"), *X.SCENARIO_HUMIDITY, right_closed=False).alias("humidity_level"),
    )


@query(
    "mth3_indicators",
    """SELECT date, province, CAST(season = 'fall' AS INT) AS season_fall, CAST(season = 'spring' AS INT) AS season_spring,
              CAST(season = 'summer' AS INT) AS season_summer, CAST(season = 'wet' AS INT) AS season_wet,
              CAST(season = 'winter' AS INT) AS season_winter,
              CAST(temperature > 20 AND temperature <= 25 AS INT) AS temp_Cool,
              CAST(temperature > 25 AND temperature <= 30 AS INT) AS temp_Warm, CAST(temperature > 30 AS INT) AS temp_Hot
       FROM climate""",
)
def _(spark, d):
    binned = panels.climate(spark, d).withColumn("temp", X.bin_label(F.col("temperature"), *X.TRAINING_TEMPERATURE))
    wide = binned.withColumns(
        X.level_indicators("season", ["dry", "fall", "spring", "summer", "wet", "winter"])
        | X.level_indicators("temp", X.TRAINING_TEMPERATURE[1])
    )
    return wide.drop("temperature", "humidity", "season", "temp")


@query(
    "mth4_token_indicators",
    """SELECT station_nbr, date, """
    + ", ".join(
        f"""CAST(list_contains(string_split(coalesce(codesum, ''), ' '), '{c}') AS INT) AS "{c}\""""
        for c in schema.WEATHER_CODES
    )
    + " FROM weather_raw",
)
def _(spark, d):
    weather = panels.weather_raw(spark, d).select("station_nbr", "date", "codesum")
    return weather.withColumns(X.token_indicators("codesum", schema.WEATHER_CODES)).drop("codesum")


@query(
    "mth5_sentinels",
    """SELECT station_nbr, date, TRY_CAST(tmax AS DOUBLE) AS tmax, TRY_CAST(tmin AS DOUBLE) AS tmin,
         CASE WHEN preciptotal = 'T' THEN 0.01 WHEN preciptotal = '  T' THEN NULL ELSE TRY_CAST(preciptotal AS DOUBLE) END AS p_as_is,
         CASE WHEN trim(preciptotal) = 'T' THEN 0.0 ELSE TRY_CAST(preciptotal AS DOUBLE) END AS p_zero,
         CASE WHEN trim(preciptotal) = 'T' THEN 0.01 ELSE TRY_CAST(preciptotal AS DOUBLE) END AS p_trimmed
       FROM weather_raw""",
)
def _(spark, d):
    rain = F.col("preciptotal")
    return panels.weather_raw(spark, d).select(
        "station_nbr",
        "date",
        X.sentinel_number(F.col("tmax")).alias("tmax"),
        X.sentinel_number(F.col("tmin")).alias("tmin"),
        X.sentinel_number(rain, trim=False).alias("p_as_is"),
        X.sentinel_number(rain, trace_value=0.0).alias("p_zero"),
        X.sentinel_number(rain).alias("p_trimmed"),
    )


@query(
    "mth6_coerce_numeric",
    """SELECT station_nbr, date, TRY_CAST(tmax AS DOUBLE) AS tmax, TRY_CAST(tmin AS DOUBLE) AS tmin,
              TRY_CAST(preciptotal AS DOUBLE) AS preciptotal FROM weather_raw""",
)
def _(spark, d):
    return X.coerce_numeric(panels.weather_raw(spark, d).drop("codesum"), ["station_nbr", "date"])


@query(
    "mth7_zscore",
    f"""SELECT date, province, {r6("(temperature - 22.5) / 7.25", "temperature")}, humidity FROM climate""",
)
def _(spark, d):
    stats = {"temperature": (22.5, 7.25), "humidity": (60.0, None)}
    climate = panels.climate(spark, d).drop("season")
    return rounded(climate.withColumns({c: X.zscore(F.col(c), *stats[c]) for c in stats}))


@query("mth8_coalesce", "SELECT station_nbr, date, coalesce(tmax, tmin) AS temp FROM weather_numeric")
def _(spark, d):
    return panels.weather_numeric(spark, d).select("station_nbr", "date", F.coalesce("tmax", "tmin").alias("temp"))


@query(
    "mth9_clamp_round",
    """SELECT date, province, greatest(45.0, least(80.0, humidity)) AS humidity, round(temperature / 3, 1) AS temperature,
              round_even(temperature, 0) AS whole, greatest(1.0, temperature - 20) AS floored FROM climate""",
)
def _(spark, d):
    temperature = F.col("temperature")
    return panels.climate(spark, d).select(
        "date",
        "province",
        X.clamp(F.col("humidity"), 45.0, 80.0).alias("humidity"),
        F.round(temperature / 3, 1).alias("temperature"),
        F.bround(temperature).alias("whole"),
        F.greatest(F.lit(1.0), temperature - 20).alias("floored"),
    )


def _scenario_columns():
    key = F.col("store_nbr") + F.day("date")
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (key % len(names) + 1).cast("int"))
    event = pick(["Sale/Promotion", "Local Event", "Inventory Clearance", "New Product Launch", "None"])
    return {
        "event_pct": X.lookup(event, X.EVENT_DEFAULT_PCT, 0.0),
        "weather": pick(list(X.WEATHER_FACTOR)),
        "competition": pick(list(X.COMPETITION_FACTOR)),
        "supply": pick(list(X.SUPPLY_FACTOR)),
    }


@query(
    "mth10_scenario_factor",
    f"""WITH k AS (SELECT date, store_nbr, item_nbr, store_nbr + day(date) AS k FROM sales)
        SELECT date, store_nbr, item_nbr, {r6('''
          (CASE k % 5 WHEN 0 THEN 20 WHEN 1 THEN 10 WHEN 2 THEN -10 WHEN 3 THEN 50 ELSE 0 END / 100.0 + 1)
          * CASE k % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.95 WHEN 2 THEN 0.9 WHEN 3 THEN 0.8 ELSE 0.7 END
          * CASE k % 3 WHEN 0 THEN 1.1 WHEN 1 THEN 1.0 ELSE 0.9 END
          * CASE k % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 1.0 ELSE 1.05 END
          * CASE WHEN isodow(date) >= 6 THEN 1.15 ELSE 1.0 END::DOUBLE''', 'factor')} FROM k""",
)
def _(spark, d):
    panel = panels.sales(spark, d, province=False).select("date", *PAIR).withColumns(_scenario_columns())
    factor = X.scenario_factor(F.col("event_pct"), F.col("weather"), F.col("competition"), F.col("supply"), F.col("date"))
    return rounded(panel.select("date", *PAIR, factor.alias("factor")))

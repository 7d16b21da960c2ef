import datetime as dt

import pytest
from pyspark.sql import functions as F

from demandloom import schema
from demandloom.operators import joins as J
from demandloom.sources import files, panels
from tests.conftest import rows


def test_unknown_format_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown format"):
        files.write_table(spark.range(1), str(tmp_path / "t"), "feather")


def test_missing_paths_fall_back(spark, tmp_path):
    empty = files.read_or_empty(spark, str(tmp_path / "none.csv"))
    assert empty.columns == ["date", "store", "sales"] and empty.count() == 0
    assert files.read_feature_stats(spark, str(tmp_path / "none.json")) == {}


def test_feature_stats_round_trip(spark, tmp_path):
    stats = {"model_version": "1", "last_trained": "2020-01-01", "required_columns": ["a"], "column_order": ["a"], "default_values": {"year": 2017},
             "temperature_bins": [20.0], "temperature_labels": ["Cold", "Hot"], "humidity_bins": [60.0], "humidity_labels": ["Low", "High"]}
    files.write_feature_stats(spark, str(tmp_path / "s"), stats)
    assert files.read_feature_stats(spark, str(tmp_path / "s")) == stats


def test_headerless_file_with_thousands_and_encoding(spark, tmp_path):
    (tmp_path / "traffic.csv").write_bytes('16. 1. 2.,"1,234"\n16. 1. 3.,\n16. 1. 4.,5é\n'.encode("latin-1"))
    df = files.read_measure_csv(spark, str(tmp_path / "traffic.csv"), ["date", "hit"], "hit", encoding="ISO-8859-1")
    assert rows(df) == [("16. 1. 2.", 1234.0)]
    dated = files.coerce_date(df, "date", "yy. M. d.")
    assert dated.first()["date"] == dt.date(2016, 1, 2)


def test_submission_is_sorted_and_complete(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2014, 1, 2), 1, 5, 3.0), (dt.date(2014, 1, 1), 2, 5, 0.0)], schema.SALES)
    files.write_submission(df, str(tmp_path / "sub"))
    back = spark.read.option("header", True).schema(schema.SUBMISSION).csv(str(tmp_path / "sub"))
    assert sorted(rows(back)) == [("1_5_2014-01-02", 3.0), ("2_5_2014-01-01", 0.0)]


def test_columns_resolve_or_raise(spark):
    df = spark.createDataFrame([(1, 2, 3.0)], "store_id int, item_id int, sales double")
    assert schema.canonical_panel(df).columns == ["store_nbr", "item_nbr", "units"]
    with pytest.raises(ValueError):
        schema.resolve_column(df, ["units"])
    assert schema.resolve_column(df, ["units"], required=False) is None


def test_column_kinds(spark):
    df = spark.createDataFrame([(1, 2.0, "x", True, 3)], "id int, v double, c string, f boolean, month int")
    assert schema.split_columns(df, ["month"], ["id"]) == (["c", "f", "month"], ["v"])


def test_calendar_join_does_not_grow_the_table(spark, small):
    panel = panels.sales(spark, small, province=False)
    listed = panels.calendar(spark)
    assert listed.count() > J.flat_calendar(listed).count()
    joined = J.with_calendar(panel, listed)
    assert joined.count() == panel.count()
    assert joined.where("holiday = 1").count() > 0


@pytest.mark.parametrize("how", ["climate", "weather"])
def test_left_joins_keep_the_row_count(spark, small, how):
    panel = panels.sales(spark, small)
    if how == "climate":
        joined = J.with_climate(panel, panels.climate(spark, small))
    else:
        joined = J.with_store_weather(panel, panels.weather_numeric(spark, small), panels.store_key(spark, small), "left")
    assert joined.count() == panel.count()


def test_station_serves_several_stores(spark):
    weather = spark.createDataFrame([(17, dt.date(2014, 1, 1), 30.0)], "station_nbr int, date date, tmax double")
    key = spark.createDataFrame([(1, 17), (2, 17), (3, 4)], schema.STORE_KEY)
    assert sorted(r["store_nbr"] for r in J.weather_by_store(weather, key).collect()) == [1, 2]
    doubled = key.unionByName(key.where("store_nbr = 1").withColumn("station_nbr", F.lit(9)))
    assert rows(J.duplicate_keys(doubled)) == [(1, 2)] and J.unique_key(doubled).count() == 3


def test_results_do_not_depend_on_partition_count(spark, small):
    from demandloom.plans import registered

    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            return {q: sorted(map(repr, registered()[q](spark, small).collect())) for q in ("win7_store_row_context", "agg8_describe")}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")

    assert run("1") == run("7")


def test_entry_is_the_flagship(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["store_nbr", "mae", "rmse", "wape", "n"]

from datetime import date, datetime

import pytest
from conftest import at
from pyspark.sql import functions as F

from herdsignal.functions import names, numbers, time as T


def one(spark, column, *values, schema):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {schema}")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("v"))).collect()]


def test_snap_goes_to_the_even_tick(spark):
    given = [at("2020-01-01 00:05:00"), at("2020-01-01 00:15:00"), at("2020-01-01 00:05:00.000001"), at("1969-12-31 23:56:00"), None]
    expected = [at("2020-01-01 00:00"), at("2020-01-01 00:20"), at("2020-01-01 00:10"), at("1970-01-01"), None]
    assert one(spark, T.snap, *given, schema="timestamp_ntz") == expected


def test_epoch_field(spark):
    given = ["946684800", "946684801", "1893456000", None, "x", "1893455999"]
    assert one(spark, T.epoch_error, *given, schema="string") == ["invalid_date", None, "invalid_date", None, "invalid", None]
    decoded = one(spark, T.decode_epoch, *given, schema="string")
    assert decoded[1] == at("2000-01-01 00:00:01") and decoded[5] == at("2029-12-31 23:59:59")
    assert [decoded[i] for i in (0, 2, 3, 4)] == [None] * 4
    assert one(spark, T.encode_epoch, at("2000-01-01 00:00:01"), schema="timestamp_ntz") == [946684801]


def test_offset_is_dropped_not_applied(spark):
    given = ["2020-06-01T10:00:00+02:00", "2020-06-01T10:00:00Z", "2020-06-01T10:00:00.5", "later", None]
    expected = [at("2020-06-01 10:00"), at("2020-06-01 10:00"), at("2020-06-01 10:00:00.500000"), None, None]
    assert one(spark, T.decode_datetime, *given, schema="string") == expected
    assert one(spark, T.strip_offset, "2020-06-01T10:00:00+02:00", "2020-06-01T10:00:00-02:00", schema="string") == [
        "2020-06-01T10:00:00",
        "2020-06-01T10:00:00-02:00",
    ]
    assert one(spark, T.encode_datetime, at("2020-06-01 10:00"), at("2020-06-01 10:00:00.25"), schema="timestamp_ntz") == [
        "2020-06-01T10:00:00",
        "2020-06-01T10:00:00.250000",
    ]


def test_iso_and_repair(spark):
    assert one(spark, T.parse_iso, "2020-01-02T03:04:05", None, "2020-01-02", schema="string") == [at("2020-01-02 03:04:05"), None, None]
    given = ["2020-01-02 03:04:05.9", "1577836800", "nothing", None]
    assert one(spark, T.repaired_time, *given, schema="string") == [at("2020-01-02 03:04:05"), at("2020-01-01"), None, None]


def test_between_days_includes_the_last_day(spark):
    times = [at("2019-01-01"), at("2019-01-13 23:59:59"), at("2019-01-14")]
    inside = one(spark, lambda c: T.between_days(c, "2019-01-01", date(2019, 1, 13)), *times, schema="timestamp_ntz")
    assert inside == [True, True, False]


def test_numbers(spark):
    assert one(spark, numbers.class_tag, 0.5, 0.5000001, None, schema="double") == [0, 1, None]
    assert one(spark, numbers.round_half_even, 0.125, 0.375, -0.125, schema="double") == [0.12, 0.38, -0.12]
    assert one(spark, numbers.no_nan, float("nan"), 1.0, None, schema="double") == [None, 1.0, None]
    assert one(spark, numbers.logistic, 0.0, 800.0, -800.0, schema="double") == [0.5, 1.0, 0.0]


@pytest.mark.parametrize(
    "path, name",
    [
        ("file:/x/cow%201%7C0.csv", "cow 1|0.csv"),
        ("file:/x/a+b%7C12.csv", "a+b|12.csv"),
        ("file:/x/7%7C1.csv/part-0.csv", "7|1.csv"),
        ("file:/x/other.csv", ""),
    ],
)
def test_sensor_names(spark, path, name):
    assert one(spark, names.sensor_name, path, schema="string") == [name]


def test_whole_ids_match(spark):
    assert one(spark, lambda c: names.belongs_to(c, F.lit("a1")), "a1|0.csv", "a10|0.csv", "a1|0.pkl", schema="string") == [True, False, False]
    assert one(spark, names.chunk_of, "a1|12.csv", schema="string") == [12]


def test_wall_time(spark):
    assert one(spark, T.wall_time, datetime(2020, 1, 1, 5), schema="timestamp") == [at("2020-01-01 05:00")]

"""Legal input at the edges: glitches, text keys, headers in any order, time zones, overlong numbers."""

import math
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from herdsignal.functions import names, time as T
from herdsignal.operators import clean, features, joins, metrics, models
from herdsignal.sources import readings, tables

START = datetime(2020, 3, 29)


def series(spark, values):
    rows = [("o", "a", START + timedelta(minutes=10 * i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "organisation_id string, animal_id string, datetime timestamp_ntz, temp double")


def test_a_glitch_ends_with_its_frame(spark):
    values = [38 + math.sin(i) / 10 for i in range(1200)]
    values[100], values[700] = 1e9, math.inf
    df = clean.nulls_for_nan(series(spark, values), ["temp"])
    found = [features.temperature_statistics(df, ["temp_var"], block_rows=n).orderBy("datetime").toPandas() for n in (256, 4096)]
    clean_values = pd.Series(values).replace(math.inf, math.nan)
    want = clean_values.rolling(288, min_periods=2).var()
    for got in found:
        assert got["temp_var"].iloc[500:].tolist() == pytest.approx(clean_values.iloc[101:].rolling(288, min_periods=2).var().iloc[399:].tolist(), rel=1e-6)
        assert got["temp_var"].notna().tolist() == want.notna().tolist()
    assert found[0]["temp_var"].equals(found[1]["temp_var"])


def test_keys_stay_text(spark, tmp_path):
    rows = [(o, "1", START, 1.0) for o in ("007", "08", "1e3", "o1")]
    tables.write_readings(spark.createDataFrame(rows, "organisation_id string, animal_id string, datetime timestamp_ntz, act double"), str(tmp_path / "t"))
    stored = tables.read_table(spark, str(tmp_path / "t"))
    assert sorted(r["organisation_id"] for r in stored.collect()) == ["007", "08", "1e3", "o1"]


def test_columns_by_header(spark, tmp_path):
    (tmp_path / "a=1|0.csv").write_text("ts,temp,act\n946684801,38.5,7\n")
    (tmp_path / "b|0.csv").write_text("ts,act,temp,more\n946684801,8,39.5,x\n99999999999999999,1,2,y\n")
    got = {(r["animal_id"], r["act"], r["temp"], r["datetime"]) for r in readings.read_sensor_csv(spark, str(tmp_path)).collect()}
    at = datetime(2000, 1, 1, 0, 0, 1)
    assert got == {("a=1", 7.0, 38.5, at), ("b", 8.0, 39.5, at), ("b", 1.0, 2.0, None)}


def test_overlong_numbers_are_set_aside(spark):
    df = spark.createDataFrame([("99999999999999999",), ("946684801",), ("2020-01-01 00:00:00.5",)], "ts string")
    times = [r["datetime"] for r in clean.repair_time(df).collect()]
    assert times == [None, datetime(2000, 1, 1, 0, 0, 1), datetime(2020, 1, 1)]


@pytest.mark.parametrize("zone", ["UTC", "Europe/Vienna"])
def test_the_grid_needs_no_time_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = series(spark, range(36))  # the night in which Vienna's clocks go forward
        ticks = df.select("datetime", T.snap(F.col("datetime")).alias("tick"), T.from_micros(T.to_micros(F.col("datetime"))).alias("back")).collect()
        assert all(r["tick"] == r["datetime"] == r["back"] for r in ticks)
        assert len({r["tick"] for r in ticks}) == 36
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_every_row_is_scored(spark):
    rows = [(i, float(i % 7), float(i % 5), int(i % 7 > 3)) for i in range(60)]
    model = models.train_weighted(spark.createDataFrame(rows, "k int, a double, b double, annotation int"), ["a", "b"])
    asked = spark.createDataFrame([(1, 1.0, 2.0, 0), (2, None, 2.0, 1), (3, math.nan, 1.0, 0)], "k int, a double, b double, annotation int")
    scored = {r["k"]: r for r in models.score(model, asked, keep=["k"]).collect()}
    assert scored[1]["probability"] is not None and scored[1]["y_pred"] in (0, 1)
    assert all(scored[k]["probability"] is None and scored[k]["y_pred"] is None for k in (2, 3))


def test_missing_readings_come_last(spark):
    rows = [("o", "a", START, 0, None), ("o", "a", START, 0, 5.0)]
    df = spark.createDataFrame(rows, "organisation_id string, animal_id string, datetime timestamp_ntz, chunk int, act double")
    assert [r["act"] for r in clean.dedup_first(df, ["chunk", "act"]).collect()] == [5.0]


def test_nan_has_no_bin(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (math.nan,), (None,), (math.inf,)], "v double")
    assert {r["bin"]: r["n"] for r in metrics.histogram(df, "v", 4).collect()} == {1: 1, 2: 0, 3: 0, 4: 1}


def test_the_newest_organisation_counts(spark):
    animals = spark.createDataFrame([("a", "o1", 1), ("a", "o0", 2)], "animal_id string, organisation_id string, loaded int")
    found = joins.organisation_of(spark.createDataFrame([("a",)], "animal_id string"), animals, "loaded")
    assert [r["organisation_id"] for r in found.collect()] == ["o0"]


def test_whole_path_element(spark):
    row = spark.createDataFrame([("file:/x/a=1%7C0.csv",)], "p string").select(names.sensor_name(F.col("p")).alias("n"))
    assert row.first()["n"] == "a=1|0.csv"

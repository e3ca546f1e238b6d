from datetime import timedelta

import pytest
from conftest import at
from pyspark.sql import functions as F

from herdsignal.operators import clean, features

READINGS = "organisation_id string, animal_id string, datetime timestamp_ntz, act double, temp double"


def readings(spark, *rows):
    return spark.createDataFrame([("o", a, at(t), act, temp) for a, t, act, temp in rows], READINGS)


def test_first_reading_of_a_tick(spark):
    given = readings(spark, ("a", "2020-01-01 00:04:00", 2.0, 1.0), ("a", "2020-01-01 00:02:00", 1.0, None), ("b", "2020-01-01 00:04:00", 3.0, 1.0))
    rows = clean.on_grid(given).orderBy("animal_id").collect()
    assert [(r.animal_id, r.datetime, r.act, r.temp) for r in rows] == [("a", at("2020-01-01"), 1.0, None), ("b", at("2020-01-01"), 3.0, 1.0)]


def test_history_and_heat_filters(spark):
    given = readings(spark, *[("a", f"2020-01-01 00:0{i}:00", 1.0, 31.0) for i in range(4)], ("b", "2020-01-01 00:00:00", 1.0, 31.0))
    assert {r.animal_id for r in clean.min_history(given, 4).collect()} == {"a"}
    assert clean.min_history(given, 5).count() == 0
    flags = given.withColumns({"pregnant": F.lit(False), "inseminated": F.lit(False), "cyclic": F.col("animal_id") == "b"})
    assert {r.animal_id for r in clean.with_any_heat(flags).collect()} == {"b"}


def test_plausible_drops_missing_and_cold(spark):
    given = readings(spark, ("a", "2020-01-01", 1.0, 30.0), ("a", "2020-01-02", 1.0, 30.01), ("a", "2020-01-03", 1.0, None))
    assert [r.temp for r in clean.plausible(given).collect()] == [30.01]


def test_default_group(spark):
    animals = spark.createDataFrame([("a", None), ("b", "g")], "animal_id string, group_id string")
    assert [r.animal_id for r in clean.default_group(animals).collect()] == ["b"]
    assert sorted(r.group_id for r in clean.default_group(animals, reject_missing=False).collect()) == ["N/A", "g"]


@pytest.mark.parametrize("group, present, mean", [("g", 4, None), ("g", 5, 3.0), ("N/A", 6, None)])
def test_group_mean_needs_five_animals(spark, group, present, mean):
    rows = [("o", group, str(i), at("2020-01-01"), float(i) if i <= present else None) for i in range(1, 8)]
    given = spark.createDataFrame(rows, "organisation_id string, group_id string, animal_id string, datetime timestamp_ntz, act double")
    found = {r.animal_id: r.act_group_mean for r in features.group_mean(given).collect()}
    for i in range(1, 8):
        assert found[str(i)] == (mean if i <= present else None)


def test_days_in_milk(spark):
    times = ["2020-01-01 23:00:00", "2020-01-05 00:00:00", "2020-01-05 12:00:00", "2020-01-09 01:00:00"]
    given = readings(spark, *[("a", t, 1.0, 1.0) for t in times], ("b", times[0], 1.0, 1.0))
    births = spark.createDataFrame(
        [("o", "a", at("2020-01-05 13:00:00")), ("o", "a", at("2020-01-08 00:00:00")), ("o", "a", None)],
        "organisation_id string, animal_id string, calved_at timestamp_ntz",
    )
    rows = features.days_in_milk(given, births).orderBy("animal_id", "datetime").collect()
    assert [r.DIM for r in rows] == [None, 0, 0, 1, None]
    assert len(rows) == given.count()


def test_quarantine_and_blocked_series(spark):
    raw = spark.createDataFrame([("a", "2020-01-01 00:00:00"), ("b", "1577836800"), ("c", "broken")], "animal_id string, ts string")
    good, bad = clean.split_unreadable(clean.repair_time(raw))
    assert {r.animal_id for r in good.collect()} == {"a", "b"} and [r.ts for r in bad.collect()] == ["broken"]
    assert [r.animal_id for r in clean.drop_series(good, good.where("animal_id = 'a'"), ["animal_id"]).collect()] == ["b"]


def test_slices_and_pruning(spark):
    start = at("2020-01-01")
    given = spark.createDataFrame([("o", str(i), start + timedelta(hours=12 * i), 1.0, 1.0) for i in range(6)], READINGS)
    assert clean.date_slice(given, "2020-01-01", "2020-01-02").count() == 4
    assert clean.key_slice(given, organisation_id="o", animal_id="3").count() == 1
    assert clean.for_trees(given).columns == ["organisation_id", "animal_id", "datetime", "act"]
    assert clean.required(given.withColumn("DIM", F.lit(None).cast("int")), ["DIM", "act"]).count() == 0

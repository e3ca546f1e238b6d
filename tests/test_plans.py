"""The whole flow on a small herd, and what its plans must not contain."""

from datetime import timedelta

import pytest
from conftest import at
from pyspark.sql import functions as F

from herdsignal.operators import clean, joins, labels
from herdsignal.plans import features as plan, relations as R

START = at("2020-01-01")
ANIMALS = [("o", str(i), "g" if i < 8 else None) for i in range(9)]


@pytest.fixture(scope="module")
def inputs(spark):
    # 3300 ticks: the last event lies on day 21, its span ends before the series does.
    rows = spark.range(9 * 3300).select(
        F.lit("o").alias("organisation_id"),
        (F.col("id") % 9).cast("string").alias("animal_id"),
        (F.lit(START) + F.make_dt_interval(mins=(F.floor(F.col("id") / 9) * 10 + F.col("id") % 4).cast("int"))).alias("datetime"),
        (F.pmod(F.xxhash64("id"), F.lit(100))).cast("double").alias("act"),
        (38 + F.pmod(F.xxhash64("id"), F.lit(7)) / 10 - F.when(F.col("id") % 97 == 0, 6).otherwise(0)).alias("temp"),
    )
    day = lambda n: START + timedelta(days=n)
    made = []
    for i in range(9):
        made += [("o", str(i), 0, day(2), "heat", None, None), ("o", str(i), 0, day(18 + 3), "insemination", None, None)]
        made += [("o", str(i), 0, day(12), "pregnancy_result", day(4), False), ("o", str(i), 0, day(1), "calving_confirmation", None, None)]
    events = spark.createDataFrame(
        made,
        "organisation_id string, animal_id string, cycle_no int, event_ts timestamp_ntz, event_type string, insemination_date timestamp_ntz, pregnant boolean",
    )
    detections = spark.createDataFrame([("o", "1", day(9), "actincrease_704"), ("o", "1", day(2), "actincrease_704")], "organisation_id string, animal_id string, event_ts timestamp_ntz, event_type string")
    animals = spark.createDataFrame(ANIMALS, "organisation_id string, animal_id string, group_id string")
    return rows, animals, events, detections


def test_feature_table(inputs):
    table = plan.build_features(*inputs, settings=plan.Settings(min_rows=1000)).cache()
    rows = table.toPandas()
    assert set(rows.animal_id) == set("01234567") and (rows.groupby("animal_id").size() > 2500).all()
    assert rows.DIM.min() == 0 and rows.temp.min() > 30
    for label in labels.LABELS:
        per_animal = rows[rows[label]].groupby("animal_id").size()
        assert len(per_animal) == (1 if label == "deleted" else 8), label
        assert (per_animal <= 2 * 61).all() and (per_animal > 40).all()
    assert rows.heat_feature.notna().all() and (rows.act_group_mean - 50).abs().max() < 40
    matrix, split, scaler = plan.build_training(table, plan.Settings(hold_off=12))
    assert matrix.columns[-5:] == ["annotation", "DIM", "act", "act_group_mean", "temp_filtered"]
    assert sorted(r.split for r in split.collect()).count("test") == 3
    assert abs(matrix.agg(F.avg("act")).collect()[0][0]) < 0.01
    table.unpersist()


def test_history_filter_and_required_heat(inputs):
    assert plan.build_features(*inputs, settings=plan.Settings(min_rows=4320)).count() == 0
    wanted = plan.build_features(*inputs, settings=plan.Settings(min_rows=1000, require_heat=True))
    assert wanted.select("animal_id").distinct().count() == 8


def plan_of(df, capsys):
    df.explain()
    return capsys.readouterr().out


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_no_pair_joins(spark, folder, capsys):
    import __spark_entry__ as entry

    for name in ("c5_locate_peaks", "c7_cyclic_events", "c8_pregnant_events", "l5_all_labels", "e5_spike_filter", "h1_scale"):
        text = plan_of(entry.queries()[name](spark, folder), capsys)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_filters_and_columns_reach_the_scan(spark, capsys):
    readings = R.table(spark, "/root/testdata/sf0.001", "events").where("user_id = 3").select("ts", "value")
    text = plan_of(readings, capsys)
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,3)]" in text and "props" not in text


def test_copies_are_reduced_before_the_shuffle(spark, capsys):
    text = plan_of(clean.on_grid(R.readings(spark, "/root/testdata/sf0.001"), ties=["event_id"]), capsys)
    assert "partial_min_by" in text and text.count("Exchange") == 1 and "Window" not in text


def test_a_hot_animal_is_split_in_lookups(spark, capsys):
    """Adaptive execution cuts the partition of an animal that holds most rows."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        hot = F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise((F.col("id") % 500).cast("string"))
        rows = spark.range(0, 300000, 1, 6).select(hot.alias("animal_id"), F.xxhash64("id").alias("x"), "id")
        animals = rows.select("animal_id").distinct().withColumn("organisation_id", F.lit("o"))
        joined = joins.organisation_of(rows, animals)
        assert joined.where("organisation_id IS NOT NULL").count() == 300000
        joined.write.format("noop").mode("overwrite").save()
        collected = joined.select("animal_id", "organisation_id", "x")
        collected.collect()
        assert "skew=true" in plan_of(collected, capsys)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)

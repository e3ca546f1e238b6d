from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from conftest import at
from pyspark.sql import functions as F

from herdsignal.operators import events as ev, labels

EVENTS = "organisation_id string, animal_id string, cycle_no int, event_ts timestamp_ntz, event_type string, insemination_date timestamp_ntz, pregnant boolean"
READINGS = "organisation_id string, animal_id string, datetime timestamp_ntz, act double"
DAY0 = at("2020-01-01")


def events(spark, *rows):
    """(day, type[, cycle[, insemination day]]) of one animal."""
    made = []
    for day, kind, *rest in rows:
        cycle = rest[0] if rest else 0
        inseminated = DAY0 + timedelta(days=rest[1]) if len(rest) > 1 else None
        made.append(("o", "a", cycle, None if day is None else DAY0 + timedelta(days=day), kind, inseminated, False))
    return spark.createDataFrame(made, EVENTS)


def days(df):
    return sorted((r.event_ts - DAY0).days for r in df.collect())


def test_cyclic_bounds(spark):
    found = ev.cyclic_events(events(spark, *[(d, "heat") for d in (0, 18, 50, 74, 99)]))
    assert days(found) == [0, 18, 50, 74]


def test_cyclic_needs_the_same_cycle_and_type(spark):
    assert days(ev.cyclic_events(events(spark, (0, "heat", 0), (20, "heat", 1)))) == []
    assert days(ev.cyclic_events(events(spark, (0, "heat"), (20, "calving_confirmation"), (None, "heat")))) == []
    assert days(ev.cyclic_events(events(spark, (0, "heat"), (20, "insemination")))) == [0, 20]


@pytest.mark.parametrize("bucket_days", [7, 60, 400])
def test_exists_within_against_brute_force(spark, bucket_days):
    rng = np.random.default_rng(3)
    rows = [(float(d), "heat", int(c)) for d, c in zip(rng.integers(0, 2000, 300) / 2, rng.integers(0, 3, 300))]
    found = ev.exists_within(events(spark, *rows), events(spark, *rows), ["cycle_no"], (18, 24), (-24, -18), bucket_days=bucket_days)
    times = {}
    for d, _, c in rows:
        times.setdefault(c, set()).add(d)
    want = {(c, DAY0 + timedelta(days=d)) for c, ds in times.items() for d in ds if any(18 <= abs(x - d) <= 24 for x in ds)}
    assert {(r.cycle_no, r.event_ts) for r in found.collect()} == want
    assert found.count() == len(want)


@pytest.mark.parametrize("gap, pregnant", [(269, False), (270, True), (290, True), (291, False)])
def test_pregnant_bounds(spark, gap, pregnant):
    found = ev.pregnant_events(events(spark, (0, "heat"), (gap, "calving_confirmation")))
    assert days(found) == ([0] if pregnant else [])


def test_pregnant_sources(spark):
    given = events(spark, (0, "heat"), (5, "pregnancy_result", 0, 3), (6, "pregnancy_result", 0, 3), (7, "pregnancy_result"))
    cycles = spark.createDataFrame([("o", "a", 0, DAY0 + timedelta(days=280))], "organisation_id string, animal_id string, cycle_no int, last_calving_date timestamp_ntz")
    assert days(ev.pregnant_events(given, cycles)) == [0, 3]
    assert days(ev.pregnant_events(given)) == [3]
    assert days(ev.pregnant_events(given, positive_only=True)) == []


def test_deleted_is_a_multiset_difference(spark):
    detected = events(spark, (1, "actincrease_704"), (1, "actincrease_704"), (2, "actincrease_704"), (9, "other"))
    kept = events(spark, (1, "heat"), (3, "heat"), (2, "insemination"))
    assert days(ev.deleted_events(detected, kept)) == [1, 2]


def readings(spark, *rows):
    return spark.createDataFrame([("o", "a", t, v) for t, v in rows], READINGS)


def peak(spark, event, *rows):
    found = labels.locate_peaks(readings(spark, *rows), spark.createDataFrame([("o", "a", event)], "organisation_id string, animal_id string, event_ts timestamp_ntz"))
    return [r.peak_ts for r in found.collect()]


def test_peak_ties_and_empty_slices(spark):
    noon = at("2020-01-05 12:00")
    far = timedelta(hours=12, microseconds=1)
    assert peak(spark, noon, (noon, 5.0), (noon + timedelta(hours=1), 5.0)) == [noon]
    assert peak(spark, noon, (noon + timedelta(hours=12), 1.0)) == [noon + timedelta(hours=12)]
    assert peak(spark, noon, (noon + far, 1.0), (noon - far, 1.0)) == []
    assert peak(spark, noon, (noon, None)) == []


def test_span_bounds(spark):
    top = at("2020-01-01 10:00")
    ticks = [at("2020-01-01 00:00") + timedelta(minutes=10 * i) for i in range(144)]
    peaks = spark.createDataFrame([("o", "a", top, True)], "organisation_id string, animal_id string, peak_ts timestamp_ntz, cyclic boolean")
    marked = labels.mark_spans(readings(spark, *[(t, 1.0) for t in ticks]), peaks, ["cyclic"])
    on = sorted(r.datetime for r in marked.where("cyclic").collect())
    assert (on[0], on[-1], len(on)) == (at("2020-01-01 08:00"), at("2020-01-01 18:00"), 61)
    assert marked.count() == 144


def test_labels_against_pandas(spark):
    """All four sets at once, next to a plain loop over each event."""
    rng = np.random.default_rng(5)
    base = pd.Timestamp("2020-03-01")
    frames, event_rows = [], []
    for animal in ("a", "b"):
        ticks = np.sort(rng.choice(1500, 1000, replace=False))
        act = np.where(rng.random(1000) < 0.2, np.nan, rng.integers(0, 50, 1000).astype(float))
        frames.append(pd.DataFrame({"animal_id": animal, "datetime": base + pd.to_timedelta(ticks * 10, unit="min"), "act": act}))
        for label in labels.LABELS:
            for minute in rng.integers(-1000, 16000, 8):
                event_rows.append(("o", animal, label, (base + pd.Timedelta(minutes=int(minute))).to_pydatetime()))
    pdf = pd.concat(frames, ignore_index=True)
    loaded = spark.createDataFrame(pdf.assign(organisation_id="o")).withColumns(
        {"act": F.nanvl("act", F.lit(None).cast("double")), "datetime": F.col("datetime").cast("timestamp_ntz")}
    )
    made = spark.createDataFrame(event_rows, "organisation_id string, animal_id string, label string, event_ts timestamp_ntz")
    sets = {label: made.where(F.col("label") == label).drop("label") for label in labels.LABELS}
    mine = labels.mark_events(loaded, sets).toPandas().sort_values(["animal_id", "datetime"]).reset_index(drop=True)

    want = pdf.assign(**{label: False for label in labels.LABELS}).sort_values(["animal_id", "datetime"])
    parts = []
    for animal, group in want.groupby("animal_id"):
        group = group.set_index("datetime")
        for _, who, label, t in event_rows:
            if who != animal:
                continue
            smooth = group.loc[t - pd.Timedelta(hours=12) : t + pd.Timedelta(hours=12), "act"].rolling(6, min_periods=1, center=True).mean().round(6)
            if smooth.notna().any():
                top = smooth.idxmax()
                group.loc[top - pd.Timedelta(hours=2) : top + pd.Timedelta(hours=8), label] = True
        parts.append(group.reset_index())
    want = pd.concat(parts, ignore_index=True)
    for label in labels.LABELS:
        assert want[label].sum() > 50
        assert (mine[label] == want[label]).all(), label


def test_annotation_ignores_deleted(spark):
    rows = spark.createDataFrame([(False, False, False, True), (True, False, False, False)], "pregnant boolean, cyclic boolean, inseminated boolean, deleted boolean")
    assert [r.raw for r in labels.annotate(rows).collect()] == [0, 1]


def test_no_pair_joins_in_plans(spark, capsys):
    given = events(spark, (0, "heat"), (20, "heat"))
    marked = labels.mark_events(readings(spark, (DAY0, 1.0)), {"cyclic": ev.cyclic_events(given)})
    marked.explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan

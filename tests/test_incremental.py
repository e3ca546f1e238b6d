"""Refreshed series, replacement by key, irregular intervals and mergeable scalers."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from herdsignal.operators import labels, scaling
from herdsignal.operators.series import BUCKET
from herdsignal.session import fresh_path
from herdsignal.sources import readings as SR, tables
from herdsignal.streaming.refresh import SeriesStore

START = datetime(2024, 1, 1)


def smooth(part):
    """A frame of three rows back and two ahead."""
    def add(rows, window):
        return rows.withColumn("mean", F.avg("act").over(window.rowsBetween(-3, 2)))

    return labels.rolling(part, add, before=3, after=2)


def series(animals=3, days=20, per_day=4, seed=1):
    rng = random.Random(seed)
    rows = []
    for animal in range(animals):
        for day in range(days):
            for k in range(per_day):
                if rng.random() < 0.8:
                    rows.append(("o", str(animal), START + timedelta(days=day, hours=6 * k), rng.randrange(100) / 1.0, len(rows)))
    return rows


SCHEMA = "organisation_id string, animal_id string, datetime timestamp_ntz, act double, id long"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def collected(df):
    return sorted((r["animal_id"], r["datetime"], r["act"], round(r["mean"], 9)) for r in df.collect())


def test_refresh_in_any_order(spark):
    rows = series()
    whole = collected(smooth(frame(spark, rows)))
    rng = random.Random(2)
    rng.shuffle(rows)
    store = SeriesStore(spark, fresh_path(spark, "store"), smooth, 3, 2, ["id"], days=2)
    for part in (rows[:90], rows[90:100], rows[100:]):
        store.refresh(frame(spark, part))
    store.refresh(frame(spark, []))
    assert collected(store.table()) == whole
    # A copy of a reading that comes later and is worse in order changes nothing, a better one counts.
    a, b, at, act, number = sorted(rows)[5]
    store.refresh(frame(spark, [(a, b, at, act + 1, number + 1000)]))
    assert collected(store.table()) == whole
    store.refresh(frame(spark, [(a, b, at, act + 1, -1)]))
    better = [r if r[1:3] != (b, at) else (a, b, at, act + 1, -1) for r in rows]
    assert collected(store.table()) == collected(smooth(frame(spark, better)))


def test_refresh_leaves_other_blocks_alone(spark):
    rows = series(days=30, per_day=4, animals=2)
    store = SeriesStore(spark, fresh_path(spark, "store"), smooth, 3, 2, ["id"], days=2)
    late = [r for r in rows if r[1] == "0" and r[2].day == 15]
    store.refresh(frame(spark, [r for r in rows if r not in late]))
    store.refresh(frame(spark, late))
    log = {(r["animal_id"], r[BUCKET]): r for r in store.log().collect()}
    block = lambda day: (datetime(2024, 1, day) - datetime(1970, 1, 1)).days // 2
    again = {key for key, r in log.items() if r["derived"] >> 32 == 2}
    assert ("0", block(15)) in again and len(again) <= 3 and all(animal == "0" for animal, _ in again)
    assert {key for key, r in log.items() if r["raw"] >> 32 == 2} == {("0", block(15))}
    # Only the folders of the blocks within reach are read.
    plan = store._rows("raw", store.log().where(F.col(BUCKET) == block(15)))._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    filters = [line for line in plan.splitlines() if line.startswith("PartitionFilters") and BUCKET in line]
    assert filters and str(block(15)) in filters[0]


def test_broken_off_refresh_changes_nothing(spark):
    rows = series(days=6, animals=1)
    failing = {"now": False}

    def compute(part):
        if failing["now"]:
            raise RuntimeError("lost")
        return smooth(part)

    store = SeriesStore(spark, fresh_path(spark, "store"), compute, 3, 2, ["id"], days=2)
    store.refresh(frame(spark, rows[:12]))
    before = collected(store.table())
    failing["now"] = True
    with pytest.raises(RuntimeError):
        store.refresh(frame(spark, rows[12:]))
    assert collected(store.table()) == before
    failing["now"] = False
    store.refresh(frame(spark, rows[12:]))
    assert collected(store.table()) == collected(smooth(frame(spark, rows)))


def stored(spark):
    path = fresh_path(spark, "readings")
    rows = [(str(o), f"{o}-{a}", START + timedelta(hours=h), float(h), h) for o in range(4) for a in range(3) for h in range(5)]
    tables.write_readings(frame(spark, rows), path)
    return path, rows


def files_of(path):
    return {str(p.relative_to(path)) for p in Path(path.removeprefix("file:")).rglob("*.parquet")} if not path.startswith("file:") else {
        str(p.relative_to(path.removeprefix("file:"))) for p in Path(path.removeprefix("file:")).rglob("*.parquet")
    }


def content(spark, path):
    return sorted(tuple(r) for r in tables.read_table(spark, path).select("organisation_id", "animal_id", "datetime", "act", "id").collect())


def test_replace_keys_by_animal(spark):
    path, rows = stored(spark)
    before = files_of(path)
    # One animal gets new rows, another one moves to another organisation, a third one is new, in an odd folder.
    new = [("1", "1-0", START, -1.0, 0), ("3", "2-1", START, -2.0, 0), ("a/b=ü%", "x", START, -3.0, 0)]
    assert tables.replace_keys(frame(spark, new), path) == ["1", "2", "3", "a/b=ü%"]
    want = sorted([r for r in rows if r[1] not in ("1-0", "2-1")] + new)
    assert content(spark, path) == want
    same = {f for f in before if f.startswith("organisation_id=0/")}
    assert same and same <= files_of(path)
    assert not any(f.startswith("_") for f in files_of(path))
    # The last animal of a folder moves away: the folder goes.
    tables.replace_keys(frame(spark, [("0", "x", START, -4.0, 0)]), path)
    assert content(spark, path) == sorted([r for r in want if r[1] != "x"] + [("0", "x", START, -4.0, 0)])
    assert tables.replace_keys(frame(spark, []), path) == []


@pytest.mark.parametrize("survives", [0, 1, 2, 3])
def test_killed_replacement(spark, monkeypatch, survives):
    """A write that is killed before its journal leaves the old rows; after it, it is finished by the next reader."""
    path, rows = stored(spark)
    new = [("1", "1-0", START, -1.0, 0), ("2", "2-0", START, -1.0, 0)]
    want = sorted([r for r in rows if r[1] not in ("1-0", "2-0")] + new)
    if not survives:
        monkeypatch.setattr(tables, "_publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            tables.replace_keys(frame(spark, new), path)
        assert content(spark, path) == sorted(rows)
        return
    whole, calls = tables._path, []

    class Dying:
        def __init__(self, system):
            self.system = system

        def __getattr__(self, name):
            def run(*args):
                if name in ("rename", "delete"):
                    calls.append(name)
                    if len(calls) > survives:
                        raise KeyboardInterrupt
                return getattr(self.system, name)(*args)

            return run

    monkeypatch.setattr(tables, "_path", lambda s, n: (whole(s, n)[0], Dying(whole(s, n)[1])))
    with pytest.raises(KeyboardInterrupt):
        tables.replace_keys(frame(spark, new), path)
    monkeypatch.setattr(tables, "_path", whole)
    assert content(spark, path) == want
    assert content(spark, path) == want


def test_in_intervals(spark):
    rng = random.Random(3)
    rows = [("o", "hot" if i % 2 else str(i % 7), START + timedelta(minutes=10 * rng.randrange(100_000)), 1.0, i) for i in range(600)]
    spans = []
    for i in range(80):
        first = START + timedelta(minutes=rng.randrange(900_000))
        spans.append(("o", rng.choice(["hot", "1", "2"]), first, first + timedelta(microseconds=rng.choice([0, 1, 3_600_000_000, 86_400_000_000 * 30, 86_400_000_000 * 730])), i))
    spans += [("o", "hot", rows[1][2], rows[1][2], 90), ("o", "hot", START + timedelta(days=9), START, 91), ("o", "hot", None, START, 92), ("x", "hot", START, START + timedelta(days=700), 93)]
    spans.append(("o", "hot", datetime(1969, 12, 1), START + timedelta(days=800), 94))
    intervals = spark.createDataFrame(spans, "organisation_id string, animal_id string, first timestamp_ntz, last timestamp_ntz, segment int")
    got = sorted((r["id"], r["segment"]) for r in SR.in_intervals(frame(spark, rows), intervals).collect())
    want = sorted((r[4], s[4]) for r in rows for s in spans if s[:2] == r[:2] and s[2] is not None and s[2] <= r[2] <= s[3])
    assert got == want
    assert SR.in_intervals(frame(spark, rows), intervals.where("false")).count() == 0
    cells = SR.in_intervals(frame(spark, rows), intervals)._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in cells and "CartesianProduct" not in cells


def test_scaler_states_merge(spark):
    values = np.random.default_rng(5).normal(1e6, 1, 400)
    rows = [(float(v), None if i < 100 else float(i), None) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "act double, temp double, none double")
    columns = ("act", "temp", "none")
    path = fresh_path(spark, "scaler")
    for low, high in ((0, 100), (100, 101), (101, 400), (400, 400)):
        scaling.partial_fit(spark.createDataFrame(rows[low:high], df.schema), path, columns)
    got, want = scaling.fitted(spark, path, columns).first(), scaling.fit_scaler(df, columns).first()
    for name in ("act_mean", "act_std", "temp_mean", "temp_std"):
        assert got[name] == pytest.approx(want[name], rel=1e-12, abs=0) or name == "act_std" and abs(got[name] - np.std(values)) < 1e-9
    assert got["none_mean"] is None and got["none_std"] is None


def test_epoch_order_is_a_bijection(spark):
    from herdsignal.operators import sequences

    for rows in (1, 2, 3, 7, 10, 97, 4097):
        ids = spark.range(rows, numPartitions=3).withColumnRenamed("id", "row_id")
        places = [[r[0] for r in ids.orderBy("row_id").select(sequences.epoch_place("row_id", rows, epoch=e)).collect()] for e in (0, 1)]
        assert all(sorted(p) == list(range(rows)) for p in places)
        if rows > 90:
            assert places[0] != places[1] and sum(p == i for i, p in enumerate(places[0])) < 10
            moves = {(b - a) % rows for a, b in zip(places[0], places[0][1:], strict=False)}
            assert len(moves) > rows // 4  # neighbours do not stay at a fixed distance

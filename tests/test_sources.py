from datetime import timedelta
from pathlib import Path

import pytest
from conftest import at
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from herdsignal.operators import joins
from herdsignal.sources import files, readings as SR, tables
from herdsignal.streaming import ingest
from herdsignal.streaming.ingest import ingest_new_files


def test_default_span_has_two_segments(spark):
    spans = spark.createDataFrame(
        [("a", at("2018-04-01"), at("2020-04-01")), ("b", at("2018-04-01"), at("2018-04-01") + timedelta(days=399)), ("c", at("2018-04-01"), at("2018-05-01"))],
        "animal_id string, first timestamp_ntz, last timestamp_ntz",
    )
    rows = SR.segments(spans).orderBy("animal_id", "segment").collect()
    day = lambda n: at("2018-04-01") + timedelta(days=n)
    assert [(r.animal_id, r.segment_start, r.segment_end) for r in rows] == [
        ("a", at("2018-04-01"), at("2019-05-05")),
        ("a", at("2019-05-04"), at("2020-04-01")),
        ("b", day(0), day(399)),
        ("b", day(398), day(399)),
        ("c", day(0), at("2018-05-01")),
    ]


def test_rows_in_segments_match_the_segment_table(spark):
    first, last = at("2020-01-01"), at("2020-02-10")
    rows = spark.range(0, 42 * 4).select((F.lit(first) + F.make_dt_interval(hours=(F.col("id") * 6).cast("int"))).alias("datetime"))
    placed = {(r.datetime, r.segment) for r in SR.in_segments(rows, first, last, days=8, step=7).collect()}
    spans = spark.createDataFrame([(first, last)], "first timestamp_ntz, last timestamp_ntz")
    table = SR.segments(spans, days=8, step=7).collect()
    want = {(r.datetime, s.segment) for r in rows.collect() for s in table if s.segment_start <= r.datetime <= s.segment_end}
    assert placed == want


def write_csv(folder: Path, name: str, *lines: str):
    (folder / name).write_text("ts,act,temp\n" + "\n".join(lines) + "\n")


def test_sensor_csv(spark, tmp_path):
    write_csv(tmp_path, "a1|0.csv", "1577836800,1.5,38", "1577837400,NaN,39")
    write_csv(tmp_path, "a1|1.csv", "1577837400,7,40")
    write_csv(tmp_path, "a10|0.csv", "1577836800,9,")
    (tmp_path / "a1|2.pkl").write_text("x")
    rows = SR.read_sensor_csv(spark, str(tmp_path)).orderBy("animal_id", "chunk", "datetime").collect()
    assert [(r.animal_id, r.chunk, r.datetime, r.act, r.temp) for r in rows] == [
        ("a1", 0, at("2020-01-01 00:00"), 1.5, 38.0),
        ("a1", 0, at("2020-01-01 00:10"), None, 39.0),
        ("a1", 1, at("2020-01-01 00:10"), 7.0, 40.0),
        ("a10", 0, at("2020-01-01 00:00"), 9.0, None),
    ]
    animals = spark.createDataFrame([("a1", "o")], "animal_id string, organisation_id string")
    merged = SR.consolidate(SR.read_sensor_csv(spark, str(tmp_path)), animals)
    assert {(r.organisation_id, r.animal_id, r.act) for r in merged.collect()} == {("o", "a1", 1.5), ("o", "a1", None), (None, "a10", 9.0)}


def test_stream_reads_every_file_once(spark, tmp_path):
    drop, target, seen = (tmp_path / n for n in ("drop", "target", "seen"))
    drop.mkdir()
    write_csv(drop, "a|0.csv", "1577836800,1,38")
    ingest_new_files(spark, str(drop), str(target), str(seen))
    ingest_new_files(spark, str(drop), str(target), str(seen))
    assert spark.read.parquet(str(target)).count() == 1
    write_csv(drop, "b|0.csv", "1577836800,2,38", "1577836801,3,38")
    ingest_new_files(spark, str(drop), str(target), str(seen))
    assert sorted(r.act for r in spark.read.parquet(str(target)).collect()) == [1.0, 2.0, 3.0]


def test_stream_takes_many_small_files_at_once(spark, tmp_path):
    drop, target, seen = (tmp_path / n for n in ("drop", "target", "seen"))
    drop.mkdir()
    for i in range(1200):
        write_csv(drop, f"a{i}|0.csv", f"1577836800,{i},38")
    listing = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(listing)
    ingest_new_files(spark, str(drop), str(target), str(seen))
    assert spark.read.parquet(str(target)).agg(F.count("*"), F.sum("act")).first() == (1200, sum(range(1200)))
    assert [f.name for f in (seen / "commits").iterdir() if f.name.isdigit()] == ["0"]
    assert spark.conf.get(listing) == before


def test_stream_lists_files_in_tasks(spark, tmp_path, monkeypatch):
    """The stream's log names lists of files, a bounded number of files each, and none of the files."""
    drop, target, seen = (tmp_path / n for n in ("drop", "target", "seen"))
    (drop / "below").mkdir(parents=True)
    monkeypatch.setattr(ingest, "FILES_PER_LIST", 3, raising=False)
    for i in range(10):
        write_csv(drop / ("below" if i % 2 else "."), f"a {i}|0.csv", f"1577836800,{i},38")
    ingest_new_files(spark, str(drop), str(target), str(seen))
    write_csv(drop, "b|1.csv", "1577836800,10,38")
    ingest_new_files(spark, str(drop), str(target), str(seen))
    ingest_new_files(spark, str(drop), str(target), str(seen))
    rows = spark.read.parquet(str(target)).collect()
    assert sorted(r.act for r in rows) == list(range(11))
    assert {r.animal_id for r in rows} == {*(f"a {i}" for i in range(10)), "b"} and {r.chunk for r in rows} == {0, 1}
    logs = "".join(f.read_text() for f in (seen / "sources" / "0").iterdir() if f.name.isdigit())
    assert ".csv" not in logs and logs.count("parquet") == 5
    # Columns in another order end the stream; nothing of the file is kept.
    (drop / "c|0.csv").write_text("ts,temp,act\n1577836800,1,2\n")
    with pytest.raises(StreamingQueryException):
        ingest_new_files(spark, str(drop), str(target), str(seen))
    assert spark.read.parquet(str(target)).count() == 11
    write_csv(drop, "c|0.csv", "1577836800,11,38")
    ingest_new_files(spark, str(drop), str(target), str(seen))
    assert spark.read.parquet(str(target)).count() == 12


def test_stream_goes_on_with_a_checkpoint_of_files(spark, tmp_path, monkeypatch):
    drop, target, seen = (tmp_path / n for n in ("drop", "target", "seen"))
    drop.mkdir()
    write_csv(drop, "a|0.csv", "1577836800,1,38")
    with monkeypatch.context() as m:
        m.setattr(files, "listed", lambda *_: None)
        ingest_new_files(spark, str(drop), str(target), str(seen))
    write_csv(drop, "b|0.csv", "1577836800,2,38")
    ingest_new_files(spark, str(drop), str(target), str(seen))
    assert sorted(r.act for r in spark.read.parquet(str(target)).collect()) == [1.0, 2.0]


def test_feature_table_load(spark):
    rows = [("aa", "bb", "ca", at("2020-01-01 00:00"), 1), ("aa", "ba", "cb", at("2020-01-01 00:10"), 2), ("ab", "bd", "cc", at("2020-01-01 00:20"), 3), ("ac", "bc", "cd", at("2020-01-01 00:30"), 4)]
    table = spark.createDataFrame(rows, "organisation_id string, group_id string, animal_id string, datetime timestamp_ntz, temp int")
    ordered = sorted(rows)
    assert [tuple(r) for r in SR.load_features(table).collect()] == ordered
    assert [tuple(r) for r in SR.load_features(table, ["aa", "ab"]).collect()] == ordered[:3]
    assert SR.load_animal(table, "cc", with_keys=False).columns == ["datetime", "temp"]
    assert SR.series_of(table, "aa", "nobody").count() == 0


def herd(spark, *rows):
    return spark.createDataFrame([(o, a, at("2020-01-01"), v) for o, a, v in rows], "organisation_id string, animal_id string, datetime timestamp_ntz, act double")


def stored(spark, path):
    return sorted((r.organisation_id, r.animal_id, r.act) for r in spark.read.parquet(path).collect())


def test_replace_partitions(spark, tmp_path):
    path = str(tmp_path / "readings")
    tables.write_readings(herd(spark, ("x", "a", 1.0), ("y", "b", 2.0)), path)
    tables.replace_partitions(herd(spark, ("y", "c", 3.0)), path)
    assert stored(spark, path) == [("x", "a", 1.0), ("y", "c", 3.0)]
    tables.rebuild(herd(spark, ("z", "d", 4.0)), path)
    assert stored(spark, path) == [("z", "d", 4.0)]


def test_upsert_and_incremental(spark):
    old, new = herd(spark, ("x", "a", 1.0), ("x", "b", 2.0)), herd(spark, ("x", "b", 5.0), ("x", "c", 6.0))
    assert sorted(r.act for r in tables.upsert_by_key(old, new).collect()) == [1.0, 5.0, 6.0]
    keys = ["organisation_id", "animal_id"]
    assert [r.animal_id for r in tables.only_new(new, old, keys).collect()] == ["c"]
    assert tables.only_new(new, old, keys, update=True).count() == 2
    assert sorted(r.animal_id for r in tables.stored_keys(new, old).collect()) == ["a", "b", "c"]
    parts = spark.createDataFrame([("x", "b", p) for p in ("animal", "events", "sensordata")] + [("x", "c", "animal")] * 3, "organisation_id string, animal_id string, part string")
    assert [r.animal_id for r in tables.incomplete_animals(new, parts).collect()] == ["c"]


def test_export_and_slice(spark, tmp_path):
    rows = spark.range(100).select(
        F.lit("o").alias("organisation_id"),
        (F.col("id") % 3).cast("string").alias("animal_id"),
        F.timestamp_seconds(F.col("id") * 600).cast("timestamp_ntz").alias("datetime"),
        *[F.col("id").cast("double").alias(n) for n in ("DIM", "act", "act_group_mean")],
        F.when(F.col("id") % 10 > 0, F.col("id")).alias("temp_filtered"),
        F.lit(1).alias("annotation"),
    )
    tables.export_training(rows, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 90 and {f.dataType.simpleString() for f in back.schema if f.name in ("annotation", "DIM", "act")} == {"float"}
    ids = [r.row_id for r in back.orderBy("organisation_id", "animal_id", "datetime").collect()]
    assert ids == list(range(90))
    assert [r.row_id for r in tables.row_slice(back, 10, 13).orderBy("row_id").collect()] == [10, 11, 12]


def test_lookup(spark):
    animals = spark.createDataFrame([("a", "o1"), ("b", "o2")], "animal_id string, organisation_id string")
    asked = spark.createDataFrame([("a",), ("z",)], "animal_id string")
    assert {tuple(r) for r in joins.organisation_of(asked, animals).collect()} == {("a", "o1"), ("z", None)}
    newer = spark.createDataFrame([("b", "o3")], "animal_id string, organisation_id string")
    assert {tuple(r) for r in joins.merge_lookup(animals, newer).collect()} == {("a", "o1"), ("b", "o3")}

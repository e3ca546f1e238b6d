"""Scans, sinks, projections, filters, joins, aggregates and set operations."""

from __future__ import annotations

import re
from datetime import datetime

from pyarrow import fs
from pyspark.sql import functions as F

from herdsignal import schemas
from herdsignal.functions import names, numbers, time as T
from herdsignal.operators import clean, features, joins, metrics, sequences, split
from herdsignal.operators.series import ANIMAL
from herdsignal.plans import relations as R
from herdsignal.plans.registry import query, six
from herdsignal.plans.relations import sql
from herdsignal.session import fresh_path
from herdsignal.sources import documents, quarantine, readings as SR, tables
from herdsignal.streaming.ingest import ingest_new_files

ROWS = ["organisation_id", "animal_id", "datetime", "act", "temp"]


def _csv_drop(spark, sf, folder: str, first_half: bool | None = None) -> None:
    """Readings in whole seconds as files ``{animal}|{chunk}.csv``, chunk 1 from the 16th of the month on."""
    rows = R.readings(spark, sf)
    chunk = (F.dayofmonth("datetime") > 15).cast("int")
    if first_half is not None:
        rows = rows.where(chunk == (0 if first_half else 1))
    name = F.concat("animal_id", F.lit("|"), chunk.cast("string"), F.lit(".csv"))

    def write(group):
        system, root = fs.FileSystem.from_uri(re.sub("^file:/(?=[^/])", "file:///", folder))
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{group['file'].iloc[0]}", compression=None) as out:
            out.write(group[["ts", "act", "temp"]].to_csv(index=False).encode())
        return group[["file"]].head(1)

    files = rows.select(name.alias("file"), T.encode_epoch(F.col("datetime")).alias("ts"), "act", "temp")
    # Small rows, but a file to write for each animal: dealt to as many tasks as a shuffle may have.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files.repartition(tasks, "file").groupBy("file").applyInPandas(write, "file string").count()


_CSV_ROWS = """
    SELECT CAST(user_id AS VARCHAR) AS animal_id, CAST(day(ts) > 15 AS INTEGER) AS chunk,
           CAST(date_trunc('second', ts) AS TIMESTAMP) AS datetime, value AS act,
           CAST(25 AS DOUBLE) + CAST(0.2 AS DOUBLE) * CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS temp
    FROM events"""


@query("a1_read_sensor_csv", sql(_CSV_ROWS))
def _(spark, sf):
    folder = fresh_path(spark, "drop")
    _csv_drop(spark, sf, folder)
    return SR.read_sensor_csv(spark, folder)


_DOCUMENT = sql("""
    SELECT 'o' || o_orderkey AS animal_id, CAST(o_custkey % 5 AS VARCHAR) AS organisation_id,
           CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS group_id,
           CAST(o_custkey AS VARCHAR) AS current_device_id, o_orderstatus = 'F' AS archived, o_orderdate AS created_at,
           o_orderstatus AS tag, CASE WHEN o_orderstatus <> 'P' THEN 'open' END AS state,
           CAST(CASE WHEN o_orderstatus <> 'P' THEN 2 END AS DOUBLE) AS cycles,
           CAST(o_orderstatus <> 'P' AND o_orderpriority = '5-LOW' AS INTEGER) AS errors
    FROM orders""")


def _document_columns(decoded):
    return decoded.select(
        F.col("_id").alias("animal_id"),
        "organisation_id",
        "group_id",
        "current_device_id",
        "archived",
        "created_at",
        F.col("tags")[0].alias("tag"),
        F.col("lifecycle.state").alias("state"),
        F.when(F.col("lifecycle").isNotNull(), F.size("lifecycle.cycles_with_padding")).cast("double").alias("cycles"),
        F.size("errors").alias("errors"),
    )


@query("a2_read_documents", _DOCUMENT)
def _(spark, sf):
    path = fresh_path(spark, "documents")
    R.animal_documents(spark, sf).select("json").write.text(path)
    return _document_columns(documents.read_documents(spark, path, "animal"))


def _stored(spark, sf) -> str:
    path = fresh_path(spark, "readings")
    tables.write_readings(R.readings(spark, sf).select(*ROWS), path)
    return path


@query("a3_keyed_scan", sql("SELECT organisation_id, animal_id, datetime, act, temp FROM readings WHERE organisation_id = '1' AND animal_id = '7'"))
def _(spark, sf):
    return SR.series_of(tables.read_table(spark, _stored(spark, sf)).select(*ROWS), "1", "7")


@query("a4_metric_range", sql("""
    SELECT organisation_id, animal_id, datetime, act FROM readings
    WHERE datetime BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'"""))
def _(spark, sf):
    first, last = datetime(2024, 1, 5), datetime(2024, 1, 20, 12)
    return SR.readings_between(R.readings(spark, sf), first, last, metrics=["act"])


_SEGMENTS = dict(days=8, step=7)


@query("a5_time_segments", sql("""
    SELECT r.organisation_id, r.animal_id, r.datetime, CAST(s.i AS BIGINT) AS segment
    FROM readings r JOIN (
        SELECT i, TIMESTAMP '2024-01-01' + to_days(7 * i) AS a,
               CASE WHEN i < 4 THEN TIMESTAMP '2024-01-01' + to_days(7 * i + 8) ELSE TIMESTAMP '2024-01-31' END AS b
        FROM (SELECT CAST(unnest(range(5)) AS INTEGER) AS i)) s ON r.datetime BETWEEN s.a AND s.b"""))
def _(spark, sf):
    first, last = datetime(2024, 1, 1), datetime(2024, 1, 31)
    return SR.in_segments(R.readings(spark, sf), first, last, **_SEGMENTS).select(*ANIMAL, "datetime", "segment")


@query("a5_segments_merged", sql("SELECT organisation_id, animal_id, datetime, act FROM readings QUALIFY row_number() OVER (PARTITION BY organisation_id, animal_id, datetime ORDER BY event_id) = 1"))
def _(spark, sf):
    first, last = datetime(2024, 1, 1), datetime(2024, 1, 31)
    parts = SR.in_segments(R.readings(spark, sf), first, last, **_SEGMENTS)
    return clean.dedup_first(parts, ["event_id", "segment"]).select(*ANIMAL, "datetime", "act")


_INTERVALS = r"""
    SELECT event_id AS segment, CAST(user_id % 2 AS VARCHAR) AS organisation_id, CAST(user_id AS VARCHAR) AS animal_id,
           ts - to_hours(CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER)) AS first,
           ts - to_hours(CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER)) + to_hours(1 << CAST(event_id % 15 AS INTEGER)) AS last
    FROM events WHERE event_type = 'signup'"""


@query("a5_irregular_segments", sql("""
    SELECT r.organisation_id, r.animal_id, r.datetime, r.event_id, i.segment
    FROM readings r JOIN intervals i ON r.organisation_id = i.organisation_id AND r.animal_id = i.animal_id
     AND r.datetime BETWEEN i.first AND i.last""", intervals=_INTERVALS))
def _(spark, sf):
    events = R.table(spark, sf, "events").where("event_type = 'signup'")
    begin = F.col("ts") - F.make_dt_interval(hours=F.get_json_object("props", "$.k").cast("int"))
    hours = F.expr("shiftleft(1, cast(event_id % 15 as int))")
    intervals = events.select(
        F.col("event_id").alias("segment"), (F.col("user_id") % 2).cast("string").alias("organisation_id"), F.col("user_id").cast("string").alias("animal_id"),
        begin.alias("first"), (begin + F.make_dt_interval(hours=hours)).alias("last"),
    )
    return SR.in_intervals(R.readings(spark, sf), intervals).select(*ANIMAL, "datetime", "event_id", "segment")


@query("a6_predicate_scan", sql("SELECT datetime, act FROM readings WHERE animal_id = '3'"))
def _(spark, sf):
    return SR.metric_of(R.readings(spark, sf), "3")


@query("a7_load_features", sql("SELECT organisation_id, group_id, animal_id, datetime, act, temp FROM readings WHERE organisation_id IN ('1')"))
def _(spark, sf):
    chosen = R.readings(spark, sf).select("organisation_id", "group_id", "animal_id", "datetime", "act", "temp")
    return SR.load_features(chosen, ["1"])


@query("a8_write_readings", sql("SELECT organisation_id, animal_id, datetime, act, temp FROM readings"))
def _(spark, sf):
    return tables.read_table(spark, _stored(spark, sf)).select(*ROWS)


@query("a8_text_keys", sql("SELECT '00' || organisation_id AS organisation_id, animal_id, datetime, act FROM readings"))
def _(spark, sf):
    path = fresh_path(spark, "readings")
    tables.write_readings(R.readings(spark, sf).select(*ROWS).withColumn("organisation_id", F.concat(F.lit("00"), "organisation_id")), path)
    return tables.read_table(spark, path).select(*ANIMAL, "datetime", "act")


@query("a1_consolidate", sql(f"""
    SELECT organisation_id, animal_id, datetime, act, temp FROM (
        SELECT c.*, h.organisation_id FROM ({_CSV_ROWS}) c LEFT JOIN herd h USING (animal_id))
    QUALIFY row_number() OVER (PARTITION BY organisation_id, animal_id, datetime ORDER BY chunk, act, temp) = 1"""))
def _(spark, sf):
    folder = fresh_path(spark, "drop")
    _csv_drop(spark, sf, folder)
    return SR.consolidate(SR.read_sensor_csv(spark, folder), R.herd(spark, sf)).select(*ROWS)


@query("a9_replace_partitions", sql("SELECT organisation_id, animal_id, datetime, CASE WHEN organisation_id = '1' THEN act + 1 ELSE act END AS act, temp FROM readings"))
def _(spark, sf):
    path = _stored(spark, sf)
    changed = R.readings(spark, sf).where("organisation_id = '1'").withColumn("act", F.col("act") + 1).select(*ROWS)
    tables.replace_partitions(changed, path)
    return tables.read_table(spark, path).select(*ROWS)


@query("a9_upsert_by_key", sql("""
    SELECT organisation_id, animal_id, datetime, CASE WHEN group_id = '2' THEN -act ELSE act END AS act FROM readings"""))
def _(spark, sf):
    old = R.readings(spark, sf).select(*ANIMAL, "datetime", "act", "group_id")
    new = old.where("group_id = '2'").withColumn("act", -F.col("act"))
    return tables.upsert_by_key(old, new).select(*ANIMAL, "datetime", "act")


@query("a9_replace_keys", sql("""
    SELECT CASE WHEN group_id = '2' AND CAST(animal_id AS INTEGER) % 8 = 2 THEN '9' ELSE organisation_id END AS organisation_id,
           animal_id, datetime, CASE WHEN group_id = '2' THEN -act ELSE act END AS act, temp
    FROM readings"""))
def _(spark, sf):
    path = _stored(spark, sf)
    moved = (F.col("group_id") == "2") & (F.col("animal_id").cast("int") % 8 == 2)
    new = R.readings(spark, sf).where("group_id = '2'").withColumns(
        {"act": -F.col("act"), "organisation_id": F.when(moved, F.lit("9")).otherwise(F.col("organisation_id"))}
    )
    tables.replace_keys(new.select(*ROWS), path)
    return tables.read_table(spark, path).select(*ROWS)


@query("a11_only_new", sql("""
    SELECT organisation_id, animal_id, c_mktsegment FROM animals
    WHERE animal_id NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier)"""))
def _(spark, sf):
    stored = R.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("animal_id"))
    return tables.only_new(R.animals(spark, sf), stored, ["animal_id"]).select(*ANIMAL, "c_mktsegment")


@query("a11_incomplete_animals", sql("""
    SELECT organisation_id, animal_id FROM herd WHERE (organisation_id, animal_id) NOT IN (
        SELECT (CAST(user_id % 2 AS VARCHAR), CAST(user_id AS VARCHAR)) FROM events
        GROUP BY user_id HAVING count(DISTINCT day(ts)) >= 28)"""))
def _(spark, sf):
    parts = R.readings(spark, sf).withColumn("part", F.dayofmonth("datetime").cast("string"))
    return tables.incomplete_animals(R.herd(spark, sf), parts, needed=28).select(*ANIMAL)


@query("a11_only_new_update", sql("SELECT organisation_id, animal_id, c_mktsegment FROM animals"))
def _(spark, sf):
    stored = R.table(spark, sf, "supplier").select(F.col("s_nationkey").cast("string").alias("organisation_id"))
    return tables.only_new(R.animals(spark, sf), stored, ["organisation_id"], update=True).select(*ANIMAL, "c_mktsegment")


@query("a11_ingest_stream", sql(_CSV_ROWS))
def _(spark, sf):
    folder, target, seen = (fresh_path(spark, name) for name in ("drop", "readings", "seen"))
    _csv_drop(spark, sf, folder, first_half=True)
    ingest_new_files(spark, folder, target, seen)
    _csv_drop(spark, sf, folder, first_half=False)
    ingest_new_files(spark, folder, target, seen)
    return tables.read_table(spark, target)


@query("a12_rebuild", sql("SELECT organisation_id, animal_id, datetime, act, temp FROM readings WHERE act > 20"))
def _(spark, sf):
    path = fresh_path(spark, "derived")
    rows = R.readings(spark, sf).select(*ROWS)
    tables.rebuild(rows, path)
    tables.rebuild(rows.where("act > 20"), path)
    return tables.read_table(spark, path)


@query("b1_anonymise", sql("SELECT organisation_id, n_regionkey FROM organisations"))
def _(spark, sf):
    return documents.anonymise(R.organisations(spark, sf))


@query("b2_epoch_to_time", sql("SELECT event_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS datetime FROM events"))
def _(spark, sf):
    epoch = F.unix_seconds(F.col("ts").cast("timestamp"))
    return R.table(spark, sf, "events").select("event_id", T.from_epoch_seconds(epoch).alias("datetime"))


def _time_texts(spark, sf):
    """Times as ISO text, as epoch text or as neither."""
    kind = F.col("event_type")
    epoch = F.unix_seconds(F.col("ts").cast("timestamp")).cast("string")
    text = F.when(kind == "error", kind).when(kind.isin("click", "signup"), epoch).otherwise(F.col("ts").cast("string"))
    return R.table(spark, sf, "events").select("event_id", text.alias("ts"))


@query("b3_repair_time", sql("SELECT event_id, CAST(CASE WHEN event_type <> 'error' THEN date_trunc('second', ts) END AS TIMESTAMP) AS datetime FROM events"))
def _(spark, sf):
    return clean.repair_time(_time_texts(spark, sf)).select("event_id", "datetime")


@query("b3_unreadable", sql("SELECT event_id, event_type AS ts FROM events WHERE event_type = 'error'"))
def _(spark, sf):
    return clean.split_unreadable(clean.repair_time(_time_texts(spark, sf)))[1].select("event_id", "ts")


def _with_broken_files(spark, sf) -> str:
    """Stored readings; beside the first file of each organisation lie a copy cut in half and one with a hole of zeros."""
    path = _stored(spark, sf)
    listed = spark.read.format("binaryFile").options(pathGlobFilter="*.parquet", recursiveFileLookup=True).load(path)
    firsts = listed.groupBy(F.regexp_extract("path", "^(.*)/", 1).alias("folder")).agg(F.min("path").alias("path"))

    def spoil(parts):
        for part in parts:
            for folder, file in zip(part["folder"], part["path"]):
                for name in ("cut", "damaged"):
                    system, source = quarantine.open_at(file)
                    _, target = quarantine.open_at(f"{folder}/{name}.parquet")
                    size = system.get_file_info(source).size
                    with system.open_input_stream(source, compression=None) as whole, system.open_output_stream(target, compression=None) as out:
                        out.write(whole.read(size // 4))
                        if name == "damaged":
                            out.write(bytes(len(whole.read(size // 4))))
                            while piece := whole.read(1 << 20):
                                out.write(piece)
            yield part[["path"]]

    firsts.mapInPandas(spoil, "path string").count()
    return path


_STORED = "organisation_id string, animal_id string, datetime timestamp_ntz, act double, temp double"


@query("b3_intact_files", sql("SELECT organisation_id, animal_id, datetime, act, temp FROM readings"))
def _(spark, sf):
    return quarantine.read_parquet(spark, _with_broken_files(spark, sf), _STORED)[0].select(*ROWS)


@query("b3_unreadable_files", sql("""
    SELECT DISTINCT 'organisation_id=' || organisation_id || '/' || name AS file
    FROM readings, (VALUES ('cut.parquet'), ('damaged.parquet')) AS broken(name)"""))
def _(spark, sf):
    failures = quarantine.read_parquet(spark, _with_broken_files(spark, sf), _STORED)[1]
    return failures.select(F.regexp_extract("path", "([^/]*/[^/]*)$", 1).alias("file"))


@query("b4_drop_series", sql("SELECT organisation_id, animal_id, datetime, act FROM readings WHERE CAST(animal_id AS BIGINT) NOT IN (SELECT s_suppkey FROM supplier)"))
def _(spark, sf):
    supplier = R.table(spark, sf, "supplier")
    blocked = supplier.select(
        (F.col("s_suppkey") % 2).cast("string").alias("organisation_id"), F.col("s_suppkey").cast("string").alias("animal_id")
    )
    return clean.drop_series(R.readings(spark, sf), blocked).select(*ANIMAL, "datetime", "act")


@query("b5_wall_time", sql("SELECT event_id, ts AS datetime FROM events"))
def _(spark, sf):
    return R.table(spark, sf, "events").select("event_id", T.wall_time(F.col("ts").cast("timestamp")).alias("datetime"))


@query("b6_snap_to_grid", sql("""
    SELECT event_id, make_timestamp(CAST(round_even(epoch_us(datetime) / 600000000.0, 0) AS BIGINT) * 600000000) AS datetime
    FROM readings"""))
def _(spark, sf):
    return clean.snap_to_grid(R.readings(spark, sf)).select("event_id", "datetime")


@query("b7_float32", sql("SELECT event_id, CAST(act AS FLOAT) AS act, CAST(temp AS FLOAT) AS temp FROM readings"))
def _(spark, sf):
    return R.readings(spark, sf).select("event_id", *[numbers.float32(F.col(n)).alias(n) for n in ("act", "temp")])


@query("b8_round_half_even", sql("SELECT event_id, round_even(act * 1000 / CAST(8 AS DOUBLE), 2) AS act, CAST(trunc(act) AS INTEGER) AS whole FROM readings"))
def _(spark, sf):
    return R.readings(spark, sf).select(
        "event_id",
        numbers.round_half_even(F.col("act") * 1000 / 8.0).alias("act"),
        numbers.signed_int(F.col("act")).alias("whole"),
    )


@query("b9_parse_iso", sql("SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS parsed FROM orders"))
def _(spark, sf):
    text = F.date_format("o_orderdate", T.ISO_PATTERN)
    text = F.when(F.col("o_orderstatus") == "F", text).when(
        F.col("o_orderstatus") == "O", text
    )
    return R.table(spark, sf, "orders").select("o_orderkey", T.parse_iso(text).alias("parsed"))


@query("b10_datetime_field", sql("""
    SELECT event_id, ts AS decoded,
           CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
                ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS encoded,
           strftime(ts, '%Y-%m-%dT%H:%M:%S') || '-02:00' AS kept
    FROM events"""))
def _(spark, sf):
    iso = F.date_format("ts", T.ISO_PATTERN + ".SSSSSS")
    decoded = T.decode_datetime(F.concat(iso, F.lit("+02:00")))
    plain = F.date_format("ts", T.ISO_PATTERN)
    return R.table(spark, sf, "events").select(
        "event_id",
        decoded.alias("decoded"),
        T.encode_datetime(T.strip_offset(F.concat(iso, F.lit("+02:00"))).cast("timestamp_ntz")).alias("encoded"),
        T.strip_offset(F.concat(plain, F.lit("-02:00"))).alias("kept"),
    )


@query("b11_epoch_field", sql("""
    SELECT o_orderkey,
           CASE WHEN o_orderpriority = '1-URGENT' THEN 'invalid'
                WHEN o_orderpriority <> '5-LOW' AND o_orderdate <= TIMESTAMP '2000-01-01' THEN 'invalid_date' END AS error,
           CASE WHEN o_orderpriority NOT IN ('1-URGENT', '5-LOW') AND o_orderdate > TIMESTAMP '2000-01-01'
                THEN o_orderdate END AS decoded
    FROM orders"""))
def _(spark, sf):
    priority = F.col("o_orderpriority")
    value = F.when(priority == "1-URGENT", priority).when(
        priority != "5-LOW", T.encode_epoch(F.col("o_orderdate")).cast("string")
    )
    orders = R.table(spark, sf, "orders").withColumn("value", value)
    return orders.select(
        "o_orderkey", T.epoch_error(F.col("value")).alias("error"), T.decode_epoch(F.col("value")).alias("decoded")
    )


@query("b12_decode_documents", _DOCUMENT)
def _(spark, sf):
    decoded = schemas.decode(R.animal_documents(spark, sf), "json", "animal")
    return _document_columns(decoded.select("document.*", "errors"))


@query("b13_encode_documents", sql("""
    SELECT 'o' || o_orderkey AS animal_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS created_at,
           CAST(o_custkey AS VARCHAR) AS sensor,
           CASE WHEN o_orderstatus <> 'P' THEN 'insemination' END AS second_event,
           CASE WHEN o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW'
                THEN strftime(o_orderdate + to_days(21), '%Y-%m-%dT%H:%M:%S') END AS second_event_ts
    FROM orders"""))
def _(spark, sf):
    decoded = schemas.decode(R.animal_documents(spark, sf), "json", "animal")
    encoded = schemas.encode(decoded.drop("errors"), "document", "animal")
    event = "$.lifecycle.cycles[0].events[1]"
    return encoded.select(
        F.get_json_object("json", "$._id").alias("animal_id"),
        F.get_json_object("json", "$.created_at").alias("created_at"),
        F.get_json_object("json", "$.sensor").alias("sensor"),
        F.get_json_object("json", f"{event}.event_type").alias("second_event"),
        F.get_json_object("json", f"{event}.event_ts").alias("second_event_ts"),
    )


@query("b13_error_counts", sql("""
    SELECT 'lifecycle.cycles.events.event_ts: invalid' AS error, count(*) AS n
    FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority = '5-LOW'"""))
def _(spark, sf):
    return schemas.error_counts(schemas.decode(R.animal_documents(spark, sf), "json", "animal"))


@query("b14_leave_out_fields", sql("SELECT 'o' || o_orderkey AS animal_id, o_orderdate AS created_at, FALSE AS has_sensor FROM orders"))
def _(spark, sf):
    decoded = schemas.decode(R.animal_documents(spark, sf), "json", "animal_simple_v2")
    thinner = schemas.without(decoded, "document", "current_device_id", "tags")
    has = "current_device_id" in thinner.select("document.*").columns
    return thinner.select("document._id", "document.created_at").select(
        F.col("_id").alias("animal_id"), "created_at", F.lit(has).alias("has_sensor")
    )


def _flat_events(spark, sf):
    return documents.flatten_event_documents(R.animal_documents(spark, sf))


@query("b15_flatten_events", sql("SELECT organisation_id, animal_id, cycle_no, event_type, event_ts FROM document_events"))
def _(spark, sf):
    return _flat_events(spark, sf).select(*ANIMAL, "cycle_no", "event_type", "event_ts")


@query("b15_flatten_decoded", sql("SELECT organisation_id, animal_id, cycle_no, event_type, event_ts FROM document_events"))
def _(spark, sf):
    animals = schemas.decode(R.animal_documents(spark, sf), "json", "animal").select("document.*")
    return documents.flatten_events(animals).select(*ANIMAL, "cycle_no", "event_type", "event_ts")


@query("b16_event_types", sql("SELECT animal_id, event_ts, event_type FROM lifecycle_events WHERE event_type IN ('heat', 'insemination')"))
def _(spark, sf):
    from herdsignal.operators.events import of_type

    return of_type(R.lifecycle_events(spark, sf), "heat", "insemination").select("animal_id", "event_ts", "event_type")


def _maybe_grouped(spark, sf):
    animals = R.animals(spark, sf)
    return animals.withColumn("group_id", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")))


@query("b17_default_group", sql("SELECT animal_id, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment ELSE 'N/A' END AS group_id FROM animals"))
def _(spark, sf):
    return clean.default_group(_maybe_grouped(spark, sf), reject_missing=False).select("animal_id", "group_id")


@query("b17_reject_groupless", sql("SELECT animal_id, c_mktsegment AS group_id FROM animals WHERE c_mktsegment <> 'BUILDING'"))
def _(spark, sf):
    return clean.default_group(_maybe_grouped(spark, sf)).select("animal_id", "group_id")


@query("b18_attach_keys", sql("SELECT r.organisation_id, h.group_id, r.animal_id, r.datetime, r.act FROM readings r JOIN herd h USING (organisation_id, animal_id)"))
def _(spark, sf):
    readings = R.readings(spark, sf).drop("group_id")
    return readings.join(R.herd(spark, sf), list(ANIMAL)).select("organisation_id", "group_id", "animal_id", "datetime", "act")


@query("b19_required", sql("SELECT event_id, act FROM (SELECT event_id, CASE WHEN act > 10 THEN act END AS act, temp FROM readings) WHERE act IS NOT NULL AND temp IS NOT NULL"))
def _(spark, sf):
    gaps = R.readings(spark, sf).withColumn("act", F.when(F.col("act") > 10, F.col("act")))
    return clean.required(gaps, ["act", "temp"]).select("event_id", "act")


@query("b20_plausible", sql("SELECT event_id, temp FROM readings WHERE temp > 30"))
def _(spark, sf):
    return clean.plausible(R.readings(spark, sf)).select("event_id", "temp")


@query("b21_min_history", sql("""
    SELECT organisation_id, animal_id, datetime FROM readings WHERE temp > 30
    QUALIFY count(*) OVER (PARTITION BY organisation_id, animal_id) >= 50"""))
def _(spark, sf):
    return clean.min_history(clean.plausible(R.readings(spark, sf)), 50).select(*ANIMAL, "datetime")


@query("b23_date_slice", sql("SELECT event_id, datetime FROM readings WHERE datetime >= TIMESTAMP '2024-01-03' AND datetime < TIMESTAMP '2024-01-14'"))
def _(spark, sf):
    return clean.date_slice(R.readings(spark, sf), "2024-01-03", "2024-01-13").select("event_id", "datetime")


@query("b24_key_slice", sql("SELECT animal_id, datetime, act FROM readings WHERE organisation_id = '0' AND group_id = '2'"))
def _(spark, sf):
    return clean.key_slice(R.readings(spark, sf), organisation_id="0", group_id="2").select("animal_id", "datetime", "act")


@query("b26_prune_columns", sql("SELECT organisation_id, animal_id, group_id, datetime, act, event_id FROM readings"))
def _(spark, sf):
    return clean.for_trees(R.readings(spark, sf))


@query("b27_logistic", sql("SELECT doc_id, round(exp(logit) / (exp(logit) + 1) + 1e-9, 6) AS probability FROM predictions"))
def _(spark, sf):
    return R.predictions(spark, sf).select("doc_id", six(numbers.logistic(F.col("logit"))).alias("probability"))


@query("b28_class_tag", sql("SELECT doc_id, CAST(round_even(exp(logit) / (exp(logit) + 1), 0) AS INTEGER) AS tag FROM predictions"))
def _(spark, sf):
    return R.predictions(spark, sf).select("doc_id", numbers.class_tag(numbers.logistic(F.col("logit"))).alias("tag"))


@query("b29_file_names", sql(r"""
    SELECT event_id, CAST(user_id AS VARCHAR) AS animal_id, CAST(event_id % 3 AS INTEGER) AS chunk,
           event_type <> 'view' AS is_sensor_file, event_type <> 'view' AND user_id = 1 AS is_of_one
    FROM events"""))
def _(spark, sf):
    suffix = F.when(F.col("event_type") != "view", ".csv").otherwise(".pkl")
    name = F.concat(F.col("user_id").cast("string"), F.lit("|"), (F.col("event_id") % 3).cast("string"))
    events = R.table(spark, sf, "events").select("event_id", name.alias("stem"), F.concat(name, suffix).alias("name"))
    return events.select(
        "event_id",
        names.animal_of(F.col("name")).alias("animal_id"),
        names.chunk_of(F.col("stem")).alias("chunk"),
        names.is_sensor_file(F.col("name")).alias("is_sensor_file"),
        names.belongs_to(F.col("name"), F.lit("1")).alias("is_of_one"),
    )


@query("b30_calendar_day", sql("SELECT DISTINCT animal_id, CAST(CAST(datetime AS DATE) AS TIMESTAMP) AS day FROM readings"))
def _(spark, sf):
    return R.readings(spark, sf).select("animal_id", T.calendar_day(F.col("datetime")).cast("timestamp_ntz").alias("day")).distinct()


@query("c1_organisation_lookup", sql("""
    SELECT r.event_id, r.animal_id, a.organisation_id FROM readings r LEFT JOIN
        (SELECT animal_id, organisation_id FROM animals) a USING (animal_id)"""))
def _(spark, sf):
    return joins.organisation_of(R.readings(spark, sf).select("event_id", "animal_id"), R.animals(spark, sf))


@query("c1_merge_lookup", sql("""
    SELECT animal_id, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'moved' ELSE organisation_id END AS organisation_id
    FROM animals"""))
def _(spark, sf):
    animals = R.animals(spark, sf)
    moved = animals.where("c_mktsegment = 'MACHINERY'").select("animal_id", F.lit("moved").alias("organisation_id"))
    return joins.merge_lookup(animals.select("animal_id", "organisation_id"), moved)


@query("c2_compose", sql("""
    SELECT e.event_id, CAST(a.c_nationkey AS VARCHAR) AS organisation_id, CAST(e.user_id AS VARCHAR) AS animal_id,
           n.n_regionkey, a.c_mktsegment
    FROM events e JOIN customer a ON e.user_id = a.c_custkey JOIN nation n ON a.c_nationkey = n.n_nationkey"""))
def _(spark, sf):
    placed = joins.organisation_of(R.readings(spark, sf).select("event_id", "animal_id"), R.animals(spark, sf))
    return joins.compose(placed, R.animals(spark, sf), R.organisations(spark, sf)).select(
        "event_id", *ANIMAL, "n_regionkey", "c_mktsegment"
    )


@query("c3_missing_ids", sql("SELECT animal_id FROM animals WHERE NOT EXISTS (SELECT 1 FROM herd h WHERE h.animal_id = animals.animal_id)"))
def _(spark, sf):
    return joins.missing_ids(R.animals(spark, sf).select("animal_id"), R.herd(spark, sf), ["animal_id"])


@query("d1_animals_per_organisation", sql("""
    SELECT o.organisation_id, o.name, count(a.animal_id) AS animals
    FROM organisations o LEFT JOIN animals a USING (organisation_id) GROUP BY ALL"""))
def _(spark, sf):
    return metrics.animals_per_organisation(R.organisations(spark, sf), R.animals(spark, sf)).select("organisation_id", "name", "animals")


@query("d2_group_mean", sql("""
    SELECT organisation_id, animal_id, datetime, act,
           round(CASE WHEN count(act) OVER w >= 5 THEN avg(act) OVER w END + 1e-9, 6) AS act_group_mean
    FROM grid6h WINDOW w AS (PARTITION BY organisation_id, group_id, datetime)"""))
def _(spark, sf):
    return features.group_mean(R.grid(spark, sf, 360)).select(
        *ANIMAL, "datetime", "act", six("act_group_mean").alias("act_group_mean")
    )


@query("d3_distinct_keys", sql("SELECT DISTINCT organisation_id, group_id, animal_id FROM readings"))
def _(spark, sf):
    return R.readings(spark, sf).select("organisation_id", "group_id", "animal_id").distinct()


@query("d5_confusion", sql("""
    SELECT a.y, b.y_pred, count(p.doc_id) AS n, count(p.doc_id) / CAST(sum(count(p.doc_id)) OVER (PARTITION BY a.y) AS DOUBLE) AS share
    FROM (VALUES (0), (1)) a(y) CROSS JOIN (VALUES (0), (1)) b(y_pred)
    LEFT JOIN predictions p ON p.y = a.y AND p.y_pred = b.y_pred GROUP BY a.y, b.y_pred"""))
def _(spark, sf):
    return metrics.confusion(R.predictions(spark, sf))


_REPORT = """
    SELECT class, round(precision + 1e-9, 6) AS precision, round(recall + 1e-9, 6) AS recall, round(f1 + 1e-9, 6) AS f1, support FROM (
        SELECT class, precision, recall, f1, support FROM per_class
        UNION ALL SELECT 'accuracy', accuracy, accuracy, accuracy, n FROM
            (SELECT avg(CAST(y = y_pred AS INTEGER)) AS accuracy, count(*) AS n FROM predictions)
        UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM per_class
        UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                         sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM per_class)"""
_PER_CLASS = """
    SELECT class, precision, recall,
           coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, support
    FROM (SELECT k.class,
                 coalesce(count(*) FILTER (y = k.i AND y_pred = k.i) / nullif(CAST(count(*) FILTER (y_pred = k.i) AS DOUBLE), 0), 0) AS precision,
                 coalesce(count(*) FILTER (y = k.i AND y_pred = k.i) / nullif(CAST(count(*) FILTER (y = k.i) AS DOUBLE), 0), 0) AS recall,
                 count(*) FILTER (y = k.i) AS support
          FROM predictions CROSS JOIN (VALUES (0, 'no heat'), (1, 'heat')) k(i, class) GROUP BY k.i, k.class)"""


@query("d6_report", sql(_REPORT, per_class=_PER_CLASS))
def _(spark, sf):
    lines = metrics.report(R.predictions(spark, sf))
    return lines.select("class", *[six(m).alias(m) for m in ("precision", "recall", "f1")], "support")


@query("d7_accuracy", sql("""
    SELECT CAST(round_even(100 * avg(CAST(y = y_pred AS INTEGER)), 0) AS INTEGER) AS accuracy,
           CAST(round_even(100 * avg(CAST(y = y_pred AS INTEGER)) FILTER (y > 0.5), 0) AS INTEGER) AS accuracy_positive,
           CAST(round_even(100 * avg(CAST(y = y_pred AS INTEGER)) FILTER (y <= 0.5), 0) AS INTEGER) AS accuracy_negative
    FROM predictions"""))
def _(spark, sf):
    return metrics.accuracy(R.predictions(spark, sf))


@query("d8_weighted_loss", sql("""
    SELECT round(avg(-(250 * y * ln(1 / (1 + exp(-logit))) + (1 - y) * ln(1 - 1 / (1 + exp(-logit))))) + 1e-9, 6) AS loss FROM predictions"""))
def _(spark, sf):
    return metrics.cross_entropy(R.predictions(spark, sf)).select(six("loss").alias("loss"))


@query("d8_plain_loss", sql("""
    SELECT round(avg(-(y * ln(1 / (1 + exp(-logit))) + (1 - y) * ln(1 - 1 / (1 + exp(-logit))))) + 1e-9, 6) AS loss FROM predictions"""))
def _(spark, sf):
    scored = R.predictions(spark, sf).withColumn("probability", numbers.logistic(F.col("logit")))
    return metrics.plain_cross_entropy(scored).select(six("loss").alias("loss"))


@query("d9_histogram", sql("""
    SELECT b.bin, count(h.bin) AS n
    FROM (SELECT CAST(unnest(range(1, 51)) AS INTEGER) AS bin) b LEFT JOIN (
        SELECT least(CAST(floor((o_totalprice - low) / ((high - low) / 50)) AS INTEGER), 49) + 1 AS bin
        FROM orders CROSS JOIN (SELECT min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders)) h USING (bin)
    GROUP BY b.bin"""))
def _(spark, sf):
    return metrics.histogram(R.table(spark, sf, "orders"), "o_totalprice")


@query("d9_event_histogram", sql("""
    SELECT b.bin, count(h.bin) AS n
    FROM (SELECT CAST(unnest(range(1, 51)) AS INTEGER) AS bin) b LEFT JOIN (
        SELECT least(CAST(floor((moment - low) / ((high - low) / 50)) AS INTEGER), 49) + 1 AS bin
        FROM (SELECT CAST(epoch_us(event_ts) AS DOUBLE) AS moment FROM document_events WHERE event_ts IS NOT NULL)
        CROSS JOIN (SELECT min(CAST(epoch_us(event_ts) AS DOUBLE)) AS low, max(CAST(epoch_us(event_ts) AS DOUBLE)) AS high FROM document_events)) h USING (bin)
    GROUP BY b.bin"""))
def _(spark, sf):
    events = _flat_events(spark, sf).select(T.to_micros(F.col("event_ts")).alias("at"))
    return metrics.histogram(events, "at")


@query("f1_sorted_readings", sql("SELECT organisation_id, group_id, animal_id, datetime, act FROM readings ORDER BY ALL"))
def _(spark, sf):
    return SR.load_features(R.readings(spark, sf).select("organisation_id", "group_id", "animal_id", "datetime", "act"))


@query("f2_sorted_events", sql("SELECT animal_id, event_ts, event_type FROM lifecycle_events ORDER BY event_ts"))
def _(spark, sf):
    return R.lifecycle_events(spark, sf).select("animal_id", "event_ts", "event_type").orderBy("event_ts")


@query("f3_organisations_by_size", sql("""
    SELECT o.organisation_id, count(a.animal_id) AS animals FROM organisations o LEFT JOIN animals a USING (organisation_id)
    GROUP BY ALL ORDER BY animals DESC, organisation_id"""))
def _(spark, sf):
    sizes = metrics.animals_per_organisation(R.organisations(spark, sf), R.animals(spark, sf))
    return sizes.select("organisation_id", "animals").orderBy(F.desc("animals"), "organisation_id")


@query("g1_union_frames", sql("SELECT animal_id, datetime, act, NULL::DOUBLE AS temp FROM readings WHERE act > 50 UNION ALL SELECT animal_id, datetime, act, temp FROM readings WHERE act <= 50"))
def _(spark, sf):
    readings = R.readings(spark, sf)
    high = readings.where("act > 50").select("animal_id", "datetime", "act")
    rest = readings.where("act <= 50").select("animal_id", "datetime", "act", "temp")
    return high.unionByName(rest, allowMissingColumns=True)


@query("g2_stored_keys", sql("SELECT organisation_id, animal_id FROM herd UNION SELECT organisation_id, animal_id FROM animals"))
def _(spark, sf):
    return tables.stored_keys(R.herd(spark, sf), R.animals(spark, sf))


@query("g4_except_ids", sql("SELECT animal_id FROM animals EXCEPT SELECT animal_id FROM herd"))
def _(spark, sf):
    return R.animals(spark, sf).select("animal_id").subtract(R.herd(spark, sf).select("animal_id"))


@query("h3_row_split", sql("""
    SELECT organisation_id, animal_id, datetime, act,
           CASE WHEN CAST('0x' || substr(md5('42|' || organisation_id || '|' || animal_id || '|' || epoch_us(datetime)), 1, 15) AS BIGINT) % 1000000 < 330000
                THEN 'test' ELSE 'train' END AS split
    FROM readings"""))
def _(spark, sf):
    return split.split_rows(R.readings(spark, sf).select(*ANIMAL, "datetime", "act"))


@query("h5_unpad", sql("SELECT organisation_id, animal_id, CAST(row_number() OVER (PARTITION BY organisation_id, animal_id ORDER BY datetime) - 1 AS BIGINT) AS seq_no, CAST(raw AS FLOAT) AS raw, CAST(act AS FLOAT) AS act FROM flagged"))
def _(spark, sf):
    padded = sequences.pad_sequences(R.flagged(spark, sf), ["raw", "act"], chunk_rows=32)
    return sequences.unpad(padded, ["raw", "act"], chunk_rows=32)


@query("h12_events_for_analysis", sql("""
    SELECT organisation_id, animal_id, event_type, event_ts FROM document_events
    WHERE event_type IN ('heat', 'insemination')
      AND substr(animal_id, 2) IN (SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 2)"""))
def _(spark, sf):
    json = R.animal_documents(spark, sf)
    items = R.table(spark, sf, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("animal_id"))
    keys = json.select(
        F.get_json_object("json", "$.organisation_id").alias("organisation_id"),
        F.get_json_object("json", "$._id").alias("animal_id"),
    )
    parts = items.join(keys, "animal_id")
    return documents.events_for_analysis(_flat_events(spark, sf), parts).select(*ANIMAL, "event_type", "event_ts")

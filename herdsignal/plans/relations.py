"""The given tables seen as herd data, in Spark and in SQL.

Events become readings, life-cycle events and detections of animals (their users); orders become
life-cycle events of customers and, row by row, nested animal documents.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from herdsignal.operators.clean import dedup_first, on_grid

Loader = tuple[SparkSession, str]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def _animal() -> list[Column]:
    user = F.col("user_id")
    return [(user % 2).cast("string").alias("organisation_id"), user.cast("string").alias("animal_id")]


def readings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        *_animal(),
        (F.col("user_id") % 4).cast("string").alias("group_id"),
        F.col("ts").alias("datetime"),
        F.col("value").alias("act"),
        (F.lit(25.0) + F.lit(0.2) * _k()).alias("temp"),
        "event_id",
    )


def grid(spark: SparkSession, folder: str, minutes: int = 10) -> DataFrame:
    return on_grid(readings(spark, folder), minutes, ["event_id"]).drop("read_at", "event_id")


def flagged(spark: SparkSession, folder: str) -> DataFrame:
    """Gridded readings with a raw 0/1 label."""
    return grid(spark, folder).withColumn("raw", (F.col("act") > 50).cast("int"))


def long_series(spark: SparkSession, folder: str) -> DataFrame:
    """All readings of an organisation as one animal's, off the grid: two long series."""
    rows = readings(spark, folder).withColumn("animal_id", F.col("organisation_id")).drop("group_id")
    return dedup_first(rows, ["event_id"]).drop("event_id")


def long_flagged(spark: SparkSession, folder: str) -> DataFrame:
    """Long series with a raw 0/1 label that is rarely set."""
    return long_series(spark, folder).withColumn("raw", (F.col("act") > 180).cast("int"))


def lifecycle_events(spark: SparkSession, folder: str) -> DataFrame:
    """Fixed renaming of event types; the days before an insemination come from the payload."""
    kind = F.col("event_type")
    events = table(spark, folder, "events").where(kind != "error")
    renamed = (
        F.when(kind == "purchase", "heat")
        .when(kind == "signup", "insemination")
        .when(kind == "click", "pregnancy_result")
        .otherwise("calving_confirmation")
    )
    inseminated_at = F.col("ts") - F.make_dt_interval(hours=_k())
    return events.select(
        *_animal(),
        (_k() % 2).alias("cycle_no"),
        F.col("ts").alias("event_ts"),
        renamed.alias("event_type"),
        F.when(kind == "click", inseminated_at).alias("insemination_date"),
        (_k() % 2 == 0).alias("pregnant"),
    )


def cycles(spark: SparkSession, folder: str) -> DataFrame:
    """Two cycles per animal: the first begins with a calving near its events, the second one's comes long after them."""
    events = lifecycle_events(spark, folder)
    days = F.when(F.col("cycle_no") == 0, 2).otherwise(280)
    began = events.groupBy("organisation_id", "animal_id", "cycle_no").agg(F.min("event_ts").alias("began"))
    return began.select(
        "organisation_id", "animal_id", "cycle_no", (F.col("began") + F.make_dt_interval(days=days)).alias("last_calving_date")
    )


def detections(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").where(F.col("event_type") == "error")
    return events.select(
        *_animal(),
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("event_ts"),
        F.lit("actincrease_704").alias("event_type"),
    )


def daily_heats(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").where(F.col("event_type") == "purchase")
    return events.select(
        *_animal(),
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("event_ts"),
        F.lit("heat").alias("event_type"),
    )


def order_events(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as life-cycle events over several years."""
    status = F.col("o_orderstatus")
    kind = F.when(status == "F", "calving_confirmation").when(status == "O", "insemination").otherwise("heat")
    return table(spark, folder, "orders").select(
        (F.col("o_custkey") % 2).cast("string").alias("organisation_id"),
        F.col("o_custkey").cast("string").alias("animal_id"),
        (F.col("o_orderkey") % 2).cast("int").alias("cycle_no"),
        F.col("o_orderdate").alias("event_ts"),
        kind.alias("event_type"),
    )


def organisations(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select(
        F.col("n_nationkey").cast("string").alias("organisation_id"), F.col("n_name").alias("name"), "n_regionkey"
    )


def animals(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_nationkey").cast("string").alias("organisation_id"),
        F.col("c_custkey").cast("string").alias("animal_id"),
        "c_mktsegment",
        "c_acctbal",
    )


def herd(spark: SparkSession, folder: str) -> DataFrame:
    """The animals of the readings with their groups."""
    return (
        table(spark, folder, "events")
        .select("user_id")
        .distinct()
        .select(*_animal(), (F.col("user_id") % 4).cast("string").alias("group_id"))
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Labels as truth and prediction, with a logit that depends on the document."""
    return table(spark, folder, "labels").select(
        "doc_id",
        F.col("quality").alias("y"),
        F.col("toxic").alias("y_pred"),
        ((F.col("doc_id") % 17 - 8) / 4.0).alias("logit"),
    )


def animal_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One animal document per order, as JSON text; some without life cycle, events or proper times."""
    status, priority, at = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_orderdate")

    def iso(days: int, suffix: str = "") -> Column:
        moment = at + F.make_dt_interval(days=F.lit(days))
        return F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(suffix))

    def event(kind: str, time: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("event_type"),
            time.alias("event_ts"),
            F.map_from_arrays(F.array(F.lit("by")), F.array(priority)).alias("information"),
            F.col("o_orderkey").cast("string").alias("number"),
        )

    low = priority == "5-LOW"
    first = F.struct(
        F.lit("pregnant").alias("state"),
        F.when(status == "F", iso(700)).alias("last_calving_date"),
        F.array(
            event("heat", iso(0, "+02:00")),
            event("insemination", F.when(low, F.lit("soon")).otherwise(iso(21))),
            event("calving_confirmation", iso(280)),
        ).alias("events"),
    )
    second = F.struct(
        F.lit("lactating").alias("state"),
        F.lit(None).cast("string").alias("last_calving_date"),
        F.when(status == "O", F.array(event("heat", iso(400)))).alias("events"),
    )
    lifecycle = F.when(status != "P", F.struct(F.lit("open").alias("state"), F.array(first, second).alias("cycles")))
    document = F.struct(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("_id"),
        (F.col("o_custkey") % 5).cast("string").alias("organisation_id"),
        F.when(~low, priority).alias("group_id"),
        F.col("o_custkey").cast("string").alias("sensor"),
        F.when(status == "F", F.lit("true")).otherwise(F.lit("false")).alias("archived"),
        iso(0, "+02:00").alias("created_at"),
        F.array(status, priority).alias("tags"),
        lifecycle.alias("lifecycle"),
        F.col("o_totalprice").alias("unknown_field"),
    )
    # The table is one file here, and documents take work: spread the rows first.
    orders = table(spark, folder, "orders").repartition("o_orderkey")
    return orders.select("o_orderkey", F.to_json(document).alias("json"))


# The same relations for the SQL side, in the order of their dependencies.
RELATIONS = {
    "readings": r"""
        SELECT CAST(user_id % 2 AS VARCHAR) AS organisation_id, CAST(user_id AS VARCHAR) AS animal_id,
               CAST(user_id % 4 AS VARCHAR) AS group_id, ts AS datetime, value AS act,
               CAST(25 AS DOUBLE) + CAST(0.2 AS DOUBLE) * CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER) AS temp,
               event_id
        FROM events""",
    "grid": """
        SELECT organisation_id, animal_id, tick AS datetime, group_id, act, temp
        FROM (SELECT *, make_timestamp(CAST(round_even(epoch_us(datetime) / 600000000.0, 0) AS BIGINT) * 600000000) AS tick
              FROM readings)
        QUALIFY row_number() OVER (PARTITION BY organisation_id, animal_id, tick ORDER BY datetime, event_id) = 1""",
    "grid6h": """
        SELECT organisation_id, animal_id, tick AS datetime, group_id, act, temp
        FROM (SELECT *, make_timestamp(CAST(round_even(epoch_us(datetime) / 21600000000.0, 0) AS BIGINT) * 21600000000) AS tick
              FROM readings)
        QUALIFY row_number() OVER (PARTITION BY organisation_id, animal_id, tick ORDER BY datetime, event_id) = 1""",
    "flagged": "SELECT *, CAST(act > 50 AS INTEGER) AS raw FROM grid",
    "long_series": """
        SELECT organisation_id, organisation_id AS animal_id, datetime, act, temp FROM readings
        QUALIFY row_number() OVER (PARTITION BY organisation_id, datetime ORDER BY event_id) = 1""",
    "long_flagged": "SELECT *, CAST(act > 180 AS INTEGER) AS raw FROM long_series",
    "lifecycle_events": r"""
        SELECT CAST(user_id % 2 AS VARCHAR) AS organisation_id, CAST(user_id AS VARCHAR) AS animal_id,
               CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER) % 2 AS cycle_no, ts AS event_ts,
               CASE event_type WHEN 'purchase' THEN 'heat' WHEN 'signup' THEN 'insemination'
                    WHEN 'click' THEN 'pregnancy_result' ELSE 'calving_confirmation' END AS event_type,
               CASE WHEN event_type = 'click'
                    THEN ts - to_hours(CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER)) END AS insemination_date
        FROM events WHERE event_type <> 'error'""",
    "cycles": """
        SELECT organisation_id, animal_id, cycle_no, min(event_ts) + to_days(CASE WHEN cycle_no = 0 THEN 2 ELSE 280 END) AS last_calving_date
        FROM lifecycle_events GROUP BY organisation_id, animal_id, cycle_no""",
    "births": """
        SELECT organisation_id, animal_id, cycle_no, event_ts FROM lifecycle_events WHERE event_type = 'calving_confirmation'
        UNION ALL SELECT organisation_id, animal_id, cycle_no, last_calving_date FROM cycles""",
    "detections": """
        SELECT CAST(user_id % 2 AS VARCHAR) AS organisation_id, CAST(user_id AS VARCHAR) AS animal_id,
               CAST(date_trunc('day', ts) AS TIMESTAMP) AS event_ts
        FROM events WHERE event_type = 'error'""",
    "daily_heats": """
        SELECT CAST(user_id % 2 AS VARCHAR) AS organisation_id, CAST(user_id AS VARCHAR) AS animal_id,
               CAST(date_trunc('day', ts) AS TIMESTAMP) AS event_ts
        FROM events WHERE event_type = 'purchase'""",
    "order_events": """
        SELECT CAST(o_custkey % 2 AS VARCHAR) AS organisation_id, CAST(o_custkey AS VARCHAR) AS animal_id,
               CAST(o_orderkey % 2 AS INTEGER) AS cycle_no, o_orderdate AS event_ts,
               CASE o_orderstatus WHEN 'F' THEN 'calving_confirmation' WHEN 'O' THEN 'insemination'
                    ELSE 'heat' END AS event_type
        FROM orders""",
    "organisations": "SELECT CAST(n_nationkey AS VARCHAR) AS organisation_id, n_name AS name, n_regionkey FROM nation",
    "animals": """
        SELECT CAST(c_nationkey AS VARCHAR) AS organisation_id, CAST(c_custkey AS VARCHAR) AS animal_id,
               c_mktsegment, c_acctbal FROM customer""",
    "herd": """
        SELECT DISTINCT CAST(user_id % 2 AS VARCHAR) AS organisation_id, CAST(user_id AS VARCHAR) AS animal_id,
               CAST(user_id % 4 AS VARCHAR) AS group_id FROM events""",
    "predictions": """
        SELECT doc_id, quality AS y, toxic AS y_pred, (doc_id % 17 - 8) / CAST(4 AS DOUBLE) AS logit FROM labels""",
    "document_events": """
        SELECT CAST(o_custkey % 5 AS VARCHAR) AS organisation_id, 'o' || o_orderkey AS animal_id, cycle_no, event_type,
               event_ts
        FROM (
            SELECT o_custkey, o_orderkey, 0 AS cycle_no, 'heat' AS event_type, o_orderdate AS event_ts
            FROM orders WHERE o_orderstatus <> 'P'
            UNION ALL
            SELECT o_custkey, o_orderkey, 0, 'insemination',
                   CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate + to_days(21) END
            FROM orders WHERE o_orderstatus <> 'P'
            UNION ALL
            SELECT o_custkey, o_orderkey, 0, 'calving_confirmation', o_orderdate + to_days(280)
            FROM orders WHERE o_orderstatus <> 'P'
            UNION ALL
            SELECT o_custkey, o_orderkey, 1, 'heat', o_orderdate + to_days(400) FROM orders WHERE o_orderstatus = 'O'
        )""",
}


def sql(body: str, **extra: str) -> str:
    """``body`` with the relations it needs put in front; ``extra`` relations come after the given ones."""
    known = {**RELATIONS, **extra}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                visit(known[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    return "WITH " + ",\n".join(f"{name} AS ({known[name]})" for name in needed) + "\n" + body

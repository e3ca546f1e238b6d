"""Organisation and animal documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from herdsignal.functions.time import decode_datetime
from herdsignal.schemas import decode

# Identifying fields of an organisation, at load time and in the batch pass.
IDENTIFYING = ("name", "account")
IDENTIFYING_ALL = ("name", "account", "partner_id")


def read_documents(spark: SparkSession, path: str, schema: str, with_errors: bool = True) -> DataFrame:
    """One JSON document per line, decoded; bad fields are null and listed in ``errors``."""
    decoded = decode(spark.read.text(path), "value", schema)
    columns = [*decoded.select("document.*").columns, *(["errors"] if with_errors else [])]
    return decoded.select("document.*", "errors").select(*columns)


def quarantine(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents without errors and documents with some."""
    clean = F.size("errors") == 0
    return documents.where(clean), documents.where(~clean)


def anonymise(organisations: DataFrame, fields=IDENTIFYING_ALL) -> DataFrame:
    return organisations.drop(*fields)


def anonymise_nested(df: DataFrame, document: str, fields=IDENTIFYING_ALL) -> DataFrame:
    return df.withColumn(document, F.col(document).dropFields(*fields))


def cycles_of(animals: DataFrame) -> DataFrame:
    """One row per life-cycle cycle; an animal without any yields nothing.

    Arrays are taken apart with their absence, which is dropped after: for a plain explode Spark asks first whether the
    array is empty, and would decode each document twice, the first time before the rows are spread over the tasks.
    """
    cycles = animals.select(
        "organisation_id",
        F.col("_id").alias("animal_id"),
        F.posexplode_outer("lifecycle.cycles_with_padding").alias("cycle_no", "cycle"),
    )
    return cycles.where(F.col("cycle_no").isNotNull()).select("organisation_id", "animal_id", "cycle_no", F.col("cycle.last_calving_date").alias("last_calving_date"), F.col("cycle.events").alias("events"))


def flatten_events(animals: DataFrame) -> DataFrame:
    """One row per life-cycle event."""
    keys = ["organisation_id", "animal_id", "cycle_no"]
    exploded = cycles_of(animals).select(*keys, F.posexplode_outer("events").alias("_place", "event"))
    return exploded.where(F.col("_place").isNotNull()).select(
        *keys, "event.event_ts", "event.event_type", "event.insemination_date", "event.pregnant"
    )


def flatten_event_documents(df: DataFrame, json: str = "json") -> DataFrame:
    """Life-cycle events straight from animal documents in JSON text.

    Only the fields of the result are parsed, and they are typed after the arrays are taken apart, so
    that no array of whole events is rebuilt. Same rows as ``flatten_events`` on decoded documents.
    """
    event = "event_ts STRING, event_type STRING, insemination_date STRING, pregnant STRING"
    wanted = f"_id STRING, organisation_id STRING, lifecycle STRUCT<cycles: ARRAY<STRUCT<events: ARRAY<STRUCT<{event}>>>>>"
    parsed = df.select(F.from_json(json, wanted).alias("d"))
    cycles = parsed.select(
        F.col("d.organisation_id").alias("organisation_id"),
        F.col("d._id").alias("animal_id"),
        F.posexplode("d.lifecycle.cycles").alias("cycle_no", "cycle"),
    )
    events = cycles.select("organisation_id", "animal_id", "cycle_no", F.explode("cycle.events").alias("event"))
    return events.select(
        "organisation_id",
        "animal_id",
        "cycle_no",
        decode_datetime(F.col("event.event_ts")).alias("event_ts"),
        F.col("event.event_type").alias("event_type"),
        decode_datetime(F.col("event.insemination_date")).alias("insemination_date"),
        F.col("event.pregnant").try_cast("boolean").alias("pregnant"),
    )


def events_for_analysis(events: DataFrame, stored_parts: DataFrame, types=("insemination", "heat")) -> DataFrame:
    """Flattened events of the animals with at least two stored parts, of the given types, by time.

    ``stored_parts`` has a row per animal and stored part (document, events, readings).
    """
    eligible = (
        stored_parts.groupBy("organisation_id", "animal_id")
        .agg(F.count(F.lit(1)).alias("_parts"))
        .where(F.col("_parts") >= 2)
    )
    chosen = events.where(F.col("event_type").isin(*types))
    return chosen.join(eligible, ["organisation_id", "animal_id"], "left_semi").orderBy("event_ts")

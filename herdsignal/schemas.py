"""Document schemas, their decoding from JSON and their encoding back.

A schema is a list of ``(document name, kind, column name)``. Kinds: ``text``, ``integer``, ``flag``,
``dict``, ``texts``, ``dicts``, ``time`` (ISO, offset dropped), ``epoch`` (checked seconds), or another
schema by name, in a list for a repeated one. Scalars are read as text, so that a bad value costs one
field and adds one error instead of spoiling the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from herdsignal.functions import time as T

# The documents' field names and types.
_STATE = [
    ("state", "text"),
    ("last_insemination_date", "time"),
    ("last_heat_date", "time"),
    ("last_calving_date", "time"),
    ("expected_calving_date", "time"),
    ("lactation_number", "integer"),
    ("milk_yield", "integer"),
    ("cycle_length", "integer"),
    ("insemination_window_start", "time"),
    ("insemination_window_optimal_end", "time"),
    ("insemination_window_end", "time"),
    ("last_calving_detection", "time"),
    ("dry_off_date", "time"),
]
_STATE_INTERNAL = [
    ("state", "text"),
    ("last_insemination_date", "epoch"),
    ("last_heat_date", "epoch"),
    ("last_calving_date", "epoch"),
    ("expected_calving_date", "epoch"),
    ("cycle_length", "integer"),
    ("insemination_window_start", "epoch"),
    ("insemination_window_end", "epoch"),
    ("last_calving_detection", "epoch"),
]
_ANIMAL_V2 = [
    ("_id", "text"),
    ("name", "text"),
    ("mark", "text"),
    ("official_id", "text"),
    ("display_name", "text"),
    ("organisation_id", "text"),
    ("group_id", "text"),
    ("location", "text"),
    ("sensor", "text", "current_device_id"),
    ("current_device_id", "text"),
    ("archived", "flag"),
    ("created_at", "time"),
    ("birthday", "time"),
    ("race", "text"),
    ("mixed_race", "dicts"),
    ("official_id_rule", "text"),
    ("tags", "texts"),
    ("lactation_status", "text"),
]
SCHEMAS = {
    "cycle_event": [
        ("_id", "text"),
        ("animal_id", "text"),
        ("event_ts", "time"),
        ("create_ts", "time"),
        ("event_type", "text"),
        ("information", "dict"),
        ("active", "flag"),
        ("cycle_length", "integer"),
        ("reason", "text"),
        ("days_to_calving", "integer"),
        ("expected_calving_date", "time"),
        ("insemination_date", "time"),
        ("pregnant", "flag"),
        ("number", "integer"),
        ("late_abort", "flag"),
        ("icar_key", "text"),
        ("diagnosis_key", "text"),
        ("diagnosis_key_type", "text"),
    ],
    "state_info": _STATE,
    "cycle": [*_STATE, ("events", ["cycle_event"])],
    "lifecycle": [*_STATE, ("cycles", ["cycle"], "cycles_with_padding")],
    "animal_id": [("_id", "text")],
    "animal_list": [("name", "text"), ("_ids", "texts")],
    "animal_list_names": [("list_names", "texts")],
    "animal_simple": [
        ("_id", "text"),
        ("organisation_id", "text"),
        ("group_id", "text"),
        ("name", "text"),
        ("display_name", "text"),
        ("metadata", "dict", "animal_metadata"),
        ("tags", "texts"),
        ("mark", "text"),
        ("official_id", "text"),
        ("sensor", "text", "current_device_id"),
        ("archived", "flag"),
        ("created_at", "epoch"),
        ("lactation_status", "text"),
    ],
    "animal_simple_v2": _ANIMAL_V2,
    "animal_integration": [f for f in _ANIMAL_V2 if f[0] != "sensor"] + [("last_readout", "time")],
    "modules": [("animal_id", "text"), ("valid_from", "time"), ("active_modules", "dict")],
    "animal": [*_ANIMAL_V2, ("lifecycle", "lifecycle"), ("modules", "modules")],
    # The document-store variant leaves out heats and lactations, which this version no longer has.
    "animal_store": [*_ANIMAL_V2, ("lifecycle", "lifecycle"), ("modules", "modules")],
    "cycle_event_internal": [
        ("_id", "text"),
        ("animal_id", "text"),
        ("event_ts", "epoch"),
        ("create_ts", "epoch"),
        ("event_type", "text"),
        ("information", "dict"),
        ("active", "flag"),
    ],
    "state_info_internal": _STATE_INTERNAL,
    "cycle_internal": [*_STATE_INTERNAL, ("events", ["cycle_event_internal"])],
    "lifecycle_internal": [*_STATE_INTERNAL, ("cycles", ["cycle_internal"])],
    "animal_internal": [
        *[("created_at", "epoch") if f[0] == "created_at" else f for f in _ANIMAL_V2],
        ("heats", "text", "deprecated"),
        ("lactations", "text", "deprecated"),
        ("lifecycle", "lifecycle_internal"),
        ("modules", "modules"),
        ("metadata", "dict", "animal_metadata"),
    ],
    "animal_device": [("animal_id", "text"), ("device_id", "text"), ("ts", "epoch")],
}
CORRUPT = "_corrupt"
BAD_DOCUMENT = "document: unreadable"

_TYPES = {"dict": "MAP<STRING,STRING>", "texts": "ARRAY<STRING>", "dicts": "ARRAY<MAP<STRING,STRING>>"}


def _fields(schema: str) -> list[tuple]:
    return [(f[0], f[1], f[2] if len(f) > 2 else f[0]) for f in SCHEMAS[schema]]


def _raw_type(kind) -> str:
    if isinstance(kind, list):
        return f"ARRAY<{_raw_type(kind[0])}>"
    if kind in SCHEMAS:
        return f"STRUCT<{', '.join(f'`{name}`: {_raw_type(k)}' for name, k, _ in _fields(kind))}>"
    return _TYPES.get(kind, "STRING")


def raw_schema(schema: str) -> str:
    """DDL of the document as it stands in the JSON text."""
    return ", ".join(f"`{name}` {_raw_type(kind)}" for name, kind, _ in _fields(schema))


def _typed(value: Column, kind) -> Column:
    if isinstance(kind, list):
        return F.transform(value, lambda item: _typed(item, kind[0]))
    if kind in SCHEMAS:
        return F.when(value.isNotNull(), F.struct(*_typed_fields(value, kind)))
    if kind == "time":
        return T.decode_datetime(value)
    if kind == "epoch":
        return T.decode_epoch(value)
    if kind == "integer":
        return value.try_cast("int")
    if kind == "flag":
        return value.try_cast("boolean")
    return value


def _typed_fields(value: Column, schema: str) -> list[Column]:
    """Fields under their column names; where two share a name, the first one that is set counts."""
    sources: dict[str, list[Column]] = {}
    for name, kind, column in _fields(schema):
        sources.setdefault(column, []).append(_typed(value[name], kind))
    return [(F.coalesce(*found) if len(found) > 1 else found[0]).alias(name) for name, found in sources.items()]


def _errors(value: Column, kind, path: str) -> Column | None:
    """Array of messages ``path: code`` for the fields that do not fit."""
    none = F.array().cast("array<string>")
    if isinstance(kind, list):
        inner = lambda item: _errors(item, kind[0], path)
        return F.coalesce(F.flatten(F.transform(value, inner)), none)
    if kind in SCHEMAS:
        found = [_errors(value[name], k, f"{path}.{name}" if path else name) for name, k, _ in _fields(kind)]
        found = [errors for errors in found if errors is not None]
        return F.coalesce(F.concat(*found), none) if found else none
    if kind == "epoch":
        code = T.epoch_error(value)
    elif kind in ("time", "integer", "flag"):
        code = F.when(value.isNotNull() & _typed(value, kind).isNull(), F.lit("invalid"))
    else:
        return None
    return F.when(code.isNotNull(), F.array(F.concat(F.lit(f"{path}: "), code))).otherwise(none)


def decode(df: DataFrame, json: str, schema: str, document: str = "document", errors: str = "errors") -> DataFrame:
    """Replace the JSON text column by a typed struct and an array of errors; unknown fields are dropped."""
    raw = F.from_json(
        F.col(json), f"{raw_schema(schema)}, `{CORRUPT}` STRING", {"columnNameOfCorruptRecord": CORRUPT}
    )
    with_raw = df.withColumn("_raw", raw)
    unreadable = F.col("_raw")[CORRUPT].isNotNull()
    found = F.concat(
        F.when(unreadable, F.array(F.lit(BAD_DOCUMENT))).otherwise(F.array().cast("array<string>")),
        _errors(F.col("_raw"), schema, ""),
    )
    typed = F.struct(*_typed_fields(F.col("_raw"), schema))
    return with_raw.withColumns({document: typed, errors: found}).drop("_raw", *([json] if json != document else []))


def _plain(value: Column, kind) -> Column:
    if isinstance(kind, list):
        return F.transform(value, lambda item: _plain(item, kind[0]))
    if kind in SCHEMAS:
        fields = [_plain(value[column], k).alias(name) for name, k, column in _fields(kind)]
        return F.when(value.isNotNull(), F.struct(*fields))
    if kind == "time":
        return T.encode_datetime(value)
    if kind == "epoch":
        return F.when(T.epoch_error(T.encode_epoch(value).cast("string")).isNull(), T.encode_epoch(value))
    return value


def _encode_errors(value: Column, kind, path: str) -> Column | None:
    none = F.array().cast("array<string>")
    if isinstance(kind, list):
        inner = lambda item: _encode_errors(item, kind[0], path)
        return F.coalesce(F.flatten(F.transform(value, inner)), none)
    if kind in SCHEMAS:
        parts = [
            _encode_errors(value[column], k, f"{path}.{name}" if path else name) for name, k, column in _fields(kind)
        ]
        parts = [part for part in parts if part is not None]
        return F.coalesce(F.concat(*parts), none) if parts else none
    if kind == "epoch":
        code = T.epoch_error(T.encode_epoch(value).cast("string"))
        return F.when(code.isNotNull(), F.array(F.concat(F.lit(f"{path}: "), code))).otherwise(none)
    return None


def encode(df: DataFrame, document: str, schema: str, json: str = "json", errors: str = "errors") -> DataFrame:
    """Typed struct to JSON text under the document's own names; null fields are left out."""
    return df.withColumns(
        {
            json: F.to_json(_plain(F.col(document), schema)),
            errors: F.coalesce(_encode_errors(F.col(document), schema, ""), F.array().cast("array<string>")),
        }
    )


def error_counts(df: DataFrame, errors: str = "errors") -> DataFrame:
    return df.select(F.explode(errors).alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def without(df: DataFrame, document: str, *fields: str) -> DataFrame:
    """Leave fields out of a document."""
    return df.withColumn(document, F.col(document).dropFields(*fields))

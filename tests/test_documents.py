import json

from conftest import at
from pyspark.sql import functions as F

from herdsignal import schemas
from herdsignal.sources import documents


def decoded(spark, schema, *docs):
    texts = [(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)]
    return schemas.decode(spark.createDataFrame(texts, "i int, json string"), "json", schema).orderBy("i")


ANIMAL = {
    "_id": "a1",
    "organisation_id": "o1",
    "sensor": "s9",
    "created_at": "2020-06-01T10:00:00+02:00",
    "archived": True,
    "tags": ["x", "y"],
    "mixed_race": [{"race": "r1"}],
    "something_else": 5,
    "modules": {"valid_from": "2020-01-01T00:00:00", "active_modules": {"heat": "on"}},
    "lifecycle": {
        "state": "open",
        "cycles": [
            {
                "last_calving_date": "2020-01-01T00:00:00",
                "milk_yield": "12",
                "events": [
                    {"event_type": "heat", "event_ts": "2020-02-01T00:00:00", "information": {"k": "v"}},
                    {"event_type": "insemination", "event_ts": "not a time", "number": "many"},
                ],
            },
            {"state": "dry", "events": None},
            {"state": "new"},
        ],
    },
}


def test_decode_nested(spark):
    row = decoded(spark, "animal", ANIMAL).collect()[0]
    d = row.document
    assert (d._id, d.current_device_id, d.created_at, d.archived) == ("a1", "s9", at("2020-06-01 10:00"), True)
    assert d.tags == ["x", "y"] and d.mixed_race == [{"race": "r1"}] and d.modules.active_modules == {"heat": "on"}
    cycle = d.lifecycle.cycles_with_padding[0]
    assert cycle.last_calving_date == at("2020-01-01") and cycle.milk_yield == 12
    assert cycle.events[0].information == {"k": "v"} and cycle.events[1].event_ts is None
    assert sorted(row.errors) == ["lifecycle.cycles.events.event_ts: invalid", "lifecycle.cycles.events.number: invalid"]
    assert "something_else" not in d and "sensor" not in d


def test_broken_and_empty_documents(spark):
    rows = decoded(spark, "animal", "{broken", {}, {"lifecycle": None}).collect()
    assert schemas.BAD_DOCUMENT in rows[0].errors and rows[1].errors == [] and rows[2].errors == []
    good, bad = documents.quarantine(decoded(spark, "animal", "{broken", {"_id": "x"}))
    assert good.count() == 1 and bad.count() == 1


def test_epoch_variant(spark):
    rows = decoded(spark, "animal_device", {"ts": 946684801}, {"ts": 946684800}, {"ts": "x"}, {}).collect()
    assert [r.document.ts for r in rows] == [at("2000-01-01 00:00:01"), None, None, None]
    assert [r.errors for r in rows] == [[], ["ts: invalid_date"], ["ts: invalid"], []]


def test_every_schema_round_trips(spark):
    for name in schemas.SCHEMAS:
        frame = decoded(spark, name, {})
        assert frame.collect()[0].errors == []
        assert schemas.encode(frame.drop("errors"), "document", name).collect()[0].json == "{}"


def test_encode_uses_document_names(spark):
    frame = decoded(spark, "animal", ANIMAL).drop("errors")
    text = json.loads(schemas.encode(frame, "document", "animal").collect()[0].json)
    assert text["sensor"] == "s9" and text["created_at"] == "2020-06-01T10:00:00"
    assert [c.get("state") for c in text["lifecycle"]["cycles"]] == [None, "dry", "new"]
    again = decoded(spark, "animal", text).collect()[0]
    assert again.document == frame.collect()[0].document and again.errors == []


def test_exclusion_and_renames(spark):
    assert "current_device_id" in decoded(spark, "animal_integration", {}).select("document.*").columns
    assert "sensor" not in schemas.raw_schema("animal_integration")
    internal = decoded(spark, "animal_internal", {"heats": "h", "metadata": {"a": "b"}}).collect()[0].document
    assert internal.deprecated == "h" and internal.animal_metadata == {"a": "b"}
    simple = decoded(spark, "animal_simple", {"sensor": "s", "created_at": 1577836800}).collect()[0].document
    assert simple.current_device_id == "s" and simple.created_at == at("2020-01-01")


def test_flatten(spark):
    frame = decoded(spark, "animal", ANIMAL, {"_id": "a2", "lifecycle": None}, {"_id": "a3", "lifecycle": {"cycles": None}})
    typed = documents.flatten_events(frame.select("document.*"))
    rows = typed.orderBy("event_type").collect()
    assert [(r.animal_id, r.cycle_no, r.event_type, r.event_ts) for r in rows] == [
        ("a1", 0, "heat", at("2020-02-01")),
        ("a1", 0, "insemination", None),
    ]
    texts = spark.createDataFrame([(json.dumps(ANIMAL),), ("{broken",), ("{}",)], "json string")
    direct = documents.flatten_event_documents(texts)
    assert direct.columns == typed.columns and direct.orderBy("event_type").collect() == rows


def test_flatten_decodes_once(spark):
    holed = {"_id": "a4", "lifecycle": {"cycles": [None, {"events": [None, {"event_type": "heat"}]}, {"events": []}]}}
    texts = spark.createDataFrame([(json.dumps(holed),), ("{}",)], "json string").repartition(3, "json")
    rows = documents.flatten_events(schemas.decode(texts, "json", "animal").select("document.*"))
    assert sorted((r.animal_id, r.cycle_no, r.event_type or "") for r in rows.collect()) == [("a4", 1, ""), ("a4", 1, "heat")]
    # Not a second time in a condition below the shuffle, where the table may be a single file.
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1


def test_anonymise(spark):
    organisations = spark.createDataFrame([("o", "n", "acc", "p", 3)], "_id string, name string, account string, partner_id string, size int")
    assert documents.anonymise(organisations).columns == ["_id", "size"]
    assert documents.anonymise(organisations, documents.IDENTIFYING).columns == ["_id", "partner_id", "size"]
    nested = organisations.select(F.struct("*").alias("organisation"))
    assert documents.anonymise_nested(nested, "organisation").select("organisation.*").columns == ["_id", "size"]


def test_error_counts(spark):
    counts = schemas.error_counts(decoded(spark, "animal_device", {"ts": 1}, {"ts": 2}, {"ts": "x"}))
    assert {r.error: r.n for r in counts.collect()} == {"ts: invalid_date": 2, "ts: invalid": 1}

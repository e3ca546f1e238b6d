"""Reversible line deduplication: sharded cuckoo filters in front of exact reference-count tables.

An index is a folder of append-only tables, so that documents can be inserted and deleted at any time:

* ``refs``: a row for each document and each different key of its lines; ``gone``: deleted documents.
* ``counts``: per key its number of documents and the largest id among them. A later version of a row replaces the
  earlier ones.
* ``done``: versions that are whole. Rows of a version that broke off are never read.
* ``filters``: per shard of keys a cuckoo filter of the keys that have a document. The newest version counts.

Inserting groups the new keys before the shuffle and lets the owner of a shard probe its filter. Keys that it does not
have are new for sure: they enter the filter, and their counts are written without a look at the old ones. Only the
others are joined with the exact counts. Deleting recounts the keys of the deleted documents from ``refs`` and takes
keys without documents out of the filter. A filter that overflows is built anew, larger, from the exact counts. So a
filter decides nothing by itself, and whatever a key's share of all lines is, a task sees it once per shard.

Keys are known by 128 bits of hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from herdsignal.llm import common as C
from herdsignal.session import cut, fresh_path, scratch

#: Least length of a key in code points, and documents that must have it.
LEAST_POINTS, LEAST_DOCS = 20, 3
#: Keys of a shard, when the index is made.
SHARD_KEYS = 1 << 19
#: Places of a filter's bucket, share of them that is filled at most when it is made, and rounds of moving.
PLACES, FILLED, ROUNDS = 4, 0.75, 200

KEY = ["a", "b"]
_REFS = "version int, a long, b long, id long"
_COUNTS = "version int, shard int, a long, b long, n long, last long"
_FILTERS = "version int, shard int, slots binary"
_GONE = "version int, id long"
_DONE = "version int"


class CuckooFilter:
    """A set of 64-bit hashes as 16-bit marks, each in one of two buckets of four places; all steps for many hashes at once."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots.reshape(-1, PLACES)

    @staticmethod
    def for_keys(many: int) -> CuckooFilter:
        """An empty filter for so many hashes."""
        buckets = 1 << max(0, int(many / (PLACES * FILLED))).bit_length()
        return CuckooFilter(np.zeros(buckets * PLACES, np.uint16))

    def _homes(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        marks = np.maximum(hashes >> np.uint64(48), np.uint64(1)).astype(np.uint16)
        return marks, (hashes & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def _other(self, marks: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ (C.mixed(marks.astype(np.uint64) + np.uint64(77)) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        marks, one = self._homes(hashes)
        two = self._other(marks, one)
        return (self.slots[one] == marks[:, None]).any(1) | (self.slots[two] == marks[:, None]).any(1)

    def _put(self, marks: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Fill free places of the buckets; which marks found none."""
        order = np.argsort(bucket, kind="stable")
        starts, sizes = C.runs(bucket[order])
        rank = np.arange(len(order)) - np.repeat(starts, sizes)
        mine = self.slots[bucket[order]]
        free = (mine == 0).sum(1)
        fits = rank < free
        place = np.argsort(mine != 0, axis=1, kind="stable")[np.arange(len(order)), np.minimum(rank, PLACES - 1)]
        self.slots[bucket[order[fits]], place[fits]] = marks[order[fits]]
        left = np.ones(len(marks), bool)
        left[order[fits]] = False
        return left

    def insert(self, hashes: np.ndarray) -> bool:
        """Add hashes, one mark for each; False if there was not room for all, and the filter must be made anew."""
        marks, bucket = self._homes(hashes)
        for number in range(ROUNDS):
            left = self._put(marks, bucket)
            if not left.any():
                return True
            marks, bucket = marks[left], bucket[left]
            if number:  # one mark per full bucket takes a place, and what was there moves on
                _, first = np.unique(bucket, return_index=True)
                place = (bucket[first] + number) % PLACES
                before = self.slots[bucket[first], place].copy()
                self.slots[bucket[first], place] = marks[first]
                marks[first] = before
            bucket = self._other(marks, bucket)
        return False

    def remove(self, hashes: np.ndarray) -> None:
        """Take out one mark of each hash; all must have been inserted."""
        marks, one = self._homes(hashes)
        for mark, first, second in zip(marks.tolist(), one.tolist(), self._other(marks, one).tolist(), strict=True):
            bucket = first if (self.slots[first] == mark).any() else second
            place = np.flatnonzero(self.slots[bucket] == mark)
            if len(place):
                self.slots[bucket, place[0]] = 0


class _Lines:
    """The lines of some texts: row, start and end of each, and the hashes and lengths in code points of their keys."""

    def __init__(self, column: pa.Array):
        self.data, offsets = C.raw(column)
        breaks = np.flatnonzero(self.data == 10)
        # Every row begins a line, and each line feed one more.
        rows_of_breaks = np.searchsorted(offsets, breaks, side="right") - 1
        self.many = np.bincount(rows_of_breaks, minlength=len(column)) + 1
        self.row = np.repeat(np.arange(len(column)), self.many)
        first = np.cumsum(self.many) - self.many
        self.start = np.empty(len(self.row), np.int64)
        self.end = np.empty(len(self.row), np.int64)
        inner = np.ones(len(self.row), bool)
        inner[first] = False
        self.start[first], self.start[inner] = offsets[:-1], breaks + 1
        last = first + self.many - 1
        outer = np.ones(len(self.row), bool)
        outer[last] = False
        self.end[last], self.end[outer] = offsets[1:], breaks
        # Keys begin at the first and end behind the last byte that is not white.
        solid = np.flatnonzero(~C._SPACE[self.data])
        at, to = np.searchsorted(solid, self.start), np.searchsorted(solid, self.end)
        has = at < to
        begin, stop = self.start.copy(), self.start.copy()
        begin[has], stop[has] = solid[at[has]], solid[to[has] - 1] + 1
        points = np.r_[0, np.cumsum((self.data & 0xC0) != 0x80)]
        self.points = points[stop] - points[begin]
        self.a, self.b = (h.view(np.int64) for h in C.word_hashes(C._LOWER[self.data], begin, stop))


def _posted(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Different keys of each row."""
    for batch in C.steps(batches, "text"):
        lines = _Lines(batch.column(1))
        long = np.flatnonzero(lines.points >= least)
        row, a, b = lines.row[long], lines.a[long], lines.b[long]
        order = np.lexsort((b, a, row))
        row, a, b = row[order], a[order], b[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new]), batch.column(0).take(pa.array(row[new]))], ["a", "b", "id"])


def _owner(key, rows: pa.Table, filters: pa.Table) -> pa.Table:
    """A shard's owner: which of the new keys its filter may have, and the filter with all of them.

    Rows of keys have their hashes, the row of the filter its slots, which are empty when it has to be made anew.
    """
    keys = np.asarray(rows.column("a")).view(np.uint64)
    slots = filters.column("slots")[0].as_py() if filters.num_rows else None
    known = CuckooFilter.for_keys(len(keys)) if slots is None else CuckooFilter(np.frombuffer(slots, np.uint16).copy())
    seen = known.contains(keys)
    # Of new keys with equal marks only the first may be called new by the filter; all are new to the exact counts.
    fits = known.insert(keys[~seen])
    out = pa.table([rows.column(c) for c in ("shard", "a", "b", "n", "last")] + [pa.array(seen)], [*_OWNED[:5], "seen"])
    tail = pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([known.slots.tobytes() if fits else b""], pa.binary())], ["shard", "slots"])
    return pa.concat_tables([out, tail], promote_options="default").select(_OWNED)


_OWNED = ["shard", "a", "b", "n", "last", "seen", "slots"]
_OWNED_SCHEMA = "shard int, a long, b long, n long, last long, seen boolean, slots binary"


def _without(key, rows: pa.Table, filters: pa.Table) -> pa.Table:
    """A shard's filter without the keys of ``rows``."""
    known = CuckooFilter(np.frombuffer(filters.column("slots")[0].as_py(), np.uint16).copy())
    known.remove(np.asarray(rows.column("a")).view(np.uint64))
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([known.slots.tobytes()], pa.binary())], ["shard", "slots"])


def _anew(key, rows):
    """A filter of a shard's keys, made as large as it needs to be."""
    keys, room = np.asarray(rows.column("a")).view(np.uint64), rows.num_rows
    known = CuckooFilter.for_keys(room)
    while not known.insert(keys):
        room *= 2
        known = CuckooFilter.for_keys(room)
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([known.slots.tobytes()], pa.binary())], ["shard", "slots"])


class LineIndex:
    """An index of the lines of documents in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str | None = None, least_points: int = LEAST_POINTS, shard_keys: int = SHARD_KEYS):
        """``folder``: where the tables lie; a new index begins in an unused one."""
        self.spark, self.folder = spark, folder or fresh_path(spark, "lines")
        self.least_points, self.shard_keys = least_points, shard_keys

    def _table(self, name: str, schema: str, version: int | None = None) -> DataFrame:
        """The rows of finished versions, and of ``version``, which is under way."""
        every = self._stored(name, schema)
        whole = [row["version"] for row in self._stored("done", _DONE).collect()]  # one small number per change
        return every.where(F.col("version").isin([*whole, *([version] if version else [])]))

    def _stored(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def _append(self, name: str, df: DataFrame, schema: str) -> None:
        names = T.StructType.fromDDL(schema).fieldNames()
        df.select(*names).write.mode("append").option("compression", "zstd").parquet(f"{self.folder}/{name}")

    def _version(self) -> int:
        """One more than the newest version, whole or not; each change of the index has its own."""
        newest = [self._stored(name, schema).agg(F.max("version")).first()[0] for name, schema in (("counts", _COUNTS), ("gone", _GONE), ("refs", _REFS))]
        return 1 + max((n for n in newest if n is not None), default=0)

    def _finish(self, version: int) -> None:
        self._append("done", self.spark.createDataFrame([(version,)], _DONE), _DONE)

    def refs(self) -> DataFrame:
        """(a, b, id): the keys of documents that are in the index."""
        refs, gone = self._table("refs", _REFS), self._table("gone", _GONE)
        if gone.isEmpty():
            return refs.select(*KEY, "id")
        last = gone.groupBy("id").agg(F.max("version").alias("until"))
        alive = refs.join(last, "id", "left").where("until IS NULL OR version > until")
        return alive.select(*KEY, "id")

    def counts(self, version: int | None = None) -> DataFrame:
        """(shard, a, b, n, last): exact number of documents and largest id of each key that has a document."""
        counts = self._table("counts", _COUNTS, version)
        if counts.select("version").distinct().count() <= 1:
            return counts.drop("version")
        newest = F.max_by(F.struct("n", "last"), "version").alias("_c")
        return counts.groupBy("shard", *KEY).agg(newest).select("shard", *KEY, "_c.*").where("n > 0")

    def filters(self) -> DataFrame:
        """(shard, slots): the newest filter of each shard."""
        every = self._table("filters", _FILTERS)
        newest = every.groupBy("shard").agg(F.max("version").alias("version"))
        return every.join(newest, ["shard", "version"]).select("shard", "slots")

    def _shards(self, rows: DataFrame) -> int:
        """Shards of the index: as the first insertion needs them, and the same ever after."""
        path = f"{self.folder}/shards"
        held = self._stored("shards", "shards int").first()
        if held is None:
            many = max(1, -(-rows.count() // self.shard_keys))
            self.spark.createDataFrame([(many,)], "shards int").write.parquet(path)
            return many
        return held["shards"]

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Add documents. Ids that the index has already are passed over (delete them first); rows without an id too.

        Rows with one id are one document with the keys of all of them.
        """
        version = self._version()
        texts = C.only(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long")).where("id IS NOT NULL")
        least = self.least_points
        new = texts.mapInArrow(lambda batches: _posted(batches, least), "a long, b long, id long")
        if version > 1:
            new = new.join(self.refs().select("id").distinct(), "id", "left_anti")
        with scratch():
            rows = new.withColumn("version", F.lit(version))
            repeated = texts.groupBy("id").count().where("count > 1")
            if not repeated.isEmpty():
                rows = rows.distinct()
            self._append("refs", rows, _REFS)
            mine = self._table("refs", _REFS, version).where(F.col("version") == version)
            keys = cut(mine.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("id").alias("last")), "keys")
            shards = self._shards(keys)
            keys = keys.withColumn("shard", F.expr(f"cast(pmod(b, {shards}) as int)"))
            before = self.filters()
            told = cut(keys.groupBy("shard").cogroup(before.groupBy("shard")).applyInArrow(_insertion, _OWNED_SCHEMA), "told")
            fresh = told.where("seen = false").withColumn("version", F.lit(version))
            maybe = told.where("seen = true").select("shard", *KEY, "n", "last")
            if version > 1:
                old = self.counts().select("shard", *KEY, F.col("n").alias("n0"), F.col("last").alias("last0"))
                both = maybe.join(old, ["shard", *KEY], "left")
                maybe = both.select("shard", *KEY, (F.col("n") + F.coalesce("n0", F.lit(0))).alias("n"), F.greatest("last", "last0").alias("last"))
                missed = cut(both.where("n0 IS NULL").select("shard", *KEY), "missed")
            else:
                missed = maybe.select("shard", *KEY)
            changed = cut(fresh.select("shard", *KEY, "n", "last").unionByName(maybe), "changed").withColumn("version", F.lit(version))
            self._append("counts", changed, _COUNTS)
            self._filters_after(told.where("slots IS NOT NULL").select("shard", "slots"), missed, version)
        self._finish(version)

    def _filters_after(self, told: DataFrame, missed: DataFrame, version: int) -> None:
        """Store filters: with the keys that only looked known, and made anew from the exact counts where they overflow."""
        if not missed.isEmpty():
            told = cut(told.groupBy("shard").cogroup(missed.groupBy("shard")).applyInArrow(_more, "shard int, slots binary"), "told")
        stored = told.where("length(slots) > 0")
        over = told.where("length(slots) = 0").select("shard")
        if not over.isEmpty():
            anew = self.counts(version).join(over, "shard", "left_semi").groupBy("shard").applyInArrow(_anew, "shard int, slots binary")
            stored = stored.unionByName(anew)
        self._append("filters", cut(stored, "filters").withColumn("version", F.lit(version)), _FILTERS)

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> None:
        """Take out the documents whose ids are given; ids that the index does not have change nothing."""
        version = self._version()
        with scratch():
            known = self.refs()
            named = C.only(ids, id=id_col).select(F.col("id").cast("long").alias("id")).where("id IS NOT NULL").distinct()
            going = cut(known.join(named, "id", "left_semi"), "going")
            if going.isEmpty():
                return
            shards = self._shards(going)
            keys = cut(going.select(*KEY).distinct(), "keys")
            rest = known.join(named, "id", "left_anti").join(keys, KEY, "left_semi").groupBy(*KEY).agg(F.count("*").alias("n"), F.max("id").alias("last"))
            counted = keys.join(rest, KEY, "left").withColumns({"n": F.coalesce("n", F.lit(0)), "shard": F.expr(f"cast(pmod(b, {shards}) as int)"), "version": F.lit(version)})
            counted = cut(counted, "counted")
            ended = counted.where("n = 0").select("shard", "a")
            filters = cut(ended.groupBy("shard").cogroup(self.filters().groupBy("shard")).applyInArrow(_deletion, "shard int, slots binary"), "filters")
            self._append("gone", going.select("id").distinct().withColumn("version", F.lit(version)), _GONE)
            self._append("counts", counted, _COUNTS)
            self._append("filters", filters.withColumn("version", F.lit(version)), _FILTERS)
        self._finish(version)

    def dropped(self, least_docs: int = LEAST_DOCS) -> DataFrame:
        """(id, a array, b array): keys whose lines a document of the index loses."""
        repeated = cut(self.counts().where(F.col("n") >= least_docs).select(*KEY, "n", "last"), "repeated")
        loses = C.hot_join(self.refs(), repeated, KEY, "n").where("id <> last")
        return loses.groupBy("id").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))

    def kept(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = LEAST_DOCS, digest: bool = False) -> DataFrame:
        """One row per row of ``docs``: id, n_lines, n_dropped, and the text of the lines that stay, joined by line feeds
        (``digest``: its SHA-256, kept_sha256, in its place). Documents that are not in the index lose nothing.
        """
        drops = self.dropped(least_docs).withColumnRenamed("id", "_id")
        texts = C.only(docs, id=id_col, text=text_col)
        joined = texts.join(drops, F.col("id").cast("long") == F.col("_id"), "left").drop("_id")
        name = "kept_sha256" if digest else "text"
        schema = f"id {dict(texts.dtypes)['id']}, n_lines long, n_dropped long, {name} string"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in C.steps(batches, "text"):
                lines = _Lines(batch.column(1))
                drop = _among(lines, batch.column(2), batch.column(3))
                texts = []
                ends = np.cumsum(lines.many).tolist()
                whole = lines.data.tobytes()
                for a, b in zip([0, *ends[:-1]], ends, strict=True):
                    if not drop[a:b].any():
                        text = whole[lines.start[a] : lines.end[b - 1]]
                    else:
                        stay = a + np.flatnonzero(~drop[a:b])
                        text = b"\n".join([whole[s:e] for s, e in zip(lines.start[stay].tolist(), lines.end[stay].tolist(), strict=True)])
                    texts.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
                gone = np.bincount(lines.row[drop], minlength=batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines.many), pa.array(gone), pa.array(texts, pa.string())], ["id", "n_lines", "n_dropped", name])

        return joined.select("id", "text", "a", "b").mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _among(lines: _Lines, a: pa.Array, b: pa.Array) -> np.ndarray:
    """Which lines have a key that their row is to lose."""
    drop = np.zeros(len(lines.row), bool)
    ends = np.cumsum(lines.many)
    for i in np.flatnonzero(np.asarray(a.is_valid())).tolist():
        lose = set(zip(a[i].values.to_pylist(), b[i].values.to_pylist(), strict=True))
        span = slice(ends[i] - lines.many[i], ends[i])
        drop[span] = [key in lose for key in zip(lines.a[span].tolist(), lines.b[span].tolist(), strict=True)]
    return drop


def _insertion(key, rows: pa.Table, filters: pa.Table) -> pa.Table:
    return _owner(key, rows, filters) if rows.num_rows else pa.table([[]] * 7, _OWNED).cast(_OWNED_ARROW)


def _deletion(key, rows: pa.Table, filters: pa.Table) -> pa.Table:
    return _without(key, rows, filters) if rows.num_rows else filters.select(["shard", "slots"]).slice(0, 0)


def _more(key, told: pa.Table, missed: pa.Table) -> pa.Table:
    """A shard's filter with the keys that had looked known, but have no document yet."""
    slots = told.column("slots")[0].as_py()
    if missed.num_rows and slots:
        known = CuckooFilter(np.frombuffer(slots, np.uint16).copy())
        slots = known.slots.tobytes() if known.insert(np.asarray(missed.column("a")).view(np.uint64)) else b""
    return pa.table([told.column("shard"), pa.array([slots], pa.binary())], ["shard", "slots"])


_OWNED_ARROW = pa.schema(
    [("shard", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("last", pa.int64()), ("seen", pa.bool_()), ("slots", pa.binary())]
)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_lines, n_dropped, kept_sha256, by a new index of all of them.

    Texts are split at line feeds, null and empty ones into one empty line. A line's key is the line without white
    characters at both ends, A-Z in lower case. Keys of at least 20 code points that are in three documents or more lose
    all their lines but in the document with the largest id. Rows with one id are one document, of which each row is
    returned; rows without an id count for nothing and lose nothing. Whole texts are split, whatever their length; an
    empty table gives an empty result; other columns are not read.
    """
    index = LineIndex(docs.sparkSession)
    index.insert(docs, id_col, text_col)
    return index.kept(docs, id_col, text_col, digest=True)

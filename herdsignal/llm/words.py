"""Distinct-word tables: texts as numbers of words, each different word looked up once for all texts.

``split`` cuts the texts of a task into chunks of bounded size. A chunk keeps its texts as numbers of its own words, and
sends each of its different words once to the task that owns the word's bucket. ``answer`` lets the owner work out
something for every different word, and ``finish`` brings the answers back to the chunks, which put them in the
places of the numbers. However frequent a word is, a chunk sends it once. All tables are rows of packed arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from herdsignal.llm import common as C

#: Bytes of text per chunk (one text at least).
CHUNK_BYTES = 16 << 20
#: Bytes of text that are split at a time.
STEP = 2 << 20
#: Rows of bucket DOCUMENTS hold a chunk's texts, the others its words.
DOCUMENTS = -1

_SCHEMA = "chunk long, bucket int, a binary, b binary, c binary, d binary, sign binary"
_NAMES = ["chunk", "bucket", "a", "b", "c", "d", "sign"]

#: A splitter turns a column of texts into two hashes of all words, words per text, and a function that gives the words
#: at some positions as the bytes that stand for them.
Splitter = Callable[[pa.Array], tuple[tuple[np.ndarray, np.ndarray], np.ndarray, Callable[[np.ndarray], list[bytes]]]]


def pack(values: np.ndarray) -> bytes:
    """A compressed array: byte planes, so that small numbers cost little."""
    raw = np.ascontiguousarray(values)
    planes = raw.view(np.uint8).reshape(len(raw), -1).T.tobytes() if len(raw) else b""
    return len(planes).to_bytes(8, "little") + (pa.Codec("zstd").compress(planes, asbytes=True) if planes else b"")


def unpack(data: bytes, kind) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    if not size:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[8:], size, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def pack_strings(values: list[bytes]) -> tuple[bytes, bytes]:
    return pack(np.array([len(v) for v in values], np.uint32)), pack(np.frombuffer(b"".join(values), np.uint8))


def unpack_strings(lengths: bytes, data: bytes) -> list[bytes]:
    ends = np.cumsum(unpack(lengths, np.uint32).astype(np.int64)).tolist()
    whole = unpack(data, np.uint8).tobytes()
    return [whole[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


TEXTS, WORDS = "texts", "words"


@dataclass
class _Step:
    """Some texts: ids, marks, their words as numbers of the different ones, hashes of these, words per text, spelling."""

    ids: pa.Array
    marks: np.ndarray | None
    codes: np.ndarray
    hashes: tuple[np.ndarray, np.ndarray]
    sizes: np.ndarray
    spelled: list[bytes]


def split(docs: DataFrame, splitter: Splitter, buckets: int, marked: bool = False, parts: tuple[str, ...] = (TEXTS, WORDS)) -> DataFrame:
    """The chunks of ``docs`` (id, text and, if ``marked``, a boolean ``mark``): rows of texts, rows of words or both.

    Word rows carry the words, and how often they are in the texts (``marked``: in those marked, which may be never).
    Words are told apart by 128 bits of hashes. The frame is not written: two frames of the same ``docs`` agree only if
    its rows come in the same order each time, as those of files do; ``finish`` ends the job if they don't.
    """

    def chunk(number: int, steps: list[_Step]) -> Iterator[pa.RecordBatch]:
        keys, checks = (np.concatenate([step.hashes[i] for step in steps]) for i in (0, 1))
        codes, first = C.distinct(keys, checks)
        names = C.mixed(keys[first] ^ C.mixed(checks[first]))
        shift = np.cumsum([0, *(len(step.hashes[0]) for step in steps)])[:-1]
        index = np.concatenate([codes[s : s + len(step.hashes[0])][step.codes] for s, step in zip(shift.tolist(), steps, strict=True)])
        often = np.bincount(index, minlength=len(names))
        order = np.argsort(-often, kind="stable")
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        bucket = ((names >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32) if len(names) else np.zeros(0, np.int32)
        by_bucket = np.argsort(bucket, kind="stable")
        counts = np.concatenate([step.sizes for step in steps])
        sign = hashlib.blake2b(names.tobytes(), digest_size=8).digest()  # the same rows in the same order
        out: list[list] = [[] for _ in _NAMES]
        if TEXTS in parts:
            place = np.empty(len(names), np.int32)
            place[by_bucket] = np.arange(len(names), dtype=np.int32)
            ids = _ids(pa.concat_arrays([step.ids for step in steps]))
            row = (number, DOCUMENTS, ids, pack(counts.astype(np.int32)), pack(rank[index].astype(np.int32)), pack(place[order]), sign)
            for column, value in zip(out, row, strict=True):
                column.append(value)
        if WORDS in parts:
            spelled = [word for step in steps for word in step.spelled]
            if marked:
                often = np.bincount(index[np.repeat(np.concatenate([step.marks for step in steps]), counts)], minlength=len(names))
            for at, size in zip(*C.runs(bucket[by_bucket]), strict=True):
                mine = by_bucket[at : at + size]
                lengths, data = pack_strings([spelled[i] for i in first[mine].tolist()])
                row = (number, int(bucket[mine[0]]), lengths, data, pack(often[mine].astype(np.int64)), pack(names[mine]), sign)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, steps = TaskContext.get().partitionId() << 32, 0, []
        for batch in C.steps(batches, "text", STEP):
            size = batch.column(1).nbytes
            if held and held + size > CHUNK_BYTES:
                yield from chunk(number, steps)
                number, held, steps = number + 1, 0, []
            both, sizes, get = splitter(batch.column(1))
            codes, first = C.distinct(*both)
            marks = np.asarray(batch.column(2).fill_null(False)) if marked else None
            spelled = get(first) if WORDS in parts else []
            steps.append(_Step(batch.column(0), marks, codes.astype(np.int32), (both[0][first], both[1][first]), sizes, spelled))
            held += size
        if steps:
            yield from chunk(number, steps)

    return docs.mapInArrow(C.tidy(run), _SCHEMA)


def _ids(ids: pa.Array) -> bytes:
    """Ids of a chunk, nulls kept."""
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([ids], ["id"])
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


@dataclass
class Chunk:
    """A chunk's texts: ids, words per text, and all words as places in the answers."""

    ids: pa.Array
    counts: np.ndarray
    places: np.ndarray

    @property
    def offsets(self) -> np.ndarray:
        return np.r_[0, np.cumsum(self.counts.astype(np.int64))]


def answer(chunks: DataFrame, owner: Callable[[list[dict]], Iterator[tuple[dict, dict[str, bytes]]]], buckets: int) -> DataFrame:
    """(chunk, bucket, a, b, c, d): what ``owner`` says to each row of words of a bucket; it gets all rows of the bucket."""

    def run(key, table):
        out = [(row["chunk"], row["bucket"], *(told.get(k) for k in "abcd"), row["sign"]) for row, told in owner(table.to_pylist())]
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 5]
        C.give_back()
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], _NAMES)

    asked = chunks.where(F.col("bucket") != DOCUMENTS).repartition(buckets, "bucket")
    return asked.groupBy("bucket").applyInArrow(run, _SCHEMA)


def finish(chunks: DataFrame, answers: DataFrame, work: Callable[[Chunk, list[dict]], pa.Table], schema: str) -> DataFrame:
    """``work`` on every chunk and the answers to its words, in order of places."""

    def run(key, left, right):
        row = left.to_pylist()[0]
        ids = pa.ipc.open_stream(row["a"]).read_all().column(0).combine_chunks()
        places = unpack(row["d"], np.int32)[unpack(row["c"], np.int32)]
        told = sorted(right.to_pylist(), key=lambda r: r["bucket"])
        if any(r["sign"] != row["sign"] for r in told):
            raise ValueError("the rows of the texts came in another order; write them to a table first")
        done = work(Chunk(ids, unpack(row["b"], np.int32), places), told)
        C.give_back()
        return done

    texts = chunks.where(F.col("bucket") == DOCUMENTS)
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)

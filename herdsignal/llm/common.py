"""Shared pieces of the text operators: hot keys, connected components, hashes of words in numpy."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from herdsignal.session import cut, release

#: A key is hot when it holds more than this share of the rows; so at most HOT_KEYS keys are.
HOT_KEYS = 500
#: Bytes of text that one step of a task holds at a time; a longer text is a step of its own.
STEP_BYTES = 4 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns of ``df`` under the operator's own names, so that no other column can clash."""
    return df.select(*(F.col(f"`{theirs}`").alias(ours) for ours, theirs in columns.items()))


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_ids(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose id is among the first column of ``ids``, all columns as they are."""
    name = unused(df, "_among")
    wanted = ids.toDF(name).distinct()
    return df.join(wanted, df[id_col] == F.col(name), "left_semi")


def tasks(df: DataFrame) -> int:
    """Shuffle partitions of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_join(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str, how: str = "inner") -> DataFrame:
    """Join rows with ``groups`` (one row per key; ``size``: how many of the rows have it), whatever the skew.

    Keys with more than 1/HOT_KEYS of the rows number at most HOT_KEYS, so that part of ``groups`` is broadcast; the
    other keys are joined by a shuffle, in which none has more than that share. Both inputs are read twice: pass
    written tables.
    """
    total = groups.agg(F.sum(size).alias("_total"))
    marked = groups.crossJoin(F.broadcast(total))  # one row
    hot = marked.where(F.col(size) * HOT_KEYS > F.col("_total")).drop("_total")
    rest = marked.where(F.col(size) * HOT_KEYS <= F.col("_total")).drop("_total")
    return (
        rows.join(F.broadcast(hot), key)
        .unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key, how))
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (a, b).

    Every node points to its smallest neighbour, chains of pointers are shortened by repeated joins, edges are drawn
    anew between the roots, until none is left. Each round at least halves the nodes that still have edges.
    """
    edges = cut(edges.select("a", "b").where("a <> b").distinct(), "edges")
    label: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to"), F.count("*").alias("n")), "parent")
        while True:
            pointed = parent.where("to < a").groupBy("to").agg(F.count("*").alias("m")).withColumnRenamed("to", "via")
            up = parent.select(F.col("a").alias("via"), F.col("to").alias("top"))
            up = up.join(pointed, "via").where("top < via")
            if up.isEmpty():
                break
            moved = parent.select("a", "n", F.col("to").alias("via"))
            old, parent = parent, cut(
                hot_join(moved, cut(up, "up"), "via", "m", "left").select("a", F.coalesce("top", "via").alias("to"), "n"), "parent"
            )
            release(old)
        if label is None:
            label = parent.select(F.col("a").alias("node"), F.col("to").alias("component"))
        else:
            size = label.groupBy("component").agg(F.count("*").alias("m"))
            roots = cut(parent.select(F.col("a").alias("component"), F.col("to").alias("root")).join(size, "component"), "roots")
            label = cut(
                hot_join(label, roots, "component", "m", "left").select("node", F.coalesce("root", "component").alias("component")), "label"
            )
        to = cut(parent.select("a", "to", "n"), "to")
        one = cut(hot_join(edges, to, "a", "n").select(F.col("to").alias("c"), "b"), "half")
        in_b = one.groupBy("b").agg(F.count("*").alias("n"))
        to_b = cut(to.select(F.col("a").alias("b"), "to").join(in_b, "b"), "to")
        old, edges = edges, cut(
            hot_join(one, to_b, "b", "n").select(F.least("c", "to").alias("a"), F.greatest("c", "to").alias("b")).where("a <> b").distinct(), "edges"
        )
        release(old, one, to, to_b)
    if label is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return label


def steps(batches: Iterator[pa.RecordBatch], text: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a step holds about ``most`` bytes of ``text`` (one row at least)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        size = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
        at = 0
        while at < len(size):
            ends = np.cumsum(size[at:])
            to = at + max(1, int(np.searchsorted(ends, most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def give_back() -> None:
    """Returns freed memory to the system. Workers are used again, and what one operator's arrays have taken would
    otherwise count against the executor while the next one runs."""
    _kept.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries than glibc have none
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; freed memory is given back at the end of each task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return task


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column one after the other, and where each row starts (one more than rows)."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = column.cast(pa.large_binary())
    _, offsets, data = wide.buffers()
    starts = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    if data is None:
        return np.zeros(0, np.uint8), starts - starts[0]
    return np.frombuffer(data, np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def of(base: int) -> np.ndarray:
        x = np.full(size, base, np.uint64)
        x[0] = 1
        return np.multiply.accumulate(x)

    return of(_BASE), of(_INVERSE)


#: The powers that a task keeps from step to step, if any.
_kept: list[np.ndarray] = []


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64; those of usual sizes are kept until the task ends."""
    if size > 2 * STEP_BYTES:
        return _powers(size)
    if not _kept or len(_kept[0]) < size:
        _kept[:] = _powers(-(-size // (1 << 18)) << 18)
    return _kept[0][:size], _kept[1][:size]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end] (values: random 64-bit codes), equal for equal content and length."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


#: Spans of more bytes than this are hashed one by one by BLAKE2.
LONG_SPAN = 1024
#: The first 0 to 8 bytes of a block.
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the bytes data[start:end] of each span, equal for equal bytes.

    Blocks of eight bytes go one after the other through two chains of bijections of 64 bits; no sum of powers, whose
    collisions are known for every base. The first hash is folded from both chains, so that neither alone decides.
    """
    blocks = np.ndarray(len(data) + 1, "<u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    size = ends - starts
    a = mixed(size.astype(np.uint64) + np.uint64(0x8CB92BA72F3D8DD7))
    b = mixed(a ^ np.uint64(0xD6E8FEB86659FD93))
    live, at = np.flatnonzero((size > 0) & (size <= LONG_SPAN)), 0
    while len(live):
        block = blocks[starts[live] + at] & _FIRST_BYTES[np.minimum(size[live] - at, 8)]
        a[live] = mixed(a[live] ^ block)
        b[live] = mixed((b[live] + block) * np.uint64(0x9E3779B97F4A7C15))
        at += 8
        live = live[size[live] > at]
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=16).digest()
        a[i], b[i] = np.frombuffer(digest, "<u8")
    return mixed(a + mixed(b)), b


def distinct(hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the different pairs (hash, check), and where each number comes first."""
    while True:
        codes, values = pd.factorize(hashes)
        first = np.zeros(len(values), np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        other = checks != checks[first][codes]
        if not other.any():
            return codes, first
        hashes = np.where(other, mixed(hashes ^ mixed(checks)), hashes)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^ \\t-\\r]+`` of rows laid out one after the other, A-Z like a-z: hashes, row, start, end of each.

    ``between`` marks other bytes that part words, none of which are part of a longer character.
    """
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~between[data]
    begins = inside[1:] & ~inside[:-1]  # position i of data at index i
    stops = inside[:-1] & ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    joined = cuts[inside[cuts] & inside[cuts + 1]]  # a word that ends where the next row's word begins
    begins[joined] = True
    stops[joined] = True
    start, end = np.flatnonzero(begins), np.flatnonzero(stops)
    row = np.searchsorted(offsets, start, side="right") - 1
    return word_hashes(_LOWER[data], start, end), row, start, end


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])
    return starts, np.diff(np.r_[starts, len(sorted_values)])


def binary(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place reachable from each of n places by links (a, b)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new

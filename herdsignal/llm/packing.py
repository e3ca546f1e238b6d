"""Harmonic packing: pieces of reciprocal-capacity sizes, each class packed by a fixed number per sequence.

The sizes are ``capacity // k`` for k = 1, 2, 3, ... A document gives as many whole sequences as it fills; from its
rest the largest size that fits is cut, then again from what is left, which shrinks about as a square: three pieces or
so. Each class k fills its sequences with exactly k pieces, independently of the others and of other workers: a worker
numbers the pieces of its block, and sums of counts by block tell where its numbers begin. Less than one sequence of
each class is left over; these pieces (fewer than ``capacity`` tokens per class, whatever the input) are packed
together by first fit, the longest first.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from herdsignal.llm import bpe, words as W
from herdsignal.session import cut, scratch

CAPACITY = 4096
#: Pieces per block that a worker numbers.
BLOCK_PIECES = 100_000
#: Sequences of class k are numbered from k << CLASS_SHIFT; those of the left-over pieces from 0.
CLASS_SHIFT = 44


def class_of(rest: int, capacity: int = CAPACITY) -> int:
    """The smallest k with capacity // k <= rest."""
    k = max(1, capacity // (rest + 1))
    while capacity // k > rest:
        k += 1
    return k


def harmonic_cuts(length: int, capacity: int = CAPACITY) -> list[tuple[int, int, int]]:
    """(start, size, class) of the pieces of a document."""
    pieces, at = [], 0
    while at < length:
        k = class_of(min(length - at, capacity), capacity)
        pieces.append((at, capacity // k, k))
        at += capacity // k
    return pieces


def _pieces(end_id: int, capacity: int):
    def work(chunk: W.Chunk, told: list[dict]) -> pa.Table:
        sizes, ids = bpe.word_ids(told)
        starts = np.cumsum(sizes) - sizes
        known: dict[int, list[tuple[int, int, int]]] = {}
        offsets = chunk.offsets
        out: list[list] = [[], [], [], [], [], []]
        for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            tokens = np.append(bpe.text_ids(chunk.places[a:b], sizes, ids, starts), np.uint32(end_id)).astype("<u4")
            if len(tokens) not in known:
                known[len(tokens)] = harmonic_cuts(len(tokens), capacity)
            view = memoryview(tokens).cast("B")
            for start, size, k in known[len(tokens)]:
                for column, value in zip(out, (row, start, size, zlib.crc32(view[4 * start : 4 * (start + size)]), len(tokens), k), strict=True):
                    column.append(value)
        rows = chunk.ids.take(pa.array(out[0], pa.int64()))
        rest = [pa.array(column, pa.int64()) for column in out[1:]]
        return pa.table([rows, pa.array(out[0], pa.int64()), *rest], ["id", "row", "start", "length", "ids_crc32", "doc_tokens", "class"])

    return work


def cut_documents(docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, start, length, ids_crc32, doc_tokens, class): the pieces of every document, ``end_id`` added to each."""
    kind = dict(docs.select(id_col).dtypes)[id_col]
    schema = f"id {kind}, row long, start long, length long, ids_crc32 long, doc_tokens long, class long"
    return bpe.chunk_ids(docs, path, _pieces(end_id, capacity), schema, id_col, text_col)


def fill(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds bin, place and full (whether its sequence gets its k pieces) to the pieces of every class."""
    pieces = cut(pieces, "pieces")  # read for the totals, the counts and the numbers
    total = pieces.groupBy("class").agg(F.count("*").alias("in_class"))  # at most ``capacity`` classes
    block = F.expr(f"pmod(xxhash64(id, start, row), cast(ceil(in_class / {BLOCK_PIECES}) as bigint))")
    placed = pieces.join(F.broadcast(total), "class").withColumn("block", block)
    counts = placed.groupBy("class", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("class").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = counts.select("class", "block", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("class", "block").orderBy("id", "start", "row"))
    numbered = placed.withColumn("own", own - 1).join(begins, ["class", "block"])
    number = (F.col("before") + F.col("own")).cast("long")
    numbered = numbered.withColumn("bin", F.floor(number / F.col("class"))).withColumn("place", number % F.col("class"))
    return numbered.withColumn("full", (F.col("bin") + 1) * F.col("class") <= F.col("in_class"))


def _first_fit(capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop(columns="all").sort_values(["length", "id", "start", "row"], ascending=[False, True, True, True], kind="stable")
        used: list[int] = []
        sequence, offset = [], []
        opened = 0  # earlier sequences have no room for pieces of this size
        before = None
        for size in group["length"].tolist():
            opened, before = (opened if size == before else 0), size
            while opened < len(used) and used[opened] + size > capacity:
                opened += 1
            if opened == len(used):
                used.append(0)
            sequence.append(opened)
            offset.append(used[opened])
            used[opened] += size
        return group.assign(sequence_id=sequence, offset=offset)

    return run


def pack(docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its text (null: empty) by the tokenizer at ``path`` and ``end_id``; so empty texts are
    pieces of one token. Every id is in exactly one piece, offsets of a sequence are gapless from 0. Very long
    documents fill sequences of their own; repeated rows are packed each; ids may be null; only the two named columns
    are read; an empty table gives an empty result.
    """
    with scratch() as tables:
        placed = cut(fill(cut_documents(docs, path, end_id, capacity, id_col, text_col), capacity), "placed")
        tables.keep(placed)
    columns = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    sequence = F.shiftleft(F.col("class"), CLASS_SHIFT) + F.col("bin")
    offset = F.col("place") * F.floor(F.lit(capacity) / F.col("class"))
    whole = placed.where("full").select(*columns[:5], sequence.alias("sequence_id"), offset.cast("long").alias("offset"))
    # Fewer than ``capacity`` tokens of each of the some 2 * sqrt(capacity) classes, however long the input.
    rest = placed.where("NOT full").select("id", "row", *columns[1:5])
    kind = dict(placed.dtypes)["id"]
    schema = f"id {kind}, row long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    fitted = rest.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_first_fit(capacity), schema)
    return whole.unionByName(fitted.select(*columns)).withColumnRenamed("id", id_col)

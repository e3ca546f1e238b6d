"""Near-duplicate embeddings by collision-counting projections.

Vectors of equal direction are one from the start. Tables of random sign patterns bring vectors to cells, so that the
work does not grow with the square of the input; the number of tables follows from the recall that is asked for at the
threshold. In a cell every vector is a query: on each of ``PROJECTIONS`` lines the vectors are sorted, those in the
window around the query collide with it, and pairs with enough collisions are verified by their cosine. Width and count
are calibrated so that a pair at the threshold passes with probability ``PASS``.

Cells with more than ``BLOCK`` vectors are cut into blocks, and each pair of blocks is a group of its own. A pair that
meets in several tables is counted in the first of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from herdsignal.llm import common as C
from herdsignal.session import cut

THRESHOLD = 0.95
#: Least probability that a pair at the threshold meets in a cell, and that it passes the count there.
RECALL, PASS = 0.999, 0.9999
#: Lines per vector, vectors that a cell should hold, vectors per block of a larger cell.
PROJECTIONS, CELL, BLOCK = 32, 256, 1024
#: Half the window's width in standard deviations of the distance of a pair at the threshold.
WIDTH = 1.5
_SEED = 20_240_601


@dataclass(frozen=True)
class Plan:
    """Bits per table, tables, half width of the window, and collisions that a pair needs."""

    bits: int
    tables: int
    width: float
    count: int


def plan(vectors: int, threshold: float = THRESHOLD, recall: float = RECALL, passing: float = PASS) -> Plan:
    bits = max(1, math.ceil(math.log2(max(1, vectors) / CELL))) if vectors > CELL else 1
    alike = (1 - math.acos(threshold) / math.pi) ** bits
    tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - alike)))
    collide = math.erf(WIDTH / math.sqrt(2))
    below = 0.0
    count = 0
    while count < PROJECTIONS:
        below += math.comb(PROJECTIONS, count) * collide**count * (1 - collide) ** (PROJECTIONS - count)
        if below > 1 - passing:
            break
        count += 1
    return Plan(bits, tables, WIDTH * math.sqrt(2 - 2 * threshold), count)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors in double precision; null where there is none."""
    for batch in batches:
        out = []
        for value in batch.column(1):
            unit = None
            if value.is_valid and value.values.null_count == 0 and len(value.values):
                x = np.asarray(value.values, np.float64)
                if np.isfinite(x).all() and (top := np.abs(x).max()) > 0:
                    x = x / top
                    unit = (x / math.sqrt(float(x @ x))).tobytes()
            out.append(unit)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "unit"])


def _directions(size: int, how: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Directions of the tables' signs and of the lines, the same for all vectors of a length."""
    rng = np.random.default_rng(_SEED + size)
    return rng.standard_normal((size, how.bits * how.tables)), rng.standard_normal((size, PROJECTIONS))


def _cells(how: Plan):
    """A row per vector and table: (tab, cell, id, copies, unit, codes); a cell holds vectors of one length only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = [v.as_py() for v in batch.column(2)]
            for size in sorted({len(u) for u in units}):
                rows = [i for i, u in enumerate(units) if len(u) == size]
                x = np.frombuffer(b"".join(units[i] for i in rows), np.float64).reshape(len(rows), -1)
                signs = x @ _directions(size // 8, how)[0] > 0
                weights = C.mixed(np.arange(how.bits, dtype=np.uint64) + np.uint64(size << 8))
                codes = (signs.reshape(len(rows), how.tables, how.bits) * weights).sum(2, dtype=np.uint64)
                codes = (codes + C.mixed(np.array([size], np.uint64))).view(np.int64)  # lengths do not meet, whatever the signs
                take = pa.array(np.repeat(rows, how.tables))
                data = [c.tobytes() for c in codes]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.tile(np.arange(how.tables, dtype=np.int32), len(rows))),
                        pa.array(codes.ravel()),
                        batch.column(0).take(take),
                        batch.column(1).take(take),
                        batch.column(2).take(take),
                        pa.array([d for d in data for _ in range(how.tables)], pa.binary()),
                    ],
                    ["tab", "cell", "id", "copies", "unit", "codes"],
                )

    return run


def collisions(lines: np.ndarray, others: np.ndarray, width: float) -> np.ndarray:
    """How often each of ``others`` (columns) is in the window of each query (rows), line by line."""
    count = np.zeros((len(lines), len(others)), np.int16)
    each = np.arange(len(lines))
    for j in range(lines.shape[1]):
        order = np.argsort(others[:, j])
        line = others[order, j]
        marks = np.zeros((len(lines), len(others) + 1), np.int8)
        np.add.at(marks, (each, np.searchsorted(line, lines[:, j] - width, side="left")), 1)
        np.add.at(marks, (each, np.searchsorted(line, lines[:, j] + width, side="right")), -1)
        count[:, order] += np.cumsum(marks[:, :-1], axis=1, dtype=np.int8)
    return count


def _links(how: Plan, threshold: float):
    def run(key, table):
        tab, mine, theirs = (int(table.column(c)[0].as_py()) for c in ("tab", "low", "high"))
        block = np.asarray(table.column("block"))
        ids, copies = np.asarray(table.column("id")), np.asarray(table.column("copies"))
        order = np.lexsort((ids, block))
        block, ids, copies = block[order], ids[order], copies[order]
        units = table.column("unit").to_pylist()
        x = np.frombuffer(b"".join(units[i] for i in order.tolist()), np.float64).reshape(len(ids), -1)
        codes = table.column("codes").to_pylist()
        codes = np.frombuffer(b"".join(codes[i] for i in order.tolist()), np.int64).reshape(len(ids), -1)[:, : tab]
        lines = x @ _directions(x.shape[1], how)[1]
        left, right = (np.flatnonzero(block == b) for b in (mine, theirs))
        found_a, found_b = [], []
        for at in range(0, len(left), 256):
            queries = left[at : at + 256]
            some = collisions(lines[queries], lines[right], how.width) >= how.count
            a, b = np.nonzero(some)
            a, b = queries[a], right[b]
            ok = a < b if mine == theirs else np.ones(len(a), bool)
            a, b = a[ok], b[ok]
            for cut_at in range(0, len(a), 1 << 16):
                p, q = a[cut_at : cut_at + (1 << 16)], b[cut_at : cut_at + (1 << 16)]
                near = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
                p, q = p[near], q[near]
                if tab:
                    new = ~(codes[p] == codes[q]).any(1)
                    p, q = p[new], q[new]
                found_a.append(p)
                found_b.append(q)
        a, b = (np.concatenate([np.zeros(0, np.int64), *f]) for f in (found_a, found_b))
        links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
        to = C.forest(len(ids), a, b)
        keep = links > 0
        return pa.table([pa.array(ids[keep]), pa.array(links[keep].astype(np.int64)), pa.array(ids[to[keep]])], ["id", "links", "to"])

    return run


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept.

    Two vectors link when the cosine of their angle, in double precision, is ``threshold`` or more; no pair below it
    links, and a pair at it is found with probability RECALL * PASS (one further above more surely). Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing, and neither do vectors of different
    lengths. ``n_links`` counts the other rows that a row is linked with, copies and repeated rows too;
    ``component_id`` is the smallest id reachable, ``kept`` says whether it is the row's own. Rows without an id
    come back with no link, no component and kept false. Other columns are not read; an empty table gives an empty result.
    """
    units = cut(C.only(vectors, id=id_col, vector=vector_col).withColumn("id", F.col("id").cast("long")).mapInArrow(_units, "id long, unit binary"), "units")
    known = units.where("id IS NOT NULL AND unit IS NOT NULL")
    keyed = cut(known.select("id", F.sha2("unit", 256).alias("key")), "keyed")
    groups = cut(known.groupBy(F.sha2("unit", 256).alias("key")).agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("unit").alias("unit")), "groups")
    how = plan(groups.count(), threshold)
    cells = cut(groups.select(F.col("rep").alias("id"), "copies", "unit").mapInArrow(_cells(how), "tab int, cell long, id long, copies long, unit binary, codes binary"), "cells")
    sizes = cells.groupBy("tab", "cell").agg(F.count("*").alias("n")).where("n > 1")
    sizes = sizes.select("tab", "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = cells.join(sizes, ["tab", "cell"]).withColumn("block", F.expr("pmod(xxhash64(id), blocks)").cast("int"))
    # Every pair of blocks of a cell is a group; a row goes to as many as its cell has blocks.
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.select("tab", "cell", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "copies", "unit", "codes")
    found = cut(paired.groupBy("tab", "cell", "low", "high").applyInArrow(_links(how, threshold), "id long, links long, to long"), "found")
    label = C.components(found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = groups.select("key", "copies", F.col("rep").alias("id")).join(links, "id", "left").join(label.withColumnRenamed("node", "id"), "id", "left")
    named = cut(named.select("key", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "named")
    told = C.hot_join(keyed, named, "key", "copies").select("id", "n_links", "component_id")
    rest = units.where("id IS NULL OR unit IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    return told.unionByName(rest).select(F.col("id").alias(id_col), "n_links", "component_id", kept)

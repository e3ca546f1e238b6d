"""Ranked lexical search for many queries at once, with shared parts of their scores computed once.

Queries (items) are sets of terms, and a document's score for an item is the sum of its terms' weights there, so items
that share terms share partial sums. For a block of items:

1. Mining. Pairs of nodes that occur together in several items become a node of their own, most frequent first, and
   again over the new nodes, until no pair is shared. The result is a DAG: leaves are terms, an inner node is the sum of
   two others, an item the sum of a few nodes.
2. One pass over the texts keeps for each document its number of terms and the block's terms that it has, as a table.
   Its totals and document frequencies give the weights.
3. One pass over that table. A task holds an accumulator per node and document of a step. Leaves are filled from the
   documents, inner nodes level by level, each once for all items that share it, and items last; each item keeps its
   best documents. The best of all tasks are ranked by a window over at most ``TOP`` rows per task and item.

The DAG, the terms and the weights of a block are broadcast; their size is bounded by ``BLOCK_ITEMS`` and
``BLOCK_TERMS``. Items beyond that make further blocks.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from herdsignal.llm import common as C
from herdsignal.session import cut, release

#: Documents per item.
TOP = 50
#: Items and terms of a block (one item at least, whatever its terms).
BLOCK_ITEMS, BLOCK_TERMS = 512, 1 << 16
#: Documents whose accumulators a task holds at a time, and the most accumulators (numbers) of a step.
STEP_DOCS, STEP_CELLS = 512, 1 << 23
#: Terms of an item that take part in the mining of pairs; the others stay leaves. Pairs per item are bounded so.
MINED = 256

# Characters between terms, and the terms of a text.
_BETWEEN = np.array([c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 128 for c in range(256)])
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text: str | None) -> list[str]:
    """All terms of a text, A-Z in lower case; null has none."""
    return _TERM.findall((text or "").translate(str.maketrans(C.UPPER, C.LOWER)))


@dataclass(frozen=True)
class Plan:
    """Terms of a block, inner nodes as sums of two earlier ones, by levels, and the nodes that each item adds up."""

    terms: list[str]
    levels: list[tuple[np.ndarray, np.ndarray]]  # left and right nodes; a level's nodes are numbered on
    nodes: list[list[int]]  # per item

    @property
    def size(self) -> int:
        return len(self.terms) + sum(len(left) for left, _ in self.levels)


def share(items: list[set[str]]) -> Plan:
    """The query-sharing DAG of the items' term sets."""
    terms = sorted(set().union(*items)) if items else []
    number = {term: i for i, term in enumerate(terms)}
    own = [sorted(number[t] for t in item) for item in items]
    often = Counter(n for nodes in own for n in nodes)
    # The terms that most items have take part first; a term of one item cannot be shared.
    live = [sorted((n for n in nodes if often[n] > 1), key=lambda n: (-often[n], n))[:MINED] for nodes in own]
    alone = [sorted(set(nodes) - set(mine)) for nodes, mine in zip(own, live, strict=True)]
    levels, size = [], len(terms)
    while True:
        pairs = Counter(pair for nodes in live for pair in combinations(sorted(nodes), 2))
        where: dict[tuple[int, int], int] = {}
        shared = {pair: n for pair, n in pairs.items() if n > 1}
        made: list[tuple[int, int]] = []
        used = Counter()
        after = []
        for nodes in live:
            free, new = set(nodes), []
            ranked = sorted((pair for pair in combinations(sorted(nodes), 2) if pair in shared), key=lambda p: (-shared[p], p))
            for pair in ranked:
                if free.issuperset(pair):
                    free.difference_update(pair)
                    if pair not in where:
                        where[pair] = len(made)
                        made.append(pair)
                    used[pair] += 1
                    new.append(pair)
            after.append((free, new))
        kept = [pair for pair in made if used[pair] > 1]
        if not kept:
            break
        place = {pair: size + i for i, pair in enumerate(kept)}
        live = [
            sorted([*free, *(n for pair in new for n in ([place[pair]] if pair in place else pair))]) for free, new in after
        ]
        levels.append((np.array([a for a, _ in kept]), np.array([b for _, b in kept])))
        size += len(kept)
    return Plan(terms, levels, [sorted([*a, *b]) for a, b in zip(alone, live, strict=True)])


@dataclass(frozen=True)
class _Known:
    """The block's terms as sorted hashes with their checks and numbers."""

    hashes: np.ndarray
    checks: np.ndarray
    numbers: np.ndarray

    @staticmethod
    def of(terms: list[str]) -> _Known:
        raw = [t.encode() for t in terms]
        ends = np.cumsum([len(r) for r in raw]).astype(np.int64)
        hashes, checks = C.word_hashes(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, ends[:-1]][: len(ends)], ends)
        order = np.argsort(hashes)
        return _Known(hashes[order], checks[order], order)

    def find(self, hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Number of each word, -1 for words that are no term of the block."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        same = (self.hashes[at] == hashes) & (self.checks[at] == checks)
        return np.where(same, self.numbers[at], -1)


_SPARSE = "n long, terms binary, often binary"


def _sparse(shared):
    """Per text: how many terms it has, and which of the block's terms how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in C.steps(batches, "text"):
            data, offsets = C.raw(batch.column(1))
            both, row, _, _ = C.words(data, offsets, _BETWEEN)
            n = np.bincount(row, minlength=batch.num_rows)
            number = known.find(*both)
            code, often = np.unique(row[number >= 0] * (len(known.hashes) + 1) + number[number >= 0], return_counts=True)
            ends = np.cumsum(np.bincount(code // (len(known.hashes) + 1), minlength=batch.num_rows)).tolist()
            term = (code % (len(known.hashes) + 1)).astype(np.int32)
            often = often.astype(np.int64)
            spans = list(zip([0, *ends[:-1]], ends, strict=True))
            columns = [pa.array(n, pa.int64()), C.binary([term[a:b].tobytes() for a, b in spans]), C.binary([often[a:b].tobytes() for a, b in spans])]
            keep = pa.array(n > 0)
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in (batch.column(0), *columns)], ["id", "n", "terms", "often"])

    return run


def _frequencies(many: int):
    """Document frequencies of the block's terms in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(many, np.int64)
        for batch in batches:
            sums += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32), minlength=many)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], ["term", "df"])

    return run


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)


def scores(plan: Plan, weight: np.ndarray, total: int, documents: int, n: np.ndarray, row: np.ndarray, term: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Scores of all items (rows) for some documents (columns), every inner node of the DAG added up once.

    ``row``, ``term`` and ``often``: document, number and count of each of their terms.
    """
    cells = np.zeros((plan.size, len(n)), np.int64)
    m = 50 + 50 * n * documents // max(total, 1)
    cells[term, row] = weight[term] * (1_000_000_000 * often // (1000 * often + 20 * m[row]))
    at = len(plan.terms)
    for left, right in plan.levels:
        np.add(cells[left], cells[right], out=cells[at : at + len(left)])
        at += len(left)
    out = np.zeros((len(plan.nodes), len(n)), np.int64)
    for item, nodes in enumerate(plan.nodes):
        if nodes:
            out[item] = cells[nodes].sum(0)
    return out


def _best(item: np.ndarray, score: np.ndarray, doc: np.ndarray, top: int) -> np.ndarray:
    """Places of each item's ``top`` best documents, equal scores by document."""
    order = np.lexsort((doc, -score, item))
    starts, sizes = C.runs(item[order])
    return order[np.arange(len(order)) - np.repeat(starts, sizes) < top]


def _ranked(shared, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, weight, total, documents = shared.value
        many = len(plan.nodes)
        least = np.ones(many, np.int64)  # what a document needs to be among an item's best so far
        item, score, doc = (np.zeros(0, np.int64) for _ in range(3))
        step = max(1, min(STEP_DOCS, STEP_CELLS // max(1, plan.size)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids, n = (np.asarray(part.column(i)) for i in (0, 1))
                term = np.frombuffer(b"".join(part.column(2).to_pylist()), np.int32)
                often = np.frombuffer(b"".join(part.column(3).to_pylist()), np.int64)
                row = np.repeat(np.arange(len(n)), [len(x) // 4 for x in part.column(2).to_pylist()])
                found = scores(plan, weight, total, documents, n, row, term, often)
                who, where = np.nonzero(found >= least[:, None])
                item, score, doc = np.r_[item, who], np.r_[score, found[who, where]], np.r_[doc, ids[where]]
                if len(item) > 4 * top * many:
                    keep = _best(item, score, doc, top)
                    item, score, doc = item[keep], score[keep], doc[keep]
                    starts, sizes = C.runs(item)
                    full = sizes == top
                    least[item[starts[full]]] = score[(starts + sizes - 1)[full]]
        keep = _best(item, score, doc, top)
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (item, doc, score)], ["item", "doc", "score"])

    return run


def _blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[object, set[str]]]]:
    """Items with their terms, a block at a time."""
    rows = C.only(items, item=item_col, text=text_col).where("item IS NOT NULL AND text IS NOT NULL").orderBy("item")
    block, terms = {}, set()
    for row in rows.toLocalIterator():
        new = set(terms_of(row["text"]))
        if row["item"] not in block and block and (len(block) == BLOCK_ITEMS or len(terms | new) > BLOCK_TERMS):
            yield list(block.items())
            block, terms = {}, set()
        block.setdefault(row["item"], set()).update(new)
        terms |= new
    if block:
        yield list(block.items())


def search(
    items: DataFrame, docs: DataFrame, top: int = TOP, item_col: str = "item_id", item_text: str = "text", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The ``top`` best documents of each item: item, rank (int, from 1), id, score (both long).

    Terms are runs of digits, letters and characters beyond ASCII, A-Z in lower case, of whole texts; null and empty
    texts have none, and such documents count for nothing and are never found. With N documents that have terms, L terms
    in all of them, n in one, df documents that have a term and tf occurrences of it in the document, the weight is
    ``w = floor(1000 ln((2N + 2) / (2 df + 1)))``, ``m = 50 + (50 n N) div L``, and the score is the sum of
    ``w * ((10^9 tf) div (1000 tf + 20 m))`` over an item's different terms. Only scores above 0 are returned, equal
    ones by ascending id. Rows of one item are one item with the terms of all; rows of ``docs`` with equal ids are
    documents each; rows without an id count but are not found, items without one are left out. Ids of documents must
    be whole numbers. Empty tables give an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    kind = dict(items.dtypes)[item_col]
    texts = C.only(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long")).where("text IS NOT NULL")
    result = spark.createDataFrame([], f"item {kind}, rank int, doc long, score long")
    for block in _blocks(items, item_col, item_text):
        plan = share([terms for _, terms in block])
        known = spark.sparkContext.broadcast(_Known.of(plan.terms))
        table = cut(texts.mapInArrow(_sparse(known), f"id long, {_SPARSE}"), "sparse")
        totals = table.agg(F.count("*").alias("documents"), F.sum("n").alias("total")).first()
        counted = table.select("terms").mapInArrow(_frequencies(len(plan.terms)), "term int, df long")
        df = np.zeros(len(plan.terms), np.int64)
        for row in counted.groupBy("term").agg(F.sum("df").alias("df")).collect():  # at most the block's terms
            df[row["term"]] = row["df"]
        weight = weights(df, totals["documents"])
        shared = spark.sparkContext.broadcast((plan, weight, totals["total"] or 0, totals["documents"]))
        best = table.where("id IS NOT NULL").mapInArrow(_ranked(shared, top), "item long, doc long, score long")
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc"))
        ranked = cut(best.withColumn("rank", rank).where(F.col("rank") <= top), "ranked")
        release(table)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"item long, name {kind}")
        result = result.unionByName(ranked.join(F.broadcast(names), "item").select(F.col("name").alias("item"), "rank", "doc", "score"))
    return result.withColumnsRenamed({"item": item_col, "doc": id_col})

"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams by label are summed over every labelled text that is given to ``fit``; the matrix of logarithms
(labels times ``BUCKETS``, whatever the input) is broadcast and texts are scored in numpy, one step of a task at a time.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from herdsignal.llm import common as C

#: n-gram lengths, hash buckets, added count, and the most labels a model may have (it is broadcast).
ORDERS, BUCKETS, ADDED, MOST_LABELS = (1, 2, 3), 1 << 16, 0.1, 1000
#: Bytes of text scored at a time.
STEP = 1 << 19
UNDETERMINED = "und"


@dataclass(frozen=True)
class Model:
    """Labels in order, logarithms of their shares, and of the n-grams' shares within each (buckets x labels)."""

    labels: list[str]
    prior: np.ndarray
    weights: np.ndarray


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case and "is a letter" of the first 65,536 code points."""
    lower, letter = np.arange(1 << 16, dtype=np.uint32), np.zeros(1 << 16, bool)
    for i in range(1 << 16):
        if not 0xD800 <= i < 0xE000:
            small = chr(i).lower()
            lower[i] = ord(small) if len(small) == 1 else i
            letter[i] = unicodedata.category(chr(i))[0] == "L"
    return lower, letter


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of all rows, runs of anything else as one space before and after words; row of each."""
    data, offsets = C.raw(column)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    before = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    at = before[offsets]  # code points before each row
    lower, letter = _tables()
    high = points >= 1 << 16
    low = np.where(high, 0, points)
    is_letter = letter[low]
    for value in np.unique(points[high]):
        is_letter[points == value] = unicodedata.category(chr(value))[0] == "L"
    small = np.where(high, points, lower[low])
    rows = np.repeat(np.arange(len(column)), np.diff(at))
    after = np.zeros(len(points), bool)  # the first code point behind a word of the same row
    after[1:] = ~is_letter[1:] & is_letter[:-1] & (rows[1:] == rows[:-1])
    keep = is_letter | after
    small = np.where(is_letter, small, 32)[keep]
    rows = rows[keep]
    if not len(rows):
        return small, rows
    # Each row begins and ends with a space, whether or not it does in the text.
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    last = np.r_[first[1:] - 1, len(rows) - 1]
    open_end = last[small[last] != 32]
    where = np.r_[first, open_end + 1]
    return np.insert(small, where, 32), np.insert(rows, where, np.r_[rows[first], rows[open_end]])


def _grams(column: pa.Array, orders=ORDERS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket and row of all n-grams, order by order; grams of one space are left out."""
    points, rows = _letters(column)
    for n in orders:
        if len(points) < n:
            continue
        size = len(points) - n + 1
        inside = rows[n - 1 :] == rows[:size]
        if n == 1:
            inside = inside & (points != 32)
        mixed = np.full(size, n * 0x9E3779B1, np.uint64)
        for j in range(n):
            mixed = (mixed ^ points[j : j + size]) * np.uint64(0x9FB21C651E98DF25)
            mixed ^= mixed >> np.uint64(28)
        yield (mixed & np.uint64(BUCKETS - 1)).astype(np.int64)[inside], rows[:size][inside]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in C.steps(batches, "text", STEP):
        labels, names = batch.column(1).dictionary_encode(), None
        codes, names = np.asarray(labels.indices), labels.dictionary.to_pylist()
        for name, many in zip(names, np.bincount(codes, minlength=len(names)), strict=True):
            sums.setdefault(name, np.zeros(BUCKETS + 1, np.int64))[BUCKETS] += many
        for bucket, row in _grams(batch.column(0)):
            found = np.bincount(codes[row] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
            for name, mine in zip(names, found, strict=True):
                sums[name][:BUCKETS] += mine
    for name, mine in sums.items():
        at = np.flatnonzero(mine)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(mine[at])], ["label", "bucket", "n"])


def fit(docs: DataFrame, text_col: str = "text", label_col: str = "lang") -> Model:
    """The model of all rows with a text and a label; rows that lack one teach nothing."""
    rows = C.only(docs, text=text_col, label=label_col).where("text IS NOT NULL AND label IS NOT NULL")
    counts = rows.mapInArrow(C.tidy(_counts), "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    labels = sorted(r["label"] for r in rows.select("label").distinct().limit(MOST_LABELS + 1).collect())
    if len(labels) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    table = counts.toPandas()  # at most MOST_LABELS x (BUCKETS + 1) rows, whatever the input
    sums = np.zeros((BUCKETS + 1, len(labels)))
    sums[table["bucket"], [labels.index(x) for x in table["label"]]] = table["n"]
    shares = sums[:BUCKETS] + ADDED
    prior = np.log(sums[BUCKETS] / max(1.0, sums[BUCKETS].sum())) if labels else np.zeros(0)
    return Model(labels, prior, np.log(shares / shares.sum(0)))


def tag(docs: DataFrame, model: Model, text_col: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted label of each row and its score (see ``predict``) as two more columns, in place: no
    shuffle, all rows and columns kept. The two names must not be taken (``common.unused`` finds free ones)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, prior, weights = shared.value.labels, shared.value.prior, shared.value.weights
        step = max(1 << 14, STEP * 4 // max(4, len(labels)))
        for batch in C.steps(batches, text_col, step):
            sums = np.zeros((batch.num_rows, len(labels)))
            seen = np.zeros(batch.num_rows, bool)
            for bucket, row in _grams(batch.column(columns.index(text_col))):
                if not len(row) or not labels:
                    continue
                starts, _ = C.runs(row)
                seen[row[starts]] = True
                sums[row[starts]] += np.add.reduceat(weights[bucket], starts, axis=0)
            if labels:
                sums += prior
                best = sums.argmax(1)
                share = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
            names = [labels[best[i]] if seen[i] else UNDETERMINED for i in range(len(seen))]
            sure = np.where(seen, share, 0.0) if labels else np.zeros(len(seen))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(sure)], [*columns, label, score])

    schema = T.StructType([*docs.schema.fields, T.StructField(label, T.StringType()), T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(C.tidy(run), schema)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score.

    ``score`` is the posterior probability of the predicted label. Texts that are null or have no letter, and all texts
    if nothing was learned, are ``und`` with score 0. Of labels with equal scores the first in order wins. Whole texts
    are scored, repeated rows alike; ids may be null. Only the two named columns are read.
    """
    found = tag(C.only(docs, id=id_col, text=text_col), model)
    return found.select(F.col("id").alias(id_col), "lang_pred", "score")

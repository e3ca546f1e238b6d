"""Phrase collocation mining: phrases of two to four words that stand together more often than their parts suggest.

Texts become numbers of frequent words (``words``: each different word of a language is counted and numbered by the
task that owns it); everything else in a text is a barrier. Then, for phrases of 2, 3 and 4 words in turn:

1. Candidates are Apriori-safe: a phrase is looked at only where it stands in the text and both phrases that are a word
   shorter are frequent, by a bitmap of hashes of fixed size. Tasks bincount the hashes of such phrases, sums of these
   vectors tell which hashes are frequent enough, and phrases with such a hash are the candidates. Neither step loses
   a frequent phrase; what they let through besides is counted and dropped, however much that is: in large tables
   most places of the bitmap are frequent.
2. Each task counts the different candidates of its texts and deals these counts, packed, to groups by the phrases'
   hashes. The task of a group leaves out the phrases whose 64-bit hash is too rare, lays the others into double-array
   tries, small ones for shards of their first two words, one behind the other, moves the states of all its phrases at
   once in numpy, level by level, and sums the counts by accepting state. So the texts are read twice for each length,
   however many candidates there are.

Scores, cuts and the ranking are joins and windows on the frequent phrases. What is broadcast is bounded by ``BITS``,
what a task holds by ``HELD`` and ``MOST``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from herdsignal.llm import common as C, words as W
from herdsignal.session import cut, release, scratch

#: Least occurrences, longest phrase, phrases per language.
LEAST, LONGEST, TOP = 30, 4, 2000
#: Score of a phrase whose parts never stand alone, and the per cent of occurrences that make a longer phrase cover it.
SCALE, COVER = 2_000_000, 80
#: Bits of a hash that number the places of a bitmap; candidates per trie, and positions of the texts per group, on average.
BITS, SHARD, MOST = 24, 1 << 14, 1 << 21
#: Positions whose phrases a task looks at together, and counts that it holds before it deals them out.
POSITIONS, HELD = 1 << 18, 1 << 20
#: Numbers per block of a summed vector, and vectors added up by one task.
BLOCK, FAN_IN = 1 << 18, 32

# Characters that end a piece, and those between words.
_BREAK, _BETWEEN = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_BETWEEN[_BREAK] = True
_BETWEEN[[9, 32]] = True

#: Codes of the numbered texts: a frequent word is above 0, another word 0, the end of a piece BREAK, a language below.
BREAK = -1


def splitter(column: pa.Array):
    """Words of texts that begin with a line for their language, the end of each piece as an empty word.

    A word is spelled as language, tab, word, so that each language has words of its own.
    """
    data, offsets = C.raw(column)
    both, row, start, end = C.words(data, offsets, _BETWEEN)
    low = C._LOWER[data].tobytes()
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    of_row = np.zeros(len(column), np.int64)
    of_row[row[first]] = first
    is_language = np.zeros(len(row), bool)
    is_language[first] = True
    tongue = tuple(C.mixed(h[of_row[row]] ^ np.uint64(0x5851F42D4C957F2D)) for h in both)
    hashes = [np.where(is_language, t, C.mixed(h ^ t)) for h, t in zip(both, tongue, strict=True)]
    breaks = np.cumsum(np.r_[0, _BREAK[data]])[start] if len(row) else np.zeros(0, np.int64)
    new = np.zeros(len(row), bool)
    new[1:] = (row[1:] == row[:-1]) & (breaks[1:] != breaks[:-1]) & ~is_language[:-1]
    at = np.flatnonzero(new)
    word = np.insert(np.arange(len(row)), at, -1)
    hashes = tuple(np.insert(h, at, np.uint64(0x2545F4914F6CDD1D)) for h in hashes)

    def spelled(places: np.ndarray) -> list[bytes]:
        out = []
        for i in word[places].tolist():
            if i < 0:
                out.append(b"")
                continue
            lang = of_row[row[i]]
            name = low[start[lang] : end[lang]] + b"\t"
            out.append(name if is_language[i] else name + low[start[i] : end[i]])
        return out

    counts = np.bincount(row, minlength=len(column)) + np.bincount(row[at], minlength=len(column))
    return hashes, counts.astype(np.int64), spelled


#: Chunk of the rows that hold a bucket's numbered words instead of an answer.
NUMBERED = -1


def _owner(buckets: int, least: int):
    """Owner of a bucket of words: numbers of the words of each chunk, and one row with the numbered words."""

    def run(rows: list[dict]):
        names = [W.unpack(row["d"], np.uint64) for row in rows]
        counts = np.concatenate([W.unpack(row["c"], np.int64) for row in rows])
        values, first, place = np.unique(np.concatenate(names), return_index=True, return_inverse=True)
        total = np.zeros(len(values), np.int64)
        np.add.at(total, place, counts)
        lengths = [W.unpack(row["a"], np.uint32).astype(np.int64) for row in rows]
        data = np.concatenate([W.unpack(row["b"], np.uint8) for row in rows]).tobytes()
        ends = np.cumsum(np.concatenate(lengths))
        starts = ends - np.concatenate(lengths)
        last = np.frombuffer(data, np.uint8)[np.maximum(ends[first] - 1, 0)] if data else np.zeros(len(first), np.uint8)
        size = (ends - starts)[first]
        is_break = size == 0
        is_language = ~is_break & (last == 9)
        frequent = (total >= least) & ~is_break & ~is_language
        bucket = rows[0]["bucket"]
        code = np.zeros(len(values), np.int32)
        code[is_break] = BREAK
        code[is_language] = -2 - (np.arange(is_language.sum()) * buckets + bucket)
        code[frequent] = 1 + np.arange(frequent.sum()) * buckets + bucket
        at = 0
        for row, mine in zip(rows, names, strict=True):
            yield row, {"a": W.pack(code[place[at : at + len(mine)]])}
            at += len(mine)
        told = np.flatnonzero(is_language | frequent)
        lengths, words = W.pack_strings([data[starts[i] : ends[i]] for i in first[told].tolist()])
        yield {"chunk": NUMBERED, "bucket": bucket, "sign": b""}, {"a": lengths, "b": words, "c": W.pack(total[told]), "d": W.pack(code[told])}

    return run


_WORDS = "code int, lang string, word string, f long"


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            parts = [w.split(b"\t") for w in W.unpack_strings(row["a"], row["b"])]
            lang = [bytes.fromhex(p[0][1:].decode()).decode() for p in parts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(W.unpack(row["d"], np.int32)), pa.array(lang, pa.string()), pa.array([p[1].decode() for p in parts], pa.string()), pa.array(W.unpack(row["c"], np.int64))],
                ["code", "lang", "word", "f"],
            )


def _coded(chunk: W.Chunk, told: list[dict]) -> pa.Table:
    """A chunk's texts as one row of codes, and how many words each language has in it."""
    codes = np.concatenate([np.zeros(0, np.int32), *(W.unpack(r["a"], np.int32) for r in told)])[chunk.places]
    marks = np.flatnonzero(codes < BREAK)
    words = np.r_[0, np.cumsum(codes > BREAK)]
    n = np.diff(np.r_[words[marks], words[-1]])
    langs, place = np.unique(codes[marks], return_inverse=True)
    sums = np.zeros(len(langs), np.int64)
    np.add.at(sums, place, n)
    rows = [C.binary([W.pack(np.maximum(codes, 0))]), pa.array([langs.tolist()], pa.list_(pa.int32())), pa.array([sums.tolist()], pa.list_(pa.int64()))]
    return pa.table(rows, ["codes", "langs", "sums"])


@dataclass(frozen=True)
class Bitmap:
    """Hashes of frequent phrases of one length, as a set of places: eight to a byte."""

    bits: np.ndarray

    @staticmethod
    def of(places: np.ndarray) -> Bitmap:
        return Bitmap(np.packbits(places, bitorder="little"))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes & np.uint64(8 * len(self.bits) - 1)
        return (self.bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _next(hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return C.mixed((hashes ^ codes) * np.uint64(0x9FB21C651E98DF25))


def _hashes(words: list[np.ndarray]) -> np.ndarray:
    """Hashes of phrases, the same as ``_chain`` gives them."""
    hashes = np.zeros(len(words[0]), np.uint64)
    for w in words:
        hashes = _next(hashes, w.astype(np.uint64))
    return hashes


def _chain(codes: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``many`` codes from each position on, and whether all are frequent words."""
    size = max(0, len(codes) - many + 1)
    wide = codes.astype(np.uint64)
    hashes, fine = np.zeros(size, np.uint64), np.ones(size, bool)
    for j in range(many):
        hashes = _next(hashes, wide[j : j + size])
        fine &= codes[j : j + size] > 0
    return hashes, fine


def _safe(codes: np.ndarray, many: int, shorter: Bitmap | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions where both phrases that are a word shorter are frequent, and the hashes of the phrases there."""
    hashes, fine = _chain(codes, many)
    if shorter is not None:
        parts, _ = _chain(codes, many - 1)
        known = shorter.has(parts)
        fine &= known[:-1] & known[1:]
    at = np.flatnonzero(fine)
    return at, hashes[at]


def _rows_of(batch: pa.RecordBatch, many: int) -> Iterator[np.ndarray]:
    """Codes of POSITIONS positions at a time, and of the ``many - 1`` behind them, where phrases that begin there end."""
    for row in batch.column(0):
        codes = W.unpack(row.as_py(), np.int32)
        for at in range(0, len(codes), POSITIONS):
            yield codes[at : at + POSITIONS + many - 1]


_VECTOR = "block int, part long, counts binary"


def _blocks(vector: np.ndarray, part: int) -> pa.RecordBatch:
    """A vector as packed rows of at most BLOCK numbers; rows of zeros are left out."""
    rows = [(b, part, W.pack(vector[at : at + BLOCK])) for b, at in enumerate(range(0, len(vector), BLOCK)) if vector[at : at + BLOCK].any()]
    columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
    kinds = (pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["block", "part", "counts"])


def _summed(vectors: DataFrame, size: int, most: int | None = None) -> np.ndarray:
    """The sum of the tasks' vectors (one of ``size`` numbers, each cut at ``most``), FAN_IN at a time."""
    kind = np.uint8 if most else np.int64

    def add(key, table):
        total = None
        for counts in table.column("counts").to_pylist():
            mine = W.unpack(counts, kind).astype(np.int64)
            total = mine if total is None else total + mine
        if most:
            total = np.minimum(total, most)
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int64()), pa.array([W.pack(total.astype(kind))], pa.binary())], ["block", "part", "counts"])

    vectors = cut(vectors, "vectors")
    while True:
        parts = vectors.agg(F.max("part")).first()[0]
        if not parts:
            break
        grouped = vectors.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("long"))
        old, vectors = vectors, cut(grouped.groupBy("block", "part").applyInArrow(add, _VECTOR), "vectors")
        release(old)
    out = np.zeros(size, kind)
    for row in vectors.collect():  # ``size`` numbers in all
        mine = W.unpack(row["counts"], kind)
        out[row["block"] * BLOCK : row["block"] * BLOCK + len(mine)] = mine
    release(vectors)
    return out


def _hash_counts(shared, many: int, bits: int, least: int):
    """Counts of the hashes of safe phrases by place, cut at ``least``."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shorter = shared.value
        total = np.zeros(1 << bits, np.uint8)
        for batch in batches:
            for codes in _rows_of(batch, many):
                _, hashes = _safe(codes, many, shorter)
                place, n = np.unique((hashes & np.uint64((1 << bits) - 1)).astype(np.uint32), return_counts=True)
                total[place] = np.minimum(total[place] + n, least)
        yield _blocks(total, TaskContext.get().partitionId())

    return run


_DEALT = "dealt long, phrases binary, counts binary"


@dataclass
class Counts:
    """Different phrases, a column of codes for each word, their hashes, and how often they occur."""

    hashes: np.ndarray
    words: list[np.ndarray]
    n: np.ndarray

    @staticmethod
    def of(hashes: np.ndarray, words: list[np.ndarray], n: np.ndarray) -> Counts:
        """Sums of equal phrases, told apart by 128 bits."""
        place, first = C.distinct(hashes, _check(words))
        total = np.zeros(len(first), np.int64)
        np.add.at(total, place, n)
        return Counts(hashes[first], [w[first] for w in words], total)

    @staticmethod
    def joined(parts: list[Counts]) -> Counts:
        words = [np.concatenate(w) for w in zip(*(p.words for p in parts), strict=True)]
        return Counts.of(np.concatenate([p.hashes for p in parts]), words, np.concatenate([p.n for p in parts]))

    def dealt(self, groups: int) -> pa.RecordBatch:
        """Packed rows, one for each group of hashes."""
        group = (self.hashes >> np.uint64(32)) % np.uint64(groups)
        order = np.argsort(group, kind="stable")
        rows = []
        for at, size in zip(*C.runs(group[order]), strict=True):
            mine = order[at : at + size]
            rows.append((int(group[mine[0]]), W.pack(np.concatenate([w[mine] for w in self.words]).astype(np.int32)), W.pack(self.n[mine])))
        columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        kinds = (pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["dealt", "phrases", "counts"])


def _check(words: list[np.ndarray]) -> np.ndarray:
    """A second hash of phrases."""
    out = np.full(len(words[0]), 0x5851F42D4C957F2D, np.uint64)
    for w in words:
        out = C.mixed((out + w.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
    return out


def _candidates(shared, many: int, groups: int, held: int):
    """Counts of the different safe phrases of a task's texts whose hash is frequent, dealt to groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shorter, often = shared.value
        parts: list[Counts] = []
        for batch in batches:
            for codes in _rows_of(batch, many):
                at, hashes = _safe(codes, many, shorter)
                fine = often.has(hashes)
                at, hashes = at[fine], hashes[fine]
                parts.append(Counts.of(hashes, [codes[at + j] for j in range(many)], np.ones(len(at), np.int64)))
                if sum(len(p.n) for p in parts) > held:
                    parts = [Counts.joined(parts)]
                    if 2 * len(parts[0].n) > held:
                        yield parts.pop().dealt(groups)
        if parts:
            yield Counts.joined(parts).dealt(groups)

    return C.tidy(run)


def _pair(codes: np.ndarray) -> np.ndarray:
    """Numbers above 0 of the two codes from each position on, by which shards are dealt."""
    return (_chain(codes, 2)[0] >> np.uint64(1)).astype(np.int64)


class DoubleArray:
    """Tries of phrases of equal length in two arrays: the child of state s by symbol c is base[s] + c, if check says s.

    A word is two symbols, its code divided by ``radix`` and the rest, so that states need little room between them.
    """

    def __init__(self, phrases: np.ndarray, radix: int):
        """``phrases``: different rows of codes, sorted; accepting states are numbered like rows; the root is state 0."""
        n, many = phrases.shape
        self.radix, self.roots = radix, np.zeros(1, np.int64)
        self.base, self.check = np.zeros(1, np.int64), np.full(1, -1, np.int64)
        self._room(2 * radix + 2 * n)
        self.check[0] = 0  # no child is placed there
        state = np.zeros(n, np.int64)  # of each row's prefix
        new = np.zeros(n, bool)
        new[:1] = True
        for j in range(2 * many):
            symbol = (phrases[:, j // 2] % radix if j % 2 else phrases[:, j // 2] // radix).astype(np.int64)
            new = new.copy()
            new[1:] |= symbol[1:] != symbol[:-1]
            edges = np.flatnonzero(new)
            state = self._place(state[edges], symbol[edges])[np.cumsum(new) - 1]
        self.accept = np.full(len(self.base), -1, np.int64)
        self.accept[state] = np.arange(n)

    def packed(self) -> list[bytes]:
        size = 1 + int(np.flatnonzero(self.check >= 0)[-1])
        return [W.pack(x[:size].astype(np.int32)) for x in (self.base, self.check, self.accept)]

    @staticmethod
    def joined(tries: list[list[bytes]], radix: int) -> DoubleArray:
        """Packed tries one behind the other; a trie's accepting states are numbered on from the one before."""
        out = DoubleArray.__new__(DoubleArray)
        at, number, parts, roots = 0, 0, [], []
        for base, check, accept in ([W.unpack(x, np.int32) for x in trie] for trie in tries):
            roots.append(at)
            last = check >= 0
            last[0] = False
            accepts = accept >= 0
            parts.append((base + at, np.where(last, check + at, -1), np.where(accepts, accept + number, -1)))
            at, number = at + len(base), number + int(accepts.sum())
        out.radix, out.roots = radix, np.array(roots)
        out.base, out.check, out.accept = (np.concatenate(x).astype(np.int32) for x in zip(*parts, strict=True))
        return out

    def _room(self, size: int) -> None:
        more = size - len(self.base)
        if more > 0:
            self.base = np.r_[self.base, np.zeros(more, np.int64)]
            self.check = np.r_[self.check, np.full(more, -1, np.int64)]

    def _place(self, parent: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Child states of edges (parent, symbol), sorted; nodes with many children find their places first."""
        starts, sizes = C.runs(parent)
        child = np.empty(len(parent), np.int64)
        many = np.flatnonzero(sizes > 1)
        low = 1
        for i in many[np.argsort(-sizes[many], kind="stable")].tolist():
            span = slice(starts[i], starts[i] + sizes[i])
            steps = symbol[span] - symbol[starts[i]]
            at, width = low, 64
            while True:
                if at + 8 * width + int(steps[-1]) >= len(self.check):
                    self._room(2 * len(self.check) + 8 * width + int(steps[-1]))
                free = at + np.flatnonzero(self.check[at : at + 8 * width] < 0)[:width]
                fits = np.flatnonzero((self.check[free[:, None] + steps] < 0).all(1))
                if len(fits):
                    break
                at = int(free[-1]) + 1 if len(free) == width else at + 8 * width
            place = free[fits[0]] + steps
            self.check[place] = parent[starts[i]]
            self.base[parent[starts[i]]] = place[0] - symbol[starts[i]]
            child[span] = place
            if sizes[i] < 4:  # small families leave few gaps behind
                low = max(low, at)
        one = np.flatnonzero(sizes == 1)
        free = np.flatnonzero(self.check < 0)
        if len(free) < len(one):
            self._room(len(self.check) + len(one))
            free = np.flatnonzero(self.check < 0)
        place, edge = free[: len(one)], starts[one]
        self.check[place] = parent[edge]
        self.base[parent[edge]] = place - symbol[edge]
        child[edge] = place
        return child

    def accepted(self, codes: np.ndarray, many: int, root: np.ndarray | None = None) -> np.ndarray:
        """Rows of the phrases that begin at the positions of a text; all positions move on together.

        ``root``: number of the trie of each position, below 0 if it has none here.
        """
        return self.accept[self.ends(codes, many, root)[1]]

    def ends(self, codes: np.ndarray, many: int, root: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Positions where phrases begin, and the accepting states that these lead to."""
        begins = codes[: max(0, len(codes) - many + 1)] > 0
        at = np.flatnonzero(begins if root is None else begins & (root[: len(begins)] >= 0))
        state = self.roots[np.zeros(len(at), np.int64) if root is None else root[at]]
        for j in range(2 * many):
            code = codes[at + j // 2]
            to = self.base[state] + (code % self.radix if j % 2 else code // self.radix)
            inside = (code > 0) & (to > 0) & (to < len(self.check))
            good = inside & (self.check[np.where(inside, to, 0)] == state)
            at, state = at[good], to[good]
        return at, state


def _tries(phrases: np.ndarray, radix: int, shard: int) -> tuple[DoubleArray, np.ndarray, np.ndarray]:
    """Tries of different phrases, the order of these among the accepting states, and the number of each shard's trie."""
    shards = max(1, -(-len(phrases) // shard))
    mine = _pair(phrases[:, :2].ravel())[::2] % shards
    order = np.lexsort((*phrases.T[::-1], mine))
    starts, sizes = C.runs(mine[order])
    packed = [DoubleArray(phrases[order[at : at + size]], radix).packed() for at, size in zip(starts.tolist(), sizes.tolist(), strict=True)]
    roots = np.full(shards, -1, np.int64)
    roots[mine[order[starts]]] = np.arange(len(starts))
    return DoubleArray.joined(packed, radix), order, roots


def _enough(many: int, radix: int, least: int, shard: int):
    """The phrases of a group that occur often enough, by bincounts of accepting states."""

    def run(key, table):
        counts = [W.unpack(x, np.int64) for x in table.column("counts").to_pylist()]
        parts = [W.unpack(x, np.int32).reshape(many, -1) for x in table.column("phrases").to_pylist()]
        n, words = np.concatenate(counts), list(np.concatenate(parts, 1))
        hashes = _hashes(words)
        place, first = C.distinct(hashes, hashes)  # by one hash, which may join phrases but loses none
        sums = np.zeros(len(first), np.int64)
        np.add.at(sums, place, n)
        live = sums[place] >= least
        n, words, hashes = n[live], [w[live] for w in words], hashes[live]
        ids, f = np.zeros((0, many), np.int32), np.zeros(0, np.int64)
        if len(n):
            phrases = np.stack(Counts.of(hashes, words, n).words, 1)
            trie, order, roots = _tries(phrases, radix, shard)
            ids, f = phrases[order], np.zeros(len(phrases), np.int64)
            for low in range(0, len(n), POSITIONS):
                codes = np.stack([w[low : low + POSITIONS] for w in words], 1).ravel()
                root = np.full(len(codes), -1, np.int64)
                root[::many] = roots[_pair(codes)[::many] % len(roots)]
                at, state = trie.ends(codes, many, root)
                np.add.at(f, trie.accept[state], n[low + at // many])
            ids, f = ids[f >= least], f[f >= least]
        C.give_back()
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * many, pa.int32()), pa.array(ids.ravel()))
        return pa.table([flat, pa.array(f)], ["ids", "f"])

    return run


def _places(many: int, bits: int):
    """The places of the hashes of phrases."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint8)
        for batch in batches:
            hashes = _hashes(list(np.asarray(batch.column(0).flatten()).reshape(-1, many).T))
            total[(hashes & np.uint64((1 << bits) - 1)).astype(np.int64)] = 1
        yield _blocks(total, TaskContext.get().partitionId())

    return run


def frequent(
    texts: DataFrame, many: int, radix: int, shorter: Bitmap | None, groups: int, least: int = LEAST, bits: int = BITS, shard: int = SHARD
) -> tuple[DataFrame, Bitmap]:
    """Phrases of ``many`` words that occur ``least`` times or more (ids, f), and the bitmap of their hashes."""
    spark = texts.sparkSession
    known = spark.sparkContext.broadcast(shorter)
    often = Bitmap.of(_summed(texts.mapInArrow(_hash_counts(known, many, bits, least), _VECTOR), 1 << bits, least) >= least)
    known = spark.sparkContext.broadcast((shorter, often))
    dealt = texts.mapInArrow(_candidates(known, many, groups, HELD), _DEALT)
    kept = cut(dealt.groupBy("dealt").applyInArrow(_enough(many, radix, least, shard), "ids array<int>, f long"), "frequent")
    return kept, Bitmap.of(_summed(kept.select("ids").mapInArrow(_places(many, bits), _VECTOR), 1 << bits, 1) > 0)


def _slices(shortest: int, whole: bool) -> str:
    """SQL: all contiguous parts of the array ``ids`` from ``shortest`` elements on."""
    end = "size(ids)" if whole else "size(ids) - 1"
    return f"flatten(transform(filter(sequence(1, {LONGEST}), k -> k >= {shortest} AND k <= {end}), k -> transform(sequence(1, size(ids) - k + 1), i -> slice(ids, i, k))))"


def scored(grams: DataFrame, words: DataFrame) -> DataFrame:
    """Phrases (ids, f) of two words or more that no longer one covers, with their lowest-scoring cut: ids, a, l, r, score."""
    known = words.select(F.array("code").alias("ids"), "f").unionByName(grams)
    phrases = grams.withColumnRenamed("f", "a")
    cuts = phrases.select("ids", "a", F.explode(F.expr("sequence(1, size(ids) - 1)")).alias("k"))
    cuts = cuts.withColumns({"first": F.expr("slice(ids, 1, k)"), "rest": F.expr("slice(ids, k + 1, size(ids) - k)")})
    cuts = cuts.join(known.select(F.col("ids").alias("first"), F.col("f").alias("l")), "first")
    cuts = cuts.join(known.select(F.col("ids").alias("rest"), F.col("f").alias("r")), "rest")
    # Decimals: the product passes 64 bits for long counts.
    score = F.expr(f"(cast({SCALE} as decimal(10, 0)) * cast(a as decimal(20, 0))) div cast(l + r as decimal(20, 0))")
    best = cuts.groupBy("ids").agg(F.min(F.struct(score.alias("score"), "k", "l", "r", "a")).alias("c")).select("ids", "c.*")
    inside = grams.where("size(ids) > 2").select(F.explode(F.expr(_slices(2, whole=False))).alias("ids"), F.col("f").alias("longer"))
    inside = inside.groupBy("ids").agg(F.max("longer").alias("longer"))
    left = best.join(inside, "ids", "left").where(f"longer IS NULL OR 100 * longer < {COVER} * a")
    return left.select("ids", "a", "l", "r", "score")


def mine(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, bits: int = BITS, shard: int = SHARD, most: int = MOST
) -> DataFrame:
    """The ``top`` best phrases of each language: lang, rank (int, from 1), phrase, a, l, r, n, score (long).

    A-Z are lower-cased; texts are cut at ``.,;:!?`` and line ends into pieces, these at blanks and tabs into words; null
    texts are empty, a null language is ``und``. ``n`` counts all words of a language; phrases are 2 to 4 words of one
    piece that occur ``a`` times, ``least`` or more, overlaps included. A cut into two parts that occur l and r times
    scores ``2000000 a div (l + r)``; the lowest-scoring cut counts, of equal ones the first. Phrases inside a longer one
    that occurs 80 % as often or more are left out. The best come first; equal scores by a, then by the phrase in the
    order of its UTF-8 bytes. Whole texts are counted, however long, repeated rows each; an empty table gives an empty
    result; other columns are not read.
    """
    buckets = C.tasks(docs)
    tongue = F.concat(F.lit("L"), F.hex(F.coalesce("lang", F.lit("und")).cast("binary")), F.lit("\n"))
    rows = C.only(docs, text=text_col, lang=lang_col).select(F.lit(0).alias("id"), F.concat(tongue, F.coalesce("text", F.lit(""))).alias("text"))
    with scratch() as tables:
        chunks = cut(W.split(rows, splitter, buckets), "chunks")
        told = cut(W.answer(chunks, _owner(buckets, least), buckets), "told")
        named = cut(told.where(F.col("chunk") == NUMBERED).select("a", "b", "c", "d").mapInArrow(_numbered, _WORDS), "words")
        coded = cut(W.finish(chunks, told.where(F.col("chunk") != NUMBERED), _coded, "codes binary, langs array<int>, sums array<long>"), "coded")
        release(chunks, told)
        words = named.where("code > 0")
        texts, shorter = coded.select("codes"), None
        radix = 1 + math.isqrt(words.agg(F.max("code")).first()[0] or 0)
        positions = coded.select(F.explode("sums").alias("n")).agg(F.sum("n")).first()[0] or 0
        groups = max(1, -(-positions // most))
        every = words.select(F.array("code").alias("ids"), "f").where("false")
        for many in range(2, LONGEST + 1):
            found, shorter = frequent(texts, many, radix, shorter, groups, least, bits, shard)
            every = every.unionByName(found)
        kept = cut(scored(every, words.select("code", "f")), "scored")
        spelled = (
            kept.select("ids", F.posexplode("ids").alias("place", "code"))
            .join(words.select("code", "word", "lang"), "code")
            .groupBy("ids").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("parts"), F.first("lang").alias("lang"))
            .select("ids", "lang", F.concat_ws(" ", F.col("parts.word")).alias("phrase"))
        )
        n = coded.select(F.explode(F.arrays_zip("langs", "sums")).alias("x")).groupBy(F.col("x.langs").alias("code")).agg(F.sum("x.sums").alias("n"))
        n = n.join(named.where("code < 0").select("code", "lang"), "code").select("lang", "n")
        whole = kept.join(spelled, "ids").select("lang", "phrase", "a", "l", "r", "score")
        result = cut(_first(whole, top, buckets).join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "phrases")
        tables.keep(result)
    return result


def _first(phrases: DataFrame, top: int, parts: int) -> DataFrame:
    """The ``top`` first of each language with their rank: of each part of its phrases, then of what these give."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.expr(f"pmod(xxhash64(phrase), {parts})")
    place = F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))
    some = phrases.withColumn("rank", place).where(F.col("rank") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return some.withColumn("rank", rank).where(F.col("rank") <= top)

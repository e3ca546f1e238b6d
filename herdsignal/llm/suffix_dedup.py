"""Removal of repeated byte strings by suffix sorting with a difference cover.

Strings of ``length`` bytes that are equal can be told to the same task without moving the text: each has an *anchor*,
the k-gram in it with the smallest hash (winnowing), at the same place in equal strings. So

1. every task sends each of its anchors once; owners of buckets of hashes tell which ones occur in two documents;
2. for these only, the *contexts* go to the owners: the bytes of the strings that have the anchor;
3. an owner sorts the suffixes of its contexts: triples at two of three places (the difference cover modulo 3) are
   sorted and named, names are sorted by recursion, the other places are merged in. The recursion ends when names stand
   for ``length`` bytes. Neighbours are compared byte by byte over their first ``length`` bytes; the smallest document
   of each run of equal prefixes keeps its string, the others learn which bytes to remove.

Within a task, documents that repeat a context of a smaller document are settled at once, so however many copies of a
passage there are, each task sends it for one document only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from herdsignal.llm import common as C, words as W
from herdsignal.session import cut, release, scratch

LENGTH = 50
#: Bits of an anchor's hash that are compared first; the rest of the number holds its place in the step.
_PLACE = np.uint64((1 << 31) - 1)
#: Letters that are sorted at a time.
SORT_BYTES = 1 << 20
#: Bytes of text whose anchors are found at a time.
ANCHOR_BYTES = 1 << 19


def gram_size(length: int) -> int:
    """Bytes of an anchor; a longer one is shared by fewer documents, a shorter one leaves fewer anchors."""
    return max(1, length // 2 - 3)


@cache
def _codes() -> np.ndarray:
    return C.mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchors of all strings of ``length`` bytes within rows: hash, row, place, first and last start of its strings.

    Rows are looked at about ``ANCHOR_BYTES`` (one row at least) at a time: each byte takes some twenty words of memory.
    """
    parts, row = [], 0
    while row < len(offsets) - 1:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + ANCHOR_BYTES, side="right")) - 1)
        begin = offsets[row]
        found, rows, *places = _anchors(data[begin : offsets[to]], offsets[row : to + 1] - begin, length)
        parts.append((found, rows + row, *(x + begin for x in places)))
        row = to
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else _anchors(data, offsets, length)


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    k = gram_size(length)
    window = length - k + 1
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return np.zeros(0, np.uint64), none, none, none, none
    up, down = C.powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_codes()[data] * up[:-1], out=sums[1:])
    n = len(data) - k + 1
    hashes = sums[k:] - sums[:n]
    hashes *= down[:n]
    hashes = C.mixed(hashes)
    low = hashes & ~_PLACE
    low |= np.arange(n, dtype=np.uint64)
    reach = 1
    while reach < window:
        step = min(reach, window - reach)
        low = np.minimum(low[: len(low) - step], low[step:])
        reach += step
    valid = np.zeros(len(low), bool)  # starts whose string is within its row
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= length:
            valid[a : b - length + 1] = True
    start = np.flatnonzero(valid)
    place = (low[start] & _PLACE).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.r_[first[1:] - 1, len(start) - 1][: len(first)]
    place = place[first]
    return hashes[place], np.searchsorted(offsets, place, side="right") - 1, place, start[first], start[last]


_LOW48 = np.uint64((1 << 48) - 1)
_POSTED = "bucket int, low binary, high binary, labels binary, counts binary, label long, found binary, id long, n_bytes long, sha string"


def _empty_columns(names: str) -> dict[str, list]:
    return {part.split()[0]: [] for part in names.split(", ")}


def _batch(columns: dict[str, list], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    typed = [part.split() for part in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[name], kinds[kind]) for name, kind in typed], [name for name, _ in typed])


def _put(columns: dict[str, list], **values) -> None:
    for name, column in columns.items():
        column.append(values.get(name))


def _post(buckets: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.steps(batches, "text"):
            data, offsets = C.raw(batch.column(1))
            out = _empty_columns(_POSTED)
            view = memoryview(data)
            shas = [hashlib.sha256(view[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            labels = np.array([int.from_bytes(s.digest()[:8], "little", signed=True) for s in shas], np.int64)
            for i, sha in enumerate(shas):
                _put(out, bucket=-1, id=batch.column(0)[i].as_py(), label=int(labels[i]), n_bytes=int(offsets[i + 1] - offsets[i]), sha=sha.hexdigest())
            found, row, *_ = anchors(data, offsets, length)
            key, who = found & _LOW48, labels[row]
            order = np.argsort(key, kind="stable")
            key, who = key[order], who[order]
            starts, sizes = C.runs(key)
            if len(starts):
                several = np.minimum.reduceat(who, starts) != np.maximum.reduceat(who, starts)
                # What two texts of this step have in common is settled; one of them stands for it elsewhere.
                shared = np.repeat(several, sizes)
                _tell(out, who[shared], key[shared], buckets)
                key, who = key[starts], who[starts]
                bucket = (key % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((who, bucket))
                key, who, bucket = key[order], who[order], bucket[order]
                for at, size in zip(*C.runs(bucket), strict=True):
                    mine = who[at : at + size]
                    first, counts = C.runs(mine)
                    keys = key[at : at + size]
                    _put(
                        out, bucket=int(bucket[at]), low=keys.astype(np.uint32).tobytes(), high=(keys >> np.uint64(32)).astype(np.uint16).tobytes(),
                        labels=mine[first].tobytes(), counts=counts.astype(np.uint32).tobytes(),
                    )
            yield _batch(out, _POSTED)

    return run


def _tell(out: dict[str, list], who: np.ndarray, key: np.ndarray, buckets: int) -> None:
    """The anchors that other texts have too, a row for each home bucket of texts: labels, counts, and found."""
    order = np.lexsort((who, who % buckets))
    who, key = who[order], key[order]
    home = who % buckets
    for at, size in zip(*C.runs(home), strict=True):
        first, counts = C.runs(who[at : at + size])
        _put(out, bucket=int(home[at]), labels=who[at : at + size][first].tobytes(), counts=counts.astype(np.uint32).tobytes(), found=key[at : at + size].tobytes())


_FOUND = "bucket int, labels binary, counts binary, found binary"


def _shared(buckets: int):
    """The anchors of a bucket that two texts have, told to the texts' home buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, labels = [], []
        for batch in batches:
            out = _empty_columns(_FOUND)
            for row in batch.to_pylist():
                if row["found"] is not None:
                    _put(out, **{name: row[name] for name in out})
                    continue
                low, high = np.frombuffer(row["low"], np.uint32), np.frombuffer(row["high"], np.uint16)
                keys.append(low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32))
                labels.append(np.repeat(np.frombuffer(row["labels"], np.int64), np.frombuffer(row["counts"], np.uint32)))
            yield _batch(out, _FOUND)
        if keys:
            key, who = np.concatenate(keys), np.concatenate(labels)
            order = np.argsort(key)
            key, who = key[order], who[order]
            starts, sizes = C.runs(key)
            shared = np.repeat(np.minimum.reduceat(who, starts) != np.maximum.reduceat(who, starts), sizes)
            out = _empty_columns(_FOUND)
            _tell(out, who[shared], key[shared], buckets)
            yield _batch(out, _FOUND)

    return run


def _by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, found): all shared anchors of each text of a home bucket."""
    keys, labels = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for batch in batches:
        for row in batch.to_pylist():
            keys.append(np.frombuffer(row["found"], np.uint64))
            labels.append(np.repeat(np.frombuffer(row["labels"], np.int64), np.frombuffer(row["counts"], np.uint32)))
    key, who = np.concatenate(keys), np.concatenate(labels)
    order = np.argsort(who, kind="stable")
    key, who = key[order], who[order]
    rows = [(int(who[a]), key[a : a + n].tobytes()) for a, n in zip(*C.runs(who), strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["label", "found"])


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text): texts compressed, to be joined twice."""
    for batch in C.steps(batches, "text"):
        data, offsets = C.raw(batch.column(1))
        packed = [W.pack(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), C.binary(packed)], ["id", "text"])


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of (id, text, found) with their texts restored, about ``STEP_BYTES`` (one text at least) at a time."""
    for batch in batches:
        held, texts = 0, []
        for i, packed in enumerate(batch.column(1)):
            text = W.unpack(packed.as_py(), np.uint8).tobytes()
            if texts and held + len(text) > C.STEP_BYTES:
                yield _restored(batch, i, texts)
                held, texts = 0, []
            held += len(text)
            texts.append(text)
        if texts:
            yield _restored(batch, batch.num_rows, texts)


def _restored(batch: pa.RecordBatch, end: int, texts: list[bytes]) -> pa.RecordBatch:
    part = batch.slice(end - len(texts), len(texts))
    return pa.RecordBatch.from_arrays([part.column(0), C.binary(texts), part.column(2)], ["id", "text", "found"])


_CONTEXTS = "bucket int, keys binary, sizes binary, context binary, ids binary, at binary, id long, found binary"


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """data[start:start + size] of all spans one after the other."""
    ends = np.cumsum(size)
    return data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)]


def _contexts(buckets: int, length: int):
    """Contexts of shared anchors, each once per step with its smallest document; the others' bytes are settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _opened(batches):
            data, offsets = C.raw(batch.column(1))
            ids = np.asarray(batch.column(0), np.int64)
            out = _empty_columns(_CONTEXTS)
            found, row, place, first, last = anchors(data, offsets, length)
            key = found & _LOW48
            wanted = np.zeros(len(key), bool)
            for i, told in enumerate(batch.column(2).to_pylist()):
                a, b = np.searchsorted(row, [i, i + 1])
                wanted[a:b] = np.isin(key[a:b], np.frombuffer(told, np.uint64))
            key, row, first, last = key[wanted], row[wanted], first[wanted], last[wanted]
            if not len(key):
                continue
            size = last - first + length
            same = C.span_hashes(_codes()[data], first, first + size) ^ C.mixed((place[wanted] - first).astype(np.uint64)) ^ key
            who = ids[row]
            order = np.lexsort((who, same))
            key, row, first, size, same, who = key[order], row[order], first[order], size[order], same[order], who[order]
            starts, sizes = C.runs(same)
            least = np.repeat(who[starts], sizes)
            settled = who > least
            _ranges(out, who[settled], first[settled] - offsets[row[settled]], first[settled] - offsets[row[settled]] + size[settled], buckets)
            go = ~settled
            key, row, first, size, who = key[go], row[go], first[go], size[go], who[go]
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            key, row, first, size, who, bucket = key[order], row[order], first[order], size[order], who[order], bucket[order]
            for a, n in zip(*C.runs(bucket), strict=True):
                b = a + n
                _put(
                    out, bucket=int(bucket[a]), keys=W.pack(key[a:b]), sizes=W.pack(size[a:b].astype(np.uint32)), context=W.pack(_gather(data, first[a:b], size[a:b])),
                    ids=W.pack(who[a:b]), at=W.pack((first[a:b] - offsets[row[a:b]]).astype(np.uint32)),
                )
            yield _batch(out, _CONTEXTS)

    return run


def _ranges(out: dict[str, list], who: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: int) -> None:
    """Rows (id, found) with the bytes to remove as starts and ends, merged where they meet."""
    order = np.lexsort((start, who))
    who, start, end = who[order], start[order], end[order]
    for at, n in zip(*C.runs(who), strict=True):
        a, b = merged(start[at : at + n], end[at : at + n])
        _put(out, bucket=int(who[at]) % buckets, id=int(who[at]), found=np.stack([a, b]).astype(np.uint32).tobytes())


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans in order of starts, those that overlap or touch made one."""
    far = np.maximum.accumulate(end)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > far[:-1]
    first = np.flatnonzero(new)
    return start[first], far[np.r_[first[1:] - 1, len(start) - 1][: len(first)]]


def _names(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of keys and their dense ranks from 1."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    names = np.empty(len(keys), np.int64)
    names[order] = np.cumsum(new)
    return order, names


def _joined(high: np.ndarray, low: np.ndarray, top: int) -> np.ndarray:
    """One key of two letters; ``top`` is above the low ones. Large letters are named first."""
    if int(high.max(initial=0)) >= (1 << 63) // top:
        high = _names(high)[1]
    return high * top + low


def suffix_order(letters: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``letters`` (0 or more) in the order of their suffixes, which is exact over the first ``depth`` letters.

    Suffixes with equal ``depth`` letters stand next to each other in any order; beyond the end letters are -1.
    """
    n = len(letters)
    if n < 3 or depth <= 0:
        return np.lexsort([np.r_[letters[i:], np.full(i, -1)][:n] for i in (2, 1, 0)]) if n else np.zeros(0, np.int64)
    s = np.concatenate([letters.astype(np.int64) + 1, np.zeros(5, np.int64)])
    top = int(s.max()) + 1
    one, two, zero = np.arange(1, n + 1, 3), np.arange(2, n + 1, 3), np.arange(0, n, 3)
    sampled = np.r_[one, two]
    order, names = _names(_joined(_joined(s[sampled], s[sampled + 1], top), s[sampled + 2], top))
    if depth > 3 and names[order[-1]] < len(names):
        # Names at places 1, 4, ... and then 2, 5, ...: a suffix of this string stands for one of the letters.
        order = suffix_order(np.r_[names[: len(one)], 0, names[len(one) :]], -(-depth // 3))
        order = order[order != len(one)]
        order = np.where(order > len(one), order - 1, order)
    rank = np.zeros(n + 8, np.int64)
    rank[sampled[order]] = np.arange(1, len(order) + 1)
    sampled = sampled[order]
    keep = sampled < n
    sampled = sampled[keep]
    wide = n + 9
    by_one = lambda i: _pair(s, rank, i, 1, top, wide)
    by_two = lambda i: _pair(s, rank, i, 2, top, wide)
    zero = zero[np.argsort(by_one(zero))]
    ones, twos = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before = np.searchsorted(by_one(ones), by_one(zero)) + np.searchsorted(by_two(twos), by_two(zero))
    before = np.maximum.accumulate(before)
    return np.insert(sampled, before, zero)


def _pair(s: np.ndarray, rank: np.ndarray, at: np.ndarray, by: int, top: int, wide: int) -> np.ndarray:
    """The ``by`` letters at places and the rank of what follows, as one comparable key."""
    if by == 1:
        return s[at] * wide + rank[at + 1]
    if top * top < (1 << 63) // wide:
        return (s[at] * top + s[at + 1]) * wide + rank[at + 2]
    pairs = np.unique(s[:-1] * top + s[1:])  # letters are at most as many as places, so a pair fits
    return np.searchsorted(pairs, s[at] * top + s[at + 1]) * wide + rank[at + 2]


def smallest_owner(text: np.ndarray, starts: np.ndarray, ids: np.ndarray, letters: np.ndarray, length: int) -> np.ndarray:
    """For each start (in bytes ``text``, of document ids): the smallest id among equal strings of ``length`` bytes."""
    wanted = np.full(len(letters), -1, np.int64)
    wanted[starts] = np.arange(len(starts))
    order = wanted[suffix_order(letters, length)]
    order = order[order >= 0]
    at = starts[order]
    padded = np.r_[text, np.zeros(8, np.uint8)]
    eight = np.lib.stride_tricks.as_strided(padded, (len(text) + 1, 8), (1, 1))
    new = np.ones(len(at), bool)
    if len(at) > 1:
        equal = np.ones(len(at) - 1, bool)
        for j in [*range(0, length - 8, 8), max(0, length - 8)] if length >= 8 else []:
            word = np.ascontiguousarray(eight[at + j]).view(np.uint64).ravel()
            equal &= word[1:] == word[:-1]
        for j in range(length) if length < 8 else []:
            equal &= text[at[1:] + j] == text[at[:-1] + j]
        new[1:] = ~equal
    runs = np.flatnonzero(new)
    least = np.minimum.reduceat(ids[order], runs) if len(runs) else ids[:0]
    out = np.empty(len(starts), ids.dtype)
    out[order] = np.repeat(least, np.diff(np.r_[runs, len(at)]))
    return out


def _owner(length: int):
    """Sorts the suffixes of a bucket's contexts, some hashes at a time, and tells what to remove."""

    def settle(out, key, size, context, ids, at) -> None:
        # Each different context once, with the smallest id that has it.
        begin = np.cumsum(size) - size
        same = C.span_hashes(_codes()[context], begin, begin + size)
        _, first, which = np.unique(same, return_index=True, return_inverse=True)
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, which, ids)
        every, whose, place_of = size, ids, at
        context, size, ids = _gather(context, begin[first], size[first]), size[first], least
        # Letters: bytes from 1 on, 0 behind each context.
        end = np.cumsum(size + 1)
        begin = end - size - 1
        text = np.zeros(end[-1], np.uint8)
        letters = np.zeros(end[-1], np.int64)
        inside = np.ones(end[-1], bool)
        inside[end - 1] = False
        text[inside] = context
        letters[inside] = context.astype(np.int64) + 1
        many = size - length + 1
        first = np.cumsum(many) - many
        starts = np.arange(many.sum()) + np.repeat(begin - first, many)
        least = smallest_owner(text, starts, np.repeat(ids, many), letters, length)
        # Back to every document that has the context.
        own = every - length + 1
        offset = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        who = np.repeat(whose, own)
        gone = least[np.repeat(first[which], own) + offset] < who
        if gone.any():
            place = (np.repeat(place_of, own) + offset)[gone]
            _ranges(out, who[gone], place, place + length, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = "id long, found binary"
        parts: list[list[np.ndarray]] = [[], [], [], [], []]
        for batch in batches:
            out = _empty_columns(schema)
            for row in batch.to_pylist():
                if row["found"] is not None:
                    _put(out, id=row["id"], found=row["found"])
                    continue
                for part, (name, kind) in zip(parts, (("keys", np.uint64), ("sizes", np.uint32), ("context", np.uint8), ("ids", np.int64), ("at", np.uint32)), strict=True):
                    part.append(W.unpack(row[name], kind))
            yield _batch(out, schema)
        if not parts[0]:
            return
        key, size, context, ids, at = (np.concatenate(p) for p in parts)
        size, at = size.astype(np.int64), at.astype(np.int64)
        begin = np.cumsum(size) - size
        order = np.argsort(key, kind="stable")
        key, size, ids, at, begin = key[order], size[order], ids[order], at[order], begin[order]
        starts, _ = C.runs(key)
        # Equal strings have equal anchors, so whole runs of a hash are sorted together, as many as fit.
        sums = np.cumsum(size)
        a = 0
        bounds = np.r_[starts[1:], len(key)]
        while a < len(key):
            base = sums[a - 1] if a else 0
            fit = bounds[(bounds > a) & (sums[bounds - 1] - base <= SORT_BYTES)]
            b = int(fit[-1]) if len(fit) else int(bounds[bounds > a][0])
            out = _empty_columns(schema)
            settle(out, key[a:b], size[a:b], _gather(context, begin[a:b], size[a:b]), ids[a:b], at[a:b])
            yield _batch(out, schema)
            a = b

    return run


_LOST = "id long, n_removed long, n_spans long, kept binary, text string, spans binary"


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _opened(batches):
        data, offsets = C.raw(batch.column(1))
        out: list[list] = [[], [], [], []]
        for i, found in enumerate(batch.column(2).to_pylist()):
            spans = np.concatenate([np.frombuffer(f, np.uint32).reshape(2, -1) for f in found], axis=1).astype(np.int64)
            order = np.argsort(spans[0], kind="stable")
            start, end = merged(spans[0][order], spans[1][order])
            text = data[offsets[i] : offsets[i + 1]]
            mark = np.zeros(len(text) + 1, np.int32)
            mark[start] += 1
            mark[end] -= 1
            keep = np.cumsum(mark)[: len(text)] == 0
            out[0].append(int((end - start).sum()))
            out[1].append(len(start))
            out[2].append(text[keep].tobytes())
            out[3].append(np.stack([start, end]).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array([x.decode("utf-8", "ignore") for x in out[2]], pa.string()), pa.array(out[3], pa.binary())],
            ["id", "n_removed", "n_spans", "kept", "text", "spans"],
        )


def removals(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, n_bytes, sha, rep) of all rows, (id, text, found) of texts with anchors that others share, and (id, found) of
    those that lose some of their bytes, a row for each id.

    ``rep`` is the smallest id with the same text; rows with another rep lose everything, if they have ``length``
    bytes, and are not among the last. ``found`` lists spans of bytes.
    """
    with scratch() as tables:
        buckets = C.tasks(docs)
        texts = C.only(docs, id=id_col, text=text_col).withColumns({"id": F.col("id").cast("long"), "text": F.coalesce("text", F.lit(""))})
        posted = cut(texts.where("id IS NOT NULL").mapInArrow(C.tidy(_post(buckets, length)), _POSTED), "posted")
        home = posted.where("bucket = -1").select("id", "n_bytes", "sha", "label")
        reps = cut(home.groupBy("sha").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label")), "reps")
        rows = cut(C.hot_join(home, reps.select("sha", "rep", "n"), "sha", "n").select("id", "n_bytes", "sha", "rep"), "rows")
        found = posted.where("bucket >= 0").repartition(buckets, "bucket").mapInArrow(C.tidy(_shared(buckets)), _FOUND)
        asked = found.repartition(buckets, "bucket").mapInArrow(C.tidy(_by_text), "label long, found binary").join(reps.select("label", F.col("rep").alias("id")), "label").select("id", "found")
        packed = texts.where("id IS NOT NULL").mapInArrow(C.tidy(_squeezed), "id long, text binary")
        texts = cut(packed.join(asked, "id").select("id", "text", "found"), "asked")
        release(posted, reps)  # before the contexts need the room
        contexts = texts.mapInArrow(C.tidy(_contexts(buckets, length)), _CONTEXTS).repartition(buckets, "bucket")
        spans = contexts.mapInArrow(C.tidy(_owner(length)), "id long, found binary").groupBy("id").agg(F.collect_list("found").alias("found"))
        spans = cut(spans, "spans")
        tables.keep(rows, texts, spans)
    return rows, texts, spans


_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def suffix_dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256.

    Removed is each byte covered by a string of ``length`` bytes that also starts in a row with a smaller id; strings
    may overlap and are judged on the input, within one text each. ``n_spans`` counts maximal removed runs; the hash is
    of the bytes that stay. Null counts as empty; texts shorter than ``length`` stay. Repeated rows (same id and text)
    do not remove each other; an id must not stand for two texts. Rows without an id remove nothing, lose nothing and
    come back with their size and hash. Other columns are not read; an empty table gives an empty result.
    """
    rows, texts, spans = removals(docs, length, id_col, text_col)
    losing = texts.select("id", "text").dropDuplicates(["id"]).join(spans, "id")
    lost = losing.mapInArrow(C.tidy(_removed), _LOST).select("id", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha"))
    copy = (F.col("id") != F.col("rep")) & (F.col("n_bytes") >= length)
    told = rows.join(lost, "id", "left").select(
        "id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(_EMPTY_SHA)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
    )
    nameless = C.only(docs, id=id_col, text=text_col).where("id IS NULL").select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).cast("binary").alias("t"))
    zero = F.lit(0).cast("long")
    nameless = nameless.select("id", F.length("t").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("t", 256).alias("kept_sha256"))
    return told.unionByName(nameless).withColumnRenamed("id", id_col)


def keep_rest(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the removed bytes cut out of the text; copies keep an empty text, and bytes that a cut leaves of a
    broken character are dropped. All other columns stay as they are."""
    rows, texts, spans = removals(docs, length, id_col, text_col)
    release(texts)  # the texts of ``docs`` are cut, so that only spans are shuffled beside them
    copies = rows.where((F.col("id") != F.col("rep")) & (F.col("n_bytes") >= length)).select("id").distinct()
    key, value, gone = C.unused(docs, "_changed"), C.unused(docs, "_spans"), C.unused(docs, "_copy")
    changed = spans.join(copies.withColumn("copy", F.lit(True)), "id", "full").toDF(key, value, gone)
    joined = docs.join(changed, docs[id_col] == F.col(key), "left").select(*docs.columns, value, gone)
    return joined.mapInArrow(C.tidy(_left(text_col, value, gone)), docs.schema)


def _left(text_col: str, value: str, gone: str):
    """The rows without their last two columns, the spans and whether the row is a copy; the text is what they leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.steps(batches, text_col):
            place = batch.schema.get_field_index(text_col)
            spans, copies = batch.column(batch.schema.get_field_index(value)), batch.column(batch.schema.get_field_index(gone))
            texts = batch.column(place)
            if spans.null_count < len(spans) or copies.null_count < len(copies):
                texts = pa.array([_rest_of(*row) for row in zip(texts.to_pylist(), spans.to_pylist(), copies.to_pylist(), strict=True)], texts.type)
            columns = [texts if i == place else column for i, column in enumerate(batch.columns[:-2])]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-2])

    return run


def _rest_of(text: str | None, found: list[bytes] | None, copy: bool | None) -> str | None:
    if copy:
        return ""
    if not found or not text:
        return text
    data = np.frombuffer(text.encode(), np.uint8)
    keep = np.ones(len(data), bool)
    for part in found:
        for start, end in np.frombuffer(part, np.uint32).reshape(2, -1).T.tolist():
            keep[start:end] = False
    return text if keep.all() else data[keep].tobytes().decode("utf-8", "ignore")

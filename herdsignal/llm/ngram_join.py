"""Jaccard join of documents on word n-grams by T-occurrence search.

A document that links with another lacks at most ``q(n) = n - ceil(0.8 n)`` of its n shingles there. The search
narrows in three steps, each of them exact:

1. Partial lists. Every document posts its ``p(n)`` smallest shingle hashes. Linked documents r and s share at least
   ``min(m(r), m(s))`` of what both have posted, ``m = p - q``; so documents with fewer posted shingles that anybody
   else has posted link with nothing. Most documents end here, and nothing but these postings is shuffled.
2. Leaders. Documents with equal sets are one from here on. Those with a common minimum hash are compared with the
   smallest one that has it. That joins nearly all groups of near copies by stars, without their pairs.
3. T-occurrence search over what is left. A document needs ``T = n - q`` shingles with other components. Those that
   have so many form families by their rarest shingles, and in a family the documents outside its largest component
   are queries. DivideSkip merges the short inverted lists of the queries' shingles, probes the long ones by binary
   search in the sorted sets, and pairs that reach the required overlap are linked.

Postings travel as packed arrays, one per task step and bucket of hashes. A shingle that several documents of a step have
is settled there and sent twice at most, so that one in a third of all documents is no hot key. In step 3 that holds for
shingles of several components; those that only one component has in a step are sent for each of its different sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from herdsignal.llm import common as C
from herdsignal.session import cut, scratch

#: Words per shingle and the least similarity in per cent.
SHINGLE, PERCENT = 5, 80
#: Minimum hashes per document that look for a leader.
LEADER_KEYS = 8
#: Lists with more documents than this are long: put aside and probed.
LONG = 64
#: Documents per block of a family.
BLOCK = 512
#: Bytes of text whose shingles a task holds at a time.
STEP = 2 << 20

_POSTINGS = "bucket int, ids binary, labels binary, counts binary, hashes binary, home binary, home_n binary, sig binary, home_hits binary"


def lacking(n: np.ndarray | int, percent: int = PERCENT):
    """How many of its n shingles a document may lack in a document that it links with."""
    return n - (percent * n + 99) // 100


def posted(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return np.minimum(n, lacking(n, percent) + 1 + n // 10)


def needed(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Posted shingles that must have been posted by others too: m of the smallest size that can link."""
    return 1 + (percent * n + 99) // 100 // 10


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text one after the other, and how many each text has."""
    data, offsets = C.raw(column)
    (word, _), row, _, _ = C.words(data, offsets)
    factors = C.mixed(np.arange(101, 101 + size, dtype=np.uint64)) | np.uint64(1)
    per_row = np.bincount(row, minlength=len(column))
    full = np.flatnonzero(row[size - 1 :] == row[: len(row) - size + 1]) if len(row) >= size else np.zeros(0, np.int64)
    hashes = np.zeros(len(full), np.uint64)
    for j in range(size):
        hashes += word[full + j] * factors[j]
    rows = row[full]
    first = np.cumsum(per_row) - per_row
    short = np.flatnonzero((per_row > 0) & (per_row < size))
    whole = np.zeros(len(short), np.uint64)
    for j in range(size - 1):
        has = per_row[short] > j
        whole[has] += word[first[short[has]] + j] * factors[j]
    whole += per_row[short].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    hashes, rows = C.mixed(np.r_[hashes, whole]), np.r_[rows, short]
    order = np.argsort(hashes)
    order = order[np.argsort(rows[order].astype(np.uint32), kind="stable")]
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[new], np.bincount(rows[new], minlength=len(column))


def _settled(hashes: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Postings that need not be sent: others of the step have the hash, and two of different labels stand for it."""
    order = np.lexsort((label, hashes))
    starts, sizes = C.runs(hashes[order])
    ends = starts + sizes - 1
    inner = np.repeat(label[order[starts]] != label[order[ends]], sizes) if len(starts) else np.zeros(0, bool)
    inner[starts] = False
    inner[ends] = False
    settled = np.zeros(len(hashes), bool)
    settled[order[inner]] = True
    return settled


def _packed(ids, labels, hashes, sizes, take, buckets: int, sig: np.ndarray) -> pa.RecordBatch:
    """The first ``take`` hashes of every document, dealt to buckets; ids of a bucket once with their counts.

    Size, signature and settled postings of every document go to the bucket of its id, its home.
    """
    first = np.cumsum(sizes) - sizes
    rank = np.arange(len(hashes)) - np.repeat(first, sizes)
    keep = rank < np.repeat(take, sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)[keep]
    hashes = hashes[keep]
    settled = _settled(hashes, (ids if labels is None else labels)[doc])
    home = (ids, sizes.astype(np.int64), sig, np.bincount(doc[settled], minlength=len(sizes)).astype(np.int64))
    doc, hashes = doc[~settled], hashes[~settled]
    bucket = ((hashes >> np.uint64(20)) % np.uint64(buckets)).astype(np.uint32)
    order = np.argsort(bucket, kind="stable")
    bucket, doc, hashes = bucket[order], doc[order], hashes[order]
    out = {name.split()[0]: [] for name in _POSTINGS.split(", ")}
    posting, at_home = list(out)[1:5], list(out)[5:]
    for at, size in zip(*C.runs(bucket), strict=True):
        mine = doc[at : at + size]
        starts, counts = C.runs(mine)
        who = mine[starts]
        out["bucket"].append(int(bucket[at]))
        out["ids"].append(ids[who].tobytes())
        out["labels"].append(None if labels is None else labels[who].tobytes())
        out["counts"].append(counts.astype(np.uint32).tobytes())
        out["hashes"].append(hashes[at : at + size].tobytes())
        for k in at_home:
            out[k].append(None)
    where = ids % buckets
    order = np.argsort(where, kind="stable")
    for at, size in zip(*C.runs(where[order]), strict=True):
        mine = order[at : at + size]
        out["bucket"].append(int(where[mine[0]]))
        for k in posting:
            out[k].append(None)
        for k, x in zip(at_home, home, strict=True):
            out[k].append(x[mine].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), *(pa.array(out[k], pa.binary()) for k in list(out)[1:])], list(out))


def _post_texts(buckets: int, size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.steps(batches, "text", STEP):
            ids = np.asarray(batch.column(0), np.int64)
            hashes, sizes = shingle_sets(batch.column(1), size)
            row = np.repeat(np.arange(len(sizes)), sizes)
            sig = np.zeros((len(sizes), 2), np.uint64)
            some = sizes > 0
            at = (np.cumsum(sizes) - sizes)[some]
            if len(row):
                sig[some, 0] = np.add.reduceat(hashes, at)
                sig[some, 1] = np.bitwise_xor.reduceat(C.mixed(hashes + np.uint64(7)), at)
            yield _packed(ids, None, hashes, sizes, posted(sizes, percent), buckets, sig)

    return run


def _post_sets(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.steps(batches, "hashes"):
            data, offsets = C.raw(batch.column(2))
            ids, labels = np.asarray(batch.column(0), np.int64), np.asarray(batch.column(1), np.int64)
            hashes = np.frombuffer(data.tobytes(), np.uint64)
            sizes = np.diff(offsets) // 8
            yield _packed(ids, labels, hashes, sizes, sizes, buckets, np.zeros((len(sizes), 2), np.uint64))

    return run


_HITS = "bucket int, ids binary, hits binary, home binary, home_n binary, sig binary, home_hits binary"


def _hits(buckets: int):
    """Per document the posted shingles that another label has posted, packed by home bucket; home rows pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [name.split()[0] for name in _HITS.split(", ")]
        ids, labels, hashes = [], [], []
        for batch in batches:
            home = batch.filter(pc.is_valid(batch.column(5)))
            if home.num_rows:
                none = pa.nulls(home.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([home.column(0), none, none, *(home.column(i) for i in (5, 6, 7, 8))], names)
            for row in batch.filter(pc.is_null(batch.column(5))).to_pylist():
                counts = np.frombuffer(row["counts"], np.uint32)
                ids.append(np.repeat(np.frombuffer(row["ids"], np.int64), counts))
                if row["labels"] is not None:
                    labels.append(np.repeat(np.frombuffer(row["labels"], np.int64), counts))
                hashes.append(np.frombuffer(row["hashes"], np.uint64))
        if not ids:
            return
        key = np.concatenate(hashes)
        hashes.clear()
        who = np.concatenate(ids)
        ids.clear()
        order = np.argsort(key)
        key, who = key[order], who[order]
        label = np.concatenate(labels)[order] if labels else who
        labels.clear()
        del order
        starts, sizes = C.runs(key)
        shared = np.repeat(np.minimum.reduceat(label, starts) != np.maximum.reduceat(label, starts), sizes)
        key, who = key[shared], who[shared]
        del label, shared
        order = np.lexsort((key, who))
        key, who = key[order], who[order]
        new = np.ones(len(who), bool)
        new[1:] = (who[1:] != who[:-1]) | (key[1:] != key[:-1])  # repeated rows of a document count once
        found, hits = np.unique(who[new], return_counts=True)
        home = found % buckets
        order = np.argsort(home, kind="stable")
        found, hits, home = found[order], hits[order], home[order]
        out = [(int(home[a]), found[a : a + n].tobytes(), hits[a : a + n].tobytes()) for a, n in zip(*C.runs(home), strict=True)]
        none = pa.nulls(len(out), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), *(C.binary([o[i] for o in out]) for i in (1, 2)), none, none, none, none], names)

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n, sig, hits): one row per document of a home bucket."""
    ids, hits, home, home_n, sigs, settled = [], [], [], [], [], []
    for batch in batches:
        for row in batch.to_pylist():
            if row["home"] is None:
                ids.append(np.frombuffer(row["ids"], np.int64))
                hits.append(np.frombuffer(row["hits"], np.int64))
            else:
                home.append(np.frombuffer(row["home"], np.int64))
                home_n.append(np.frombuffer(row["home_n"], np.int64))
                sigs.append(np.frombuffer(row["sig"], np.uint64).reshape(-1, 2))
                settled.append(np.frombuffer(row["home_hits"], np.int64))
    none = np.zeros(0, np.int64)
    who, at = np.unique(np.concatenate([none, *ids, *home]), return_inverse=True)
    counted = sum(len(x) for x in ids)
    total = np.zeros(len(who), np.int64)
    np.add.at(total, at, np.concatenate([none, *hits, *settled]))
    n = np.zeros(len(who), np.int64)
    sig = np.zeros((len(who), 2), np.uint64)
    n[at[counted:]] = np.concatenate([none, *home_n])
    sig[at[counted:]] = np.concatenate([np.zeros((0, 2), np.uint64), *sigs])
    names = [f"{c}:{a:x}:{b:x}" if c else None for (a, b), c in zip(sig.tolist(), n.tolist(), strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(n), pa.array(names, pa.string()), pa.array(total)], ["id", "n", "sig", "hits"])


def _count_hits(postings: DataFrame, buckets: int) -> DataFrame:
    found = postings.repartition(buckets, "bucket").mapInArrow(C.tidy(_hits(buckets)), _HITS)
    return found.repartition(buckets, "bucket").mapInArrow(C.tidy(_sums), "id long, n long, sig string, hits long")


def _set_rows(size: int, keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.steps(batches, "text", STEP):
            hashes, sizes = shingle_sets(batch.column(1), size)
            at = np.cumsum(sizes) - sizes
            some = sizes > 0
            low = np.zeros((len(sizes), keys), np.uint64)
            for j in range(keys):
                if some.any():
                    low[some, j] = np.minimum.reduceat(C.mixed(hashes ^ C.mixed(np.full(1, 1000 + j, np.uint64))), at[some])
            offsets = pa.array(np.arange(0, low.size + 1, keys, dtype=np.int32))
            data = hashes.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes.astype(np.int64)),
                    C.binary([data[8 * a : 8 * (a + n)] for a, n in zip(at.tolist(), sizes.tolist(), strict=True)]),
                    pa.ListArray.from_arrays(offsets, pa.array(low.view(np.int64).ravel())),
                ],
                ["id", "n", "hashes", "keys"],
            )

    return run


def overlap(a: bytes, b: bytes) -> int:
    """Size of the intersection of two sorted sets: the shorter is searched in the longer."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) if len(y) else 0


def _checked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in C.steps([whole], "set_a"):
                sets = zip(batch.column("set_a"), batch.column("set_b"), strict=True)
                linked = []
                for x, y in sets:
                    a, b = x.as_py(), y.as_py()
                    same = overlap(a, b)
                    linked.append(100 * same >= percent * ((len(a) + len(b)) // 8 - same))
                kept = batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))
                if kept.num_rows:
                    yield kept

    return run


def _with_set(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """The set of one side of each pair; a side in many pairs is dealt over several tasks."""
    sizes = cut(pairs.groupBy(column).agg(F.count("*").alias("size")), "sizes")
    total = sizes.agg(F.sum("size").alias("total"))
    sizes = sizes.crossJoin(F.broadcast(total)).select(column, "size", F.ceil(F.col("size") * C.HOT_KEYS / F.col("total")).cast("int").alias("salts"))
    salted = C.hot_join(pairs, sizes, column, "size").withColumn("salt", F.expr("pmod(xxhash64(a, b), salts)").cast("int")).drop("size", "salts")
    side = sets.select(F.col("id").alias(column), F.col("hashes").alias(f"set_{column}")).join(sizes.select(column, "salts"), column)
    side = side.select(column, f"set_{column}", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return salted.join(side, [column, "salt"]).drop("salt")


def links_of(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    pairs = cut(pairs.select("a", "b").distinct(), "pairs")
    if pairs.isEmpty():
        return pairs
    both = _with_set(pairs, sets, "b")
    joined = both.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("set_a")), "a")
    return cut(joined.select("a", "b", "set_a", "set_b").mapInArrow(C.tidy(_checked(percent)), "a long, b long"), "links")


def leader_pairs(sets: DataFrame) -> DataFrame:
    """(a, b): each document and the smallest one with an equal minimum hash."""
    keyed = cut(sets.select("id", F.posexplode("keys").alias("j", "low")).select("id", F.xxhash64("j", "low").alias("key")), "keys")
    leaders = cut(keyed.groupBy("key").agg(F.min("id").alias("b"), F.count("*").alias("n")).where("n > 1"), "leaders")
    return C.hot_join(keyed, leaders, "key", "n").select(F.col("id").alias("a"), "b").where("a <> b").distinct()


def _lists(sets: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of all sets in order, and the set of each: inverted lists one after the other."""
    sizes = [len(x) // 8 for x in sets]
    key = np.frombuffer(b"".join(sets), np.uint64)
    whose = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(key, kind="stable")
    return key[order], whose[order]


def overlaps(queries: list[bytes], others: list[bytes], long: int = LONG) -> np.ndarray:
    """Sizes of the intersections of all queries and others, by DivideSkip.

    Lists of at most ``long`` sets are merged: their sets, in order, give a count per pair. The long lists are put
    aside; each set is searched for their shingles by binary probes, and what both sides answer is added up.
    """
    key, whose = _lists(others)
    starts, sizes = C.runs(key)
    shingles = key[starts]
    count = np.zeros((len(queries), len(others)), np.float32)
    probes = shingles[sizes > long]
    sets = [np.frombuffer(q, np.uint64) for q in queries]
    heap, owner = [], []
    for i, mine in enumerate(sets):
        at = np.searchsorted(shingles, mine)
        at = at[at < len(shingles)][shingles[at[at < len(shingles)]] == mine[at < len(shingles)]] if len(shingles) else at[:0]
        at = at[sizes[at] <= long]
        spans = sizes[at]
        ends = np.cumsum(spans)
        heap.append(whose[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[at] - (ends - spans), spans)])
        owner.append(len(heap[-1]))
    merged = np.repeat(np.arange(len(queries)), owner) * len(others) + np.concatenate([np.zeros(0, np.int64), *heap])
    pairs, seen = np.unique(merged, return_counts=True)
    count.reshape(-1)[pairs] = seen
    other_sets = [np.frombuffer(o, np.uint64) for o in others]
    for at in range(0, len(probes), 4096):
        some = probes[at : at + 4096]
        answers = [np.stack([_probe(x, some) for x in side]) for side in (sets, other_sets)]
        count += answers[0] @ answers[1].T
    return count


def _probe(mine: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    if not len(mine):
        return np.zeros(len(shingles), np.float32)
    at = np.searchsorted(mine, shingles)
    return ((at < len(mine)) & (mine[np.minimum(at, len(mine) - 1)] == shingles)).astype(np.float32)


def _search(percent: int):
    """Links between the queries and the others of a pair of blocks, as a forest."""

    def run(key, table):
        query = np.asarray(table.column("query"))
        ids, sets = np.asarray(table.column("id")), table.column("hashes").to_pylist()
        left, right = np.flatnonzero(query), np.flatnonzero(~query)
        links = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        others = [sets[i] for i in right.tolist()]
        sizes = np.array([len(x) // 8 for x in sets])
        for at in range(0, len(left), 256):
            mine = left[at : at + 256]
            same = overlaps([sets[i] for i in mine.tolist()], others).astype(np.int64)
            union = sizes[mine][:, None] + sizes[right][None, :] - same
            a, b = np.nonzero((100 * same >= percent * union) & (ids[mine][:, None] != ids[right][None, :]))
            links[0].append(mine[a])
            links[1].append(right[b])
        a, b = np.concatenate(links[0]), np.concatenate(links[1])
        names, place = np.unique(ids, return_inverse=True)
        to = C.forest(len(names), place[a], place[b])
        linked = to != np.arange(len(to))
        return pa.table([pa.array(names[linked]), pa.array(names[to[linked]])], ["a", "b"])

    return run


def occurrence_links(sets: DataFrame, label: DataFrame, percent: int = PERCENT, buckets: int | None = None) -> DataFrame:
    """Links (a, b) between documents in different components: enough of them to join what any link joins.

    Documents that share T of their shingles with other components are left; of these, the rarest shingles (n - T + 1
    of each) make families, so that linked documents are in one. In a family all documents outside its largest
    component are queries against the family, block by block.
    """
    buckets = buckets or C.tasks(sets)
    comps = sets.select("id").join(label.select(F.col("node").alias("id"), "component"), "id", "left")
    comps = cut(comps.select("id", F.coalesce("component", "id").alias("comp")), "comps")
    labelled = sets.select("id", "n", "hashes").join(comps, "id")
    hits = _count_hits(labelled.select("id", "comp", "hashes").mapInArrow(C.tidy(_post_sets(buckets)), _POSTINGS), buckets).select("id", "hits")
    left = cut(labelled.join(hits, "id").where(f"hits >= (n * {percent} + 99) div 100").drop("hits"), "left")
    links = left.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    if left.isEmpty():
        return links

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.steps(batches, "hashes"):
            data, offsets = C.raw(batch.column(2))
            sizes = np.diff(offsets) // 8
            take = [pa.array(np.repeat(np.asarray(batch.column(i), np.int64), sizes)) for i in (0, 1)]
            need = pa.array(np.repeat((percent * sizes + 99) // 100, sizes))
            yield pa.RecordBatch.from_arrays([*take, need, pa.array(np.frombuffer(data.tobytes(), np.int64))], ["id", "comp", "need", "h"])

    posts = cut(left.select("id", "comp", "hashes").mapInArrow(C.tidy(entries), "id long, comp long, need long, h long"), "posts")
    lists = posts.groupBy("h").agg(F.count("*").alias("df"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    sized = C.hot_join(posts, cut(lists.select("h", "df"), "lists"), "h", "df")
    ranked = sized.groupBy("id", "need").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("own"))  # a document's own shingles
    rare = cut(ranked.where("size(own) >= need").select("id", F.explode(F.expr("slice(own, 1, size(own) - need + 1)")).alias("x")).select("id", F.col("x.h").alias("h")), "rare")
    firsts = cut(rare.groupBy("h").agg(F.min("id").alias("b"), F.count("*").alias("n")).where("n > 1"), "firsts")
    edges = C.hot_join(rare, firsts, "h", "n").select(F.col("id").alias("a"), "b").distinct()
    family = C.components(edges).withColumnRenamed("component", "family").withColumnRenamed("node", "id")
    members = cut(comps.join(family, "id"), "members")
    parts = members.groupBy("family", "comp").agg(F.count("*").alias("n"))
    main = parts.groupBy("family").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("largest")).where("n > largest")
    blocks = main.select("family", "main", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("n") - F.col("largest")) / BLOCK).cast("int").alias("asks"), "n")
    placed = cut(C.hot_join(members, cut(blocks, "blocks"), "family", "n"), "placed")
    rows = left.select("id", "hashes").join(placed, "id")
    one, two = F.expr("cast(pmod(xxhash64(id), asks) as int)"), F.expr("cast(pmod(xxhash64(id, 1), blocks) as int)")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    asking = rows.where("comp <> main").select("family", one.alias("ask"), every("blocks").alias("block"), F.lit(True).alias("query"), "id", "hashes")
    asked = rows.select("family", every("asks").alias("ask"), two.alias("block"), F.lit(False).alias("query"), "id", "hashes")
    return cut(asking.unionByName(asked).groupBy("family", "ask", "block").applyInArrow(_search(percent), "a long, b long"), "links")


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per id of ``docs``: id, n_shingles, component_id (smallest id reachable by links, itself included).

    Words are runs of non-white characters, A-Z in lower case; the set holds the distinct shingles of ``size`` words,
    or the whole sequence if it is shorter. Two documents link when their Jaccard similarity is ``percent`` or more.
    Null, empty and white texts have no shingles and link with nothing. Rows repeated with the same id are one
    document. Rows without an id come back with nulls. Empty tables give empty results; other columns are not read.
    """
    with scratch() as tables:
        texts = only(docs, id_col, text_col)
        buckets = C.tasks(docs)
        known = texts.where("id IS NOT NULL")
        stats = _count_hits(known.mapInArrow(C.tidy(_post_texts(buckets, size, percent)), _POSTINGS), buckets)
        stats = cut(stats, "stats")
        groups = cut(stats.where("n > 0").groupBy("sig").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.max("hits").alias("hits"), F.max("n").alias("n")), "groups")
        asked = groups.where(f"hits >= 1 + ((n * {percent} + 99) div 100) div 10").select(F.col("rep").alias("id"))
        sets = cut(known.join(asked, "id", "left_semi").mapInArrow(C.tidy(_set_rows(size, LEADER_KEYS)), "id long, n long, hashes binary, keys array<long>").dropDuplicates(["id"]), "sets")
        links = links_of(leader_pairs(sets), sets, percent)
        label = C.components(links)
        more = occurrence_links(sets, label, percent, buckets)
        if not more.isEmpty():
            label = C.components(links.unionByName(more))
        named = cut(groups.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("sig", "copies", F.coalesce("component", "rep").alias("component_id")), "named")
        told = C.hot_join(stats.where("n > 0"), named, "sig", "copies").select("id", "n", "component_id")
        alone = stats.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
        nameless = texts.where("id IS NULL").select("id", F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("component_id"))
        result = cut(told.unionByName(alone).unionByName(nameless).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id"), "result")
        tables.keep(result)
    return result


def only(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return C.only(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of ``docs`` that are the smallest of their component."""
    found = ngram_join(docs, id_col, text_col)
    return C.with_ids(docs, id_col, found.where(F.col(id_col) == F.col("component_id")).select("component_id"))

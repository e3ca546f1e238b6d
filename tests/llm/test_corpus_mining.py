"""Line deduplication, phrase mining and lexical search against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from herdsignal.llm import common as C, lexical_search, line_dedup, phrases

LOWER = str.maketrans(C.UPPER, C.LOWER)
SCHEMA = "doc_id long, text string, lang string, n long, score long, a long, id string, rank int"


def corpus():
    rng = random.Random(5)
    lines = [f"A line of boilerplate, number {i}" for i in range(6)] + ["short", " \t", "", "x" * 19, "y" * 20, "ÄÖÜ" * 7, "  Ends in white \x0b\x0c and is long enough\r"]
    words = ["red", "Green", "blue", "naïve", "x1", "日本", "the", "cat", "sat", "on", "mat"]
    out = []
    for i in range(60):
        parts = []
        for _ in range(rng.choice([1, 3, 8])):
            parts.append(rng.choice(lines) if rng.random() < 0.6 else " ".join(rng.choice(words) for _ in range(rng.choice([2, 9]))) + rng.choice([".", "", "!", ", the cat sat on the mat"]))
            if rng.random() < 0.2:
                parts.append(parts[-1].upper())
        out.append((i, "\n".join(parts), ["en", "de", None, "und", ""][i % 5]))
    out += [(60, None, "en"), (61, "", "en"), (62, "\n\n", None), (63, ("the cat sat on the mat. " * 2000) + "\n" + lines[0], "en")]
    out += [out[3], out[3], (None, lines[0] + "\nmore", "en"), (None, None, None)]
    return out


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, g, 1, 2, 3, "x", 4) for i, t, g in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def kept_lines(rows):
    """(id, lines, dropped, text) of every row, and the documents of each key, by the rule."""
    holders = {}
    for i, text, *_ in rows:
        if i is not None:
            for line in (text or "").split("\n"):
                if len(key(line)) >= 20:
                    holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        lost = [i is not None and len(holders.get(key(x), ())) >= 3 and i != max(holders[key(x)]) for x in lines]
        out.append((i, len(lines), sum(lost), "\n".join(x for x, gone in zip(lines, lost, strict=True) if not gone)))
    return Counter(out), {k: (len(v), max(v)) for k, v in holders.items()}


def test_line_dedup(docs, empty):
    want, _ = kept_lines(ROWS)
    got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in line_dedup.line_dedup(docs).collect())
    assert got == Counter({(i, n, d, hashlib.sha256(t.encode()).hexdigest()): c for (i, n, d, t), c in want.items()})
    assert line_dedup.line_dedup(empty).count() == 0


def state(index):
    return {(r["a"], r["b"]): (r["n"], r["last"]) for r in index.counts().where("n > 0").collect()}


def test_line_index_inserts_and_deletes(spark, docs):
    index = line_dedup.LineIndex(spark, shard_keys=8)
    index.insert(docs.where("doc_id < 30"))
    first = state(index)
    index.insert(docs)  # the others are new, those known are passed over
    index.insert(docs.where("doc_id = 7"))
    want, holders = kept_lines(ROWS)
    every = state(index)
    assert sorted(every.values()) == sorted(holders.values())
    got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in index.kept(docs).collect())
    assert got == want
    index.delete(docs.where("doc_id >= 30"))
    assert state(index) == first
    index.delete(docs.where("doc_id >= 30"))
    few = [row for row in ROWS if row[0] is not None and row[0] < 30]
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in index.kept(docs.where("doc_id < 30")).collect()) == kept_lines(few)[0]
    # Every key with a document is in its shard's filter, whatever was inserted and deleted before.
    slots = {r["shard"]: line_dedup.CuckooFilter(np.frombuffer(bytes(r["slots"]), np.uint16)) for r in index.filters().collect()}
    for r in index.counts().where("n > 0").collect():
        assert slots[r["shard"]].contains(np.array([r["a"]], np.int64).view(np.uint64)).all()
    index.insert(docs.where("doc_id >= 30"))
    assert state(index) == every
    # What a broken-off change has written is not read.
    index._append("counts", spark.createDataFrame([(99, 0, 1, 2, 3, 4)], line_dedup._COUNTS), line_dedup._COUNTS)
    assert state(index) == every


def test_cuckoo_filter():
    rng = np.random.default_rng(4)
    keys = C.mixed(np.arange(20_000, dtype=np.uint64))
    known = line_dedup.CuckooFilter.for_keys(len(keys))
    assert known.insert(keys) and known.contains(keys).all()
    others = C.mixed(np.arange(20_000, 40_000, dtype=np.uint64))
    assert known.contains(others).mean() < 0.01
    known.remove(keys[:15_000])
    assert known.contains(keys[15_000:]).all() and known.contains(keys[:15_000]).mean() < 0.01
    small = line_dedup.CuckooFilter(np.zeros(8, np.uint16))
    assert not small.insert(keys[:9])


def brute_phrases(rows, least, top):
    words_of, grams = {}, {}
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            words_of[lang] = words_of.get(lang, 0) + len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    grams.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, found in grams.items():
        found = {g: f for g, f in found.items() if f >= least}
        mine = []
        for g, a in found.items():
            if len(g) < 2:
                continue
            longer = [f for h, f in found.items() if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))]
            if any(100 * f >= 80 * a for f in longer):
                continue
            score, _, l, r = min((2_000_000 * a // (found[g[:k]] + found[g[k:]]), k, found[g[:k]], found[g[k:]]) for k in range(1, len(g)))
            mine.append((-score, -a, " ".join(g).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(mine)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, words_of[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("how", [{"bits": 12}, {"bits": 4, "shard": 30, "most": 60}])
def test_phrases(docs, empty, how, monkeypatch):
    monkeypatch.setattr(phrases, "POSITIONS", 100)
    got = sorted(tuple(r) for r in phrases.mine(docs, least=3, top=40, **how).collect())
    assert got == brute_phrases(ROWS, 3, 40)
    if how["bits"] == 12:
        assert phrases.mine(empty, bits=12).count() == 0


def test_phrases_with_a_full_bitmap(docs, monkeypatch):
    """As many tables are written, and so texts read, however many candidates the bitmap lets through."""
    made = []
    monkeypatch.setattr(phrases, "cut", lambda df, name, cut=phrases.cut: made.append(name) or cut(df, name))
    monkeypatch.setattr(phrases, "POSITIONS", 100)
    monkeypatch.setattr(phrases, "HELD", 50, raising=False)  # counts are dealt out many times a task
    want = brute_phrases(ROWS, 3, 40)
    runs = []
    for how in ({"bits": 12}, {"bits": 3, "shard": 5, "most": 2000}):
        assert sorted(tuple(r) for r in phrases.mine(docs, least=3, top=40, **how).collect()) == want
        runs.append(sorted(made))
        made.clear()
    assert runs[0] == runs[1]


def test_counts_of_phrases():
    words = [np.array([5, 5, 1, 5], np.int32), np.array([6, 7, 2, 6], np.int32)]
    once = phrases.Counts.of(phrases._hashes(words), words, np.array([1, 2, 3, 4]))
    twice = phrases.Counts.joined([once, once])
    assert {(a, b): n for a, b, n in zip(*(w.tolist() for w in twice.words), twice.n.tolist(), strict=True)} == {(5, 6): 10, (5, 7): 4, (1, 2): 6}
    # A hash that two phrases share does not join them.
    assert len(phrases.Counts.of(np.zeros(4, np.uint64), words, np.ones(4, np.int64)).n) == 3


def test_phrases_beyond_64_bits(spark):
    big = 2**45
    grams = spark.createDataFrame([([1, 2], big)], "ids array<int>, f long")
    words = spark.createDataFrame([(1, big + 1), (2, big)], "code int, f long")
    assert phrases.scored(grams, words).first()["score"] == 2_000_000 * big // (2 * big + 1)


def test_double_array():
    rng = np.random.default_rng(6)
    for many, codes in ((2, 5), (3, 40), (4, 3000)):
        rows = np.unique(rng.integers(1, codes, (400, many)).astype(np.int32), axis=0)
        radix = 1 + int(codes**0.5)
        text = np.concatenate([rng.integers(0, codes, 300), rows[::7].ravel(), [0], rows[5]]).astype(np.int32)
        number = {tuple(r): i for i, r in enumerate(rows.tolist())}
        starts = [tuple(text[i : i + many].tolist()) for i in range(len(text) - many + 1)]
        want = [number[s] for s in starts if s in number]
        one = phrases.DoubleArray(rows, radix)
        assert one.accepted(text, many).tolist() == want
        half = len(rows) // 2
        both = phrases.DoubleArray.joined([phrases.DoubleArray(part, radix).packed() for part in (rows[:half], rows[half:])], radix)
        root = np.array([0 if number.get(s, 0) < half else 1 for s in starts])
        assert both.accepted(text, many, root).tolist() == want


def brute_search(items, rows, top):
    texts = [(i, lexical_search.terms_of(t)) for i, t, *_ in rows]
    texts = [(i, Counter(t), len(t)) for i, t in texts if t]
    n_all, l_all = len(texts), sum(n for _, _, n in texts)
    df = Counter(t for _, c, _ in texts for t in c)
    asked = {}
    for item, text in items:
        if item is not None and text is not None:
            asked.setdefault(item, set()).update(lexical_search.terms_of(text))
    out = []
    for item, terms in asked.items():
        found = []
        for i, often, n in texts:
            m = 50 + 50 * n * n_all // l_all
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (10**9 * often[t] // (1000 * often[t] + 20 * m)) for t in terms if often[t])
            if score > 0 and i is not None:
                found.append((-score, i))
        out += [(item, rank, i, -score) for rank, (score, i) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "step", "top"), [(512, 512, 50), (2, 3, 5)])
def test_lexical_search(spark, docs, empty, monkeypatch, block, step, top):
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", block)
    monkeypatch.setattr(lexical_search, "STEP_DOCS", step)
    items = [(1, "The red cat, naïve!"), (2, "the RED cat sat"), (3, "red cat on mat"), (4, None), (5, ""), (6, "nowhere"), (7, "日本 x1 number"), (2, "the RED cat sat"), (None, "cat")]
    frame = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, score string").repartition(2)
    got = sorted(tuple(r) for r in lexical_search.search(frame, docs, top=top).collect())
    assert got == brute_search(items, ROWS, top)
    if top == 5:
        assert lexical_search.search(frame, empty).count() == 0
        assert lexical_search.search(frame.where("false"), docs).count() == 0


def test_shared_sums():
    plan = lexical_search.share([{"a", "b", "c"}, {"a", "b", "d"}, {"a", "b", "c"}, set(), {"z"}])
    assert plan.levels and len(plan.nodes[0]) == 1 and plan.nodes[0] == plan.nodes[2]

    def leaves(node):
        at = len(plan.terms)
        for left, right in plan.levels:
            if at <= node < at + len(left):
                return leaves(int(left[node - at])) + leaves(int(right[node - at]))
            at += len(left)
        return [plan.terms[node]]

    assert [sorted(t for n in nodes for t in leaves(n)) for nodes in plan.nodes] == [["a", "b", "c"], ["a", "b", "d"], ["a", "b", "c"], [], ["z"]]

"""The text operators against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from herdsignal.llm import bpe, embedding_dedup, exact_dedup, language, ngram_join, packing, recurrent_lm, suffix_dedup, token_counts, warc
from herdsignal.llm import common as C, queries

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
LOWER = str.maketrans(C.UPPER, C.LOWER)
SCHEMA = "doc_id long, text string, lang string, id string, keep_id long, _kept_id int"


def corpus() -> list[str | None]:
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)] + ["Ärger", "don't", "naïve", "x'll", "42", "İstanbul", "日本", "ét", "<|endoftext|>", "a\x85b"]
    base = [rng.choice(words) for _ in range(150)]
    texts: list[str | None] = [None, "", " \t", "one", "One two", "ONE TWO", "one two", None]
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(" ".join(copy))
    passage = " ".join(rng.choice(words) for _ in range(40))
    for _ in range(25):
        texts.append(" ".join(rng.choice(words) for _ in range(rng.choice([5, 30, 90]))) + "\n" + passage)
    texts.append(" ".join(rng.choice(words) for _ in range(20_000)))
    return texts


TEXTS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], "x", 1, 2) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="doc_id"):
    return {row[key]: row for row in df.collect()}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return set(zip(*(words[k:] for k in range(5)), strict=False)) if len(words) >= 5 else ({tuple(words)} if words else set())


def classes(n, linked):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j in linked:
        a, b = find(i), find(j)
        label[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_ngram_join(docs, empty, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    sets = [shingles(t) for t in TEXTS]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = classes(len(sets), pairs)
    got = by_id(ngram_join.ngram_join(docs.unionByName(docs.where("doc_id < 12"))))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(sets[i]), want[i]) for i in range(len(sets))}
    assert ngram_join.ngram_join(empty).count() == 0


def test_overlaps_merge_and_probe():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 50)).astype(np.uint64)) for _ in range(30)]
    raw = [s.tobytes() for s in sets]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets[:10]]
    for long in (0, 5, 100):
        assert ngram_join.overlaps(raw[:10], raw, long).tolist() == want


def test_settled_postings_change_no_answer():
    rng = np.random.default_rng(2)
    for many in (0, 1, 40, 400):
        hashes, label, step = rng.integers(0, 20, many).astype(np.uint64), rng.integers(0, 8, many), rng.integers(0, 3, many)
        settled = np.zeros(many, bool)
        for s in range(3):
            settled[step == s] = ngram_join._settled(hashes[step == s], label[step == s])
        other = lambda h, x, among: bool(((hashes == h) & (label != x) & among).any())
        for h, x, done in zip(hashes, label, settled, strict=True):
            assert other(h, x, np.ones(many, bool)) == (True if done else other(h, x, ~settled))
        sent = Counter(zip(step[~settled].tolist(), hashes[~settled].tolist(), strict=True))
        for (s, h), n in sent.items():
            mine = label[(step == s) & (hashes == h)]
            assert n == (len(mine) if (mine == mine[0]).all() else 2)


def test_exact_dedup(docs, empty):
    keys = [(t or "").translate(LOWER) for t in TEXTS]
    last = {k: i for i, k in enumerate(keys)}
    size = Counter(keys)
    weak = lambda text: exact_dedup.F.substring(exact_dedup.F.sha2(text.cast("binary"), 256), 1, 1)
    for how in ({}, {"capacity": 2, "max_depth": 6}, {"digest": weak}):
        got = by_id(exact_dedup.exact_dedup(docs, **how))
        assert {i: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for i, r in got.items()} == {
            i: (last[k], size[k], last[k] == i, hashlib.sha256(k.encode()).hexdigest()) for i, k in enumerate(keys)
        }
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.keep_one(docs).columns == docs.columns


def test_directory_splits_overfull_buckets(docs):
    texts = docs.selectExpr("doc_id AS id", "coalesce(text, '') AS text").withColumn("digest", exact_dedup.digest_of(exact_dedup.F.col("text")))
    cells = exact_dedup.directory(texts.select("digest").distinct(), capacity=4, max_depth=8)
    index = exact_dedup.build_index(texts, cells, max_depth=8)
    sizes = {(r["bucket"], r["depth"]): r["count"] for r in index.groupBy("bucket", "depth").count().collect()}
    assert all(n <= 4 or depth == 8 for (_, depth), n in sizes.items())
    assert len(sizes) > 5
    routed = exact_dedup.route(texts, cells, max_depth=8)
    assert routed.count() == len(TEXTS)
    assert routed.join(index.select("digest", index["bucket"].alias("owner")), "digest").where("bucket <> owner").count() == 0


def test_one_digest_for_all(spark):
    """Chains of every length, two texts under one id, repeated rows, null ids."""
    rows = [(1, "a"), (1, "b"), (2, "A"), (2, "A"), (3, None), (4, ""), (None, "c"), (5, "d"), (5, "e"), (6, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_dedup.exact_dedup(docs, digest=lambda text: exact_dedup.F.lit("00000000")).collect()
    told = sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"], r["text_sha256"]) for r in got)
    want = []
    for i, t in rows:
        key = (t or "").translate(LOWER)
        same = [j for j, u in rows if (u or "").translate(LOWER) == key]
        keep = max((j for j in same if j is not None), default=None)
        want.append((i or 0, keep or 0, len(same), i is not None and i == keep, hashlib.sha256(key.encode()).hexdigest()))
    assert told == sorted(want)
    assert {r["chain"] for r in got} == set(range(6))
    kept = exact_dedup.keep_one(docs).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in kept) == [(2, "A"), (4, ""), (5, "d"), (5, "e"), (6, "b")]


def test_bpe(docs, empty):
    tok = Tokenizer.from_file(WORD_BPE)
    ids = [tok.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    got = by_id(bpe.digests(docs, WORD_BPE))
    for i, want in enumerate(ids):
        decoded = tok.decode(want, skip_special_tokens=False)
        row = got[i]
        assert row["n_tokens"] == len(want)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    encoded = bpe.encode(docs, WORD_BPE)
    assert {r["doc_id"]: r["ids"] for r in encoded.collect()} == dict(enumerate(ids))
    assert {r["doc_id"]: r["text"] for r in bpe.decode(encoded, WORD_BPE).collect()} == {i: tok.decode(x, skip_special_tokens=False) for i, x in enumerate(ids)}
    assert bpe.digests(empty, WORD_BPE).count() == 0


def test_packing(docs, empty):
    tok = Tokenizer.from_file(WORD_BPE)
    rows = packing.pack(docs, WORD_BPE).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, text in enumerate(TEXTS):
        want = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(want))
            assert r["ids_crc32"] == zlib.crc32(want[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(want)
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(empty, WORD_BPE).count() == 0


def test_harmonic_cuts():
    for length in (1, 2, 63, 64, 65, 1000, 1365, 1366, 4095, 4096, 4097, 20_000):
        cuts = packing.harmonic_cuts(length)
        assert sum(size for _, size, _ in cuts) == length
        assert all(size == 4096 // k for _, size, k in cuts)


def test_suffix_dedup(docs, empty, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", 1 << 12)
    seen, want = set(), {}
    for i, text in enumerate(TEXTS):
        data, new = (text or "").encode(), set()
        gone = bytearray(len(data))
        for k in range(len(data) - 49):
            piece = data[k : k + 50]
            if piece in seen:
                gone[k : k + 50] = b"\1" * 50
            new.add(piece)
        seen |= new
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        want[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    got = by_id(suffix_dedup.suffix_dedup(docs))
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == want
    assert suffix_dedup.suffix_dedup(empty).count() == 0
    rest = suffix_dedup.keep_rest(docs)
    assert rest.columns == docs.columns and rest.count() == docs.count()


def test_rest_is_cut_without_a_second_copy_of_the_texts(spark):
    passage, other = "the quick brown fox jumps over the lazy dog " * 2, "x" * 20
    rows = [(1, passage, "a"), (2, "é" * 30 + passage + other, "b"), (3, passage, "c"), (3, passage, "c"), (4, None, "d"), (None, passage, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _spans string")
    rest = suffix_dedup.keep_rest(docs)
    got = sorted(((r[0] or 0, r[1], r[2]) for r in rest.collect()), key=str)
    assert got == sorted([(0, passage, "e"), (1, passage, "a"), (2, "é" * 30 + other, "b"), (3, "", "c"), (3, "", "c"), (4, None, "d")], key=str)
    # Spans are joined to the rows; no aggregate or join carries another copy of a text.
    assert "_kept" not in rest._jdf.queryExecution().analyzed().toString() and rest.schema == docs.schema


def test_anchors_by_parts(monkeypatch):
    rng = np.random.default_rng(5)
    sizes = np.r_[0, 0, 400, 49, 50, 0, rng.integers(0, 300, 40), 0]
    data, offsets = rng.integers(97, 100, sizes.sum()).astype(np.uint8), np.r_[0, np.cumsum(sizes)]
    whole = suffix_dedup._anchors(data, offsets, 50)
    for most in (1, 50, 333, 1 << 19):
        monkeypatch.setattr(suffix_dedup, "ANCHOR_BYTES", most)
        assert all((x == y).all() and len(x) == len(y) for x, y in zip(suffix_dedup.anchors(data, offsets, 50), whole, strict=True))
    assert [len(x) for x in suffix_dedup.anchors(data[:0], offsets[:1], 50)] == [0] * 5


def test_suffix_order():
    rng = np.random.default_rng(0)
    for turn in range(150):
        letters = rng.integers(0, rng.integers(1, 5), rng.integers(0, 120))
        if turn % 3 == 0 and len(letters) > 20:
            letters = np.tile(letters[:7], 20)
        depth = int(rng.integers(1, 60))
        order = suffix_dedup.suffix_order(letters, depth).tolist()
        assert sorted(order) == list(range(len(letters)))
        prefixes = [tuple(letters[i : i + depth].tolist()) for i in order]
        assert prefixes == sorted(prefixes)


def test_language(spark, empty):
    rows = [(i, ("der und die nicht ist ein " if i % 2 else "the and of that with from ") * (1 + i % 5), "de" if i % 2 else "en") for i in range(40)]
    docs = spark.createDataFrame([*rows, (40, None, "en"), (41, "12 !?", "de"), (42, "the of", None)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    got = by_id(language.predict(docs, model))
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows)
    assert (got[40]["lang_pred"], got[41]["lang_pred"], got[42]["lang_pred"]) == ("und", "und", "en")
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.predict(empty, language.fit(empty)).count() == 0
    assert {r["lang_pred"] for r in language.predict(docs, language.fit(empty)).collect()} == {"und"}


def test_embedding_dedup(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((30, 16))
    rows = [(base[i % 30] + rng.standard_normal(16) * rng.choice([0, 0.02, 0.08])).tolist() for i in range(400)]
    odd = [None, [], [0.0] * 16, [1.0, None] * 8, [float("nan")] * 16, [float("inf")] * 16, [1.0, 0.0]]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate([*rows, *odd])], "vec_id long, embedding array<double>, id int").repartition(3)
    unit = np.array(rows) / np.linalg.norm(rows, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    want = classes(len(rows), [(i, j) for i, j in np.argwhere(near) if j < i])
    got = by_id(embedding_dedup.embedding_dedup(df), "vec_id")
    found = sum(got[i]["n_links"] for i in range(len(rows)))
    assert 0.99 * near.sum() <= found <= near.sum()
    assert sum(got[i]["component_id"] == want[i] for i in range(len(rows))) >= 0.99 * len(rows)
    assert all(got[len(rows) + i]["n_links"] == 0 and got[len(rows) + i]["kept"] for i in range(len(odd)))
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    html = ["<p>a</p>", "<p>ä</p>", "<p>a</p>", None, "", "x" * 700_000, "<p>a</p>\r\n\r\n"]
    pages = spark.createDataFrame([(i, f"http://x/{i}\r\n" if i else None, h, 0) for i, h in enumerate(html)], "page_id long, url string, html string, id int")
    archives = warc.write(pages.repartition(2))
    got = by_id(warc.read(archives), "id")
    first = {h: i for i, h in reversed([(i, h or "") for i, h in enumerate(html)])}
    for i, h in enumerate(html):
        data = (h or "").encode()
        row = got[i]
        assert row["digest_ok"] and row["payload_bytes"] == len(data) and row["payload_digest"] == warc.digest(data)
        assert row["refers_to"] == (None if first[h or ""] == i else first[h or ""])
        assert row["record_type"] == ("response" if row["refers_to"] is None else "revisit")
        assert row["payload"] == (data if row["refers_to"] is None else None)
    assert warc.archive(pages.limit(0)).count() == 0
    assert {r["record_type"] for r in warc.archive(pages, least=1 << 30).collect()} == {"response"}


def test_damaged_archives():
    import io

    good = warc.record(1, "http://x/", b"payload", None, "1970-01-01T00:00:00Z")
    assert [warc.parse(m)["id"] for m in warc.members(io.BytesIO(good + good))] == [1, 1]
    with pytest.raises(warc.Damaged):
        [warc.parse(m) for m in warc.members(io.BytesIO(good[:-12]))]


def test_token_counts(docs, empty):
    encoder, sizes = token_counts.encoding(BYTE_BPE, public_tokenizers.PATTERN)
    got: dict[int, list] = {}
    for r in token_counts.token_counts(docs, BYTE_BPE, public_tokenizers.PATTERN).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, text in enumerate(TEXTS):
        rows = sorted(got[i], key=lambda r: r["section"])
        assert sum(r["n_tokens"] for r in rows) == len(encoder.encode_ordinary(text or ""))
        assert "".join((text or "")[r["start"] : r["end"]] for r in rows) == (text or "")
    assert token_counts.token_counts(empty, BYTE_BPE, public_tokenizers.PATTERN).count() == 0


def test_tokens_across_boundaries():
    first, behind = np.array([0, 2, 4]), np.array([2, 4, 9])
    spans = np.array([[0, 3], [3, 5], [6, 9]])
    section, crossing = token_counts.attribute(first, behind, spans, "most")
    assert section.tolist() == [0, 0, 2] and crossing.tolist() == [False, True, True]
    assert token_counts.attribute(first, behind, spans, "start")[0].tolist() == [0, 0, 1]


def test_warc_repeated_id_with_two_payloads(spark):
    rows = [(1, "u", "one"), (2, "u", "two"), (5, "u", "one"), (5, "u", "two"), (5, "u", "three")]
    found = warc.read(warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    got = sorted((r.id, r.refers_to or 0, bytes(r.payload or b"").decode()) for r in found)
    assert got == [(1, 0, "one"), (2, 0, "two"), (5, 0, "three"), (5, 1, ""), (5, 2, "")]


def test_recurrent_lm(docs, empty):
    marked = docs.selectExpr("*", "doc_id % 10 <> 0 AS train")
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None] for t in TEXTS]
    counts = Counter(w for i, t in enumerate(tokens) if i % 10 for w in t)
    n, v = sum(counts.values()), len(counts)
    got = by_id(recurrent_lm.score(marked, "train"))
    for i, text in enumerate(tokens):
        row = got[i]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in text)
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (len(text), sum(counts[w] > 0 for w in text), n)
        assert row["base_score"] == pytest.approx(base, rel=1e-9)
        assert row["score"] < 0
    assert recurrent_lm.score(empty.selectExpr("*", "true AS train"), "train").count() == 0


def test_recurrent_lm_learns_from_every_window(spark):
    top = recurrent_lm.TOP
    known = recurrent_lm.Vocabulary(5000, top, 101, np.arange(top, dtype=np.uint64), np.full(top, 3), np.full(recurrent_lm.TAILS, 5), np.full(recurrent_lm.TAILS, 2))
    long = np.arange(1000, dtype=np.uint16)
    short = [np.arange(1000 + 5 * i, 1005 + 5 * i, dtype=np.uint16) for i in range(107)]  # more than two groups of learners
    rows = [(i, len(c) + 1, bytes(recurrent_lm.W.pack(c))) for i, c in enumerate([long, *short])]
    coded = spark.createDataFrame(rows, "id long, n_tokens long, codes binary").coalesce(1)
    began = recurrent_lm.Network(known)
    learned = recurrent_lm.Network(known).load(recurrent_lm.train(coded, known))
    changed = (learned.p["inputs"] != began.p["inputs"]).any(axis=1)
    assert changed[: 1000 + 5 * len(short)].all() and changed[recurrent_lm._BEGIN]


def test_probabilities_add_up_to_one():
    rng = np.random.default_rng(0)
    top = 70
    known = recurrent_lm.Vocabulary(2000, 500, 10, np.arange(top, dtype=np.uint64), np.arange(top, 0, -1), np.full(recurrent_lm.TAILS, 5), np.full(recurrent_lm.TAILS, 2))
    net = recurrent_lm.Network(known)
    state = rng.standard_normal((1, recurrent_lm.STATE)).astype(np.float32)
    codes = np.r_[-1, np.arange(top), recurrent_lm.TOP + np.arange(recurrent_lm.TAILS)]
    score, _ = net.loss(np.repeat(state, len(codes), 0), codes)
    assert np.exp(score).sum() == pytest.approx(1, abs=1e-4)


def test_pipeline_keeps_columns(spark, docs):
    kept = docs.withColumnRenamed("id", "source").selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as int) AS n_chars")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_join", "suffix_dedup", "packing"]
    before = kept
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, "")
        assert after.columns == kept.columns
        before = spark.createDataFrame(after.collect(), kept.schema)
    ids = {r["doc_id"] for r in before.collect()}
    assert corpus_pipeline.STAGES[-1][1](spark, before, "").select("doc_id").distinct().count() == len(ids)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    from check_oracles import connect

    folder = "/root/testdata/sf0.001"
    mine = queries.QUERIES[name](spark, folder).toPandas()
    sql = connect(folder).execute(queries.ORACLES[name]).df()
    key = [c for c in mine.columns if c in ("doc_id", "page_id")][0]
    mine, sql = (x.sort_values(key).reset_index(drop=True) for x in (mine, sql))
    for column in mine.columns:
        left, right = mine[column].astype(object).where(mine[column].notna(), None), sql[column].astype(object).where(sql[column].notna(), None)
        assert left.tolist() == right.tolist(), column


def long_words():
    """Words that sums of powers modulo 2**64 cannot tell apart, whatever the base, and long random ones."""
    rng = random.Random(8)
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    return [one, two, one + two, two + one, *("".join(rng.choice("abcdefgh") for _ in range(n)) for n in (8, 9, 16, 17, 1024, 1025, 5000) for _ in range(3))]


def test_long_words_are_told_apart(spark):
    found = long_words()
    docs = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string").coalesce(1)
    tok = Tokenizer.from_file(WORD_BPE)
    ids = [tok.encode(t, add_special_tokens=False).ids for t in found]
    for twice in (False, True):
        got = by_id(bpe.digests(docs, WORD_BPE, twice=twice))
        assert [got[i]["ids_sha256"] for i in range(len(found))] == [hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest() for x in ids]
    pieces = packing.pack(docs, WORD_BPE).where("start = 0").collect()
    for r in pieces:
        want = np.array([*ids[r["doc_id"]], 2], "<u4")
        assert (r["doc_tokens"], r["ids_crc32"]) == (len(want), zlib.crc32(want[: r["length"]].tobytes()))
    assert all(r["component_id"] == r["doc_id"] for r in ngram_join.ngram_join(docs).collect())
    train = docs.withColumn("t", queries.F.col("doc_id") != 1)
    told = by_id(recurrent_lm.score(train, "t"))
    assert told[1]["n_known"] == 1 and told[0]["n_known"] == 2 and told[0]["train_tokens"] == 2 * (len(found) - 1)


def test_distinct_beyond_equal_hashes():
    checks = np.array([5, 6, 5, 7, 6, 5], np.uint64)
    codes, first = C.distinct(np.zeros(6, np.uint64), checks)
    assert checks[first][codes].tolist() == checks.tolist() and sorted(first.tolist()) == [0, 1, 3]


def test_other_row_order_is_noticed(spark):
    from herdsignal.llm import words as W

    rows = [spark.createDataFrame([(1, a), (2, b)], "id long, text string").coalesce(1) for a, b in (("x y", "z"), ("z", "x y"))]
    texts, asked = (W.split(r, bpe.splitter(WORD_BPE), 2, parts=(p,)) for r, p in zip(rows, (W.TEXTS, W.WORDS), strict=True))
    with pytest.raises(Exception, match="another order"):
        W.finish(texts, W.answer(asked, bpe.encoder(WORD_BPE), 2), lambda c, t: None, "id long").collect()


def test_pipeline_stages_edges(spark, empty):
    base = [(i, t, ["en", "de"][i % 2], "s", None, 0) for i, t in enumerate(["hello good world today", "guten morgen liebe welt"] * 6)]
    rows = [*base, base[0], (None, "hello good world", "en", "s", None, 0), (50, None, "en", "s", None, 0), (51, "", None, "s", None, 0), (1, "12 34", "de", "s", None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    one = corpus_pipeline.language_id(spark, docs, "")
    assert one.columns == docs.columns
    assert sorted(r["doc_id"] for r in one.collect()) == [0, 0, *range(1, 12)]
    two = corpus_pipeline.drop_copies(spark, one, "")
    assert [(r["doc_id"], r["text"]) for r in two.orderBy("doc_id").collect()] == [(10, base[0][1]), (11, base[1][1])]
    twins = corpus_pipeline.drop_copies(spark, docs.where("doc_id = 0").unionByName(docs.where("doc_id = 0")), "")
    assert twins.count() == 1
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty.withColumnsRenamed({"keep_id": "k"}), "").count() == 0

"""BPE encoding and decoding by a table of distinct words.

A tokenizer of the kind taken here splits a normalised text into words and merges within words only, so a word has the
same ids wherever it stands. Texts are cut into words in Spark tasks (``words``), every distinct word is encoded once
by the task that owns it, and ids come back to the places of the words. Decoding joins ids to the pieces of the
vocabulary, a table of fixed size, and joins pieces with a blank, as the library does without a decoder.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from herdsignal.llm import common as C, words as W
from herdsignal.session import cut

#: Code points below this are in NFC already and have had the same classes in every Unicode version.
SIMPLE = 0x300
#: Marks the word of a special token in the table of words; no other word can begin so, because words hold no blank.
SPECIAL = b" "
#: The contractions that the pre-tokenizer of the vocabulary splits off.
SHORT_ENDINGS, LONG_ENDINGS = "stmd", ("re", "ve", "ll")
#: The steps that the fast splitter stands for; a tokenizer with others goes the slow way throughout.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@cache
def tokenizer(path: str) -> Tokenizer:
    made = Tokenizer.from_file(path)
    made.no_padding()
    made.no_truncation()
    return made


@cache
def _known(path: str) -> bool:
    """Whether the tokenizer normalises and splits as the fast splitter does."""
    with open(path) as file:
        spec = json.load(file)
    steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    pre = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    return steps == ["NFC", "Replace", "Lowercase"] and pre[0].get("pattern", {}).get("Regex") == _PATTERN and pre[0]["behavior"] == "Removed" and pre[0]["invert"]


@cache
def specials(path: str) -> list[str]:
    return sorted((t.content for t in tokenizer(path).get_added_tokens_decoder().values()), key=len, reverse=True)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case and class (0 white, 1 letter, 2 number, 3 other) of the simple code points."""
    lower = np.array([ord(chr(i).lower()) if len(chr(i).lower()) == 1 else i for i in range(SIMPLE)], np.uint32)
    kinds = {"L": 1, "N": 2}
    cls = np.array([0 if i in (32, 0x85, 0xA0) or 9 <= i <= 13 else kinds.get(unicodedata.category(chr(i))[0], 3) for i in range(SIMPLE)], np.uint8)
    return lower, cls


def _hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of spans of simple code points, which fit into two bytes each."""
    return C.word_hashes(points.astype("<u2").view(np.uint8), 2 * starts, 2 * ends)


def _spans(low: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-case code points."""
    n = len(low)
    start = cls != 0
    start[1:] &= (cls[1:] != cls[:-1]) | (cls[1:] == 2)
    quote = np.flatnonzero(start & (low == 39))
    quote = quote[(quote + 1 < n)]
    if len(quote):
        one = np.isin(low[quote + 1], [ord(c) for c in SHORT_ENDINGS])
        two = np.zeros(len(quote), bool)
        far = quote + 2 < n
        for ending in LONG_ENDINGS:
            two[far] |= (low[quote[far] + 1] == ord(ending[0])) & (low[quote[far] + 2] == ord(ending[1]))
        for at, size in ((quote[one], 2), (quote[two & ~one], 3)):
            start[at + 1] = False
            behind = at + size
            behind = behind[behind < n]
            start[behind] = cls[behind] != 0
    marks = np.flatnonzero(start | (cls == 0))
    begins = start[marks]
    return marks[begins], np.r_[marks[1:], n][begins]


def slow_words(text: str, path: str) -> list[bytes]:
    """Words of one text by the tokenizer's own steps; a special token is a word of its own."""
    tok, out, rest = tokenizer(path), [], [text]
    for special in specials(path):
        rest = [part for piece in rest for part in (_cut(piece, special) if isinstance(piece, str) else [piece])]
    for piece in rest:
        if isinstance(piece, bytes):
            out.append(SPECIAL + piece)
        elif piece:
            normal = tok.normalizer.normalize_str(piece) if tok.normalizer else piece
            out += [normal[a:b].encode() for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(normal)]
    return out


def _cut(text: str, special: str) -> list:
    """The text around a special token, and the token as bytes in between."""
    parts = text.split(special)
    return [x for i, part in enumerate(parts) for x in ((special.encode(), part) if i else (part,))]


def splitter(path: str) -> W.Splitter:
    def run(column: pa.Array):
        texts = [t or "" for t in column.to_pylist()]
        special = specials(path)
        slow = {i for i, t in enumerate(texts) if any(s in t for s in special)} if _known(path) else set(range(len(texts)))
        joined = "\n".join("" if i in slow else t for i, t in enumerate(texts))
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([0 if i in slow else len(t) for i, t in enumerate(texts)]) + np.arange(len(texts))
        odd = np.unique(np.searchsorted(ends, np.flatnonzero((points >= SIMPLE) | (points == 0x130)), side="right"))
        if len(odd):
            slow |= set(odd.tolist())
            points = points.copy()
            for i in odd.tolist():
                points[ends[i - 1] + 1 if i else 0 : ends[i]] = 32
        lower, classes = _tables()
        low = lower[points]
        start, end = _spans(low, classes[points])
        hashes, checks = _hashes(low, start, end)
        row = np.searchsorted(ends, start, side="right")
        counts = np.bincount(row, minlength=len(texts)).astype(np.int64)
        small = low.tobytes().decode("utf-32-le")
        if not slow:
            return (hashes, checks), counts, lambda at: [small[a:b].encode() for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
        # Rows taken the slow way are put in between, word by word.
        extra: list[bytes] = []
        whose = []
        for i in sorted(slow):
            mine = slow_words(texts[i], path)
            extra += mine
            whose += [i] * len(mine)
        others = _spelled_hashes(extra)
        every = np.r_[row, np.array(whose, np.int64)]
        order = np.argsort(every, kind="stable")
        n = len(hashes)

        def spelled(at: np.ndarray) -> list[bytes]:
            return [small[start[i] : end[i]].encode() if i < n else extra[i - n] for i in order[at].tolist()]

        both = (np.r_[hashes, others[0]][order], np.r_[checks, others[1]][order])
        return both, np.bincount(every, minlength=len(texts)).astype(np.int64), spelled

    return run


def _spelled_hashes(spelled: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words as the fast splitter has them, and others where it can't have the word."""
    points = [np.frombuffer(w.decode().encode("utf-32-le"), "<u4") for w in spelled]
    wide = [bool((p >= SIMPLE).any()) or w[:1] == SPECIAL for p, w in zip(points, spelled, strict=True)]
    # Words of other code points and special tokens keep four bytes for each, and end in one that no word has.
    parts = [np.append(p, 0xFFFFFFFF).astype("<u4").view(np.uint8) if odd else p.astype("<u2").view(np.uint8) for p, odd in zip(points, wide, strict=True)]
    ends = np.cumsum([len(p) for p in parts]).astype(np.int64)
    starts = np.r_[0, ends[:-1]].astype(np.int64)[: len(ends)]
    return C.word_hashes(np.concatenate([np.zeros(0, np.uint8), *parts]), starts, ends)


def encode_words(spelled: list[bytes], path: str) -> list[np.ndarray]:
    tok = tokenizer(path)
    ordinary = [w.decode() for w in spelled]
    done = tok.encode_batch([w[1:] if w[0] == " " else w for w in ordinary], add_special_tokens=False)
    return [np.array(e.ids, np.uint32) for e in done]


def encoder(path: str) -> Callable[[list[dict]], Iterator[tuple[dict, dict[str, bytes]]]]:
    """Owner of a bucket of words: ids per word (a: how many, b: ids), each distinct word encoded once."""

    def run(rows: list[dict]):
        asked = [W.unpack_strings(row["a"], row["b"]) for row in rows]
        number: dict[bytes, int] = {}
        for spelled in asked:
            for word in spelled:
                number.setdefault(word, len(number))
        ids = encode_words(list(number), path)
        for row, spelled in zip(rows, asked, strict=True):
            mine = [ids[number[word]] for word in spelled]
            yield row, {"a": W.pack(np.array([len(m) for m in mine], np.uint32)), "b": W.pack(np.concatenate([np.zeros(0, np.uint32), *mine]))}

    return run


def word_ids(told: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each word of a chunk has, and all their ids."""
    none = np.zeros(0, np.uint32)
    return np.concatenate([none, *(W.unpack(r["a"], np.uint32) for r in told)]).astype(np.int64), np.concatenate([none, *(W.unpack(r["b"], np.uint32) for r in told)])


def text_ids(places: np.ndarray, sizes: np.ndarray, ids: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """Ids of words one after the other; ``starts``: where the ids of each different word begin, if known."""
    if starts is None:
        starts = np.cumsum(sizes) - sizes
    mine = sizes[places]
    ends = np.cumsum(mine)
    return ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[places] - (ends - mine), mine)]


def chunk_ids(docs: DataFrame, path: str, work, schema: str, id_col: str, text_col: str, twice: bool = False) -> DataFrame:
    """``work`` on the ids of every chunk of texts.

    ``twice``: texts are split once for their words and once more for their order, so that neither is written in
    between; that takes less disk and more time, and ``docs`` whose rows come in the same order each time.
    """
    buckets = C.tasks(docs)
    rows = C.only(docs, id=id_col, text=text_col)
    if twice:
        texts, asked = (W.split(rows, splitter(path), buckets, parts=(part,)) for part in (W.TEXTS, W.WORDS))
    else:
        texts = asked = cut(W.split(rows, splitter(path), buckets), "chunks")
    return W.finish(texts, W.answer(asked, encoder(path), buckets), work, schema)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ids (array of int), as the tokenizers library encodes the text without added
    special tokens. Null counts as the empty text; an id may be null; repeated rows stay repeated; texts are taken
    whole, whatever their length; other columns are not read; an empty table gives an empty result.
    """
    kind = dict(docs.select(id_col).dtypes)[id_col]

    def work(chunk: W.Chunk, told: list[dict]) -> pa.Table:
        sizes, ids = word_ids(told)
        offsets = np.r_[0, np.cumsum(sizes[chunk.places])][chunk.offsets]
        flat = text_ids(chunk.places, sizes, ids).astype(np.int32)
        return pa.table([chunk.ids, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], ["id", "ids"])

    return chunk_ids(docs, path, work, f"id {kind}, ids array<int>", id_col, text_col).withColumnRenamed("id", id_col)


@cache
def pieces(path: str) -> list[str]:
    """The vocabulary in order of ids, of fixed size; an id without a piece is empty."""
    tok = tokenizer(path)
    if tok.decoder is not None:
        raise ValueError("pieces are joined with blanks: a tokenizer with a decoder of its own is not taken")
    vocabulary = tok.get_vocab(with_added_tokens=True)
    out = [""] * (max(vocabulary.values()) + 1)
    for piece, number in vocabulary.items():
        out[number] = piece
    return out


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``encoded`` with an id: id, text. Ids are joined to their pieces, special tokens too.

    The vocabulary is broadcast: its size is fixed by the tokenizer. Null or empty ids give the empty text. Rows are
    told apart by their id, so ids must be unique and not null.
    """
    spark = encoded.sparkSession
    vocabulary = spark.createDataFrame(list(enumerate(pieces(path))), "token int, piece string")
    rows = encoded.select(F.col(id_col).alias("id"), F.posexplode_outer(ids_col).alias("pos", "token"))
    joined = rows.join(F.broadcast(vocabulary), "token", "left")
    text = F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]))
    return joined.groupBy("id").agg(text.alias("text")).withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", twice: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids_sha256 (decimal ids joined by blanks), decoded_sha256.

    ``twice`` is for ``docs`` read from files (``chunk_ids``): half the disk.
    Words are encoded and decoded once each in the table of distinct words; the documents are put together from both.
    """
    kind = dict(docs.select(id_col).dtypes)[id_col]

    def work(chunk: W.Chunk, told: list[dict]) -> pa.Table:
        sizes, ids = word_ids(told)
        vocabulary = pieces(path)
        ends = np.cumsum(sizes).tolist()
        numbers = ids.tolist()
        of_word = [numbers[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []
        written = np.empty(len(of_word), object)
        decoded = np.empty(len(of_word), object)
        written[:] = [" ".join(map(str, w)) for w in of_word]
        decoded[:] = [" ".join([vocabulary[i] for i in w]) for w in of_word]
        empty = sizes == 0
        hashed: tuple[list, list] = ([], [])
        offsets = chunk.offsets
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            places = chunk.places[a:b]
            if empty[places].any():
                places = places[~empty[places]]
            for out, table in zip(hashed, (written, decoded), strict=True):
                out.append(hashlib.sha256(" ".join(table[places]).encode()).hexdigest())
        counts = np.diff(np.r_[0, np.cumsum(sizes[chunk.places])][offsets])
        return pa.table([chunk.ids, pa.array(counts), *(pa.array(h, pa.string()) for h in hashed)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return chunk_ids(docs, path, work, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", id_col, text_col, twice).withColumnRenamed("id", id_col)

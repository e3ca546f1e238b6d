"""Token counts of fields or sections, attributed by offsets.

A document is encoded once and whole. Tokens of a byte-level vocabulary are pieces of its UTF-8 bytes, so their lengths
give each token's span of bytes, and counting the bytes that begin a character gives its span of characters. The spans
are joined to the sections' intervals by binary search. A token across a boundary goes to one section by a rule:

* ``most``: the one that holds most of its characters, the earlier of equals;
* ``start``: the one that holds its first character.

Characters outside all sections belong to section -1, so that counts add up to the document's.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F

from herdsignal.llm import common as C

RULES = ("most", "start")
OUTSIDE = -1


@cache
def encoding(path: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The vocabulary of a rank file, and the number of bytes of each token."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for piece, number in ranks.items():
        sizes[number] = len(piece)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def token_spans(text: str, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """First character and the one behind the last of every token; tokens within a character share it."""
    encoder, sizes = encoding(path, pattern)
    ends = np.cumsum(sizes[np.asarray(encoder.encode_ordinary(text), np.int64)])
    data = np.frombuffer(text.encode(), np.uint8)
    begins = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]  # characters that begin before each byte
    starts = np.r_[0, ends[:-1]][: len(ends)]
    return begins[starts + 1] - 1 if len(ends) else starts, begins[ends]


def line_spans(text: str) -> np.ndarray:
    """(start, end) of every line, its line feed included; a text without any has one line, an empty one too."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ends = np.flatnonzero(points == 10) + 1
    if not len(ends) or ends[-1] != len(points):
        ends = np.r_[ends, len(points)]
    return np.stack([np.r_[0, ends[:-1]], ends], 1)


def attribute(first: np.ndarray, behind: np.ndarray, spans: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of every token (OUTSIDE: none) and whether it crosses a boundary. Spans are in order and don't overlap."""
    # Boundaries cut the text into intervals, every other one a section: 2 i + 1 is section i.
    edges = spans.reshape(-1)
    at = np.searchsorted(edges, first, side="right")
    last = np.searchsorted(edges, behind - 1, side="right")
    held = at.copy()
    crossing = at != last
    if rule == "most":
        for i in np.flatnonzero(crossing).tolist():
            cuts = np.r_[first[i], edges[at[i] : last[i]], behind[i]]
            held[i] = at[i] + int(np.argmax(np.diff(cuts)))
    section = np.where(held % 2 == 1, held // 2, OUTSIDE)
    # Sections that touch have an empty interval between them, which is no boundary of its own.
    return section, crossing


def _counts(path: str, pattern: str, rule: str, given: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.steps(batches, "text"):
            rows, columns = [], [[], [], [], [], []]
            for i, text in enumerate(batch.column(1).to_pylist()):
                text = text or ""
                if given:
                    value = batch.column(2)[i].as_py() or []
                    spans = np.array([(s["start"], s["end"]) for s in value], np.int64).reshape(-1, 2)
                    if len(spans) and ((np.diff(spans.reshape(-1)) < 0).any() or spans[0, 0] < 0):
                        raise ValueError("sections must be in order and must not overlap")
                else:
                    spans = line_spans(text)
                first, behind = token_spans(text, path, pattern)
                section, crossing = attribute(first, behind, spans, rule)
                outside = section == OUTSIDE
                n = len(spans) + bool(outside.any())
                where = np.where(outside, len(spans), section)
                counts = np.bincount(where, minlength=n)
                crossed = np.bincount(where[crossing], minlength=n)
                rows += [i] * n
                number = np.r_[np.arange(len(spans)), np.full(n - len(spans), OUTSIDE)]
                bounds = np.r_[spans, np.full((n - len(spans), 2), OUTSIDE)]
                for column, value in zip(columns, (number, bounds[:, 0], bounds[:, 1], counts, crossed), strict=True):
                    column.append(value)
            arrays = [pa.array(np.concatenate([np.zeros(0, np.int64), *c]).astype(np.int64)) for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *arrays], ["id", "section", "start", "end", "n_tokens", "n_crossing"])

    return run


def token_counts(docs: DataFrame, path: str, pattern: str, sections_col: str | None = None, rule: str = "most", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per section of every row of ``docs``: id, section (from 0), start, end (characters), n_tokens,
    n_crossing (of these, tokens that cross a boundary).

    Sections are the spans in ``sections_col`` (array of structs start, end; in order, not overlapping) or, without it,
    the lines with their line feeds. Tokens outside all sections are counted in a row with section, start and end -1,
    if there are any. Null texts are empty; an empty text has one line without a token; null or empty lists of
    sections leave everything outside. Repeated rows are counted each, ids may be null, other columns are not read,
    and an empty table gives an empty result.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    columns = {"id": id_col, "text": text_col} | ({"sections": sections_col} if sections_col else {})
    rows = C.only(docs, **columns)
    kind = dict(rows.dtypes)["id"]
    schema = f"id {kind}, section long, start long, end long, n_tokens long, n_crossing long"
    return rows.mapInArrow(_counts(path, pattern, rule, sections_col is not None), schema).withColumnRenamed("id", id_col)


def field_sections(names: list[str], separator: str = "\n"):
    """A text of several columns put together and the spans of each in it: (text, sections) columns."""
    parts = [F.coalesce(F.col(name), F.lit("")) for name in names]
    text = F.concat_ws(separator, *parts)
    spans, at = [], F.lit(0)
    for part in parts:
        end = at + F.length(part)
        spans.append(F.struct(at.cast("int").alias("start"), end.cast("int").alias("end")))
        at = end + len(separator)
    return text, F.array(*spans)

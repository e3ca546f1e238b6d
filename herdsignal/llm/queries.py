"""The registered queries of the subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from herdsignal.llm import (
    bpe,
    embedding_dedup,
    exact_dedup,
    language,
    lexical_search,
    line_dedup,
    ngram_join,
    packing,
    phrases,
    recurrent_lm,
    suffix_dedup,
    token_counts,
    warc,
)
from herdsignal.session import own_folder

#: The vocabularies of the encoding and counting queries.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            own_folder(spark)
            return function(spark, folder)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_ngram_join")
def _(spark, sf):
    return ngram_join.ngram_join(table(spark, sf, "documents"))


@query(
    "op4_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
    FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
          FROM documents)
    WINDOW same AS (PARTITION BY t)
    """,
)
def _(spark, sf):
    found = exact_dedup.exact_dedup(table(spark, sf, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def remainder(column: str, by: int):
    """crc32 of a number's text, divided."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


@query("op2_language_id")
def _(spark, sf):
    documents = table(spark, sf, "documents")
    held_out = remainder("doc_id", 4) == 2
    model = language.fit(documents.where(~held_out))
    return language.predict(documents, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op3_packing")
def _(spark, sf):
    return packing.pack(table(spark, sf, "documents"), WORD_BPE)


@query("op5_bpe")
def _(spark, sf):
    return bpe.digests(table(spark, sf, "documents"), WORD_BPE, twice=True)


@query("op8_suffix_dedup")
def _(spark, sf):
    return suffix_dedup.suffix_dedup(table(spark, sf, "documents"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def _(spark, sf):
    return corpus_pipeline.run(spark, sf)


@query(
    "op6_warc",
    """
    SELECT page_id, strlen(p) AS payload_bytes, digest AS payload_digest,
           CASE WHEN page_id = min(page_id) OVER same THEN 'response' ELSE 'revisit' END AS record_type,
           CAST(CASE WHEN page_id <> min(page_id) OVER same THEN min(page_id) OVER same END AS DOUBLE) AS refers_to
    FROM (
        SELECT page_id, p, (
            SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                       CAST(('0x' || substr(h, 1 + (5 * i) // 4, 2)) AS BIGINT) // [8, 4, 2, 1][1 + i % 4] % 32 + 1, 1), '' ORDER BY i)
            FROM range(32) AS r(i)) AS digest
        FROM (SELECT page_id, coalesce(html, '') AS p, sha1(coalesce(html, '')) || '0' AS h FROM pages)
    )
    WINDOW same AS (PARTITION BY p)
    """,
)
def _(spark, sf):
    read = warc.archive(table(spark, sf, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op7_token_counts")
def _(spark, sf):
    return token_counts.token_counts(table(spark, sf, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


@query("op9_embedding_dedup")
def _(spark, sf):
    return embedding_dedup.embedding_dedup(table(spark, sf, "embeddings"))


@query("op10_recurrent_lm")
def _(spark, sf):
    documents = table(spark, sf, "documents").withColumn("_train", remainder("doc_id", 10) != 0)
    scored = recurrent_lm.score(documents, "_train")
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query(
    "op13_lexical_search",
    r"""
    WITH texts AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    words AS (SELECT doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM texts),
    often AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
    lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY ALL),
    totals AS (SELECT count(*) AS n_all, CAST(sum(n) AS BIGINT) AS l_all FROM lengths),
    asked AS (
        SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    weighted AS (
        SELECT term, CAST(floor(1000 * ln(CAST(2 * n_all + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
        FROM (SELECT term, count(*) AS df FROM often GROUP BY ALL), totals),
    scored AS (
        SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_all) // l_all)))) AS BIGINT) AS score
        FROM asked JOIN often USING (term) JOIN weighted USING (term) JOIN lengths USING (doc_id), totals GROUP BY ALL)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
    WHERE rank <= 50
    """,
)
def _(spark, sf):
    return lexical_search.search(table(spark, sf, "benchmark"), table(spark, sf, "documents"))


@query(
    "op11_line_dedup",
    r"""
    WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
    lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS place FROM split),
    keyed AS (
        SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
    repeated AS (
        SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
    marked AS (SELECT k.*, coalesce(doc_id <> last, FALSE) AS dropped FROM keyed k LEFT JOIN repeated USING (key))
    SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(dropped AS INTEGER)) AS BIGINT) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
    """,
)
def _(spark, sf):
    return line_dedup.line_dedup(table(spark, sf, "documents"))


_PHRASES = r"""
    WITH texts AS (
        SELECT row_number() OVER () AS t, coalesce(lang, 'und') AS lang,
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    pieces AS (SELECT t, lang, unnest(regexp_split_to_array(text, '[.,;:!?
-]')) AS piece FROM texts),
    numbered AS (SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM pieces),
    placed AS (SELECT p, lang, w, unnest(range(1, len(w) + 1)) AS i FROM numbered),
    sizes AS (SELECT lang, CAST(count(*) AS BIGINT) AS n FROM placed GROUP BY lang),
    grams AS (
        SELECT lang, w[i : i + k - 1] AS g, CAST(count(*) AS BIGINT) AS f FROM placed, range(1, 5) AS s(k)
        WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 30),
    cuts AS (
        SELECT c.lang, c.g, c.f AS a, k, l.f AS l, r.f AS r, CAST(CAST(2000000 AS HUGEINT) * c.f // (l.f + r.f) AS BIGINT) AS score
        FROM (SELECT *, unnest(range(1, len(g))) AS k FROM grams WHERE len(g) > 1) c
        JOIN grams l ON l.lang = c.lang AND l.g = c.g[1 : k] JOIN grams r ON r.lang = c.lang AND r.g = c.g[k + 1 : len(c.g)]),
    best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
    inner_parts AS (
        SELECT lang, g[i : i + k - 1] AS g, max(f) AS longer
        FROM (SELECT *, unnest(range(1, len(g) + 1)) AS i FROM grams WHERE len(g) > 2), range(2, 4) AS s(k)
        WHERE k < len(g) AND i + k - 1 <= len(g) GROUP BY ALL)
    SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, a, l, r, n, score FROM (
        SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, n, score,
               row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, array_to_string(b.g, ' ')) AS rank
        FROM best b JOIN sizes USING (lang) LEFT JOIN inner_parts c ON c.lang = b.lang AND c.g = b.g
        WHERE longer IS NULL OR 100 * longer < 80 * a)
    WHERE rank <= 2000
    """


@query("op12_phrases", _PHRASES)
def _(spark, sf):
    return phrases.mine(table(spark, sf, "documents"))

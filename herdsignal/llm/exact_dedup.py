"""Exact duplicates by an extendible-hash index on shared files, in DataFrame operations only.

* Directory: different digests are counted by their first bits. A bucket with more of them than ``capacity`` doubles
  the directory and splits, until every bucket fits or the bits of the directory are used up (then the bucket grows:
  one digest cannot be told apart by more bits).
* Insert: the directory gives every row its bucket, and copies meet within the bucket, where digests and then whole
  texts are compared. Tasks combine their own rows first, so a text with a third of all rows leaves each task once.
* Chain: different texts under one digest are numbered within their bucket by the rows that they keep.
* Files: entries are written ordered by bucket and digest, so owner tasks hold ranges of keys.
* Probe: each row is looked up in its bucket by digest; chained digests are probed by text as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from herdsignal.llm.common import hot_join, lower_ascii, only, unused
from herdsignal.session import cut

#: Distinct texts per bucket, and bits of the digest that the directory may use at most.
CAPACITY, MAX_DEPTH = 100_000, 16


def digest_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def prefix(digest: Column, bits: int) -> Column:
    """The first bits of a hexadecimal digest."""
    return F.shiftright(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), 32 - bits)


def directory(digests: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(cell, bucket, depth): for each used cell of the full directory, its bucket (first bits) and local depth.

    ``digests`` has one row per different digest. Doubling from depth 0 on stops at the first depth at which the
    bucket fits. Counts by cell come from one grouping; the levels above are sums of them.
    """
    cells = digests.groupBy(prefix(F.col("digest"), max_depth).alias("cell")).agg(F.count("*").alias("n"))
    levels = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth"))
    levels = levels.withColumn("bucket", F.expr(f"shiftright(cell, {max_depth} - depth)"))
    sizes = levels.groupBy("depth", "bucket").agg(F.sum("n").alias("n"))
    fits = sizes.where((F.col("n") <= capacity) | (F.col("depth") == max_depth)).select("depth", "bucket")
    found = levels.join(F.broadcast(fits), ["depth", "bucket"])  # fewer than 2 ** (max_depth + 1) rows
    found = found.groupBy("cell").agg(F.min("depth").alias("depth"))
    return found.withColumn("bucket", F.expr(f"shiftleft(shiftright(cell, {max_depth} - depth), {max_depth} - depth)"))


def route(rows: DataFrame, cells: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``rows`` (with a digest) with their bucket and its depth; the directory has at most 2 ** max_depth cells."""
    return rows.withColumn("cell", prefix(F.col("digest"), max_depth)).join(F.broadcast(cells), "cell").drop("cell")


def build_index(texts: DataFrame, cells: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Index of ``texts`` (id, digest, text) under the directory ``cells``: one entry per different text, in files
    ordered by bucket.

    Columns: bucket, depth, digest, chain (0, 1, ... within a digest, by keep_id, then text), chains, keep_id (largest
    id), group_size, and the text itself where a digest has several texts (else null).
    """
    routed = route(texts, cells, max_depth)
    place, kept = ["bucket", "depth", "digest"], [F.max("id").alias("keep_id"), F.count("*").alias("group_size")]
    entries = cut(routed.groupBy(*place, "text").agg(*kept).select(*place, "keep_id", "group_size"), "entries")
    # Texts of one digest: nearly always one, so what collides is found by counts, and only its texts are written.
    crowded = cut(entries.groupBy("bucket", "digest").agg(F.count("*").alias("chains")).where("chains > 1"), "chained")
    single = entries.withColumns({"chain": F.lit(0), "chains": F.lit(1).cast("long"), "text": F.lit(None).cast("string")})
    if not crowded.isEmpty():
        single = single.join(crowded.select("bucket", "digest"), ["bucket", "digest"], "left_anti")
        several = routed.join(crowded, ["bucket", "digest"]).groupBy(*place, "chains", "text").agg(*kept)
        in_chain = Window.partitionBy("bucket", "digest").orderBy("keep_id", "text")
        single = single.unionByName(several.withColumn("chain", F.row_number().over(in_chain) - 1))
    index = single.select(*place, "chain", "chains", "keep_id", "group_size", "text")
    return cut(index.repartitionByRange("bucket", "digest").sortWithinPartitions("bucket", "digest", "chain"), "index")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, digest=digest_of
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256, bucket and chain of its entry.

    Texts are equal when they are identical after lower-casing A-Z; null counts as the empty text. Of equal texts the
    largest id stays; of rows with equal text and id (repeated rows) all are marked as kept. Ids must not be null:
    rows with a null id count in their group and are returned unkept. Very long texts take part whole. An empty
    table gives an empty result; other columns of ``docs`` are neither read nor returned. ``digest`` is a function of
    the normalised text to hexadecimal digits; a weak one only makes chains longer.
    """
    texts = only(docs, id=id_col, text=text_col).withColumn("text", lower_ascii(F.coalesce("text", F.lit(""))))
    texts = texts.withColumn("digest", digest(F.col("text")))
    rows = cut(texts.select("id", "digest", digest_of(F.col("text")).alias("text_sha256")), "rows")
    cells = cut(directory(rows.select("digest").distinct(), capacity, max_depth), "directory")
    index = build_index(texts, cells, max_depth)
    entry, bucket = ["bucket", "digest", "chain", "keep_id", "group_size"], ["bucket", "digest"]
    found = hot_join(route(rows, cells, max_depth).drop("depth"), index.where("chains = 1").select(*entry), bucket, "group_size")
    crowded = index.where("chains > 1").select(*entry, "text")
    if not crowded.isEmpty():
        chained = route(texts, cells, max_depth).join(crowded, [*bucket, "text"])
        found = found.unionByName(chained.select(*entry, "id", digest_of(F.col("text")).alias("text_sha256")))
    return found.select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256", "bucket", "chain"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Of wholly repeated rows and of rows with equal id and equal text one stays, whichever; rows without an id go.
    Two different texts under one id are judged each by itself.
    """
    name = unused(docs, "_sha")
    stay = exact_dedup(docs, id_col, text_col).where("kept").select(F.col(id_col), F.col("text_sha256").alias(name)).distinct()
    named = docs.withColumn(name, digest_of(lower_ascii(F.coalesce(F.col(text_col), F.lit("")))))
    return named.join(stay, [id_col, name], "left_semi").dropDuplicates([id_col, name]).select(*docs.columns)

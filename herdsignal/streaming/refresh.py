"""Derived series kept up to date: new readings redo only the blocks that they can change.

A store is a folder of three tables, all of them only ever appended to:

* ``raw``: one row per series and time, by calendar block;
* ``derived``: the same rows with what ``compute`` adds to them, by calendar block;
* ``log``: per series and block its number of rows and the versions of its raw and its derived rows that count.
  A refresh appends to the log last, so one that breaks off changes nothing.

``compute`` is a chain of row frames that reach ``before`` rows back and ``after`` rows ahead in all. The counts of the
log say which rows of a series lie in which block, so what a block's new rows can change is known without reading a row:
the blocks within reach. These are computed anew from the raw rows of themselves and of the blocks within their reach.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from herdsignal.operators.clean import dedup_first
from herdsignal.operators.series import ANIMAL, BUCKET, with_buckets
from herdsignal.session import cut, scratch

VERSION = "_version"
_STATE = ("rows", "raw", "derived")


class SeriesStore:
    """Stored series and what is derived from them."""

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        compute: Callable[[DataFrame], DataFrame],
        before: int,
        after: int,
        order: Sequence[str],
        keys: Sequence[str] = ANIMAL,
        time: str = "datetime",
        days: int = 7,
    ):
        """``order``: of several rows of a series and time the first by these columns counts, whenever it arrives.
        ``days``: length of a block. Keys and times must not be null.
        """
        self.spark, self.folder, self.compute = spark, folder, compute
        self.before, self.after, self.order = before, after, list(order)
        self.keys, self.time, self.days = list(keys), time, days

    def _stored(self, name: str) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        schema = self.spark.read.parquet(f"{self.folder}/{name}").schema
        kinds = [T.StructField(f.name, T.LongType()) if f.name == BUCKET else f for f in schema]
        return self.spark.read.schema(T.StructType(kinds)).parquet(f"{self.folder}/{name}")

    def _append(self, name: str, df: DataFrame) -> None:
        """Few files per block, sorted by series and time."""
        rows = df.repartitionByRange(BUCKET, *self.keys, self.time).sortWithinPartitions(BUCKET, *self.keys, self.time)
        rows.write.mode("append").option("compression", "zstd").partitionBy(BUCKET).parquet(f"{self.folder}/{name}")

    def log(self) -> DataFrame | None:
        """Per series and block: rows, raw and derived (versions)."""
        log = self._stored("log")
        if log is None:
            return None
        newest = F.max_by(F.struct(*_STATE), VERSION).alias("_newest")
        return log.groupBy(*self.keys, BUCKET).agg(newest).select(*self.keys, BUCKET, "_newest.*")

    def _version(self) -> int:
        """Above all versions of the log. The low bits are drawn, so that what a broken-off refresh has left is never read."""
        log = self._stored("log")
        newest = 0 if log is None else log.agg(F.max(VERSION)).first()[0] >> 32
        return (newest + 1 << 32) + random.getrandbits(32)

    def _rows(self, name: str, state: DataFrame) -> DataFrame:
        """The rows of the blocks of ``state`` in the version that counts; only these blocks' folders are read."""
        wanted = state.where(F.col(name).isNotNull()).select(*self.keys, BUCKET, F.col(name).alias(VERSION))
        blocks = [row[BUCKET] for row in wanted.select(BUCKET).distinct().collect()]  # blocks of the calendar
        return self._stored(name).where(F.col(BUCKET).isin(blocks)).join(wanted, [*self.keys, BUCKET, VERSION], "left_semi")

    def affected(self, state: DataFrame) -> DataFrame:
        """``state`` (keys, block, rows, touched) with ``affected``, blocks whose derived rows may have changed, and
        ``context``, blocks whose raw rows these need.

        All blocks of a series are one row each, and their rows follow each other, so the nearest touched (then
        affected) block on either side decides.
        """
        by_block = Window.partitionBy(*self.keys).orderBy(BUCKET)
        until = by_block.rowsBetween(Window.unboundedPreceding, 0)
        from_here = by_block.rowsBetween(0, Window.unboundedFollowing)

        def within(flag: str, back: int, ahead: int) -> Column:
            """Whether a flagged block ends at most ``back`` rows before this one or begins at most ``ahead`` behind it."""
            last = F.max(F.when(F.col(flag), F.col("_end"))).over(until)
            first = F.min(F.when(F.col(flag), F.col("_begin"))).over(from_here)
            reached = (last + back > F.col("_begin")) | (first - ahead < F.col("_end"))
            return F.coalesce(reached, F.lit(False))

        placed = state.withColumn("_end", F.sum("rows").over(until)).withColumn("_begin", F.col("_end") - F.col("rows"))
        flagged = placed.withColumn("affected", F.col("touched") | within("touched", self.before, self.after))
        return flagged.withColumn("context", F.col("affected") | within("affected", self.after, self.before)).drop("_begin", "_end")

    def refresh(self, readings: DataFrame) -> None:
        """Add readings, in any order of time and as late as they may be, and derive again what they change."""
        with scratch():
            rows = cut(with_buckets(readings, self.time, self.days), "new")
            log = self.log()
            stored = None if log is None else cut(log, "log")
            version = self._version()
            touched = rows.select(*self.keys, BUCKET).distinct()
            merged = rows
            if stored is not None:
                old = self._rows("raw", stored.join(touched, [*self.keys, BUCKET], "left_semi"))
                merged = rows.unionByName(old.drop(VERSION))
            merged = cut(dedup_first(merged, self.order, [*self.keys, BUCKET], self.time), "merged")
            if merged.isEmpty():
                return
            self._append("raw", merged.withColumn(VERSION, F.lit(version).cast("long")))
            counts = merged.groupBy(*self.keys, BUCKET).agg(F.count(F.lit(1)).alias("_n"))
            if stored is None:
                stored = counts.select(*self.keys, BUCKET).withColumns({name: F.lit(None).cast("long") for name in _STATE})
            # Only series with new rows: the others have no block within reach.
            mine = stored.join(touched.select(*self.keys).distinct(), self.keys, "left_semi")
            state = mine.join(counts, [*self.keys, BUCKET], "full").select(
                *self.keys, BUCKET,
                F.coalesce("_n", "rows").alias("rows"),
                F.when(F.col("_n").isNotNull(), version).otherwise(F.col("raw")).cast("long").alias("raw"),
                F.col("_n").isNotNull().alias("touched"),
            )
            state = cut(self.affected(state), "state")
            near = self._rows("raw", state.where("context")).drop(VERSION, BUCKET)
            again = state.where("affected").select(*self.keys, BUCKET)
            derived = with_buckets(self.compute(near), self.time, self.days).join(again, [*self.keys, BUCKET], "left_semi")
            self._append("derived", derived.withColumn(VERSION, F.lit(version).cast("long")))
            done = state.where("affected").select(*self.keys, BUCKET, "rows", "raw", F.lit(version).cast("long").alias("derived"))
            done.withColumn(VERSION, F.lit(version).cast("long")).write.mode("append").parquet(f"{self.folder}/log")

    def table(self) -> DataFrame:
        """The derived rows as they are now."""
        return self._rows("derived", self.log()).drop(VERSION, BUCKET)

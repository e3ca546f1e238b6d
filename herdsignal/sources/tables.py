"""Table sinks and sources: partitioned writes, replacement by key, incremental loads, row slices."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from herdsignal.operators.sequences import training_matrix
from herdsignal.operators.series import ANIMAL, rank_all
from herdsignal.session import cut, release

#: Columns that tables are laid out by in folders; all of them are text.
FOLDER_KEYS = ("organisation_id", "split")


def _laid_out(df: DataFrame) -> DataFrame:
    """Ranges of organisation, animal and time, sorted.

    A task then writes few organisations, a big organisation or a long series is written by many tasks,
    and Parquet statistics on animal and time are narrow.
    """
    order = ["organisation_id", "animal_id", "datetime"]
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def write_readings(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Compressed Parquet by organisation."""
    _laid_out(df).write.mode(mode).option("compression", "zstd").partitionBy("organisation_id").parquet(path)


def replace_partitions(df: DataFrame, path: str) -> None:
    """Replace the organisations that occur in ``df`` and leave the others alone."""
    (
        _laid_out(df)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("organisation_id")
        .parquet(path)
    )


JOURNAL = "_replacement"


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def folders_holding(stored: DataFrame, wanted: DataFrame, keys: Sequence[str], folder: str) -> list[str]:
    """Folders of a stored table that hold one of the keys; only the key columns are read."""
    held = stored.select(folder, *[k for k in keys if k != folder]).join(wanted, list(keys), "left_semi")
    return [row[folder] for row in held.select(folder).distinct().collect()]  # names of folders


def replace_keys(df: DataFrame, path: str, keys: Sequence[str] = ("animal_id",), folder: str = "organisation_id") -> list[str]:
    """Replace all stored rows of the keys that occur in ``df`` by its rows, wherever they are stored.

    Only folders that hold such a key, or get one, are written anew; the files of the others stay as they are. New
    folders are staged beside the old ones under a name that readers pass over. A journal of one small file then makes
    them count, and moves them into place. A write that ends before its journal changes nothing; one that ends later is
    finished by ``finish_replacement``, which the next replacement and ``read_table`` call first. Writers of one table
    must take turns. Returns the folders that were written. Keys and folder names must not be null.
    """
    spark = df.sparkSession
    finish_replacement(spark, path)
    stored = read_table(spark, path)
    fresh = cut(df.select(*stored.columns), "fresh")
    wanted = fresh.select(*keys).distinct()
    gaining = [row[folder] for row in fresh.select(folder).distinct().collect()]
    folders = sorted({*gaining, *folders_holding(stored, wanted, keys, folder)})
    if not folders:
        return []
    kept = stored.where(F.col(folder).isin(folders)).join(wanted, list(keys), "left_anti")
    staging = f"_staged-{uuid.uuid4().hex}"
    _laid_out(kept.unionByName(fresh)).write.option("compression", "zstd").partitionBy(folder).parquet(f"{path}/{staging}")
    release(fresh)
    _publish(spark, path, staging, folder, folders)
    return folders


def _publish(spark: SparkSession, path: str, staging: str, folder: str, folders: list[str]) -> None:
    """Write the journal under another name, rename it, which makes the replacement count, and carry it out."""
    names = [row["name"] for row in spark.createDataFrame([(f,) for f in folders], "f string").select(_folder_name(folder).alias("name")).collect()]
    lines = "\n".join([staging, *names])
    draft, system = _path(spark, f"{path}/{JOURNAL}-{uuid.uuid4().hex}")
    out = system.create(draft)
    out.write(bytearray(lines.encode()))
    out.close()
    system.rename(draft, _path(spark, f"{path}/{JOURNAL}")[0])
    finish_replacement(spark, path)


def _folder_name(folder: str) -> Column:
    """A value as the name of its folder: characters that paths reserve as % and two digits."""
    escaped = F.col("f")
    for sign in "%\"#'*/:=?\\{}[]^":
        escaped = F.replace(escaped, F.lit(sign), F.lit(f"%{ord(sign):02X}"))
    return F.concat(F.lit(f"{folder}="), escaped)


def finish_replacement(spark: SparkSession, path: str) -> bool:
    """Carry out a replacement whose journal is there; each step may have been done already. Says whether one was."""
    journal, system = _path(spark, f"{path}/{JOURNAL}")
    if not system.exists(journal):
        return False
    staging, *names = _lines(system, journal)
    for name in names:
        live, moved, new = (_path(spark, f"{path}/{part}")[0] for part in (name, f"{staging}/{name}.moved", f"{staging}/{name}"))
        if system.exists(new):
            if system.exists(live):
                system.delete(live, True)
            system.rename(new, live)
            system.create(moved).close()
        elif not system.exists(moved) and system.exists(live):
            system.delete(live, True)  # no row is left in this folder
    system.delete(journal, False)
    system.delete(_path(spark, f"{path}/{staging}")[0], True)
    return True


def _lines(system, file) -> list[str]:
    stream = system.open(file)
    try:
        return bytes(stream.readAllBytes()).decode().split("\n")
    finally:
        stream.close()


def upsert_by_key(old: DataFrame, new: DataFrame, keys: Sequence[str] = ANIMAL) -> DataFrame:
    """Old rows whose key is not in ``new``, and all new rows."""
    kept = old.join(new.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def only_new(candidates: DataFrame, stored: DataFrame, keys: Sequence[str], update: bool = False) -> DataFrame:
    """Rows whose key is not stored yet; all of them when updating."""
    if update:
        return candidates
    return candidates.join(stored.select(*keys).distinct(), list(keys), "left_anti")


def incomplete_animals(animals: DataFrame, parts: DataFrame, needed: int = 3) -> DataFrame:
    """Animals with fewer than ``needed`` distinct stored parts."""
    complete = (
        parts.select(*ANIMAL, "part").distinct().groupBy(*ANIMAL).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= needed)
    )
    return animals.join(complete, list(ANIMAL), "left_anti")


def rebuild(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def stored_keys(new: DataFrame, old: DataFrame | None, keys: Sequence[str] = ANIMAL) -> DataFrame:
    """Distinct keys of new and already stored data."""
    found = new.select(*keys)
    return (found if old is None else found.unionByName(old.select(*keys))).distinct()


def export_training(df: DataFrame, path: str, split: DataFrame | None = None) -> None:
    """Write the training matrix with a ``row_id`` from 0, dense within each split where one is given.

    Rows come in the order of organisation, animal and time; Parquet keeps the range of ``row_id``
    of every row group, so a slice reads only the groups it needs.
    """
    matrix = training_matrix(df)
    order = [*ANIMAL, "datetime"]
    if split is None:
        rank_all(matrix, order, "row_id").write.mode("overwrite").option("compression", "zstd").parquet(path)
        return
    # Ranked with the split in front; the first rank of each split (one row each) then makes its ids begin at 0.
    ranked = rank_all(matrix.join(split, list(ANIMAL)), ["split", *order], "_rank")
    firsts = ranked.groupBy("split").agg(F.min("_rank").alias("_first"))
    numbered = ranked.join(F.broadcast(firsts), "split").withColumn("row_id", F.col("_rank") - F.col("_first"))
    numbered.drop("_rank", "_first").write.mode("overwrite").option("compression", "zstd").partitionBy("split").parquet(path)


def row_slice(df: DataFrame, start: int, end: int, row: str = "row_id") -> DataFrame:
    """Rows ``start`` up to but not including ``end``."""
    return df.where((F.col(row) >= start) & (F.col(row) < end))


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A stored table. Keys that are folder names are read as the text they are, never as numbers."""
    finish_replacement(spark, path)
    if schema is None:
        found = spark.read.parquet(path).schema
        schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name in FOLDER_KEYS else f for f in found])
    return spark.read.schema(schema).parquet(path)

"""Session settings, shared scratch tables and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "herdsignal", cores: str | int = "*", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # Small tables should still use all cores of one machine.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    own_folder(spark)
    return spark


def own_folder(spark: SparkSession) -> None:
    """On one machine, name a folder for scratch tables where ``spark.checkpoint.dir`` names none."""
    context = spark.sparkContext
    unset = spark.conf.get("spark.checkpoint.dir", None) is None and context.getCheckpointDir() is None
    if unset and context.master.startswith("local[") or unset and context.master == "local":
        context.setCheckpointDir(tempfile.mkdtemp(prefix="herdsignal-"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return named


def fresh_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/herdsignal/{uuid.uuid4().hex}/{name}"


class Scratch:
    """The scratch tables that ``cut`` makes while a ``scratch`` block runs."""

    def __init__(self) -> None:
        self.made: list[DataFrame] = []
        self.kept: list[DataFrame] = []

    def keep(self, *tables: DataFrame) -> None:
        self.kept += tables


_OPEN: list[Scratch] = []


@contextmanager
def scratch() -> Iterator[Scratch]:
    """Deletes the scratch tables made in the block, all but those to keep, when it ends."""
    block = Scratch()
    _OPEN.append(block)
    try:
        yield block
    finally:
        _OPEN.remove(block)
    kept = {id(table) for table in block.kept}
    release(*(table for table in block.made if id(table) not in kept))
    if _OPEN:
        _OPEN[-1].made += block.kept


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as a scratch table and read it back: later stages neither recompute nor lose it.

    The table stays in the shared folder, because the returned frame reads it; clear ``herdsignal/`` there
    when the job's results are written, or use ``scratch`` or ``release`` as soon as nothing reads it any more.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    if _OPEN:
        _OPEN[-1].made.append(table)
    return table


def release(*tables: DataFrame) -> None:
    """Delete the files of scratch tables made by ``cut``."""
    for table in tables:
        spark = table.sparkSession
        root = f"{shared_folder(spark).rstrip('/')}/herdsignal/".split(":")[-1].lstrip("/")
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            if root not in folder:
                raise ValueError(f"{folder} is no scratch table")
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

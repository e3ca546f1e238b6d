"""Incremental ingest of sensor files: every file is read once, however often the job runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from herdsignal.functions import names
from herdsignal.session import cut, release
from herdsignal.sources import files
from herdsignal.sources.readings import SENSOR_CSV, sensor_columns, sensor_rows

#: Files of a batch. Sensor files are small; a batch costs a listing of its files and its share of the stream's logs.
FILES_PER_TRIGGER = 100_000
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def sensor_stream(spark: SparkSession, folder: str, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    rows = (
        spark.readStream.schema(SENSOR_CSV)
        .option("header", True)
        .option("enforceSchema", False)  # a file with its columns in another order ends the stream
        .option("pathGlobFilter", "*.csv")
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_trigger)
        .csv(folder)
    )
    return sensor_columns(rows)


#: Folder of a checkpoint with the lists of files, and files per list on average, at most.
LISTS, FILES_PER_LIST = "files", 10_000


def _announce(spark: SparkSession, found: DataFrame, lists: str) -> None:
    """Lists the found files that no list has yet. A list that is written stays, even if the job ends before the next."""
    known = spark.read.schema(files.LISTED).parquet(lists).select("path")
    new = cut(found.join(known, "path", "left_anti"), "new")
    n = new.count()
    if n:
        new.repartition(-(-n // FILES_PER_LIST)).write.mode("append").parquet(lists)
    release(new)


def listed_stream(spark: SparkSession, lists: str, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """Readings of the listed files. Tasks open these; the driver holds only the names of the lists."""
    found = (
        spark.readStream.schema(files.LISTED)
        .option("maxFilesPerTrigger", max(1, files_per_trigger // FILES_PER_LIST))
        .option("maxFileAge", "36500d")  # a list that waited long is read as well
        .parquet(lists)
    )
    dealt = found.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    header = tuple(part.split()[0] for part in SENSOR_CSV.split(", "))  # a file with its columns in another order ends the stream
    return sensor_columns(sensor_rows(files.lines(dealt, header), SENSOR_CSV), "_path")


def ingest_new_files(spark: SparkSession, folder: str, target: str, checkpoint: str) -> None:
    """Append the readings of the files not seen before, then stop. The checkpoint knows the seen files.

    Tasks list the files and note the new ones in the checkpoint; the stream reads these lists. Where only Spark can list
    the files (``files.listed``), and with a checkpoint that has no lists yet, the stream's source is the folder itself,
    whose files the driver holds. The stream then looks up each file of a batch again, by default in a task of its own;
    here a task looks up many.
    """
    lists = spark._jvm.org.apache.hadoop.fs.Path(checkpoint, LISTS)
    system = lists.getFileSystem(spark._jsc.hadoopConfiguration())
    has_lists = system.exists(lists)
    begun = system.exists(spark._jvm.org.apache.hadoop.fs.Path(checkpoint, "offsets"))
    found = None if begun and not has_lists else files.listed(spark, folder, names.SUFFIX)
    if found is None and has_lists:
        raise ValueError(f"{checkpoint} has lists of files, but tasks cannot list {folder}")
    if found is not None:
        system.mkdirs(lists)
        _announce(spark, found, lists.toString())
        release(found)
    usual = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, min(int(usual), 4 * spark.sparkContext.defaultParallelism))
    try:
        query = (
            (sensor_stream(spark, folder) if found is None else listed_stream(spark, lists.toString()))
            .writeStream.format("parquet")
            .option("path", target)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(_LISTING, usual)

"""Files that tasks list and read, so that the driver holds neither their names nor their places, however many there are."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from herdsignal.session import cut

#: Bytes of a file that a task reads, at most about as many bytes of text per row, and rows per batch.
PIECE, BLOCK, ROWS = 64 << 20, 1 << 18, 256
#: Names of a folder that are told in a batch.
NAMES = 10_000
#: Files of a task on average, at most; and bytes.
FILES_PER_TASK, BYTES_PER_TASK = 20_000, 128 << 20

LISTED = "path string, size long"
_FOUND = "path string, size long, folder boolean"
_LINES = "file string, head string, lines array<string>"
_BLANK = "".join(map(chr, range(33)))


def open_at(path: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of ``scheme://authority/path`` or ``file:/path``; special characters stay as they are."""
    parts = re.fullmatch(r"([a-zA-Z0-9+.-]+):(?://([^/]*))?(/.*)", path, re.DOTALL)
    if parts is None or parts[1] == "file":
        return fs.LocalFileSystem(), parts[3] if parts else path
    system, root = fs.FileSystem.from_uri(f"{parts[1]}://{parts[2] or ''}/")
    return system, root.rstrip("/") + parts[3]


def _hidden(name: str) -> bool:
    """What Spark's readers pass over."""
    return name.startswith(".") or name.startswith("_") and "=" not in name


def _children(suffix: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (path for batch in batches for path in batch.column(0).to_pylist()):
            system, root = open_at(path)
            store = path.removesuffix(root)
            infos = system.get_file_info(fs.FileSelector(root))
            for low in range(0, len(infos), NAMES):
                found = [(store + i.path, i.size or 0, i.type == fs.FileType.Directory) for i in infos[low : low + NAMES] if not _hidden(i.base_name)]
                found = [row for row in found if row[2] or row[0].endswith(suffix)]
                columns = list(zip(*found, strict=True)) if found else [(), (), ()]
                kinds = (pa.string(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "size", "folder"])

    return run


def listed(spark: SparkSession, folder: str, suffix: str) -> DataFrame | None:
    """(path, size) of the files ``*{suffix}`` below a folder, found by tasks level by level and written to a table.

    None where tasks cannot do that: for patterns, single files, what is not there, and stores that only Spark opens.
    """
    named = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = named.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(named).toString()
    try:
        system, root = open_at(whole)
        here = system.get_file_info(root).type == fs.FileType.Directory
    except (OSError, ValueError, NotImplementedError, pa.ArrowException):
        return None
    if not here or re.search(r"[*?\[\]{}\\]", folder):
        return None
    folders, files = spark.createDataFrame([(whole,)], "path string"), None
    while True:
        found = cut(folders.mapInArrow(_children(suffix), _FOUND), "listing")
        mine = found.where("NOT folder").select("path", "size")
        files = mine if files is None else files.unionByName(mine)
        folders = found.where("folder").select("path")
        if folders.isEmpty():
            return files
        folders = folders.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(files: DataFrame) -> DataFrame:
    """The listed files dealt to as many tasks as a shuffle has, or to more if they are many or large."""
    n, size = files.agg(F.count("*"), F.sum("size")).first()
    least = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(max(least, n // FILES_PER_TASK, (size or 0) // BYTES_PER_TASK))


def lines(files: DataFrame, header: tuple[str, ...] | None = None) -> DataFrame:
    """(file, head, lines) of the listed files, a row for each block of lines: those that are not blank.

    ``head``: a file's first line, in one row of it; null in the others. It is not among the lines. ``file`` is the path,
    percent encoded. ``header``: names that the first lines must give, in any case; another line ends the job.
    """
    pieces = files.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(PIECE).cast("long"))))
    end = F.when(F.col("start") + PIECE < F.col("size"), F.col("start") + PIECE)  # null: what the file has by now
    return pieces.select("path", "start", end.alias("end")).mapInArrow(_read(header), _LINES)


def _blocks(path: str, start: int, end: int | None) -> Iterator[bytes]:
    """Whole lines that begin from ``start`` on, before ``end`` if it is given, a block at a time."""
    system, root = open_at(path)
    with system.open_input_file(root) as opened, io.BufferedReader(opened, BLOCK) as source:
        if start:
            source.seek(start - 1)
            source.readline()
        at = source.tell()
        while end is None or at < end:
            block = source.read(BLOCK if end is None else min(BLOCK, end - at))
            if not block:
                return
            if not block.endswith(b"\n"):
                block += source.readline()
            at += len(block)
            yield block


def _lines(path: str, start: int, end: int | None, header: tuple[str, ...] | None) -> Iterator[tuple[str | None, list[str]]]:
    begins = start == 0
    for i, block in enumerate(_blocks(path, start, end)):
        text = block.decode("utf-8", "replace")
        if start == 0 and i == 0:
            text = text.removeprefix("\ufeff")
        some = [line for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n") if line.strip(_BLANK)]
        head = some.pop(0) if begins and some else None
        if head is not None:
            begins = False
            if header is not None and tuple(name.strip('"').lower() for name in head.split(",")) != header:
                raise ValueError(f"{path}: the header is {head[:200]!r}, not {','.join(header)}")
        if some or head is not None:
            yield head, some


def _read(header: tuple[str, ...] | None):
    def batch(rows: list[tuple[str, str | None, list[str]]]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "head", "lines"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = 0, []
        for asked in batches:
            for path, start, end in zip(*(c.to_pylist() for c in asked.columns), strict=True):
                file = quote(path, safe="/:")
                for head, some in _lines(path, start, end, header):
                    rows.append((file, head, some))
                    held += sum(map(len, some))
                    if len(rows) >= ROWS or held >= 4 * BLOCK:
                        yield batch(rows)
                        held, rows = 0, []
        if rows:
            yield batch(rows)

    return run

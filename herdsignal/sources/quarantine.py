"""Files that cannot be read through are left out as a whole and listed with the reason."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs, parquet
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from herdsignal.session import cut
from herdsignal.sources.files import open_at
from herdsignal.sources.readings import read_sensor_csv

PIECE = 1 << 20


def _try_parquet(system: fs.FileSystem, path: str) -> str | None:
    """Footer and every page, a batch of rows at a time."""
    with system.open_input_file(path) as source:
        for _ in parquet.ParquetFile(source).iter_batches(batch_size=1 << 14):
            pass
    return None


def _try_csv(system: fs.FileSystem, path: str) -> str | None:
    """Text in UTF-8 below a header that names ``ts``, whose last line has as many fields as the header.

    A last line that breaks off within its last field cannot be told from a whole one.
    """
    decoder = codecs.getincrementaldecoder("utf-8")()
    header, in_header, commas, filled, last = "", True, 0, False, 0
    with system.open_input_stream(path, compression=None) as source:
        while True:
            piece = source.read(PIECE)
            first, *others = decoder.decode(piece, final=not piece).split("\n")
            if in_header and len(header) <= PIECE:
                header += first
            in_header = in_header and not others
            for i, part in enumerate((first, *others)):
                if i:
                    commas, filled = 0, False
                commas, filled = commas + part.count(","), filled or bool(part.strip())
                last = commas if filled else last
            if not piece:
                break
    if "ts" not in [name.strip().strip('"') for name in header.split(",")]:
        return "no header line that names ts"
    return None if last == header.count(",") else "the last line is cut off"


_TRIES = {"parquet": _try_parquet, "csv": _try_csv}


def unreadable_files(spark: SparkSession, folder: str, kind: str = "parquet") -> DataFrame:
    """``(path, file, reason)`` of the files ``*.{kind}`` below ``folder`` that cannot be read through.

    Every file is read once, in tasks that hold as many files as a scan would; a table of the failures is written.
    Files without a byte hold nothing and are no failures.
    ``file`` is the path as ``_metadata.file_path`` spells it.
    """
    attempt = _TRIES[kind]

    def tried(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            failures = []
            for path, file in zip(part["path"], part["file"]):
                try:
                    reason = attempt(*open_at(path))
                except FileNotFoundError:
                    raise  # the listing is out of date: not a broken file
                except (OSError, ValueError, pa.ArrowException) as error:
                    reason = f"{type(error).__name__}: {error}"[:500]
                if reason is not None:
                    failures.append((path, file, reason))
            yield pd.DataFrame(failures, columns=["path", "file", "reason"])

    below = {"pathGlobFilter": f"*.{kind}", "recursiveFileLookup": True}
    listed = spark.read.format("binaryFile").options(**below).load(folder)
    named = listed.select("path", F.col("_metadata.file_path").alias("file"))
    return cut(named.mapInPandas(tried, "path string, file string, reason string"))


def read_parquet(spark: SparkSession, folder: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """The rows of all files that can be read through, and the list of the others.

    Of a file that breaks off in the middle no row is kept, not even those before the damage.
    """
    failures = unreadable_files(spark, folder)
    rows = spark.read.schema(schema).option("ignoreCorruptFiles", True).option("pathGlobFilter", "*.parquet").parquet(folder)
    named = rows.select("*", F.col("_metadata.file_path").alias("_file"))
    return named.join(failures.select(F.col("file").alias("_file")), "_file", "left_anti").drop("_file"), failures


def read_sensor_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """``read_sensor_csv`` of all files that can be read through, and the list of the others."""
    failures = unreadable_files(spark, folder, "csv")
    return read_sensor_csv(spark, folder, failures), failures

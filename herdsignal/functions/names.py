"""Names of sensor files: ``{animal_id}|{chunk}.csv``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SEPARATOR = "|"
SUFFIX = ".csv"


def plain(file_path: Column) -> Column:
    """A path without percent codes. Spark's file metadata is percent encoded; a plus sign is literal there."""
    return F.url_decode(F.replace(file_path, F.lit("+"), F.lit("%2B")))


def sensor_name(file_path: Column) -> Column:
    """The path element ``{animal_id}|{chunk}.csv``, be it a file or a folder of part files."""
    return F.regexp_extract(plain(file_path), r"([^/]*\|[^/|]*\.csv)(/|$)", 1)


def is_sensor_file(name: Column) -> Column:
    return F.endswith(name, F.lit(SUFFIX))


def animal_of(name: Column) -> Column:
    return F.split_part(name, F.lit(SEPARATOR), F.lit(1))


def chunk_of(name: Column) -> Column:
    chunk = F.split_part(name, F.lit(SEPARATOR), F.lit(2))
    return F.replace(chunk, F.lit(SUFFIX), F.lit("")).try_cast("int")


def belongs_to(name: Column, animal_id: Column) -> Column:
    """Whole-id match, so that ``a1`` does not take the files of ``a10``."""
    return is_sensor_file(name) & (animal_of(name) == animal_id)

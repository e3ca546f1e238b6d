"""Sensor readings: CSV drops, tables, ranges, overlapping time segments."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from herdsignal.functions import names, time as T
from herdsignal.functions.numbers import no_nan
from herdsignal.functions.time import MICROS_PER_DAY
from herdsignal.operators.clean import dedup_first
from herdsignal.operators.joins import organisation_of
from herdsignal.operators.series import ANIMAL
from herdsignal.sources import files

# Columns of a sensor file, keys of the feature table, segment lengths, default span.
SENSOR_CSV = "ts BIGINT, act DOUBLE, temp DOUBLE"
HEADER_LINE = r'(^|,)\s*"?ts"?\s*(,|$)'
MOST_LAYOUTS = 100
FEATURE_KEYS = ("organisation_id", "group_id", "animal_id", "datetime")
SEGMENT_DAYS = 399
SEGMENT_STEP_DAYS = 398
SPAN = ("2018-04-01", "2020-04-01")


def sensor_columns(rows: DataFrame, path: str = "_metadata.file_path") -> DataFrame:
    """Animal and chunk from the file name, time from epoch seconds, null for NaN."""
    name = names.sensor_name(F.col(path))
    return rows.select(
        names.animal_of(name).alias("animal_id"),
        names.chunk_of(name).alias("chunk"),
        T.from_epoch_seconds(F.col("ts")).alias("datetime"),
        no_nan(F.col("act")).alias("act"),
        no_nan(F.col("temp")).alias("temp"),
    )


def read_sensor_csv(spark: SparkSession, folder: str, without: DataFrame | None = None) -> DataFrame:
    """All files ``{animal}|{chunk}.csv`` below a folder, but for those whose ``file`` is in ``without``; columns by
    the names in a file's header line.

    Lines that name ``ts`` are headers. Usually there is one layout; with several (at most MOST_LAYOUTS) the files
    of each are read by it. Missing columns are null, others are left out. Tasks list and read the files where they can
    (``files.listed``); otherwise Spark's readers do, whose driver holds the list of all files.
    """
    found = files.listed(spark, folder, names.SUFFIX)
    lines, rows = _by_readers(spark, folder, without) if found is None else _by_tasks(found, without)
    layouts = sorted(row["value"] for row in lines.select("value").distinct().limit(MOST_LAYOUTS + 1).collect())
    if len(layouts) > MOST_LAYOUTS:
        raise ValueError(f"more than {MOST_LAYOUTS} layouts of sensor files")
    kinds = dict(part.split() for part in SENSOR_CSV.split(", "))
    parts = None
    for layout in layouts or [",".join(kinds)]:
        given = [name.strip().strip('"') for name in layout.split(",")]
        typed = [(name, kinds[name]) if name in kinds and name not in given[:i] else (f"_c{i}", "STRING") for i, name in enumerate(given)]
        read = rows(", ".join(f"`{n}` {k}" for n, k in typed))
        if len(layouts) > 1:
            mine = lines.where(F.col("value") == layout).select("_file").distinct()
            read = read.join(mine, F.col("_path") == F.col("_file"), "left_semi")
        absent = {name: F.lit(None).cast(kind) for name, kind in kinds.items() if name not in given}
        part = sensor_columns(read.withColumns(absent) if absent else read, "_path")
        parts = part if parts is None else parts.unionByName(part)
    return parts


#: Header lines (value, _file), and the rows below the files' first lines, with ``_path``, by a schema.
_Read = tuple[DataFrame, Callable[[str], DataFrame]]


def _by_tasks(found: DataFrame, without: DataFrame | None) -> _Read:
    if without is not None:
        path = F.regexp_replace(names.plain(F.col("file")), "^file:/+", "file:/")
        found = found.join(without.select(path.alias("path")), "path", "left_anti")
    blocks = files.lines(files.spread(found))
    lines = blocks.select(F.explode(F.concat(F.array("head"), "lines")).alias("value"), F.col("file").alias("_file"))
    return lines.where(F.col("value").rlike(HEADER_LINE)), lambda schema: sensor_rows(blocks, schema)


def sensor_rows(blocks: DataFrame, schema: str) -> DataFrame:
    """The lines of blocks (``files.lines``) by a schema, with the file as ``_path``."""
    lines = blocks.select(F.col("file").alias("_path"), F.explode("lines").alias("_line"))
    return lines.select(F.from_csv("_line", schema).alias("_row"), "_path").select("_row.*", "_path")


def _by_readers(spark: SparkSession, folder: str, without: DataFrame | None) -> _Read:
    below = {"pathGlobFilter": f"*{names.SUFFIX}", "recursiveFileLookup": True}
    left = lambda rows, path: rows if without is None else rows.join(without, F.col(path) == without["file"], "left_anti")
    lines = spark.read.options(**below).text(folder).where(F.col("value").rlike(HEADER_LINE))
    lines = left(lines.select("value", F.col("_metadata.file_path").alias("_file")), "_file")

    def rows(schema: str) -> DataFrame:
        read = spark.read.schema(schema).options(**below).csv(folder, header=True)
        return left(read.select("*", F.col("_metadata.file_path").alias("_path")), "_path")

    return lines, rows


def consolidate(csv: DataFrame, animals: DataFrame) -> DataFrame:
    """Attach the organisation (one per animal), merge the chunks and keep the first reading of each time."""
    return dedup_first(organisation_of(csv, animals), ["chunk", "act", "temp"]).drop("chunk")


def readings_between(
    readings: DataFrame,
    first,
    last,
    animals: Sequence[str] | None = None,
    metrics: Sequence[str] = ("act", "temp"),
) -> DataFrame:
    """Chosen metrics in a closed time range, optionally of some animals only."""
    chosen = readings.where(F.col("datetime").between(F.lit(first), F.lit(last)))
    if animals is not None:
        chosen = chosen.where(F.col("animal_id").isin(*animals))
    return chosen.select(*ANIMAL, "datetime", *metrics)


def series_of(readings: DataFrame, organisation_id: str, animal_id: str) -> DataFrame:
    """Readings of one animal; an unknown animal has none."""
    return readings.where((F.col("organisation_id") == organisation_id) & (F.col("animal_id") == animal_id))


def metric_of(readings: DataFrame, animal_id: str, metric: str = "act") -> DataFrame:
    return readings.where(F.col("animal_id") == animal_id).select("datetime", metric)


def load_features(
    features: DataFrame, organisation_ids: Sequence[str] | None = None, ordered: bool = True
) -> DataFrame:
    """The feature table, optionally of some organisations, sorted by its keys."""
    if organisation_ids is not None:
        features = features.where(F.col("organisation_id").isin(*organisation_ids))
    return features.orderBy(*FEATURE_KEYS) if ordered else features


def load_animal(features: DataFrame, animal_id: str, with_keys: bool = True) -> DataFrame:
    one = features.where(F.col("animal_id") == animal_id)
    return one if with_keys else one.drop("organisation_id", "group_id", "animal_id")


def _micros(value) -> Column:
    column = value if isinstance(value, Column) else F.lit(value).cast("timestamp_ntz")
    return T.to_micros(column)


def segment_count(first, last, days: int = SEGMENT_DAYS, step: int = SEGMENT_STEP_DAYS) -> Column:
    """Full segments while at least ``days`` remain, then the rest."""
    span = _micros(last) - _micros(first)
    full = F.floor((span - days * MICROS_PER_DAY) / (step * MICROS_PER_DAY)) + 1
    return F.greatest(full, F.lit(0)) + 1


def segments(spans: DataFrame, days: int = SEGMENT_DAYS, step: int = SEGMENT_STEP_DAYS) -> DataFrame:
    """Overlapping segments of each ``(first, last)``; every other column is kept."""
    first, last = F.col("first"), F.col("last")
    count = segment_count(first, last, days, step)
    numbered = spans.withColumn("_count", count).withColumn(
        "segment", F.explode(F.sequence(F.lit(0), F.col("_count") - 1))
    )
    start = T.to_micros(first) + F.col("segment") * (step * MICROS_PER_DAY)
    full = F.col("segment") < F.col("_count") - 1
    return numbered.withColumns(
        {
            "segment_start": T.from_micros(start),
            "segment_end": F.when(full, T.from_micros(start + days * MICROS_PER_DAY)).otherwise(last),
        }
    ).drop("_count")


def in_segments(
    readings: DataFrame, first, last, days: int = SEGMENT_DAYS, step: int = SEGMENT_STEP_DAYS
) -> DataFrame:
    """Each reading once per segment that holds it (both ends included).

    Segments are evenly spaced, so their numbers follow from the time by arithmetic; no join.
    ``first`` and ``last`` are values or columns of the readings.
    """
    offset = T.to_micros(F.col("datetime")) - _micros(first)
    count = segment_count(first, last, days, step)
    lowest = F.greatest(F.ceil((offset - days * MICROS_PER_DAY) / (step * MICROS_PER_DAY)), F.lit(0))
    highest = F.least(F.floor(offset / (step * MICROS_PER_DAY)), count - 1)
    inside = (offset >= 0) & (T.to_micros(F.col("datetime")) <= _micros(last))
    # The rest segment may be shorter than a step, so the earliest segment is bounded by the count too.
    return readings.where(inside).withColumn(
        "segment", F.explode(F.sequence(F.least(lowest, count - 1), highest))
    )


#: Levels of the cells that cover intervals are a multiple of this apart, so that a reading lies in few of them.
LEVEL_STEP = 2
#: Cells longer than this many days are dealt to as many parts, so that a long series is no single task.
LONG_CELL_DAYS, CELL_PARTS = 32, 8


def in_intervals(
    readings: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str] = ANIMAL,
    first: str = "first",
    last: str = "last",
    time: str = "datetime",
) -> DataFrame:
    """Each reading once per interval of its key that holds it, both ends included, with the interval's columns.

    Intervals of a key may be of any length and overlap as they like. An interval is covered by at most ten cells of
    the calendar whose length is a power of two of microseconds, four to eight times shorter than itself (sixteen
    with ``LEVEL_STEP``); a reading lies in one cell of each level that occurs, and both meet by an equality join on
    key, level and cell. Readings and intervals without times, and intervals that end before they begin, give nothing.
    Columns of the intervals other than keys must have names of their own.
    """
    begin, end = T.to_micros(F.col(first)), T.to_micros(F.col(last))
    sized = intervals.withColumns({"_begin": begin, "_end": end}).where(F.col("_end") >= F.col("_begin"))
    # The length's bits, less two, rounded down to a level.
    bits = F.length(F.bin(F.col("_end") - F.col("_begin")))
    level = F.greatest(F.floor((bits - 2) / LEVEL_STEP) * LEVEL_STEP, F.lit(0)).cast("int")
    placed = sized.withColumn("_level", level)
    levels = sorted(row["_level"] for row in placed.select("_level").distinct().collect())  # at most 32
    cell = lambda micros: F.expr(f"shiftright({micros}, _level)")
    long = F.col("_level") >= (LONG_CELL_DAYS * MICROS_PER_DAY).bit_length() - 1
    cells = placed.withColumn("_cell", F.explode(F.sequence(cell("_begin"), cell("_end"))))
    parts = F.when(long, F.sequence(F.lit(0), F.lit(CELL_PARTS - 1))).otherwise(F.array(F.lit(0)))
    cells = cells.withColumn("_part", F.explode(parts))
    asked = readings.withColumn("_at", T.to_micros(F.col(time))).where(F.col("_at").isNotNull())
    asked = asked.withColumn("_level", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>")))
    asked = asked.withColumn("_cell", cell("_at")).withColumn("_part", F.when(long, F.pmod(F.xxhash64("_at"), F.lit(CELL_PARTS))).otherwise(0).cast("int"))
    joined = asked.join(cells, [*keys, "_level", "_cell", "_part"])
    return joined.where((F.col("_at") >= F.col("_begin")) & (F.col("_at") <= F.col("_end"))).drop("_level", "_cell", "_part", "_at", "_begin", "_end")

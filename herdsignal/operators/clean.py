"""Cleaning: time repair, grid, duplicates, filters, column pruning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from herdsignal.functions import time as T
from herdsignal.functions.numbers import no_nan
from herdsignal.operators.series import ANIMAL

# Plausibility and history thresholds, and the columns dropped for boosted trees.
MIN_TEMPERATURE = 30
MIN_HISTORY_ROWS = 30 * 144
REQUIRED = ("DIM", "act", "act_group_mean")
NOT_FOR_TREES = ("race", "country", "temp", "temp_filtered", "pregnant", "cyclic", "inseminated", "deleted")
NO_GROUP = "N/A"


def repair_time(df: DataFrame, text: str = "ts", time: str = "datetime") -> DataFrame:
    """Read ``text`` as a timestamp or as epoch seconds; unreadable times become null."""
    return df.withColumn(time, T.repaired_time(F.col(text)))


def split_unreadable(df: DataFrame, time: str = "datetime") -> tuple[DataFrame, DataFrame]:
    """Rows with a time, and the rows to set aside."""
    return df.where(F.col(time).isNotNull()), df.where(F.col(time).isNull())


def nulls_for_nan(df: DataFrame, columns: Sequence[str] = ("act", "temp")) -> DataFrame:
    return df.withColumns({name: no_nan(F.col(name)) for name in columns})


def snap_to_grid(df: DataFrame, minutes: int = 10, time: str = "datetime", original: str = "read_at") -> DataFrame:
    """Move ``time`` to the grid and keep the time before that in ``original``."""
    return df.withColumn(original, F.col(time)).withColumn(time, T.snap(F.col(time), minutes))


def dedup_first(
    df: DataFrame,
    order: Sequence[str],
    keys: Sequence[str] = ANIMAL,
    time: str = "datetime",
) -> DataFrame:
    """The first row in ``order`` for each key and time; missing values come last, other columns break ties.

    An aggregate and not a ranking window: copies are already reduced before the shuffle, and the
    rows of one animal spread over as many tasks as it has ticks.
    """
    rest = [name for name in df.columns if name not in (*keys, time)]
    kinds = dict(df.dtypes)
    ties = [name for name in rest if name not in order and not kinds[name].startswith(("map", "struct", "array"))]
    ranks = [part for name in (*order, *ties) for part in (F.col(name).isNull().alias(f"{name}_missing"), F.col(name))]
    first = F.min_by(F.struct(*rest), F.struct(*ranks)).alias("_first")
    return df.groupBy(*keys, time).agg(first).select(*keys, time, "_first.*")


def on_grid(df: DataFrame, minutes: int = 10, ties: Sequence[str] = ()) -> DataFrame:
    """One row per animal and tick: the earliest reading that falls on the tick."""
    snapped = snap_to_grid(df, minutes)
    return dedup_first(snapped, ["read_at", *ties])


def default_group(df: DataFrame, reject_missing: bool = True) -> DataFrame:
    """Reject animals without a group, or name their group ``N/A``."""
    if reject_missing:
        return df.where(F.col("group_id").isNotNull())
    return df.withColumn("group_id", F.coalesce("group_id", F.lit(NO_GROUP)))


def required(df: DataFrame, columns: Sequence[str] = REQUIRED) -> DataFrame:
    return df.na.drop(subset=list(columns))


def plausible(df: DataFrame, min_temp: float = MIN_TEMPERATURE) -> DataFrame:
    return df.where(F.col("temp") > min_temp)


def min_history(df: DataFrame, rows: int = MIN_HISTORY_ROWS, keys: Sequence[str] = ANIMAL) -> DataFrame:
    """Keep the series with at least ``rows`` rows.

    The counts are aggregated before the shuffle; the semi join can be split by the adaptive planner
    when one series is very long.
    """
    long_enough = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= rows)
    return df.join(long_enough.select(*keys), list(keys), "left_semi")


def with_any_heat(df: DataFrame, keys: Sequence[str] = ANIMAL) -> DataFrame:
    """Keep the animals that have at least one heat label."""
    heat = F.col("pregnant") | F.col("cyclic") | F.col("inseminated")
    labelled = df.where(heat).select(*keys).distinct()
    return df.join(labelled, list(keys), "left_semi")


def date_slice(df: DataFrame, first, last, time: str = "datetime") -> DataFrame:
    """From the start of day ``first`` to the end of day ``last``."""
    return df.where(T.between_days(F.col(time), first, last))


def key_slice(df: DataFrame, **keys) -> DataFrame:
    """Rows of one organisation, group or animal."""
    for name, value in keys.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def for_trees(df: DataFrame) -> DataFrame:
    return df.drop(*NOT_FOR_TREES)


def drop_series(df: DataFrame, blocked: DataFrame, keys: Sequence[str] = ANIMAL) -> DataFrame:
    """Remove the series listed in ``blocked``."""
    return df.join(blocked.select(*keys).distinct(), list(keys), "left_anti")

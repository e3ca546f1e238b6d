"""Features: spike-filtered temperature, group activity, days in milk, heat feature."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, WindowSpec, functions as F, types as T

from herdsignal.operators.clean import NO_GROUP
from herdsignal.operators.series import ANIMAL, packed, rolling, unpacked

# Frames in rows of ten minutes, and the spike factor.
MEDIAN_FRAME = (-144, 143)
VARIANCE_FRAME = (-287, 0)
MEAN_FRAME = (-36, 35)
FILLER_FRAME = (-18, 17)
HEAT_FRAME = (-11, 0)
SPIKE_FACTOR = 0.55
MIN_GROUP_ANIMALS = 5

def trailing_variance(frame: DataFrame, column: str, name: str, window: WindowSpec, rows: int) -> DataFrame:
    """Sample variance of the last ``rows`` rows; null below two values.

    Each frame is added up anew: a difference of running sums would keep the rounding error of a value that has
    left the frame, for one glitch of 1e9 on all rows behind it.
    """
    return frame.withColumn(name, F.var_samp(column).over(window.rowsBetween(1 - rows, 0)))


def _medians(frame: tuple[int, int]):
    """For an array of values the median of each row frame; missing values are skipped."""
    before, after = -frame[0], frame[1]

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def medians(blocks: pd.Series) -> pd.Series:
        results = []
        for values in blocks:
            # A trailing window moved forward: the rows ahead of the last one count as missing.
            padded = np.append(np.asarray(values, dtype=float), np.full(after, np.nan))
            trailing = pd.Series(padded).rolling(before + 1 + after, min_periods=1).median()
            found = trailing.to_numpy()[after:]
            results.append([None if np.isnan(v) else v for v in found.tolist()])
        return pd.Series(results)

    return medians


STATISTICS = ("temp_median", "temp_mean", "temp_var")


def _temperature_statistics(
    part: DataFrame, window: WindowSpec, keys: Sequence[str], row: str, wanted: Sequence[str] = STATISTICS
) -> DataFrame:
    """Median, mean and variance of the temperature, or some of them.

    Spark has no framed median. Sorting the collected values of every frame in SQL took twice to three
    times as long on 580,000 rows as one Arrow pass over the values of each block.
    """
    if "temp_median" in wanted:
        part = unpacked(packed(part, keys, row), keys, _medians(MEDIAN_FRAME)(F.col("_rows.temp")), "temp_median")
    if "temp_mean" in wanted:
        part = part.withColumn("temp_mean", F.avg("temp").over(window.rowsBetween(*MEAN_FRAME)))
    return trailing_variance(part, "temp", "temp_var", window, -VARIANCE_FRAME[0] + 1) if "temp_var" in wanted else part


def temperature_statistics(df: DataFrame, wanted: Sequence[str] = STATISTICS, **series) -> DataFrame:
    """Rolling median, sample variance and mean of the temperature; only the wanted ones are computed."""
    keys, row = series.get("keys", ANIMAL), series.get("row") or "_row"
    return rolling(df, lambda part, w: _temperature_statistics(part, w, keys, row, wanted), before=287, after=143, **series)


def filter_temperature(
    df: DataFrame, factor: float = SPIKE_FACTOR, keep_statistics: bool = False, **series
) -> DataFrame:
    """Replace drinking spikes.

    A reading below ``median - factor * variance`` is a spike. Spikes first take the rolling mean;
    then they take the rolling mean of the series repaired that way. Both passes run on the same
    blocks, whose margins cover the two frames together. Temperatures must be finite or null
    (``clean.nulls_for_nan``).
    """
    keys, row = series.get("keys", ANIMAL), series.get("row") or "_row"

    def two_passes(part: DataFrame, window: WindowSpec) -> DataFrame:
        bound = F.col("temp_median") - F.col("temp_var") * factor
        filler = F.avg("_repaired").over(window.rowsBetween(*FILLER_FRAME))
        result = (
            _temperature_statistics(part, window, keys, row)
            .withColumn("spike", F.coalesce(F.col("temp") < bound, F.lit(False)))
            .withColumn("_repaired", F.when(F.col("spike"), F.col("temp_mean")).otherwise(F.col("temp")))
            .withColumn("temp_filtered", F.when(F.col("spike"), filler).otherwise(F.col("_repaired")))
            .drop("_repaired")
        )
        return result if keep_statistics else result.drop("temp_median", "temp_var", "temp_mean", "spike")

    return rolling(df, two_passes, before=287 + 18, after=143 + 17, **series)


GROUP_TICK = ["organisation_id", "group_id", "datetime"]


def group_means(df: DataFrame, min_animals: int = MIN_GROUP_ANIMALS) -> DataFrame:
    """Mean activity of a group on each tick on which enough of its animals have a value."""
    in_group = F.col("act").isNotNull() & (F.col("group_id") != NO_GROUP)
    return (
        df.where(in_group)
        .groupBy(*GROUP_TICK)
        .agg(F.count("act").alias("_animals"), F.avg("act").alias("_mean"))
        .where(F.col("_animals") >= min_animals)
        .drop("_animals")
    )


def attach_group_mean(df: DataFrame, means: DataFrame) -> DataFrame:
    joined = df.join(means, GROUP_TICK, "left")
    return joined.withColumn("act_group_mean", F.when(F.col("act").isNotNull(), F.col("_mean"))).drop("_mean")


def group_mean(df: DataFrame, min_animals: int = MIN_GROUP_ANIMALS) -> DataFrame:
    """The group's mean activity on every row that has a value itself.

    Aggregated before the shuffle and joined back on the tick, so that a big group is spread by time
    and a big tick can still be split by the adaptive skew join.
    """
    return attach_group_mean(df, group_means(df, min_animals))


def heat_feature(df: DataFrame, frame: tuple[int, int] = HEAT_FRAME, **series) -> DataFrame:
    """Rolling sum of the activity above the group mean."""

    def add(part: DataFrame, window: WindowSpec) -> DataFrame:
        above = F.col("act") - F.col("act_group_mean")
        return part.withColumn("heat_feature", F.sum(above).over(window.rowsBetween(*frame)))

    return rolling(df, add, before=-frame[0], after=frame[1], **series)


def milk_days(days: DataFrame, calvings: DataFrame, keys: Sequence[str] = ANIMAL, name: str = "DIM") -> DataFrame:
    """Days since the last calving, for the distinct ``_date`` values of each animal after its first calving.

    Both sides are distinct days, so the as-of window sees at most one row per calendar day of an
    animal. ``calvings`` has the keys and ``calved_at``.
    """
    calved = F.to_date("calved_at")
    births = calvings.where(calved.isNotNull()).select(*keys, calved.alias("_date"), calved.alias("_calved")).distinct()
    asked = days.select(*keys, "_date", F.lit(None).cast("date").alias("_calved")).distinct()
    timeline = asked.unionByName(births).groupBy(*keys, "_date").agg(F.max("_calved").alias("_calved"))
    so_far = Window.partitionBy(*keys).orderBy("_date").rowsBetween(Window.unboundedPreceding, 0)
    last_calving = F.last("_calved", ignorenulls=True).over(so_far)
    per_day = timeline.select(*keys, "_date", F.datediff("_date", last_calving).alias(name))
    return per_day.where(F.col(name).isNotNull())


def days_in_milk(df: DataFrame, calvings: DataFrame, keys: Sequence[str] = ANIMAL, name: str = "DIM") -> DataFrame:
    """Days since the last calving on or before the day of each reading; null before the first one.

    Computed per day and joined back on animal and day.
    """
    dated = df.withColumn("_date", F.to_date("datetime"))
    return dated.join(milk_days(dated, calvings, keys, name), [*keys, "_date"], "left").drop("_date")

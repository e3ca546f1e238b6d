"""Row-based windows over long series that may be very uneven.

One animal may hold a large share of all rows, so no window here sorts a whole series in one task:

* ``number_rows`` numbers a series through counts per calendar bucket: the counts are added up per
  series (a few rows each), the rows themselves are only ever sorted within one bucket.
* ``rolling`` cuts the numbered series into blocks of equal row count and gives every block the rows
  before and after it that its frames reach into, so a bounded ROWS frame sees what it would see in
  the whole series.
* ``running_last`` and ``running_sum`` carry one value per bucket into the following buckets.

A bucket on a ten-minute grid holds at most ``144 * bucket_days`` rows of a series.
Keys and times must not be null (``clean.split_unreadable`` sets such rows aside).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from herdsignal.functions.time import day_number

ANIMAL = ("organisation_id", "animal_id")
BUCKET = "_bucket"
BLOCK = "_block"


def with_buckets(df: DataFrame, time: str, bucket_days: int) -> DataFrame:
    return df.withColumn(BUCKET, day_number(F.col(time), bucket_days))


def number_rows(
    df: DataFrame,
    keys: Sequence[str] = ANIMAL,
    time: str = "datetime",
    ties: Sequence[str] = (),
    row: str = "row_no",
    total: str | None = None,
    bucket_days: int = 7,
) -> DataFrame:
    """Number the rows of each series from 0 in time order; ``total`` names a column for its length."""
    bucketed = with_buckets(df, time, bucket_days)
    counts = bucketed.groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("_n"))
    by_bucket = Window.partitionBy(*keys).orderBy(BUCKET)
    earlier = by_bucket.rowsBetween(Window.unboundedPreceding, -1)
    offsets = [F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")]
    if total:
        offsets.append(F.sum("_n").over(Window.partitionBy(*keys)).alias(total))
    starts = counts.select(*keys, BUCKET, *offsets)
    in_bucket = Window.partitionBy(*keys, BUCKET).orderBy(time, *ties)
    return (
        bucketed.join(starts, [*keys, BUCKET])
        .withColumn(row, F.col("_offset") + F.row_number().over(in_bucket) - 1)
        .drop("_offset", BUCKET)
    )


def rolling(
    df: DataFrame,
    compute: Callable[[DataFrame, WindowSpec], DataFrame],
    before: int,
    after: int,
    keys: Sequence[str] = ANIMAL,
    time: str = "datetime",
    ties: Sequence[str] = (),
    row: str | None = None,
    block_rows: int = 4096,
    bucket_days: int = 7,
) -> DataFrame:
    """Apply window expressions whose frames reach ``before`` rows back and ``after`` rows ahead.

    ``compute`` gets the frame and a window specification without a frame, and adds columns.
    Frames of several chained steps add up in ``before`` and ``after``. A frame already numbered by
    ``number_rows`` names its columns in ``row`` and ``{row}_total`` and is not numbered again.
    """
    numbered = df if row else number_rows(df, keys, time, ties, "_row", "_row_total", bucket_days)
    row_name = row or "_row"
    position, length = F.col(row_name), F.col(f"{row_name}_total")
    first = F.greatest(F.floor((position - after) / block_rows), F.lit(0))
    last = F.least(F.floor((position + before) / block_rows), F.floor((length - 1) / block_rows))
    blocks = numbered.withColumn(BLOCK, F.explode(F.sequence(first, last)))
    window = Window.partitionBy(*keys, BLOCK).orderBy(row_name)
    result = compute(blocks, window).where(F.col(BLOCK) == F.floor(position / block_rows)).drop(BLOCK)
    return result if row else result.drop("_row", "_row_total")


def packed(part: DataFrame, keys: Sequence[str], row: str) -> DataFrame:
    """One row per block inside ``rolling``: its rows in order, as the array ``_rows`` of structs.

    A block is bounded by ``block_rows`` and its margins, so the array is too.
    """
    rest = [name for name in part.columns if name not in (*keys, BLOCK, row)]
    rows = F.array_sort(F.collect_list(F.struct(row, *rest)))
    return part.groupBy(*keys, BLOCK).agg(rows.alias("_rows"))


def unpacked(blocks: DataFrame, keys: Sequence[str], values: Column, name: str) -> DataFrame:
    """Back to one row per reading, with the matching element of the array ``values`` as ``name``."""
    paired = blocks.withColumn("_values", values).select(*keys, BLOCK, F.inline(F.arrays_zip("_rows", "_values")))
    return paired.select(*keys, BLOCK, "_rows.*", F.col("_values").alias(name))


def running_last(
    df: DataFrame,
    value: Column,
    name: str,
    keys: Sequence[str] = ANIMAL,
    time: str = "datetime",
    ties: Sequence[str] = (),
    bucket_days: int = 7,
) -> DataFrame:
    """Forward fill: the last non-null ``value`` at or before each row."""
    bucketed = with_buckets(df, time, bucket_days).withColumn("_value", value)
    order = F.struct(time, *ties)
    known = F.col("_value").isNotNull()
    latest = bucketed.groupBy(*keys, BUCKET).agg(
        F.max_by(F.col("_value"), F.when(known, order)).alias("_latest")
    )
    earlier = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carried = latest.select(*keys, BUCKET, F.last("_latest", ignorenulls=True).over(earlier).alias("_carried"))
    so_far = Window.partitionBy(*keys, BUCKET).orderBy(time, *ties).rowsBetween(Window.unboundedPreceding, 0)
    return (
        bucketed.join(carried, [*keys, BUCKET])
        .withColumn(name, F.coalesce(F.last("_value", ignorenulls=True).over(so_far), F.col("_carried")))
        .drop("_value", "_carried", BUCKET)
    )


def running_sums(
    df: DataFrame,
    values: dict[str, Column],
    keys: Sequence[str] = ANIMAL,
    time: str = "datetime",
    ties: Sequence[str] = (),
    bucket_days: int = 7,
) -> DataFrame:
    """Cumulative sums up to and including each row, one column per entry; nulls count as zero."""
    valued = {f"_value_{name}": F.coalesce(value, F.lit(0)) for name, value in values.items()}
    bucketed = with_buckets(df, time, bucket_days).withColumns(valued)
    sums = bucketed.groupBy(*keys, BUCKET).agg(*[F.sum(f"_value_{name}").alias(f"_sum_{name}") for name in values])
    earlier = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(f"_sum_{name}").over(earlier), F.lit(0)).alias(f"_before_{name}") for name in values]
    carried = sums.select(*keys, BUCKET, *before)
    so_far = Window.partitionBy(*keys, BUCKET).orderBy(time, *ties).rowsBetween(Window.unboundedPreceding, 0)
    totals = {name: F.col(f"_before_{name}") + F.sum(f"_value_{name}").over(so_far) for name in values}
    done = [BUCKET, *valued, *[f"_before_{name}" for name in values]]
    return bucketed.join(carried, [*keys, BUCKET]).withColumns(totals).drop(*done)


def running_sum(df: DataFrame, value: Column, name: str, **series) -> DataFrame:
    return running_sums(df, {name: value}, **series)


def rank_all(df: DataFrame, order: Sequence[str], rank: str = "rank", total: str | None = None) -> DataFrame:
    """Number all rows from 0 in the order of ``order`` without bringing them into one task.

    A range sort spreads the rows; the checkpoint fixes which row lies in which partition, and the
    partition sizes (one row per partition) then give every partition its starting number.
    """
    from herdsignal.session import cut

    ordered = cut(
        df.orderBy(*order)
        .withColumn("_partition", F.spark_partition_id())
        .withColumn("_position", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    sizes = ordered.groupBy("_partition").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_partition").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "_partition",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"),
        F.sum("_n").over(Window.partitionBy()).alias(total or "_total"),
    )
    # One row per partition of the sorted frame: the broadcast does not grow with the rows.
    ranked = ordered.join(F.broadcast(starts), "_partition").withColumn(rank, F.col("_start") + F.col("_position"))
    return ranked.drop("_partition", "_position", "_start", *([] if total else ["_total"]))

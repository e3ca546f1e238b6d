"""Train and test splits that do not depend on partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from herdsignal.functions.time import to_micros
from herdsignal.operators.series import ANIMAL

# Test share and seed.
TEST_SHARE = 0.33
SEED = 42



def key_hash(keys: Sequence[str], seed: int, times: Sequence[str] = ()) -> Column:
    """60 bits of the MD5 of the seed and the keys as text, parted by ``|``; ``times`` count in microseconds."""
    parts = [to_micros(F.col(k)).cast("string") if k in times else F.col(k).cast("string") for k in keys]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def split_by_key(
    df: DataFrame, keys: Sequence[str] = ANIMAL, share: float = TEST_SHARE, seed: int = SEED, name: str = "split"
) -> DataFrame:
    """Distinct keys with ``train`` or ``test``: exactly ``ceil(share * n)`` keys are for testing.

    Keys are ranked by a seeded hash that other engines have too. The rank comes from the sizes of a fixed number of hash buckets
    and the rank within a bucket, so no task sees all keys.
    """
    unique = df.select(*keys).distinct()
    hashed = unique.withColumn("_hash", key_hash(keys, seed))
    bucketed = hashed.withColumn("_bucket", F.shiftright(F.col("_hash"), 48))
    sizes = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "_bucket",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"),
        F.sum("_n").over(Window.partitionBy()).alias("_total"),
    )
    in_bucket = Window.partitionBy("_bucket").orderBy("_hash", *keys)
    # At most 4096 rows, whatever the number of keys.
    ranked = bucketed.join(F.broadcast(starts), "_bucket").withColumn(
        "_rank", F.col("_start") + F.row_number().over(in_bucket)
    )
    is_test = F.col("_rank") <= F.ceil(F.lit(share) * F.col("_total"))
    return ranked.select(*keys, F.when(is_test, "test").otherwise("train").alias(name))


def split_rows(
    df: DataFrame,
    keys: Sequence[str] = (*ANIMAL, "datetime"),
    share: float = TEST_SHARE,
    seed: int = SEED,
    name: str = "split",
) -> DataFrame:
    """Assign each row by a seeded hash of its key; the same row always falls on the same side."""
    times = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)]
    place = key_hash(keys, seed, times) % 1_000_000
    return df.withColumn(name, F.when(place < int(share * 1_000_000), "test").otherwise("train"))

"""Life-cycle events: flattening, interval existence tests and the event sets behind the labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from herdsignal.functions.time import MICROS_PER_DAY, to_micros
from herdsignal.operators.series import ANIMAL

# Event types and the day ranges of the rules.
HEAT = "heat"
INSEMINATION = "insemination"
CALVING = "calving_confirmation"
PREGNANCY = "pregnancy_result"
DETECTION = "actincrease_704"
CYCLE_DAYS = (18, 24)
GESTATION_DAYS = (270, 290)

CYCLE = (*ANIMAL, "cycle_no")


def of_type(events: DataFrame, *types: str) -> DataFrame:
    return events.where(F.col("event_type").isin(*types))


def exists_within(
    probes: DataFrame,
    targets: DataFrame,
    keys: Sequence[str],
    *ranges: tuple[int, int],
    time: str = "event_ts",
    bucket_days: int = 60,
) -> DataFrame:
    """Distinct probes (keys and time) with a target in one of the ``ranges`` of days after them.

    Ranges include both ends and may be negative. A range semi join that emits no pairs: with probes
    moved to the start of their range, the first target at or after that point decides. Both sides are
    made distinct before the shuffle; a group is cut into calendar buckets, and a target is repeated in
    the bucket before its own when a range that starts there can reach it.
    """
    micros = [(low * MICROS_PER_DAY, high * MICROS_PER_DAY) for low, high in ranges]
    reach = max(high - low for low, high in micros)
    width = bucket_days * MICROS_PER_DAY
    bucket = lambda at: F.floor(at / width)
    at = to_micros(F.col(time))
    begins = F.array(*[F.struct((at + low).alias("at"), F.lit(high - low).alias("within")) for low, high in micros])
    starts = (
        probes.where(F.col(time).isNotNull())
        .select(*keys, time)
        .distinct()
        .select(*keys, time, F.explode(begins).alias("_r"))
        .select(*keys, time, F.col("_r.at").alias("_at"), F.col("_r.within").alias("_within"), bucket(F.col("_r.at")).alias("_b"))
    )
    goals = targets.where(F.col(time).isNotNull()).select(*keys, at.alias("_at")).distinct()
    goals = goals.select(
        *keys,
        "_at",
        F.col("_at").alias("_goal"),
        F.explode(F.sequence(bucket(F.col("_at") - reach), bucket(F.col("_at")))).alias("_b"),
    )
    # Latest first, so that a running "last" is the nearest target ahead; at equal times targets come first.
    ahead = (
        Window.partitionBy(*keys, "_b")
        .orderBy(F.col("_at").desc(), F.col("_goal").desc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    nearest = F.last("_goal", ignorenulls=True).over(ahead)
    found = (
        starts.unionByName(goals, allowMissingColumns=True)
        .withColumn("_nearest", nearest)
        .where(F.col("_goal").isNull() & (F.col("_nearest") - F.col("_at") <= F.col("_within")))
        .select(*keys, time)
    )
    return found.distinct() if len(ranges) > 1 else found


def cyclic_events(events: DataFrame, keys: Sequence[str] = CYCLE, days: tuple[int, int] = CYCLE_DAYS) -> DataFrame:
    """Heats and inseminations with another one of the same cycle 18 to 24 days away, on either side."""
    heats = of_type(events, HEAT, INSEMINATION)
    return exists_within(heats, heats, keys, days, (-days[1], -days[0]))


def inseminations(events: DataFrame) -> DataFrame:
    return of_type(events, INSEMINATION).select(*ANIMAL, "event_ts").distinct()


def calvings(events: DataFrame, cycles: DataFrame | None = None) -> DataFrame:
    """Confirmed calvings and, where cycles are given, their last calving dates, as ``calved_at``."""
    keys = [name for name in CYCLE if name in events.columns]
    confirmed = of_type(events, CALVING).select(*keys, F.col("event_ts").alias("calved_at"))
    if cycles is not None:
        confirmed = confirmed.unionByName(cycles.select(*keys, F.col("last_calving_date").alias("calved_at")))
    return confirmed.where(F.col("calved_at").isNotNull())


def pregnant_events(
    events: DataFrame,
    cycles: DataFrame | None = None,
    keys: Sequence[str] = CYCLE,
    days: tuple[int, int] = GESTATION_DAYS,
    positive_only: bool = False,
) -> DataFrame:
    """Heats followed by a calving after 270 to 290 days in the same cycle, and confirmed inseminations.

    A pregnancy result counts whatever its outcome unless ``positive_only`` is set.
    """
    births = calvings(events, cycles).withColumnRenamed("calved_at", "event_ts")
    carried = exists_within(of_type(events, HEAT, INSEMINATION), births, keys, days)
    animal = [name for name in keys if name != "cycle_no"]
    result = carried.select(*animal, "event_ts")
    if "insemination_date" in events.columns:
        confirmed = of_type(events, PREGNANCY)
        if positive_only:
            confirmed = confirmed.where("pregnant")
        result = result.unionByName(confirmed.select(*animal, F.col("insemination_date").alias("event_ts")))
    return result.where(F.col("event_ts").isNotNull()).distinct()


def deleted_events(detections: DataFrame, events: DataFrame) -> DataFrame:
    """Detected heats minus one occurrence for each heat that is still in the life cycle."""
    detected = of_type(detections, DETECTION).select(*ANIMAL, "event_ts")
    kept = of_type(events, HEAT).select(*ANIMAL, "event_ts")
    return detected.exceptAll(kept)

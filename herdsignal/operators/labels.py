"""Labels on readings: peak localisation, spans, the four heat labels, annotation and runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec, functions as F

from herdsignal.functions.numbers import any_heat
from herdsignal.functions.time import from_micros, to_micros
from herdsignal.operators import events as ev
from herdsignal.operators.series import ANIMAL, rolling, running_sums

# Search span, smoothing frame, marked span, hold-off.
SEARCH_HOURS = 12
PEAK_FRAME = (-3, 2)
SPAN_HOURS = (-2, 8)
HOLD_OFF_ROWS = 720
LABELS = ("cyclic", "inseminated", "pregnant", "deleted")

DAY = "_day"
SPANS = "_spans"

_HOUR = 3_600_000_000
_DAY = 24 * _HOUR


def locate_peaks(
    readings: DataFrame,
    events: DataFrame,
    carry: Sequence[str] = (),
    hours: int = SEARCH_HOURS,
) -> DataFrame:
    """For each event the time of the highest smoothed activity within ``hours`` before and after it.

    ``events`` has one row per animal and ``event_ts``; ``carry`` names further columns to keep. The
    interval becomes an equality on animal and calendar day, so a long series meets its events day by
    day. Smoothing sees only the rows of the slice, and adds them in the order of time, so that equal
    neighbourhoods give equal values; ties go to the earliest time. Events without activity are dropped.
    """
    reach = hours * _HOUR
    at = to_micros(F.col("event_ts"))
    day = lambda micros: F.floor(micros / _DAY)
    sought = events.withColumn("_day", F.explode(F.sequence(day(at - reach), day(at + reach))))
    values = readings.select(*ANIMAL, "datetime", "act", day(to_micros(F.col("datetime"))).alias("_day"))
    near = F.abs(to_micros(F.col("datetime")) - at) <= reach
    slices = values.join(sought, [*ANIMAL, "_day"]).where(near)
    in_slice = Window.partitionBy(*ANIMAL, "event_ts").orderBy("datetime")
    total, known = F.lit(0.0), F.lit(0)
    for step in range(PEAK_FRAME[0], PEAK_FRAME[1] + 1):
        value = F.lead("act", step).over(in_slice) if step else F.col("act")
        total = total + F.coalesce(value, F.lit(0.0))
        known = known + value.isNotNull().cast("int")
    smooth = slices.withColumn("_smooth", F.try_divide(total, known))
    best = F.max_by("datetime", F.struct("_smooth", (-to_micros(F.col("datetime"))).alias("_early")))
    kept = [F.first(name).alias(name) for name in carry]
    return (
        smooth.where(F.col("_smooth").isNotNull())
        .groupBy(*ANIMAL, "event_ts")
        .agg(best.alias("peak_ts"), *kept)
    )


def day_spans(peaks: DataFrame, labels: Sequence[str], hours: tuple[int, int] = SPAN_HOURS) -> DataFrame:
    """The marked spans that touch each calendar day of an animal, as an array.

    Peaks are made distinct first. They are reading times, so on a ten-minute grid a day is touched by
    at most the 144 peaks of its own and the 60 of the hours around it.
    """
    at = to_micros(F.col("peak_ts"))
    distinct = peaks.groupBy(*ANIMAL, "peak_ts").agg(*[F.bool_or(name).alias(name) for name in labels])
    first, last = at + hours[0] * _HOUR, at + hours[1] * _HOUR
    days = F.explode(F.sequence(F.floor(first / _DAY), F.floor(last / _DAY)))
    bounded = distinct.withColumns({"first": from_micros(first), "last": from_micros(last)})
    return (
        bounded.select(*ANIMAL, days.alias(DAY), F.struct("first", "last", *labels).alias("_span"))
        .groupBy(*ANIMAL, DAY)
        .agg(F.collect_list("_span").alias(SPANS))
    )


def flag_readings(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Turn the spans of a reading's day into the boolean ``labels``."""
    time = F.col("datetime")
    hits = df.withColumn(SPANS, F.filter(SPANS, lambda s: (time >= s["first"]) & (time <= s["last"])))
    flags = {name: F.coalesce(F.exists(SPANS, lambda s: s[name]), F.lit(False)) for name in labels}  # noqa: B023
    return hits.withColumns(flags).drop(SPANS)


def with_day(df: DataFrame) -> DataFrame:
    return df.withColumn(DAY, F.floor(to_micros(F.col("datetime")) / _DAY))


def mark_spans(
    readings: DataFrame, peaks: DataFrame, labels: Sequence[str], hours: tuple[int, int] = SPAN_HOURS
) -> DataFrame:
    """Set the boolean ``labels`` on the readings from two hours before to eight hours after a peak.

    The interval join is an equality join on animal and calendar day: a span reaches into two days at
    most, and a long series is spread over its days.
    """
    joined = with_day(readings).join(day_spans(peaks, labels, hours), [*ANIMAL, DAY], "left")
    return flag_readings(joined, labels).drop(DAY)


def tagged(sets: dict[str, DataFrame]) -> DataFrame:
    """Event sets by label as one frame: a row per animal and time, a boolean column per label."""
    parts = None
    for label, events in sets.items():
        part = events.select(*ANIMAL, "event_ts", F.lit(label).alias("_label"))
        parts = part if parts is None else parts.unionByName(part)
    flags = [F.bool_or(F.col("_label") == label).alias(label) for label in sets]
    return parts.groupBy(*ANIMAL, "event_ts").agg(*flags)


def mark_events(readings: DataFrame, sets: dict[str, DataFrame]) -> DataFrame:
    """Label readings around the events of each set, all sets in one pass."""
    names = list(sets)
    return mark_spans(readings, locate_peaks(readings, tagged(sets), carry=names), names)


def event_sets(events: DataFrame, detections: DataFrame, cycles: DataFrame | None = None) -> dict[str, DataFrame]:
    """The events behind the four labels."""
    return {
        "cyclic": ev.cyclic_events(events),
        "inseminated": ev.inseminations(events),
        "pregnant": ev.pregnant_events(events, cycles),
        "deleted": ev.deleted_events(detections, events),
    }


def add_labels(
    readings: DataFrame,
    events: DataFrame,
    detections: DataFrame,
    cycles: DataFrame | None = None,
) -> DataFrame:
    return mark_events(readings, event_sets(events, detections, cycles))


def annotate(df: DataFrame) -> DataFrame:
    """Raw annotation from the three heat labels; deleted heats do not count."""
    return df.withColumn("raw", any_heat(F.col("pregnant"), F.col("cyclic"), F.col("inseminated")))


def debounce(
    df: DataFrame, raw: str = "raw", name: str = "annotation", hold_off: int = HOLD_OFF_ROWS, **series
) -> DataFrame:
    """Silence the annotation for ``hold_off`` rows from each falling edge of the raw label on.

    Only edges less than ``hold_off`` rows back matter, so the frame is bounded and the blocks of
    ``rolling`` see every edge they need.
    """

    def silence(part: DataFrame, window: WindowSpec) -> DataFrame:
        position = F.row_number().over(window)
        falling = (F.lag(raw).over(window) == 1) & (F.col(raw) == 0)
        so_far = window.rowsBetween(Window.unboundedPreceding, 0)
        return (
            part.withColumn("_at", position)
            .withColumn("_edge", F.when(falling, F.col("_at")))
            .withColumn("_last_edge", F.max("_edge").over(so_far))
            .withColumn(
                name,
                F.when(F.col("_at") - F.col("_last_edge") < hold_off, F.lit(0)).otherwise(F.col(raw)).cast("int"),
            )
            .drop("_at", "_edge", "_last_edge")
        )

    return rolling(df, silence, before=hold_off, after=0, **series)


def difference(df: DataFrame, column: str, name: str, **series) -> DataFrame:
    """Difference to the row before."""

    def add(part: DataFrame, window: WindowSpec) -> DataFrame:
        return part.withColumn(name, F.col(column) - F.lag(column).over(window))

    return rolling(df, add, before=1, after=0, **series)


def label_runs(df: DataFrame, flag: str, keys: Sequence[str] = ANIMAL, time: str = "datetime", **series) -> DataFrame:
    """Contiguous stretches of set flags: first and last time and number of rows.

    Within a stretch the running counts of all rows and of flagged rows grow together, so their
    difference names the stretch; no row needs to see its neighbour.
    """
    counts = {"_all": F.lit(1), "_flagged": F.col(flag).cast("int")}
    flagged = running_sums(df.select(*keys, time, flag), counts, keys, time, **series).where(F.col(flag))
    return (
        flagged.groupBy(*keys, (F.col("_all") - F.col("_flagged")).alias("_run"))
        .agg(F.min(time).alias("first_ts"), F.max(time).alias("last_ts"), F.count(F.lit(1)).alias("rows"))
        .drop("_run")
    )

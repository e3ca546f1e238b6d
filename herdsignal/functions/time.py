"""Time columns. Times are TIMESTAMP_NTZ; no function here depends on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The accepted epoch range (2000-01-01 to 2030-01-01, both ends excluded) and its error codes.
EPOCH_MIN = 946684800
EPOCH_MAX = 1893456000
ERROR_NOT_INTEGER = "invalid"
ERROR_OUT_OF_RANGE = "invalid_date"

ISO_PATTERN = "yyyy-MM-dd'T'HH:mm:ss"
MICROS_PER_DAY = 86_400_000_000
MICROS_PER_SECOND = 1_000_000
# The first and last second of the years 1 to 9999.
FIRST_SECOND, LAST_SECOND = -62_135_596_800, 253_402_300_799


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def _seconds(time: Column) -> Column:
    """Seconds of a wall time since 1970, with six decimals; no time zone takes part.

    The argument is named once here and in everything below: nested time functions would otherwise multiply the size
    of the generated code.
    """
    return (time - _epoch()).cast("interval second").cast("decimal(20,6)")


def to_micros(time: Column) -> Column:
    """Microseconds of a wall time since 1970."""
    return (_seconds(time) * MICROS_PER_SECOND).cast("long")


def from_micros(micros: Column) -> Column:
    """The wall time of microseconds since 1970."""
    seconds = (micros.cast("decimal(18,0)") / F.lit(MICROS_PER_SECOND)).cast("decimal(18,6)")
    return _epoch() + F.make_dt_interval(secs=seconds)


def day_number(time: Column, days: int = 1) -> Column:
    """Number of the ``days``-wide calendar bucket that holds ``time``."""
    return F.floor(F.unix_date(F.to_date(time)) / F.lit(days)).cast("long")


def from_epoch_seconds(seconds: Column) -> Column:
    """The wall time of epoch seconds (whole or not); null outside the years 1 to 9999."""
    inside = (seconds >= FIRST_SECOND) & (seconds <= LAST_SECOND)
    return from_micros(F.when(inside, seconds * MICROS_PER_SECOND))


def wall_time(time: Column) -> Column:
    """Forget the time zone and keep the wall clock."""
    return time.cast("timestamp_ntz")


def snap(time: Column, minutes: int = 10) -> Column:
    """Nearest grid tick; a time halfway between two ticks goes to the even one.

    Decimal arithmetic, so that no time is misplaced by floating point.
    """
    step = minutes * 60_000_000
    # The quotient has one digit more than the step: a half is a half, and nothing else is rounded to one.
    ticks = F.bround(to_micros(time).cast("decimal(18,0)") / F.lit(step).cast(f"decimal({len(str(step))},0)"), 0)
    return from_micros(ticks.cast("long") * F.lit(step))


def repaired_time(text: Column) -> Column:
    """A time from text holding either a timestamp or epoch seconds, cut to whole seconds; else null."""
    as_time = text.try_cast("timestamp_ntz")
    as_epoch = from_epoch_seconds(text.try_cast("bigint"))
    is_number = text.rlike(r"^\s*-?\d+\s*$")
    seconds = F.floor(_seconds(F.when(is_number, as_epoch).otherwise(as_time)))
    return from_micros(seconds.cast("long") * MICROS_PER_SECOND)


def parse_iso(text: Column) -> Column:
    """``2020-06-01T10:00:00`` to a time; null for null or anything else."""
    return F.try_to_timestamp(text, F.lit(ISO_PATTERN)).cast("timestamp_ntz")


def decode_datetime(text: Column) -> Column:
    """ISO text to wall time; a UTC offset is dropped, not applied."""
    return text.try_cast("timestamp_ntz")


def encode_datetime(time: Column) -> Column:
    """Wall time to ISO text; the fraction appears only when there is one."""
    plain = F.date_format(time, ISO_PATTERN)
    fraction = F.date_format(time, ISO_PATTERN + ".SSSSSS")
    return F.when(F.pmod(to_micros(time), F.lit(1_000_000)) == 0, plain).otherwise(fraction)


def strip_offset(text: Column) -> Column:
    """ISO text without a ``+hh:mm`` suffix; a ``-hh:mm`` suffix stays."""
    return F.split_part(text, F.lit("+"), F.lit(1))


def epoch_error(value: Column) -> Column:
    """Error code of an epoch-seconds field, null when it is fine or missing."""
    number = value.try_cast("bigint")
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(number.isNull(), F.lit(ERROR_NOT_INTEGER))
        .when((number > EPOCH_MIN) & (number < EPOCH_MAX), F.lit(None).cast("string"))
        .otherwise(F.lit(ERROR_OUT_OF_RANGE))
    )


def decode_epoch(value: Column) -> Column:
    """Epoch seconds to a time, null when the field is missing or wrong."""
    return F.when(epoch_error(value).isNull(), from_epoch_seconds(value.try_cast("bigint")))


def encode_epoch(time: Column) -> Column:
    return F.floor(_seconds(time)).cast("long")


def calendar_day(time: Column) -> Column:
    return F.to_date(time)


def between_days(time: Column, first, last) -> Column:
    """Rows from the start of day ``first`` to the end of day ``last``."""
    first_day = F.lit(first).cast("date")
    after_last = F.date_add(F.lit(last).cast("date"), 1)
    return (time >= first_day.cast("timestamp_ntz")) & (time < after_last.cast("timestamp_ntz"))

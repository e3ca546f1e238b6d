"""Number columns: rounding, downcasts, logits."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def no_nan(value: Column) -> Column:
    """NaN and infinite values become null: averages do not skip the one and are spoilt by the other."""
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def float32(value: Column) -> Column:
    return value.cast("float")


def round_half_even(value: Column, digits: int = 2) -> Column:
    return F.bround(value, digits)


def signed_int(value: Column) -> Column:
    return value.cast("int")


def logistic(logit: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-logit))


def class_tag(probability: Column) -> Column:
    """Rounded probability; one half rounds down to class 0."""
    return (probability > 0.5).cast("int")


def any_heat(pregnant: Column, cyclic: Column, inseminated: Column) -> Column:
    """Raw annotation: 1 when one of the three heat labels is set, null labels counting as unset."""
    flags = [F.coalesce(flag, F.lit(False)) for flag in (pregnant, cyclic, inseminated)]
    return (flags[0] | flags[1] | flags[2]).cast("int")

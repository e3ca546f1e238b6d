"""From raw readings, animals and events to the feature table, the training matrix and its split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from herdsignal.operators import clean, events as ev, features, labels, scaling, sequences, split
from herdsignal.operators.series import ANIMAL, number_rows
from herdsignal.session import cut

ROW = "row_no"


@dataclass(frozen=True)
class Settings:
    """Thresholds and grid; tests and small tables lower them."""

    minutes: int = 10
    min_animals: int = features.MIN_GROUP_ANIMALS
    min_temp: float = clean.MIN_TEMPERATURE
    min_rows: int = clean.MIN_HISTORY_ROWS
    require_heat: bool = False
    hold_off: int = labels.HOLD_OFF_ROWS
    ties: tuple[str, ...] = ()


def gridded(readings: DataFrame, animals: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per animal and tick, with the group of the animal; animals without a group are left out."""
    known = clean.default_group(animals).select(*ANIMAL, "group_id")
    ticks = clean.on_grid(clean.nulls_for_nan(readings), settings.minutes, settings.ties)
    return ticks.select(*ANIMAL, "datetime", "act", "temp").join(known, list(ANIMAL))


def build_features(
    readings: DataFrame,
    animals: DataFrame,
    events: DataFrame,
    detections: DataFrame,
    cycles: DataFrame | None = None,
    settings: Settings = Settings(),
) -> DataFrame:
    """The feature table.

    The order of the stages matters: labels and the temperature filter see the whole gridded series,
    the group mean sees all rows, rows are filtered after that, and the heat feature sees what is left.
    The gridded readings and the filtered rows are each read more than once and therefore written out.
    """
    grid = cut(gridded(readings, animals, settings))
    filtered = features.filter_temperature(grid)
    labelled = with_day_sheet(filtered, day_sheet(grid, events, detections, cycles))
    grouped = features.attach_group_mean(labelled, features.group_means(grid, settings.min_animals))
    kept = cut(clean.plausible(clean.required(grouped), settings.min_temp))
    numbered = number_rows(kept, row=ROW, total=f"{ROW}_total")
    long_enough = numbered.where(F.col(f"{ROW}_total") >= settings.min_rows)
    if settings.require_heat:
        long_enough = clean.with_any_heat(long_enough)
    return features.heat_feature(long_enough, row=ROW).drop(ROW, f"{ROW}_total")


def day_sheet(
    grid: DataFrame, events: DataFrame, detections: DataFrame, cycles: DataFrame | None = None
) -> DataFrame:
    """What holds for a whole day of an animal: its days in milk and the label spans that touch it.

    One row per animal and day, so that the readings are shuffled once for both.
    """
    sets = labels.event_sets(events, detections, cycles)
    peaks = labels.locate_peaks(grid, labels.tagged(sets), carry=list(sets))
    spans = labels.day_spans(peaks, list(sets))
    births = ev.calvings(events, cycles).select(*ANIMAL, "calved_at")
    milk = features.milk_days(grid.select(*ANIMAL, F.to_date("datetime").alias("_date")), births)
    numbered = milk.select(*ANIMAL, F.unix_date("_date").cast("long").alias(labels.DAY), "DIM")
    return numbered.join(spans, [*ANIMAL, labels.DAY], "full")


def with_day_sheet(readings: DataFrame, sheet: DataFrame) -> DataFrame:
    joined = labels.with_day(readings).join(sheet, [*ANIMAL, labels.DAY], "left")
    return labels.flag_readings(joined, labels.LABELS).drop(labels.DAY)


def build_training(table: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scaled training matrix, train/test keys and the fitted scaler. Labels are debounced after scaling."""
    table = cut(table)  # the scaler, the debounced series and the split read it
    scaler = cut(scaling.fit_scaler(table))
    scaled = scaling.scale(table, scaler)
    debounced = labels.debounce(labels.annotate(scaled), hold_off=settings.hold_off)
    matrix = sequences.training_matrix(debounced)
    return matrix, split.split_by_key(matrix), scaler


def smoke(readings: DataFrame, minutes: int, min_animals: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """Grid, first reading per tick, group mean and heat feature: the shortest way through the stages."""
    grid = clean.on_grid(readings, minutes, ties)
    with_mean = features.group_mean(grid, min_animals)
    return features.heat_feature(with_mean.where(F.col("act_group_mean").isNotNull()))

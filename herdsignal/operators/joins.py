"""Joins by key: organisation lookup, composition of readings with their documents, id differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from herdsignal.operators.series import ANIMAL
from herdsignal.session import cut


def organisation_of(df: DataFrame, animals: DataFrame, loaded_at: str | None = None) -> DataFrame:
    """Organisation of each animal, null when unknown. No hint: the planner broadcasts only what is small.

    An animal in several organisations counts in the one loaded last by ``loaded_at``, or without such a column
    in the greatest id. The lookup is written first: dealt anew for the join, a hot animal's rows can be split.
    """
    newest = F.max_by("organisation_id", F.struct(loaded_at, "organisation_id")) if loaded_at else F.max("organisation_id")
    lookup = cut(animals.groupBy("animal_id").agg(newest.alias("organisation_id")), "lookup")
    return df.join(lookup, "animal_id", "left")


def merge_lookup(old: DataFrame, new: DataFrame) -> DataFrame:
    """Animal to organisation map in which new entries replace old ones."""
    return old.join(new.select("animal_id"), "animal_id", "left_anti").unionByName(new)


def compose(readings: DataFrame, animals: DataFrame, organisations: DataFrame) -> DataFrame:
    """Readings with the columns of their animal and organisation; animals without readings disappear."""
    return readings.join(animals, list(ANIMAL)).join(organisations, "organisation_id")


def missing_ids(wanted: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    return wanted.join(stored.select(*keys), list(keys), "left_anti")

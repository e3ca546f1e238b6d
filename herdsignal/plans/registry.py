"""Named queries over the given tables, each with the SQL that must give the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from herdsignal.session import own_folder

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            own_folder(spark)
            return function(spark, folder)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def six(value: Column | str) -> Column:
    """Six decimals for comparison; the nudge keeps exact halves from depending on summation order."""
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column + F.lit(1e-9), 6)

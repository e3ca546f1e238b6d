"""Scaler: mean and population deviation per column, fitted once and applied row by row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# The columns that are scaled.
NUMERIC = ("act", "temp", "DIM", "temp_filtered", "act_group_mean", "heat_feature")


def _moments(name: str, prefix: str) -> list[Column]:
    deviation = F.stddev_pop(name)
    return [F.avg(name).alias(f"{prefix}mean"), F.when(deviation == 0, F.lit(1.0)).otherwise(deviation).alias(f"{prefix}std")]


def fit_scaler(df: DataFrame, columns: Sequence[str] = NUMERIC) -> DataFrame:
    """One row with ``{column}_mean`` and ``{column}_std``; nulls are ignored, a zero deviation becomes 1.

    An array column, whose arrays are all of one length, gets arrays with a mean and a deviation for each place.
    """
    arrays = [name for name in columns if _is_array(df, name)]
    scaler = df.agg(*[part for name in columns if name not in arrays for part in _moments(name, f"{name}_")]) if len(arrays) < len(columns) else None
    for name in arrays:
        places = df.select(F.posexplode(name).alias("_place", "_value")).groupBy("_place").agg(*_moments("_value", ""))
        row = places.agg(F.array_sort(F.collect_list(F.struct("_place", "mean", "std"))).alias("_all"))
        row = row.select(F.col("_all.mean").alias(f"{name}_mean"), F.col("_all.std").alias(f"{name}_std"))
        scaler = row if scaler is None else scaler.crossJoin(row)
    return scaler.select(*[f"{name}_{part}" for name in columns for part in ("mean", "std")])


def _is_array(df: DataFrame, name: str) -> bool:
    return name in df.columns and isinstance(df.schema[name].dataType, T.ArrayType)


_STATE = ("n", "mean", "m2")


def scaler_state(df: DataFrame, columns: Sequence[str] = NUMERIC) -> DataFrame:
    """What a scaler has to know of some rows: per column n, mean and m2, the sum of squared distances from the mean.

    Nulls are ignored; a column without values has n 0 and nulls.
    """
    parts = []
    for name in columns:
        state = F.struct(F.lit(name).alias("column"), F.count(name).alias("n"), F.avg(name).alias("mean"), (F.var_pop(name) * F.count(name)).alias("m2"))
        parts.append(state)
    return df.agg(F.array(*parts).alias("_state")).select(F.inline("_state"))


def merge_states(states: DataFrame) -> DataFrame:
    """One state per column from the states of disjoint rows, whatever their number and order.

    Squared distances are moved from each part's mean to the common one, so a large mean costs no digits.
    """
    common = states.groupBy("column").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean"))
    apart = (F.col("mean") - F.col("_mean")) * (F.col("mean") - F.col("_mean"))
    merged = states.join(common, "column").groupBy("column").agg(
        F.sum("n").alias("n"), F.first("_mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * apart).alias("m2")
    )
    return merged.select("column", *_STATE)


def scaler_of(state: DataFrame, columns: Sequence[str] = NUMERIC) -> DataFrame:
    """The one-row scaler of a state, as ``fit_scaler`` gives it."""
    mine = lambda name, value: F.max(F.when(F.col("column") == name, value))
    deviation = F.sqrt(F.col("m2") / F.col("n"))
    spread = F.when(deviation == 0, F.lit(1.0)).otherwise(deviation)
    return state.agg(*[part for name in columns for part in (mine(name, F.col("mean")).alias(f"{name}_mean"), mine(name, spread).alias(f"{name}_std"))])


def partial_fit(df: DataFrame, path: str, columns: Sequence[str] = NUMERIC) -> None:
    """Add rows to a stored scaler: their state is kept beside those of earlier calls, which are not read."""
    scaler_state(df, columns).write.mode("append").parquet(path)


def fitted(spark: SparkSession, path: str, columns: Sequence[str] = NUMERIC) -> DataFrame:
    """The scaler of all rows that ``partial_fit`` has added."""
    return scaler_of(merge_states(spark.read.parquet(path)), columns)


def scale(
    df: DataFrame, scaler: DataFrame, columns: Sequence[str] = NUMERIC, output: str = "float"
) -> DataFrame:
    """``(x - mean) / std`` as float32; nulls stay null. The scaler's one row is read first and enters as literals."""
    row = scaler.first()
    number = lambda value: F.lit(value).cast("double")

    def scaled(name: str) -> Column:
        mean, std = row[f"{name}_mean"], row[f"{name}_std"]
        if not _is_array(df, name):
            return ((F.col(name) - number(mean)) / number(std)).cast(output)
        means, stds = (F.array(*map(number, x)).cast("array<double>") for x in (mean, std))
        return F.transform(name, lambda x, i: ((x - F.get(means, i)) / F.get(stds, i)).cast(output))

    return df.withColumns({name: scaled(name) for name in columns})


def save_scaler(scaler: DataFrame, path: str) -> None:
    scaler.write.mode("overwrite").parquet(path)


def load_scaler(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)

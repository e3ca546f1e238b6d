"""ARMA(1,1) with constant for every series, by two regressions (Hannan and Rissanen, 1982).

The regressions need only sums of products, which Spark adds up per series before the shuffle; one small system per
series is solved from them. The recursion ``e_t = u_t - theta * e_{t-1}`` is a scan of affine maps: a block of rows is
one map of the residual before it, the maps of a series' blocks are put together in order (one row per block), and the
residual before a block then reaches its rows by a power of theta. So no block needs the rows of another one, whatever
theta is, and predictions are exact for any theta of at most 1 in size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec, functions as F, types as T

from herdsignal.operators.series import ANIMAL, BLOCK, number_rows, rolling
from herdsignal.session import cut

LONG_ORDER = 4
MAX_THETA = 1.0


def _gram(names: Sequence[str], complete: Column) -> Column:
    """Sums of products over the complete rows: upper triangle for a constant and the named columns."""
    columns = [F.lit(1.0), *[F.col(name) for name in names]]
    return F.array(*[F.sum(F.when(complete, a * b)) for i, a in enumerate(columns) for b in columns[i:]])


def _two_regressions(order: int):
    """Coefficients ``[constant, phi, theta]`` from the Gram sums of ``1, x1 .. x(order+1), x``.

    First the value on ``order`` lags; the residual one step back is then itself a sum of lags, so the
    second regression, on the last value and that residual, needs no further pass over the rows.
    """
    size = order + 3
    upper = np.triu_indices(size)

    def fit(sums) -> list | None:
        gram = np.zeros((size, size))
        gram[upper] = np.asarray(sums, dtype=float)
        gram = gram + np.triu(gram, 1).T
        if not np.isfinite(gram).all():
            return None
        first = gram[: order + 1, : order + 1]
        if np.linalg.matrix_rank(first) <= order:
            return None
        long = np.linalg.solve(first, gram[: order + 1, -1])
        pick = np.zeros((3, size))
        pick[0, 0] = pick[1, 1] = pick[2, 1] = 1.0
        pick[2, 0] = -long[0]
        pick[2, 2 : order + 2] = -long[1:]
        second = pick @ gram @ pick.T
        if np.linalg.matrix_rank(second) < 3:
            return None
        constant, phi, theta = np.linalg.solve(second, pick @ gram[:, -1])
        return [constant, phi, theta]

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for sums in batches:
            found = [fit(values) if all(v is not None for v in values) else None for values in sums]
            yield pd.Series(found, index=sums.index, dtype=object)

    return solve


def arma11(
    df: DataFrame,
    column: str = "act",
    keys: Sequence[str] = ANIMAL,
    time: str = "datetime",
    ties: Sequence[str] = (),
    long_order: int = LONG_ORDER,
    block_rows: int = 16384,
    bucket_days: int = 7,
) -> DataFrame:
    """Adds the coefficients ``constant, phi, theta``, ``invertible`` and the in-sample one-step ``prediction``.

    The first prediction of a series is its mean. Rows without a value are left out; series too short or
    too regular to fit keep null coefficients and predictions. ``invertible`` says whether theta is at most
    ``MAX_THETA`` in size; where it is not, the estimate is returned as it is and predictions are null.
    """
    known = df.where(F.col(column).isNotNull())
    numbered = number_rows(known, keys, time, ties, "_t", "_t_total", bucket_days)

    def add_lags(part: DataFrame, window: WindowSpec) -> DataFrame:
        return part.withColumns({f"_x{k}": F.lag(column, k).over(window) for k in range(1, long_order + 2)})

    lagged = rolling(numbered, add_lags, long_order + 1, 0, keys, time, row="_t", block_rows=block_rows)
    lags = [f"_x{k}" for k in range(1, long_order + 2)]
    complete = F.col(lags[-1]).isNotNull()
    sums = lagged.groupBy(*keys).agg(_gram([*lags, column], complete).alias("_sums"), F.avg(column).alias("_mean"))
    fit = sums.withColumn("_fit", _two_regressions(long_order)("_sums")).select(
        *keys,
        "_mean",
        F.col("_fit")[0].alias("constant"),
        F.col("_fit")[1].alias("phi"),
        F.col("_fit")[2].alias("theta"),
        (F.abs(F.col("_fit")[2]) <= MAX_THETA).alias("invertible"),
    )
    rows = lagged.select(*df.columns, "_t", "_x1").join(fit, list(keys))
    return _predicted(rows, column, keys, block_rows)


def predict(
    df: DataFrame,
    coefficients: DataFrame,
    column: str = "act",
    keys: Sequence[str] = ANIMAL,
    time: str = "datetime",
    ties: Sequence[str] = (),
    block_rows: int = 16384,
    bucket_days: int = 7,
) -> DataFrame:
    """``arma11`` with given ``coefficients`` (keys, constant, phi, theta); series without any are left out."""
    known = df.where(F.col(column).isNotNull())
    numbered = number_rows(known, keys, time, ties, "_t", "_t_total", bucket_days)

    def add_lag(part: DataFrame, window: WindowSpec) -> DataFrame:
        return part.withColumn("_x1", F.lag(column).over(window))

    lagged = rolling(numbered, add_lag, 1, 0, keys, time, row="_t", block_rows=block_rows)
    means = known.groupBy(*keys).agg(F.avg(column).alias("_mean"))
    fit = coefficients.select(*keys, "constant", "phi", "theta", (F.abs("theta") <= MAX_THETA).alias("invertible"))
    return _predicted(lagged.drop("_t_total").join(fit.join(means, list(keys)), list(keys)), column, keys, block_rows)


def _predicted(rows: DataFrame, column: str, keys: Sequence[str], block_rows: int) -> DataFrame:
    """Predictions from rows with ``_t``, ``_x1``, ``_mean`` and coefficients."""
    expected = F.when(F.col("_t") == 0, F.col("_mean")).otherwise(F.col("constant") + F.col("phi") * F.col("_x1"))
    shocks = rows.withColumn("_u", F.when(F.col("invertible"), F.col(column) - expected)).drop("_mean", "_x1")
    blocks = shocks.withColumn(BLOCK, F.floor(F.col("_t") / block_rows))
    schema = T.StructType([*blocks.schema.fields, T.StructField("_e", T.DoubleType())])
    # Rows of a block lie together and in order, so a task goes through its blocks in batches, however small they are.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = blocks.repartition(tasks, *keys, BLOCK).sortWithinPartitions(*keys, BLOCK, "_t")
    local = cut(ordered.mapInPandas(_within_blocks([*keys, BLOCK]), schema), "residuals")
    # A block's map: the residual before it times (-theta) ** rows, plus its own last residual. One row per block.
    last = local.groupBy(*keys, BLOCK).agg(
        F.pow(-F.first("theta"), F.count(F.lit(1)).cast("double")).alias("a"), F.max_by("_e", "_t").alias("b")
    )
    ordered = last.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(BLOCK, "a", "b"))).alias("_maps"))
    carried = ordered.select(*keys, F.inline(F.arrays_zip(F.col(f"_maps.{BLOCK}").alias(BLOCK), _carried("_maps.a", "_maps.b").alias("_in"))))
    reached = F.col("_e") + F.pow(-F.col("theta"), (F.col("_t") % block_rows + 1).cast("double")) * F.col("_in")
    fitted = local.join(carried, [*keys, BLOCK]).withColumn("prediction", F.col(column) - reached)
    return fitted.withColumn("prediction", F.nanvl("prediction", F.lit(None).cast("double"))).drop("_u", "_t", "_t_total", "_e", "_in", BLOCK)


def _within_blocks(keys: Sequence[str]):
    """Adds ``_e`` to rows sorted by ``keys`` and ``_t``, for every block as if no residual came before it.

    The last block of a batch may go on in the next one and waits for it: never more than a batch and a block are held.
    """

    def finished(rows: pd.DataFrame, starts: Sequence[int]) -> pd.DataFrame:
        shocks, thetas = rows["_u"].to_numpy(dtype=float), rows["theta"].to_numpy(dtype=float)
        found = [_residuals(shocks[a:b], -thetas[a]) for a, b in zip(starts, [*starts[1:], len(rows)])]
        return rows.assign(_e=np.concatenate(found))

    def within(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = None
        for part in parts:
            rows = part if waiting is None else pd.concat([waiting, part], ignore_index=True)
            if rows.empty:
                continue
            begins = np.ones(len(rows), dtype=bool)
            begins[1:] = np.logical_or.reduce([rows[key].to_numpy()[1:] != rows[key].to_numpy()[:-1] for key in keys])
            starts = np.flatnonzero(begins)
            waiting = rows.iloc[starts[-1] :]
            if len(starts) > 1:
                yield finished(rows.iloc[: starts[-1]], starts[:-1].tolist())
        if waiting is not None:
            yield finished(waiting, [0])

    return within


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _carried(a: pd.Series, b: pd.Series) -> pd.Series:
    """What each block of a series begins with, from the maps of those before it."""
    out = []
    for factors, rests in zip(a, b, strict=True):
        value, before = 0.0, []
        for factor, rest in zip(factors, rests, strict=True):
            before.append(value)
            value = np.nan if factor is None or rest is None else factor * value + rest
        out.append(before)
    return pd.Series(out, dtype=object)


def _residuals(shocks: np.ndarray, factor: float) -> np.ndarray:
    """``e_t = u_t + factor * e_{t-1}`` by doubling the reach of the sum in every step."""
    total, reach = shocks, 1
    while reach < len(shocks):
        longer = total.copy()
        longer[reach:] += factor * total[:-reach]
        total, factor, reach = longer, factor * factor, reach * 2
    return total

"""A feed-forward network with heavier positive rows: trained by sums of gradients over blocks, stored, scored in batches.

Hidden units are sigmoids, the one output is the logit of class 1. Spark's own network takes no row weights.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from herdsignal.functions.numbers import class_tag
from herdsignal.operators.metrics import POSITIVE_WEIGHT
from herdsignal.operators.sequences import epoch_batches
from herdsignal.operators.series import ANIMAL, rank_all
from herdsignal.session import cut, release

#: Rows of a block. A block's gradient is one matrix product, whose rows and their order never change.
BLOCK_ROWS = 1024
#: Gradients of blocks are added up as whole multiples of 1 / UNITS, so that no order of addition matters.
UNITS = 2**40
#: A network is sent to every task, so its size is bounded.
MOST_WEIGHTS = 1_000_000

Layers = list[tuple[np.ndarray, np.ndarray]]


@dataclass
class Step:
    """Mean loss and mean gradient of ``rows`` rows, the gradient in the order of ``flat``."""

    rows: int
    loss: float
    gradient: np.ndarray


def sizes_of(layers: Layers) -> list[int]:
    return [layers[0][0].shape[0], *[len(bias) for _, bias in layers]]


def flat(layers: Layers) -> np.ndarray:
    """Layer by layer the weights, by input and then by output, and the biases."""
    return np.concatenate([part.ravel() for layer in layers for part in layer])


def shaped(values: np.ndarray, sizes: Sequence[int]) -> Layers:
    layers, at = [], 0
    for inputs, outputs in zip(sizes[:-1], sizes[1:]):
        middle, end = at + inputs * outputs, at + (inputs + 1) * outputs
        layers.append((values[at:middle].reshape(inputs, outputs), values[middle:end]))
        at = end
    return layers


def start(sizes: Sequence[int], seed: int = 42) -> Layers:
    """Small uniform weights, biases of 0."""
    drawn = np.random.default_rng(seed)
    return [(drawn.uniform(-1, 1, (n, m)) / np.sqrt(n), np.zeros(m)) for n, m in zip(sizes[:-1], sizes[1:])]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def _forward(layers: Layers, x: np.ndarray) -> list[np.ndarray]:
    """The inputs of each layer, and at last the logits."""
    passed = [x]
    for i, (weights, bias) in enumerate(layers):
        z = passed[-1] @ weights + bias
        passed.append(z if i == len(layers) - 1 else _sigmoid(z))
    return passed


def probabilities(layers: Layers, x: np.ndarray) -> np.ndarray:
    return _sigmoid(_forward(layers, x)[-1][:, 0])


def _block_sums(layers: Layers, x: np.ndarray, y: np.ndarray, positive: float) -> np.ndarray:
    """Gradient and loss of weighted cross-entropy, added up over the rows of a block."""
    passed = _forward(layers, x)
    logit = passed[-1][:, 0]
    loss = positive * y * np.logaddexp(0, -logit) + (1 - y) * np.logaddexp(0, logit)
    back = (_sigmoid(logit) * (1 + (positive - 1) * y) - positive * y)[:, None]
    parts: list[np.ndarray] = []
    for i in range(len(layers) - 1, -1, -1):
        parts = [(passed[i].T @ back).ravel(), back.sum(axis=0), *parts]
        if i:
            back = (back @ layers[i][0].T) * passed[i] * (1 - passed[i])
    return np.concatenate([*parts, [loss.sum()]])


def _values(features: Sequence[str]) -> Column:
    return F.array(*[F.col(name).cast("double") for name in features])


def _whole(values: Column) -> Column:
    return F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def blocks_of(
    df: DataFrame,
    features: Sequence[str],
    label: str = "annotation",
    order: Sequence[str] = (*ANIMAL, "datetime"),
    block_rows: int = BLOCK_ROWS,
    seed: int = 42,
) -> DataFrame:
    """Blocks ``(batch, y, x)`` of at most ``block_rows`` shuffled rows, ``x`` row after row in one array; written out.

    Rows are numbered in ``order`` (ties by a hash of what they hold) and dealt by a permutation of the numbers, so the
    blocks do not depend on the partitioning and no key is too frequent for one. Rows that lack the label or have a
    feature that is missing or infinite are left out. A task works on the blocks of one split of the written files.
    """
    rows = df.select(*order, F.col(label).cast("double").alias("_y"), _values(features).alias("_x"))
    rows = rows.where(F.col("_y").isNotNull() & _whole(F.col("_x"))).withColumn("_tie", F.xxhash64("_y", "_x"))
    numbered = cut(rank_all(rows, [*order, "_tie"], "_row"))
    dealt = epoch_batches(numbered, numbered.count(), block_rows, seed, row="_row")
    grouped = dealt.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("place", "_y", "_x"))).alias("_rows"))
    y, x = F.transform("_rows", lambda row: row["_y"]), F.transform("_rows", lambda row: row["_x"])
    blocks = cut(grouped.select("batch", y.alias("y"), F.flatten(x).alias("x")))
    release(numbered)
    return blocks


def gradient(blocks: DataFrame, layers: Layers, positive: float = POSITIVE_WEIGHT) -> Step:
    """One pass over the blocks. Sums are of whole numbers, hence the same whatever task or attempt gives which part.

    Each task hands on one row per weight; what reaches the driver is one row per weight in all.
    """
    weights = flat(layers).size
    if weights > MOST_WEIGHTS:
        raise ValueError(f"a network of more than {MOST_WEIGHTS} weights")

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units, rows = np.zeros(weights + 1, dtype=object), 0
        for part in parts:
            for y, x in zip(part["y"], part["x"]):
                sums = _block_sums(layers, np.asarray(x).reshape(len(y), -1), np.asarray(y), positive)
                units += np.array([int(v) for v in np.rint(sums * UNITS)], dtype=object)
                rows += len(y)
        if rows:
            yield pd.DataFrame({"place": range(weights + 2), "units": [Decimal(v) for v in (*units, rows)]})

    sums = blocks.select("y", "x").mapInPandas(add, "place int, units decimal(38,0)").groupBy("place").agg(F.sum("units").alias("units"))
    found = {row["place"]: int(row["units"]) for row in sums.collect()}
    rows = found.get(weights + 1, 0)
    means = np.array([found.get(i, 0) / (UNITS * max(rows, 1)) for i in range(weights + 1)])
    return Step(rows, float(means[-1]), means[:-1])


def train(
    df: DataFrame,
    features: Sequence[str],
    label: str = "annotation",
    order: Sequence[str] = (*ANIMAL, "datetime"),
    hidden: Sequence[int] = (16,),
    positive: float = POSITIVE_WEIGHT,
    iterations: int = 40,
    rate: float = 0.05,
    seed: int = 42,
) -> Layers:
    """Adam steps with the gradient of all rows, positives ``positive`` times heavier. Inputs should be scaled.

    Without a row to learn from the network stays as it starts.
    """
    blocks = blocks_of(df, features, label, order, seed=seed)
    sizes = [len(features), *hidden, 1]
    weights = flat(start(sizes, seed))
    mean, spread = np.zeros_like(weights), np.zeros_like(weights)
    for i in range(1, iterations + 1):
        step = gradient(blocks, shaped(weights, sizes), positive)
        mean = 0.9 * mean + 0.1 * step.gradient
        spread = 0.999 * spread + 0.001 * step.gradient**2
        weights = weights - rate * (mean / (1 - 0.9**i)) / (np.sqrt(spread / (1 - 0.999**i)) + 1e-8)
    release(blocks)
    return shaped(weights, sizes)


def save(spark: SparkSession, layers: Layers, path: str) -> None:
    """One row per weight: layer, input (the bias comes after the last one), output, value."""
    rows = [
        (i, n, m, float(value))
        for i, (weights, bias) in enumerate(layers)
        for n, line in enumerate([*weights, bias])
        for m, value in enumerate(line)
    ]
    spark.createDataFrame(rows, "layer int, input int, output int, value double").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Layers:
    """A network stored as such a table, by whatever program."""
    table = spark.read.parquet(path)
    rows = table.orderBy("layer", "input", "output").limit(MOST_WEIGHTS + 1).collect()
    if len(rows) > MOST_WEIGHTS:
        raise ValueError(f"a network of more than {MOST_WEIGHTS} weights")
    layers = []
    for layer in sorted({row["layer"] for row in rows}):
        mine = [row for row in rows if row["layer"] == layer]
        values = np.array([row["value"] for row in mine]).reshape(-1, mine[-1]["output"] + 1)
        layers.append((values[:-1], values[-1]))
    return layers


def score(
    layers: Layers, df: DataFrame, features: Sequence[str], label: str = "annotation", keep: Sequence[str] = (), batch_rows: int = 4096
) -> DataFrame:
    """Every row with truth ``y``, ``probability`` and class ``y_pred``, as ``models.score`` gives them."""

    def make():
        return lambda x: probabilities(layers, x)

    predict = predict_batch_udf(make, return_type=T.DoubleType(), batch_size=batch_rows, input_tensor_shapes=[[len(features)]])
    rows = df.select(*keep, F.col(label).cast("int").alias("y"), _values(features).alias("_x"))
    rows = rows.withColumn("_whole", _whole(F.col("_x")))
    blank = F.array_repeat(F.lit(0.0), len(features))
    scored = rows.withColumn("probability", predict(F.when(F.col("_whole"), F.col("_x")).otherwise(blank)))
    scored = scored.withColumn("probability", F.when(F.col("_whole"), F.col("probability"))).drop("_x", "_whole")
    return scored.withColumn("y_pred", F.when(F.col("probability").isNotNull(), class_tag(F.col("probability"))))

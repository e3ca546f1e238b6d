"""Model inputs: lag embeddings, sliding sequences, padded sequences."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F

from herdsignal.operators.series import ANIMAL, BLOCK, number_rows, packed, rank_all, rolling

# Lags, sequence length, padding, batch size, matrix columns in their order.
LAGS = 144
SEQUENCE_ROWS = 288
PAD_VALUE = -1.0
BATCH_SIZE = 10
MATRIX = ("annotation", "DIM", "act", "act_group_mean", "temp_filtered")
TREE_LAGS = ("act", "act_group_mean")


def lag_embedding(
    df: DataFrame,
    columns: Sequence[str],
    lags: int = LAGS,
    keys: Sequence[str] = ANIMAL,
    time: str = "datetime",
    ties: Sequence[str] = (),
    block_rows: int = 4096,
    bucket_days: int = 7,
) -> DataFrame:
    """Columns ``{name}0`` to ``{name}{lags-1}``: the value k rows earlier, null at the start.

    Lags are looked up in the arrays of a block's values, instead of one window expression per lag.
    """
    windows = lag_windows(df, columns, lags, keys, time, ties, block_rows, bucket_days)
    return windows.withColumns(_lag_columns(columns, lags)).drop(*map(_window_of, columns))


def _window_of(name: str) -> str:
    return f"_lags_{name}"


def _lag_columns(columns: Sequence[str], lags: int) -> dict[str, Column]:
    return {f"{name}{k}": F.get(_window_of(name), F.lit(k)) for name in columns for k in range(lags)}


def lag_windows(
    df: DataFrame,
    columns: Sequence[str],
    lags: int = LAGS,
    keys: Sequence[str] = ANIMAL,
    time: str = "datetime",
    ties: Sequence[str] = (),
    block_rows: int = 4096,
    bucket_days: int = 7,
) -> DataFrame:
    """Arrays ``_lags_{name}`` of a row's last ``lags`` values, its own first; shorter at the start of a series.

    The blocks are small and their windows are ``lags`` times as large, so they are dealt to as many tasks as a
    shuffle may have, whatever their size suggests.
    """
    numbered = number_rows(df, keys, time, ties, "_row", "_row_total", bucket_days)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def look_up(part: DataFrame, window: WindowSpec) -> DataFrame:
        values = {f"_values_{name}": F.col(f"_rows.{name}") for name in columns}
        rows = packed(part.repartition(tasks, *keys, BLOCK), keys, "_row").withColumns(values)
        placed = rows.select(*keys, BLOCK, *values, F.posexplode("_rows").alias("_pos", "_this"))
        first, length = F.greatest(F.col("_pos") - lags + 1, F.lit(0)), F.least(F.col("_pos") + 1, F.lit(lags))
        windows = [F.reverse(F.slice(f"_values_{name}", first + 1, length)).alias(_window_of(name)) for name in columns]
        return placed.select(*keys, BLOCK, "_this.*", *windows)

    return rolling(numbered, look_up, lags - 1, 0, keys, time, row="_row", block_rows=block_rows).drop("_row", "_row_total")


def _tree_windows(df: DataFrame, lags: int, **series) -> DataFrame:
    """Arrays of the rounded lags of activity and group mean beside the other columns of ``df``; no nulls.

    Whether a lag is missing is asked of the two arrays, not of every lag's column: a condition over hundreds of columns
    becomes one method that the JVM runs uncompiled. What is missing is NaN there, which ``array_contains`` finds in
    compiled code; a filter by a lambda is interpreted and makes Spark copy the block's arrays for each of its rows.
    """
    missing = F.lit(float("nan")).cast("float")
    rounded = df.withColumns({name: F.coalesce(F.bround(name, 2).cast("float"), missing) for name in TREE_LAGS})
    rest = [name for name in df.columns if name not in TREE_LAGS]
    windows = lag_windows(rounded, TREE_LAGS, lags, **series)
    for name in TREE_LAGS:
        windows = windows.where((F.size(_window_of(name)) == lags) & ~F.array_contains(_window_of(name), missing))
    return windows.na.drop(subset=rest)


def tree_matrix(df: DataFrame, lags: int = LAGS, **series) -> DataFrame:
    """Boosted-tree rows: rounded lags of activity and group mean, whole days in milk, no nulls."""
    windows = _tree_windows(df, lags, **series)
    embedded = windows.withColumns(_lag_columns(TREE_LAGS, lags)).drop(*TREE_LAGS, *map(_window_of, TREE_LAGS))
    return embedded.withColumn("DIM", F.col("DIM").cast("int"))


def tree_arrays(df: DataFrame, lags: int = LAGS, name: str = "inputs", **series) -> DataFrame:
    """The rows of ``tree_matrix`` with its features in one array of floats: days in milk, lags of activity, of group mean.

    One column instead of hundreds, which Spark neither compiles nor reads in batches; learners and scaler take it whole.
    """
    windows = _tree_windows(df, lags, **series)
    inputs = F.concat(F.array(F.col("DIM").cast("int").cast("float")), *map(_window_of, TREE_LAGS))
    return windows.withColumn(name, inputs).drop("DIM", *TREE_LAGS, *map(_window_of, TREE_LAGS))


def sequence_windows(
    df: DataFrame,
    columns: Sequence[str],
    label: str,
    length: int = SEQUENCE_ROWS,
    stride: int = 1,
    name: str = "sequence",
    keys: Sequence[str] = ANIMAL,
    time: str = "datetime",
    ties: Sequence[str] = (),
    block_rows: int = 4096,
    bucket_days: int = 7,
) -> DataFrame:
    """For every ``stride``-th row the ``length`` rows from it on, as an array of structs; only full windows.

    The label of a window is that of its first row. Windows are slices of a block's rows, so only the
    chosen ones are built.
    """
    numbered = number_rows(df, keys, time, ties, "seq_no", "seq_no_total", bucket_days)
    wanted = numbered.select(*keys, time, label, F.struct(*columns).alias("_v"), "seq_no", "seq_no_total")

    def slices(part: DataFrame, window: WindowSpec) -> DataFrame:
        blocks = packed(part, keys, "seq_no").withColumns(
            {"_start": F.col("_rows")[0]["seq_no"], "_values": F.col("_rows._v")}
        )
        first = F.pmod(-F.col("_start"), F.lit(stride))
        end = F.least(F.lit(block_rows), F.size("_rows") - length + 1)
        # An array of starts; empty where the block holds no full window.
        starts = F.when(first < end, F.sequence(first.cast("int"), (end - 1).cast("int"), F.lit(stride)))
        placed = blocks.select("*", F.explode(starts).alias("_at"))
        head = F.get("_rows", F.col("_at"))
        return placed.select(
            *keys,
            BLOCK,
            head[time].alias(time),
            head["seq_no"].alias("seq_no"),
            head["seq_no_total"].alias("seq_no_total"),
            head[label].alias(label),
            F.slice("_values", F.col("_at") + 1, F.lit(length)).alias(name),
        )

    windows = rolling(wanted, slices, 0, length - 1, keys, time, row="seq_no", block_rows=block_rows)
    return windows.select(*keys, time, "seq_no", label, name)


def flat_window(sequence: str, columns: Sequence[str]):
    """One float array of all values of a window, row by row."""
    return F.flatten(F.transform(sequence, lambda row: F.array(*[row[c].cast("float") for c in columns])))


def pad_sequences(
    df: DataFrame,
    columns: Sequence[str] = MATRIX,
    batch_size: int = BATCH_SIZE,
    chunk_rows: int = 4320,
    pad: float = PAD_VALUE,
    keys: Sequence[str] = ANIMAL,
    time: str = "datetime",
    bucket_days: int = 7,
) -> DataFrame:
    """One sequence per animal, padded to the longest of its batch; the true length is kept.

    A sequence comes in chunks of ``chunk_rows`` rows, numbered by ``chunk``, because an animal may
    have any number of rows; joined in order the chunks are the whole padded sequence. Batches are
    ``batch_size`` animals in key order.
    """
    numbered = number_rows(df, keys, time, row="_row", bucket_days=bucket_days)
    values = F.array(*[F.col(name).cast("float") for name in columns])
    chunks = (
        numbered.groupBy(*keys, F.floor(F.col("_row") / chunk_rows).alias("chunk"))
        .agg(F.array_sort(F.collect_list(F.struct("_row", values.alias("v")))).alias("_rows"))
        .withColumn("rows", F.transform("_rows", lambda row: row["v"]))
        .drop("_rows")
    )
    lengths = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("length"))
    batched = rank_all(lengths, list(keys), "_rank").withColumn("batch", F.floor(F.col("_rank") / batch_size))
    longest = batched.groupBy("batch").agg(F.max("length").alias("padded_length"))
    frame = (
        batched.join(longest, "batch")
        .drop("_rank")
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("padded_length") - 1) / chunk_rows))))
    )
    target = F.least(F.lit(chunk_rows), F.col("padded_length") - F.col("chunk") * chunk_rows)
    filler = F.array(*[F.lit(pad).cast("float") for _ in columns])
    have = F.coalesce("rows", F.array().cast("array<array<float>>"))
    return (
        frame.join(chunks, [*keys, "chunk"], "left")
        .withColumn("rows", F.concat(have, F.array_repeat(filler, (target - F.size(have)).cast("int"))))
        .select("batch", *keys, "length", "padded_length", "chunk", "rows")
    )


def unpad(padded: DataFrame, columns: Sequence[str] = MATRIX, keys: Sequence[str] = ANIMAL, chunk_rows: int = 4320) -> DataFrame:
    """Back to one row per time step; padding is recognised by a label of -0.5 or less."""
    rows = padded.select(*keys, "chunk", F.posexplode("rows").alias("_pos", "_values"))
    named = [F.col("_values")[i].alias(name) for i, name in enumerate(columns)]
    position = (F.col("chunk") * chunk_rows + F.col("_pos")).alias("seq_no")
    return rows.select(*keys, position, *named).where(F.col(columns[0]) > -0.5)


def training_matrix(df: DataFrame, keys: Sequence[str] = ANIMAL, time: str = "datetime") -> DataFrame:
    """Label and features as float32 in their fixed order, without incomplete rows."""
    complete = df.na.drop(subset=list(MATRIX))
    return complete.select(*keys, time, *[F.col(name).cast("float").alias(name) for name in MATRIX])


#: Steps of the permutation of an epoch, and the most walks back into the range of the rows.
STEPS, WALKS = 8, 64


def epoch_keys(seed: int, epoch: int) -> list[int]:
    """A number below a million for each step of the permutation, odd and even steps told apart by their last bit."""
    drawn = [int(hashlib.md5(f"{seed}|{epoch}|{i}".encode()).hexdigest()[:8], 16) % 500_000 for i in range(STEPS)]
    return [2 * k + i % 2 for i, k in enumerate(drawn)]


def epoch_place(row: str, rows: int, seed: int = 42, epoch: int = 0) -> Column:
    """The place of row number ``row`` (0 to ``rows`` - 1) in the shuffled order of an epoch: a bijection, without a sort.

    A Feistel network over pairs (number div width, number mod width): in turns one half is moved by a function of the
    other, within its own range, which can be undone whatever the function. The pairs are hardly more than the rows;
    a place beyond the last row goes through the network again. Any partitioning gives the same places.
    """
    height = math.isqrt(max(rows - 1, 0)) + 1
    width = -(-rows // height)
    keys = "array(" + ", ".join(f"{k}L" for k in epoch_keys(seed, epoch)) + ")"
    mix = lambda x: f"((({x} % 1000003 + k) * ({x} % 1000003 + k)) % 999983 * 31 + {x} div 7)"
    high, low = f"(v div {width}L)", f"(v % {width}L)"
    moved_high = f"(({high} + {mix(low)}) % {height}L) * {width}L + {low}"
    moved_low = f"{high} * {width}L + ({low} + {mix(high)}) % {width}L"
    step = f"if(k % 2 = 0, {moved_high}, {moved_low})"
    network = lambda x: f"aggregate({keys}, {x}, (v, k) -> {step})"
    walk = f"aggregate(sequence(1, {WALKS}), {network(f'cast(`{row}` as bigint)')}, (p, i) -> if(p < {rows}L, p, {network('p')}))"
    return F.expr(walk)


def epoch_batches(df: DataFrame, rows: int, batch_rows: int, seed: int = 42, epoch: int = 0, row: str = "row_id") -> DataFrame:
    """``df``, whose ``row`` counts from 0 to ``rows`` - 1, with the batch and the place in it of each row in an epoch."""
    placed = df.withColumn("_place", epoch_place(row, rows, seed, epoch))
    return placed.withColumns({"batch": F.expr(f"_place div {batch_rows}"), "place": F.expr(f"_place % {batch_rows}")}).drop("_place")

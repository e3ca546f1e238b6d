"""Windows over cut series against pandas over whole series. One animal holds most of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from herdsignal.operators import features, labels, sequences, series

SMALL = dict(block_rows=40, bucket_days=1)


def herd(seed: int = 1) -> pd.DataFrame:
    """Ticks with gaps; the first animal has about ten times the rows of the others."""
    rng = np.random.default_rng(seed)
    parts = []
    for animal, ticks in (("hot", 3000), ("b", 300), ("c", 200), ("d", 1)):
        kept = np.sort(rng.choice(ticks * 2, ticks, replace=False))
        parts.append(
            pd.DataFrame(
                {
                    "organisation_id": "o",
                    "animal_id": animal,
                    "datetime": pd.Timestamp("2020-01-01") + pd.to_timedelta(kept * 10, unit="min"),
                    "act": np.where(rng.random(ticks) < 0.1, np.nan, rng.integers(0, 100, ticks)),
                    "temp": np.where(rng.random(ticks) < 0.1, np.nan, 38 + rng.integers(-60, 20, ticks) / 10),
                    "raw": (rng.random(ticks) < 0.3).astype(int),
                }
            )
        )
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="module")
def pandas_herd():
    return herd()


@pytest.fixture(scope="module")
def frame(spark, pandas_herd):
    from herdsignal.operators.clean import nulls_for_nan

    loaded = spark.createDataFrame(pandas_herd).withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))
    return nulls_for_nan(loaded).repartition(5)


def collected(df, *columns):
    return df.select("animal_id", "datetime", *columns).toPandas().sort_values(["animal_id", "datetime"]).reset_index(drop=True)


def expected(pdf, function):
    parts = [function(group.reset_index(drop=True)) for _, group in pdf.sort_values(["animal_id", "datetime"]).groupby("animal_id")]
    return pd.concat(parts, ignore_index=True)


def same(mine, theirs):
    np.testing.assert_allclose(mine.astype(float).to_numpy(), theirs.astype(float).to_numpy(), rtol=1e-9, atol=1e-9)


def test_number_rows(frame, pandas_herd):
    mine = collected(series.number_rows(frame, total="n", bucket_days=1), "row_no", "n")
    same(mine.row_no, expected(pandas_herd, lambda g: pd.Series(range(len(g)))))
    same(mine.n, expected(pandas_herd, lambda g: pd.Series([len(g)] * len(g))))


def test_spike_filter(frame, pandas_herd):
    def whole(g):
        temp = g.temp
        centred = lambda s, n: s.rolling(n, min_periods=1, center=True)
        median = centred(temp, 288).median()
        variance = temp.rolling(288, min_periods=1).var()
        spike = temp < median - 0.55 * variance
        once = temp.where(~spike, centred(temp, 72).mean())
        twice = once.where(~spike, centred(once, 36).mean())
        return pd.DataFrame({"median": median, "variance": variance, "spike": spike, "filtered": twice})

    theirs = expected(pandas_herd, whole)
    result = features.filter_temperature(frame, keep_statistics=True, block_rows=500, bucket_days=1)
    mine = collected(result, "temp_median", "temp_var", "spike", "temp_filtered")
    same(mine.temp_median, theirs["median"])
    same(mine.temp_var, theirs.variance)
    assert (mine.spike == theirs.spike).all() and theirs.spike.sum() > 50
    same(mine.temp_filtered, theirs.filtered)


def test_heat_feature(frame, pandas_herd):
    given = frame.withColumn("act_group_mean", F.lit(50.0))
    mine = collected(features.heat_feature(given, **SMALL), "heat_feature")
    same(mine.heat_feature, expected(pandas_herd, lambda g: (g.act - 50).rolling(12, min_periods=1).sum()))


def test_running(frame, pandas_herd):
    mine = collected(series.running_sum(frame, F.col("raw"), "total", bucket_days=1), "total")
    same(mine.total, expected(pandas_herd, lambda g: g.raw.cumsum()))
    mine = collected(series.running_last(frame, F.col("act"), "filled", bucket_days=1), "filled")
    same(mine.filled, expected(pandas_herd, lambda g: g.act.ffill()))


@pytest.mark.parametrize("hold_off", [3, 30, 720])
def test_debounce(frame, pandas_herd, hold_off):
    def whole(g):
        out, silent_until = [], -1
        for i, raw in enumerate(g.raw):
            if i and g.raw[i - 1] == 1 and raw == 0:
                silent_until = i + hold_off - 1
            out.append(0 if i <= silent_until else raw)
        return pd.Series(out)

    options = SMALL if hold_off <= 40 else dict(block_rows=720, bucket_days=1)
    mine = collected(labels.debounce(frame, hold_off=hold_off, **options), "annotation")
    same(mine.annotation, expected(pandas_herd, whole))


def test_debounce_example(spark):
    raw = [0, 0, 1, 1, 0, 0, 1, 0, 0, 0]
    rows = spark.createDataFrame([("o", "a", i, r) for i, r in enumerate(raw)], "organisation_id string, animal_id string, i int, raw int")
    timed = rows.withColumn("datetime", F.timestamp_seconds(F.col("i") * 600).cast("timestamp_ntz"))
    found = [r.annotation for r in labels.debounce(timed, hold_off=3).orderBy("i").collect()]
    assert found == [0, 0, 1, 1, 0, 0, 0, 0, 0, 0]


def test_lags_and_windows(frame, pandas_herd):
    mine = collected(sequences.lag_embedding(frame, ["act"], 7, **SMALL), *[f"act{k}" for k in range(7)])
    for k in range(7):
        same(mine[f"act{k}"], expected(pandas_herd, lambda g, k=k: g.act.shift(k)))
    windows = sequences.sequence_windows(frame, ["raw", "act"], "raw", length=5, stride=3, **SMALL)
    rows = windows.orderBy("animal_id", "seq_no").collect()
    truth = {a: g.reset_index(drop=True) for a, g in pandas_herd.sort_values("datetime").groupby("animal_id")}
    assert len(rows) == sum(len(range(0, len(g) - 4, 3)) for g in truth.values())
    for r in rows:
        part = truth[r.animal_id].iloc[r.seq_no : r.seq_no + 5]
        assert [s.raw for s in r.sequence] == list(part.raw) and r.raw == part.raw.iloc[0]


def test_label_runs(frame, pandas_herd):
    mine = labels.label_runs(frame.withColumn("heat", F.col("raw") == 1), "heat", bucket_days=1)
    found = sorted((r.animal_id, r.first_ts, r.last_ts, r.rows) for r in mine.collect())
    want = []
    for animal, g in pandas_herd.sort_values("datetime").groupby("animal_id"):
        run = (g.raw != g.raw.shift()).cumsum()
        for _, part in g[g.raw == 1].groupby(run):
            want.append((animal, part.datetime.iloc[0], part.datetime.iloc[-1], len(part)))
    assert found == sorted(want)


def test_single_row_has_no_variance(frame):
    row = collected(features.temperature_statistics(frame), "temp_var").query("animal_id == 'd'")
    assert row.temp_var.isna().all()


def test_result_does_not_depend_on_partitioning(frame):
    once = collected(features.filter_temperature(frame), "temp_filtered")
    again = collected(features.filter_temperature(frame.repartition(3, "datetime")), "temp_filtered")
    same(once.temp_filtered, again.temp_filtered)


def test_rank_all(frame, pandas_herd):
    ranked = series.rank_all(frame, ["animal_id", "datetime"], "rank", total="n").toPandas()
    want = pandas_herd.sort_values(["animal_id", "datetime"]).reset_index(drop=True)
    mine = ranked.sort_values("rank").reset_index(drop=True)
    assert list(mine["rank"]) == list(range(len(want))) and (mine.n == len(want)).all()
    assert (mine.animal_id == want.animal_id).all() and (mine.datetime == want.datetime).all()


def test_frames_by_row_position(spark):
    rows = spark.range(700).select(
        F.lit("o").alias("organisation_id"),
        F.lit("a").alias("animal_id"),
        F.timestamp_seconds(F.col("id") * 600).cast("timestamp_ntz").alias("datetime"),
        F.col("id").cast("double").alias("temp"),
    )

    def bounds(part, window):
        frames = {"median": (-144, 143), "mean": (-36, 35), "filler": (-18, 17)}
        return part.withColumns(
            {f"{n}_{edge}": f("temp").over(window.rowsBetween(*b)) for n, b in frames.items() for edge, f in (("low", F.min), ("high", F.max))}
        )

    middle = series.rolling(rows, bounds, 144, 143, block_rows=150).where("temp = 350").collect()[0]
    assert (middle.median_low, middle.median_high) == (206, 493)
    assert (middle.mean_low, middle.mean_high) == (314, 385)
    assert (middle.filler_low, middle.filler_high) == (332, 367)

import math

import numpy as np
import pandas as pd
import pytest
from conftest import at
from pyspark.sql import functions as F

from herdsignal.operators import forecast, metrics, models, scaling, sequences, split
from herdsignal.plans import catalog_series


def keyed(spark, animals, rows=1):
    return spark.range(animals * rows).select(
        F.lit("o").alias("organisation_id"),
        (F.col("id") % animals).cast("string").alias("animal_id"),
        F.timestamp_seconds(F.floor(F.col("id") / animals) * 600).cast("timestamp_ntz").alias("datetime"),
        F.col("id").cast("double").alias("act"),
    )


def test_scaler(spark):
    given = keyed(spark, 4, 25).withColumns({"act": F.when(F.col("act") != 7, F.col("act")), "flat": F.lit(3.0)})
    scaler = scaling.fit_scaler(given, ["act", "flat"])
    fitted = scaler.collect()[0]
    values = np.array([v for v in range(100) if v != 7], dtype=float)
    assert math.isclose(fitted.act_mean, values.mean()) and math.isclose(fitted.act_std, values.std()) and fitted.flat_std == 1.0
    scaled = scaling.scale(given, scaler, ["act", "flat"])
    check = scaled.agg(F.avg("act"), F.stddev_pop("act"), F.max("flat"), F.count("act")).collect()[0]
    assert abs(check[0]) < 1e-6 and abs(check[1] - 1) < 1e-6 and check[2] == 0 and check[3] == 99
    assert scaled.schema["act"].dataType.simpleString() == "float"


@pytest.mark.parametrize("animals, test", [(10, 4), (1, 1), (100, 33), (7000, 2310)])
def test_key_split(spark, animals, test):
    sides = split.split_by_key(keyed(spark, animals, 2)).toPandas()
    assert (sides.split == "test").sum() == test and len(sides) == animals and sides.animal_id.is_unique
    again = split.split_by_key(keyed(spark, animals, 2).repartition(7)).toPandas()
    assert set(map(tuple, sides.itertuples(index=False))) == set(map(tuple, again.itertuples(index=False)))


def test_row_split_is_stable(spark):
    given = keyed(spark, 50, 100)
    sides = split.split_rows(given)
    share = sides.where("split = 'test'").count() / 5000
    assert 0.30 < share < 0.36
    assert sides.exceptAll(split.split_rows(given.repartition(3))).count() == 0


def counted(spark):
    rows = [(0, 0, 495676930), (0, 1, 32952514), (1, 0, 322323), (1, 1, 2281286)]
    return spark.createDataFrame(rows, "y int, y_pred int, n long")


def test_published_matrix(spark):
    matrix = {(r.y, r.y_pred): r for r in metrics.confusion(counted(spark), weight="n").collect()}
    assert matrix[1, 1].n == 2281286 and round(matrix[0, 0].share, 6) == 0.937664
    lines = {r["class"]: r for r in metrics.report(counted(spark), weight="n").collect()}
    assert lines["accuracy"].support == 531233053 and round(lines["accuracy"].f1, 6) == 0.937363
    heat = lines["heat"]
    assert (round(heat.precision, 6), round(heat.recall, 6), round(heat.f1, 6)) == (0.064747, 0.876201, 0.120584)


def test_metrics_with_an_absent_class(spark):
    given = spark.createDataFrame([(0, 0)] * 2, "y int, y_pred int")
    assert [r.n for r in metrics.confusion(given).orderBy("y", "y_pred").collect()] == [2, 0, 0, 0]
    lines = {r["class"]: r for r in metrics.report(given).collect()}
    assert (lines["heat"].precision, lines["heat"].f1, lines["no heat"].f1, lines["macro avg"].f1) == (0.0, 0.0, 1.0, 0.5)
    shown = metrics.accuracy(given).collect()[0]
    assert (shown.accuracy, shown.accuracy_positive, shown.accuracy_negative) == (100, None, 100)


def test_losses(spark):
    given = spark.createDataFrame([(1, 0.3), (0, -2.0), (0, 90.0)], "y int, logit double")
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    want = (250 * -math.log(sigmoid(0.3)) - math.log(1 - sigmoid(-2.0)) + 90.0) / 3
    assert math.isclose(metrics.cross_entropy(given).collect()[0].loss, want, rel_tol=1e-9)
    sure = spark.createDataFrame([(1, 0.0), (0, 0.5)], "y int, probability double")
    assert math.isclose(metrics.plain_cross_entropy(sure).collect()[0].loss, (100 + math.log(2)) / 2)


def test_histogram_closes_the_last_bin(spark):
    given = spark.range(101).select(F.col("id").cast("double").alias("x"))
    rows = metrics.histogram(given, "x").orderBy("bin").collect()
    assert len(rows) == 50 and rows[-1].n == 3 and sum(r.n for r in rows) == 101
    flat = metrics.histogram(given.select(F.lit(2.0).alias("x")), "x")
    assert flat.agg(F.sum("n")).collect()[0][0] == 101


@pytest.mark.parametrize("chunk", [4, 7, 1000])
def test_pad_and_unpad(spark, chunk):
    lengths = {"a": 3, "b": 9, "c": 1, "d": 8}
    rows = [("o", a, at(f"2020-01-01 00:{i:02d}:00"), i % 2, float(i)) for a, n in lengths.items() for i in range(n)]
    given = spark.createDataFrame(rows, "organisation_id string, animal_id string, datetime timestamp_ntz, annotation int, act double")
    padded = sequences.pad_sequences(given, ["annotation", "act"], batch_size=2, chunk_rows=chunk)
    whole = {}
    for r in padded.orderBy("animal_id", "chunk").collect():
        whole.setdefault(r.animal_id, []).extend(r.rows)
        assert r.length == lengths[r.animal_id] and r.batch == "abcd".index(r.animal_id) // 2
    assert {a: len(v) for a, v in whole.items()} == {"a": 9, "b": 9, "c": 8, "d": 8}
    assert whole["a"][3:] == [[-1.0, -1.0]] * 6 and whole["a"][:3] == [[0.0, 0.0], [1.0, 1.0], [0.0, 2.0]]
    back = sequences.unpad(padded, ["annotation", "act"], chunk_rows=chunk)
    assert sorted((r.animal_id, r.seq_no, r.act) for r in back.collect()) == sorted((a, i, float(i)) for a, n in lengths.items() for i in range(n))


def test_tree_matrix(spark):
    given = keyed(spark, 1, 10).withColumns({"annotation": F.lit(1), "DIM": F.lit(2.9), "act": F.col("act") + 0.125, "act_group_mean": F.lit(1.0)})
    rows = sequences.tree_matrix(given, lags=3).orderBy("datetime").collect()
    assert len(rows) == 8 and rows[0].DIM == 2 and "act" not in rows[0]
    assert [round(v, 2) for v in (rows[0].act0, rows[0].act1, rows[0].act2)] == [2.12, 1.12, 0.12]


def test_tree_matrix_with_gaps_in_many_tasks(spark):
    lost, nan = {5}, {17}
    value = F.when(F.col("act") == 17, F.lit(float("nan"))).when(F.col("act") != 5, F.col("act"))
    given = keyed(spark, 1, 400).withColumns({"act_group_mean": F.lit(1.0), "annotation": F.lit(0), "DIM": F.lit(1), "act": value})
    matrix = sequences.tree_matrix(given, lags=4, block_rows=40)
    assert matrix.columns == ["organisation_id", "animal_id", "datetime", "annotation", "DIM", *[f"{n}{k}" for n in ("act", "act_group_mean") for k in range(4)]]
    whole = [i for i in range(3, 400) if not (lost | nan) & set(range(i - 3, i + 1))]
    assert sorted((r.act0, r.act1, r.act2, r.act3) for r in matrix.collect()) == [(i, i - 1, i - 2, i - 3) for i in whole]
    # A few kilobytes of rows become hundreds of columns, so their size must not decide on the number of tasks.
    assert "REPARTITION_BY_NUM" in matrix._jdf.queryExecution().executedPlan().toString()


def test_models_learn_and_persist(spark, tmp_path):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"x": rng.random(600), "z": rng.random(600)})
    pdf["annotation"] = (pdf.x > 0.7).astype(int)
    given = spark.createDataFrame(pdf)
    for model in (
        models.train_trees(given, ["x", "z"], rounds=3, depth=3),
        models.train_weighted(given, ["x", "z"]),
        models.train_network(given, ["x", "z"], hidden=(4,), iterations=60),
    ):
        scored = models.score(model, given)
        assert scored.columns == ["y", "probability", "y_pred"]
        assert metrics.report(scored).where("class = 'heat'").collect()[0].recall > 0.8
    models.save_model(model, str(tmp_path / "m"))
    again = models.score(models.load_model(str(tmp_path / "m")), given)
    assert scored.exceptAll(again).count() == 0
    scaler = scaling.fit_scaler(given, ["x"])
    scaling.save_scaler(scaler, str(tmp_path / "s"))
    assert scaling.load_scaler(spark, str(tmp_path / "s")).collect() == scaler.collect()
    trees = models.train_trees(models.class_weight(given), ["x", "z"], weight="weight", rounds=2, depth=2)
    assert metrics.accuracy(models.score(trees, given)).collect()[0].accuracy_positive > 90


def least_squares_arma(x, order=forecast.LONG_ORDER):
    n = len(x)
    lagged = lambda t: np.array([1, *[x[t - k] for k in range(1, order + 1)]])
    rows = range(order + 1, n)
    long = np.linalg.lstsq(np.array([lagged(t) for t in rows]), x[order + 1 :], rcond=None)[0]
    r = np.array([np.nan if t < order else x[t] - lagged(t) @ long for t in range(n)])
    design = np.array([[1, x[t - 1], r[t - 1]] for t in rows])
    c, phi, theta = np.linalg.lstsq(design, x[order + 1 :], rcond=None)[0]
    theta = min(max(theta, -forecast.MAX_THETA), forecast.MAX_THETA)
    out, e = np.empty(n), 0.0
    for t in range(n):
        out[t] = x.mean() if t == 0 else c + phi * x[t - 1] + theta * e
        e = x[t] - out[t]
    return c, phi, theta, out


def test_arma_against_a_plain_loop(spark):
    rng = np.random.default_rng(4)
    parts, want = [], {}
    for animal, n in (("long", 12000), ("short", 60), ("tiny", 3)):
        x, before, shock = np.empty(n), 5.0, 0.0
        for t in range(n):
            new = rng.normal()
            x[t] = 2 + 0.6 * before + new + 0.4 * shock
            before, shock = x[t], new
        times = pd.Timestamp("2020-01-01") + pd.to_timedelta(np.arange(n) * 10, unit="min")
        parts.append(pd.DataFrame({"organisation_id": "o", "animal_id": animal, "datetime": times, "act": x}))
        want[animal] = x
    given = spark.createDataFrame(pd.concat(parts)).withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))
    found = forecast.arma11(given.repartition(5), block_rows=5000).toPandas().sort_values(["animal_id", "datetime"])
    assert len(found) == 12063
    for animal in ("long", "short"):
        mine = found[found.animal_id == animal]
        c, phi, theta, out = least_squares_arma(want[animal])
        np.testing.assert_allclose(mine[["constant", "phi", "theta"]].iloc[0].astype(float), [c, phi, theta], rtol=1e-6)
        np.testing.assert_allclose(mine.prediction.astype(float), out, rtol=1e-6, atol=1e-6)
    fitted = found[found.animal_id == "long"].iloc[0]
    assert abs(fitted.phi - 0.6) < 0.05 and abs(fitted.theta - 0.4) < 0.07
    assert found[found.animal_id == "tiny"].prediction.isna().all()


def test_blocks_across_batches():
    rng = np.random.default_rng(5)
    sizes = [("a", 0, 16), ("a", 1, 16), ("a", 2, 1), ("b", 2, 40), ("c", 2, 3)]
    blocks = [pd.DataFrame({"k": k, "_block": b, "_t": range(b * 16, b * 16 + n), "_u": rng.normal(size=n), "theta": 0.1 * (i + 1)}) for i, (k, b, n) in enumerate(sizes)]
    rows = pd.concat(blocks, ignore_index=True)
    want = np.concatenate([forecast._residuals(b["_u"].to_numpy(), -b["theta"].iloc[0]) for b in blocks])
    for size in (1, 5, 16, 100):
        parts = [rows.iloc[:0], *[rows.iloc[i : i + size] for i in range(0, len(rows), size)]]
        found = pd.concat(forecast._within_blocks(["k", "_block"])(iter(parts)))
        assert found["_e"].tolist() == want.tolist() and found["_t"].tolist() == rows["_t"].tolist()


def test_small_blocks_are_no_groups_of_their_own(spark, monkeypatch):
    plans = []
    written = forecast.cut
    monkeypatch.setattr(forecast, "cut", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df, name))
    coefficients = spark.createDataFrame([("o", "0", 2.0, 0.5, 0.4)], "organisation_id string, animal_id string, constant double, phi double, theta double")
    assert forecast.predict(keyed(spark, 1, 50), coefficients, block_rows=16).count() == 50
    assert "REPARTITION_BY_NUM" in plans[0] and "FlatMapGroupsInPandas" not in plans[0]


def test_model_queries_have_the_default_lags():
    assert catalog_series._FEATURES == ["DIM", *[f"{name}{k}" for name in ("act", "act_group_mean") for k in range(sequences.LAGS)]]


def test_scores_of_many_features(spark):
    names = [f"f{i}" for i in range(289)]
    rows = spark.range(40).selectExpr("cast(id % 2 as int) AS annotation", *[f"cast(if(id = 3 and {i} = 288, null, id * {i} % 7) as double) AS {n}" for i, n in enumerate(names)])
    scored = models.score(models.train_weighted(rows, names), rows).collect()
    assert len(scored) == 40 and sum(r.probability is None for r in scored) == 1


def test_tree_arrays_hold_the_matrix(spark):
    value = F.when(F.col("act") == 17, F.lit(float("nan"))).when(F.col("act") != 5, F.col("act") + 0.125)
    given = keyed(spark, 2, 100).withColumns({"act_group_mean": F.col("act") % 7, "annotation": F.lit(0), "DIM": F.lit(2.9), "act": value})
    matrix, arrays = sequences.tree_matrix(given, lags=4, block_rows=40), sequences.tree_arrays(given, lags=4, block_rows=40)
    names = ["DIM", *[f"{n}{k}" for n in ("act", "act_group_mean") for k in range(4)]]
    want = {(r.animal_id, r.datetime): [r[n] for n in names] for r in matrix.collect()}
    assert {(r.animal_id, r.datetime): r.inputs for r in arrays.collect()} == want and len(want) == arrays.count() > 100


def test_learners_and_scaler_take_one_array(spark, tmp_path):
    rows = [(i % 2, [float(i % 2) + i * 0.001, float(i % 5)] if i else [None, 1.0], *([i % 2 + i * 0.001, float(i % 5)] if i else [None, 1.0])) for i in range(200)]
    given = spark.createDataFrame(rows, "annotation int, v array<double>, x double, z double")
    one, two = scaling.fit_scaler(given, ["v"]), scaling.fit_scaler(given, ["x", "z"]).first()
    assert np.allclose([*one.first().v_mean, *one.first().v_std], [two.x_mean, two.z_mean, two.x_std, two.z_std])
    flat = scaling.scale(scaling.scale(given, scaling.fit_scaler(given, ["x", "z"]), ["x", "z"]), one, ["v"]).collect()
    assert np.allclose([r.v for r in flat[1:]], [(r.x, r.z) for r in flat[1:]], atol=1e-6) and flat[0].v[0] is None
    for train in (models.train_weighted, models.train_network, lambda df, names: models.train_trees(df, names, rounds=2, depth=2)):
        model = train(given, "v")
        models.save_model(model, str(tmp_path / "m"))
        got = models.score(models.load_model(str(tmp_path / "m")), given).collect()
        want = models.score(train(given, ["x", "z"]), given).collect()
        assert [r.probability is None for r in got] == [i == 0 for i in range(200)]
        assert [r.probability for r in got[1:]] == pytest.approx([r.probability for r in want[1:]], abs=1e-6)


def test_few_long_series_are_learned_from_in_many_tasks(spark, monkeypatch):
    value = (F.col("act") * 7 % 100).cast("double")
    flagged = keyed(spark, 2, 1200).select("organisation_id", "animal_id", "datetime", value.alias("act"), value.alias("temp"), (value > 90).cast("int").alias("raw"))
    monkeypatch.setattr(catalog_series.R, "long_flagged", lambda spark, folder: flagged)
    train, test = catalog_series._parts(spark, "")
    assert train.count() == test.count() == 1200 - 143 and "SortMergeJoin" not in train._jdf.queryExecution().executedPlan().toString()

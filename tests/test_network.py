"""The weighted network, its batch scoring, and files that cannot be read."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from herdsignal.operators import metrics, models, network
from herdsignal.sources import quarantine


def rare(spark, rows=3000, seed=1):
    """One row in thirty is positive, on a ring that no line cuts off, in noise."""
    drawn = np.random.default_rng(seed)
    x = drawn.normal(size=(rows, 2))
    pdf = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "key": [f"k{i % 7}" for i in range(rows)], "place": range(rows)})
    pdf["annotation"] = ((x**2).sum(axis=1) + drawn.normal(size=rows) * 0.4 > 6.5).astype(int)
    return spark.createDataFrame(pdf)


ORDER = ("key", "place")


def plain_gradient(layers, x, y, positive):
    """By differences of the loss."""
    weights, sizes = network.flat(layers), network.sizes_of(layers)

    def loss(values):
        h = x
        for i, (w, b) in enumerate(network.shaped(values, sizes)):
            h = h @ w + b if i == len(sizes) - 2 else 1 / (1 + np.exp(-(h @ w + b)))
        p = 1 / (1 + np.exp(-h[:, 0]))
        return np.mean(-positive * y * np.log(p) - (1 - y) * np.log(1 - p))

    steps = np.eye(len(weights)) * 1e-6
    return loss(weights), np.array([(loss(weights + s) - loss(weights - s)) / 2e-6 for s in steps])


def test_gradient_against_differences_and_any_partitioning(spark):
    given = rare(spark, 500)
    layers = network.start([2, 3, 2, 1], seed=3)
    pdf = given.toPandas()
    loss, want = plain_gradient(layers, pdf[["a", "b"]].to_numpy(), pdf.annotation.to_numpy(), 250)
    found = [
        network.gradient(network.blocks_of(rows, ["a", "b"], order=ORDER, block_rows=64).repartition(n), layers)
        for rows, n in ((given, 1), (given.repartition(5), 3))
    ]
    assert found[0].rows == 500 and abs(found[0].loss - loss) < 1e-9
    np.testing.assert_allclose(found[0].gradient, want, rtol=1e-5, atol=1e-6)
    assert found[0].loss == found[1].loss and (found[0].gradient == found[1].gradient).all()


def test_weights_raise_the_recall_of_the_rare_class(spark):
    given = rare(spark)
    recalls = {}
    for positive in (1.0, 250.0):
        layers = network.train(given, ["a", "b"], order=ORDER, hidden=(8,), positive=positive, iterations=25, rate=0.2)
        scored = network.score(layers, given, ["a", "b"])
        recalls[positive] = metrics.report(scored).where("class = 'heat'").collect()[0].recall
    assert recalls[250.0] > recalls[1.0] and recalls[250.0] > 0.9


def test_stored_network_scores_every_row(spark, tmp_path):
    layers = network.start([2, 3, 1], seed=5)
    network.save(spark, layers, str(tmp_path / "n"))
    loaded = network.load(spark, str(tmp_path / "n"))
    assert (network.flat(loaded) == network.flat(layers)).all() and network.sizes_of(loaded) == [2, 3, 1]
    given = spark.createDataFrame(
        [(1, 0.5, -1.0, 1), (2, None, 1.0, 0), (3, float("nan"), 1.0, 0), (4, float("inf"), 1.0, 0), (5, 2.0, 0.0, None)],
        "id int, a double, b double, annotation int",
    )
    rows = {r.id: r for r in network.score(loaded, given, ["a", "b"], keep=["id"], batch_rows=2).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5] and [rows[i].probability for i in (2, 3, 4)] == [None] * 3 and rows[2].y_pred is None
    want = network.probabilities(layers, np.array([[0.5, -1.0], [2.0, 0.0]]))
    np.testing.assert_allclose([rows[1].probability, rows[5].probability], want, rtol=1e-12)
    assert rows[5].y is None and rows[1].y_pred == int(want[0] > 0.5)


def test_nothing_to_learn_from(spark):
    none = rare(spark, 5).where("a > 100")
    layers = network.train(none, ["a", "b"], order=ORDER, hidden=(2,), iterations=2)
    assert (network.flat(layers) == network.flat(network.start([2, 2, 1]))).all()
    assert network.score(layers, none, ["a", "b"]).count() == 0


def test_repeated_rows_of_one_key(spark):
    """Copies of a row all count and spread over the blocks."""
    given = rare(spark, 50).withColumns({"key": F.lit("k"), "place": F.lit(0)})
    blocks = network.blocks_of(given.unionByName(given), ["a", "b"], order=ORDER, block_rows=16)
    layers = network.start([2, 2, 1])
    twice, once = network.gradient(blocks, layers), network.gradient(network.blocks_of(given, ["a", "b"], order=ORDER), layers)
    assert twice.rows == 100 and blocks.agg(F.max(F.size("y"))).collect()[0][0] == 16
    np.testing.assert_allclose(twice.gradient, once.gradient, rtol=1e-9, atol=1e-9)


def test_model_scores_and_network_scores_have_the_same_columns(spark):
    given = rare(spark, 60)
    model = models.train_weighted(given, ["a", "b"])
    assert models.score(model, given).schema.simpleString() == network.score(network.start([2, 2, 1]), given, ["a", "b"]).schema.simpleString()


@pytest.mark.parametrize("name", ["cut in half", "a hole", "no parquet"])
def test_unreadable_parquet(spark, tmp_path, name):
    folder = tmp_path / "t"
    spark.range(20000).selectExpr("id", "cast(id * 7919 % 10007 as double) AS x").repartition(3).write.parquet(str(folder))
    whole = next(folder.glob("*.parquet")).read_bytes()
    half = len(whole) // 2
    spoilt = {"cut in half": whole[:half], "a hole": whole[: half // 2] + bytes(half) + whole[half // 2 + half :], "no parquet": b"id,x\n" * 9}
    (folder / "odd name|%20.parquet").write_bytes(spoilt[name])
    (folder / "empty.parquet").write_bytes(b"")
    rows, failures = quarantine.read_parquet(spark, str(folder), "id long, x double")
    found = failures.collect()
    assert [r.path.rpartition("/")[2] for r in found] == ["odd name|%20.parquet"] and found[0].reason
    assert rows.count() == 20000 and rows.agg(F.sum("id")).collect()[0][0] == sum(range(20000))


def test_all_parquet_files_are_fine(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "t"))
    rows, failures = quarantine.read_parquet(spark, str(tmp_path / "t"), "id long")
    assert rows.count() == 10 and failures.count() == 0


def test_unreadable_sensor_files(spark, tmp_path):
    good = {"1|0.csv": "ts,act,temp\n1577836800,1.5,38.0\n1577837400,2.5,38.5\n", "2|0.csv": "temp,ts,act\n38.0,1577836800,3.5", "3|0.csv": "ts,act,temp\n", "7|0.csv": ""}
    bad = {"4|0.csv": b"ts,act,temp\n1577836800,1.5,38.0\n15778", "5|0.csv": b"act,temp\n1,2\n", "6|0.csv": b"ts,act,temp\n1577836800,\xff\xfe,38.0\n"}
    for name, text in good.items():
        (tmp_path / name).write_text(text)
    for name, data in bad.items():
        (tmp_path / name).write_bytes(data)
    rows, failures = quarantine.read_sensor_files(spark, str(tmp_path))
    assert sorted((r.animal_id, r.act, r.temp) for r in rows.collect()) == [("1", 1.5, 38.0), ("1", 2.5, 38.5), ("2", 3.5, 38.0)]
    reasons = {r.path.rpartition("/")[2]: r.reason for r in failures.collect()}
    assert sorted(reasons) == sorted(bad) and "cut off" in reasons["4|0.csv"] and "header" in reasons["5|0.csv"]
    assert "Unicode" in reasons["6|0.csv"]


def test_long_lines_over_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quarantine, "PIECE", 16)
    text = "ts,act,temp\n" + "1577836800,1.5,38.0\n" * 50
    path = tmp_path / "1|0.csv"
    path.write_text(text)
    assert quarantine._try_csv(*quarantine.open_at(f"file:{path}")) is None
    path.write_text(text[:-12])
    assert quarantine._try_csv(*quarantine.open_at(f"file://{path}")) == "the last line is cut off"

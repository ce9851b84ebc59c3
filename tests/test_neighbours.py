"""Nearest rows by boxes of points: the same as from all pairs, from few of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import joins, neighbours
from gridloom.operators import anomaly, models


def wanted(x, y, k):
    d = np.sqrt(((y[:, None] - x[None]) ** 2).sum(2))
    return [list(np.lexsort((np.arange(len(x)), row))[:k]) for row in d]


@pytest.mark.parametrize("kind", ["spread", "planes", "ties", "one far", "wide"])
def test_leaves_find_the_nearest_among_few(monkeypatch, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20_000, 12 if kind == "wide" else 2))
    if kind == "planes":
        x[:, 0] = rng.integers(0, 25, len(x))
    if kind == "ties":
        x = np.round(x, 1) + 0.0
    if kind == "one far":
        x[7] = 1e6
    seen, plain = [], neighbours._squares
    monkeypatch.setattr(neighbours, "_squares", lambda y, x: seen.append(len(y) * len(x)) or plain(y, x))
    leaves = neighbours.Leaves(x, 5)
    home = leaves.home(x)
    by = np.argsort(home, kind="stable")
    blocks = [by[i : i + neighbours.BLOCK] for i in range(0, len(by), neighbours.BLOCK)]
    for i, block in enumerate(blocks):
        q, at, _ = leaves.nearest(x[block], home[block], 5, True)
        if i % 50 == 0 or 7 in block:
            assert [list(at[q == j]) for j in range(len(block))] == wanted(x, x[block], 5)
    assert kind == "wide" or sum(seen) < len(x) ** 2 / 10


def test_a_factor_sends_few_of_equal_points(spark, monkeypatch):
    sent, plain = [], neighbours.Leaves.__init__
    monkeypatch.setattr(neighbours.Leaves, "__init__", lambda self, x, k: sent.append(len(x)) or plain(self, x, k))
    df = spark.range(5000).select("id", (F.col("id") % 5).cast("double").alias("x"), F.lit(1.0).alias("y"))
    found = anomaly.local_outlier_factor(df, "id", ["x", "y"], 10)
    assert found.where("lof = 1").count() == 5000
    assert sent == [5 * 11]


@pytest.mark.parametrize("chunk", [64_000_000, 30_000])
def test_nearest_rows_in_slabs(spark, monkeypatch, chunk):
    monkeypatch.setattr(joins, "CHUNK_BYTES", chunk)
    x = np.random.default_rng(4).normal(size=(2000, 2))
    x[::3] = np.round(x[::3])  # copies
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, x0 double, x1 double")
    found = neighbours.nearest_rows(df, df, 4, same=True, root=True).orderBy("id_", "d", "id").toPandas()
    assert len(found) == 8000
    for i, row in enumerate(wanted(x, x, 5 + 2000)):
        row.remove(i)
        assert list(found["id"][4 * i : 4 * i + 4]) == row[:4]


def test_infinite_rows_are_no_neighbours(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, float("inf"))], "id long, x0 double")
    assert sorted(tuple(r) for r in neighbours.nearest_rows(df, df, 2, same=True).collect()) == [(0, 1, 1.0), (1, 0, 1.0)]
    assert neighbours.nearest_rows(df.where("id = 2"), df, 1).count() == 0


def test_a_forest_scores_on_all_cores(spark):
    df = spark.range(100).select("id", F.sqrt("id").alias("x")).coalesce(1)
    assert anomaly.isolation_forest(df, "id", ["x"], trees=2).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_distances_that_round_to_one_are_in_order_of_key(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 1.5e-8), (2, 0.0, 1.0), (3, 0.0, 1.1)], "id long, x double, y double")
    found = {r["id"]: r["lof"] for r in anomaly.local_outlier_factor(df, "id", ["x", "y"], 1).collect()}
    assert found[0] == pytest.approx(1)  # SQL orders by the root, so row 1 is nearest


def test_a_prediction_sends_few_of_equal_points(spark, monkeypatch):
    sent, plain = [], neighbours.Leaves.__init__
    monkeypatch.setattr(neighbours.Leaves, "__init__", lambda self, x, k: sent.append(len(x)) or plain(self, x, k))
    df = spark.range(5000).select("id", (F.col("id") % 5).cast("double").alias("x"), F.when(F.col("id") < 25, F.col("id") % 5).otherwise(9).alias("label"))
    found = models.nearest_neighbours(df, df, "id", "label", ["x"])
    assert found.where("prediction = id % 5").count() == 5000  # of equal points those of least key vote
    assert sent == [5 * 5]

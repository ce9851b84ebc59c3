import random

import pytest
from pyspark.sql import functions as F

from gridloom.errors import NotSupported
from gridloom.functions import decorators
from gridloom.operators import selection, text


def test_fisher_exact():
    assert selection.fisher_exact(8, 2, 1, 5) == pytest.approx(0.03496503, rel=1e-5)
    assert selection.fisher_exact(3, 1, 1, 3) == pytest.approx(0.48571429, rel=1e-6)
    assert selection.fisher_exact(0, 0, 0, 0) == 1.0


def test_clusters_and_modes(spark):
    rng = random.Random(5)
    data = [(i, rng.gauss(10 * (i % 3), 1), rng.gauss(10 * (i % 3), 1)) for i in range(240)]
    df = spark.createDataFrame(data, "k long, a double, b double")
    found = selection.mean_shift(df, "k", ["a", "b"], bandwidth=4.0)
    assert found.select("cluster").distinct().count() == 3
    assert found.groupBy((F.col("k") % 3).alias("g")).agg(F.count_distinct("cluster").alias("n")).agg(F.max("n")).first()[0] == 1
    assert selection.silhouette(found, ["a", "b"]) > 0.9
    assert selection.principal_components(df, ["a", "b"], 1).select("pc1").count() == 240
    odd = df.union(spark.createDataFrame([(999, 0.0, 20.0)], df.schema))
    assert selection.reconstruction_errors(odd, ["a", "b"]).orderBy(F.desc("error")).first()["k"] == 999


def test_modes_come_from_all_rows(spark):
    rng = random.Random(7)
    centres = [(0, 0, 6000), (20, 0, 5985), (40, 40, 12), (-40, 40, 3)]
    data = [(x + rng.gauss(0, 1), y + rng.gauss(0, 1), g) for g, (x, y, n) in enumerate(centres) for _ in range(n)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "k long, a double, b double, g int")
    assert selection.clean.sample(df, "k", 100).where("g = 3").count() == 0  # a sample of rows lacks a mode
    pairs = selection.mean_shift(df, "k", ["a", "b"], bandwidth=6.0, seeds=100).groupBy("g", "cluster").count().collect()
    assert sorted((r["g"], r["count"]) for r in pairs) == [(g, n) for g, (*_, n) in enumerate(centres)]
    assert len({r["cluster"] for r in pairs}) == 4
    same = spark.createDataFrame([(i, 5.0) for i in range(20)] + [(20, 9.0)], "k long, a double")
    assert selection.mean_shift(same, "k", ["a"]).select("cluster").distinct().count() == 2


def test_search_and_heads(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(i, a := rng.gauss(0, 1), 3 * a, float(a > 0), [a, rng.gauss(0, 1)]) for i in range(150)], "k long, a double, y double, l double, v array<double>")
    best = selection.grid_search(df, "k", "y", ["a"], "elastic_net", {"regParam": [0.001, 10.0]}, k=2)
    assert best["options"] == {"regParam": 0.001} and best["test"]["r2"] > 0.9
    held = best["predictions"]
    assert held.columns == ["k", "y", "prediction"] and 10 < held.count() < 60
    heads = selection.best_head(df, "k", "l", "v", ("logistic", "svc"), k=2)
    assert set(heads) == {"logistic", "svc"} and max(heads.values()) > 0.9


def test_small_helpers(spark):
    ranks = selection.average_rank(spark.createDataFrame([("g", 1), ("g", 1), ("g", 2)], "g string, v int"), ["g"], "v")
    assert sorted(r["rank"] for r in ranks.collect()) == [1.5, 1.5, 3.0]
    assert [selection.short_number(x) for x in (None, 3, 3.14159, 1234, 5.6e6, 7e9)] == ["–", "3", "3.14", "1.2K", "5.6M", "7.0B"]
    with pytest.raises(NotSupported, match="pretrained"):
        selection.refuse("image_cnn")


def test_linkage_and_text_vectors(spark):
    rng = random.Random(9)
    spots = [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)]
    data = [(i, [x + rng.gauss(0, 0.05) for x in spots[i % 3]]) for i in range(90)] + [(100, None)]
    found = selection.agglomerate(spark.createDataFrame(data, "k long, v array<double>"), "k", "v", 3, grains=20)
    groups = {}
    for r in found.collect():
        groups.setdefault(r["cluster"], set()).add(r["k"] % 3)
    assert found.count() == 90 and len(groups) == 3 and all(len(g) == 1 for g in groups.values())
    texts = spark.createDataFrame([(1, "red apples and pears"), (2, "Red apples, pears!"), (3, "steel bridges"), (4, None), (5, "")], "k long, t string")
    vectors = {r["k"]: r["embedding"] for r in text.hashed_embeddings(texts, "k", "t", 256).collect()}
    cosine = lambda a, b: sum(x * y for x, y in zip(vectors[a], vectors[b]))
    assert cosine(1, 2) > 0.8 and abs(cosine(1, 3)) < 0.3 and cosine(1, 1) == pytest.approx(1) and not any(vectors[4]) and not any(vectors[5])
    assert {r["w"] for r in texts.select(text.normalise("t").alias("w")).collect()} == {"red apples pears", "steel bridges", ""}
    labelled = spark.createDataFrame([(i, "good fine nice" if i % 2 else "bad poor sad", "p" if i % 2 else "n") for i in range(60)] + [(60, "good", None), (61, None, "p")], "k long, t string, l string")
    predicted = selection.text_classifier(labelled, "k", "t", "l").collect()
    assert len(predicted) == 62 and all(r["prediction"] == r["label"] for r in predicted if r["label"] is not None and r["k"] < 60)
    assert next(r for r in predicted if r["k"] == 60)["prediction"] == "p"


def test_decorators():
    calls = []

    @decorators.retry(3, 0, (KeyError,))
    def shaky():
        calls.append(1)
        if len(calls) < 3:
            raise KeyError("x")
        return 7

    assert shaky() == 7 and len(calls) == 3
    with pytest.raises(ValueError):
        decorators.validate(x=lambda v: v > 0)(lambda x: x)(0)
    assert decorators.suppress(5)(lambda: 1 / 0)() == 5
    with pytest.warns(DeprecationWarning):
        decorators.deprecated("old")(lambda: 1)()
    once = decorators.once(lambda: calls.append(1) or len(calls))
    assert once() == once() == 4
    assert decorators.timer(decorators.memory_usage(decorators.log_call(lambda: 3)))() == 3 and decorators.cache(lambda x: x + 1)(1) == 2

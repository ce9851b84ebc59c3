import random

from pyspark.sql import functions as F

from gridloom.operators import explain, models


def test_lime_follows_a_linear_model(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(i, a := rng.gauss(0, 1), b := rng.gauss(0, 2), 3 * a - b) for i in range(200)], "k long, a double, b double, y double")
    fitted = models.train(df, "y", ["a", "b"], "linear")
    weights = explain.lime(df, fitted, "k", ["a", "b"], draws=100)
    assert weights.select("k").distinct().count() == 50
    found = {r["feature"]: r["importance"] for r in explain.lime_importance(weights).collect()}
    assert abs(found["a"] - 3) < 0.4 and abs(found["b"] - 2) < 0.4
    assert explain.top_features(explain.lime_importance(weights), 1).first()["feature"] == "a"


def test_word_dropout(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p q r s t"), (2, "a b"), (3, None), (4, "a b c")], "k long, t string")
    found = {r["k"]: r["augmented"] for r in explain.word_dropout(df, "k", "t").collect()}
    assert len(found[1].split()) == 18 and found[2] == "a b" and found[3] is None and len(found[4].split()) == 2


def test_training_pairs(spark):
    df = spark.range(60).select(F.col("id").alias("k"), (F.col("id") % 3).alias("l"))
    pairs = explain.training_pairs(df, "k", "l", 2)
    assert pairs.count() == 240 and pairs.where("k = other").count() == 0
    assert pairs.where((F.col("k") % 3 == F.col("other") % 3) != F.col("same")).count() == 0


def test_shapley_values_of_a_linear_model(spark):
    rng = random.Random(8)
    data = [(i, rng.gauss(0, 1), rng.gauss(0, 2), "ab"[i % 2]) for i in range(200)]
    df = spark.createDataFrame(data, "k long, a double, b double, s string").withColumn("y", 3 * F.col("a") - F.col("b") + F.when(F.col("s") == "a", 5.0).otherwise(0.0))
    fitted = models.train(df, "y", ["a", "b", "s"], "linear")
    one = spark.createDataFrame([(0.5, 1.0, "b")], "a double, b double, s string")
    values = {(r["k"], r["feature"]): r["shap"] for r in explain.shapley(df, fitted, "k", ["a", "b", "s"], one, orders=3, rows=10).collect()}
    assert len(values) == 30
    by_id = {r[0]: r for r in data}
    for (k, c), v in values.items():
        _, a, b, s = by_id[k]
        assert abs(v - {"a": 3 * (a - 0.5), "b": -(b - 1.0), "s": 5.0 * (s == "a")}[c]) < 1e-3
    top = explain.shapley_importance(explain.shapley(df, fitted, "k", ["a", "b", "s"], orders=5)).orderBy(F.desc("importance")).first()
    assert top["feature"] in ("a", "s")

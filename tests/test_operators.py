"""Edge cases on small hand-made tables."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.errors import ConfigError, DataLoadError, DataValidationError, DriftDetectionError, NotSupported
from gridloom.functions import joins, quantiles
from gridloom.operators import anomaly, charts, clean, drift, fairness, metrics, models, profile, selection, text
from gridloom.operators import timeseries as ts
from gridloom.operators.features import FeatureEngineer
from gridloom.roles import ColumnRoles, nan_to_null
from gridloom.sources import files


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_roles_and_nan(spark):
    df = spark.createDataFrame([(1, 2.0, "a", True), (2, math.nan, None, None)], "i int, x double, s string, b boolean")
    assert ColumnRoles.of(df) == ColumnRoles(("i", "x"), ("s",), ("b",), (), ())
    assert nan_to_null(df).where("x is null").count() == 1


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, s string")
    for suffix in ("parquet", "csv", "json"):
        path = str(tmp_path / f"t.{suffix}")
        files.save(df, path)
        assert files.load(spark, path).count() == 2
    with pytest.raises(DataLoadError):
        files.load(spark, str(tmp_path / "none.parquet"))
    with pytest.raises(DataLoadError):
        files.load(spark, str(tmp_path / "t.xlsx"))
    with pytest.raises(DataValidationError):
        files.load(spark, str(tmp_path / "t.parquet"), target="y")
    assert rows(files.from_records(spark, {"instances": [{"a": 1}, {"a": 2}]}, "a long")) == [(1,), (2,)]
    assert rows(files.from_records(spark, {"a": 5}, "a long")) == [(5,)]
    nested = spark.createDataFrame([((1, (2,)),)], "a struct<b:int,c:struct<d:int>>")
    assert files.flatten(nested).columns == ["a.b", "a.c.d"]
    assert files.pipeline_config("data: x\ntarget: y\ntask: regression")["test_size"] == 0.2
    for bad in ("data: x", "data: x\ntarget: y\ntask: r\nother: 1", "[]"):
        with pytest.raises(ConfigError):
            files.pipeline_config(bad)
    assert files.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


def test_profile_of_empty_and_constant_tables(spark):
    empty = spark.createDataFrame([], "a int, s string")
    assert [r["missing_pct"] for r in profile.describe(empty).collect()] == [None, None]
    assert rows(profile.duplicates(empty)) == [(0, 0, None)]
    assert rows(profile.constants(empty)) == [("a",), ("s",)]
    df = spark.createDataFrame([(1, 10), (1, 10), (2, 20), (2, 20), (3, 30)], "a long, b long")
    assert rows(profile.duplicates(df)) == [(5, 2, 40.0)]
    assert rows(profile.correlations(df)) == [("a", "b", 1.0)]
    assert {r["column"]: r["flag"] for r in profile.cardinality(df).collect()} == {"a": "low-cardinality", "b": "low-cardinality"}
    assert profile.correlations(df.select("a")).count() == 0


def test_clean(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, 2)], "x long, y long")
    assert clean.clean(df).count() == 2
    spread = spark.createDataFrame([(float(i % 10), "k") for i in range(100)] + [(1000.0, "k"), (None, "k")], "x double, s string").withColumn("i", F.monotonically_increasing_id())
    assert clean.clean(spread, ["x"]).agg(F.max("x")).first()[0] == 9.0
    assert clean.clean(spread, ["x"]).where("x is null").count() == 0
    assert clean.clean(spread, ["x"], keep_nulls=True).where("x is null").count() == 1
    assert clean.clean(spread, ["x"], mode="simultaneous").count() == 100
    assert clean.clean(spread, exclude=("x", "i")).count() == 102
    with pytest.raises(DataValidationError):
        clean.clean(df, mode="none")


def test_joins(spark):
    a = spark.createDataFrame([(1, "l"), (None, "n")], "id long, v string")
    b = spark.createDataFrame([(1, "r"), (None, "m"), (3, "o")], "id long, v string")
    assert clean.integrate(a, b, "id", "inner").columns == ["id", "v", "v_right"]
    assert rows(clean.integrate(a, b, "id", "inner")) == [(1, "l", "r")]
    assert clean.integrate(a, b, "id", "full").count() == 4
    assert clean.integrate(a, b, None, "cross").count() == 6
    for on, how in (("id", "cross"), (None, "left"), ("id", "theta")):
        with pytest.raises(DataValidationError):
            clean.integrate(a, b, on, how)


def test_splits_are_stable(spark):
    df = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") % 4).alias("g"))
    test = clean.split(df, "k").where("is_test")
    assert 300 < test.count() < 500 and rows(test) == rows(clean.split(df.repartition(7), "k").where("is_test"))
    assert {r["count"] for r in clean.split(df, "k", by="g").where("is_test").groupBy("g").count().collect()} == {100}
    assert clean.folds(df, "k").select("fold").distinct().count() == 5
    assert clean.sample(df, "k", 10).count() == 10


def test_features(spark, tmp_path):
    rng = random.Random(1)
    data = [(math.exp(rng.gauss(0, 1)), float(i), f"c{i % 15}", float(i % 15)) for i in range(200)]
    df = spark.createDataFrame(data, "income double, age double, city string, y double").withColumn("day", F.expr("timestamp_ntz'2020-01-04'"))
    model = FeatureEngineer(auto_bin=True, n_bins=4).fit(df, "y")
    out = model.transform(df)
    assert {"income_log", "income_x_age", "city_target_enc", "day_month", "age_bin"} <= set(out.columns)
    assert not {"city", "day"} & set(out.columns)
    first = out.first()
    assert (first["day_day_of_week"], first["day_is_weekend"], first["day_quarter"]) == (6, 1, 1)
    unseen = model.transform(df.limit(1).withColumn("city", F.lit("new"))).first()
    assert unseen["city_target_enc"] == pytest.approx(7.0)
    assert out.select("age_bin").distinct().count() == 4
    assert model.transform(df.drop("city", "day")).count() == 200
    assert model.names(df) == out.columns
    model.save(spark, str(tmp_path / "features"))
    loaded = type(model).load(spark, str(tmp_path / "features")).transform(df)
    assert loaded.columns == out.columns and sorted(map(str, loaded.collect())) == sorted(map(str, out.collect()))
    again = FeatureEngineer().fit(df.select("age"))
    assert again.log == [] and again.encodings == {}


def test_drift(spark):
    rng = random.Random(2)
    a = spark.createDataFrame([(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(500)], "x double, y double")
    b = spark.createDataFrame([(rng.gauss(5, 1), rng.gauss(0, 1)) for _ in range(500)], "x double, y double")
    found = {r["feature"]: r for r in drift.detect(a, b).collect()}
    assert found["x"]["drifted"] and found["x"]["ks_statistic"] > 0.9 and not found["y"]["psi_drifted"]
    assert drift.summary(drift.detect(a, b)).first()["worst_feature"] == "x"
    same = drift.detect(a, a).collect()
    assert all(r["psi"] == pytest.approx(0) and r["ks_statistic"] == 0 and not r["drifted"] for r in same)
    constant = spark.createDataFrame([(1.0,)] * 5, "x double")
    assert {r["psi"] for r in drift.psi(constant, constant).collect()} == {0.0}
    assert tuple(drift.summary(drift.detect(a, b).where("false")).first()) == (0, 0, 0.0, 0.0, None)
    with pytest.raises(DriftDetectionError):
        drift.detect(a, spark.createDataFrame([("s",)], "z string"))
    assert drift.ks_p_value(0.5, 100, 100) < 1e-6 and drift.ks_p_value(0.0, 10, 10) == 1.0
    assert drift.ks_asymptotic(0.05, 5000, 5000) == pytest.approx(drift.ks_exact(0.05, 5000, 5000), rel=0.1)
    sketched = {r["feature"]: r["psi"] for r in drift.psi(a, b, accuracy=10_000).collect()}
    exact = {r["feature"]: r["psi"] for r in drift.psi(a, b).collect()}
    assert sketched.keys() == exact.keys() and all(abs(sketched[k] - exact[k]) < 0.5 for k in exact)


@pytest.mark.parametrize(("n", "m"), [(3, 4), (5, 5), (2, 7), (1, 1)])
def test_exact_p_value_counts_all_orders(n, m):
    def statistic(order):
        return max(abs(sum(order[:k]) / n - (k - sum(order[:k])) / m) for k in range(1, n + m + 1))

    found = [statistic([int(i in chosen) for i in range(n + m)]) for chosen in itertools.combinations(range(n + m), n)]
    for d in sorted(set(found)):
        assert drift.ks_exact(d, n, m) == pytest.approx(sum(x >= d - 1e-9 for x in found) / len(found))


def test_quantiles_of_any_size_equal_sorting(spark):
    rng = random.Random(5)
    data = [(g, float(rng.choice([rng.randrange(5), rng.gauss(0, 9)]))) for g in "ab" for _ in range(500)] + [("c", 3.0)]
    counts = spark.createDataFrame(data, "g string, x double").groupBy("g", "x").agg(F.count("*").alias("n"))
    found = quantiles.exact_quantiles(counts, "g", "x", "n", [0, 0.1, 0.37, 0.5, 1])
    for g in "abc":
        assert found[g] == pytest.approx(np.quantile([x for k, x in data if k == g], [0, 0.1, 0.37, 0.5, 1]).tolist())
    upto = {(r["g"], r["x"]): (r["n_upto"], r["n_total"]) for r in quantiles.cumulate(counts, "g", "x", ["n"]).collect()}
    assert all(upto[g, x] == (sum(k == g and y <= x for k, y in data), sum(k == g for k, _ in data)) for g, x in data)


def test_fairness(spark):
    perfect = spark.createDataFrame([(i % 2, i % 2, "ab"[(i // 2) % 2]) for i in range(100)], "y int, p int, g string")
    assert all(r["fair"] for r in fairness.metrics(fairness.group_rates(perfect, "y", "p", "g")).collect())
    biased = perfect.withColumn("p", F.when((F.col("g") == "a"), 0).otherwise(F.col("p")))
    found = {r["metric"]: r for r in fairness.metrics(fairness.group_rates(biased, "y", "p", "g")).collect()}
    assert len(found) == 5 and found["demographic_parity_ratio"]["value"] == 0 and not found["equal_opportunity_diff"]["fair"]
    alone = fairness.metrics(fairness.group_rates(biased.where("g = 'a'"), "y", "p", "g")).collect()
    assert {r["metric"]: r["value"] for r in alone}["disparate_impact_ratio"] == 1.0
    nulls = biased.withColumn("g", F.lit(None).cast("string"))
    assert fairness.group_rates(nulls, "y", "p", "g").first()["grp"] == "null"


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, None)], "y double, p double")
    r = metrics.regression(df, "y", "p").first()
    assert (r["n"], r["mse"], r["mae"]) == (2, 0.5, 0.5) and r["r2"] == pytest.approx(-1)
    assert metrics.regression(df.limit(1), "y", "p").first()["r2"] is None
    c = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "y string, p string")
    report = {r["label"]: r for r in metrics.classification_report(c, "y", "p").collect()}
    assert report["c"]["precision"] == 0 and report["c"]["f1"] == 0 and report["b"]["recall"] == 1
    assert metrics.classification(c, "y", "p").first()["accuracy"] == 0.5


def test_series(spark):
    y = [math.sin(2 * math.pi * i / 12) * 10 + 50 for i in range(120)]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(y)], "series string, pos int, value double")
    assert ts.seasonal_period(ts.autocorrelation(df)).first()["period"] == 12
    f = ts.forecast(df, 12, period=12, alpha=0.3).orderBy("step").collect()
    assert len(f) == 12 and all(r["lower"] <= r["forecast"] <= r["upper"] for r in f)
    assert all(abs(r["forecast"] - (math.sin(2 * math.pi * (119 + r["step"]) / 12) * 10 + 50)) < 3 for r in f)
    trend = spark.createDataFrame([("s", i, 50 + 0.5 * i) for i in range(120)], "series string, pos int, value double")
    assert ts.arima(trend, 5).where("step = 5").first()["forecast"] == pytest.approx(50 + 0.5 * 124, abs=1)
    assert ts.walk_forward(df.limit(30), 3, 10).orderBy("fold").first()["train_end"] == 15
    spiked = df.withColumn("value", F.when(F.col("pos") == 60, 500.0).otherwise(F.col("value")))
    assert [r["pos"] for r in ts.rolling_median_anomalies(spiked, 24).where("is_anomaly").collect()] == [60]
    f = ts.sarima(df, 12, 12).orderBy("step").collect()
    assert all(abs(r["forecast"] - (math.sin(2 * math.pi * (119 + r["step"]) / 12) * 10 + 50)) < 1 and r["lower"] <= r["forecast"] <= r["upper"] for r in f)
    with pytest.raises(Exception, match="over two periods"):
        ts.sarima(df.where("pos < 20"), 3, 12).collect()
    unnamed = df.withColumn("series", F.lit(None).cast("string")).withColumn("residual", F.col("value") - 50)
    assert ts.residual_anomalies(unnamed, "residual").count() == 120 and ts.autocorrelation(unnamed).count() == 61
    assert (ts.auto_method(100, 12), ts.auto_method(20, 12), ts.auto_method(50, 1)) == ("sarima", "exp_smoothing", "arima")


def test_outliers(spark):
    rng = random.Random(3)
    data = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(300)] + [(1000, 9.0, 9.0)]
    df = spark.createDataFrame(data, "k long, x double, y double")
    assert anomaly.local_outlier_factor(df, "k", ["x", "y"]).orderBy(F.desc("lof")).first()["k"] == 1000
    assert anomaly.isolation_forest(df, "k", ["x", "y"]).orderBy(F.desc("score")).first()["k"] == 1000
    with pytest.raises(DataValidationError):
        anomaly.local_outlier_factor(df.limit(10), "k", ["x"])
    z = anomaly.standardise(df.withColumn("c", F.lit(1.0)), ["x", "c"])
    assert z.agg(F.stddev_pop("x_z")).first()[0] == pytest.approx(1) and z.agg(F.max("c_z")).first()[0] == 0
    scored = anomaly.flag_top(df.select("k", "x"), "x", 0.05)
    assert scored.where("is_anomaly").count() == 15
    with pytest.raises(DataValidationError):
        anomaly.consensus(df, ["missing"])


@pytest.mark.parametrize("chunk", [64_000_000, 2000])
def test_chunks_change_no_neighbour_and_no_loss(spark, monkeypatch, chunk):
    rng = np.random.default_rng(7)
    x = rng.integers(-8, 8, size=(200, 2)).astype(float)  # many ties of distance
    labels = rng.integers(0, 3, 200)
    rows_of = [(i, float(a), float(b), None if i == 7 else str(c), [float(a), float(b), 1.0]) for i, ((a, b), c) in enumerate(zip(x, labels))]
    df = spark.createDataFrame(rows_of, "k long, x double, y double, l string, v array<double>")
    monkeypatch.setattr(joins, "CHUNK_BYTES", chunk)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    near = [sorted(range(200), key=lambda j: (round(d[i, j], 9), j))[:5] for i in range(200)]
    reach = np.array([d[i, near[i][-1]] for i in range(200)])
    lrd = np.array([1 / (np.mean([max(d[i, j], reach[j]) for j in near[i]]) + 1e-10) for i in range(200)])
    lof = {r["k"]: r["lof"] for r in anomaly.local_outlier_factor(df, "k", ["x", "y"], k=5).collect()}
    assert len(lof) == 200
    assert all(lof[i] == pytest.approx(np.mean(lrd[near[i]]) / lrd[i], rel=1e-6) for i in range(200))
    known = df.where("k >= 50")
    found = {r["k"]: r["prediction"] for r in models.nearest_neighbours(known, df.where("k < 50"), "k", "l", ["x", "y"], 1).collect()}
    for i in range(50):
        least = min(d[i, j] for j in range(50, 200))
        assert found[i] in {str(labels[j]) for j in range(50, 200) if d[i, j] < least + 1e-6}
    u = np.c_[x, np.ones(200)] / np.sqrt((x**2).sum(1) + 1)[:, None]
    gaps, same = 1 - u @ u.T, (labels[:, None] == labels) & (np.arange(200) != 7)[:, None] & (np.arange(200) != 7)
    pairs = np.triu_indices(200, 1)
    one = text.pair_losses(df, "k", "l", "v").first()
    assert one["n_pairs"] == len(pairs[0])
    assert one["contrastive"] == pytest.approx(np.where(same, gaps**2, np.maximum(0, 1 - gaps) ** 2)[pairs].mean())
    s = np.where(np.eye(200, dtype=bool), -np.inf, (1 - gaps) / 0.07)
    positive = same & ~np.eye(200, dtype=bool)
    each = [np.log(np.exp(s[i]).sum()) - s[i][positive[i]].mean() for i in range(200) if positive[i].any()]
    assert text.info_nce(df, "k", "l", "v").first()["loss"] == pytest.approx(np.mean(each))


def test_null_groups_stay(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "k int, l string")
    found = {r["k"]: r["weight"] for r in models.sample_weights(df, "l").collect()}
    assert found == {1: 0.75, 2: 0.75, 3: 1.5}
    assert charts.index_to(df, "l", "k").count() == 3
    assert clean.split(df, "k", 0.5, by="l").count() == 3


def test_hulls_folds_and_walks(spark, tmp_path):
    rng = random.Random(12)
    data = [(i, rng.gauss(0, 1), rng.gauss(0, 1), "ab"[i % 2]) for i in range(400)] + [(900, None, 1.0, "a"), (901, 0.0, 0.0, None)]
    df = spark.createDataFrame(data, "k long, x double, y double, g string").repartition(5)
    found = charts.hull(df, "x", "y", "g").orderBy("group", "at").collect()
    for g in "ab":
        mine = [(r["x"], r["y"]) for r in found if r["group"] == g]
        assert mine == charts.convex_hull(*zip(*[(x, y) for _, x, y, h in data if h == g and x is not None]))
    assert [(r["x"], r["y"]) for r in found if r["group"] is None] == [(0.0, 0.0)]
    even = clean.folds(df, "k", 4, by="g").groupBy("g", "fold").count().where("g is not null").collect()
    assert len(even) == 8 and all(50 <= r["count"] <= 51 for r in even)
    y = [math.sin(2 * math.pi * i / 12) * 10 + 50 for i in range(120)]
    series = spark.createDataFrame([(s, i, v) for s in ("s", None) for i, v in enumerate(y)], "series string, pos int, value double")
    scores = ts.walk_forward_scores(series, 3, 12, 12).collect()
    assert len(scores) == 6 and all(r["n"] == 12 and r["mae"] < 3 and r["mape"] < 10 for r in scores)
    stopped = models.train(df.na.drop(), "y", ["x"], "gbt_regressor", maxIter=40, early_stopping=True)
    assert stopped.stages[-1].getNumTrees < 40  # noise gains nothing
    files.save_vectors(spark.createDataFrame([(2, [3.0, 4.0]), (1, [1.0, 2.0]), (3, None)], "k long, v array<double>"), "v", str(tmp_path / "v.npy"), "k")
    assert np.load(tmp_path / "v.npy").tolist() == [[1, 2], [3, 4]]
    files.save(spark.createDataFrame([(1, [1.5])], "k long, v array<double>"), str(tmp_path / "v.csv"))
    assert spark.read.csv(str(tmp_path / "v.csv"), header=True).first()["v"] == "[1.5]"
    pixels = spark.createDataFrame([(i, [float(i % 2)] * 4) for i in range(20)] + [(20, None)], "k long, p array<double>")
    assert selection.cluster_arrays(pixels, "k", "p", 2).groupBy((F.col("k") % 2).alias("m"), "cluster").count().count() == 2
    assert files.as_table(spark, pd.DataFrame({"a": [1, 2]})).count() == 2 and files.as_table(spark, df) is df
    assert files.as_table(spark, pa.table({"a": [1]})).count() == 1


def test_charts_on_degenerate_data(spark):
    one = spark.createDataFrame([(1.0, 1.0)] * 3, "x double, y double")
    assert charts.histogram(one, "x", 4).agg(F.sum("n")).first()[0] == 3
    assert charts.hexbin(one, "x", "y").first()["n"] == 3
    assert {r["x"] for r in charts.min_max(one, ["x"]).collect()} == {0.0}
    zero = spark.createDataFrame([("a", 0.0)], "s string, v double")
    assert charts.index_to(zero, "s", "v").first()["index"] == 0 and charts.stack_share(zero, "s", "v").first()["share"] == 0


def test_models(spark):
    rng = random.Random(4)
    data = [(a := rng.gauss(0, 1), b := rng.gauss(0, 1), 2 * a + 0.5 * b + 1, int(a > 0)) for _ in range(300)]
    df = spark.createDataFrame(data, "a double, b double, y double, c int")
    m = models.linear_regression(df, "y", ["a", "b"])
    assert (m.intercept, *m.coefficients.values()) == pytest.approx((1, 2, 0.5))
    top = m.importance(df).orderBy(F.desc("importance")).first()
    assert top["feature"] == "a"
    for name, task, target in (("ridge", "regression", "y"), ("gbt_regressor", "regression", "y"), ("naive_bayes", "classification", "c"), ("logistic", "classification", "c")):
        fitted = models.train(df, target, ["a", "b"], name, task)
        found = fitted.transform(df)
        score = metrics.regression(found, target, "prediction").first()["r2"] if task == "regression" else metrics.classification(found, target, "prediction").first()["accuracy"]
        assert score > 0.85
    assert models.cluster(df, ["a", "b"], 3).select("cluster").distinct().count() == 3
    assert models.choose_model("regression", 500) == "linear" and models.choose_model("classification", 9000, rows_per_class=400) == "random_forest_classifier"
    for name in ("mlp_classifier", "psychometric", "sgd_classifier"):
        found = models.train(df, "c", ["a", "b"], name, "classification").transform(df)
        assert metrics.classification(found, "c", "prediction").first()["accuracy"] > 0.85
    svr = models.support_vector_regression(df.union(spark.createDataFrame([(0.0, 0.0, 500.0, 0)] * 5, df.schema)), "y", ["a", "b"], epsilon=0.001)
    assert (svr.intercept, *svr.coefficients.values()) == pytest.approx((1, 2, 0.5), abs=0.15)  # outliers pull little
    with pytest.raises(NotSupported):
        models.choose_model("study", geospatial=True)
    assert models.choose_model("regression", 100_000, numeric_only=True) == "sgd_regressor" and models.choose_model("regression", 5000) == "gbt_regressor"
    assert models.choose_model("regression", 5000, numeric_only=True, all_features_matter=True) == "ridge"
    assert models.choose_model("categorical_known", exogenous_type="categorical", n_features=3) == "psychometric"
    with pytest.raises(Exception, match="unknown model"):
        models.estimator("kriging")
    assert models.grid_size({"a": [1, 2], "b": [1, 2, 3]}, 5, 2.0) == (6, 60.0)
    assert models.stop_round([1, 2, 3, 3, 3, 5], 10, 20) == 4


def test_losses(spark):
    near = spark.createDataFrame([(i, i % 2, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(10)], "k int, l int, v array<double>")
    mixed = near.withColumn("l", F.when(F.col("k") < 5, 0).otherwise(1))
    for f, c in ((text.pair_losses, "backbone"), (text.info_nce, "loss")):
        assert f(near, "k", "l", "v").first()[c] < f(mixed, "k", "l", "v").first()[c]
    assert text.tf_idf(spark.createDataFrame([(1, None), (2, "")], "k int, t string"), "k", "t").count() == 0

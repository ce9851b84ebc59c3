import io
import json
import math
import random
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from gridloom import config
from gridloom.errors import ArtifactError, DataValidationError
from gridloom.operators import models, tuning
from gridloom.plans import chain as ch
from gridloom.plans import serve, services
from gridloom.plans.artifact import Artifact, compare, feature_schema
from gridloom.plans.report import Report, ReportStep, shade
from gridloom.streaming import monitor


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(6)
    data = [(i, a := rng.gauss(0, 1), b := rng.gauss(0, 1), rng.gauss(0, 1), 2 * a + b + rng.gauss(0, 0.1)) for i in range(400)]
    return spark.createDataFrame(data, "k long, a double, b double, noise double, y double").persist()


def test_chain_rules(table, tmp_path):
    flow = ch.Clean(table, exclude=("y",)) >> ch.Select("y", ["a", "b"]) >> ch.Choose("regression") >> ch.Train()
    assert repr(flow) == "Clean >> Select >> Choose >> Train"
    state = flow.run()
    assert state.model_name == "linear" and tuning.score(state.model.transform(table), "y", "regression")["r2"] > 0.99
    path = str(tmp_path / "r.html")
    report = (ReportStep("section", "<One>") >> ReportStep("table", table.limit(2)) >> ReportStep("save", path)).run()
    assert "&lt;One&gt;" in report.render() and open(path).read().startswith("<!DOCTYPE html>")
    with pytest.raises(TypeError):
        ch.Load(table) >> ReportStep("section", "x")
    with pytest.raises(TypeError):
        ch.Load(table) >> 3
    with pytest.raises(ValueError):
        ch.Chain([]).run()
    with pytest.raises(DataValidationError):
        (ch.Log("x") >> ch.Train()).run()


def test_report_parts(spark, table):
    r = Report("T").cards({"n": 1}).tabs({"a": "<p>x</p>"}).code("a<b").diff("a\nb", "a\nc").mermaid("graph").terminal(["$ ls"]).dark_toggle()
    r.chart("<svg></svg>").spec({"a": "</script>"})
    page = r.render()
    assert "a&lt;b" in page and "+c" in page and "<\\/script>" in page
    with pytest.raises(DataValidationError):
        r.table(spark.range(3000))
    with pytest.raises(DataValidationError):
        r.chart("<b>")
    assert [shade(v, 0.9, 0.5) for v in (1, 0.6, 0.1, None)] == ["good", "warn", "bad", ""]
    assert shade(0.01, 0.1, 0.5, higher_is_better=False) == "good"


def test_artifact_round_trip(spark, table, tmp_path):
    fitted = models.train(table, "y", ["a", "b"], "linear")
    path = str(tmp_path / "m")
    Artifact(fitted, {"target": "y"}, {"rmse": 0.1}, feature_schema(table.withColumn("s", F.lit("x")))).save(spark, path)
    found = Artifact.load(spark, path)
    assert found.schema["s"]["categories"] == ["x"] and found.schema["a"]["dtype"] == "double"
    assert found.model.transform(table).count() == 400
    rows = compare({"m": found, "n": Artifact(fitted, {}, {"mae": 1}, {})}, spark).collect()
    assert [tuple(r) for r in rows] == [("m", None, 0.1), ("n", 1.0, None)]
    with pytest.raises(ArtifactError):
        Artifact.load(spark, str(tmp_path / "none"))


def test_validation_and_search(table):
    cv = tuning.cross_validate(table, "k", "y", ["a", "b"], "linear", k=3)
    assert cv["r2"]["mean"] > 0.99
    loo = tuning.leave_one_out(table, "y", ["a", "b"])
    assert 0.08 < loo["rmse"] < 0.12
    assert tuning.leave_one_out(table.sparkSession.range(2000).selectExpr("id as a", "id as y"), "y", ["a"]) is None
    pred = models.linear_regression(table, "y", ["a", "b"]).predict(table)
    b = {r["metric"]: r for r in tuning.bootstrap(pred, "k", "y", "prediction", 50).collect()}
    assert b["rmse"]["low"] < b["rmse"]["mean"] < b["rmse"]["high"] and 0.08 < b["rmse"]["mean"] < 0.12
    found = tuning.random_search(table, "k", "y", ["a", "b"], "gbt_regressor", trials=2, space=lambda r: {"maxIter": 3, "maxDepth": r.randint(2, 4)})
    assert len(found["trials"]) == 2 and found["metric"] == "rmse"
    parzen = tuning.tpe_search(table, "k", "y", ["a", "b"], "ridge", trials=14, startup=6, ranges={"regParam": (1e-4, 100.0, "log")})
    early, late = ([o["regParam"] for _, o in parzen["trials"]][i] for i in (slice(0, 6), slice(6, 14)))
    assert len(late) == 8 and sorted(late)[4] < sorted(early)[3] and parzen["score"] == min(s for s, _ in parzen["trials"])
    won = tuning.halving(table, "k", "y", ["a", "b"], "elastic_net", [{"regParam": p} for p in (0.001, 5.0, 50.0)])
    assert won["options"] == {"regParam": 0.001}
    assert tuning.score(tuning.stacked(table, "k", "y", ["a", "b"], ["linear", "ridge"], 2), "y", "regression")["r2"] > 0.98


def test_bootstrap_with_refits(table):
    fast = tuning.bootstrap_cv(table, "k", "y", ["a", "b"], replicates=10).first()
    slow = tuning.bootstrap_cv(table, "k", "y", ["a", "b"], "ridge", replicates=10, regParam=1e-9).first()
    assert fast["metric"] == slow["metric"] == "r2"
    assert all(fast[c] == pytest.approx(slow[c], abs=1e-4) and 0.99 < fast[c] < 1 for c in ("mean", "low", "high"))
    assert {tuning.default_space(random.Random(i))["maxIter"] for i in range(300)} <= set(range(50, 301))


def test_services_keep_all_rows_and_score_raw_tables(spark, tmp_path):
    rng = random.Random(11)
    data = [(a := rng.gauss(0, 1), f"c{i % 15}", float(i % 15) + a + rng.gauss(0, 0.1)) for i in range(300)]
    data += [data[0]] * 5 + [(None, "c1", 1.0), (40.0, "c2", 2.0)]
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame(data, "x double, city string, y double").coalesce(2).write.parquet(path)
    found = services.detect_anomalies(spark, config.AnomalyConfig(data=path, contamination=0.02))
    assert found.count() == len(data) and found.where("x is null and is_anomaly").count() == 0
    assert found.where("x = 40 and is_anomaly").count() == 1
    saved = str(tmp_path / "model")
    made = services.train(spark, config.TrainConfig(data=path, target="y", engineer=True, save=saved, advanced_cv=True))
    assert "city_target_enc" in made.config["features"] and made.config["columns"] == ["x", "city"] and "cv_rmse" in made.metrics
    scored = services.predict(spark, saved, path)
    assert scored.columns == ["x", "city", "y", "prediction"]
    assert services.validate(spark, saved, path)["r2"] > 0.8
    importance = {r["feature"]: r["importance"] for r in services.explain(spark, saved, path).collect()}
    assert importance["city_target_enc"] > 0.5
    page = str(tmp_path / "v.html")
    flow = f"data: {path}\ntarget: y\ntask: regression\nensemble: voting\nvalidate:\n  test_data: {path}\n  report: {page}\ntest_size: 0.3\nmodel_hint: numerical_prediction\n"
    result = services.run_pipeline(spark, flow)
    assert {"voting_r2", "validation_r2"} <= result.metrics.keys() and open(page).read().startswith("<!DOCTYPE html>")


def test_a_served_model(spark, table, tmp_path):
    path = str(tmp_path / "m")
    fitted = models.train(table, "y", ["a", "b"], "linear")
    Artifact(fitted, {"target": "y", "model": "linear", "features": ["a", "b"], "task": "regression"}, {}, feature_schema(table.select("a", "b"))).save(spark, path)
    http = serve.server(serve.Model(spark, path), port=0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{http.server_address[1]}"
    ask = lambda p, body=None: json.load(urllib.request.urlopen(base + p, body and json.dumps(body).encode(), timeout=60))
    assert ask("/health")["status"] == "ok" and set(ask("/schema")["features"]) == {"a", "b"}
    assert ask("/predict", {"instances": [{"a": 1.0, "b": 0.0}, {"a": 0.0, "b": 2.0}]})["predictions"] == pytest.approx([2, 2], abs=0.1)
    for bad in ("/none", "/predict"):
        with pytest.raises(urllib.error.HTTPError):
            ask(bad, "text" if bad == "/predict" else None)
    http.shutdown()


def test_tools_over_lines(spark, table, tmp_path):
    path, out = str(tmp_path / "t.parquet"), io.StringIO()
    table.coalesce(1).write.parquet(path)
    ask = [
        {"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"},
        {"id": 3, "method": "tools/call", "params": {"name": "describe_data", "arguments": {"path": path}}},
        {"id": 4, "method": "tools/call", "params": {"name": "describe_data", "arguments": {"path": "/none.parquet"}}},
        {"id": 5, "method": "nothing"}, {"id": 6, "method": "tools/call", "params": {"name": "report_create", "arguments": {"title": "T"}}},
        {"id": 7, "method": "tools/call", "params": {"name": "report_summary", "arguments": {"report": "1", "data": path}}},
        {"id": 8, "method": "tools/call", "params": {"name": "create_histogram", "arguments": {"data": path, "column": "a", "output": str(tmp_path / "h.svg")}}},
        {"id": 9, "method": "prompts/get", "params": {"name": "ml_workflow", "arguments": {"data": "d", "target": "y"}}},
    ]
    serve.serve_lines(serve.Tools(spark), [*(json.dumps(a) for a in ask), "", "{"], out)
    answers = {a["id"]: a for a in map(json.loads, out.getvalue().splitlines())}
    assert len(answers) == 10 and answers[1]["result"]["serverInfo"]["name"] == "gridloom"
    listed = {t["name"]: t for t in answers[2]["result"]["tools"]}
    assert len(listed) > 25 and listed["detect_drift"]["inputSchema"]["required"] == ["reference", "current"]
    assert len(json.loads(answers[3]["result"]["content"][0]["text"])["rows"]) == 5 and answers[4]["result"]["isError"]
    assert "error" in answers[5] and not answers[7]["result"]["isError"] and (tmp_path / "h.svg").read_text().startswith("<svg")
    assert "model of y" in answers[9]["result"]["messages"][0]["content"]["text"]


def test_feature_tests(table):
    found = {r["feature"]: r for r in tuning.boruta(table, "y", ["a", "noise"], rounds=10, trees=5).collect()}
    assert found["a"]["decision"] == "confirmed" and found["a"]["rank"] == 1 and found["a"]["hits"] >= 8
    assert found["noise"]["decision"] != "confirmed" and found["noise"]["rank"] > 1
    plain = {r["feature"]: r["decision"] for r in tuning.boruta(table, "y", ["a", "noise"], rounds=8, trees=5, two_step=False).collect()}
    assert plain["a"] == "confirmed"
    fitted = models.train(table, "y", ["a", "noise"], "linear")
    importance = tuning.permutation_importance(table, fitted, "y", ["a", "noise"])
    assert importance["a"] > 10 * abs(importance["noise"])


def test_stream_windows(spark, tiny, tmp_path):
    schema = spark.read.parquet(f"{tiny}/events.parquet").schema
    source = tmp_path / "in"
    source.mkdir()
    (source / "events.parquet").symlink_to(f"{tiny}/events.parquet")
    stream = spark.readStream.schema(schema).parquet(str(source))
    q = monitor.windowed_quality(stream, "ts", ["value"], "1 day").writeStream.outputMode("complete").format("memory").queryName("quality").start()
    q.processAllAvailable()
    q.stop()
    found = spark.table("quality")
    whole = spark.read.parquet(f"{tiny}/events.parquet")
    assert found.agg(F.sum("n")).first()[0] == whole.count()
    assert found.count() == whole.select(F.to_date("ts")).distinct().count()
    seen = []
    sink = monitor.drift_sink(whole, ["value"], lambda report, epoch: seen.append(report.first()["psi"]))
    sink(whole.select((F.col("value") * 2).alias("value")), 0)
    assert len(seen) == 1 and seen[0] > 0.05 and not math.isnan(seen[0])


def test_config_bounds():
    assert config.DriftConfig(reference=" a ", current="b").reference == "a"
    for bad in (lambda: config.DriftConfig(reference="a", current="b", threshold=0), lambda: config.TrainConfig(data="a", target="y", n_trials=501), lambda: config.ClusterConfig(data="a", n_clusters=1)):
        with pytest.raises(ValueError):
            bad()

import json
import random

import pytest

from gridloom.cli import main


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    rng = random.Random(9)
    rows = [(a := rng.gauss(0, 1), b := rng.gauss(0, 1), 2 * a - b, i % 2, int(a > 0), "ab"[i % 2]) for i in range(300)]
    path = str(tmp_path_factory.mktemp("cli") / "d.parquet")
    spark.createDataFrame(rows, "x1 double, x2 double, y double, t int, p int, g string").coalesce(1).write.parquet(path)
    return path


def out(capsys, *args):
    assert main(list(args)) == 0
    return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]


def test_tables(data, tmp_path, capsys):
    assert len(out(capsys, "describe", data)) == 6
    assert {r["drifted"] for r in out(capsys, "drift", data, data)} == {False}
    assert len(out(capsys, "fairness", data, "t", "p", "g")) == 5
    assert len(out(capsys, "forecast", data, "x1", "--horizon", "3", "--order", "x2")) == 3
    assert out(capsys, "quality", data) and main(["quality", data, "--html", str(tmp_path / "q.html")]) == 0
    assert main(["report", data, str(tmp_path / "r.html")]) == 0 and "<table>" in (tmp_path / "r.html").read_text()
    assert len(out(capsys, "cluster", data, "--n-clusters", "3", "--features", "x1", "x2")) == 300
    found = out(capsys, "anomaly", data, "--contamination", "0.1")
    assert 0 < sum(r["is_anomaly"] for r in found) < 60
    assert "x1_x_x2" in out(capsys, "engineer", data, "--target", "y")[0]


def test_models(data, tmp_path, capsys):
    path = str(tmp_path / "model")
    assert out(capsys, "run", data, "y", "--save", path)[0]["r2"] > 0.99
    assert len(out(capsys, "predict", path, data)) == 300
    assert out(capsys, "validate", path, data)[0]["r2"] > 0.99
    assert out(capsys, "info", path)[0]["config"]["target"] == "y"
    assert out(capsys, "compare", path)[0]["model"] == path
    yaml = tmp_path / "p.yaml"
    assert main(["init-config", str(yaml)]) == 0
    yaml.write_text(f"data: {data}\ntarget: y\ntask: regression\n")
    assert out(capsys, "pipeline", str(yaml))[0]["r2"] > 0.99


def test_errors(data, capsys):
    assert main(["describe", "/none/x.parquet"]) == 1
    assert main(["drift", data, data, "--threshold", "0"]) == 1
    assert main(["run", data, "nothing"]) == 1
    assert main(["list-models"]) == 0 and "kmeans" in capsys.readouterr().out
    assert main(["check-deps"]) == 0


def test_more_commands(data, tmp_path, capsys):
    path = str(tmp_path / "model")
    assert out(capsys, "run", data, "y", "--save", path, "--engineer")[0]["r2"] > 0.9
    found = {r["feature"]: r["importance"] for r in out(capsys, "explain", path, data)}
    assert found and all(v >= 0 for v in found.values())
    assert len(out(capsys, "embed", data, "g", "--size", "8")[0]["embedding"]) == 8
    assert out(capsys, "text", data, "g", "t")[0]["accuracy"] > 0.9
    assert main(["export", path, "onnx"]) == 1
    assert main(["init", str(tmp_path / "project")]) == 0 and (tmp_path / "project" / "pipeline.yaml").exists()
    assert len(out(capsys, "forecast", data, "x1", "--method", "exp_smoothing")) == 12


def test_formats(data, capsys):
    assert main(["--format", "csv", "describe", data]) == 0
    lines = [x for x in capsys.readouterr().out.splitlines() if "," in x]
    assert len(lines) == 7 and lines[0].startswith("column,")
    assert main(["--format", "table", "describe", data]) == 0
    assert any(x.startswith("column ") for x in capsys.readouterr().out.splitlines())

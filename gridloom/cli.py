"""Command line: ``python -m gridloom.cli COMMAND ...``; tables go to stdout or to a file."""

from __future__ import annotations

import argparse
import importlib.util
import json
import sys
from pathlib import Path

from pydantic import ValidationError
from pyspark.sql import DataFrame

from gridloom import config
from gridloom.errors import GridloomError
from gridloom.operators.models import FACTORY
from gridloom.operators.selection import refuse
from gridloom.plans import serve, services
from gridloom.plans.artifact import Artifact, compare
from gridloom.plans.report import Report
from gridloom.session import session
from gridloom.sources import files

TEMPLATE = "data: data.parquet\ntarget: y\ntask: regression\nengineer: false\ntune: false\nsave: model\n"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gridloom")
    p.add_argument("--master", help="Spark master; the cluster's default otherwise")
    p.add_argument("--format", choices=("json", "csv", "table"), default="json", help="of tables that go to stdout")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: str, **options) -> None:
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        for k, v in options.items():
            flag = f"--{k.replace('_', '-')}"
            if isinstance(v, bool):
                c.add_argument(flag, action="store_true")
            elif isinstance(v, tuple):
                c.add_argument(flag, nargs="*", default=v)
            else:
                c.add_argument(flag, type=type(v) if v is not None else str, default=v)

    command("describe", "data", output=None)
    command("explain", "artifact", "data", method="shapley", output=None)
    command("text", "data", "column", "target", output=None)
    command("embed", "data", "column", size=64, output=None)
    command("serve", "artifact", host="127.0.0.1", port=8000)
    command("mcp")
    command("export", "artifact", "kind")
    command("init", "folder")
    command("quality", "data", html=None)
    command("drift", "reference", "current", threshold=0.2, output=None)
    command("fairness", "data", "target", "predicted", "sensitive", output=None)
    command("anomaly", "data", methods=("iforest", "lof"), contamination=0.05, consensus=2, output=None)
    command("forecast", "data", "column", horizon=12, method="auto", order=None, output=None)
    command("engineer", "data", target=None, output=None)
    command("cluster", "data", n_clusters=5, method="kmeans", features=(), output=None)
    command("run", "data", "target", task="regression", engineer=False, tune=False, n_trials=10, test_size=0.2, save=None)
    command("tune", "data", "target", task="regression", n_trials=10, tune_method="tpe", test_size=0.2, save=None)
    command("predict", "artifact", "data", output=None)
    command("validate", "artifact", "data")
    command("info", "artifact")
    command("monitor", "reference", "current", threshold=0.2, artifact=None)
    c = sub.add_parser("compare")
    c.add_argument("artifacts", nargs="+")
    command("report", "data", "output", title="Report")
    command("pipeline", "yaml")
    command("init-config", "path")
    command("list-models")
    command("check-deps")
    return p


FORMAT = "json"


def show(df: DataFrame, output: str | None) -> None:
    if output:
        files.save(df, output)
    else:
        for line in files.lines_of(df, FORMAT):
            print(line)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "list-models":
        print("\n".join(sorted(FACTORY)))
        return 0
    if a.command == "check-deps":
        for name in ("pyspark", "pyarrow", "pandas", "numpy", "pydantic", "yaml"):
            print(name, "ok" if importlib.util.find_spec(name) else "missing")
        return 0
    if a.command == "init-config":
        with open(a.path, "x", encoding="utf-8") as f:
            f.write(TEMPLATE)
        return 0
    if a.command == "init":
        folder = Path(a.folder)
        (folder / "data").mkdir(parents=True)
        (folder / "pipeline.yaml").write_text(TEMPLATE.replace("data.parquet", "data/data.parquet"), encoding="utf-8")
        (folder / "README.md").write_text("Put a table into data/ and run: python -m gridloom.cli pipeline pipeline.yaml\n", encoding="utf-8")
        return 0
    try:
        run(a)
    except (GridloomError, ValidationError, OSError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


def run(a: argparse.Namespace) -> None:
    global FORMAT
    FORMAT = a.format
    spark = session(a.master)
    if a.command == "describe":
        show(services.describe(spark, a.data), a.output)
    elif a.command == "quality":
        parts = services.quality(spark, a.data)
        report = Report("Data quality")
        for name, df in parts.items():
            if a.html:
                report.section(name).table(df)
            else:
                print(f"# {name}")
                show(df, None)
        if a.html:
            report.save(a.html)
    elif a.command == "drift":
        show(services.detect_drift(spark, config.DriftConfig(reference=a.reference, current=a.current, threshold=a.threshold)), a.output)
    elif a.command == "fairness":
        show(services.check_fairness(spark, config.FairnessConfig(data=a.data, target=a.target, predicted=a.predicted, sensitive=a.sensitive)), a.output)
    elif a.command == "anomaly":
        c = config.AnomalyConfig(data=a.data, methods=tuple(a.methods), contamination=a.contamination, consensus=a.consensus)
        show(services.detect_anomalies(spark, c), a.output)
    elif a.command == "forecast":
        show(services.forecast(spark, config.ForecastConfig(data=a.data, column=a.column, horizon=a.horizon, method=a.method), a.order), a.output)
    elif a.command == "engineer":
        show(services.engineer(spark, a.data, a.target), a.output)
    elif a.command == "cluster":
        show(services.cluster(spark, config.ClusterConfig(data=a.data, n_clusters=a.n_clusters, method=a.method, features=tuple(a.features))), a.output)
    elif a.command in ("run", "tune"):
        tune = a.command == "tune" or a.tune
        c = config.TrainConfig(
            data=a.data, target=a.target, task=a.task, engineer=getattr(a, "engineer", False), tune=tune, n_trials=a.n_trials,
            tune_method=getattr(a, "tune_method", "tpe"), test_size=a.test_size, save=a.save,
        )
        print(json.dumps(services.train(spark, c).metrics))
    elif a.command == "explain":
        show(services.explain(spark, a.artifact, a.data, a.method), a.output)
    elif a.command == "text":
        found, scores = services.text(spark, a.data, a.column, a.target)
        print(json.dumps(scores))
        if a.output:
            show(found, a.output)
    elif a.command == "embed":
        show(services.embed(spark, a.data, a.column, a.size), a.output)
    elif a.command == "serve":
        serve.server(serve.Model(spark, a.artifact), a.host, a.port).serve_forever()
    elif a.command == "mcp":
        serve.serve_lines(serve.Tools(spark), sys.stdin, sys.stdout)
    elif a.command == "export":
        refuse(a.kind)
    elif a.command == "predict":
        show(services.predict(spark, a.artifact, a.data), a.output)
    elif a.command == "validate":
        print(json.dumps(services.validate(spark, a.artifact, a.data)))
    elif a.command == "info":
        found = Artifact.load(spark, a.artifact)
        print(json.dumps({"config": found.config, "metrics": found.metrics, "schema": found.schema}, default=str))
    elif a.command == "monitor":
        show(services.detect_drift(spark, config.DriftConfig(reference=a.reference, current=a.current, threshold=a.threshold)), None)
        for name, df in services.quality(spark, a.current).items():
            print(f"# {name}")
            show(df, None)
        if a.artifact:
            print(json.dumps(services.validate(spark, a.artifact, a.current)))
    elif a.command == "compare":
        show(compare({path: Artifact.load(spark, path) for path in a.artifacts}, spark), None)
    elif a.command == "report":
        df = files.load(spark, a.data)
        from gridloom.operators import profile

        Report(a.title).section("Overview").table(profile.overview(df)).section("Columns").table(profile.describe(df)).section(
            "Correlations"
        ).table(profile.correlations(df, threshold=None)).save(a.output)
    elif a.command == "pipeline":
        with open(a.yaml, encoding="utf-8") as f:
            print(json.dumps(services.run_pipeline(spark, f.read()).metrics))


if __name__ == "__main__":
    sys.exit(main())

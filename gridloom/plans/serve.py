"""Services for other programs: a model over HTTP, and the tasks as tools over JSON-RPC lines."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import TextIO

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from gridloom import config
from gridloom.errors import GridloomError
from gridloom.operators import charts, metrics, profile, selection
from gridloom.operators.models import FACTORY
from gridloom.plans import services, svg
from gridloom.plans.artifact import Artifact, compare
from gridloom.plans.report import Report
from gridloom.roles import ColumnRoles
from gridloom.sources import files

#: Rows of a table that an answer holds; the answer says whether there are more.
MOST_ROWS = 1000


class Model:
    """A stored model's answers to requests."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.artifact = spark, Artifact.load(spark, path)
        known = {c: f["dtype"] for c, f in self.artifact.schema.items()}
        self.columns = ", ".join(f"`{c}` {kind}" for c, kind in known.items())

    def get(self, path: str) -> dict | None:
        a = self.artifact
        return {
            "/health": {"status": "ok", "model": a.config["model"]},
            "/info": {"config": a.config, "metrics": a.metrics},
            "/schema": {"features": a.schema, "config": a.config},
        }.get(path)

    def predict(self, payload: dict | list) -> dict:
        df = files.from_records(self.spark, payload, self.columns)
        return {"predictions": [r["prediction"] for r in self.artifact.predict(df.coalesce(1)).collect()]}


def server(model: Model, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """GET /health, /info, /schema and POST /predict; ``serve_forever`` starts it."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self, status: int, body: dict) -> None:
            raw = json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:
            body = model.get(self.path)
            self.answer(200 if body else 404, body or {"error": f"no {self.path}"})

        def do_POST(self) -> None:
            if self.path != "/predict":
                return self.answer(404, {"error": f"no {self.path}"})
            try:
                payload = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))
                self.answer(200, model.predict(payload))
            except (ValueError, TypeError, GridloomError, PySparkException) as error:
                self.answer(400, {"error": str(error)[:500]})

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def _rows(df: DataFrame, output: str | None = None) -> dict:
    if output:
        files.save(df, output)
        return {"written": output}
    found = [r.asDict(recursive=True) for r in df.limit(MOST_ROWS + 1).collect()]
    return {"rows": found[:MOST_ROWS], "more": len(found) > MOST_ROWS}


class Tools:
    """Tasks by name, with named arguments; reports are kept between calls by number."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.reports: dict[str, Report] = {}

    def names(self) -> dict[str, Callable[..., dict]]:
        return {n.removeprefix("do_"): getattr(self, n) for n in dir(self) if n.startswith("do_")}

    def do_describe_data(self, path: str) -> dict:
        """A profile of each column."""
        return _rows(services.describe(self.spark, path))

    def do_data_info(self, path: str) -> dict:
        """Columns, types and number of rows."""
        df = files.load(self.spark, path)
        return {"columns": dict(df.dtypes), "rows": df.count()}

    def do_data_quality(self, path: str) -> dict:
        """Missing values, duplicates, constants, correlations."""
        return {k: _rows(v) for k, v in services.quality(self.spark, path).items()}

    def do_train_model(self, data: str, target: str, task: str = "regression", engineer: bool = False, tune: bool = False, n_trials: int = 10, save: str | None = None) -> dict:
        """Fit a model; its metrics on rows held out."""
        c = config.TrainConfig(data=data, target=target, task=task, engineer=engineer, tune=tune, n_trials=n_trials, save=save)
        found = services.train(self.spark, c)
        return {"metrics": found.metrics, "config": found.config}

    def do_predict(self, artifact: str, data: str, output: str | None = None) -> dict:
        """Predictions of a stored model."""
        return _rows(services.predict(self.spark, artifact, data), output)

    def do_validate_model(self, artifact: str, data: str) -> dict:
        """Metrics of a stored model on a labelled table."""
        return services.validate(self.spark, artifact, data)

    def do_explain_model(self, artifact: str, data: str, method: str = "shapley") -> dict:
        """Importance of a stored model's features."""
        return _rows(services.explain(self.spark, artifact, data, method))

    def do_detect_drift(self, reference: str, current: str, threshold: float = 0.2) -> dict:
        """Drift of each numeric column."""
        return _rows(services.detect_drift(self.spark, config.DriftConfig(reference=reference, current=current, threshold=threshold)))

    def do_detect_anomalies(self, data: str, methods: list[str] = ("iforest", "lof"), contamination: float = 0.05, consensus: int = 2, output: str | None = None) -> dict:
        """Rows with a flag of each method and the consensus."""
        c = config.AnomalyConfig(data=data, methods=tuple(methods), contamination=contamination, consensus=consensus)
        return _rows(services.detect_anomalies(self.spark, c), output)

    def do_check_fairness(self, data: str, target: str, predicted: str, sensitive: str) -> dict:
        """Fairness of predictions between groups."""
        return _rows(services.check_fairness(self.spark, config.FairnessConfig(data=data, target=target, predicted=predicted, sensitive=sensitive)))

    def do_forecast_series(self, data: str, column: str, horizon: int = 12, method: str = "auto", order: str | None = None) -> dict:
        """Steps ahead of a column."""
        return _rows(services.forecast(self.spark, config.ForecastConfig(data=data, column=column, horizon=horizon, method=method), order))

    def do_engineer_features(self, data: str, target: str | None = None, output: str | None = None) -> dict:
        """Logs, date parts, products and encodings."""
        return _rows(services.engineer(self.spark, data, target), output)

    def do_cluster_data(self, data: str, n_clusters: int = 5, method: str = "kmeans", features: list[str] = (), output: str | None = None) -> dict:
        """Rows with their cluster, and the clusters' sizes."""
        found = services.cluster(self.spark, config.ClusterConfig(data=data, n_clusters=n_clusters, method=method, features=tuple(features)))
        return _rows(found, output) | {"sizes": _rows(selection.cluster_sizes(found))["rows"]}

    def do_embed_text(self, data: str, column: str, size: int = 64, output: str | None = None) -> dict:
        """Hashed vectors of texts."""
        return _rows(services.embed(self.spark, data, column, size), output)

    def do_classify_text(self, data: str, column: str, target: str) -> dict:
        """Accuracy of a text classifier on rows held out."""
        return services.text(self.spark, data, column, target)[1]

    def do_compare_models(self, artifacts: list[str]) -> dict:
        """Metrics of stored models side by side."""
        return _rows(compare({p: Artifact.load(self.spark, p) for p in artifacts}, self.spark))

    def do_artifact_info(self, path: str) -> dict:
        """What a stored model is and how well it did."""
        found = Artifact.load(self.spark, path)
        return {"config": found.config, "metrics": found.metrics, "schema": found.schema}

    def do_available_models(self) -> dict:
        """Names of the models."""
        return {"models": sorted(FACTORY)}

    def do_export_model(self, artifact: str, format: str) -> dict:  # noqa: A002
        """Other formats need libraries that are not at hand."""
        return selection.refuse(format)

    def do_generate_report(self, data: str, output: str, title: str = "Report") -> dict:
        """A page with overview, columns and correlations."""
        df = files.load(self.spark, data)
        page = Report(title).section("Overview").table(profile.overview(df)).section("Columns").table(profile.describe(df))
        page.section("Correlations").table(profile.correlations(df, threshold=None)).save(output)
        return {"written": output}

    def do_create_histogram(self, data: str, column: str, output: str, bins: int = 20) -> dict:
        """A histogram as SVG."""
        found = charts.histogram(files.load(self.spark, data), column, bins).orderBy("bin").collect()
        with open(output, "w", encoding="utf-8") as f:
            f.write(svg.bars([f"{r['lo']:g}" for r in found], [float(r["n"]) for r in found]))
        return {"written": output}

    def do_report_create(self, title: str) -> dict:
        """Begin a report; later calls name it by its number."""
        number = str(len(self.reports) + 1)
        self.reports[number] = Report(title)
        return {"report": number}

    def do_report_section(self, report: str, title: str) -> dict:
        """A heading."""
        self.reports[report].section(title)
        return {"report": report}

    def do_report_table(self, report: str, data: str) -> dict:
        """The rows of a file; of at most 2000."""
        self.reports[report].table(files.load(self.spark, data))
        return {"report": report}

    def do_report_summary(self, report: str, data: str) -> dict:
        """Statistics of a file's numeric columns."""
        df = files.load(self.spark, data)
        self.reports[report].table(profile.summary_table(df, list(ColumnRoles.of(df).numeric)))
        return {"report": report}

    def do_report_comparison(self, report: str, data: str, metric: str, baseline: str, others: list[str]) -> dict:
        """Changes of metrics against a baseline."""
        self.reports[report].table(metrics.comparison(files.load(self.spark, data), metric, baseline, list(others)))
        return {"report": report}

    def do_report_cards(self, report: str, values: dict) -> dict:
        """Single numbers."""
        self.reports[report].cards(values)
        return {"report": report}

    def do_report_code(self, report: str, code: str) -> dict:
        """Program text."""
        self.reports[report].code(code)
        return {"report": report}

    def do_report_diff(self, report: str, old: str, new: str) -> dict:
        """Two texts compared."""
        self.reports[report].diff(old, new)
        return {"report": report}

    def do_report_mermaid(self, report: str, diagram: str) -> dict:
        """A diagram as text."""
        self.reports[report].mermaid(diagram)
        return {"report": report}

    def do_report_dark_toggle(self, report: str) -> dict:
        """A switch to dark colours."""
        self.reports[report].dark_toggle()
        return {"report": report}

    def do_report_save(self, report: str, output: str) -> dict:
        """Write the report's page."""
        self.reports[report].save(output)
        return {"written": output}


_KINDS = {"str": "string", "int": "integer", "float": "number", "bool": "boolean", "dict": "object", "list[str]": "array"}

#: What a client may ask a model to do with the tools.
PROMPTS = {
    "ml_workflow": "Describe {data}, check its quality, train a model of {target} and report its metrics.",
    "monitor_production": "Look for drift from {reference} to {current} and validate {artifact} on the latter.",
    "debug_model": "Read the info of {artifact}, explain it on {data} and say what may be wrong: {issue}.",
    "create_dashboard": "Create a report on {data} with a summary, a histogram of each number and the correlations.",
}


def tool_list(tools: Tools) -> list[dict]:
    """Name, description and arguments of each tool."""
    import inspect

    out = []
    for name, f in tools.names().items():
        parameters = inspect.signature(f).parameters.values()
        kinds = {p.name: {"type": _KINDS[str(p.annotation).split(" | ")[0]]} for p in parameters}
        needed = [p.name for p in parameters if p.default is p.empty]
        out.append({"name": name, "description": f.__doc__, "inputSchema": {"type": "object", "properties": kinds, "required": needed}})
    return out


def handle(tools: Tools, request: dict) -> dict | None:
    """The answer to one request of the Model Context Protocol; notifications have none."""
    if "id" not in request:
        return None
    method, given = request.get("method"), request.get("params") or {}
    answer: dict = {"jsonrpc": "2.0", "id": request["id"]}
    if method == "initialize":
        return answer | {"result": {"protocolVersion": given.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}, "prompts": {}}, "serverInfo": {"name": "gridloom", "version": "1"}}}
    if method == "ping":
        return answer | {"result": {}}
    if method == "tools/list":
        return answer | {"result": {"tools": tool_list(tools)}}
    if method == "prompts/list":
        return answer | {"result": {"prompts": [{"name": n, "description": t} for n, t in PROMPTS.items()]}}
    if method == "prompts/get" and given.get("name") in PROMPTS:
        text = PROMPTS[given["name"]]
        for k, v in (given.get("arguments") or {}).items():
            text = text.replace("{" + k + "}", str(v))
        return answer | {"result": {"messages": [{"role": "user", "content": {"type": "text", "text": text}}]}}
    if method == "tools/call" and given.get("name") in tools.names():
        try:
            result, failed = tools.names()[given["name"]](**(given.get("arguments") or {})), False
        except (GridloomError, PySparkException, ValueError, TypeError, KeyError, OSError) as error:
            result, failed = {"error": str(error)[:500]}, True
        return answer | {"result": {"content": [{"type": "text", "text": json.dumps(result, default=str)}], "isError": failed}}
    return answer | {"error": {"code": -32601, "message": f"no {method} {given.get('name', '')}".strip()}}


def serve_lines(tools: Tools, lines: Iterable[str], out: TextIO) -> None:
    """Answer requests that come as lines of JSON."""
    for line in lines:
        if not line.strip():
            continue
        try:
            found = handle(tools, json.loads(line))
        except json.JSONDecodeError:
            found = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if found is not None:
            out.write(json.dumps(found) + "\n")
            out.flush()

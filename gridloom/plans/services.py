"""Whole tasks on files: what the command line calls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import config
from gridloom.errors import DataValidationError, NotSupported
from gridloom.operators import anomaly, clean, drift, fairness, metrics, models, profile, selection, tuning
from gridloom.operators import explain as explaining
from gridloom.operators import text as texts
from gridloom.operators import timeseries as ts
from gridloom.operators.features import FeatureEngineer
from gridloom.plans import chain
from gridloom.plans.artifact import Artifact, feature_schema
from gridloom.plans.report import Report
from gridloom.roles import ColumnRoles, require
from gridloom.session import keep
from gridloom.sources import files


def with_key(df: DataFrame, key: str = "row_key_") -> DataFrame:
    """A key for tables that have none: the row's number, by file and place."""
    return df.withColumn(key, F.monotonically_increasing_id())


def describe(spark: SparkSession, path: str) -> DataFrame:
    return profile.describe(files.load(spark, path))


def quality(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Overview, missing values, cardinality, constants, duplicates, correlations, text types."""
    df = files.load(spark, path)
    out = {
        "overview": profile.overview(df),
        "missing": profile.missing(df),
        "cardinality": profile.cardinality(df),
        "constants": profile.constants(df),
        "duplicates": profile.duplicates(df),
        "correlations": profile.correlations(df),
    }
    if ColumnRoles.of(df).text:
        out["text_types"] = profile.infer_text_types(df)
    return out


def detect_drift(spark: SparkSession, c: config.DriftConfig) -> DataFrame:
    return drift.detect(files.load(spark, c.reference), files.load(spark, c.current), threshold=c.threshold)


def check_fairness(spark: SparkSession, c: config.FairnessConfig) -> DataFrame:
    df = files.load(spark, c.data)
    return fairness.metrics(fairness.group_rates(df, c.target, c.predicted, c.sensitive))


def detect_anomalies(spark: SparkSession, c: config.AnomalyConfig) -> DataFrame:
    """The table with a flag for each method, the votes and the consensus.

    Every row comes back, repeated ones too; rows with a null in a numeric column get no flag.
    """
    df = keep(with_key(files.load(spark, c.data)))
    columns = list(ColumnRoles.of(df.drop("row_key_")).numeric)
    if not columns:
        raise DataValidationError("no numeric columns")
    z = anomaly.standardise(df, columns)
    names = [f"{x}_z" for x in columns]
    flags = []
    for method in c.methods:
        if method == "iforest":
            scored = anomaly.isolation_forest(z, "row_key_", names).withColumnRenamed("score", "s_")
        elif method == "lof":
            scored = anomaly.local_outlier_factor(z, "row_key_", names).withColumnRenamed("lof", "s_")
        else:
            raise NotSupported(f"unknown method {method!r}; known: iforest, lof")
        flags.append(anomaly.flag_top(keep(scored), "s_", c.contamination).select("row_key_", F.col("is_anomaly").alias(method)))
    wide = reduce(lambda a, b: a.join(b, "row_key_", "left"), flags, df).fillna(False, list(c.methods))
    return anomaly.consensus(wide, list(c.methods), min(c.consensus, len(c.methods))).drop("row_key_")


#: Values of one series that a forecast takes into a task.
MOST_VALUES = 1_000_000


def forecast(spark: SparkSession, c: config.ForecastConfig, order: str | None = None) -> DataFrame:
    """Steps ahead of one column; ``order`` names the column that orders the rows.

    A forecast looks at the series as a whole, in one task: series of over ``MOST_VALUES`` values are
    refused, to be summed up to a coarser step first.
    """
    df = files.load(spark, c.data)
    require(df, c.column, *([order] if order else []))
    pos = F.col(order) if order else F.monotonically_increasing_id()
    series = df.where(F.col(c.column).isNotNull()).select(F.lit("all").alias("series"), pos.alias("pos"), F.col(c.column).cast("double").alias("value"))
    n = series.limit(MOST_VALUES + 1).count()
    if n < 10:
        raise DataValidationError("a forecast needs ten values")
    if n > MOST_VALUES:
        raise DataValidationError(f"a series of over {MOST_VALUES} values: sum it up to a coarser step first")
    if c.method not in ("auto", "arima", "sarima", "exp_smoothing"):
        raise NotSupported(f"unknown method {c.method!r}; known: auto, arima, sarima, exp_smoothing")
    if c.method == "arima":
        return ts.arima(series, c.horizon)
    period = ts.seasonal_period(ts.autocorrelation(series)).first()["period"]
    method = ts.auto_method(n, period) if c.method == "auto" else c.method
    if method == "arima":
        return ts.arima(series, c.horizon)
    if method == "sarima" and (period >= 2 or c.method == "sarima"):
        return ts.sarima(series, c.horizon, period)
    return ts.forecast(series, c.horizon, period)


def engineer(spark: SparkSession, path: str, target: str | None = None, **options) -> DataFrame:
    return FeatureEngineer(**options).fit_transform(files.load(spark, path), target)


def cluster(spark: SparkSession, c: config.ClusterConfig) -> DataFrame:
    df = files.load(spark, c.data)
    features = list(c.features) or list(ColumnRoles.of(df).numeric)
    return models.cluster(df, features, c.n_clusters, c.method)


def _fit(parts: DataFrame, c: config.TrainConfig, features: list[str]) -> tuple[object, str, dict]:
    """The model on the training part, its name and settings."""
    known = parts.where("not is_test").drop("is_test")
    numeric = set(ColumnRoles.of(known).numeric)
    counts = {}
    if c.task is config.Task.classification:
        counts = {"rows_per_class": known.groupBy(c.target).count().agg(F.min("count")).first()[0] or 0}
    name = models.choose_model(c.objective or c.task.value, known.count(), numeric_only=set(features) <= numeric, n_features=len(features), **counts)
    options: dict = {}
    if c.tune:
        name = "gbt_regressor" if c.task is config.Task.regression else "gbt_classifier"
        if c.tune_method == "halving":
            grid = [{"maxIter": n, "maxDepth": d, "stepSize": s} for n in (50, 100, 200) for d in (3, 5, 8) for s in (0.01, 0.05, 0.1)]
            options = tuning.halving(known, "row_key_", c.target, features, name, grid, c.task.value)["options"]
        else:
            search = tuning.random_search if c.tune_method == "random" else tuning.tpe_search
            options = search(known, "row_key_", c.target, features, name, c.task.value, c.n_trials)["options"]
    return models.train(known, c.target, features, name, c.task.value, **options), name, options


def train(spark: SparkSession, c: config.TrainConfig) -> Artifact:
    """A model of the task's kind on the rows that are not held out, with metrics on those that are.

    Features are engineered, settings searched and models chosen on the training rows alone; what was
    engineered is part of the artifact, which scores raw tables.
    """
    df = with_key(files.load(spark, c.data, target=c.target))
    parts = clean.split(df, "row_key_", c.test_size).persist()
    engineered = FeatureEngineer().fit(parts.where("not is_test").drop("row_key_", "is_test"), c.target) if c.engineer else None
    ready = parts if engineered is None else engineered.transform(parts, "row_key_", "is_test").persist()
    roles = ColumnRoles.of(ready)
    features = [x for x in ready.columns if x not in (c.target, "row_key_", "is_test") and x in (*roles.numeric, *roles.text)]
    fitted, name, options = _fit(ready, c, features)
    test = ready.where("is_test")
    found = fitted.transform(test)
    label = f"{c.target}_at_" if c.target in roles.text else c.target
    scores = tuning.score(found, label, c.task.value)
    if c.ensemble:
        scores |= _ensemble(ready, c, features, name)
    if c.advanced_cv:
        scores |= _advanced(ready.where("not is_test").drop("is_test"), c, features, name, options)
    ready.unpersist()
    parts.unpersist()
    settings = {"target": c.target, "task": c.task.value, "model": name, "features": features, "options": options}
    raw = [x for x in df.columns if x not in (c.target, "row_key_")]
    artifact = Artifact(fitted, settings | {"columns": raw if engineered else features}, scores, feature_schema(df.select(*raw) if engineered else df.select(*features)), engineered)
    if c.save:
        artifact.save(spark, c.save)
    return artifact


def _ensemble(ready: DataFrame, c: config.TrainConfig, features: list[str], name: str) -> dict:
    """Held-out metrics of several regressors together, beside the artifact's own model."""
    if c.task is not config.Task.regression:
        raise NotSupported("ensembles are of regressors")
    names = [*dict.fromkeys([name, "ridge", "random_forest_regressor"])]
    known, test = ready.where("not is_test").drop("is_test"), ready.where("is_test")
    fitted = [models.train(known, c.target, features, n) for n in names]
    for i, f in enumerate(fitted):
        test = f.transform(test).select(*test.columns, F.col("prediction").alias(f"p{i}_"))
    if c.ensemble == "voting":
        joined = test.withColumn("prediction", sum((F.col(f"p{i}_") for i in range(len(names))), F.lit(0.0)) / len(names))
    else:
        meta = tuning.meta_model(known, "row_key_", c.target, features, names)
        joined = meta.predict(test)
    return {f"{c.ensemble}_{k}": v for k, v in tuning.score(joined, c.target, "regression").items()}


def _advanced(known: DataFrame, c: config.TrainConfig, features: list[str], name: str, options: dict) -> dict:
    """Cross-validated and bootstrapped metrics on the training rows."""
    out = {f"cv_{k}": v["mean"] for k, v in tuning.cross_validate(known, "row_key_", c.target, features, name, c.task.value, **options).items()}
    if set(features) <= set(ColumnRoles.of(known).numeric):
        for r in tuning.bootstrap_cv(known, "row_key_", c.target, features, name, c.task.value, replicates=10, **options).collect():
            out |= {f"bootstrap_{r['metric']}_{k}": r[k] for k in ("mean", "low", "high")}
    return out


def predict(spark: SparkSession, artifact: str, path: str) -> DataFrame:
    """The table's columns and ``prediction``; raw columns, where features were engineered."""
    found, df = Artifact.load(spark, artifact), files.load(spark, path)
    require(df, *found.config.get("columns", found.config["features"]))
    return found.predict(df)


def explain(spark: SparkSession, artifact: str, path: str, method: str = "shapley") -> DataFrame:
    """``feature, importance`` of a stored model on a table, by sampled Shapley values or LIME."""
    found, df = Artifact.load(spark, artifact), with_key(files.load(spark, path))
    df = found.engineered.transform(df, "row_key_") if found.engineered else df
    features = found.config["features"]
    require(df, *features)
    if method == "shapley":
        return explaining.shapley_importance(explaining.shapley(df, found.model, "row_key_", features))
    if method == "lime":
        numeric = [c for c in features if c in ColumnRoles.of(df).numeric]
        return explaining.lime_importance(explaining.lime(df, found.model, "row_key_", numeric))
    raise NotSupported(f"unknown method {method!r}; known: shapley, lime")


def text(spark: SparkSession, path: str, column: str, target: str) -> tuple[DataFrame, dict]:
    """Each row's text, label and prediction; accuracy and F1 on the rows held out."""
    df = with_key(files.load(spark, path, target=target))
    found = selection.text_classifier(df, "row_key_", column, target)
    held = found.where("held_out and label is not null").withColumn("label", F.col("label").cast("string"))
    return df.select("row_key_", column).join(found, "row_key_").drop("row_key_"), metrics.classification(held, "label", "prediction").first().asDict()


def embed(spark: SparkSession, path: str, column: str, size: int = 64) -> DataFrame:
    """The table with ``embedding``, a hashed vector of the text's words."""
    df = keep(with_key(files.load(spark, path)))
    return df.join(texts.hashed_embeddings(df, "row_key_", column, size), "row_key_").drop("row_key_")


def validate(spark: SparkSession, artifact: str, path: str) -> dict:
    """Metrics of a stored model on a labelled table."""
    found = Artifact.load(spark, artifact)
    target = found.config["target"]
    scored = found.score(files.load(spark, path, target=target))
    label = f"{target}_at_" if f"{target}_at_" in scored.columns else target
    return tuning.score(scored, label, found.config["task"])


def run_pipeline(spark: SparkSession, text: str) -> Artifact:
    """What a pipeline's YAML says: load, engineer, tune or choose, train, validate, save.

    ``tune`` is true, or a mapping with ``method`` (tpe, random, halving) and ``n_trials``; ``validate`` a
    mapping with ``test_data`` and, for a page, ``report``.
    """
    c = files.pipeline_config(text)
    tune = c["tune"] if isinstance(c["tune"], dict) else {}
    method = {"halving": "halving", "random": "random"}.get(tune.get("method", ""), "tpe")
    found = train(
        spark,
        config.TrainConfig(
            data=c["data"], target=c["target"], task=c["task"], engineer=bool(c["engineer"]), tune=bool(c["tune"]) or "method" in tune, tune_method=method,
            n_trials=tune.get("n_trials", 50), test_size=c["test_size"], objective=c.get("model_hint"), ensemble=c.get("ensemble") or None,
            advanced_cv=bool(c.get("advanced_cv")), save=c["save"],
        ),
    )
    check = c["validate"] if isinstance(c["validate"], dict) else {}
    if "test_data" in check:
        df = files.load(spark, check["test_data"], target=found.config["target"])
        scored = found.score(df)
        label = f"{c['target']}_at_" if f"{c['target']}_at_" in scored.columns else c["target"]
        result = tuning.score(scored, label, found.config["task"])
        found.metrics |= {f"validation_{k}": v for k, v in result.items()}
        if "report" in check:
            Report(c.get("name", "Validation")).section("Metrics").cards(result).save(check["report"])
    return found


STEPS = {k: v for k, v in vars(chain).items() if isinstance(v, type) and issubclass(v, chain.Step)}

"""Stored models: Spark's own format beside JSON; no pickles."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.errors import ArtifactError, ArtifactVersionError
from gridloom.operators.features import FeatureModel
from gridloom.operators.profile import value_counts
from gridloom.roles import ColumnRoles

FORMAT, VERSION = "gridloom-model", 1
MOST_CATEGORIES = 50


def feature_schema(df: DataFrame) -> dict:
    """Type and range of numeric columns, number of values and the first fifty of others; three jobs."""
    roles, types = ColumnRoles.of(df), dict(df.dtypes)
    out: dict = {c: {"dtype": types[c]} for c in df.columns}
    if roles.numeric:
        one = df.agg(*(f(F.col(c).cast("double")).alias(f"{n}_{i}") for i, c in enumerate(roles.numeric) for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg)))).first()
        for i, c in enumerate(roles.numeric):
            out[c] |= {n: one[f"{n}_{i}"] for n in ("min", "max", "mean")}
    others = [c for c in df.columns if c not in roles.numeric]
    if others:
        counts = value_counts(df, others)
        for r in counts.groupBy("column").agg(F.count("*").alias("n")).collect():
            out[r["column"]]["n_unique"] = r["n"]
        for c in others:
            values = counts.where(F.col("column") == c).orderBy("value").limit(MOST_CATEGORIES).select("value").collect()
            out[c]["categories"] = [r["value"] for r in values]
    return out


def schema_table(spark: SparkSession, schema: dict) -> DataFrame:
    """A feature schema as ``column, dtype, low, high, mean, n_unique``."""
    pick = lambda f, k: None if f.get(k) is None else float(f[k])
    rows = [(c, f["dtype"], *(pick(f, k) for k in ("min", "max", "mean")), f.get("n_unique")) for c, f in schema.items()]
    return spark.createDataFrame(rows, "column string, dtype string, low double, high double, mean double, n_unique long")


@dataclass
class Artifact:
    """A fitted pipeline with what was engineered for it, so that raw tables can be scored."""

    model: PipelineModel
    config: dict
    metrics: dict
    schema: dict
    engineered: FeatureModel | None = None

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with the columns that the model makes of it, ``prediction`` among them."""
        return self.model.transform(self.engineered.transform(df) if self.engineered else df)

    def predict(self, df: DataFrame) -> DataFrame:
        """The table's own columns and ``prediction``."""
        if self.engineered is None:
            return self.model.transform(df).select(*df.columns, "prediction")
        row = F.struct(*df.columns).alias("row_")
        found = self.model.transform(self.engineered.transform(df.select(*df.columns, row), "row_"))
        return found.select("row_.*", "prediction")

    def save(self, spark: SparkSession, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        text = json.dumps({"format": FORMAT, "version": VERSION, "config": self.config, "metrics": self.metrics, "schema": self.schema, "engineered": self.engineered is not None}, default=str)
        if self.engineered is not None:
            self.engineered.save(spark, f"{path}/features")
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Artifact:
        try:
            found = json.loads("\n".join(r["value"] for r in spark.read.text(f"{path}/manifest").collect()))
            model = PipelineModel.load(f"{path}/model")
        except Exception as error:
            raise ArtifactError(f"cannot read a model at {path}: {error}") from error
        if found.get("format") != FORMAT:
            raise ArtifactError(f"{path} holds no model of this library")
        if found["version"] > VERSION:
            raise ArtifactVersionError(f"{path} has version {found['version']}, known is {VERSION}")
        engineered = FeatureModel.load(spark, f"{path}/features") if found.get("engineered") else None
        return cls(model, found["config"], found["metrics"], found["schema"], engineered)


def compare(artifacts: dict[str, Artifact], spark: SparkSession) -> DataFrame:
    """``model`` and the union of all metrics, null where a model lacks one."""
    names = sorted({m for a in artifacts.values() for m in a.metrics})
    rows = [(k, *(float(a.metrics[n]) if n in a.metrics else None for n in names)) for k, a in artifacts.items()]
    return spark.createDataFrame(rows, "model string" + "".join(f", `{n}` double" for n in names))

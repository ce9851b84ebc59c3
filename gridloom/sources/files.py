"""Typed readers and writers of tabular files."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from pathlib import PurePosixPath

import numpy as np
import yaml
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.errors import ConfigError, DataLoadError
from gridloom.roles import require

SUFFIXES = (".parquet", ".csv", ".tsv", ".json")


def load(spark: SparkSession, path: str, schema: T.StructType | str | None = None, target: str | None = None) -> DataFrame:
    """A table by its suffix: Parquet, CSV, TSV (both with a header) or JSON lines.

    Without a schema, CSV types are inferred by a pass over the data. Unknown suffixes and paths
    that don't exist raise DataLoadError.
    """
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        if suffix == ".parquet":
            df = reader.parquet(path)
        elif suffix in (".csv", ".tsv"):
            df = reader.csv(path, header=True, sep="\t" if suffix == ".tsv" else ",", inferSchema=schema is None)
        elif suffix == ".json":
            df = reader.json(path)
        else:
            raise DataLoadError(f"unsupported format {suffix!r}; supported: {', '.join(SUFFIXES)}")
    except AnalysisException as error:
        raise DataLoadError(f"cannot read {path}: {error}") from error
    if target is not None:
        require(df, target)
    return df


#: Numbers of an array file, which the driver writes.
MOST_NUMBERS = 25_000_000


def save_vectors(df: DataFrame, vector: str, path: str, order: str) -> None:
    """Vectors as rows of one ``.npy`` file on the driver, in the order of a column; larger tables are refused."""
    require(df, vector, order)
    rows = df.where(F.col(vector).isNotNull())
    size = rows.agg(F.coalesce(F.sum(F.size(vector)), F.lit(0))).first()[0]
    if size > MOST_NUMBERS:
        raise DataLoadError(f"over {MOST_NUMBERS} numbers: save Parquet")
    np.save(path, np.array([r[0] for r in rows.orderBy(order).select(F.col(vector).cast("array<double>")).collect()]))


def as_table(spark: SparkSession, data) -> DataFrame:
    """A Spark table as it is, or one made of a pandas or Arrow table or of what has ``to_arrow`` or ``collect`` (lazy frames)."""
    if isinstance(data, DataFrame):
        return data
    if not hasattr(data, "to_arrow") and not hasattr(data, "columns") and hasattr(data, "collect"):
        data = data.collect()
    if hasattr(data, "to_arrow"):
        data = data.to_arrow()
    return spark.createDataFrame(data)


def from_records(spark: SparkSession, payload: dict | list, schema: T.StructType | str) -> DataFrame:
    """Records of a request: a list, an object with ``instances`` or ``data``, or one object."""
    if isinstance(payload, dict):
        for key in ("instances", "data"):
            if isinstance(payload.get(key), list):
                payload = payload[key]
                break
    rows = payload if isinstance(payload, list) else [payload]
    return spark.createDataFrame(rows, schema)


def save(df: DataFrame, path: str, fmt: str = "auto", single_file: bool = False) -> None:
    """Write Parquet, CSV or JSON lines, by ``fmt`` or the path's suffix; an existing one is replaced.

    CSV holds arrays and structs as JSON.
    """
    if fmt == "auto":
        fmt = PurePosixPath(path.rstrip("/")).suffix.lower().lstrip(".") or "parquet"
    if fmt not in ("parquet", "csv", "json"):
        raise DataLoadError(f"unsupported format {fmt!r}")
    if fmt == "csv":
        nested = (T.ArrayType, T.StructType, T.MapType)
        df = df.select(*(F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema))
    writer = (df.coalesce(1) if single_file else df).write.mode("overwrite")
    writer.csv(path, header=True) if fmt == "csv" else getattr(writer, fmt)(path)


def lines_of(df: DataFrame, fmt: str = "json") -> Iterator[str]:
    """All rows as lines: JSON, CSV with a header, or a table of padded columns.

    Rows come partition by partition; a padded table needs their widths first, by one aggregation.
    """
    if fmt == "json":
        yield from (json.dumps(r.asDict(recursive=True), default=str) for r in df.toLocalIterator())
    elif fmt == "csv":
        text = lambda values: csv_line(["" if v is None else str(v) for v in values])
        yield text(df.columns)
        yield from (text(r) for r in df.toLocalIterator())
    elif fmt == "table":
        cells = df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(f"c{i}") for i, c in enumerate(df.columns)))
        widest = cells.agg(*(F.max(F.length(c)) for c in cells.columns)).first()
        widths = [max(len(c), w or 0) for c, w in zip(df.columns, widest)]
        yield "  ".join(c.ljust(w) for c, w in zip(df.columns, widths)).rstrip()
        yield from ("  ".join(v.ljust(w) for v, w in zip(r, widths)).rstrip() for r in cells.toLocalIterator())
    else:
        raise DataLoadError(f"unsupported format {fmt!r}")


def csv_line(values: list[str]) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(values)
    return out.getvalue()


def preview(df: DataFrame, order: str, rows: int = 5) -> DataFrame:
    """The first rows by a column; Spark tables have no order of their own."""
    require(df, order)
    return df.orderBy(order).limit(rows)


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Fields of structs as columns with joined names, at any depth."""

    def leaves(schema: T.StructType, names: tuple[str, ...]):
        for f in schema:
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, (*names, f.name))
            else:
                yield (*names, f.name)

    paths = list(leaves(df.schema, ()))
    return df.select(*(F.col(".".join(f"`{n}`" for n in p)).alias(sep.join(p)) for p in paths))


PIPELINE_KEYS = {"data", "target", "task", "engineer", "tune", "validate", "save", "test_size", "ensemble", "advanced_cv", "model_hint", "name"}


def pipeline_config(text: str) -> dict:
    """A pipeline's YAML: data, target and task are required; unknown keys are refused."""
    found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ConfigError("a pipeline is a mapping")
    missing, unknown = {"data", "target", "task"} - found.keys(), found.keys() - PIPELINE_KEYS
    if missing or unknown:
        raise ConfigError(f"missing keys: {sorted(missing)}; unknown keys: {sorted(unknown)}")
    return {"test_size": 0.2, "engineer": False, "tune": False, "validate": True, "save": None} | found


def merged(*layers: dict) -> dict:
    """Nested mappings, later ones over earlier ones."""
    out: dict = {}
    for layer in layers:
        for key, value in layer.items():
            out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out

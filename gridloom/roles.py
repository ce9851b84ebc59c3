"""Column roles of a schema, found once from the types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.errors import DataValidationError


@dataclass(frozen=True)
class ColumnRoles:
    numeric: tuple[str, ...]
    text: tuple[str, ...]
    boolean: tuple[str, ...]
    temporal: tuple[str, ...]
    other: tuple[str, ...]

    @classmethod
    def of(cls, df: DataFrame) -> ColumnRoles:
        pick = lambda *kinds: tuple(f.name for f in df.schema if isinstance(f.dataType, kinds))
        numeric = pick(T.NumericType)
        text = pick(T.StringType)
        boolean = pick(T.BooleanType)
        temporal = pick(T.DateType, T.TimestampType, T.TimestampNTZType)
        known = {*numeric, *text, *boolean, *temporal}
        return cls(numeric, text, boolean, temporal, tuple(c for c in df.columns if c not in known))


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise DataValidationError(f"columns not found: {missing}; available: {df.columns}")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is missing, as NULL is; floating columns only."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not floats:
        return df
    return df.select(*(F.nullif(c, F.lit(float("nan"))).alias(c) if c in floats else F.col(c) for c in df.columns))

"""Repeatable random numbers of a row's key, which any SQL can draw as well."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(key: str | Column, *salts: object) -> Column:
    """A number in [0, 1) from the first 32 bits of md5 over the key and the salts, joined by dashes.

    Equal keys draw equal numbers; a null key draws as an empty one.
    """
    key = F.col(key) if isinstance(key, str) else key
    parts = [F.coalesce(key.cast("string"), F.lit("")), *(s.cast("string") if isinstance(s, Column) else F.lit(str(s)) for s in salts)]
    return F.conv(F.substring(F.md5(F.concat_ws("-", *parts)), 1, 8), 16, 10).cast("double") / 2.0**32


def draw_sql(key: str, *salts: object) -> str:
    """The same number in DuckDB's SQL; salts are SQL expressions."""
    text = " || '-' || ".join([f"coalesce(({key})::VARCHAR, '')", *(f"({s})::VARCHAR" for s in salts)])
    return f"(('0x' || substr(md5({text}), 1, 8))::UBIGINT::DOUBLE / 4294967296)"

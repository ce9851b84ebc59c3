"""Session settings that the operators count on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, name: str = "gridloom", **settings: str) -> SparkSession:
    """The running session, or a new one with adaptive execution and UTC."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_KEPT: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    """Persist a frame that a lazy result reads more than once, until ``release``."""
    _KEPT.append(df.persist())
    return df


def release() -> None:
    """Give back what lazy results have kept; they stay valid and are computed anew."""
    while _KEPT:
        _KEPT.pop().unpersist()

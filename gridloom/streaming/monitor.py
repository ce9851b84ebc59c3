"""Quality and drift of an event stream, by window of event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import drift
from gridloom.roles import require


def windowed_quality(stream: DataFrame, ts: str, columns: list[str], window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``start, end, n, missing_{c}, mean_{c}, std_{c}`` of each window, with a watermark for late rows."""
    require(stream, ts, *columns)
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    aggs = [F.count("*").alias("n")]
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [F.sum(F.col(c).isNull().cast("int")).alias(f"missing_{c}"), F.avg(x).alias(f"mean_{c}"), F.stddev_samp(x).alias(f"std_{c}")]
    found = timed.groupBy(F.window(ts, window).alias("w_")).agg(*aggs)
    return found.select("w_.start", "w_.end", *[c for c in found.columns if c != "w_"])


def session_counts(stream: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """``key, start, end, n`` of each session of a key."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    found = timed.groupBy(key, F.session_window(ts, gap).alias("w_")).agg(F.count("*").alias("n"))
    return found.select(key, "w_.start", "w_.end", "n")


def drift_sink(reference: DataFrame, columns: list[str], report: Callable[[DataFrame, int], None], **options) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: hands the drift of each micro-batch against a fixed reference to ``report``."""

    def check(batch: DataFrame, epoch: int) -> None:
        kept = batch.select(*columns).persist()
        try:
            if kept.limit(2).count() == 2:
                report(drift.detect(reference, kept, columns, **options), epoch)
        finally:
            kept.unpersist()

    return check

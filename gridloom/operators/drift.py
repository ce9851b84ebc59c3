"""Distribution drift between two tables: all columns together in a fixed number of jobs."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.errors import DriftDetectionError
from gridloom.functions.quantiles import cumulate, exact_quantiles, quantiles
from gridloom.roles import ColumnRoles


def common_numeric(reference: DataFrame, current: DataFrame) -> list[str]:
    there = set(ColumnRoles.of(current).numeric)
    found = [c for c in ColumnRoles.of(reference).numeric if c in there]
    if not found:
        raise DriftDetectionError("the tables have no numeric column in common")
    return found


def _values(df: DataFrame, columns: list[str]) -> DataFrame:
    cells = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns))
    return df.select(F.inline(cells)).where("x is not null and not isnan(x)")


def _counts(reference: DataFrame, current: DataFrame, columns: list[str] | None) -> DataFrame:
    """``feature, x, r, c``: how often each value stands in either table."""
    columns = common_numeric(reference, current) if columns is None else columns
    both = _values(reference, columns).withColumn("side", F.lit(0)).union(_values(current, columns).withColumn("side", F.lit(1)))
    return both.groupBy("feature", "x").agg(F.count_if(F.col("side") == 0).alias("r"), F.count_if(F.col("side") == 1).alias("c"))


def psi(
    reference: DataFrame, current: DataFrame, columns: list[str] | None = None, bins: int = 10, accuracy: int | None = None
) -> DataFrame:
    """``feature, psi``: population stability over quantile bins of the reference.

    Edges are the distinct exact percentiles, the outer ones moved beyond both samples by one. Equal
    values are counted once in either table; percentiles come from these counts cumulated over ranges
    of values, and bins are sums of them. Fewer than two edges give 0, features that one table lacks
    none. With ``accuracy`` the percentiles are approximate, by a sketch.
    """
    counts = _counts(reference, current, columns).persist()
    try:
        return _psi(counts, bins, accuracy)
    finally:
        counts.unpersist()


def _psi(counts: DataFrame, bins: int, accuracy: int | None) -> DataFrame:
    at = [i / bins for i in range(bins + 1)]
    if accuracy is None:
        inner = exact_quantiles(counts, "feature", "x", "r", at)
    else:
        inner = {r["feature"]: r["q"] for r in _sketched(counts, at, accuracy).collect()}
    span = counts.where("c > 0").groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    edges = {}
    for feature, lo, hi in span.collect():
        if feature in inner:
            e = sorted(set(inner[feature]))
            edges[feature] = [min(e[0], lo) - 1, *e[1:-1], max(e[-1], hi) + 1] if len(e) >= 2 else None
    spark = counts.sparkSession
    if not edges:
        return spark.createDataFrame([], "feature string, psi double")
    known = spark.createDataFrame(list(edges.items()), "feature string, e array<double>")
    place = F.when(F.col("e").isNull(), 1).otherwise(F.least(F.size(F.filter("e", lambda v: v <= F.col("x"))), F.size("e") - 1))
    binned = counts.join(F.broadcast(known), "feature").groupBy("feature", place.alias("bin")).agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    shares: dict[str, dict[int, tuple[int, int]]] = {f: {} for f in edges}
    for feature, b, r, c in binned.collect():
        shares[feature][b] = (r, c)
    rows = []
    for feature, found in shares.items():
        n, m = (sum(v[i] for v in found.values()) for i in (0, 1))
        total = 0.0
        for b in range(1, len(edges[feature] or "12")):
            r, c = found.get(b, (0, 0))
            p, q = r / n + 1e-4, c / m + 1e-4
            total += (q - p) * math.log(q / p)
        rows.append((feature, total))
    return spark.createDataFrame(rows, "feature string, psi double")


def _sketched(counts: DataFrame, at: list[float], accuracy: int) -> DataFrame:
    """Approximate percentiles of the reference: each value stands as often as it was counted."""
    repeated = counts.where("r > 0").select("feature", "x", F.explode(F.sequence(F.lit(1).cast("long"), "r")))
    return repeated.groupBy("feature").agg(quantiles(F.col("x"), at, accuracy).alias("q"))


def ks_statistic(reference: DataFrame, current: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``feature, statistic, n_ref, n_cur``: greatest distance of the two empirical distributions.

    Equal values are counted first, then cumulated within ranges of values and over the ranges'
    totals. No task sees all values of a feature.
    """
    counts = _counts(reference, current, columns).persist()
    try:
        return _ks(counts)
    finally:
        counts.unpersist()


def _ks(counts: DataFrame) -> DataFrame:
    gap = F.abs(F.col("r_upto") / F.col("r_total") - F.col("c_upto") / F.col("c_total"))
    found = (
        cumulate(counts, "feature", "x", ["r", "c"])
        .where("r_total > 0 and c_total > 0")
        .groupBy("feature")
        .agg(F.max(gap).alias("statistic"), F.max("r_total").alias("n_ref"), F.max("c_total").alias("n_cur"))
    )
    return counts.sparkSession.createDataFrame(found.collect(), found.schema)


#: Sample sizes up to which the two-sample p-value is exact.
EXACT_SIZE = 10_000


def ks_p_value(statistic: float, n: int, m: int, exact_size: int = EXACT_SIZE) -> float:
    """Two-sample p-value: exact up to ``exact_size`` values in either sample, else asymptotic."""
    if max(n, m) <= exact_size:
        return ks_exact(statistic, n, m)
    return ks_asymptotic(statistic, n, m)


def ks_exact(statistic: float, n: int, m: int) -> float:
    """The share of all orders of n + m distinct values whose statistic is as large or larger.

    Orders are lattice paths from (0, 0) to (n, m). Of the paths to each point, the share that stays
    within the distance follows from those to the points before it, diagonal by diagonal.
    """
    least = math.ceil(statistic * n * m - 1e-7)  # |i * m - j * n| of a point that lies on or beyond
    if least <= 0:
        return 1.0
    share = np.zeros(n + 2)  # by i + 1
    share[1] = 1.0
    for d in range(1, n + m + 1):
        i = np.arange(max(0, d - m), min(n, d) + 1)
        j = d - i
        now = (share[i] * i + share[i + 1] * j) / d
        share[:] = 0
        share[i + 1] = np.where(np.abs(i * m - j * n) < least, now, 0)
    return float(min(1.0, max(0.0, 1.0 - share[n + 1])))


def ks_asymptotic(statistic: float, n: int, m: int) -> float:
    """Kolmogorov's series at the effective size."""
    lam = (math.sqrt(n * m / (n + m)) + 0.12 + 0.11 / math.sqrt(n * m / (n + m))) * statistic
    if lam < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))))


def detect(
    reference: DataFrame, current: DataFrame, columns: list[str] | None = None, bins: int = 10, threshold: float = 0.2,
    alpha: float = 0.05, accuracy: int | None = None, exact_size: int = EXACT_SIZE,
) -> DataFrame:
    """``feature, psi, ks_statistic, ks_p_value, psi_drifted, ks_drifted, drifted``.

    Features with under two values on a side are left out. The p-value is exact for samples of up to
    ``exact_size`` values each, else asymptotic.
    """
    counts = _counts(reference, current, columns).persist()
    try:
        ks = _ks(counts).where("n_ref >= 2 and n_cur >= 2")
        found = _psi(counts, bins, accuracy).join(F.broadcast(ks), "feature")
    finally:
        counts.unpersist()
    p = [(r["feature"], ks_p_value(r["statistic"], r["n_ref"], r["n_cur"], exact_size)) for r in ks.collect()]
    found = found.join(F.broadcast(reference.sparkSession.createDataFrame(p, "feature string, ks_p_value double")), "feature")
    return found.select("feature", "psi", F.col("statistic").alias("ks_statistic"), "ks_p_value").select(
        "*",
        (F.col("psi") > threshold).alias("psi_drifted"),
        (F.col("ks_p_value") < alpha).alias("ks_drifted"),
        ((F.col("psi") > threshold) | (F.col("ks_p_value") < alpha)).alias("drifted"),
    )


def summary(report: DataFrame) -> DataFrame:
    """One row: features, drifted ones and their share, greatest psi and its feature; zeros if empty."""
    return report.agg(
        F.count("*").alias("total"),
        F.coalesce(F.sum(F.col("drifted").cast("int")), F.lit(0)).alias("n_drifted"),
        F.coalesce(F.round(100 * F.avg(F.col("drifted").cast("double")), 2), F.lit(0.0)).alias("drift_pct"),
        F.coalesce(F.round(F.max("psi"), 6), F.lit(0.0)).alias("max_psi"),
        F.max_by("feature", "psi").alias("worst_feature"),
    )

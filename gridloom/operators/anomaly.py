"""Outlier detection: standardising, local outlier factor, isolation forest, consensus."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.errors import DataValidationError
from gridloom.functions.neighbours import nearest_rows
from gridloom.functions.quantiles import exact_quantiles
from gridloom.roles import require
from gridloom.session import keep


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """``{c}_z`` for each column by the population deviation, over rows without a null among them."""
    require(df, *columns)
    df = df.na.drop(subset=columns)
    one = df.agg(*(f(F.col(c).cast("double")).alias(f"{n}_{c}_") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    scaled = df.join(F.broadcast(one), F.lit(True))
    z = [F.coalesce(F.try_divide(F.col(c) - F.col(f"m_{c}_"), F.col(f"s_{c}_")), F.lit(0.0)).alias(f"{c}_z") for c in columns]
    return scaled.select(*df.columns, *z)


def local_outlier_factor(df: DataFrame, key: str, columns: list[str], k: int = 20) -> DataFrame:
    """``key, lof``: exact local outlier factors in Euclidean distance.

    Neighbours come from ``nearest_rows``, which looks only at boxes of points near a row. Ties of
    distance are broken by key; keys are unique, rows with a null left out.
    """
    require(df, key, *columns)
    points = df.select(F.col(key).alias("id"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns))).na.drop()
    if points.limit(k + 1).count() <= k:
        raise DataValidationError(f"local outlier factors need more than {k} rows")
    near = nearest_rows(points, points, k, same=True, root=True).select(F.col("id_").alias("id"), F.col("id").alias("other"), "d")
    near = keep(near)
    reach = near.groupBy("id").agg(F.max("d").alias("k_distance"))
    density = (
        near.join(reach.select(F.col("id").alias("other"), "k_distance"), "other")
        .groupBy("id")
        .agg(F.avg(F.greatest("d", "k_distance")).alias("mean"))
        .select("id", (1 / (F.col("mean") + 1e-10)).alias("lrd"))
    )
    return (
        near.join(density.select(F.col("id").alias("other"), F.col("lrd").alias("other_lrd")), "other")
        .groupBy("id")
        .agg(F.avg("other_lrd").alias("around"))
        .join(density, "id")
        .select(F.col("id").alias(key), (F.col("around") / F.col("lrd")).alias("lof"))
    )


def _path_average(n: int) -> float:
    return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _isolating_tree(points: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Random cuts of points: feature (-1 in leaves), cut, number of the left child (the right one follows), path length."""
    most = math.ceil(math.log2(max(len(points), 2)))
    feature, cut, child, length = [-1], [0.0], [0], [0.0]
    todo = [(0, points, 0)]
    while todo:
        at, part, depth = todo.pop()
        lo, hi = part.min(axis=0), part.max(axis=0)
        if depth == most or len(part) < 2 or not (hi > lo).any():
            length[at] = depth + _path_average(len(part))
            continue
        f = int(rng.choice(np.flatnonzero(hi > lo)))
        c = float(rng.uniform(lo[f], hi[f]))
        left = part[:, f] < c
        if not left.any():  # the cut fell on the least value
            c = float(np.nextafter(c, np.inf))
            left = part[:, f] < c
        feature[at], cut[at], child[at] = f, c, len(feature)
        for side in (part[left], part[~left]):
            todo.append((len(feature), side, depth + 1))
            feature.append(-1)
            cut.append(0.0)
            child.append(0)
            length.append(0.0)
    return np.array(feature), np.array(cut), np.array(child), np.array(length)


def isolation_forest(df: DataFrame, key: str, columns: list[str], trees: int = 100, rows: int = 256, seed: int = 42) -> DataFrame:
    """``key, score``: 2 ** (-mean path / expected path), near 1 for outliers.

    Each tree grows on ``rows`` points of a pool, the ``trees * rows`` rows of least seeded hash of
    the key, so the driver sees no more; scoring is one map over all rows, tree by tree in numpy, dealt
    to all cores whatever the number of files.
    Rows with a null are left out.
    """
    require(df, key, *columns)
    x = [F.col(c).cast("double") for c in columns]
    base = df.where(" and ".join(f"`{c}` is not null" for c in columns))
    drawn = base.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(rows * trees).select(*x).collect()
    if not drawn:
        raise DataValidationError("no complete rows")
    pool, rng = np.array(drawn, float), np.random.default_rng(seed)
    size = min(rows, len(pool))
    forest = [_isolating_tree(pool[rng.choice(len(pool), size, replace=False)], rng) for _ in range(trees)]
    expected = _path_average(size) or 1.0

    @F.arrow_udf("double")
    def score(*parts: pa.Array) -> pa.Array:
        values = np.column_stack([p.to_numpy(zero_copy_only=False) for p in parts])
        n, width = values.shape
        flat, first = values.reshape(-1), width * np.arange(n)
        total = np.zeros(n)
        for feature, cut, child, length in forest:
            at, open_ = np.zeros(n, np.int64), np.arange(n)
            while len(open_):
                node = at[open_]
                f = feature[node]
                inner = f >= 0
                open_, node, f = open_[inner], node[inner], f[inner]
                at[open_] = child[node] + (flat[first[open_] + f] >= cut[node])
            total += length[at]
        return pa.array(np.exp2(-total / trees / expected))

    dealt = base.select(key, *(v.alias(f"x{i}_") for i, v in enumerate(x))).repartition(df.sparkSession.sparkContext.defaultParallelism, key)
    return dealt.select(key, score(*(f"x{i}_" for i in range(len(x)))).alias("score"))


def flag_top(df: DataFrame, score: str, contamination: float) -> DataFrame:
    """``is_anomaly``: scores strictly above the (1 - contamination) percentile, which is exact; null scores are not."""
    counts = df.where(F.col(score).isNotNull()).groupBy(F.lit(0).alias("g_"), F.col(score).cast("double").alias("x_")).agg(F.count("*").alias("n_")).persist()
    found = exact_quantiles(counts, "g_", "x_", "n_", [1 - contamination])
    counts.unpersist()
    cut = found[0][0] if found else None
    return df.withColumn("is_anomaly", F.coalesce(F.col(score) > F.lit(cut), F.lit(False)))


def consensus(df: DataFrame, flags: list[str], threshold: int = 2) -> DataFrame:
    """``consensus_score`` (flags set) and ``is_anomaly`` (at least ``threshold`` of them)."""
    require(df, *flags)
    votes = sum((F.coalesce(F.col(f).cast("int"), F.lit(0)) for f in flags), F.lit(0))
    return df.withColumn("consensus_score", votes).withColumn("is_anomaly", F.col("consensus_score") >= threshold)


def compare_methods(df: DataFrame, flags: list[str]) -> DataFrame:
    """``method, n_anomalies, pct`` of each flag column and of the consensus, from one aggregation."""
    names = [*flags, "is_anomaly"]
    one = df.agg(F.count("*").alias("n_"), *(F.coalesce(F.sum(F.col(f).cast("int")), F.lit(0)).alias(f"n_{i}") for i, f in enumerate(names)))
    rows = [
        F.struct(F.lit("consensus" if f == "is_anomaly" else f).alias("method"), F.col(f"n_{i}").alias("n_anomalies"), F.try_divide(100.0 * F.col(f"n_{i}"), F.col("n_")).alias("pct"))
        for i, f in enumerate(names)
    ]
    return one.select(F.inline(F.array(*rows)))


def report(df: DataFrame, by: list[str]) -> DataFrame:
    """``by, count, avg_consensus`` of the anomalies."""
    return df.where("is_anomaly").groupBy(*by).agg(F.count("*").alias("count"), F.avg("consensus_score").alias("avg_consensus"))



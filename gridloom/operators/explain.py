"""Local explanations of fitted models."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.errors import DataValidationError
from gridloom.roles import require

MOST_ROWS = 50


def _normal(key, seed: int, c: str):
    """A standard normal number from a hash of the key and the draw (Box-Muller)."""
    u = lambda k: (F.pmod(F.xxhash64(key, F.col("draw_"), F.lit(f"{seed}-{c}-{k}")), F.lit(1 << 30)) + 0.5) / (1 << 30)
    return F.sqrt(-2 * F.log(u(0))) * F.cos(6.283185307179586 * u(1))


def lime(df: DataFrame, fitted, key: str, features: list[str], draws: int = 200, seed: int = 42) -> DataFrame:
    """``key, feature, weight``: slopes, in deviations, of a weighted linear model around each of up to 50 rows.

    Each row is perturbed by its features' deviations, the model scores all perturbed rows as one
    table, and the weighted normal equations of every row come from one aggregation.
    """
    require(df, key, *features)
    rows = df.orderBy(F.xxhash64(F.col(key)), key).limit(MOST_ROWS)
    spread = df.agg(*(F.stddev_samp(F.col(c).cast("double")).alias(c) for c in features)).first()
    wide = rows.withColumn("draw_", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    steps = {c: _normal(F.col(key), seed, c) for c in features}
    wide = wide.select("*", *(z.alias(f"z_{c}") for c, z in steps.items()))
    moved = wide.withColumns({c: F.col(c) + F.col(f"z_{c}") * F.lit(spread[c] or 0.0) for c in features})
    scored = fitted.transform(moved)
    z = [F.lit(1.0), *(F.col(f"z_{c}") for c in features)]
    width = 0.75 * np.sqrt(len(features))
    w = F.exp(-sum((v * v for v in z[1:]), F.lit(0.0)) / width**2)
    k = len(z)
    sums = scored.groupBy(key).agg(
        *(F.sum(w * z[i] * z[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)), *(F.sum(w * z[i] * F.col("prediction")).alias(f"b{i}") for i in range(k))
    )
    out = []
    for r in sums.collect():
        a = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        slopes = np.linalg.solve(a + 1e-6 * np.eye(k), np.array([r[f"b{i}"] for i in range(k)]))
        out += [(r[key], c, float(s)) for c, s in zip(features, slopes[1:])]
    if not out:
        raise DataValidationError("no rows to explain")
    return df.sparkSession.createDataFrame(out, f"`{key}` {df.schema[key].dataType.simpleString()}, feature string, weight double")


def shapley(df: DataFrame, fitted, key: str, features: list[str], background: DataFrame | None = None, orders: int = 20, rows: int = MOST_ROWS, seed: int = 42) -> DataFrame:
    """``key, feature, value, shap``: sampled Shapley values of any model with ``prediction``, for up to ``rows`` rows.

    A row's features replace those of a background row (one of up to 100) one by one, in ``orders``
    random orders; what a feature changes is averaged. All steps of all rows are one table that the
    model scores once, so a row's values sum up to its prediction less the mean over its backgrounds.
    """
    require(df, key, *features)
    spark, rng = df.sparkSession, np.random.default_rng(seed)
    asked = df.orderBy(F.xxhash64(F.col(key)), key).limit(rows).select(F.col(key).alias("key_"), F.struct(*features).alias("x_"))
    pool = (df if background is None else background).select(*features).na.drop()
    pool = pool.orderBy(F.xxhash64(*features), *features).limit(100).select(F.struct(*features).alias("b_")).collect()
    if not pool:
        raise DataValidationError("no complete background rows")
    plan = [(o, [int(v) for v in rng.permutation(len(features))], pool[int(rng.integers(len(pool)))]["b_"]) for o in range(orders)]
    kinds = df.select(F.struct(*features).alias("b")).schema["b"].dataType
    schema = T.StructType([T.StructField("order_", T.IntegerType()), T.StructField("places_", T.ArrayType(T.IntegerType())), T.StructField("b_", kinds)])
    wide = asked.join(F.broadcast(spark.createDataFrame(plan, schema)), F.lit(True)).withColumn("step_", F.explode(F.sequence(F.lit(0), F.lit(len(features)))))
    mixed = wide.select("key_", "order_", "places_", "step_", *(F.when(F.get("places_", F.lit(i)) < F.col("step_"), F.col(f"x_.`{c}`")).otherwise(F.col(f"b_.`{c}`")).alias(c) for i, c in enumerate(features)))
    scored = fitted.transform(mixed).select("key_", "order_", "places_", "step_", "prediction")
    steps = scored.groupBy("key_", "order_", "places_").agg(F.transform(F.array_sort(F.collect_list(F.struct("step_", "prediction"))), lambda s: s["prediction"]).alias("p_"))
    change = lambda i: F.get("p_", F.get("places_", F.lit(i)) + 1) - F.get("p_", F.get("places_", F.lit(i)))
    parts = steps.select("key_", F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), change(i).alias("d_")) for i, c in enumerate(features)))))
    found = parts.groupBy("key_", "feature").agg(F.avg("d_").alias("shap"))
    values = asked.select("key_", F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"x_.`{c}`").cast("string").alias("value")) for c in features))))
    return found.join(values, ["key_", "feature"]).select(F.col("key_").alias(key), "feature", "value", "shap")


def shapley_importance(values: DataFrame) -> DataFrame:
    """``feature, importance``: mean absolute Shapley value."""
    return values.groupBy("feature").agg(F.avg(F.abs("shap")).alias("importance"))


def lime_importance(weights: DataFrame) -> DataFrame:
    """``feature, importance``: mean absolute weight."""
    return weights.groupBy("feature").agg(F.avg(F.abs("weight")).alias("importance"))


def top_features(importance: DataFrame, n: int = 10) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(n)


def word_dropout(df: DataFrame, key: str, text: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    """``augmented``: the text less a tenth of its words, at least one, chosen by a hash; short texts stay."""
    require(df, key, text)
    words = F.split(F.coalesce(F.col(text), F.lit("")), r"\s+")
    n = F.size(words)
    drop = F.greatest(F.lit(1), F.floor(n * share).cast("int"))
    order = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.xxhash64(F.col(key), i, F.lit(seed)).alias("h"), i.alias("i")))
    gone = F.transform(F.slice(F.array_sort(order), F.lit(1), drop), lambda x: x["i"])
    kept = F.filter(words, lambda w, i: ~F.array_contains(gone, i))
    return df.withColumn("augmented", F.when(n > 2, F.array_join(kept, " ")).otherwise(F.col(text)))


#: Rows of a label that are numbered together.
GROUP_ROWS = 50_000


def training_pairs(df: DataFrame, key: str, label: str, per_row: int = 1, seed: int = 42) -> DataFrame:
    """``key, other, same``: for each row, ``per_row`` partners of its label and as many of the next label.

    A label's rows are dealt to groups of about ``GROUP_ROWS`` by a hash and stand in hashed order within
    theirs, so no task numbers a whole label; partners are the next ones of the group, or of a group
    of the next label: a join on numbers, not of all rows with all. Labels are few; rows without one are left out.
    """
    require(df, key, label)
    order = F.xxhash64(F.col(key), F.lit(seed))
    base = df.where(F.col(label).isNotNull()).select(key, label)
    sizes = base.groupBy(label).agg(F.count("*").alias("n_")).orderBy(label).collect()
    if not sizes:
        return base.select(key, F.col(key).alias("other"), F.lit(True).alias("same"))
    ranks = [(r[label], i, -(-r["n_"] // GROUP_ROWS)) for i, r in enumerate(sizes)]
    kinds = T.StructType([base.schema[label], T.StructField("rank_", T.IntegerType()), T.StructField("groups_", T.LongType())])
    ranked = df.sparkSession.createDataFrame(ranks, kinds)
    placed = base.join(F.broadcast(ranked), label).withColumn("g_", F.pmod(F.xxhash64(F.col(key), F.lit(seed + 1)), F.col("groups_")))
    within = Window.partitionBy("rank_", "g_")
    placed = placed.select(key, "rank_", "g_", (F.row_number().over(within.orderBy(order, key)) - 1).alias("at_"))
    counts = placed.groupBy("rank_", "g_").agg(F.count("*").alias("n_"))
    step = F.explode(F.sequence(F.lit(1), F.lit(per_row)))
    own = placed.join(F.broadcast(counts), ["rank_", "g_"]).where("n_ > 1").select(key, "rank_", "g_", "at_", "n_", step.alias("s_"))
    same = own.select(key, "rank_", "g_", F.pmod(F.col("at_") + F.col("s_"), F.col("n_")).alias("at_"), F.lit(True).alias("same"))
    parts = [same]
    if len(ranks) > 1:
        following = df.sparkSession.createDataFrame([(i, (i + 1) % len(ranks), ranks[(i + 1) % len(ranks)][2]) for i in range(len(ranks))], "rank_ int, next_ int, next_groups_ long")
        far = placed.join(F.broadcast(following), "rank_").select(key, F.col("next_").alias("rank_"), F.pmod("g_", "next_groups_").alias("g_"), "at_", step.alias("s_"))
        far = far.join(F.broadcast(counts), ["rank_", "g_"])
        parts.append(far.select(key, "rank_", "g_", F.pmod(F.col("at_") + F.col("s_"), F.col("n_")).alias("at_"), F.lit(False).alias("same")))
    partners = placed.select("rank_", "g_", "at_", F.col(key).alias("other"))
    return reduce(DataFrame.union, parts).join(partners, ["rank_", "g_", "at_"]).select(key, "other", "same")

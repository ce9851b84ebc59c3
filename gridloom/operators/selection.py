"""Model selection and models beyond the factory: grids, heads, texts, clusters, exact tests."""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import IDF, PCA, CountVectorizerModel, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.errors import DataValidationError, NotSupported
from gridloom.operators import clean, models, tuning
from gridloom.operators.text import tokens, unit
from gridloom.roles import require
from gridloom.session import keep

UNSUPPORTED = {
    "tabnet": "needs a neural network library",
    "transformer": "needs a neural network library",
    "contrastive_training": "needs pretrained text models",
    "image_cnn": "needs pretrained image models",
    "kriging": "no distributed solver",
    "onnx": "needs an export library",
}


def refuse(name: str):
    """Say why a known capability is left out."""
    raise NotSupported(f"{name}: {UNSUPPORTED.get(name, 'not known')}")


def grid_search(
    df: DataFrame, key: str, target: str, features: list[str], model: str, grid: dict[str, list], task: str = "regression", k: int = 3, test_share: float = 0.2
) -> dict:
    """The settings of a grid with the best mean score over k folds, and what the model of them does with rows held out.

    ``metric, score, options, trials`` are of the folds; ``model`` learns from all rows but a
    ``test_share``, whose ``predictions`` and ``test`` metrics come with it. Classes are split evenly.
    """
    name, more = tuning.main_metric(task)
    parts = clean.split(df, key, test_share, by=target if task == "classification" else None).persist()
    known, test = parts.where("not is_test").drop("is_test"), parts.where("is_test").drop("is_test")
    found = []
    for values in product(*grid.values()):
        options = dict(zip(grid, values))
        score = tuning.cross_validate(known, key, target, features, model, task, k, **options)[name]["mean"]
        found.append((score, options))
    best = (max if more else min)(found, key=lambda r: r[0])
    fitted = models.train(known, target, features, model, task, **best[1])
    scored = fitted.transform(test)
    label = f"{target}_at_" if f"{target}_at_" in scored.columns else target
    result = tuning.score(scored, label, task)
    parts.unpersist()
    return {"metric": name, "score": best[0], "options": best[1], "trials": found, "model": fitted, "predictions": scored.select(key, target, "prediction"), "test": result}


def best_head(df: DataFrame, key: str, label: str, vector: str, names: tuple[str, ...] = ("logistic", "svc", "random_forest_classifier"), k: int = 3) -> dict[str, float]:
    """Mean accuracy over k folds of classifiers on a vector column, best first."""
    require(df, key, label, vector)
    ready = df.select(key, F.col(label).cast("double").alias("label"), array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    folded = clean.folds(ready, key, k).persist()
    out = {}
    for name in names:
        hits = 0.0
        for fold in range(k):
            fitted = models.estimator(name).fit(folded.where(F.col("fold") != fold))
            test = fitted.transform(folded.where(F.col("fold") == fold))
            hits += test.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
        out[name] = hits / k
    folded.unpersist()
    return dict(sorted(out.items(), key=lambda r: -r[1]))


def text_classifier(df: DataFrame, key: str, text: str, label: str, vocabulary: int = 10_000, test_share: float = 0.2) -> DataFrame:
    """``key, label, held_out, prediction`` by a logistic regression on TF-IDF of words and word pairs.

    The ``vocabulary`` most frequent terms are kept. A ``test_share`` of the rows, by a draw from the
    key, is predicted but not learnt from, and rows without a label as well; null texts are empty.
    Texts are cut into terms once and kept as vectors for the fitting rounds, until
    ``session.release``.
    """
    require(df, key, text, label)
    words = tokens(F.coalesce(F.col(text), F.lit("")))
    pairs = F.zip_with(F.slice("w_", 1, F.greatest(F.size("w_") - 1, F.lit(0))), F.slice("w_", 2, F.greatest(F.size("w_") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    base = clean.split(df.select(key, text, label), key, test_share).withColumn("held_out", F.col("is_test") | F.col(label).isNull())
    terms = base.select(key, label, "held_out", words.alias("w_")).select(key, label, "held_out", F.concat("w_", pairs).alias("terms_"))
    terms = terms.persist(StorageLevel.DISK_ONLY)
    frequent = terms.where("not held_out").select(F.explode("terms_").alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    kept = [r["t"] for r in frequent.orderBy(F.desc("n"), "t").limit(vocabulary).collect()]
    if not kept:
        raise DataValidationError("no words to learn from")
    counted = CountVectorizerModel.from_vocabulary(kept, inputCol="terms_", outputCol="tf_").transform(terms).select(key, label, "held_out", "tf_")
    counted = keep(counted)
    learnt = counted.where("not held_out")
    stages = [
        IDF(inputCol="tf_", outputCol="features"),
        StringIndexer(inputCol=label, outputCol="label_", handleInvalid="keep", stringOrderType="alphabetAsc"),
        LogisticRegression(labelCol="label_", regParam=0.01, maxIter=30),
    ]
    fitted = Pipeline(stages=stages).fit(learnt)
    terms.unpersist()
    names = F.array(*map(F.lit, fitted.stages[1].labels))
    found = fitted.transform(counted)
    return found.select(key, F.col(label).alias("label"), "held_out", F.get(names, F.col("prediction").cast("int")).alias("prediction"))


def cluster_texts(df: DataFrame, key: str, vector: str, k: int = 5) -> DataFrame:
    """``key, cluster`` of embedded texts, by direction."""
    return _k_means(df.select(key, array_to_vector(unit(vector)).alias("features")), key, k)


def _k_means(ready: DataFrame, key: str, k: int) -> DataFrame:
    """``key, cluster``; the vectors are kept while the centres move."""
    ready.persist()
    fitted = KMeans(k=k, seed=42, predictionCol="cluster").fit(ready)
    ready.unpersist()
    return fitted.transform(ready).select(key, "cluster")


def cluster_arrays(df: DataFrame, key: str, vector: str, k: int = 5) -> DataFrame:
    """``key, cluster`` of arrays of one length, such as the pixels of small images, by k-means; null ones are left out."""
    return _k_means(df.where(F.col(vector).isNotNull()).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features")), key, k)


def agglomerate(df: DataFrame, key: str, vector: str, k: int = 5, grains: int = 200) -> DataFrame:
    """``key, cluster`` of embedded texts by average linkage of at most ``grains`` groups.

    K-means by direction makes the groups, whose centres and sizes alone reach the driver; the two
    nearest are joined until ``k`` are left. Up to ``grains`` different texts are linked one by one.
    """
    ready = df.where(F.col(vector).isNotNull()).select(key, array_to_vector(unit(vector)).alias("features"))
    fitted = KMeans(k=grains, seed=42, predictionCol="grain_").fit(ready)
    grained = keep(fitted.transform(ready).select(key, "grain_"))
    sizes = {r["grain_"]: float(r["count"]) for r in grained.groupBy("grain_").count().collect()}
    names = sorted(sizes)
    centres = np.array([fitted.clusterCenters()[i] for i in names])
    gaps = np.sqrt(np.maximum(((centres[:, None] - centres[None]) ** 2).sum(-1), 0))
    np.fill_diagonal(gaps, np.inf)
    weight, group = np.array([sizes[i] for i in names]), [[i] for i in names]
    alive = np.ones(len(names), bool)
    for _ in range(max(0, len(names) - k)):
        a, b = sorted(divmod(int(np.argmin(gaps)), len(names)))
        joined = (weight[a] * gaps[a] + weight[b] * gaps[b]) / (weight[a] + weight[b])
        gaps[a], gaps[:, a] = joined, joined
        gaps[a, a], gaps[b], gaps[:, b] = np.inf, np.inf, np.inf
        weight[a] += weight[b]
        group[a] += group[b]
        alive[b] = False
    of = [(grain, c) for c, i in enumerate(np.flatnonzero(alive)) for grain in group[i]]
    return grained.join(F.broadcast(df.sparkSession.createDataFrame(of, "grain_ int, cluster int")), "grain_").select(key, "cluster")


def cluster_sizes(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """``cluster, n, share`` of each cluster."""
    counts = df.groupBy(F.col(cluster).alias("cluster")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def silhouette(df: DataFrame, features: list[str], cluster: str = "cluster") -> float:
    """Mean silhouette in squared Euclidean distance, from one pass over clusters' moments."""
    ready = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df.withColumn(cluster, F.col(cluster).cast("double")))
    return ClusteringEvaluator(predictionCol=cluster).evaluate(ready)


def principal_components(df: DataFrame, features: list[str], k: int = 2) -> DataFrame:
    """``df`` with ``pc1..``, of standardised features."""
    fitted = Pipeline(stages=[*models.prepare(df, features), PCA(k=k, inputCol="features", outputCol="pc_")]).fit(df)
    from pyspark.ml.functions import vector_to_array

    wide = fitted.transform(df).withColumn("pc_", vector_to_array("pc_"))
    return wide.select(*df.columns, *(F.get("pc_", F.lit(i)).alias(f"pc{i + 1}") for i in range(k)))


def reconstruction_errors(df: DataFrame, features: list[str], k: int = 1) -> DataFrame:
    """``df`` with ``error``: squared distance of a standardised row to its first k components.

    This linear measure stands in for autoencoders, which it is not.
    """
    fitted = Pipeline(stages=[*models.prepare(df, features), PCA(k=k, inputCol="features", outputCol="pc_")]).fit(df)
    from pyspark.ml.functions import vector_to_array

    x, y = vector_to_array("features"), vector_to_array("pc_")
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e * e)
    return fitted.transform(df).select(*df.columns, F.greatest(F.lit(0.0), square(x) - square(y)).alias("error"))


def _shifted(points: DataFrame, at: np.ndarray, h: float) -> tuple[np.ndarray, np.ndarray]:
    """How many of ``points`` lie within ``h`` of each place, and their means: one aggregation."""
    names = [f"s{i}" for i in range(at.shape[1])]

    def sums(batches):
        n, total = np.zeros(len(at), np.int64), np.zeros(at.shape)
        step = max(1, 2_000_000 // at.size)
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            for lo in range(0, len(x), step):
                part = x[lo : lo + step]
                near = ((at[:, None] - part[None]) ** 2).sum(-1) <= h * h
                n += near.sum(1)
                total += near @ part
        hit = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"i": hit, "n": n[hit], **{c: total[hit, k] for k, c in enumerate(names)}})

    parts = points.mapInArrow(sums, "i long, n long, " + ", ".join(f"{c} double" for c in names))
    n, mean = np.zeros(len(at), np.int64), at.copy()
    for r in parts.groupBy("i").agg(*(F.sum(c).alias(c) for c in ("n", *names))).collect():
        n[r["i"]] = r["n"]
        mean[r["i"]] = np.array([r[c] for c in names]) / r["n"]
    return n, mean


def mean_shift(df: DataFrame, key: str, features: list[str], bandwidth: float | None = None, seeds: int = 500, rounds: int = 50) -> DataFrame:
    """``df`` with ``cluster``: the nearest of the modes that the density of all rows climbs to.

    ``seeds`` rows, the least by a hash of the key, give the bandwidth where none is given. A climb
    starts from the mean of each square of the bandwidth that holds a row; each round sums all rows
    within the bandwidth of each climb in one aggregation. Modes come from the densest on; all rows
    are then given to their nearest mode by built-in expressions.
    """
    require(df, key, *features)
    whole = df.na.drop(subset=features)
    rows = clean.sample(whole, key, seeds).select(*(F.col(c).cast("double") for c in features)).collect()
    if not rows:
        raise DataValidationError("no complete rows")
    x = np.array(rows, float)
    gaps = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    h = bandwidth or float(np.quantile(gaps[np.triu_indices(len(x), 1)], 0.3)) if len(x) > 1 else 1.0
    if h <= 0:
        h = float(gaps[gaps > 0].min()) / 2 if (gaps > 0).any() else 1.0
    names = [f"x{i}" for i in range(len(features))]
    points = whole.select(*(F.col(c).cast("double").alias(x) for c, x in zip(features, names))).persist()
    squares = points.groupBy(*(F.rint(F.col(c) / F.lit(h)).alias(f"c{c}") for c in names)).agg(*(F.avg(c).alias(c) for c in names))
    at = np.array(sorted(map(tuple, squares.select(*names).collect())), float)
    density = np.zeros(len(at), np.int64)
    moving = np.arange(len(at))
    for _ in range(rounds):
        density[moving], new = _shifted(points, at[moving], h)
        still = np.abs(new - at[moving]).max(1) >= 1e-4 * h
        at[moving] = new
        moving = moving[still]
        if not len(moving):
            break
    points.unpersist()
    modes: list[np.ndarray] = []
    for i in np.argsort(-density, kind="stable"):
        if all(np.linalg.norm(at[i] - o) > h / 2 for o in modes):
            modes.append(at[i])
    far = [sum(((F.col(c) - F.lit(float(v))) ** 2 for c, v in zip(features, m)), F.lit(0.0)) for m in modes]
    best = F.array_min(F.array(*(F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(far))))
    return df.withColumn("cluster", best["i"])


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p-value of a 2 x 2 table: all tables as unlikely as this one or more."""
    n, row, col = a + b + c + d, a + b, a + c
    if not n:
        return 1.0
    log = lambda k: math.lgamma(k + 1)
    choose = lambda m, k: log(m) - log(k) - log(m - k)
    p = lambda k: math.exp(choose(row, k) + choose(n - row, col - k) - choose(n, col))
    mine = p(a)
    return min(1.0, sum(q for k in range(max(0, col - (n - row)), min(row, col) + 1) if (q := p(k)) <= mine * (1 + 1e-7)))


def contingency(df: DataFrame, left: str, right: str) -> tuple[int, int, int, int]:
    """Counts of both, left only, right only and neither of two boolean columns, from one aggregation."""
    x, y = F.coalesce(F.col(left), F.lit(False)), F.coalesce(F.col(right), F.lit(False))
    return tuple(df.agg(F.count_if(x & y), F.count_if(x & ~y), F.count_if(~x & y), F.count_if(~x & ~y)).first())


def average_rank(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``rank`` within groups, ties sharing the mean of their places."""
    w = Window.partitionBy(*by)
    ties = F.count("*").over(Window.partitionBy(*by, value))
    return df.withColumn("rank", F.rank().over(w.orderBy(value)) + (ties - 1) / 2)


def short_number(x: float | None) -> str:
    """A number for people: 1.2K, 3.4M, two decimals below a thousand."""
    if x is None or math.isnan(x):
        return "–"
    for size, unit in ((1e9, "B"), (1e6, "M"), (1e3, "K")):
        if abs(x) >= size:
            return f"{x / size:.1f}{unit}"
    return f"{x:.0f}" if float(x).is_integer() else f"{x:.2f}"


def short_number_column(value: str):
    """``short_number`` as an expression."""
    v = F.col(value).cast("double")
    out = F.when(v.isNull() | F.isnan(v), "–")
    for size, unit in ((1e9, "B"), (1e6, "M"), (1e3, "K")):
        out = out.when(F.abs(v) >= size, F.format_string(f"%.1f{unit}", v / size))
    return out.when(v == F.floor(v), F.format_string("%.0f", v)).otherwise(F.format_string("%.2f", v))

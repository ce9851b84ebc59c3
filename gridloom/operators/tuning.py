"""Validation and search: folds, bootstrap, random search, halving, stacking, feature selection."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.errors import ModelTrainingError
from gridloom.functions.draws import draw
from gridloom.operators import clean, metrics, models
from gridloom.session import keep

MOST_LOO_ROWS = 1000


def score(df: DataFrame, target: str, task: str) -> dict[str, float]:
    """All metrics of a table with ``prediction``, as a dict."""
    f = metrics.regression if task == "regression" else metrics.classification
    return f(df, target, "prediction").first().asDict()


def main_metric(task: str) -> tuple[str, bool]:
    """The metric that models are compared by, and whether more is better."""
    return ("rmse", False) if task == "regression" else ("accuracy", True)


def cross_validate(df: DataFrame, key: str, target: str, features: list[str], model: str, task: str = "regression", k: int = 5, **options) -> dict:
    """Mean and deviation of each metric over k folds by a draw from the key; folds of classes are even."""
    folded = clean.folds(df, key, k, by=target if task == "classification" else None).persist()
    found = []
    for fold in range(k):
        fitted = models.train(folded.where(F.col("fold") != fold), target, features, model, task, **options)
        found.append(score(fitted.transform(folded.where(F.col("fold") == fold)), target, task))
    folded.unpersist()
    names = [n for n in found[0] if n != "n"]
    return {n: {"mean": float(np.mean([r[n] for r in found])), "std": float(np.std([r[n] for r in found]))} for n in names}


def leave_one_out(df: DataFrame, target: str, features: list[str], ridge: float = 0.0) -> dict | None:
    """Metrics of a linear model, each row predicted from all others; None from 1000 rows on.

    The prediction without a row follows from the hat matrix, so no model is fitted twice.
    """
    n = df.limit(MOST_LOO_ROWS).count()
    if n >= MOST_LOO_ROWS:
        return None
    table = np.array(df.select(*(F.col(c).cast("double") for c in [*features, target])).na.drop().collect(), float)
    if len(table) <= len(features) + 1:
        raise ModelTrainingError("too few complete rows")
    x, y = np.column_stack([np.ones(len(table)), table[:, :-1]]), table[:, -1]
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 0
    inverse = np.linalg.pinv(x.T @ x + penalty)
    hat = np.einsum("ij,jk,ik->i", x, inverse, x)
    e = (y - x @ inverse @ x.T @ y) / np.maximum(1 - hat, 1e-12)
    return {"mse": float(np.mean(e**2)), "rmse": float(np.sqrt(np.mean(e**2))), "mae": float(np.mean(abs(e)))}


def _poisson_times(u, mean: float):
    """How often a row stands in a resample: a Poisson number from a draw in [0, 1)."""
    cuts, total = [], 0.0
    for k in range(12):
        total += math.exp(-mean) * mean**k / math.factorial(k)
        cuts.append(total)
    return sum((F.when(u > c, 1).otherwise(0) for c in cuts), F.lit(0))


def _interval(df: DataFrame, names: list[str]) -> DataFrame:
    """``metric, mean, low, high`` over replicates: 95 % by percentiles; a row for each replicate and metric is small."""
    ends = (("mean", F.avg), ("low", lambda m: F.percentile(m, F.lit(0.025))), ("high", lambda m: F.percentile(m, F.lit(0.975))))
    one = df.agg(*(f(m).alias(f"{m}_{n}") for m in names for n, f in ends))
    return one.select(F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), *(F.col(f"{m}_{n}").alias(n) for n, _ in ends)) for m in names))))


def bootstrap(df: DataFrame, key: str, y_true: str, y_pred: str, replicates: int = 200, seed: int = 42) -> DataFrame:
    """``metric, mean, low, high``: 95 % intervals of accuracy-like error means over Poisson resamples.

    Each row counts Poisson(1) times in each replicate, drawn from its key: sums of all replicates are
    made in one aggregation, without copying rows to replicates across the network.
    """
    spread = df.select(key, (F.col(y_true).cast("double") - F.col(y_pred).cast("double")).alias("e")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    spread = spread.withColumn("u", draw(key, seed, F.col("i")))  # a column of its own, so that it is drawn once
    sums = spread.select("i", "e", _poisson_times(F.col("u"), 1.0).alias("w")).where("w > 0").groupBy("i").agg(
        (F.sum(F.col("w") * F.abs("e")) / F.sum("w")).alias("mae"), F.sqrt(F.sum(F.col("w") * F.col("e") ** 2) / F.sum("w")).alias("rmse")
    )
    return _interval(sums, ["mae", "rmse"])


def bootstrap_cv(
    df: DataFrame, key: str, target: str, features: list[str], model: str = "linear", task: str = "regression",
    replicates: int = 20, share: float = 0.7, seed: int = 42, **options,
) -> DataFrame:
    """``metric, mean, low, high`` of a model fitted anew on each resample and scored on the rows it has not seen.

    Each row counts Poisson(``share``) times in a replicate, drawn from its key; the metric is R2 or
    accuracy. The linear model of all replicates comes from one aggregation and its scores from
    another; other models are fitted one by one, with the counts as weights.
    """
    if model == "linear" and task == "regression":
        scores = _linear_replicates(df, key, target, features, replicates, share, seed)
        return _interval(scores, ["r2"])
    name = "r2" if task == "regression" else "accuracy"
    found = []
    for i in range(replicates):
        drawn = df.withColumn("u_", draw(key, seed, i)).withColumn("times_", _poisson_times(F.col("u_"), share).cast("double")).drop("u_").persist()
        fitted = models.train(drawn.where("times_ > 0"), target, features, model, task, weightCol="times_", **options)
        unseen = fitted.transform(drawn.where("times_ = 0"))
        label = f"{target}_at_" if f"{target}_at_" in unseen.columns else target
        found.append((score(unseen, label, task)[name],))
        drawn.unpersist()
    return _interval(df.sparkSession.createDataFrame(found, f"{name} double"), [name])


def _linear_replicates(df: DataFrame, key: str, target: str, features: list[str], replicates: int, share: float, seed: int) -> DataFrame:
    k = len(features)
    full = df.select(key, *(F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate([*features, target]))).na.drop(subset=[f"v{i}" for i in range(k + 1)])
    means = full.agg(*(F.avg(f"v{i}") for i in range(k + 1))).first()
    if means[0] is None:
        raise ModelTrainingError("no complete rows")
    x = [F.lit(1.0), *(F.col(f"v{i}") - means[i] for i in range(k))]
    y = F.col(f"v{k}") - means[k]
    spread = full.select(key, *(v.alias(f"x{i}") for i, v in enumerate(x)), y.alias("y")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    spread = spread.withColumn("u", draw(key, seed, F.col("i"))).withColumn("w", _poisson_times(F.col("u"), share))
    cell = lambda i, j: F.col(f"x{i}") * F.col(f"x{j}")
    sums = spread.where("w > 0").groupBy("i").agg(
        *(F.sum(F.col("w") * cell(i, j)).alias(f"a{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)),
        *(F.sum(F.col("w") * F.col(f"x{i}") * F.col("y")).alias(f"b{i}") for i in range(k + 1)),
    )
    fitted = []
    for r in sums.collect():
        a = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])
        beta = np.linalg.lstsq(a, np.array([r[f"b{i}"] for i in range(k + 1)]), rcond=None)[0]
        fitted.append((r["i"], [float(v) for v in beta]))
    betas = df.sparkSession.createDataFrame(fitted, "i int, beta array<double>")
    guess = sum((F.get("beta", F.lit(j)) * F.col(f"x{j}") for j in range(k + 1)), F.lit(0.0))
    unseen = spread.where("w = 0").join(F.broadcast(betas), "i").select("i", "y", (F.col("y") - guess).alias("e"))
    return unseen.groupBy("i").agg((1 - F.avg(F.col("e") ** 2) / F.var_pop("y")).alias("r2"))


Space = Callable[[random.Random], dict]


def default_space(rng: random.Random) -> dict:
    """Rounds 50 to 300, depth 3 to 12, step 0.01 to 0.3 on a log scale."""
    return {"maxIter": rng.randint(50, 300), "maxDepth": rng.randint(3, 12), "stepSize": 10 ** rng.uniform(-2, math.log10(0.3))}


def random_search(df: DataFrame, key: str, target: str, features: list[str], model: str, task: str = "regression", trials: int = 10, space: Space = default_space, seed: int = 42) -> dict:
    """Best of seeded random settings on a hash hold-out of a fifth: settings, score and all trials."""
    rng, (name, more) = random.Random(seed), main_metric(task)
    parts = clean.split(df, key).persist()
    found = []
    for _ in range(trials):
        options = space(rng)
        fitted = models.train(parts.where("not is_test"), target, features, model, task, **options)
        found.append((score(fitted.transform(parts.where("is_test")), target, task)[name], options))
    parts.unpersist()
    best = (max if more else min)(found, key=lambda r: r[0])
    return {"metric": name, "score": best[0], "options": best[1], "trials": found}


#: What ``tpe_search`` looks through: low and high end of each setting, and whether it is whole or logarithmic.
DEFAULT_RANGES = {"maxIter": (50, 300, "int"), "maxDepth": (3, 12, "int"), "stepSize": (0.01, 0.3, "log")}


def _parzen(rng: random.Random, found: list[tuple[float, dict]], ranges: dict, more: bool, gamma: float, tries: int) -> dict:
    """The likeliest of some settings drawn around the better trials, against the others (Parzen estimators)."""
    ranked = sorted(found, key=lambda r: r[0], reverse=more)
    cut = max(1, math.ceil(gamma * len(ranked)))
    good, rest = [o for _, o in ranked[:cut]], [o for _, o in ranked[cut:]]
    out = {}
    for name, (low, high, kind) in ranges.items():
        to, back = (math.log, math.exp) if kind == "log" else (float, float)
        a, b = to(low), to(high)
        width = (b - a) / max(2, len(good)) or 1.0
        near = lambda v, points: sum(math.exp(-(((v - to(o[name])) / width) ** 2) / 2) for o in points) / max(1, len(points)) + 1e-3  # noqa: B023, E731
        drawn = [min(b, max(a, rng.gauss(to(rng.choice(good)[name]), width))) for _ in range(tries)]
        best = max(drawn, key=lambda v: near(v, good) / near(v, rest))
        out[name] = round(back(best)) if kind == "int" else back(best)
    return out


def tpe_search(
    df: DataFrame, key: str, target: str, features: list[str], model: str, task: str = "regression", trials: int = 20,
    ranges: dict[str, tuple[float, float, str]] = DEFAULT_RANGES, startup: int = 8, gamma: float = 0.25, seed: int = 42,
) -> dict:
    """Best settings on a hold-out of a fifth, by tree-structured Parzen estimators of each setting by itself.

    The first ``startup`` trials are random; each later one is drawn where the better share ``gamma`` of
    the trials so far is dense and the rest is not.
    """
    rng, (name, more) = random.Random(seed), main_metric(task)
    parts = clean.split(df, key, by=target if task == "classification" else None).persist()
    found: list[tuple[float, dict]] = []
    for i in range(trials):
        if i < startup:
            options = {}
            for n, (low, high, kind) in ranges.items():
                v = math.exp(rng.uniform(math.log(low), math.log(high))) if kind == "log" else rng.uniform(low, high)
                options[n] = round(v) if kind == "int" else v
        else:
            options = _parzen(rng, found, ranges, more, gamma, 24)
        fitted = models.train(parts.where("not is_test"), target, features, model, task, **options)
        scored = fitted.transform(parts.where("is_test"))
        label = f"{target}_at_" if f"{target}_at_" in scored.columns else target
        found.append((score(scored, label, task)[name], options))
    parts.unpersist()
    best = (max if more else min)(found, key=lambda r: r[0])
    return {"metric": name, "score": best[0], "options": best[1], "trials": found}


def halving(df: DataFrame, key: str, target: str, features: list[str], model: str, candidates: list[dict], task: str = "regression", factor: int = 3) -> dict:
    """Successive halving: each round keeps the best third on three times the rows."""
    name, more = main_metric(task)
    rounds = max(1, math.ceil(math.log(len(candidates), factor))) if len(candidates) > 1 else 1
    left, history = list(candidates), []
    for r in range(rounds):
        share = factor ** (r - rounds + 1)
        part = clean.split(df.where(draw(key, 7) < share), key).persist()
        scored = []
        for options in left:
            fitted = models.train(part.where("not is_test"), target, features, model, task, **options)
            scored.append((score(fitted.transform(part.where("is_test")), target, task)[name], options))
        part.unpersist()
        scored.sort(key=lambda s: s[0], reverse=more)
        history.append(len(left))
        left = [options for _, options in scored[: max(1, math.ceil(len(scored) / factor))]]
    return {"options": left[0], "score": scored[0][0], "rounds": history}


def _out_of_fold(df: DataFrame, key: str, target: str, features: list[str], names: list[str], k: int) -> DataFrame:
    folded = clean.folds(df, key, k).persist()
    parts = []
    for fold in range(k):
        test = folded.where(F.col("fold") == fold)
        for i, name in enumerate(names):
            fitted = models.train(folded.where(F.col("fold") != fold), target, features, name)
            test = fitted.transform(test).select(*test.columns, F.col("prediction").alias(f"p{i}_"))
        parts.append(test)
    oof = keep(reduce(DataFrame.unionByName, parts))
    oof.count()
    folded.unpersist()
    return oof


def meta_model(df: DataFrame, key: str, target: str, features: list[str], names: list[str], k: int = 5) -> models.Linear:
    """The linear model over out-of-fold predictions ``p0_..`` of the named regressors."""
    return models.linear_regression(_out_of_fold(df, key, target, features, names, k), target, [f"p{i}_" for i in range(len(names))])


def stacked(df: DataFrame, key: str, target: str, features: list[str], names: list[str], k: int = 5) -> DataFrame:
    """``df`` with ``prediction`` of a linear model over out-of-fold predictions of the named regressors."""
    oof = _out_of_fold(df, key, target, features, names, k)
    meta = models.linear_regression(oof, target, [f"p{i}_" for i in range(len(names))])
    return meta.predict(oof).drop("fold", *(f"p{i}_" for i in range(len(names))))


def _numbered(frame: DataFrame, key) -> DataFrame:
    """``at_``: the row's number in the order of the key, without bringing all rows to one task."""
    rows = frame.orderBy(key).rdd.zipWithIndex().map(lambda t: (*t[0], t[1]))
    return frame.sparkSession.createDataFrame(rows, T.StructType([*frame.schema.fields, T.StructField("at_", T.LongType())]))


def _binomial_tail(hits: int, n: int, p: float = 0.5) -> float:
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(hits, n + 1))


def _discoveries(p: np.ndarray, alpha: float) -> np.ndarray:
    """Which tests Benjamini and Hochberg reject."""
    order = np.argsort(p, kind="stable")
    passed = np.flatnonzero(p[order] <= alpha * np.arange(1, len(p) + 1) / len(p))
    out = np.zeros(len(p), bool)
    if len(passed):
        out[order[: passed[-1] + 1]] = True
    return out


def _shadows(numbered: DataFrame, features: list[str], n: int, rng: random.Random) -> DataFrame:
    """``at_`` and a copy of each feature whose values are dealt to other rows.

    Row i's value goes to row (a * i + b) mod n with a prime to n: a permutation of its own for each
    feature, all of them in one exchange.
    """
    moved = []
    for i, c in enumerate(features):
        a = rng.randrange(1, n) if n > 1 else 1
        while math.gcd(a, n) != 1:
            a = rng.randrange(1, n)
        to = F.pmod(F.col("at_").cast("decimal(38,0)") * a + rng.randrange(n), F.lit(n)).cast("long")
        moved.append(F.struct(to.alias("to"), F.lit(i).alias("f"), F.col(c).alias("v")))
    dealt = numbered.select(F.inline(F.array(*moved)))
    return dealt.groupBy(F.col("to").alias("at_")).agg(*(F.max(F.when(F.col("f") == i, F.col("v"))).alias(f"shadow{i}_") for i in range(len(features))))


def boruta(
    df: DataFrame, target: str, features: list[str], rounds: int = 20, task: str = "regression", alpha: float = 0.05, seed: int = 42,
    percentile: float = 100, two_step: bool = True, trees: int = 20,
) -> DataFrame:
    """``feature, decision, rank, hits, importance`` of numeric features, against shuffled shadows of them.

    Each round a forest sees the features not rejected yet and at least five shadows; a feature whose
    importance beats the ``percentile`` of the shadows' scores a hit. Hits are tested against a fair
    coin both ways: in two steps, by the false discovery rate over features and by Bonferroni over
    rounds; else by Bonferroni over features. Decisions: ``confirmed``, ``rejected``, ``tentative``, or
    ``weak`` for tentative ones whose median importance beats the shadows' median. Confirmed ones
    rank 1, undecided ones 2, rejected ones behind by their median rank of importance; ``importance``
    is the median over rounds. Rows with a null are left out.
    """
    base = df.select(*(F.col(c).cast("double").alias(c) for c in features), F.col(target)).na.drop()
    numbered = _numbered(base.withColumn("row_", F.monotonically_increasing_id()), F.col("row_")).drop("row_").persist()
    n = numbered.count()
    if not n:
        raise ModelTrainingError("no complete rows")
    name = "random_forest_regressor" if task == "regression" else "random_forest_classifier"
    m, rng = len(features), random.Random(seed)
    decided, hits = np.zeros(m, int), np.zeros(m, int)
    history, best = np.full((rounds, m), np.nan), []
    for r in range(rounds):
        active = np.flatnonzero(decided >= 0)
        if not (decided == 0).any():
            break
        shadowed = [features[i] for i in active]
        while len(shadowed) < 5:
            shadowed += shadowed
        wide = numbered.join(_shadows(numbered, shadowed, n, rng), "at_").persist()
        columns = [*(features[i] for i in active), *(f"shadow{i}_" for i in range(len(shadowed)))]
        fitted = models.train(wide, target, columns, name, task, numTrees=trees)
        wide.unpersist()
        found = fitted.stages[-1].featureImportances.toArray()
        history[r, active] = found[: len(active)]
        best.append(float(np.percentile(found[len(active) :], percentile)))
        hits[active] += found[: len(active)] > best[-1]
        up = np.array([_binomial_tail(int(h), r + 1) for h in hits[active]])
        down = np.array([_binomial_tail(r + 1 - int(h), r + 1) for h in hits[active]])
        if two_step:
            accept = _discoveries(up, alpha) & (up <= alpha / (r + 1))
            reject = _discoveries(down, alpha) & (down <= alpha / (r + 1))
        else:
            accept, reject = up <= alpha / m, down <= alpha / m
        free = decided[active] == 0
        decided[active[free & accept]] = 1
        decided[active[free & reject]] = -1
    numbered.unpersist()
    middle = np.array([np.nanmedian(history[:, i]) if np.isfinite(history[:, i]).any() else 0.0 for i in range(m)])
    gone = np.flatnonzero(decided < 0)
    places = np.array([[1 + (row[gone] > v).sum() if np.isfinite(v) else np.nan for v in row[gone]] for row in history if np.isfinite(row[gone]).any()])
    order = np.nanmedian(places, axis=0) if len(places) else np.zeros(len(gone))
    first = 3 if (decided == 0).any() else 2
    ranks = {int(i): first + int((order < o).sum()) for i, o in zip(gone, order)}
    rows = []
    for i, c in enumerate(features):
        weak = bool(best) and middle[i] > np.median(best)
        decision = "confirmed" if decided[i] > 0 else "rejected" if decided[i] < 0 else "weak" if weak else "tentative"
        rows.append((c, decision, 1 if decided[i] > 0 else ranks.get(i, 2), int(hits[i]), float(middle[i])))
    return df.sparkSession.createDataFrame(rows, "feature string, decision string, rank int, hits int, importance double")


def permutation_importance(df: DataFrame, fitted, target: str, features: list[str], task: str = "regression", seed: int = 42) -> dict[str, float]:
    """How much worse the main metric gets when a feature's values are exchanged between rows.

    Values move to the next row in a hashed order by a join on row numbers; numbers come from one
    sort each.
    """
    name, more = main_metric(task)
    base = score(fitted.transform(df), target, task)[name]
    out = {}
    rows = df.withColumn("row_", F.monotonically_increasing_id()).persist()
    for c in features:
        moved = _numbered(rows.select(c, "row_"), F.xxhash64("row_", F.lit(f"{seed}-{c}"))).select("at_", c)
        changed = _numbered(rows.drop(c), F.col("row_")).join(moved, "at_")
        value = score(fitted.transform(changed), target, task)[name]
        out[c] = base - value if more else value - base
    rows.unpersist()
    return out

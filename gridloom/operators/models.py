"""Models: closed forms in SQL, selection rules, and MLlib estimators behind one factory."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as mc
from pyspark.ml import clustering as mk
from pyspark.ml import regression as mr
from pyspark.ml.feature import OneHotEncoder, QuantileDiscretizer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.errors import ModelTrainingError, NotSupported
from gridloom.functions.joins import join_groups
from gridloom.functions.neighbours import nearest_rows
from gridloom.roles import ColumnRoles, require


@dataclass(frozen=True)
class Linear:
    """Least squares: intercept, coefficients by column and the columns' means."""

    intercept: float
    coefficients: dict[str, float]
    means: dict[str, float]

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        y = sum((F.lit(b) * F.col(c) for c, b in self.coefficients.items()), F.lit(self.intercept))
        return df.withColumn(name, y)

    def shap(self, df: DataFrame) -> DataFrame:
        """``shap_{c}``: exact Shapley values of a linear model, beta * (x - mean)."""
        return df.select("*", *(((F.col(c) - F.lit(self.means[c])) * F.lit(b)).alias(f"shap_{c}") for c, b in self.coefficients.items()))

    def importance(self, df: DataFrame) -> DataFrame:
        """``feature, importance``: mean absolute Shapley value."""
        cols = list(self.coefficients)
        one = self.shap(df).agg(*(F.avg(F.abs(f"shap_{c}")).alias(c) for c in cols))
        return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("importance")) for c in cols))))


def linear_regression(df: DataFrame, target: str, features: list[str], ridge: float = 0.0) -> Linear:
    """Normal equations from one aggregation of centred moments; ``ridge`` is added to their diagonal."""
    require(df, target, *features)
    cols = [*features, target]
    x = [F.col(c).cast("double") for c in cols]
    full = df.where(" and ".join(f"`{c}` is not null" for c in cols))
    aggs = [F.count("*").alias("n"), *(F.avg(v).alias(f"m{i}") for i, v in enumerate(x))]
    aggs += [F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]
    one = full.agg(*aggs).first()
    n, k = one["n"], len(features)
    if n <= k:
        raise ModelTrainingError(f"{n} complete rows for {k} coefficients")
    cov = np.array([[one[f"c{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])
    beta = np.linalg.lstsq(cov[:k, :k] * n + ridge * np.eye(k), cov[:k, k] * n, rcond=None)[0]
    means = {c: one[f"m{i}"] for i, c in enumerate(features)}
    intercept = one[f"m{k}"] - sum(b * means[c] for b, c in zip(beta, features))
    return Linear(float(intercept), dict(zip(features, map(float, beta))), means)


def gaussian_nb(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """``label, prior, mean_{c}, var_{c}``: the parameters of Gaussian naive Bayes.

    Variances are the population's, and 1e-9 of the largest over all features is added to each.
    """
    require(df, label, *features)
    stats = df.groupBy(F.col(label).alias("label")).agg(
        F.count("*").alias("n_"), *(f(F.col(c).cast("double")).alias(f"{p}_{c}") for c in features for p, f in (("mean", F.avg), ("var", F.var_pop)))
    )
    whole = df.agg(F.count("*").alias("total_"), F.greatest(*(F.var_pop(F.col(c).cast("double")) for c in features), F.lit(0.0)).alias("eps_"))
    wide = stats.join(F.broadcast(whole), F.lit(True))
    return wide.select(
        "label", (F.col("n_") / F.col("total_")).alias("prior"), *(F.col(f"mean_{c}") for c in features), *((F.col(f"var_{c}") + 1e-9 * F.col("eps_")).alias(f"var_{c}") for c in features)
    )


#: Classes whose parameters are sent to every task; more are joined without a hint.
SENT_CLASSES = 10_000


def gaussian_nb_predict(df: DataFrame, params: DataFrame, key: str, features: list[str]) -> DataFrame:
    """``key, prediction``: the likeliest label; up to ``SENT_CLASSES`` go to every task."""
    ll = F.log("prior")
    for c in features:
        ll = ll - 0.5 * F.log(6.283185307179586 * F.col(f"var_{c}")) - (F.col(c) - F.col(f"mean_{c}")) ** 2 / (2 * F.col(f"var_{c}"))
    params = F.broadcast(params) if params.limit(SENT_CLASSES + 1).count() <= SENT_CLASSES else params
    scored = df.select(key, *features).join(params, F.lit(True)).select(key, "label", ll.alias("ll"))
    return scored.groupBy(key).agg(F.max_by("label", F.struct("ll", "label")).alias("prediction"))


def sample_weights(df: DataFrame, label: str) -> DataFrame:
    """``weight``: inverse frequency of the label, scaled to a mean of one; rows without a label are a class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n_"))
    whole = counts.agg(F.sum("n_").alias("t_"), F.count("*").alias("k_"))
    sized = counts.join(F.broadcast(whole), F.lit(True)).select(label, (F.col("t_") / (F.col("k_") * F.col("n_"))).alias("weight"))
    return join_groups(df, sized, label)


def nearest_neighbours(train: DataFrame, df: DataFrame, key: str, label: str, features: list[str], k: int = 5) -> DataFrame:
    """``key, prediction``: the label that most of a row's k nearest rows of ``train`` have, the least among equals.

    Distances are Euclidean, ties broken by key; neighbours come from ``nearest_rows``, which looks only
    at boxes of points near a row. Rows with a null feature, and unlabelled rows of ``train``, are left out.
    """
    require(train, key, label, *features)
    require(df, key, *features)
    x = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)]
    known = train.select(F.col(key).alias("id"), F.col(label).cast("string").alias("label"), *x).na.drop()
    asked = df.select(F.col(key).alias("id"), *x).na.drop()
    votes = nearest_rows(asked, known, k).groupBy(F.col("id_").alias("id"), "label").agg(F.count("*").alias("n"))
    winner = F.min_by("label", F.struct((-F.col("n")).alias("n"), "label"))
    return votes.groupBy("id").agg(winner.cast(train.schema[label].dataType).alias("prediction")).withColumnRenamed("id", key)


def support_vector_regression(df: DataFrame, target: str, features: list[str], epsilon: float = 0.1, penalty: float = 1e-3, rounds: int = 25) -> Linear:
    """A linear model of least epsilon-insensitive error, features and target standardised.

    Reweighted least squares: rows within ``epsilon`` deviations of the line count nothing, others by
    the inverse of how far they lie beyond it; each round is one aggregation of weighted moments.
    """
    require(df, target, *features)
    cols = [*features, target]
    full = df.where(" and ".join(f"`{c}` is not null" for c in cols)).select(*(F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols))).persist()
    k = len(features)
    stats = full.agg(*(f(f"v{i}") for i in range(k + 1) for f in (F.avg, F.stddev_pop))).first()
    means, spreads = [stats[2 * i] for i in range(k + 1)], [stats[2 * i + 1] or 1.0 for i in range(k + 1)]
    if means[0] is None:
        raise ModelTrainingError("no complete rows")
    z = [(F.col(f"v{i}") - means[i]) / spreads[i] for i in range(k + 1)]
    x, y, beta = [F.lit(1.0), *z[:k]], z[k], np.zeros(k + 1)
    for r in range(rounds):
        gap = y - sum((F.lit(float(b)) * v for b, v in zip(beta, x)), F.lit(0.0))
        beyond = F.abs(gap) - epsilon
        w = F.when(F.lit(r == 0), 1.0).when(beyond > 0, 1 / F.greatest(beyond, F.lit(1e-3))).otherwise(0.0)
        goal = y if r == 0 else y - F.signum(gap) * epsilon
        one = full.select(w.alias("w"), goal.alias("g"), *(v.alias(f"x{i}") for i, v in enumerate(x))).agg(
            *(F.sum(F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"a{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)),
            *(F.sum(F.col("w") * F.col(f"x{i}") * F.col("g")).alias(f"b{i}") for i in range(k + 1)),
            F.sum("w").alias("w"),
        ).first()
        if not one["w"]:
            break
        a = np.array([[one[f"a{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])
        b = np.array([one[f"b{i}"] for i in range(k + 1)])
        new = np.linalg.lstsq(a + penalty * np.diag([0.0, *[1.0] * k]), b, rcond=None)[0]
        done, beta = np.abs(new - beta).max() < 1e-6, new
        if done:
            break
    full.unpersist()
    slopes = [float(beta[i + 1] * spreads[k] / spreads[i]) for i in range(k)]
    intercept = means[k] + beta[0] * spreads[k] - sum(s * m for s, m in zip(slopes, means))
    return Linear(float(intercept), dict(zip(features, slopes)), dict(zip(features, means)))


#: Other names of the objectives.
OBJECTIVES = {
    "numerical_prediction": "regression", "categorical_known": "classification", "categorical_unknown": "clustering",
    "numerical_study": "study", "multi_numerical_prediction": "several",
}


def choose_model(objective: str, rows: int = 0, **facts) -> str:
    """The model suited to an objective, a number of rows and what is known of the data.

    Regression: under 1000 rows least squares; then, with numeric features only, ridge if all of them
    matter, else the elastic net, and from 100 000 rows on gradient descent; with other features
    boosted trees. Classification: of images nothing here; with categorical features only, the
    logistic model for under five of them, else naive Bayes; with mixed ones naive Bayes for under 300
    rows a class, else a forest. Clustering: k-means if the number of clusters is known, else mean
    shift. A study: principal components, unless of places or of a series; several targets at once
    and those are refused. Facts: ``numeric_only, all_features_matter, data_type, exogenous_type,
    n_features, rows_per_class, known_clusters, n_clusters, geospatial, time_series``.
    """
    kind = OBJECTIVES.get(objective, objective)
    if kind == "regression":
        if rows < 1000:
            return "linear"
        if not facts.get("numeric_only", False):
            return "gbt_regressor"
        if rows >= 100_000:
            return "sgd_regressor"
        return "ridge" if facts.get("all_features_matter") else "elastic_net"
    if kind == "classification":
        if facts.get("data_type") == "images":
            raise NotSupported("images: needs pretrained image models")
        if facts.get("exogenous_type") == "categorical":
            return "psychometric" if facts.get("n_features", 0) < 5 else "naive_bayes"
        return "random_forest_classifier" if facts.get("rows_per_class", 0) >= 300 else "naive_bayes"
    if kind == "clustering":
        return "kmeans" if facts.get("n_clusters") or facts.get("known_clusters") else "mean_shift"
    if kind == "study" and not facts.get("geospatial") and not facts.get("time_series"):
        return "pca"
    raise NotSupported(f"no model for {objective!r}" + "".join(f", {k}" for k in ("geospatial", "time_series") if facts.get(k)))


FACTORY = {
    "linear": lambda **o: mr.LinearRegression(regParam=0.0, **o),
    "ridge": lambda **o: mr.LinearRegression(elasticNetParam=0.0, regParam=o.pop("regParam", 1e-3), **o),
    "elastic_net": lambda **o: mr.LinearRegression(elasticNetParam=0.5, regParam=o.pop("regParam", 1.0), **o),
    "sgd_regressor": lambda **o: mr.LinearRegression(solver="l-bfgs", **o),
    "tree_regressor": lambda **o: mr.DecisionTreeRegressor(seed=42, **o),
    # The library's 32 bins a column are too coarse for columns of many values; it takes no more bins than rows.
    "gbt_regressor": lambda **o: mr.GBTRegressor(seed=42, maxIter=o.pop("maxIter", 20), maxBins=o.pop("maxBins", 1024), **o),
    "random_forest_regressor": lambda **o: mr.RandomForestRegressor(seed=42, **o),
    "naive_bayes": lambda **o: mc.NaiveBayes(modelType="gaussian", **o),
    "tree_classifier": lambda **o: mc.DecisionTreeClassifier(seed=42, **o),
    "logistic": lambda **o: mc.LogisticRegression(**o),
    "psychometric": lambda **o: mc.LogisticRegression(**o),
    "sgd_classifier": lambda **o: mc.LogisticRegression(regParam=o.pop("regParam", 1e-4), **o),
    "mlp_classifier": lambda **o: mc.MultilayerPerceptronClassifier(seed=42, **o),
    "svc": lambda **o: mc.OneVsRest(classifier=mc.LinearSVC(**o)),
    "gbt_classifier": lambda **o: mc.GBTClassifier(seed=42, maxIter=o.pop("maxIter", 20), **o),
    "random_forest_classifier": lambda **o: mc.RandomForestClassifier(seed=42, **o),
    "kmeans": lambda **o: mk.KMeans(seed=42, **o),
    "bisecting_kmeans": lambda **o: mk.BisectingKMeans(seed=42, **o),
    "gaussian_mixture": lambda **o: mk.GaussianMixture(seed=42, **o),
}


def estimator(name: str, **options):
    if name not in FACTORY:
        raise NotSupported(f"unknown model {name!r}; known: {sorted(FACTORY)}")
    return FACTORY[name](**options)


#: Rows of one of the ranges whose mean targets boosted regression trees see, and values of the columns that get them.
LOCAL_ROWS, LOCAL_VALUES = 64, 1024


def local_means(df: DataFrame, target: str, columns: list[str], weights: str | None = None) -> tuple[list, list[str]]:
    """Fitted stages that add ``{c}_local_``, the mean target of a row's range of ``c``, and the names of these.

    Trees split greedily, so of a target that rises and falls many times along a column they find next
    to nothing, more bins or not. Ranges hold about ``LOCAL_ROWS`` rows each, so their number grows with
    the rows. A column of over ``LOCAL_VALUES`` values gets them if the mean of the other rows of a
    row's range says more of its target than the mean of all rows does. The means are coefficients of
    a linear model of the ranges, so that the stages are Spark's own and can be stored.
    """
    stages, names = [], []
    counts = df.agg(*(F.approx_count_distinct(c) for c in columns)).first() if columns else ()
    for c, values in zip(columns, counts):
        if values <= LOCAL_VALUES:
            continue
        known = df.select(c, F.col(target).cast("double").alias(target), *([weights] if weights else [])).where(F.col(c).isNotNull() & F.col(target).isNotNull())
        ranges = max(2, known.count() // LOCAL_ROWS)
        cut = QuantileDiscretizer(inputCol=c, outputCol=f"{c}_range_", numBuckets=ranges, relativeError=0.25 / ranges, handleInvalid="skip").fit(known)
        ranged = cut.transform(known).groupBy(f"{c}_range_").agg(F.count("*").alias("n"), F.avg(target).alias("m"), F.var_pop(target).alias("v"))
        # a row's distance from the mean of its range's others is n / (n - 1) times that from the mean of all of them
        others = F.when(F.col("n") > 1, F.col("n") * F.col("v") * (F.col("n") / (F.col("n") - 1)) ** 2)
        whole = known.agg(F.avg(target).alias("whole"))
        alone = (F.col("m") - F.col("whole")) ** 2
        left = ranged.join(F.broadcast(whole), F.lit(True)).agg(F.sum(F.coalesce(others, alone)).alias("near"), F.sum(F.col("n") * (F.col("v") + alone)).alias("all")).first()
        if not left["near"] < left["all"]:
            continue
        hot = OneHotEncoder(inputCol=f"{c}_range_", outputCol=f"{c}_ranged_", dropLast=False).fit(cut.transform(known))
        line = mr.LinearRegression(featuresCol=f"{c}_ranged_", labelCol=target, predictionCol=f"{c}_local_", solver="l-bfgs", **({"weightCol": weights} if weights else {}))
        stages += [cut, hot, line.fit(hot.transform(cut.transform(known)))]
        names.append(f"{c}_local_")
    return stages, names


def prepare(df: DataFrame, features: list[str], scale: bool = True, made: list[str] | None = None) -> list:
    """Stages that make a vector ``features`` of numbers, and of texts one-hot; unseen texts are a kind of their own.

    ``made`` names numbers that earlier stages add.
    """
    roles = ColumnRoles.of(df)
    numeric = [c for c in features if c in roles.numeric]
    text = [c for c in features if c in roles.text]
    stages: list = []
    if text:
        stages.append(StringIndexer(inputCols=text, outputCols=[f"{c}_at_" for c in text], handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=[f"{c}_at_" for c in text], outputCols=[f"{c}_hot_" for c in text], handleInvalid="keep"))
    stages.append(VectorAssembler(inputCols=[*numeric, *(made or []), *(f"{c}_hot_" for c in text)], outputCol="raw_" if scale else "features", handleInvalid="skip"))
    if scale:
        stages.append(StandardScaler(inputCol="raw_", outputCol="features", withMean=True))
    return stages


def train(df: DataFrame, target: str, features: list[str], model: str, task: str = "regression", **options) -> PipelineModel:
    """The whole pipeline, from raw columns to ``prediction``; text targets are indexed.

    ``early_stopping`` ends boosted trees once a fifth of the rows, by their features' hash, gains no more.
    Boosted regression trees also see the ``local_means`` of numeric columns.
    """
    require(df, target, *features)
    df = df.where(F.col(target).isNotNull())
    if options.pop("early_stopping", False):
        if not model.startswith("gbt"):
            raise NotSupported("early stopping is of boosted trees")
        df = df.withColumn("validate_", F.pmod(F.xxhash64(*features), F.lit(5)) == 0)
        options["validationIndicatorCol"] = "validate_"
    local, made = [], []
    if model == "gbt_regressor":
        seen = df.where("not validate_") if "validationIndicatorCol" in options else df
        local, made = local_means(seen, target, [c for c in features if c in ColumnRoles.of(df).numeric], options.get("weightCol"))
    stages = [*local, *prepare(df, features, not model.startswith(("naive", "tree", "gbt", "random")), made)]
    label = target
    if task == "classification" and target in ColumnRoles.of(df).text:
        label = f"{target}_at_"
        stages.insert(0, StringIndexer(inputCol=target, outputCol=label, handleInvalid="keep"))
    if model == "mlp_classifier" and "layers" not in options:
        ready = Pipeline(stages=stages).fit(df).transform(df.limit(1)).first()
        classes = df.agg(F.max(F.col(target).cast("double"))).first()[0] if label == target else df.select(target).distinct().count()
        options["layers"] = [len(ready["features"]), 16, int(classes) + 1]
    return Pipeline(stages=[*stages, estimator(model, labelCol=label, **options)]).fit(df)


def cluster(df: DataFrame, features: list[str], k: int = 5, method: str = "kmeans") -> DataFrame:
    """``df`` with ``cluster``; rows with a null feature are left out."""
    require(df, *features)
    ready = Pipeline(stages=prepare(df, features)).fit(df).transform(df)
    vectors = ready.select("features").persist()
    fitted = estimator(method, k=k, predictionCol="cluster").fit(vectors)
    vectors.unpersist()
    return fitted.transform(ready).select(*df.columns, "cluster")


def soft_vote(df: DataFrame, probabilities: list[str]) -> DataFrame:
    """``probability, prediction``: the mean of several models' probabilities of class 1."""
    p = sum((F.col(c) for c in probabilities), F.lit(0.0)) / len(probabilities)
    return df.withColumn("probability", p).withColumn("prediction", (F.col("probability") >= 0.5).cast("int"))


def bh_reject(df: DataFrame, p: str, alpha: float = 0.05) -> DataFrame:
    """``rank, rejected``: Benjamini-Hochberg over all rows, which are tests of one family and few."""
    w = Window.partitionBy().orderBy(p)
    whole = Window.partitionBy()
    ranked = df.withColumn("rank", F.row_number().over(w)).withColumn("tests_", F.count("*").over(whole))
    passed = F.when(F.col(p) <= F.col("rank") / F.col("tests_") * alpha, F.col("rank"))
    return ranked.withColumn("rejected", F.col("rank") <= F.coalesce(F.max(passed).over(whole), F.lit(0))).drop("tests_")


def phi_pairs(df: DataFrame, flags: list[str]) -> DataFrame:
    """``left, right, phi`` of each pair of boolean columns, from one aggregation; null where undefined."""
    pairs = [(a, b) for i, a in enumerate(flags) for b in flags[i + 1 :]]
    count = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
    aggs = []
    for i, (a, b) in enumerate(pairs):
        x, y = F.col(a), F.col(b)
        aggs += [count(x & y).alias(f"a{i}"), count(x & ~y).alias(f"b{i}"), count(~x & y).alias(f"c{i}"), count(~x & ~y).alias(f"d{i}")]
    one = df.agg(*aggs)
    rows = []
    for i, (left, right) in enumerate(pairs):
        a, b, c, d = (F.col(f"{n}{i}") for n in "abcd")
        phi = F.try_divide(a * d - b * c, F.sqrt((a + b) * (c + d) * (a + c) * (b + d)))
        rows.append(F.struct(F.lit(left).alias("left"), F.lit(right).alias("right"), phi.alias("phi")))
    return one.select(F.inline(F.array(*rows)))


def grid_size(grid: dict[str, list], folds: int = 5, seconds: float = 1.0) -> tuple[int, float]:
    """Combinations of a grid, and the seconds that fitting them takes."""
    n = 1
    for values in grid.values():
        n *= len(values)
    return n, n * folds * seconds


def stop_round(scores: list[float], step: int = 10, patience: int = 20) -> int:
    """The round after which early stopping ends: patience // step rounds without a better score."""
    best, worse = float("-inf"), 0
    for i, score in enumerate(scores):
        best, worse = (score, 0) if score > best else (best, worse + 1)
        if worse >= max(1, patience // step):
            return i
    return len(scores) - 1

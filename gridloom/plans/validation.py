"""Splits, resamples, neighbours, choices and sources as queries; and what must hold of fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom import config
from gridloom.functions.draws import draw_sql
from gridloom.operators import anomaly, charts, clean, drift, explain, models, selection, text, tuning
from gridloom.operators import timeseries as ts
from gridloom.plans import chain, services
from gridloom.plans.analytics import _H, _UNIT, _WORDS, _hourly
from gridloom.plans.artifact import Artifact, compare, feature_schema, schema_table
from gridloom.plans.registry import query, read, rounded
from gridloom.plans.report import shade_column
from gridloom.roles import ColumnRoles
from gridloom.sources import files

# Splits and resamples: every number is drawn by md5 from the row's key.


@query(f"SELECT c_custkey, {draw_sql('c_custkey', "'split'", 42)} < 0.2 AS is_test FROM customer")
def split_rows(spark, sf_dir):
    return clean.split(read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")


@query(f"SELECT c_custkey FROM customer ORDER BY {draw_sql('c_custkey', "'sample'", 42)}, c_custkey LIMIT 50")
def sample_rows(spark, sf_dir):
    return clean.sample(read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 50)


def _times(u: str, mean: float) -> str:
    import math

    cuts, total = [], 0.0
    for k in range(12):
        total += math.exp(-mean) * mean**k / math.factorial(k)
        cuts.append(total)
    return " + ".join(f"({u} > {c!r}::DOUBLE)::INT" for c in cuts)


def _ends(name: str) -> str:
    return f"round(avg({name}), 6) AS mean, round(quantile_cont({name}, 0.025), 6) AS low, round(quantile_cont({name}, 0.975), 6) AS high"


@query(
    f"""WITH d AS (SELECT p_retailprice - p_size * 20.0::DOUBLE AS e, i, {draw_sql('p_partkey', 42, 'i')} AS u FROM part, range(0, 50) t(i)),
        w AS (SELECT *, {_times('u', 1.0)} AS w FROM d),
        r AS (SELECT i, sum(w * abs(e)) / sum(w) AS mae, sqrt(sum(w * e * e) / sum(w)) AS rmse FROM w WHERE w > 0 GROUP BY 1)
        SELECT 'mae' AS metric, {_ends('mae')} FROM r UNION ALL SELECT 'rmse', {_ends('rmse')} FROM r"""
)
def bootstrap_errors(spark, sf_dir):
    df = read(spark, sf_dir, "part").select("p_partkey", "p_retailprice", (F.col("p_size") * 20.0).alias("guess"))
    return rounded(tuning.bootstrap(df, "p_partkey", "p_retailprice", "guess", 50))


@query(
    f"""WITH d AS (SELECT p_size AS x, p_retailprice AS y, i, {draw_sql('p_partkey', 42, 'i')} AS u FROM part, range(0, 20) t(i)),
        w AS (SELECT *, {_times('u', 0.7)} AS w FROM d),
        m AS (SELECT i, sum(w) AS n, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM w GROUP BY 1),
        b AS (SELECT i, any_value(mx) AS mx, any_value(my) AS my, sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)) AS b FROM w JOIN m USING (i) GROUP BY 1),
        r AS (SELECT i, 1 - avg(pow(y - my - b * (x - mx), 2)) / var_pop(y) AS r2 FROM w JOIN b USING (i) WHERE w = 0 GROUP BY 1)
        SELECT 'r2' AS metric, {_ends('r2')} FROM r"""
)
def bootstrap_cv(spark, sf_dir):
    return rounded(tuning.bootstrap_cv(read(spark, sf_dir, "part"), "p_partkey", "p_retailprice", ["p_size"]))


@query(
    """WITH p AS (SELECT n_nationkey::DOUBLE AS x, n_regionkey::DOUBLE AS y FROM nation),
       s AS (SELECT avg(x) AS mx, avg(y) AS my, sum(pow(x - (SELECT avg(x) FROM p), 2)) AS sxx, regr_slope(y, x) AS b, count(*) AS n FROM p),
       e AS (SELECT (y - my - b * (x - mx)) / (1 - 1.0::DOUBLE / n - pow(x - mx, 2) / sxx) AS e FROM p, s)
       SELECT round(avg(e * e), 6) AS mse, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae FROM e"""
)
def leave_one_out(spark, sf_dir):
    found = tuning.leave_one_out(read(spark, sf_dir, "nation"), "n_regionkey", ["n_nationkey"])
    return rounded(spark.range(1).select(*(F.lit(v).alias(k) for k, v in found.items())))


@query(
    """WITH m AS (SELECT avg(p_size) AS mx, avg(p_retailprice) AS my, covar_pop(p_retailprice, p_size) * count(*) AS sxy, var_pop(p_size) * count(*) AS sxx FROM part)
       SELECT round(sxy / (sxx + 100), 6) AS slope, round(my - sxy / (sxx + 100) * mx, 6) AS intercept FROM m"""
)
def ridge_closed_form(spark, sf_dir):
    m = models.linear_regression(read(spark, sf_dir, "part"), "p_retailprice", ["p_size"], ridge=100.0)
    return rounded(spark.range(1).select(F.lit(m.coefficients["p_size"]).alias("slope"), F.lit(m.intercept).alias("intercept")))


# Neighbours, clusters, cuts.


@query(
    """WITH p AS (SELECT c_custkey, c_mktsegment, c_acctbal / 1000 AS x, c_nationkey::DOUBLE AS y FROM customer),
       d AS (SELECT a.c_custkey AS id, b.c_mktsegment AS label, row_number() OVER (PARTITION BY a.c_custkey ORDER BY pow(a.x - b.x, 2) + pow(a.y - b.y, 2), b.c_custkey) AS k
             FROM p a JOIN p b ON a.c_custkey % 10 = 0 AND b.c_custkey % 10 <> 0),
       v AS (SELECT id, label, count(*) AS n FROM d WHERE k <= 5 GROUP BY 1, 2)
       SELECT id AS c_custkey, arg_min(label, (-n)::VARCHAR || label) AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, label) AS r FROM v) WHERE r = 1 GROUP BY 1"""
)
def knn_predict(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", (F.col("c_acctbal") / 1000).alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    return models.nearest_neighbours(df.where("c_custkey % 10 <> 0"), df.where("c_custkey % 10 = 0"), "c_custkey", "c_mktsegment", ["x", "y"])


@query("SELECT event_type AS cluster, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1")
def cluster_sizes(spark, sf_dir):
    return rounded(selection.cluster_sizes(read(spark, sf_dir, "events"), "event_type"))


@query(
    """WITH p AS (SELECT c_nationkey % 3 AS c, c_acctbal AS x, c_nationkey::DOUBLE AS y FROM customer),
       m AS (SELECT c, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(x * x + y * y) AS q FROM p GROUP BY 1),
       d AS (SELECT p.c AS own, m.c AS c, p.x, p.y, n, x * x + y * y + q - 2 * (x * mx + y * my) AS d FROM p, m),
       s AS (SELECT own, x, y, max(d * n / (n - 1)) FILTER (WHERE c = own) AS a, min(d) FILTER (WHERE c <> own) AS b, count(*) / 3 AS w FROM d GROUP BY 1, 2, 3)
       SELECT round(sum(w * (b - a) / greatest(a, b)) / sum(w), 4) AS silhouette FROM s"""
)
def silhouette(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select((F.col("c_nationkey") % 3).alias("cluster"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    return rounded(spark.range(1).select(F.lit(float(selection.silhouette(df, ["x", "y"]))).alias("silhouette")), 4)


@query("SELECT l_orderkey, l_linenumber, l_extendedprice > (SELECT quantile_cont(l_extendedprice, 0.95) FROM lineitem) AS is_anomaly FROM lineitem")
def percentile_cut(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return anomaly.flag_top(df, "l_extendedprice", 0.05).drop("l_extendedprice")


@query(
    """WITH s AS (SELECT count(*) AS n, min(p_size) AS a, max(p_size) AS b, min(p_retailprice) AS c, max(p_retailprice) AS d,
                         stddev_samp(p_size) * pow(count(*), -1.0::DOUBLE / 6) AS h, stddev_samp(p_retailprice) * pow(count(*), -1.0::DOUBLE / 6) AS k FROM part),
       g AS (SELECT i::INT AS i, j::INT AS j, a + i * (b - a)::DOUBLE / 7 AS x, c + j * (d - c) / 7 AS y, n, h, k FROM s, range(0, 8) t(i), range(0, 8) u(j))
       SELECT i, j, round(x, 6) AS x, round(y, 6) AS y, round(1e6 * sum(exp(-(pow((x - p_size) / h, 2) + pow((y - p_retailprice) / k, 2)) / 2) / (n * h * k * 6.283185307179586)), 6) AS density
       FROM g, part GROUP BY i, j, x, y"""
)
def density_2d(spark, sf_dir):
    found = charts.density_2d(read(spark, sf_dir, "part"), "p_size", "p_retailprice", 8)
    return rounded(found.withColumn("density", F.col("density") * 1e6))


# Texts.


@query(
    f"""WITH w AS (SELECT item_id, {_WORDS} AS w FROM benchmark), c AS (SELECT item_id, w, count(*) AS n FROM w GROUP BY ALL),
        h AS (SELECT item_id, ('0x' || substr(md5(w), 1, 8))::UBIGINT AS h, n FROM c),
        p AS (SELECT item_id, (h % 32)::INT AS place, sum(CASE WHEN h >= 2147483648 THEN -1 ELSE 1 END * ln(1 + n)) AS v FROM h GROUP BY 1, 2)
        SELECT item_id, place, round(v / sqrt(sum(v * v) OVER (PARTITION BY item_id)), 6) AS value FROM p WHERE abs(v) > 1e-9"""
)
def hashed_embeddings(spark, sf_dir):
    found = text.hashed_embeddings(read(spark, sf_dir, "benchmark"), "item_id", "text", 32)
    return rounded(found.select("item_id", F.posexplode("embedding").alias("place", "value")).where("abs(value) > 1e-9"))


@query(
    f"""WITH {_UNIT}, x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
        m AS (SELECT label, i, avg(x) AS x FROM x GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY 1),
        s AS (SELECT v.vec_id, c.label, list_dot_product(u, c) / sqrt(list_dot_product(c, c)) AS f FROM v, c),
        r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY f DESC, label) AS k FROM s)
        SELECT vec_id, max(label) FILTER (WHERE k = 1) AS prediction, round(max(f) FILTER (WHERE k = 1), 5) AS confidence,
               string_agg(label::VARCHAR, ',' ORDER BY k) AS top_k_predictions FROM r WHERE k <= 3 GROUP BY 1"""
)
def predicted_labels(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    found = text.predict_labels(vectors, "vec_id", "embedding", text.label_centroids(vectors, "label", "embedding"))
    return rounded(found.select("vec_id", "prediction", "confidence", F.array_join(F.col("top_k_predictions").cast("array<string>"), ",").alias("top_k_predictions")), 5)


_STOPPED = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


@query(rf"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '' AND t NOT IN ({_STOPPED})), ' ') AS words FROM documents")
def normalised_texts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.normalise("text").alias("words"))


# Choices.

_CASES = [
    ("regression", 500, True, "linear"), ("regression", 1000, True, "elastic_net"), ("regression", 99_999, True, "elastic_net"), ("regression", 100_000, True, "sgd_regressor"),
    ("regression", 5000, False, "gbt_regressor"), ("regression", 500_000, False, "gbt_regressor"), ("classification", 5000, True, "naive_bayes"), ("study", 10, True, "pca"),
    ("clustering", 10, True, "mean_shift"), ("numerical_prediction", 999, False, "linear"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{o}', {n}, {'true' if num else 'false'}, '{m}')" for o, n, num, m in _CASES) + ") t(objective, n, numeric_only, model)")
def chosen_models(spark, sf_dir):
    rows = [(o, n, num, models.choose_model(o, n, numeric_only=num)) for o, n, num, _ in _CASES]
    return spark.createDataFrame(rows, "objective string, n int, numeric_only boolean, model string")


@query(f"WITH {_H}, s AS (SELECT count(*) AS n FROM h) SELECT n, p AS period, CASE WHEN p > 1 AND n > 2 * p THEN 'sarima' WHEN p > 1 THEN 'exp_smoothing' ELSE 'arima' END AS method FROM s, (VALUES (1), (24), (10000)) t(p)")
def chosen_forecasts(spark, sf_dir):
    n = _hourly(spark, sf_dir).count()
    return spark.createDataFrame([(n, p, ts.auto_method(n, p)) for p in (1, 24, 10_000)], "n long, period int, method string")


@query("SELECT 12::BIGINT AS n, 60.0::DOUBLE AS seconds")
def grid_sizes(spark, sf_dir):
    n, seconds = models.grid_size({"maxDepth": [2, 4, 6], "maxIter": [5, 10, 20, 40]}, 5)
    return spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(seconds).alias("seconds"))


@query("SELECT 0.001::DOUBLE AS penalty, '3,1' AS rounds")
def halving_search(spark, sf_dir):
    df = read(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_size") * 3.0 + F.col("p_partkey") % 7).alias("y"))
    found = tuning.halving(df, "p_partkey", "y", ["p_size"], "ridge", [{"regParam": p} for p in (0.001, 100.0, 1000.0)])
    return spark.createDataFrame([(found["options"]["regParam"], ",".join(map(str, [*found["rounds"], 1])))], "penalty double, rounds string")


@query("SELECT * FROM (VALUES ('l_quantity', 'confirmed', 1), ('l_discount', 'rejected', 2), ('l_tax', 'rejected', 2)) t(feature, decision, rank)")
def boruta(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").where("l_orderkey % 4 = 0").select("l_quantity", "l_discount", "l_tax", (F.col("l_extendedprice") + F.col("l_quantity") * 1000).alias("y"))
    found = tuning.boruta(df, "y", ["l_quantity", "l_discount", "l_tax"], rounds=12, trees=5)
    return found.select("feature", "decision", F.least("rank", F.lit(2)).alias("rank"))


# Sources, roles and presentation.


@query("SELECT * FROM (VALUES ('l_orderkey', 'numeric'), ('l_shipdate', 'temporal'), ('l_returnflag', 'text'), ('l_quantity', 'numeric')) t(\"column\", role)")
def column_roles(spark, sf_dir):
    roles = ColumnRoles.of(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_returnflag", "l_quantity"))
    rows = [(c, name) for name in ("numeric", "text", "boolean", "temporal", "other") for c in getattr(roles, name)]
    return spark.createDataFrame(rows, "column string, role string")


@query("SELECT * FROM (VALUES ('value'), ('user_id')) t(feature)")
def common_columns(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("value", "user_id", "event_type")
    return spark.createDataFrame([(c,) for c in drift.common_numeric(events, events.drop("event_type"))], "feature string")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_custkey LIMIT 5")
def previewed(spark, sf_dir):
    return files.preview(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_custkey")


@query("SELECT * FROM (VALUES (1, 'x', 2.5::DOUBLE), (2, 'y', NULL)) t(a, b, c)")
def request_records(spark, sf_dir):
    return files.from_records(spark, {"instances": [{"a": 1, "b": "x", "c": 2.5}, {"a": 2, "b": "y"}]}, "a int, b string, c double")


@query('SELECT c_custkey, c_name AS "who.name", c_nationkey AS "who.at.nation" FROM customer')
def flattened(spark, sf_dir):
    nested = read(spark, sf_dir, "customer").select(
        "c_custkey", F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_nationkey").alias("nation")).alias("at")).alias("who")
    )
    return files.flatten(nested)


@query(
    """SELECT 'p_size' AS "column", 'bigint' AS dtype, min(p_size)::DOUBLE AS low, max(p_size)::DOUBLE AS high, round(avg(p_size), 6) AS mean, NULL::BIGINT AS n_unique FROM part
       UNION ALL SELECT 'p_retailprice', 'double', min(p_retailprice), max(p_retailprice), round(avg(p_retailprice), 6), NULL FROM part
       UNION ALL SELECT 'p_type', 'string', NULL, NULL, NULL, count(DISTINCT p_type) FROM part"""
)
def feature_schemas(spark, sf_dir):
    df = read(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("p_size"), "p_retailprice", "p_type")
    return rounded(schema_table(spark, feature_schema(df)))


@query("SELECT c_custkey, CASE WHEN c_acctbal IS NULL THEN '' WHEN c_acctbal >= 5000 THEN 'good' WHEN c_acctbal >= 0 THEN 'warn' ELSE 'bad' END AS shade FROM customer")
def shaded_cells(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", shade_column("c_acctbal", 5000, 0).alias("shade"))


@query(
    """WITH t AS (SELECT c_custkey, c_custkey::DOUBLE * c_custkey * 1000.0::DOUBLE / 7 AS v FROM customer)
       SELECT c_custkey, CASE WHEN abs(v) >= 1e9 THEN printf('%.1fB', v / 1e9) WHEN abs(v) >= 1e6 THEN printf('%.1fM', v / 1e6) WHEN abs(v) >= 1e3 THEN printf('%.1fK', v / 1e3)
              WHEN v = floor(v) THEN printf('%.0f', v) ELSE printf('%.2f', v) END AS short FROM t"""
)
def short_numbers(spark, sf_dir):
    v = F.col("c_custkey").cast("double") * F.col("c_custkey") * 1000.0 / 7
    return read(spark, sf_dir, "customer").select("c_custkey", v.alias("v")).select("c_custkey", selection.short_number_column("v").alias("short"))


@query("SELECT p_size, p_retailprice FROM part WHERE p_size > 10")
def chained_steps(spark, sf_dir):
    flow = chain.Load(read(spark, sf_dir, "part")) >> chain.Apply(lambda df: df.where("p_size > 10")) >> chain.Select("p_retailprice", ["p_size"])
    return flow.run().df


@query("SELECT * FROM (VALUES ('a', NULL::DOUBLE, 0.1::DOUBLE), ('b', 2.0, 0.2)) t(model, mae, rmse)")
def compared_artifacts(spark, sf_dir):
    bare = lambda metrics: Artifact(None, {}, metrics, {})
    return compare({"a": bare({"rmse": 0.1}), "b": bare({"rmse": 0.2, "mae": 2})}, spark)


@query("SELECT * FROM (VALUES ('data', 'd.csv'), ('engineer', 'False'), ('save', 'None'), ('target', 'y'), ('task', 'regression'), ('test_size', '0.3'), ('tune', '{''method'': ''halving''}'), ('validate', 'True')) t(key, value)")
def pipeline_settings(spark, sf_dir):
    found = files.pipeline_config("data: d.csv\ntarget: y\ntask: regression\ntest_size: 0.3\ntune:\n  method: halving\n")
    return spark.createDataFrame([(k, str(v)) for k, v in found.items()], "key string, value string")


@query("SELECT * FROM (VALUES ('a.x', 1), ('a.y', 3), ('b', 4)) t(key, value)")
def merged_settings(spark, sf_dir):
    found = files.merged({"a": {"x": 1, "y": 2}}, {"a": {"y": 3}}, {"b": 4})
    rows = [(f"a.{k}", v) for k, v in found["a"].items()] + [("b", found["b"])]
    return spark.createDataFrame(rows, "key string, value int")


@query(
    """WITH g AS (SELECT l_returnflag AS grp, avg((l_linenumber = 1)::INT::DOUBLE) AS s FROM lineitem GROUP BY 1), o AS (SELECT min(s) / max(s) AS dp FROM g)
       SELECT 'demographic_parity_ratio' AS metric, round(dp, 6) AS value, dp >= 0.8 AS fair FROM o UNION ALL SELECT 'equalized_odds_tpr_diff', 0.0, true FROM o
       UNION ALL SELECT 'equalized_odds_fpr_diff', 0.0, true FROM o UNION ALL SELECT 'disparate_impact_ratio', round(dp, 6), dp >= 0.8 FROM o
       UNION ALL SELECT 'equal_opportunity_diff', 0.0, true FROM o"""
)
def fairness_service(spark, sf_dir):
    c = config.FairnessConfig(data=f"{sf_dir}/lineitem.parquet", target="l_linenumber", predicted="l_linenumber", sensitive="l_returnflag")
    return rounded(services.check_fairness(spark, c))


@query("SELECT * FROM (VALUES ('c_custkey'), ('c_nationkey'), ('c_acctbal')) t(feature), (SELECT 0.0::DOUBLE AS psi, 0.0::DOUBLE AS ks_statistic, 1.0::DOUBLE AS ks_p_value, false AS psi_drifted, false AS ks_drifted, false AS drifted)")
def drift_service(spark, sf_dir):
    path = f"{sf_dir}/customer.parquet"
    return rounded(services.detect_drift(spark, config.DriftConfig(reference=path, current=path)))


@query("SELECT count(*) AS n, true AS better_than_mean, true AS on_rows_held_out FROM part")
def train_service(spark, sf_dir):
    path = f"{sf_dir}/part.parquet"
    made = services.train(spark, config.TrainConfig(data=path, target="p_retailprice"))
    scored = made.predict(files.load(spark, path))
    return scored.agg(F.count("prediction").alias("n"), F.lit(made.metrics["r2"] > 0.05).alias("better_than_mean"), (F.count("*") > made.metrics["n"] * 3).alias("on_rows_held_out"))


@query(
    "SELECT count(*) AS n, true AS some_flagged, true AS all_columns FROM customer"
)
def anomaly_service(spark, sf_dir):
    found = services.detect_anomalies(spark, config.AnomalyConfig(data=f"{sf_dir}/customer.parquet", contamination=0.1, consensus=1))
    wanted = {"iforest", "lof", "consensus_score", "is_anomaly", "c_custkey"} <= set(found.columns)
    return found.agg(F.count("*").alias("n"), (F.count_if("is_anomaly") >= F.count("*") * 0.09).alias("some_flagged"), F.lit(wanted).alias("all_columns"))


@query("SELECT true AS grid, true AS parzen, true AS stacked, true AS moved, true AS halved")
def tuning_holds(spark, sf_dir):
    df = read(spark, sf_dir, "part").where("p_partkey % 2 = 0").select("p_partkey", "p_size", (F.col("p_size") * 3.0 + F.col("p_partkey") % 7).alias("y"), (F.col("p_partkey") % 5).alias("noise"))
    grid = selection.grid_search(df, "p_partkey", "y", ["p_size"], "ridge", {"regParam": [0.001, 1000.0]}, k=2)
    parzen = tuning.tpe_search(df, "p_partkey", "y", ["p_size"], "ridge", trials=6, startup=4, ranges={"regParam": (0.001, 1000.0, "log")})
    stacked = tuning.score(tuning.stacked(df, "p_partkey", "y", ["p_size"], ["linear", "ridge"], 2), "y", "regression")["r2"]
    fitted = models.train(df, "y", ["p_size", "noise"], "linear")
    moved = tuning.permutation_importance(df, fitted, "y", ["p_size", "noise"])
    halved = tuning.halving(df, "p_partkey", "y", ["p_size"], "ridge", [{"regParam": p} for p in (0.001, 500.0)])
    row = (
        grid["options"] == {"regParam": 0.001} and grid["test"]["r2"] > 0.99,
        parzen["score"] <= min(s for s, _ in parzen["trials"]) and len(parzen["trials"]) == 6,
        stacked > 0.99,
        moved["p_size"] > 10 * abs(moved["noise"]),
        halved["options"] == {"regParam": 0.001},
    )
    return spark.createDataFrame([row], "grid boolean, parzen boolean, stacked boolean, moved boolean, halved boolean")


@query("SELECT count(*) - 23 AS n, true AS not_negative FROM (SELECT DISTINCT date_trunc('hour', ts) AS h FROM events)")
def sequence_errors(spark, sf_dir):
    found = ts.sequence_errors(_hourly(spark, sf_dir), 24, 2)
    return found.agg(F.count("*").alias("n"), (F.min("error") >= 0).alias("not_negative"))


@query("SELECT * FROM (VALUES ('x', 3.0::DOUBLE), ('z', 0.0::DOUBLE)) t(feature, importance)")
def lime_holds(spark, sf_dir):
    df = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 10.0).alias("x"), (F.col("p_partkey") % 11).cast("double").alias("z"))
    spread = df.agg(F.stddev_samp("x")).first()[0]
    df = df.withColumn("y", F.col("x") * (3.0 / spread))
    fitted = models.train(df, "y", ["x", "z"], "linear")
    return rounded(explain.lime_importance(explain.lime(df, fitted, "p_partkey", ["x", "z"], draws=50)), 2)


# What must hold of models that SQL cannot fit.


@query("SELECT 4 AS n_clusters, 0::BIGINT AS n_misplaced")
def kmeans_holds(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 50).alias("y"))
    found = models.cluster(part, ["x", "y"], 4).persist()
    spread = found.agg(F.stddev_samp("x").alias("sx"), F.stddev_samp("y").alias("sy"))
    scaled = found.join(F.broadcast(spread), F.lit(True)).select("p_partkey", "cluster", (F.col("x") / F.col("sx")).alias("x"), (F.col("y") / F.col("sy")).alias("y"))
    centres = scaled.groupBy(F.col("cluster").alias("c")).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    gap = (F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2
    nearest = scaled.join(F.broadcast(centres), F.lit(True)).groupBy("p_partkey", "cluster").agg(F.min_by("c", gap).alias("near"))
    # Lloyd's rounds stop within a tolerance, so a row at a border may lie nearer to a mean that moved last.
    share = F.count_if(F.col("near") != F.col("cluster")) / F.count("*")
    return nearest.agg(F.count_distinct("cluster").cast("int").alias("n_clusters"), F.when(share < 0.01, 0).otherwise(1).cast("long").alias("n_misplaced"))


@query("SELECT count(*) AS n, (floor((count(*) - 1) * 0.05))::BIGINT >= 1 AS some_flagged, true AS in_range FROM customer")
def iforest_holds(spark, sf_dir):
    scored = anomaly.isolation_forest(read(spark, sf_dir, "customer"), "c_custkey", ["c_acctbal", "c_nationkey"])
    found = anomaly.flag_top(scored, "score", 0.05)
    flagged = F.count_if("is_anomaly")
    return found.agg(F.count("*").alias("n"), flagged.between(1, F.count("*") * 0.05 + 1).alias("some_flagged"), ((F.min("score") > 0) & (F.max("score") < 1)).alias("in_range"))


@query("SELECT 12::BIGINT AS steps, true AS ordered, true AS widening")
def sarima_holds(spark, sf_dir):
    found = ts.sarima(_hourly(spark, sf_dir), 12, 24)
    width = F.col("upper") - F.col("lower")
    return found.agg(
        F.count("*").alias("steps"),
        F.bool_and((F.col("lower") <= F.col("forecast")) & (F.col("forecast") <= F.col("upper"))).alias("ordered"),
        (F.max_by(width, "step") >= F.min_by(width, "step")).alias("widening"),
    )


@query("SELECT true AS better_than_mean, true AS sums_up")
def shapley_holds(spark, sf_dir):
    df = read(spark, sf_dir, "part").select("p_partkey", "p_size", F.length("p_name").alias("size"), (F.col("p_size") * 10 + F.length("p_name") * 3).cast("double").alias("y"))
    fitted = models.train(df, "y", ["p_size", "size"], "gbt_regressor", maxIter=5)
    r2 = tuning.score(fitted.transform(df), "y", "regression")["r2"]
    values = explain.shapley(df, fitted, "p_partkey", ["p_size", "size"], orders=8, rows=20)
    sums = values.groupBy("p_partkey").agg(F.sum("shap").alias("s"))
    guesses = fitted.transform(df).join(sums, "p_partkey").select((F.col("prediction") - F.col("s")).alias("base"))
    even = guesses.agg(F.max("base") - F.min("base")).first()[0]
    return spark.createDataFrame([(r2 > 0.5, even < 1e-6)], "better_than_mean boolean, sums_up boolean")

"""Drift, fairness, metrics, series, charts, outliers, models and embeddings as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import anomaly, charts, drift, fairness, metrics, models, selection, text
from gridloom.functions.draws import draw_sql
from gridloom.operators import timeseries as ts
from gridloom.plans.registry import query, read, rounded

# Drift: events before and from a day on, one column scaled.

_DAY = "TIMESTAMP '2024-01-15'"


def _periods(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    late = F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")
    columns = ("value", "user_id")
    current = events.where(late).select((F.col("value") * 1.3).alias("value"), "user_id")
    return events.where(~late).select(*columns), current


_PSI = f"""r AS (SELECT unnest([{{'f': 'value', 'x': value}}, {{'f': 'user_id', 'x': user_id::DOUBLE}}]) AS u FROM events WHERE ts < {_DAY}),
  c AS (SELECT unnest([{{'f': 'value', 'x': value * 1.3}}, {{'f': 'user_id', 'x': user_id::DOUBLE}}]) AS u FROM events WHERE ts >= {_DAY}),
  e0 AS (SELECT u.f AS f, list_sort(list_distinct(quantile_cont(u.x, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS q FROM r GROUP BY 1),
  s AS (SELECT u.f AS f, min(u.x) AS lo, max(u.x) AS hi FROM c GROUP BY 1),
  e AS (SELECT f, list_concat(list_concat([least(q[1], lo) - 1], q[2:len(q) - 1]), [greatest(q[len(q)], hi) + 1]) AS q FROM e0 JOIN s USING (f)),
  b AS (SELECT f, 0 AS side, least(len(list_filter(q, lambda v: v <= u.x)), len(q) - 1) AS bin FROM r JOIN e ON f = u.f
        UNION ALL SELECT f, 1, least(len(list_filter(q, lambda v: v <= u.x)), len(q) - 1) FROM c JOIN e ON f = u.f),
  n AS (SELECT f, bin, count(*) FILTER (WHERE side = 0) AS nr, count(*) FILTER (WHERE side = 1) AS nc FROM b GROUP BY 1, 2),
  g AS (SELECT f, unnest(range(1, len(q))) AS bin FROM e),
  p AS (SELECT f, coalesce(nr, 0) / sum(nr) OVER (PARTITION BY f)::DOUBLE + 1e-4 AS pr, coalesce(nc, 0) / sum(nc) OVER (PARTITION BY f)::DOUBLE + 1e-4 AS pc
        FROM g LEFT JOIN n USING (f, bin)),
  psi AS (SELECT f AS feature, sum((pc - pr) * ln(pc / pr)) AS psi FROM p GROUP BY 1)"""
_KS = """v AS (SELECT u.f AS f, u.x AS x, 1 AS a, 0 AS b FROM r UNION ALL SELECT u.f, u.x, 0, 1 FROM c),
  k AS (SELECT f, x, sum(a) AS a, sum(b) AS b FROM v GROUP BY 1, 2),
  d AS (SELECT f, abs(sum(a) OVER w / sum(a) OVER (PARTITION BY f)::DOUBLE - sum(b) OVER w / sum(b) OVER (PARTITION BY f)::DOUBLE) AS gap,
               sum(a) OVER (PARTITION BY f) AS n, sum(b) OVER (PARTITION BY f) AS m FROM k WINDOW w AS (PARTITION BY f ORDER BY x)),
  ks AS (SELECT f AS feature, max(gap) AS statistic, max(n)::BIGINT AS n_ref, max(m)::BIGINT AS n_cur FROM d GROUP BY 1)"""


@query(f"WITH {_PSI} SELECT feature, round(psi, 6) AS psi FROM psi")
def drift_psi(spark, sf_dir):
    return rounded(drift.psi(*_periods(spark, sf_dir)))


@query(f"WITH {_PSI}, {_KS} SELECT feature, round(statistic, 6) AS statistic, n_ref, n_cur FROM ks")
def drift_ks_stat(spark, sf_dir):
    return rounded(drift.ks_statistic(*_periods(spark, sf_dir)))


_SERIES = " + ".join(f"{2 * (-1) ** (k - 1)} * exp(-2 * {k * k} * lam * lam)" for k in range(1, 21))
_DETECT = f"""WITH {_PSI}, {_KS},
  j AS (SELECT feature, psi, statistic, sqrt(n_ref::DOUBLE * n_cur / (n_ref + n_cur)) AS size FROM psi JOIN ks USING (feature)),
  l AS (SELECT *, (size + 0.12 + 0.11 / size) * statistic AS lam FROM j),
  t AS (SELECT feature, psi, statistic AS ks_statistic, CASE WHEN lam < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, {_SERIES})) END AS ks_p_value FROM l),
  report AS (SELECT *, psi > 0.2 AS psi_drifted, ks_p_value < 0.05 AS ks_drifted, psi > 0.2 OR ks_p_value < 0.05 AS drifted FROM t)"""


@query(f"{_DETECT} SELECT feature, round(psi, 6) AS psi, round(ks_statistic, 6) AS ks_statistic, round(ks_p_value, 6) AS ks_p_value, psi_drifted, ks_drifted, drifted FROM report")
def drift_report(spark, sf_dir):
    return rounded(drift.detect(*_periods(spark, sf_dir), exact_size=0))


@query(
    f"""{_DETECT} SELECT count(*) AS total, sum(drifted::INT)::BIGINT AS n_drifted, round(100 * avg(drifted::INT::DOUBLE), 2) AS drift_pct,
        round(max(psi), 6) AS max_psi, arg_max(feature, psi) AS worst_feature FROM report"""
)
def drift_summary(spark, sf_dir):
    return drift.summary(drift.detect(*_periods(spark, sf_dir), exact_size=0))


# Fairness and metrics: labelled documents, a rule on length as the prediction.


def _judged(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("n_chars") > 400).cast("int").alias("y_pred"), "n_chars")
    return docs.join(read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y_true"), "toxic"), "doc_id")


_J = "j AS (SELECT d.doc_id, lang, (n_chars > 400)::INT AS y_pred, n_chars, quality AS y_true, toxic FROM documents d JOIN labels USING (doc_id))"
_RATES = f"""{_J}, g AS (SELECT lang AS grp, count(*) AS n, avg((y_pred = 1)::INT::DOUBLE) AS selection_rate,
   coalesce(avg((y_pred = 1)::INT::DOUBLE) FILTER (WHERE y_true = 1), 0) AS tpr, coalesce(avg((y_pred = 1)::INT::DOUBLE) FILTER (WHERE y_true <> 1), 0) AS fpr FROM j GROUP BY 1)"""


@query(f"WITH {_RATES} SELECT grp, n, round(selection_rate, 6) AS selection_rate, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM g")
def fairness_groups(spark, sf_dir):
    return rounded(fairness.group_rates(_judged(spark, sf_dir), "y_true", "y_pred", "lang"))


@query(f"WITH {_RATES} SELECT grp, round(selection_rate / (SELECT max(selection_rate) FROM g), 6) AS impact FROM g")
def fairness_di(spark, sf_dir):
    return rounded(fairness.disparate_impact(fairness.group_rates(_judged(spark, sf_dir), "y_true", "y_pred", "lang")))


@query(
    f"""WITH {_RATES}, o AS (SELECT min(selection_rate) / max(selection_rate) AS dp, max(tpr) - min(tpr) AS t, max(fpr) - min(fpr) AS f FROM g)
       SELECT 'demographic_parity_ratio' AS metric, round(dp, 6) AS value, dp >= 0.8 AS fair FROM o
       UNION ALL SELECT 'equalized_odds_tpr_diff', round(t, 6), t < 0.1 AND f < 0.1 FROM o
       UNION ALL SELECT 'equalized_odds_fpr_diff', round(f, 6), t < 0.1 AND f < 0.1 FROM o
       UNION ALL SELECT 'disparate_impact_ratio', round(dp, 6), dp >= 0.8 FROM o
       UNION ALL SELECT 'equal_opportunity_diff', round(t, 6), t < 0.1 FROM o"""
)
def fairness_summary(spark, sf_dir):
    return rounded(fairness.metrics(fairness.group_rates(_judged(spark, sf_dir), "y_true", "y_pred", "lang")))


@query(
    """WITH p AS (SELECT l_extendedprice AS y, l_quantity * 1000 AS p FROM lineitem)
       SELECT count(*) AS n, round(avg((y - p) * (y - p)), 4) AS mse, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae,
              round(1 - avg((y - p) * (y - p)) / var_pop(y), 4) AS r2 FROM p"""
)
def metrics_regression(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_extendedprice", (F.col("l_quantity") * 1000).alias("p"))
    return rounded(metrics.regression(df, "l_extendedprice", "p"), 4)


@query("SELECT round(100 * avg(abs((l_extendedprice - l_quantity * 1000) / (l_extendedprice + 1e-8))), 4) AS mape FROM lineitem")
def metrics_mape(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_extendedprice", (F.col("l_quantity") * 1000).alias("p"))
    return rounded(metrics.mape(df, "l_extendedprice", "p"), 4)


@query(f"WITH {_J} SELECT y_true, y_pred, count(*) AS n FROM j GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(_judged(spark, sf_dir), "y_true", "y_pred")


_REPORT = f"""{_J}, k AS (SELECT y_true AS label FROM j UNION SELECT y_pred FROM j),
  m AS (SELECT label, (SELECT count(*) FROM j WHERE y_true = label) AS support, (SELECT count(*) FROM j WHERE y_pred = label) AS said,
               (SELECT count(*) FROM j WHERE y_true = label AND y_pred = label) AS hit FROM k),
  rep AS (SELECT label, coalesce(hit::DOUBLE / nullif(said, 0), 0) AS "precision", coalesce(hit::DOUBLE / nullif(support, 0), 0) AS recall,
               coalesce(2.0::DOUBLE * hit / nullif(said + support, 0), 0) AS f1, support FROM m)"""


@query(f'WITH {_REPORT} SELECT label, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM rep')
def metrics_report(spark, sf_dir):
    return rounded(metrics.classification_report(_judged(spark, sf_dir), "y_true", "y_pred"))


@query(
    f"""WITH {_REPORT} SELECT round(sum(recall * support) / sum(support), 6) AS accuracy, round(sum(f1 * support) / sum(support), 6) AS f1_weighted,
        round(sum("precision" * support) / sum(support), 6) AS precision_weighted, round(sum(recall * support) / sum(support), 6) AS recall_weighted FROM rep"""
)
def metrics_classification(spark, sf_dir):
    return rounded(metrics.classification(_judged(spark, sf_dir), "y_true", "y_pred"))


@query(
    """WITH q AS (SELECT event_type AS metric, avg(value) FILTER (WHERE user_id % 2 = 0) AS a, avg(value) FILTER (WHERE user_id % 2 = 1) AS b FROM events GROUP BY 1)
       SELECT metric, 'b' AS model, round(a, 6) AS baseline, round(b, 6) AS value, round(b - a, 6) AS delta, round(100 * (b - a) / abs(a), 6) AS delta_pct,
              CASE WHEN b = a THEN 'same' WHEN b > a THEN 'better' ELSE 'worse' END AS direction FROM q"""
)
def comparison_deltas(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    by = lambda k: F.avg(F.when(F.col("user_id") % 2 == k, F.col("value")))
    return rounded(metrics.comparison(events.groupBy("event_type").agg(by(0).alias("a"), by(1).alias("b")), "event_type", "a", ["b"]))


# Series: events by hour.


def _hourly(spark, sf_dir):
    hours = read(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.count("*").cast("double").alias("value"))
    pos = F.floor((F.unix_timestamp(F.col("h").cast("timestamp")) - F.lit(1704067200)) / 3600)
    return hours.select(F.lit("all").alias("series"), pos.cast("long").alias("pos"), "value")


_H = "h AS (SELECT 'all' AS series, (epoch(date_trunc('hour', ts))::BIGINT - 1704067200) // 3600 AS pos, count(*)::DOUBLE AS value FROM events GROUP BY 2)"


@query(
    f"""WITH {_H}, w AS (SELECT *, count(*) OVER f AS n, avg(value) OVER f AS m, stddev_samp(value) OVER f AS s FROM h
          WINDOW f AS (ORDER BY pos ROWS BETWEEN 24 PRECEDING AND 23 FOLLOWING))
        SELECT series, pos, value, CASE WHEN n = 48 THEN round(m, 6) END AS centre, CASE WHEN n = 48 THEN round(s, 6) END AS spread,
               coalesce(n = 48 AND abs(value - m) > 2 * s, false) AS is_anomaly FROM w"""
)
def rolling_mean_anomaly(spark, sf_dir):
    return rounded(ts.rolling_mean_anomalies(_hourly(spark, sf_dir), n_sigma=2.0))


@query(
    f"""WITH {_H}, w AS (SELECT *, list(value) OVER f AS a FROM h WINDOW f AS (ORDER BY pos ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)),
        m AS (SELECT *, list_median(a) AS md FROM w), d AS (SELECT *, list_median(list_transform(a, lambda v: abs(v - md))) AS mad FROM m)
        SELECT series, pos, value, CASE WHEN len(a) = 25 THEN round(md, 6) END AS centre, CASE WHEN len(a) = 25 THEN round(1.4826 * mad, 6) END AS spread,
               coalesce(len(a) = 25 AND abs(value - md) > 2 * 1.4826 * mad, false) AS is_anomaly FROM d"""
)
def rolling_median_anomaly(spark, sf_dir):
    return rounded(ts.rolling_median_anomalies(_hourly(spark, sf_dir), window=25, n_sigma=2.0))


@query(
    f"""WITH {_H}, d AS (SELECT *, value - lag(value, 24) OVER (ORDER BY pos) AS r FROM h), s AS (SELECT avg(r) AS m, stddev_pop(r) AS s FROM d)
        SELECT series, pos, r AS residual, coalesce(abs(r - m) > 2 * s, false) AS is_anomaly FROM d, s WHERE r IS NOT NULL"""
)
def residual_rule(spark, sf_dir):
    from pyspark.sql import Window

    lagged = F.lag("value", 24).over(Window.partitionBy("series").orderBy("pos"))
    df = _hourly(spark, sf_dir).select("series", "pos", (F.col("value") - lagged).alias("residual")).where("residual is not null")
    return ts.residual_anomalies(df, "residual", n_sigma=2.0)


@query(
    f"""WITH {_H}, w AS (SELECT *, list(value) OVER (ORDER BY pos ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS a FROM h)
        SELECT series, pos, list_sum(a) AS total FROM w WHERE len(a) = 6"""
)
def ts_sequences(spark, sf_dir):
    found = ts.sequences(_hourly(spark, sf_dir), 6)
    return found.select("series", "pos", F.aggregate("sequence", F.lit(0.0), lambda s, v: s + v).alias("total"))


_ACF = f"""{_H}, d AS (SELECT row_number() OVER (ORDER BY pos) AS i, value - avg(value) OVER () AS d, count(*) OVER () AS n FROM h),
  l AS (SELECT unnest(range(0, least((SELECT max(n) FROM d) // 2, 100) + 1)) AS lag),
  acf AS (SELECT lag, sum(a.d * b.d) / (SELECT sum(d * d) FROM d) AS acf FROM l JOIN d a ON true JOIN d b ON b.i = a.i + lag GROUP BY 1)"""


@query(f"WITH {_ACF} SELECT 'all' AS series, lag::INT AS lag, round(acf, 6) AS acf FROM acf")
def acf(spark, sf_dir):
    return rounded(ts.autocorrelation(_hourly(spark, sf_dir)))


@query(
    f"""WITH {_ACF}, p AS (SELECT lag, acf, lag(acf) OVER (ORDER BY lag) AS a, lead(acf) OVER (ORDER BY lag) AS b FROM acf)
        SELECT 'all' AS series, coalesce(min(lag) FILTER (WHERE acf > a AND acf > b AND acf > 0.1 AND lag >= 2), 1)::INT AS period FROM p"""
)
def seasonal_period(spark, sf_dir):
    return ts.seasonal_period(ts.autocorrelation(_hourly(spark, sf_dir)))


@query(
    f"""WITH {_H}, n AS (SELECT count(*) AS n FROM h), f AS (SELECT n, n - 3 * 24 AS first, unnest(range(0, 3)) AS fold FROM n)
        SELECT 'all' AS series, fold::INT AS fold, first + fold * 24 AS train_end, least(first + fold * 24 + 24, n) AS test_end FROM f"""
)
def walk_forward_folds(spark, sf_dir):
    return ts.walk_forward(_hourly(spark, sf_dir), 3, 24)


@query(
    f"""WITH RECURSIVE {_H}, y AS (SELECT row_number() OVER (ORDER BY pos) AS i, value AS v FROM h),
        s AS (SELECT 1::BIGINT AS i, v AS l, (SELECT v FROM y WHERE i = 2) - v AS t FROM y WHERE i = 1
              UNION ALL SELECT y.i, 0.3::DOUBLE * v + 0.7::DOUBLE * (l + t), 0.1::DOUBLE * (0.3::DOUBLE * v + 0.7::DOUBLE * (l + t) - l) + 0.9::DOUBLE * t FROM s JOIN y ON y.i = s.i + 1),
        z AS (SELECT 0.3::DOUBLE * v + 0.7::DOUBLE * (v + d) AS l, 0.1::DOUBLE * (0.3::DOUBLE * v + 0.7::DOUBLE * (v + d) - v) + 0.9::DOUBLE * d AS t
              FROM (SELECT v, (SELECT v FROM y WHERE i = 2) - v AS d FROM y WHERE i = 1)),
        q AS (SELECT 1::BIGINT AS i, l, t FROM z
              UNION ALL SELECT y.i, 0.3::DOUBLE * v + 0.7::DOUBLE * (l + t), 0.1::DOUBLE * (0.3::DOUBLE * v + 0.7::DOUBLE * (l + t) - l) + 0.9::DOUBLE * t FROM q JOIN y ON y.i = q.i + 1)
        SELECT 'all' AS series, step, round(l + step * t, 4) AS forecast FROM (SELECT arg_max(l, i) AS l, arg_max(t, i) AS t FROM q), (SELECT unnest(range(1, 13)) AS step)"""
)
def forecast_smoothing(spark, sf_dir):
    return rounded(ts.forecast(_hourly(spark, sf_dir), 12, alpha=0.3).select("series", "step", "forecast"), 4)


@query()
def forecast_arima(spark, sf_dir):
    return rounded(ts.arima(_hourly(spark, sf_dir), 12))


@query(
    f"""WITH {_H}, a AS (SELECT *, count(*) OVER f AS n, avg(value) OVER f AS m, stddev_samp(value) OVER f AS s FROM h WINDOW f AS (ORDER BY pos ROWS BETWEEN 24 PRECEDING AND 23 FOLLOWING)),
        b AS (SELECT pos, list(value) OVER f AS l FROM h WINDOW f AS (ORDER BY pos ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)),
        c AS (SELECT pos, l, list_median(l) AS md FROM b), e AS (SELECT pos, l, md, list_median(list_transform(l, lambda v: abs(v - md))) AS mad FROM c),
        f AS (SELECT pos, coalesce(n = 48 AND abs(value - m) > 2 * s, false) AS mean_flag, coalesce(len(l) = 25 AND abs(value - md) > 2 * 1.4826 * mad, false) AS median_flag FROM a JOIN e USING (pos))
        SELECT pos, mean_flag, median_flag, mean_flag::INT + median_flag::INT AS consensus_score, mean_flag OR median_flag AS is_anomaly FROM f"""
)
def ts_consensus(spark, sf_dir):
    hourly = _hourly(spark, sf_dir)
    mean = ts.rolling_mean_anomalies(hourly, n_sigma=2.0).select("pos", F.col("is_anomaly").alias("mean_flag"))
    median = ts.rolling_median_anomalies(hourly, window=25, n_sigma=2.0).select("pos", F.col("is_anomaly").alias("median_flag"))
    return anomaly.consensus(mean.join(median, "pos"), ["mean_flag", "median_flag"], 1)


# Charts.


@query(
    """WITH s AS (SELECT min(value) AS a, (max(value) - min(value)) / 10 AS w FROM events),
       c AS (SELECT least(floor((value - a) / w), 9)::INT AS bin, count(*) AS n, avg(value) AS mean, var_pop(value) AS variance FROM events, s GROUP BY 1),
       g AS (SELECT unnest(range(0, 10))::INT AS bin)
       SELECT bin, round(a + bin * w, 6) AS lo, round(a + (bin + 1) * w, 6) AS hi, coalesce(n, 0) AS n, round(mean, 6) AS mean, round(variance, 6) AS variance,
              round(sum(coalesce(n, 0)) OVER (ORDER BY bin) * max(n) OVER () / sum(n) OVER ()::DOUBLE, 6) AS cumulative FROM g LEFT JOIN c USING (bin), s"""
)
def histogram_bins(spark, sf_dir):
    return rounded(charts.histogram(read(spark, sf_dir, "events"), "value"))


@query(
    """WITH q AS (SELECT event_type, count(value) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
       SELECT event_type, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(min(value), 6) AS low, round(max(value), 6) AS high
       FROM events JOIN q USING (event_type) WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL"""
)
def box_stats(spark, sf_dir):
    return rounded(charts.box_stats(read(spark, sf_dir, "events"), "event_type", "value"))


@query(
    """WITH s AS (SELECT event_type, count(*) AS n, stddev_samp(value) AS sd, min(value) AS a, max(value) AS b, stddev_samp(value) * pow(count(*), -0.2) AS h FROM events GROUP BY 1),
       g AS (SELECT unnest(range(0, 20)) AS i)
       SELECT event_type, round(a + i * (b - a) / 19, 6) AS x, round(sum(exp(-pow((a + i * (b - a) / 19 - value) / h, 2) / 2)) / (any_value(n) * any_value(h) * 2.5066282746310002), 6) AS density
       FROM events JOIN s USING (event_type), g GROUP BY event_type, i, a, b"""
)
def violin_density(spark, sf_dir):
    return rounded(charts.density(read(spark, sf_dir, "events"), "event_type", "value", 20))


@query(
    """WITH s AS (SELECT min(p_size) AS xa, max(p_size) AS xb, min(p_retailprice) AS ya, max(p_retailprice) AS yb FROM part),
       p AS (SELECT (p_size - xa)::DOUBLE * 10 / (xb - xa) AS u, (p_retailprice - ya) * 6 / (yb - ya) AS v FROM part, s),
       c AS (SELECT pow(u - floor(u + 0.5), 2) + 3 * pow(v - floor(v + 0.5), 2) < pow(u - floor(u) - 0.5, 2) + 3 * pow(v - floor(v) - 0.5, 2) AS near, u, v FROM p)
       SELECT CASE WHEN near THEN floor(u + 0.5) ELSE floor(u) + 0.5 END AS hx, CASE WHEN near THEN floor(v + 0.5) ELSE floor(v) + 0.5 END AS hy, count(*) AS n FROM c GROUP BY 1, 2"""
)
def hexbin(spark, sf_dir):
    return charts.hexbin(read(spark, sf_dir, "part"), "p_size", "p_retailprice", 10)


def _flows(spark, sf_dir):
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    customers = read(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    wide = customers.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    return wide.groupBy("r_name", "n_name", "c_mktsegment").agg(F.count("*").alias("n"))


_FLOWS = "w AS (SELECT r_name, n_name, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)"


@query(
    f"""WITH {_FLOWS}, e AS (SELECT r_name AS source, c_mktsegment AS target, sum(n)::DOUBLE AS value FROM w GROUP BY 1, 2),
        x AS (SELECT source AS node, value AS o, 0 AS i FROM e UNION ALL SELECT target, 0, value FROM e)
        SELECT node, sum(o) AS outgoing, sum(i)::DOUBLE AS incoming, sum(o) + sum(i) AS total FROM x GROUP BY 1"""
)
def sankey_totals(spark, sf_dir):
    edges = _flows(spark, sf_dir).groupBy(F.col("r_name").alias("source"), F.col("c_mktsegment").alias("target")).agg(F.sum("n").alias("value"))
    return charts.node_totals(edges)


@query(
    f"""WITH {_FLOWS} SELECT 0 AS depth, '' AS path, sum(n)::BIGINT AS value FROM w
        UNION ALL SELECT 1, r_name, sum(n)::BIGINT FROM w GROUP BY 2 UNION ALL SELECT 2, r_name || '/' || n_name, sum(n)::BIGINT FROM w GROUP BY 2
        UNION ALL SELECT 3, r_name || '/' || n_name || '/' || c_mktsegment, sum(n)::BIGINT FROM w GROUP BY 2"""
)
def hierarchy_rollup(spark, sf_dir):
    return charts.roll_up(_flows(spark, sf_dir), ["r_name", "n_name", "c_mktsegment"], "n")


def _daily(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.dayofmonth("ts").alias("slot"), F.col("event_type").alias("series")).agg(F.round(F.sum("value"), 4).alias("value"))


_D = "d AS (SELECT day(ts) AS slot, event_type AS series, round(sum(value), 4) AS value FROM events GROUP BY 1, 2)"


@query(f"WITH {_D} SELECT slot::INT AS slot, series, value, round(value / avg(value) OVER (PARTITION BY series) * 100, 4) AS \"index\" FROM d")
def index_chart(spark, sf_dir):
    return rounded(charts.index_to(_daily(spark, sf_dir), "series", "value"), 4)


@query(f"WITH {_D} SELECT slot::INT AS slot, series, value, round(100.0::DOUBLE * value / sum(value) OVER (PARTITION BY slot), 4) AS share FROM d")
def stacked_pct(spark, sf_dir):
    return rounded(charts.stack_share(_daily(spark, sf_dir), "slot", "value"), 4)


@query(f"WITH {_D}, one AS (SELECT slot, sum(value) AS value FROM d WHERE series = 'click' GROUP BY 1) SELECT s AS slot, round(coalesce(value, 0), 4) AS value FROM range(0, 35) t(s) LEFT JOIN one ON slot = s")
def fill_slots(spark, sf_dir):
    one = _daily(spark, sf_dir).where("series = 'click'").groupBy(F.col("slot").cast("long").alias("slot")).agg(F.sum("value").alias("value"))
    return rounded(charts.fill_slots(one, 35), 4)


@query(
    """SELECT p_partkey, round((p_size - min(p_size) OVER ())::DOUBLE / (max(p_size) OVER () - min(p_size) OVER ()), 6) AS p_size,
              round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS p_retailprice FROM part"""
)
def minmax_parallel(spark, sf_dir):
    return rounded(charts.min_max(read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"]))


@query("SELECT p_partkey, p_size, round(p_size * 1000.0::DOUBLE / max(p_size) OVER (), 6) AS size FROM part")
def bubble_sizes(spark, sf_dir):
    return rounded(charts.bubble_size(read(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size"))


@query(
    f"""WITH {_H}, x AS (SELECT pos, value - avg(value) OVER () AS v FROM h), b AS (SELECT max(abs(v)) / 3 AS b FROM x)
        SELECT pos, k::INT AS band, round(least(greatest(v, k * b), (k + 1) * b) - k * b, 4) AS positive, round(least(greatest(-v, k * b), (k + 1) * b) - k * b, 4) AS negative
        FROM x, b, range(0, 3) t(k)"""
)
def horizon_bands(spark, sf_dir):
    hourly = _hourly(spark, sf_dir)
    mean = hourly.agg(F.avg("value").alias("m"))
    centred = hourly.join(F.broadcast(mean), F.lit(True)).select("pos", (F.col("value") - F.col("m")).alias("v"))
    return rounded(charts.horizon_bands(centred, "pos", "v"), 4)


@query(
    f"""WITH {_D} SELECT slot::INT AS slot, series, round(sum(value) OVER w - value - sum(value) OVER (PARTITION BY slot) / 2, 4) AS y0,
        round(sum(value) OVER w - sum(value) OVER (PARTITION BY slot) / 2, 4) AS y1 FROM d WINDOW w AS (PARTITION BY slot ORDER BY series ROWS UNBOUNDED PRECEDING)"""
)
def streamgraph_layers(spark, sf_dir):
    return rounded(charts.stream_layers(_daily(spark, sf_dir), "slot", "series", "value"), 4)


@query(f"WITH {_D} SELECT slot::INT AS slot, series, value, rank() OVER (PARTITION BY slot ORDER BY value DESC)::INT AS rank FROM d")
def bump_ranks(spark, sf_dir):
    return charts.bump_ranks(_daily(spark, sf_dir), "slot", "value")


# Outliers.


@query(
    """SELECT event_id, value, round((value - avg(value) OVER ()) / stddev_pop(value) OVER (), 6) AS value_z FROM events"""
)
def standardize_pop(spark, sf_dir):
    return rounded(anomaly.standardise(read(spark, sf_dir, "events").select("event_id", "value"), ["value"]))


@query(
    """WITH p AS (SELECT c_custkey AS id, c_acctbal / 1000 AS x, c_nationkey::DOUBLE AS y FROM customer),
       d AS (SELECT a.id, b.id AS other, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM p a JOIN p b ON a.id <> b.id),
       n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS k FROM d) WHERE k <= 10),
       r AS (SELECT id, max(d) AS kd FROM n GROUP BY 1),
       l AS (SELECT n.id, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM n JOIN r ON r.id = other GROUP BY 1)
       SELECT n.id AS c_custkey, round(avg(o.lrd) / any_value(l.lrd), 4) AS lof FROM n JOIN l ON l.id = n.id JOIN l o ON o.id = n.other GROUP BY 1"""
)
def lof_customers(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    return rounded(anomaly.local_outlier_factor(df, "c_custkey", ["x", "y"], k=10), 4)


@query()
def iforest_flags(spark, sf_dir):
    scored = anomaly.isolation_forest(read(spark, sf_dir, "lineitem").withColumn("key", F.xxhash64("l_orderkey", "l_linenumber")), "key", ["l_quantity", "l_extendedprice", "l_discount"])
    return rounded(anomaly.flag_top(scored, "score", 0.05))


def _flagged(spark, sf_dir):
    df = read(spark, sf_dir, "events").select(
        "event_id", "event_type", (F.col("value") > 50).alias("high"), (F.col("user_id") % 10 == 0).alias("odd_user"), (F.hour("ts") < 3).alias("night")
    )
    return anomaly.consensus(df, ["high", "odd_user", "night"], 2)


_FLAGGED = """f AS (SELECT event_id, event_type, value > 50 AS high, user_id % 10 = 0 AS odd_user, hour(ts) < 3 AS night FROM events),
  v AS (SELECT *, high::INT + odd_user::INT + night::INT AS consensus_score, high::INT + odd_user::INT + night::INT >= 2 AS is_anomaly FROM f)"""


@query(f"WITH {_FLAGGED} SELECT * FROM v")
def anomaly_consensus(spark, sf_dir):
    return _flagged(spark, sf_dir)


@query(
    "WITH "
    + _FLAGGED
    + " UNION ALL ".join(
        [""]
        + [f"SELECT '{'consensus' if c == 'is_anomaly' else c}' AS method, sum({c}::INT)::BIGINT AS n_anomalies, round(100.0::DOUBLE * sum({c}::INT) / count(*), 6) AS pct FROM v" for c in ("high", "odd_user", "night", "is_anomaly")]
    ).removeprefix(" UNION ALL")
)
def anomaly_methods(spark, sf_dir):
    return rounded(anomaly.compare_methods(_flagged(spark, sf_dir), ["high", "odd_user", "night"]))


@query(f"WITH {_FLAGGED} SELECT event_type, count(*) AS \"count\", round(avg(consensus_score), 6) AS avg_consensus FROM v WHERE is_anomaly GROUP BY 1")
def anomaly_report(spark, sf_dir):
    return rounded(anomaly.report(_flagged(spark, sf_dir), ["event_type"]))


# Models.


@query(
    """SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem"""
)
def linreg_closed_form(spark, sf_dir):
    m = models.linear_regression(read(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity"])
    return rounded(spark.range(1).select(F.lit(m.coefficients["l_quantity"]).alias("slope"), F.lit(m.intercept).alias("intercept")), 4)


@query(
    """WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, avg(l_quantity) AS a FROM lineitem)
       SELECT 'l_quantity' AS feature, round(avg(abs((l_quantity - a) * b)), 3) AS importance FROM lineitem, m"""
)
def shap_linear_importance(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    return rounded(models.linear_regression(df, "l_extendedprice", ["l_quantity"]).importance(df), 3)


_NB = """e AS (SELECT greatest(var_pop(p_size), var_pop(p_retailprice)) * 1e-9 AS eps, count(*) AS t FROM part),
  nb AS (SELECT p_type AS label, count(*)::DOUBLE / any_value(t) AS prior, avg(p_size) AS mean_p_size, avg(p_retailprice) AS mean_p_retailprice,
    var_pop(p_size) + any_value(eps) AS var_p_size, var_pop(p_retailprice) + any_value(eps) AS var_p_retailprice FROM part, e GROUP BY 1)"""


@query(f"WITH {_NB} SELECT label, round(prior, 4) AS prior, round(mean_p_size, 4) AS mean_p_size, round(mean_p_retailprice, 4) AS mean_p_retailprice, round(var_p_size, 4) AS var_p_size, round(var_p_retailprice, 4) AS var_p_retailprice FROM nb")
def gaussian_nb_params(spark, sf_dir):
    return rounded(models.gaussian_nb(read(spark, sf_dir, "part"), "p_type", ["p_size", "p_retailprice"]), 4)


@query(
    f"""WITH {_NB}, s AS (SELECT p_partkey, label, ln(prior) - 0.5 * ln(6.283185307179586 * var_p_size) - pow(p_size - mean_p_size, 2) / (2 * var_p_size)
          - 0.5 * ln(6.283185307179586 * var_p_retailprice) - pow(p_retailprice - mean_p_retailprice, 2) / (2 * var_p_retailprice) AS ll FROM part, nb)
        SELECT p_partkey, arg_max(label, ll) AS prediction FROM s GROUP BY 1"""
)
def gaussian_nb_predict(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    features = ["p_size", "p_retailprice"]
    return models.gaussian_nb_predict(part, models.gaussian_nb(part, "p_type", features), "p_partkey", features)


@query("SELECT doc_id, lang, round((SELECT count(*) FROM documents)::DOUBLE / ((SELECT count(DISTINCT lang) FROM documents) * count(*) OVER (PARTITION BY lang)), 6) AS weight FROM documents")
def sample_weights(spark, sf_dir):
    return rounded(models.sample_weights(read(spark, sf_dir, "documents").select("doc_id", "lang"), "lang"))


@query(
    """WITH p AS (SELECT c_custkey AS id, c_custkey / (SELECT max(c_custkey) FROM customer)::DOUBLE / 10 AS p FROM customer),
       r AS (SELECT *, row_number() OVER (ORDER BY p) AS rank, count(*) OVER () AS m FROM p)
       SELECT id, round(p, 6) AS p, rank::INT AS rank, rank <= coalesce((SELECT max(rank) FROM r WHERE p <= rank / m::DOUBLE * 0.05), 0) AS rejected FROM r"""
)
def bh_fdr(spark, sf_dir):
    customer = read(spark, sf_dir, "customer")
    top = customer.agg(F.max("c_custkey").alias("m"))
    df = customer.join(F.broadcast(top), F.lit(True)).select(F.col("c_custkey").alias("id"), (F.col("c_custkey") / F.col("m") / 10).alias("p"))
    return rounded(models.bh_reject(df, "p"))


_PHI = [("high", "odd_user"), ("high", "night"), ("odd_user", "night")]


@query(
    f"WITH {_FLAGGED} "
    + " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}::INT, {b}::INT), 6) AS phi FROM v" for a, b in _PHI)
)
def phi_boolean_pairs(spark, sf_dir):
    return rounded(models.phi_pairs(_flagged(spark, sf_dir), ["high", "odd_user", "night"]))


@query(
    """SELECT l_orderkey, l_linenumber, round((l_discount * 10 + l_tax * 12.5 + l_quantity / 50) / 3, 6) AS probability,
              ((l_discount * 10 + l_tax * 12.5 + l_quantity / 50) / 3 >= 0.5)::INT AS prediction FROM lineitem"""
)
def soft_vote(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("a"), (F.col("l_tax") * 12.5).alias("b"), (F.col("l_quantity") / 50).alias("c"))
    return rounded(models.soft_vote(df, ["a", "b", "c"]).drop("a", "b", "c"))


@query()
def kmeans_clusters(spark, sf_dir):
    return models.cluster(read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], 4)


@query()
def gbt_regression(spark, sf_dir):
    df = read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type", "p_retailprice")
    fitted = models.train(df, "p_retailprice", ["p_size", "p_type"], "gbt_regressor", maxIter=5)
    return rounded(fitted.transform(df).select("p_partkey", "prediction"))


@query()
def rf_classification(spark, sf_dir):
    df = _judged(spark, sf_dir).select("doc_id", "n_chars", "lang", "y_true")
    fitted = models.train(df, "y_true", ["n_chars", "lang"], "random_forest_classifier", "classification", numTrees=10)
    return fitted.transform(df).select("doc_id", "prediction")


# Text and embeddings.

_WORDS = r"unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> ''))"


@query(
    f"""WITH t AS (SELECT item_id, {_WORDS} AS term FROM benchmark), c AS (SELECT item_id, term, count(*) AS tf FROM t GROUP BY ALL),
        d AS (SELECT term, count(*) AS df FROM c GROUP BY 1), n AS (SELECT count(*) AS n FROM benchmark)
        SELECT item_id, term, tf, df, round(ln((1 + n)::DOUBLE / (1 + df)) + 1, 6) AS idf, round(tf * (ln((1 + n)::DOUBLE / (1 + df)) + 1), 6) AS tf_idf FROM c JOIN d USING (term), n"""
)
def tfidf_terms(spark, sf_dir):
    return rounded(text.tf_idf(read(spark, sf_dir, "benchmark"), "item_id", "text"))


_UNIT = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM embeddings)"""


@query(
    f"""WITH {_UNIT}, p AS (SELECT a.label = b.label AS same, 1 - list_dot_product(a.u, b.u) AS d FROM v a JOIN v b ON a.vec_id < b.vec_id)
        SELECT count(*) AS n_pairs, round(avg(CASE WHEN same THEN d * d ELSE pow(greatest(0, 1 - d), 2) END), 6) AS contrastive,
               round(pow(avg(d) FILTER (WHERE same), 2) + pow(avg(greatest(0, 1 - d)) FILTER (WHERE NOT same), 2), 6) AS backbone FROM p"""
)
def contrastive_loss_all_pairs(spark, sf_dir):
    return rounded(text.pair_losses(read(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding"))


@query(
    f"""WITH {_UNIT}, p AS (SELECT a.vec_id, a.label = b.label AS same, list_dot_product(a.u, b.u) / 0.07 AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id),
        k AS (SELECT vec_id, ln(sum(exp(s))) AS lse, avg(s) FILTER (WHERE same) AS pos FROM p GROUP BY 1)
        SELECT round(avg(lse - pos), 5) AS loss FROM k WHERE pos IS NOT NULL"""
)
def infonce_embeddings(spark, sf_dir):
    return rounded(text.info_nce(read(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding"), 5)


@query(
    f"""WITH {_UNIT}, x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
        m AS (SELECT label, i, avg(x) AS x FROM x GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY 1),
        s AS (SELECT v.vec_id, c.label, list_dot_product(u, c) / sqrt(list_dot_product(c, c)) AS confidence FROM v, c),
        r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY confidence DESC, label) AS rank FROM s)
        SELECT vec_id, rank::INT AS rank, label, round(confidence, 5) AS confidence FROM r WHERE rank <= 3"""
)
def nn_label_topk(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    return rounded(text.nearest_labels(vectors, "vec_id", "embedding", text.label_centroids(vectors, "label", "embedding"), 3), 5)


@query("SELECT lang AS label, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY 1")
def label_frequencies(spark, sf_dir):
    return rounded(text.label_frequencies(read(spark, sf_dir, "documents"), "lang"))


# Selection.


@query("SELECT lang, source, n, rank() OVER (PARTITION BY lang ORDER BY n) + (count(*) OVER (PARTITION BY lang, n) - 1) / 2.0::DOUBLE AS rank FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL)")
def average_ranks(spark, sf_dir):
    counts = read(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return selection.average_rank(counts, ["lang"], "n")


@query(
    """WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)
       SELECT l_orderkey, l_linenumber, l_extendedprice AS observed, round(a + b * l_quantity, 3) AS predicted, round(l_extendedprice - a - b * l_quantity, 3) AS residual FROM lineitem, m"""
)
def residuals(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    found = models.linear_regression(df, "l_extendedprice", ["l_quantity"]).predict(df, "predicted")
    return rounded(found.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("observed"), "predicted", (F.col("l_extendedprice") - F.col("predicted")).alias("residual")), 3)


@query(
    f"""WITH {_FLAGGED} SELECT count(*) FILTER (WHERE high AND night) AS both_flags, count(*) FILTER (WHERE high AND NOT night) AS left_only,
        count(*) FILTER (WHERE NOT high AND night) AS right_only, count(*) FILTER (WHERE NOT high AND NOT night) AS neither FROM v"""
)
def contingency_table(spark, sf_dir):
    a, b, c, d = selection.contingency(_flagged(spark, sf_dir), "high", "night")
    return spark.range(1).select(F.lit(a).alias("both_flags"), F.lit(b).alias("left_only"), F.lit(c).alias("right_only"), F.lit(d).alias("neither"))


@query(f"SELECT count(*) AS n, count(*) FILTER (WHERE {draw_sql('doc_id', "'split'", 42)} < 0.2) AS n_held_out, true AS accurate FROM documents")
def text_classifier(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = selection.text_classifier(docs, "doc_id", "text", "lang")
    right = F.avg(F.when(F.col("held_out"), (F.col("prediction") == F.col("label")).cast("double")))
    return found.agg(F.count("*").alias("n"), F.count_if("held_out").alias("n_held_out"), (right > 0.8).alias("accurate"))


@query()
def text_clusters(spark, sf_dir):
    return selection.cluster_texts(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 10)


@query(
    """WITH z AS (SELECT p_partkey, (p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER () AS a,
                         (p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER () AS b FROM part)
       SELECT p_partkey, round(pow(a - sign((SELECT corr(a, b) FROM z)) * b, 2) / 2, 6) AS error FROM z"""
)
def reconstruction_errors(spark, sf_dir):
    found = selection.reconstruction_errors(read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])
    return rounded(found.select("p_partkey", "error"))


@query()
def mean_shift_clusters(spark, sf_dir):
    return selection.mean_shift(read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_custkey", ["c_acctbal"])

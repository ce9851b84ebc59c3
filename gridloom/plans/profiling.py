"""Profiling, cleaning, joins and features as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import clean as cleaning
from gridloom.operators import profile
from gridloom.operators.features import FeatureEngineer
from gridloom.functions.draws import draw_sql
from gridloom.plans.registry import query, read, rounded

NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _describe_sql(table: str, columns: dict[str, str]) -> str:
    part = (
        "SELECT '{c}' AS \"column\", '{t}' AS dtype, round(100.0 * (count(*) - count({c}))::DOUBLE / count(*), 1) AS missing_pct, "
        "count(DISTINCT {c}) AS n_unique, {stats} FROM " + table
    )
    number = "round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max, round(avg({c})::DOUBLE, 4) AS mean, round(stddev_samp({c})::DOUBLE, 4) AS std"
    nothing = "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS mean, NULL::DOUBLE AS std"
    return " UNION ALL ".join(part.format(c=c, t=t, stats=nothing if t in ("string", "timestamp_ntz") else number.format(c=c)) for c, t in columns.items())


LINEITEM = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double",
    "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}


@query(_describe_sql("lineitem", LINEITEM))
def describe_lineitem(spark, sf_dir):
    return profile.describe(read(spark, sf_dir, "lineitem"))


@query(
    """WITH c AS (
         SELECT 'o_orderstatus' AS "column", o_orderstatus AS v, count(*) AS n FROM orders GROUP BY 2
         UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2),
       r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, v) AS k FROM c)
       SELECT "column", v AS top, n FROM r WHERE k = 1"""
)
def describe_mode_orders(spark, sf_dir):
    return profile.modes(read(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


def _holed(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    return events.select(
        "event_id",
        F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("value")).alias("value"),
        F.when(F.col("event_id") % 11 == 0, None).otherwise(F.col("event_type")).alias("event_type"),
        "user_id",
    )


_HOLED = "(SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS event_type, user_id FROM events)"


@query(
    f"""WITH h AS {_HOLED}
        SELECT * FROM (
          SELECT 'value' AS "column", count(*) - count(value) AS missing_count, round(100.0::DOUBLE * (count(*) - count(value)) / count(*), 2) AS missing_pct FROM h
          UNION ALL
          SELECT 'event_type', count(*) - count(event_type), round(100.0::DOUBLE * (count(*) - count(event_type)) / count(*), 2) FROM h)
        WHERE missing_count > 0"""
)
def quality_missing_events(spark, sf_dir):
    return profile.missing(_holed(spark, sf_dir))


_CUSTOMER = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query(
    "WITH u AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique, count(*) AS n FROM customer" for c in _CUSTOMER)
    + """) SELECT "column", n_unique, round(n_unique::DOUBLE / n, 4) AS uniqueness_ratio,
           CASE WHEN n_unique::DOUBLE / n > 0.95 THEN 'near-unique' WHEN n_unique <= 2 THEN 'binary'
                WHEN n_unique <= 10 THEN 'low-cardinality' ELSE '' END AS flag FROM u"""
)
def quality_cardinality_customer(spark, sf_dir):
    return profile.cardinality(read(spark, sf_dir, "customer"), list(_CUSTOMER))


@query(
    """SELECT "column" FROM (
         SELECT 'one' AS "column", count(DISTINCT 1) AS n FROM nation
         UNION ALL SELECT 'n_name', count(DISTINCT n_name) FROM nation
         UNION ALL SELECT 'n_regionkey', count(DISTINCT n_regionkey) FROM nation
         UNION ALL SELECT 'nothing', count(DISTINCT NULL::INT) FROM nation) WHERE n <= 1"""
)
def quality_constants(spark, sf_dir):
    nation = read(spark, sf_dir, "nation").select(F.lit(1).alias("one"), "n_name", "n_regionkey", F.lit(None).cast("int").alias("nothing"))
    return profile.constants(nation)


@query(
    """WITH g AS (SELECT count(*) AS c FROM lineitem GROUP BY l_quantity, l_discount, l_tax, l_returnflag)
       SELECT sum(c)::BIGINT AS n_rows, sum(c - 1)::BIGINT AS n_duplicates, round(100.0::DOUBLE * sum(c - 1) / sum(c), 2) AS duplicate_pct FROM g"""
)
def quality_duplicates(spark, sf_dir):
    return profile.duplicates(read(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag"))


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "net"]


def _pairs_sql(threshold: str) -> str:
    pairs = [(a, b) for i, a in enumerate(_CORR) for b in _CORR[i + 1 :]]
    inner = " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", corr({a}, {b}) AS r FROM n" for a, b in pairs)
    return (
        "WITH n AS (SELECT l_quantity, l_extendedprice, l_discount, l_extendedprice * (1 - l_discount) AS net FROM lineitem) "
        f'SELECT "left", "right", round(r, 4) AS correlation FROM ({inner}) {threshold}'
    )


def _with_net(spark, sf_dir):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return read(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", net.alias("net"))


@query(_pairs_sql("WHERE abs(r) >= 0.95"))
def quality_correlations_lineitem(spark, sf_dir):
    return profile.correlations(_with_net(spark, sf_dir))


@query(_pairs_sql(""))
def correlation_matrix(spark, sf_dir):
    return profile.correlations(_with_net(spark, sf_dir), threshold=None)


@query(
    """SELECT 'text' AS "column", 'categorical' AS inferred FROM documents GROUP BY 1
       UNION ALL SELECT 'day', CASE WHEN bool_or(regexp_matches(strftime(o_orderdate, '%Y-%m-%d'), '^\\d{4}-\\d{2}-\\d{2}')) THEN 'datetime (string)' END FROM orders
       UNION ALL SELECT 'key', CASE WHEN bool_and(regexp_matches(o_orderkey::VARCHAR, '^\\d+\\.?\\d*$')) THEN 'numeric (string)' END FROM orders"""
)
def type_inference_documents(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderkey").cast("string").alias("key"))
    return profile.infer_text_types(read(spark, sf_dir, "documents").select("text")).union(profile.infer_text_types(orders))


@query(
    "WITH r AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", corr({c}, l_extendedprice) AS r FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber"))
    + """) SELECT "column", round(r, 6) AS correlation FROM r ORDER BY abs(r) DESC, "column" LIMIT 3"""
)
def feature_selection_lineitem(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_linenumber", "l_extendedprice")
    return profile.rank_features(df, "l_extendedprice", 3)


@query(
    f"""SELECT count(*) AS n_rows, 4 AS n_cols, 3 AS n_numeric, 1 AS n_categorical, 0 AS n_datetime,
              (2 * count(*) - count(value) - count(event_type))::BIGINT AS missing_total FROM {_HOLED}"""
)
def eda_overview(spark, sf_dir):
    return profile.overview(_holed(spark, sf_dir))


@query(
    "WITH q AS ("
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS "count", count(*) - count({c}) AS null_count, round(avg({c})::DOUBLE, 6) AS mean, round(stddev_samp({c})::DOUBLE, 6) AS std,
            round(min({c})::DOUBLE, 6) AS min, round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q25, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS q50,
            round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q75, round(max({c})::DOUBLE, 6) AS max FROM h"""
        for c in ("value", "user_id")
    ).join([f"SELECT * FROM (WITH h AS {_HOLED} ", ")"])
    + ") SELECT * FROM q"
)
def eda_describe(spark, sf_dir):
    return profile.eda(_holed(spark, sf_dir), ["value", "user_id"])


@query(
    """WITH c AS (SELECT 'p_brand' AS "column", p_brand AS v, count(*) AS n FROM part GROUP BY 2
                  UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2),
       k AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY v) AS k FROM c)
       SELECT "column", sum(n)::BIGINT AS non_null, 0.0::DOUBLE AS missing_pct, count(*) AS n_unique,
              string_agg(v, ', ' ORDER BY v) FILTER (WHERE k <= 3) AS sample FROM k GROUP BY 1"""
)
def summary_stats(spark, sf_dir):
    return profile.summary_table(read(spark, sf_dir, "part"), ["p_brand", "p_type"])


def _clean_sql(table: str, columns: list[str], keys: str) -> str:
    steps, last = [f"s0 AS (SELECT DISTINCT {keys} FROM {table})"], "s0"
    for i, c in enumerate(columns):
        steps.append(f"s{i + 1} AS (SELECT * FROM {last} WHERE abs(({c} - (SELECT avg({c}) FROM {last})) / (SELECT stddev_samp({c}) FROM {last})) < 3.0)")
        last = f"s{i + 1}"
    return f"WITH {', '.join(steps)} SELECT * FROM {last}"


@query(_clean_sql("events", ["event_id", "user_id", "value"], "event_id, user_id, value"))
def clean_zscore_events(spark, sf_dir):
    return cleaning.clean(read(spark, sf_dir, "events").select("event_id", "user_id", "value"))


@query(_clean_sql("documents", ["n_chars"], "lang, source, n_chars"))
def clean_zscore_documents(spark, sf_dir):
    return cleaning.clean(read(spark, sf_dir, "documents").select("lang", "source", "n_chars"))


@query("SELECT lang, source, min(doc_id) AS doc_id, min_by(n_chars, doc_id) AS n_chars FROM documents GROUP BY lang, source")
def dedupe_keep_first(spark, sf_dir):
    return cleaning.keep_first(read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), ["lang", "source"], "doc_id")


def _sides(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return docs, read(spark, sf_dir, "labels").select("doc_id", "quality", F.col("toxic").alias("lang"))


_DOCS, _LABELS = "(SELECT doc_id, lang, n_chars FROM documents)", "(SELECT doc_id, quality, toxic AS lang FROM labels)"
for _how, _join in (("inner", "JOIN"), ("left", "LEFT JOIN")):
    query(f"SELECT doc_id, l.lang, n_chars, quality, r.lang AS lang_right FROM {_DOCS} l {_join} {_LABELS} r USING (doc_id)", f"join_{_how}")(
        lambda spark, sf_dir, how=_how: cleaning.integrate(*_sides(spark, sf_dir), "doc_id", how)
    )
for _how in ("right", "full"):  # the right side has rows of its own
    query(f"SELECT doc_id, l.lang, quality, r.lang AS lang_right, n_chars FROM {_LABELS} l {_how.upper()} JOIN {_DOCS} r USING (doc_id)", f"join_{_how}")(
        lambda spark, sf_dir, how=_how: cleaning.integrate(*_sides(spark, sf_dir)[::-1], "doc_id", how)
    )
for _how, _not in (("semi", ""), ("anti", "NOT ")):
    query(f"SELECT l.* FROM {_DOCS} l WHERE {_not}EXISTS (SELECT 1 FROM labels r WHERE r.doc_id = l.doc_id)", f"join_{_how}")(
        lambda spark, sf_dir, how=_how: cleaning.integrate(*_sides(spark, sf_dir), "doc_id", how)
    )


@query("SELECT r_regionkey, r_name, n_name FROM region, nation")
def join_cross(spark, sf_dir):
    region = read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return cleaning.integrate(region, read(spark, sf_dir, "nation").select("n_name"), None, "cross")


@query("SELECT event_id, value, round(ln(1 + value), 6) AS value_log FROM events")
def fe_log1p(spark, sf_dir):
    df = read(spark, sf_dir, "events").select("event_id", "value")
    return rounded(FeatureEngineer(interactions=False).fit_transform(df))


@query(
    """SELECT o_orderkey, year(o_orderdate) AS o_orderdate_year, month(o_orderdate) AS o_orderdate_month, isodow(o_orderdate) AS o_orderdate_day_of_week,
              (CASE WHEN isodow(o_orderdate) >= 6 THEN 1 ELSE 0 END)::TINYINT AS o_orderdate_is_weekend, quarter(o_orderdate) AS o_orderdate_quarter FROM orders"""
)
def fe_dates(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return FeatureEngineer(interactions=False, log_transform=False).fit_transform(df)


@query(
    """SELECT l_orderkey, l_linenumber, l_quantity, round(l_orderkey * l_linenumber, 6)::BIGINT AS l_orderkey_x_l_linenumber,
              round(l_orderkey * l_quantity, 6) AS l_orderkey_x_l_quantity, round(l_linenumber * l_quantity, 6) AS l_linenumber_x_l_quantity FROM lineitem"""
)
def fe_interactions(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return rounded(FeatureEngineer(log_transform=False).fit_transform(df))


@query(
    """WITH m AS (SELECT p_name, avg(p_retailprice) AS e FROM part GROUP BY p_name)
       SELECT p_partkey, p_type, p_retailprice, round(e, 6) AS p_name_target_enc FROM part JOIN m USING (p_name)"""
)
def fe_target_encode(spark, sf_dir):
    df = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_retailprice")
    return rounded(FeatureEngineer(interactions=False, log_transform=False).fit_transform(df, "p_retailprice"))


@query(
    """WITH e AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM events)
       SELECT event_id, value, CASE WHEN value <= a THEN 1 WHEN value <= b THEN 2 WHEN value <= c THEN 3 ELSE 4 END AS bin_rank FROM events, e"""
)
def fe_bins(spark, sf_dir):
    df = read(spark, sf_dir, "events").select("event_id", "value")
    engineer = FeatureEngineer(interactions=False, log_transform=False, auto_bin=True, n_bins=4)
    model = engineer.fit(df.select("value"))
    rank = F.array_position(F.lit(_labels(model.edges["value"])), F.col("value_bin")).cast("int")
    return model.transform(df).select("event_id", "value", rank.alias("bin_rank"))


def _labels(edges: list[float]) -> list[str]:
    names = ["-inf", *(f"{e:g}" for e in edges[1:-1]), "inf"]
    return [f"({a}, {b}]" for a, b in zip(names, names[1:])]


@query(
    """SELECT lang, count(*) AS n, sum(CASE WHEN rk / (greatest(t, 2) - 1)::DOUBLE < 0.2 THEN 1 ELSE 0 END)::BIGINT AS n_test
       FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS rk, count(*) OVER (PARTITION BY lang) AS t FROM documents) GROUP BY lang"""
)
def split_stratified_sizes(spark, sf_dir):
    docs = cleaning.split(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", by="lang")
    return docs.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.col("is_test").cast("int")).alias("n_test"))


@query(f"SELECT doc_id, floor(5 * {draw_sql('doc_id', "'fold'", 42)})::INT AS fold FROM documents")
def kfold_assignment(spark, sf_dir):
    return cleaning.folds(read(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(spark, sf_dir):
    return cleaning.integrate(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "anti").distinct()

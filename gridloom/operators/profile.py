"""Profiling and data quality: statistics of all columns in few aggregations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.quantiles import quantiles
from gridloom.roles import ColumnRoles, require


def _long(one_row: DataFrame, rows: list[dict[str, Column]]) -> DataFrame:
    """An aggregate of one row turned into a row for each dict of columns."""
    return one_row.select(F.inline(F.array(*(F.struct(*(c.alias(k) for k, c in r.items())) for r in rows))))


def value_counts(df: DataFrame, columns: list[str] | tuple[str, ...]) -> DataFrame:
    """``column, value, n`` of all non-null values as text, in one shuffle with map-side counts.

    Many exact distinct counts in one aggregate would repeat every row for each of them up to the
    reduce side; here a value travels once for each task.
    """
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns))
    return df.select(F.inline(cells)).where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))


def distinct_counts(df: DataFrame, columns: list[str] | tuple[str, ...], approximate: bool = False) -> DataFrame:
    """``column, n_unique`` of non-null values; columns without any are absent (exact) or 0."""
    if approximate:
        one = df.agg(*(F.approx_count_distinct(c).alias(c) for c in columns))
        return _long(one, [{"column": F.lit(c), "n_unique": F.col(c)} for c in columns])
    return value_counts(df, columns).groupBy("column").agg(F.count("*").alias("n_unique"))


def basic_stats(df: DataFrame, columns: list[str] | None = None, digits: int = 4) -> DataFrame:
    """``column, dtype, n_rows, missing, min, max, mean, std``: one aggregation over the table.

    Only numeric columns have the last four; the deviation is the sample's.
    """
    columns = df.columns if columns is None else columns
    numeric = set(ColumnRoles.of(df).numeric)
    aggs = [F.count("*").alias("n_")]
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`")
        aggs.append(F.count(x).alias(f"n_{i}"))
        if c in numeric:
            d = x.cast("double")
            aggs += [F.min(d).alias(f"lo_{i}"), F.max(d).alias(f"hi_{i}"), F.avg(d).alias(f"m_{i}"), F.stddev_samp(d).alias(f"s_{i}")]
    types = dict(df.dtypes)
    empty = F.lit(None).cast("double")
    rows = [
        {
            "column": F.lit(c),
            "dtype": F.lit(types[c]),
            "n_rows": F.col("n_"),
            "missing": F.col("n_") - F.col(f"n_{i}"),
            **{
                name: F.round(F.col(f"{short}_{i}"), digits) if c in numeric else empty
                for name, short in (("min", "lo"), ("max", "hi"), ("mean", "m"), ("std", "s"))
            },
        }
        for i, c in enumerate(columns)
    ]
    return _long(df.agg(*aggs), rows)


def describe(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """Type, missing share, distinct values and, for numbers, range, mean and deviation of each column."""
    columns = df.columns if columns is None else columns
    stats = basic_stats(df, columns)
    unique = distinct_counts(df, columns, approximate)
    return stats.join(F.broadcast(unique), "column", "left").select(
        "column",
        "dtype",
        F.round(F.try_divide(100.0 * F.col("missing"), F.col("n_rows")), 1).alias("missing_pct"),
        F.coalesce("n_unique", F.lit(0)).alias("n_unique"),
        "min",
        "max",
        "mean",
        "std",
    )


def modes(df: DataFrame, columns: list[str], below: int = 50) -> DataFrame:
    """``column, top, n``: the most frequent value, the least among equals, of columns with few values."""
    counts = value_counts(df, columns)
    few = counts.groupBy("column").agg(F.count("*").alias("k"), F.max(F.struct("n")).alias("m")).where(F.col("k") < below)
    return (
        counts.join(F.broadcast(few), "column")
        .where(F.col("n") == F.col("m.n"))
        .groupBy("column")
        .agg(F.min("value").alias("top"), F.first("n").alias("n"))
    )


def missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, missing_count, missing_pct`` of columns with a null."""
    columns = df.columns if columns is None else columns
    one = df.agg(F.count("*").alias("n_"), *(F.count(f"`{c}`").alias(f"n_{i}") for i, c in enumerate(columns)))
    rows = [{"column": F.lit(c), "missing_count": F.col("n_") - F.col(f"n_{i}"), "n": F.col("n_")} for i, c in enumerate(columns)]
    return (
        _long(one, rows)
        .where("missing_count > 0")
        .select("column", "missing_count", F.round(F.try_divide(100.0 * F.col("missing_count"), F.col("n")), 2).alias("missing_pct"))
    )


def cardinality(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """``column, n_unique, uniqueness_ratio, flag``: near-unique, binary, low-cardinality or nothing."""
    columns = df.columns if columns is None else columns
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    total = df.agg(F.count("*").alias("n_rows"))
    ratio = F.try_divide(F.col("n_unique").cast("double"), F.col("n_rows"))
    return (
        names.join(F.broadcast(distinct_counts(df, columns, approximate)), "column", "left")
        .fillna(0, ["n_unique"])
        .join(F.broadcast(total), F.lit(True))
        .select(
            "column",
            "n_unique",
            F.round(ratio, 4).alias("uniqueness_ratio"),
            F.when(ratio > 0.95, "near-unique")
            .when(F.col("n_unique") <= 2, "binary")
            .when(F.col("n_unique") <= 10, "low-cardinality")
            .otherwise("")
            .alias("flag"),
        )
    )


def constants(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Columns with at most one distinct non-null value: least equals greatest, no distinct count."""
    columns = df.columns if columns is None else columns
    one = df.agg(*(F.coalesce(F.min(f"`{c}`") == F.max(f"`{c}`"), F.lit(True)).alias(f"c_{i}") for i, c in enumerate(columns)))
    return _long(one, [{"column": F.lit(c), "constant": F.col(f"c_{i}")} for i, c in enumerate(columns)]).where("constant").select("column")


def duplicates(df: DataFrame) -> DataFrame:
    """``n_rows, n_duplicates, duplicate_pct``: rows beyond the first of each group of equal rows."""
    return (
        df.groupBy(*df.columns)
        .agg(F.count("*").alias("copies_"))
        .agg(F.coalesce(F.sum("copies_"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("copies_") - 1), F.lit(0)).alias("n_duplicates"))
        .withColumn("duplicate_pct", F.round(F.try_divide(100.0 * F.col("n_duplicates"), F.col("n_rows")), 2))
    )


def correlations(df: DataFrame, columns: list[str] | None = None, threshold: float | None = 0.95) -> DataFrame:
    """``left, right, correlation`` of each pair of numeric columns over rows where both are present.

    All pairs are one aggregation. ``threshold`` keeps those as strong; None keeps all.
    """
    columns = list(ColumnRoles.of(df).numeric) if columns is None else columns
    pairs = list(combinations(columns, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "left string, right string, correlation double")
    one = df.agg(*(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r_{i}") for i, (a, b) in enumerate(pairs)))
    found = _long(one, [{"left": F.lit(a), "right": F.lit(b), "r": F.col(f"r_{i}")} for i, (a, b) in enumerate(pairs)])
    if threshold is not None:
        found = found.where(F.abs("r") >= threshold)
    return found.select("left", "right", F.round("r", 4).alias("correlation"))


def infer_text_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, inferred``: what the text of a column looks like, over all its values.

    Any value that starts as a date makes it a date; else all values being numbers makes it numeric.
    """
    columns = list(ColumnRoles.of(df).text) if columns is None else columns
    one = df.agg(
        *(F.bool_or(F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}")).alias(f"d_{i}") for i, c in enumerate(columns)),
        *(F.bool_and(F.col(c).rlike(r"^\d+\.?\d*$")).alias(f"n_{i}") for i, c in enumerate(columns)),
    )
    kind = lambda i: F.when(F.col(f"d_{i}"), "datetime (string)").when(F.col(f"n_{i}"), "numeric (string)").otherwise("categorical")
    return _long(one, [{"column": F.lit(c), "inferred": kind(i)} for i, c in enumerate(columns)])


def overview(df: DataFrame) -> DataFrame:
    """One row: rows, columns, numbers of numeric, text and temporal columns, missing cells."""
    roles = ColumnRoles.of(df)
    nulls = [F.count("*") - F.count(f"`{c}`") for c in df.columns]
    return df.agg(F.count("*").alias("n_rows"), sum(nulls[1:], nulls[0]).alias("missing_total")).select(
        "n_rows",
        F.lit(len(df.columns)).alias("n_cols"),
        F.lit(len(roles.numeric)).alias("n_numeric"),
        F.lit(len(roles.text)).alias("n_categorical"),
        F.lit(len(roles.temporal)).alias("n_datetime"),
        "missing_total",
    )


def eda(df: DataFrame, columns: list[str] | None = None, accuracy: int | None = None) -> DataFrame:
    """Count, nulls, mean, deviation and quartiles (interpolated, or approximate with ``accuracy``) of numeric columns."""
    columns = list(ColumnRoles.of(df).numeric) if columns is None else columns
    aggs = [F.count("*").alias("n_")]
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n_{i}"), F.avg(x).alias(f"m_{i}"), F.stddev_samp(x).alias(f"s_{i}")]
        aggs.append(quantiles(x, (0.0, 0.25, 0.5, 0.75, 1.0), accuracy).alias(f"q_{i}"))
    rows = [
        {
            "column": F.lit(c),
            "count": F.col(f"n_{i}"),
            "null_count": F.col("n_") - F.col(f"n_{i}"),
            "mean": F.round(f"m_{i}", 6),
            "std": F.round(f"s_{i}", 6),
            **{n: F.round(F.get(F.col(f"q_{i}"), F.lit(k)), 6) for k, n in enumerate(("min", "q25", "q50", "q75", "max"))},
        }
        for i, c in enumerate(columns)
    ]
    return _long(df.agg(*aggs), rows)


def rank_features(df: DataFrame, target: str, n: int) -> DataFrame:
    """``column, correlation``: the n numeric columns most correlated with the target, by absolute value."""
    require(df, target)
    columns = [c for c in ColumnRoles.of(df).numeric if c != target]
    one = df.agg(*(F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(f"r_{i}") for i, c in enumerate(columns)))
    found = _long(one, [{"column": F.lit(c), "r": F.col(f"r_{i}")} for i, c in enumerate(columns)]).where("r is not null")
    return found.orderBy(F.abs("r").desc(), "column").limit(n).select("column", F.round("r", 6).alias("correlation"))


def summary_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, non_null, missing_pct, n_unique, sample``: sample holds the three least values as text."""
    counts = value_counts(df, columns)
    total = df.agg(F.count("*").alias("n_rows"))
    ranked = counts.withColumn("k", F.row_number().over(Window.partitionBy("column").orderBy("value")))
    sample = ranked.where("k <= 3").groupBy("column").agg(F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("sample"))
    sizes = counts.groupBy("column").agg(F.sum("n").alias("non_null"), F.count("*").alias("n_unique"))
    return (
        sizes.join(F.broadcast(sample), "column")
        .join(F.broadcast(total), F.lit(True))
        .select("column", "non_null", F.round(100.0 * (F.col("n_rows") - F.col("non_null")) / F.col("n_rows"), 2).alias("missing_pct"), "n_unique", "sample")
    )

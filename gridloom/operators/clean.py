"""Cleaning, deduplication, joins and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.errors import DataValidationError
from gridloom.functions.draws import draw
from gridloom.functions.quantiles import exact_quantiles
from gridloom.roles import ColumnRoles, nan_to_null, require

JOINS = {"inner": "inner", "left": "left", "right": "right", "full": "outer", "semi": "left_semi", "anti": "left_anti"}


def clean(
    df: DataFrame, columns: list[str] | None = None, threshold: float = 3.0, exclude: tuple[str, ...] = (),
    mode: str = "sequential", keep_nulls: bool = False,
) -> DataFrame:
    """Distinct rows within ``threshold`` sample deviations of the mean of each numeric column.

    ``sequential`` takes the columns in order, each on what the ones before left: one small
    aggregation a column. ``simultaneous`` measures all columns at once: one aggregation. Columns
    without spread are skipped; rows with a null in a column that is used go unless ``keep_nulls``.
    NaN counts as null.
    """
    if mode not in ("sequential", "simultaneous"):
        raise DataValidationError(f"unknown mode {mode!r}")
    columns = list(ColumnRoles.of(df).numeric) if columns is None else columns
    columns = [c for c in columns if c not in exclude]
    df = nan_to_null(df).distinct()

    def within(c: str, mean: float | None, deviation: float | None):
        if mean is None or not deviation:
            return None
        x = F.col(c).cast("double")
        near = F.abs((x - F.lit(mean)) / F.lit(deviation)) < threshold
        return near | x.isNull() if keep_nulls else near

    stats = lambda frame, c: (F.avg(F.col(c).cast("double")), F.stddev_samp(F.col(c).cast("double")))
    if mode == "simultaneous":
        found = df.agg(*(a for c in columns for a in stats(df, c))).first() if columns else ()
        tests = [within(c, found[2 * i], found[2 * i + 1]) for i, c in enumerate(columns)]
        for test in tests:
            df = df if test is None else df.where(test)
        return df
    whole = df.persist()
    for c in columns:
        test = within(c, *df.agg(*stats(df, c)).first())
        df = df if test is None else df.where(test)
    whole.unpersist()
    return df


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row by ``order`` of each group of equal keys, as a minimum instead of a window.

    The whole row is the least struct that begins with ``order``, so a group is reduced before the
    shuffle and no group needs sorting.
    """
    require(df, order, *keys)
    rest = [c for c in df.columns if c not in keys and c != order]
    first = F.min_by(F.struct(order, *rest), F.col(order)).alias("row_")
    return df.groupBy(*keys).agg(first).select(*keys, "row_.*").select(*df.columns)


def integrate(left: DataFrame, right: DataFrame, on: str | list[str] | None, how: str = "left") -> DataFrame:
    """Equi-join on equally named keys; null keys match nothing.

    Other columns that both sides have come out of the right side with ``_right`` added. ``full``
    has the key once, from whichever side has it. ``cross`` takes no key.
    """
    if how == "cross":
        if on is not None:
            raise DataValidationError("a cross join has no key")
        keys: list[str] = []
    else:
        if how not in JOINS:
            raise DataValidationError(f"unknown join {how!r}; one of {[*JOINS, 'cross']}")
        if on is None:
            raise DataValidationError("a join needs a key")
        keys = [on] if isinstance(on, str) else list(on)
        require(left, *keys)
        require(right, *keys)
    clash = {c: f"{c}_right" for c in right.columns if c in left.columns and c not in keys}
    right = right.withColumnsRenamed(clash)
    return left.crossJoin(right) if how == "cross" else left.join(right, keys, JOINS[how])


def split(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42, by: str | None = None) -> DataFrame:
    """``df`` with a boolean ``is_test``, by a draw from the row's key: the same rows every time.

    With ``by`` the share holds within each of its values, which are few: rows below the quantile of
    their value's draws, found without bringing a value's rows together. A null is a value.
    """
    require(df, key, *([by] if by else []))
    u = draw(key, "split", seed)
    if by is None:
        return df.withColumn("is_test", u < test_share)
    cuts = _draw_quantiles(df, by, u, [test_share])
    return cuts.withColumn("is_test", F.coalesce(u < F.get("cuts_", F.lit(0)), F.lit(False))).drop("cuts_")


def folds(df: DataFrame, key: str, k: int = 5, seed: int = 42, by: str | None = None) -> DataFrame:
    """``df`` with ``fold`` 0 to k-1 by a draw from the key; no shuffle.

    With ``by`` each of its values, which are few, is dealt to the folds evenly, by quantiles of its draws.
    """
    if k < 2:
        raise DataValidationError("at least two folds")
    require(df, key, *([by] if by else []))
    u = draw(key, "fold", seed)
    if by is None:
        return df.withColumn("fold", F.floor(u * k).cast("int"))
    cuts = _draw_quantiles(df, by, u, [i / k for i in range(1, k)])
    return cuts.withColumn("fold", F.size(F.filter("cuts_", lambda c: c <= u)).cast("int")).drop("cuts_")


def _draw_quantiles(df: DataFrame, by: str, u: Column, at: list[float]) -> DataFrame:
    """``df`` with ``cuts_``: quantiles of the draws of the row's value of ``by``; a null is a value."""
    value = F.to_json(F.struct(F.col(by).cast("string").alias("v")))
    counts = df.groupBy(value.alias("g"), u.alias("x")).agg(F.count("*").alias("n")).persist()
    found = exact_quantiles(counts, "g", "x", "n", at)
    counts.unpersist()
    cuts = df.sparkSession.createDataFrame(list(found.items()), "g_ string, cuts_ array<double>")
    return df.join(F.broadcast(cuts), value == F.col("g_"), "left").drop("g_")


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, those with the least draw from the key."""
    return df.orderBy(draw(key, "sample", seed), key).limit(n)

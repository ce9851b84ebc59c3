"""Evaluation of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.roles import require


def regression(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """One row ``n, mse, rmse, mae, r2``; r2 is null where the truth has no spread."""
    require(df, y_true, y_pred)
    y, e = F.col(y_true).cast("double"), F.col(y_true).cast("double") - F.col(y_pred).cast("double")
    pairs = df.where(F.col(y_true).isNotNull() & F.col(y_pred).isNotNull())
    one = pairs.agg(F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("v"))
    return one.select("n", "mse", F.sqrt("mse").alias("rmse"), "mae", (1 - F.try_divide(F.col("mse"), F.col("v"))).alias("r2"))


def mape(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """One row ``mape`` in percent, with 1e-8 added to the truth."""
    y = F.col(y_true).cast("double")
    return df.agg((100 * F.avg(F.abs((y - F.col(y_pred)) / (y + 1e-8)))).alias("mape"))


def confusion(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """``y_true, y_pred, n`` of the pairs that occur."""
    require(df, y_true, y_pred)
    return df.groupBy(F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred")).agg(F.count("*").alias("n"))


def classification_report(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """``label, precision, recall, f1, support`` of each label on either side; 0 where undefined."""
    cells = confusion(df, y_true, y_pred).select(
        F.inline(
            F.array(
                F.struct(F.col("y_true").alias("label"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("said"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("hit")),
                F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("said"), F.lit(0).cast("long").alias("hit")),
            )
        )
    )
    by = cells.groupBy("label").agg(F.sum("actual").alias("support"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return by.select("label", share("hit", "said").alias("precision"), share("hit", "support").alias("recall"), F.coalesce(F.try_divide(2.0 * F.col("hit"), F.col("said") + F.col("support")), F.lit(0.0)).alias("f1"), "support")


def classification(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """One row ``accuracy, f1_weighted, precision_weighted, recall_weighted``."""
    report = classification_report(df, y_true, y_pred)
    mean = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")), F.lit(0.0))
    return report.agg(
        mean("recall").alias("accuracy"), mean("f1").alias("f1_weighted"), mean("precision").alias("precision_weighted"), mean("recall").alias("recall_weighted")
    )


def comparison(df: DataFrame, metric: str, baseline: str, compared: list[str], higher_is_better: bool = True) -> DataFrame:
    """``metric, model, baseline, value, delta, delta_pct, direction`` of each compared column."""
    cells = F.array(*(F.struct(F.lit(c).alias("model"), F.col(c).cast("double").alias("value")) for c in compared))
    rows = df.select(F.col(metric).alias("metric"), F.col(baseline).cast("double").alias("baseline"), F.inline(cells))
    delta = F.col("value") - F.col("baseline")
    better = delta > 0 if higher_is_better else delta < 0
    return rows.select(
        "*", delta.alias("delta"), (100 * F.try_divide(delta, F.abs("baseline"))).alias("delta_pct"),
        F.when(delta == 0, "same").when(better, "better").otherwise("worse").alias("direction"),
    )

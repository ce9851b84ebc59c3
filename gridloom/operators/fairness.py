"""Group fairness from one grouped pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.roles import require


def group_rates(df: DataFrame, y_true: str, y_pred: str, group: str, positive=1) -> DataFrame:
    """``grp, n, selection_rate, tpr, fpr``: a row for each group; null groups are "null".

    Groups without positives (negatives) have a true (false) positive rate of 0.
    """
    require(df, y_true, y_pred, group)
    selected, actual = F.col(y_pred) == F.lit(positive), F.col(y_true) == F.lit(positive)
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    return df.groupBy(F.coalesce(F.col(group).cast("string"), F.lit("null")).alias("grp")).agg(
        F.count("*").alias("n"),
        F.avg(one(selected)).alias("selection_rate"),
        F.coalesce(F.avg(F.when(actual, one(selected))), F.lit(0.0)).alias("tpr"),
        F.coalesce(F.avg(F.when(~actual, one(selected))), F.lit(0.0)).alias("fpr"),
    )


def _ratio(low, high):
    return F.when(high == 0, 0.0).otherwise(low / high)


def metrics(rates: DataFrame) -> DataFrame:
    """``metric, value, fair`` of the group rates: five measures from one aggregation.

    Parity and impact are fair at a ratio of 0.8 or more, odds and opportunity at gaps under 0.1.
    With one group the impact ratio is 1.
    """
    one = rates.agg(
        F.count("*").alias("groups"),
        *(f(c).alias(f"{n}_{c}") for c in ("selection_rate", "tpr", "fpr") for n, f in (("lo", F.min), ("hi", F.max))),
    )
    parity = _ratio(F.col("lo_selection_rate"), F.col("hi_selection_rate"))
    impact = F.when((F.col("groups") < 2) | (F.col("hi_selection_rate") == 0), 1.0).otherwise(parity)
    tpr, fpr = F.col("hi_tpr") - F.col("lo_tpr"), F.col("hi_fpr") - F.col("lo_fpr")
    rows = [
        ("demographic_parity_ratio", parity, parity >= 0.8),
        ("equalized_odds_tpr_diff", tpr, (tpr < 0.1) & (fpr < 0.1)),
        ("equalized_odds_fpr_diff", fpr, (tpr < 0.1) & (fpr < 0.1)),
        ("disparate_impact_ratio", impact, impact >= 0.8),
        ("equal_opportunity_diff", tpr, tpr < 0.1),
    ]
    return one.select(F.inline(F.array(*(F.struct(F.lit(n).alias("metric"), v.alias("value"), f.alias("fair")) for n, v, f in rows))))


def disparate_impact(rates: DataFrame) -> DataFrame:
    """``grp, impact``: each group's selection rate over the highest, 1 if that is 0."""
    top = rates.agg(F.max("selection_rate").alias("top"))
    return rates.join(F.broadcast(top), F.lit(True)).select(
        "grp", F.when(F.col("top") == 0, 1.0).otherwise(F.col("selection_rate") / F.col("top")).alias("impact")
    )

"""Quantiles: as aggregates, or from counts that are cumulated over ranges of values."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of a group's values that are cumulated side by side.
RANGES = 64


def quantiles(x: Column, at: Sequence[float], accuracy: int | None = None) -> Column:
    """An array of quantiles with linear interpolation, or approximate ones of relative error 1 / accuracy.

    The exact aggregate holds a count of every distinct value, which is fine for millions of them;
    the approximate one holds a sketch of bounded size. ``exact_quantiles`` has no such limit.
    """
    points = F.array(*(F.lit(float(q)) for q in at))
    return F.percentile(x, points) if accuracy is None else F.percentile_approx(x, points, accuracy)


def median_of(sorted_values: Column) -> Column:
    """Median of a sorted array."""
    n = F.size(sorted_values)
    low, high = F.get(sorted_values, F.floor((n - 1) / 2).cast("int")), F.get(sorted_values, F.floor(n / 2).cast("int"))
    return (low + high) / 2


def cumulate(counts: DataFrame, group: str, x: str, columns: Sequence[str]) -> DataFrame:
    """``counts`` (a row for each group and value) with ``{c}_upto`` and ``{c}_total`` for each column.

    Values are dealt to ranges whose bounds, approximate quantiles, are fixed beforehand; sums run
    within a range, and over the ranges' totals. No task sees all values of a group; groups are few.
    """
    points = F.array(*(F.lit(i / RANGES) for i in range(1, RANGES)))
    bounds = counts.groupBy(group).agg(F.percentile_approx(x, points, 1000).alias("bounds_"))
    bounds = counts.sparkSession.createDataFrame(bounds.collect(), bounds.schema)
    part = F.size(F.filter("bounds_", lambda b: b < F.col(x)))
    ranged = counts.join(F.broadcast(bounds), group).withColumn("part_", part).drop("bounds_")
    sums = ranged.groupBy(group, "part_").agg(*(F.sum(c).alias(f"{c}_s_") for c in columns))
    before = Window.partitionBy(group).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        group, "part_",
        *(F.coalesce(F.sum(f"{c}_s_").over(before), F.lit(0)).alias(f"{c}_b_") for c in columns),
        *(F.sum(f"{c}_s_").over(Window.partitionBy(group)).alias(f"{c}_total") for c in columns),
    )
    within = Window.partitionBy(group, "part_").orderBy(x)
    upto = [(F.col(f"{c}_b_") + F.sum(c).over(within)).alias(f"{c}_upto") for c in columns]
    wide = ranged.join(F.broadcast(sums), [group, "part_"])  # a row for each group and range
    return wide.select(group, x, *columns, *upto, *(f"{c}_total" for c in columns))


def exact_quantiles(counts: DataFrame, group: str, x: str, n: str, at: Sequence[float]) -> dict[object, list[float]]:
    """Quantiles with linear interpolation of each group, from numbers ``n`` of equal values; any size."""
    place = lambda q: F.lit(float(q)) * (F.col(f"{n}_total") - 1)
    ranks = F.array_distinct(F.array(*(f(place(q)).cast("long") for q in at for f in (F.floor, F.ceil))))
    here = F.filter("ranks_", lambda r: (r >= F.col(f"{n}_upto") - F.col(n)) & (r < F.col(f"{n}_upto")))
    found = cumulate(counts.where(F.col(n) > 0), group, x, [n]).withColumn("ranks_", ranks)
    rows = found.select(group, x, f"{n}_total", F.explode(here).alias("rank_")).collect()
    values: dict[object, dict[int, float]] = {}
    totals: dict[object, int] = {}
    for g, v, total, rank in rows:
        values.setdefault(g, {})[rank] = v
        totals[g] = total
    out = {}
    for g, by_rank in values.items():
        out[g] = []
        for q in at:
            p = q * (totals[g] - 1)
            a, b = by_rank[math.floor(p)], by_rank[math.ceil(p)]
            out[g].append(a + (b - a) * (p - math.floor(p)))
    return out

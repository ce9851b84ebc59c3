"""Data behind charts: grouped, binned and stacked in Spark, small enough to draw."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.joins import join_groups
from gridloom.functions.quantiles import quantiles


def convex_hull(xs, ys) -> list[tuple[float, float]]:
    """Corners against the clock from the least, by the monotone chain."""
    pts = sorted(set(zip(map(float, xs), map(float, ys))))
    if len(pts) < 3:
        return pts

    def half(seq) -> list:
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return half(pts) + half(reversed(pts))


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """``bin, lo, hi, n, mean, variance, cumulative``: equal bins, the last closed; empty bins count 0.

    ``cumulative`` is scaled so that its end equals the largest count.
    """
    x = F.col(value).cast("double")
    span = df.agg(F.min(x).alias("a"), F.max(x).alias("b"))
    width = (F.col("b") - F.col("a")) / bins
    at = F.when(F.col("b") == F.col("a"), 0).otherwise(F.least(F.floor((F.col("x") - F.col("a")) / width), F.lit(bins - 1))).cast("int")
    counts = (
        df.select(x.alias("x")).where("x is not null").join(F.broadcast(span), F.lit(True)).select(at.alias("bin"), "x")
        .groupBy("bin").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("variance"))
    )
    spine = span.select("a", width.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = spine.join(F.broadcast(counts), "bin", "left").fillna(0, ["n"])
    running = F.sum("n").over(Window.orderBy("bin"))
    whole = Window.partitionBy()
    return out.select(
        "bin", (F.col("a") + F.col("bin") * F.col("w")).alias("lo"), (F.col("a") + (F.col("bin") + 1) * F.col("w")).alias("hi"),
        "n", "mean", "variance", (running * F.max("n").over(whole) / F.sum("n").over(whole)).alias("cumulative"),
    )


def box_stats(df: DataFrame, group: str, value: str, accuracy: int | None = None) -> DataFrame:
    """``group, n, q1, median, q3, low, high``: whiskers are the last values within 1.5 ranges of the quartiles."""
    x = F.col(value).cast("double")
    q = df.groupBy(group).agg(quantiles(x, (0.25, 0.5, 0.75), accuracy).alias("q"), F.count(x).alias("n"))
    q = q.select(group, "n", *(F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q1", "median", "q3"))))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = df.select(group, x.alias("x")).join(F.broadcast(q), group).where((F.col("x") >= F.col("q1") - reach) & (F.col("x") <= F.col("q3") + reach))
    return inside.groupBy(group, "n", "q1", "median", "q3").agg(F.min("x").alias("low"), F.max("x").alias("high"))


def density(df: DataFrame, group: str, value: str, points: int = 50) -> DataFrame:
    """``group, x, density``: Gaussian kernel density on a grid, Scott's bandwidth.

    Each value adds to every grid point of its group; sums are made before the shuffle.
    """
    v = F.col(value).cast("double")
    stats = df.groupBy(group).agg(F.count(v).alias("n"), F.stddev_samp(v).alias("s"), F.min(v).alias("a"), F.max(v).alias("b"))
    stats = stats.withColumn("h", F.col("s") * F.pow("n", F.lit(-0.2))).where("h > 0")
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    spread = df.select(group, v.alias("v")).where("v is not null").join(F.broadcast(stats), group).select("*", grid.alias("i"))
    x = F.col("a") + F.col("i") * (F.col("b") - F.col("a")) / (points - 1)
    u = (x - F.col("v")) / F.col("h")
    kernel = F.exp(-u * u / 2) / (F.col("n") * F.col("h") * 2.5066282746310002)
    return spread.groupBy(group, "i", x.alias("x")).agg(F.sum(kernel).alias("density")).drop("i")


def density_2d(df: DataFrame, x: str, y: str, points: int = 20) -> DataFrame:
    """``i, j, x, y, density``: Gaussian kernel density on a grid, Scott's bandwidth in each direction.

    Each row adds to every grid point; sums are made before the shuffle. Rows with a null are left out.
    """
    rows = df.select(F.col(x).cast("double").alias("u"), F.col(y).cast("double").alias("v")).na.drop()
    span = [f(c).alias(f"{n}{c}") for c in ("u", "v") for n, f in (("a", F.min), ("b", F.max), ("s", F.stddev_samp))]
    one = rows.agg(F.count("*").alias("n"), *span)
    one = one.select("*", *((F.col(f"s{c}") * F.pow("n", F.lit(-1 / 6))).alias(f"h{c}") for c in ("u", "v"))).where("hu > 0 and hv > 0")
    steps = F.sequence(F.lit(0), F.lit(points - 1))
    grid = one.select("*", F.explode(steps).alias("i")).select("*", F.explode(steps).alias("j"))
    at = lambda c, k: F.col(f"a{c}") + F.col(k) * (F.col(f"b{c}") - F.col(f"a{c}")) / (points - 1)
    grid = grid.select("i", "j", at("u", "i").alias("x"), at("v", "j").alias("y"), "hu", "hv", "n")
    p, q = (F.col("x") - F.col("u")) / F.col("hu"), (F.col("y") - F.col("v")) / F.col("hv")
    kernel = F.exp(-(p * p + q * q) / 2) / (F.col("n") * F.col("hu") * F.col("hv") * 6.283185307179586)
    return rows.join(F.broadcast(grid), F.lit(True)).groupBy("i", "j", "x", "y").agg(F.sum(kernel).alias("density"))


def hull(df: DataFrame, x: str, y: str, group: str | None = None) -> DataFrame:
    """``group, at, x, y``: corners of each group's convex hull, against the clock from the least.

    The hull of all points is that of the parts' hulls: each batch gives its corners alone, of which
    there are few, and those of a group meet in one task. Rows with a null coordinate are left out.
    """
    name = F.lit("all") if group is None else F.col(group).cast("string")
    rows = df.select(name.alias("group"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).na.drop(subset=["x", "y"])

    def corners(frame: pd.DataFrame) -> pd.DataFrame:
        found = convex_hull(frame["x"].to_numpy(), frame["y"].to_numpy())
        return pd.DataFrame({"group": [frame["group"].iloc[0]] * len(found), "at": range(len(found)), "x": [p[0] for p in found], "y": [p[1] for p in found]})

    def parts(frames):
        for frame in frames:
            found = [corners(part) for _, part in frame.groupby("group", dropna=False)]
            if found:
                yield pd.concat(found)[["group", "x", "y"]]

    few = rows.mapInPandas(parts, "group string, x double, y double")
    return few.groupBy("group").applyInPandas(corners, "group string, at int, x double, y double")


def hexbin(df: DataFrame, x: str, y: str, gridsize: int = 20) -> DataFrame:
    """``hx, hy, n``: centres, in units of the range, of the hexagons that hold points."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    span = df.agg(F.min(a).alias("xa"), F.max(a).alias("xb"), F.min(b).alias("ya"), F.max(b).alias("yb"))
    ny = max(1, round(gridsize / 3**0.5))
    u = F.coalesce(F.try_divide((a - F.col("xa")) * gridsize, F.col("xb") - F.col("xa")), F.lit(0.0))
    v = F.coalesce(F.try_divide((b - F.col("ya")) * ny, F.col("yb") - F.col("ya")), F.lit(0.0))
    placed = df.where(a.isNotNull() & b.isNotNull()).join(F.broadcast(span), F.lit(True)).select(u.alias("u"), v.alias("v"))
    i, j = F.floor(F.col("u") + 0.5), F.floor(F.col("v") + 0.5)
    k, m = F.floor("u") + 0.5, F.floor("v") + 0.5
    near = (F.col("u") - i) ** 2 + 3 * (F.col("v") - j) ** 2 < (F.col("u") - k) ** 2 + 3 * (F.col("v") - m) ** 2
    cell = placed.select(F.when(near, i.cast("double")).otherwise(k).alias("hx"), F.when(near, j.cast("double")).otherwise(m).alias("hy"))
    return cell.groupBy("hx", "hy").agg(F.count("*").alias("n"))


def node_totals(edges: DataFrame, source: str = "source", target: str = "target", value: str = "value") -> DataFrame:
    """``node, outgoing, incoming, total`` of a weighted graph, in one aggregation."""
    ends = F.array(
        F.struct(F.col(source).alias("node"), F.col(value).cast("double").alias("o"), F.lit(0.0).alias("i")),
        F.struct(F.col(target).alias("node"), F.lit(0.0).alias("o"), F.col(value).cast("double").alias("i")),
    )
    sums = edges.select(F.inline(ends)).groupBy("node").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))
    return sums.withColumn("total", F.col("outgoing") + F.col("incoming"))


def roll_up(leaves: DataFrame, path: list[str], value: str) -> DataFrame:
    """``path, depth, value`` of every node of a hierarchy of fixed depth, the root being depth 0."""
    parts = [F.col(c).cast("string") for c in path]
    prefixes = F.array(*(F.struct(F.lit(d).alias("depth"), F.concat_ws("/", *parts[:d]).alias("path")) for d in range(len(path) + 1)))
    sums = leaves.groupBy(*path).agg(F.sum(value).alias("v_"))
    return sums.select(F.inline(prefixes), "v_").groupBy("depth", "path").agg(F.sum("v_").alias("value"))


def fill_slots(df: DataFrame, n: int, slot: str = "slot", value: str = "value", fill: float = 0.0) -> DataFrame:
    """Slots 0 to n - 1: missing ones filled, later ones left out."""
    spine = df.sparkSession.range(n).select(F.col("id").alias(slot))
    return spine.join(F.broadcast(df.where(F.col(slot).between(0, n - 1))), slot, "left").select(slot, F.coalesce(value, F.lit(fill)).alias(value))


def index_to(df: DataFrame, series: str, value: str, baseline: float = 100.0) -> DataFrame:
    """``index``: the value over its series' mean times the baseline, 0 where the mean is 0."""
    means = df.groupBy(series).agg(F.avg(value).alias("m_"))
    scaled = join_groups(df, means, series)
    return scaled.withColumn("index", F.when(F.col("m_") == 0, 0.0).otherwise(F.col(value) / F.col("m_") * baseline)).drop("m_")


def stack_share(df: DataFrame, slot: str, value: str) -> DataFrame:
    """``share``: percent of the slot's total, 0 where that is not positive."""
    total = F.sum(value).over(Window.partitionBy(slot))
    return df.withColumn("share", F.when(total <= 0, 0.0).otherwise(100.0 * F.col(value) / total))


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled to 0 to 1; constant ones become 0."""
    one = df.agg(*(f(c).cast("double").alias(f"{n}_{c}_") for c in columns for n, f in (("a", F.min), ("b", F.max))))
    scale = {c: F.coalesce(F.try_divide(F.col(c) - F.col(f"a_{c}_"), F.col(f"b_{c}_") - F.col(f"a_{c}_")), F.lit(0.0)) for c in columns}
    wide = df.join(F.broadcast(one), F.lit(True))
    return wide.select(*(scale[c].alias(c) if c in scale else F.col(c) for c in df.columns))


def bubble_size(df: DataFrame, value: str, most: float = 1000.0) -> DataFrame:
    """``size``: the value over the greatest, times ``most``."""
    top = df.agg(F.max(value).alias("top_"))
    return df.join(F.broadcast(top), F.lit(True)).withColumn("size", F.try_divide(F.col(value) * most, F.col("top_"))).drop("top_")


def horizon_bands(df: DataFrame, pos: str, value: str, bands: int = 3) -> DataFrame:
    """``pos, band, positive, negative``: the part of the value that falls into each band."""
    top = df.agg((F.max(F.abs(value)) / bands).alias("b_"))
    wide = df.join(F.broadcast(top), F.lit(True)).select(pos, value, "b_", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"))
    part = lambda v: F.least(F.greatest(v, F.col("band") * F.col("b_")), (F.col("band") + 1) * F.col("b_")) - F.col("band") * F.col("b_")
    return wide.select(pos, "band", part(F.col(value)).alias("positive"), part(-F.col(value)).alias("negative"))


def stream_layers(df: DataFrame, x: str, series: str, value: str) -> DataFrame:
    """``x, series, y0, y1``: layers stacked around a symmetric baseline."""
    w = Window.partitionBy(x)
    upto = F.sum(value).over(w.orderBy(series).rowsBetween(Window.unboundedPreceding, 0))
    half = F.sum(value).over(w) / 2
    return df.select(x, series, (upto - F.col(value) - half).alias("y0"), (upto - half).alias("y1"))


def bump_ranks(df: DataFrame, period: str, value: str) -> DataFrame:
    """``rank`` of the value within its period, the greatest first."""
    return df.withColumn("rank", F.rank().over(Window.partitionBy(period).orderBy(F.desc(value))))

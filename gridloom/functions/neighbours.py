"""The k nearest rows of each row, exactly, from boxes of points instead of all pairs."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import joins
from gridloom.session import keep

#: Rows that a task looks up together, and distances that it holds.
MOST_ROWS, MOST_DISTANCES = 100_000, 2_000_000
#: Queries of a block, and leaves of a group.
BLOCK, GROUP = 128, 32


def _squares(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of all pairs, and for each row of ``y`` what rounding may have changed."""
    if y.shape[1] <= 8:
        d = (y[:, :1] - x[:, 0]) ** 2
        for i in range(1, y.shape[1]):
            d += (y[:, i : i + 1] - x[:, i]) ** 2
        return d, np.zeros(len(y))
    yy, xx = (y * y).sum(axis=1), (x * x).sum(axis=1)
    return yy[:, None] + xx - 2 * y @ x.T, 1e-9 * (yy + xx.max(initial=0))


def _gaps(lo: np.ndarray, hi: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of boxes from boxes."""
    return (np.maximum(0, np.maximum(lo - high[:, None], low[:, None] - hi)) ** 2).sum(axis=2)


class Leaves:
    """Points in order of their key, dealt to leaves by halving the widest side; each leaf has a box."""

    def __init__(self, x: np.ndarray, k: int):
        size = max(BLOCK, 4 * k)
        order, side, cut, child, leaf, starts = np.arange(len(x)), [-1], [0.0], [0], [0], []
        todo = [(0, 0, len(x))]
        while todo:
            at, lo, hi = todo.pop()
            if hi - lo <= size:
                leaf[at] = len(starts)
                starts.append(lo)
                continue
            part = order[lo:hi]
            p = x[part]
            s, mid = int(np.argmax(p.max(axis=0) - p.min(axis=0))), (hi - lo) // 2
            value = np.partition(p[:, s], mid)[mid]
            left = p[:, s] < value
            if abs((p[:, s] <= value).sum() - mid) < mid - left.sum():
                value = np.nextafter(value, np.inf)
                left = p[:, s] < value
            if size // 4 <= left.sum() <= hi - lo - size // 4:  # equal values stay together
                by, mid = np.argsort(~left, kind="stable"), int(left.sum())
            else:
                by = np.argpartition(p[:, s], mid)
                value = p[by[mid], s]
            order[lo:hi] = part[by]
            side[at], cut[at], child[at] = s, value, len(side)
            todo += [(len(side) + 1, lo + mid, hi), (len(side), lo, lo + mid)]
            for column, value in ((side, -1), (cut, 0.0), (child, 0), (leaf, 0)):
                column += [value, value]
        self.x, self.order, self.starts = x, order, np.array([*starts, len(x)])
        self.side, self.cut, self.child, self.leaf = map(np.array, (side, cut, child, leaf))
        if len(x):
            self.lo, self.hi = np.minimum.reduceat(x[order], starts), np.maximum.reduceat(x[order], starts)
            groups = np.arange(0, len(starts), GROUP)
            self.group_lo, self.group_hi = np.minimum.reduceat(self.lo, groups), np.maximum.reduceat(self.hi, groups)

    def home(self, y: np.ndarray) -> np.ndarray:
        """The leaf where each row of ``y`` would lie."""
        at, rows = np.zeros(len(y), np.int64), np.arange(len(y))
        while True:
            s = self.side[at]
            inner = s >= 0
            if not inner.any():
                return self.leaf[at]
            step = self.child[at] + (y[rows, s] >= self.cut[at])
            at = np.where(inner, step, at)

    def _places(self, leaves: np.ndarray) -> np.ndarray:
        first, sizes = self.starts[leaves], self.starts[leaves + 1] - self.starts[leaves]
        skipped = np.cumsum(sizes) - sizes
        return np.sort(self.order[np.repeat(first - skipped, sizes) + np.arange(sizes.sum())])

    def nearest(self, y: np.ndarray, home: np.ndarray, k: int, root: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row of ``y`` its k nearest points: row, place and distance, nearest first, equal ones by place.

        Points of the rows' own leaves bound the distances; only leaves whose box lies within a row's
        bound are looked at then. Distances are squared unless ``root`` is set, and ordered as given.
        """
        near = self._places(np.unique(home))
        d, slack = _squares(y, self.x[near])
        bound = np.partition(d, k - 1, axis=1)[:, k - 1] if len(near) >= k else np.full(len(y), np.inf)
        bound = bound * (1 + 1e-9) + slack
        return self._within(y, home, bound, k, root)

    def _within(self, y: np.ndarray, home: np.ndarray, bound: np.ndarray, k: int, root: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # Rows lie in order of their leaves: first what is near any row of a leaf, then what is near a row.
        each = np.flatnonzero(np.r_[True, home[1:] != home[:-1]])
        low, high, most = np.minimum.reduceat(y, each), np.maximum.reduceat(y, each), np.maximum.reduceat(bound, each)[:, None]
        groups = np.flatnonzero((_gaps(self.group_lo, self.group_hi, low, high) <= most).any(axis=0))
        leaves = (groups[:, None] * GROUP + np.arange(GROUP)).ravel()
        leaves = leaves[leaves < len(self.lo)]
        leaves = leaves[(_gaps(self.lo[leaves], self.hi[leaves], low, high) <= most).any(axis=0)]
        wide = len(y) * len(leaves) > MOST_DISTANCES
        if not wide:
            gap = np.zeros((len(y), len(leaves)))
            for i in range(y.shape[1]):
                gap += np.maximum(0, np.maximum(self.lo[leaves, i] - y[:, i : i + 1], y[:, i : i + 1] - self.hi[leaves, i])) ** 2
            leaves = leaves[(gap <= bound[:, None]).any(axis=0)]
            wide = len(y) * (self.starts[leaves + 1] - self.starts[leaves]).sum() > MOST_DISTANCES
        if wide and len(y) > 1:  # rows of like bounds together, so that a far row widens few others' search
            by = np.argsort(bound, kind="stable")
            found = []
            for half in (np.sort(by[: len(y) // 2]), np.sort(by[len(y) // 2 :])):
                q, at, d = self._within(y[half], home[half], bound[half], k, root)
                found.append((half[q], at, d))
            q, at, d = (np.concatenate(c) for c in zip(*found))
            order = np.argsort(q, kind="stable")
            return q[order], at[order], d[order]
        near = self._places(leaves)
        x = self.x[near]
        d, slack = _squares(y, x)
        q, at = np.nonzero(d <= (bound + slack)[:, None])
        exact = ((y[q] - x[at]) ** 2).sum(axis=1)
        exact = np.sqrt(exact) if root else exact
        fine = np.isfinite(exact)
        q, at, exact = q[fine], at[fine], exact[fine]
        order = np.lexsort((at, exact, q))
        q, at, exact = q[order], at[order], exact[order]
        first = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[first], near[at[first]], exact[first]


def _look(sent, names: list[str], k: int, same: bool, root: bool):
    """A map of rows ``id, x0, ...`` to their nearest points: the row's id, the point's columns ``names``, ``d``."""

    def search(leaves: Leaves, points: pa.Table, ids: pa.Array, y: np.ndarray):
        # Equal rows are looked up once.
        order = np.lexsort(y.T)
        new = np.ones(len(y), bool)
        new[1:] = (y[order[1:]] != y[order[:-1]]).any(axis=1)
        u, of = y[order[new]], np.cumsum(new) - 1
        home = leaves.home(u)
        by = np.argsort(home, kind="stable")
        u, home = u[by], home[by]
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        of = rank[of]
        again = np.argsort(of, kind="stable")
        order, of = order[again], of[again]
        known = points.column("id").to_numpy() if same else None
        own = ids.to_numpy(zero_copy_only=False) if same else None
        for lo in range(0, len(u), BLOCK):
            q, at, d = leaves.nearest(u[lo : lo + BLOCK], home[lo : lo + BLOCK], k + same, root)
            a, b = np.searchsorted(of, (lo, lo + BLOCK))
            mine, row = of[a:b] - lo, order[a:b]
            first, last = np.searchsorted(q, mine), np.searchsorted(q, mine, "right")
            n = last - first
            take = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            nth = np.repeat(np.arange(len(row)), n)
            if same:
                other = known[at[take]] != own[row[nth]]
                take, nth = take[other], nth[other]
                few = np.arange(len(nth)) - np.searchsorted(nth, nth) < k
                take, nth = take[few], nth[few]
            yield row[nth], at[take], d[take]

    def made(points: pa.Table, ids: pa.Array, parts: list) -> pa.RecordBatch:
        row, at, d = (np.concatenate(c) for c in zip(*parts))
        at = pa.array(at)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(row)), *(points.column(c).take(at).combine_chunks() for c in names), pa.array(d)], names=["id_", *names, "d"])

    def whole(leaves, points, batches):
        table = pa.Table.from_batches(batches)
        ids = table.column(0).combine_chunks()
        parts, n = [], 0
        for part in search(leaves, points, ids, np.column_stack([table.column(i).to_numpy() for i in range(1, table.num_columns)])):
            parts.append(part)
            n += len(part[0])
            if n > MOST_ROWS:
                yield made(points, ids, parts)
                parts, n = [], 0
        if parts:
            yield made(points, ids, parts)

    def run(batches):
        leaves, points = sent.value
        held, n = [], 0
        for batch in batches if len(leaves.x) else ():
            held.append(batch)
            n += batch.num_rows
            if n >= MOST_ROWS:
                yield from whole(leaves, points, held)
                held, n = [], 0
        if n:
            yield from whole(leaves, points, held)

    return run


def nearest_rows(asked: DataFrame, known: DataFrame, k: int, same: bool = False, root: bool = False) -> DataFrame:
    """``id_`` and ``d``, beside the columns of ``known`` but its coordinates: the k nearest rows of ``known`` for each row of ``asked``.

    Both have ``id`` and the coordinates ``x0, x1, ...``, none of them null; ``known`` may have more columns.
    Distances are Euclidean, squared unless ``root`` is set, and equal ones in order of ``id``. With
    ``same`` a row is not its own neighbour. Rows that are not finite have no neighbours and are none.

    Of equal points only the k (and one more with ``same``) of least id can be among the k nearest of
    any row, so no more are sent. The points come to the tasks as ``Leaves``, up to ``joins.CHUNK_BYTES`` at a
    time. Beyond that they are cut into slabs along a coordinate: a row looks at its own slab, and then
    only at those within the distance of its k-th neighbour there.
    """
    spark = asked.sparkSession
    xs = [c for c in asked.columns if c != "id"]
    names = [c for c in known.columns if c not in xs]
    finite = reduce(lambda a, b: a & b, (F.abs(c) < float("inf") for c in xs))
    copy = F.row_number().over(Window.partitionBy(*xs).orderBy("id"))
    known = known.where(finite).withColumn("copy_", copy).where(F.col("copy_") <= k + same).drop("copy_").persist()
    most = joins.CHUNK_BYTES // (8 * (len(xs) + len(names) + 2))
    kinds = {f.name: f.dataType.simpleString() for f in known.schema}
    schema = ", ".join([f"id_ {asked.schema['id'].dataType.simpleString()}", *(f"`{c}` {kinds[c]}" for c in names), "d double"])
    asked = asked.where(finite)
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(asked.count() / MOST_ROWS))

    def sent(part: DataFrame):
        points = part.toArrow().sort_by("id")
        x = np.column_stack([points.column(c).to_numpy() for c in xs]).astype(float)
        return spark.sparkContext.broadcast((Leaves(x, k + same), points.select(names)))

    def looked(rows: DataFrame, chunk) -> DataFrame:
        return rows.select("id", *xs).repartition(tasks, "id").mapInArrow(_look(chunk, names, k, same, root), schema)

    n = known.count()
    if n <= most:
        near = looked(asked, sent(known))
        known.unpersist()
        return near

    # The coordinate with the most values is cut into slabs of about equal size.
    wide = max(xs, key=lambda c: known.agg(F.approx_count_distinct(c)).first()[0])
    slabs = math.ceil(1.2 * n / most)
    cuts = sorted(set(known.approxQuantile(wide, [i / slabs for i in range(1, slabs)], 0.1 / slabs)))
    edges = [-math.inf, *cuts, math.inf]
    slab = sum(((F.col(wide) >= c).cast("int") for c in cuts), F.lit(0))
    sizes = dict(known.groupBy(slab.alias("slab")).count().collect())
    chunks = []
    for i in range(len(cuts) + 1):
        m = math.ceil(sizes.get(i, 0) / most)  # more than one where many points share a value
        chunks += [(i, sent(known.where((slab == i) & (F.pmod(F.xxhash64("id"), F.lit(m)) == j)))) for j in range(m)]
    known.unpersist()
    asked = keep(asked.repartition(tasks, "id"))
    place = F.row_number().over(Window.partitionBy("id_").orderBy("d", "id"))
    best = lambda parts: reduce(DataFrame.union, parts).withColumn("place_", place).where(F.col("place_") <= k).drop("place_")
    own = keep(best([looked(asked.where(slab == i), chunk) for i, chunk in chunks]))
    far = own.groupBy("id_").agg(F.count("*").alias("n_"), F.max("d").alias("far_"))
    bound = F.when(F.col("n_") >= k, F.col("far_") if root else F.sqrt("far_")).otherwise(float("inf")) * (1 + 1e-9)
    rows = keep(asked.join(far.withColumnRenamed("id_", "id"), "id", "left").select(*asked.columns, F.coalesce(bound, F.lit(float("inf"))).alias("bound_")))
    gap = lambda i: F.greatest(F.lit(edges[i]) - F.col(wide), F.col(wide) - F.lit(edges[i + 1]))
    rest = [looked(rows.where((slab != i) & (gap(i) <= F.col("bound_"))), chunk) for i, chunk in chunks]
    return best([own, *rest])

"""Joins of rows with their group's statistics, and of each row with all rows in blocks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of the rows that are sent to the tasks at a time.
CHUNK_BYTES = 64_000_000


def join_groups(df: DataFrame, stats: DataFrame, *keys: str, how: str = "left") -> DataFrame:
    """``df`` with the other columns of ``stats``, which has a row for each group; a null key is a group.

    No side is marked for broadcast: the sizes at run time decide.
    """
    there = [f"{k}_group_" for k in keys]
    renamed = stats.withColumnsRenamed(dict(zip(keys, there)))
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(t)) for k, t in zip(keys, there)))
    return df.join(renamed, on, how).drop(*there)


def against_all(
    df: DataFrame, key: str, look: Callable[[Iterator[pa.RecordBatch], pa.Table], Iterator[pa.RecordBatch]], schema: str, row_bytes: int
) -> tuple[DataFrame, int]:
    """What ``look`` makes of batches of rows and a chunk of all rows, over all chunks; and their number.

    The chunks are dealt by a hash of the key. Each is at most about ``CHUNK_BYTES`` and goes to every task,
    so memory is bounded whatever the table's size, while work is the square of it.
    """
    n = max(1, math.ceil(df.count() * row_bytes / CHUNK_BYTES))
    sc, parts = df.sparkSession.sparkContext, []
    for i in range(n):
        sent = sc.broadcast(df.where(F.pmod(F.xxhash64(key), F.lit(n)) == i).toArrow())
        parts.append(df.mapInArrow(lambda batches, sent=sent: look(batches, sent.value), schema))
    return reduce(DataFrame.union, parts), n

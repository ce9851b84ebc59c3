"""Near-duplicates: banded MinHash candidates, odd sketches, confirmation on full shingle sets."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import (
    _STEP,
    LOWER_ASCII,
    WORDS,
    SharedTables,
    column,
    focus,
    gram_hashes,
    hot_keys,
    join_split,
    list_array,
    mix64,
    prepare,
    raw_texts,
)

#: Rows that one file of an intermediate table takes.
FILE_NODES, FILE_EDGES = 100_000, 1_000_000
#: Ids up to this number are sent to the executors to select texts; more are joined by an exchange.
BROADCAST_IDS = 200_000


@dataclass(frozen=True)
class Params:
    """Texts are linked if 100 * |A & B| >= percent * |A | B| over sets of ``shingle``-word shingles.

    At a similarity s a pair shares a band with probability 1 - (1 - s**rows)**bands: at 0.8 all but
    3 in a million pairs do. Of these, odd sketches pass over those with more odd bits than a pair at
    the threshold has by ``deviations`` standard deviations, again some 3 in a million.
    """

    shingle: int = 4
    percent: int = 80
    bands: int = 32
    rows: int = 5
    bins: int = 1536  #: MinHash samples of the sketch: the least hash of each bin of hashes
    sketch_words: int = 16  #: 64-bit words of the odd sketch
    deviations: float = 4.5

    @property
    def samples(self) -> int:
        return self.bands * self.rows


def most_odd_bits(n, m, other_n, other_m, p: Params, fn):
    """XOR population count up to which two sketches may belong to a link.

    ``n`` are set sizes and ``m`` numbers of filled bins, as columns (``fn`` is the functions
    module) or numbers (numpy). A pair at the threshold t has a union of (n + n') / (1 + t), fills N
    of the bins with it and agrees in t * N of them, the more surely the fewer shingles share a bin;
    all other samples flip a bit each, and some bits twice.
    """
    t, k, bits = p.percent / 100, float(p.bins), 64.0 * p.sketch_words
    union = (n + other_n) / (1 + t)
    met = (m + other_m) / (2 * k - k * fn.exp(-n / k) - k * fn.exp(-other_n / k))
    filled = k * (1 - fn.exp(-union / k)) * met
    variance = filled * (t * (1 - t)) * (1 - filled / union) + 0.5
    flips = m + other_m - 2 * t * filled
    slope = fn.exp(-2 * flips / bits)
    expected = bits / 2 * (1 - slope)
    least = getattr(fn, "least", None) or fn.minimum
    full = fn.lit(bits**0.5 / 2) if hasattr(fn, "lit") else bits**0.5 / 2
    chance = least(fn.abs(flips) * (2 / bits) ** 0.5, full)
    return expected + p.deviations * fn.sqrt(4 * variance * slope * slope + chance * chance) + 1


def shingles(raw: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles; all words as one if there are fewer."""
    words = raw.translate(LOWER_ASCII).split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(WORDS.array(words), min(k, len(words))))


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    seed = mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seed >> np.uint64(32)).astype(np.uint32) | np.uint32(1), seed.astype(np.uint32)


def minhashes(hashes: np.ndarray, samples: int) -> np.ndarray:
    """The least value of a set under each of ``samples`` permutations of 32-bit hashes."""
    a, b = _multipliers(samples)
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(samples, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 1024):
        least = np.minimum(least, (h[at : at + 1024, None] * a + b).min(axis=0))
    return least


def band_keys(signatures: np.ndarray, p: Params) -> np.ndarray:
    """A 64-bit key of each band of each signature, the band's number included."""
    cells = signatures.reshape(-1, p.bands, p.rows).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, p.bands + 1, dtype=np.uint64), cells.shape[:2]).copy()
    for j in range(p.rows):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, j])
    return keys.view(np.int64)


def bin_samples(hashes: np.ndarray, p: Params) -> np.ndarray:
    """MinHash samples of a sorted set: the least hash of each bin that has one."""
    first = np.full(p.bins, -1, np.int64)
    bins = (mix64(hashes) % np.uint64(p.bins)).astype(np.int64)
    first[bins[::-1]] = np.arange(len(hashes) - 1, -1, -1)  # of several, the last written is the least
    return hashes[first[first >= 0]]


def odd_sketches(samples: list[np.ndarray], p: Params) -> np.ndarray:
    """Parity bitmaps: each sample of a set flips one bit of its bitmap."""
    n = 64 * p.sketch_words
    doc = np.repeat(np.arange(len(samples)), [len(x) for x in samples])
    flat = np.concatenate(samples) if samples else np.empty(0, np.uint64)
    bits = (mix64(flat ^ _STEP) % np.uint64(n)).astype(np.int64) + n * doc
    odd = (np.bincount(bits, minlength=len(samples) * n) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(len(samples), p.sketch_words)


def _signed(docs: DataFrame, p: Params) -> DataFrame:
    """``id, n, key, bands, m, o0..``: set size, its 128-bit key, band keys, filled bins and odd sketch."""

    @F.arrow_udf(
        "struct<n:long,key:binary,bands:array<long>,m:int," + ",".join(f"o{i}:long" for i in range(p.sketch_words)) + ">"
    )
    def sign(text: pa.Array) -> pa.Array:
        focus("words")
        sets = [shingles(raw, p.shingle) for raw in raw_texts(text)]
        filled = [i for i, s in enumerate(sets) if len(s)]
        bands: list[np.ndarray] = [np.empty(0, np.int64)] * len(sets)
        if filled:
            signatures = np.stack([minhashes(sets[i], p.samples) for i in filled])
            for i, keys in zip(filled, band_keys(signatures, p)):
                bands[i] = keys
        samples = [bin_samples(s, p) for s in sets]
        sketch = odd_sketches(samples, p)
        keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        return pa.StructArray.from_arrays(
            [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(keys, pa.binary()),
                list_array(bands, pa.int64()),
                pa.array([len(x) for x in samples], pa.int32()),
                *(pa.array(sketch[:, i], pa.int64()) for i in range(p.sketch_words)),
            ],
            names=["n", "key", "bands", "m", *(f"o{i}" for i in range(p.sketch_words))],
        )

    return docs.select("id", sign.asNondeterministic()("body").alias("s_")).select("id", "s_.*")


def _may_link(n, m, p: Params):
    """Sets whose sizes are further apart cannot reach the threshold."""
    return 100 * F.least(n, m) >= p.percent * F.greatest(n, m)


def _sketches_allow(a: str, b: str, p: Params):
    parts = (F.bit_count(F.col(f"{a}.o{i}").bitwiseXOR(F.col(f"{b}.o{i}"))) for i in range(p.sketch_words))
    sizes = (F.col(f"{side}.{c}").cast("double") for side in (a, b) for c in ("n", "m"))
    return reduce(add, parts) <= most_odd_bits(*sizes, p, F)


def _confirmed(pairs: DataFrame, docs: DataFrame, p: Params, tables: SharedTables) -> DataFrame:
    """Those of the pairs (a, b) that reach the threshold on full shingle sets."""
    ids = pairs.select(F.col("a").alias("id")).distinct().union(pairs.select(F.col("b").alias("id")).distinct()).distinct()
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)

    @F.arrow_udf("array<long>")
    def full_set(text: pa.Array) -> pa.Array:
        focus("words")
        return list_array([shingles(raw, p.shingle).view(np.int64) for raw in raw_texts(text)], pa.int64())

    sets = docs.join(ids, "id", "left_semi").select("id", full_set.asNondeterministic()("body").alias("set_"))
    sets = tables.keep(sets)  # both sides of the join read it
    common = F.size(F.array_intersect("x_", "y_")).cast("long")
    union = F.size("x_").cast("long") + F.size("y_") - common
    return tables.keep(
        join_split(pairs, sets.select(F.col("id").alias("a"), F.col("set_").alias("x_")), "a", "b")
        .join(sets.select(F.col("id").alias("b"), F.col("set_").alias("y_")), "b")
        .where(100 * common >= p.percent * union)
        .select("a", "b")
        .distinct()
    )


def components(links: DataFrame, tables: SharedTables, name: str) -> DataFrame:
    """``id, component`` of linked nodes: the least node reachable, by alternating stars.

    Large star hangs a node's larger neighbours under its least one, small star its smaller ones,
    until every node hangs under the least of its component. Each round is a table in the shared
    folder, which cuts its lineage; only a count, a checksum and the hot centres reach the driver.
    """

    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before, step = mark(edges), 0
    if not before[0]:
        edges = tables.save(edges, f"{name}-none", 1)
        return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    files = -(-before[0] // FILE_EDGES)  # no round has more edges than the last
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        degrees = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        least = degrees.select("u", F.least("u", "m").alias("m"))
        centres = hot_keys(degrees, "u", "n", 2 * before[0])
        hung = join_split(both, least, "u", "v", centres).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        hung = tables.save(hung, f"{name}-{step}-large", files)
        least = hung.groupBy("u").agg(F.min("v").alias("m"))
        small = hung.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = tables.save(small.union(least.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{step}", files)
        tables.drop(f"{name}-{step}-large", *([f"{name}-{step - 1}"] if step else []))
        after = mark(edges)
        if after == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before, step = after, step + 1


def near_duplicates(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id, kept``, a row for each row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased. A text with fewer words than
    a shingle is one shingle; null texts and those without words have none and are linked with
    nothing. ``component_id`` is the least id reachable over links, ``kept`` whether that is the
    row's own. Repeated rows of one id are one document; rows of one id with different texts are
    judged by their texts. Rows with a null id are judged by their
    text: they fall to a document with the same set, else their component is null and they are kept.
    An empty table gives an empty one; other columns are not read.

    Equal sets are one node, by a 128-bit key, so copies make no pairs. Candidates pass size, odd
    sketch and then full sets, in three rounds that leave out pairs already in one component: each
    node with the least of its buckets' hubs (a bucket's least member); with all its hubs; and the
    members outside their hub's component with the bucket's members of other components, by size
    and sketch inside the join. So every pair of a bucket is connected or has been compared, while a
    large group of near copies makes a few pairs for each member.
    """
    spark = docs.sparkSession
    prepare(spark)
    with SharedTables(spark, "near-duplicates") as tables:
        body = docs.select(column(id_col).alias("id"), column(text_col).alias("body"))
        return _judged(tables, body, params, id_col)


def _judged(tables: SharedTables, body: DataFrame, p: Params, id_col: str) -> DataFrame:
    sketch = ["m", *(f"o{i}" for i in range(p.sketch_words))]
    signed = tables.keep(_signed(body, p))
    total = signed.count()
    files = -(-total // FILE_NODES) or 1
    body = body.where("id is not null")
    keyed = tables.save(signed.select("id", "n", "key"), "keyed", files)
    # of the copies of a set the least id stands for all, with what the first such row carries
    copies = (
        signed.where("key is not null")
        .groupBy("key")
        .agg(F.min("id").alias("rep"), F.min_by(F.struct("n", "bands", *sketch), "id").alias("s_"), F.count("*").alias("copies"))
    )
    copies = tables.save(copies, "copies", files)  # a table, so that the plans below it stay short
    tables.release(signed)
    tables.settle()
    nodes = copies.where("rep is not null").select(F.col("rep").alias("id"), "s_.*")

    spread = nodes.select("id", "n", F.explode("bands").alias("bucket"))
    hubs = (
        spread.groupBy("bucket")
        .agg(F.count("*").alias("members"), F.min(F.struct("id", "n")).alias("hub"))
        .where("members > 1")
        .select("bucket", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n"), "members")
    )
    hubs = tables.save(hubs, "hubs", files)
    members = hubs.agg(F.sum("members")).first()[0] or 0
    crowded = join_split(spread, hubs.drop("members"), "bucket", "id", hot_keys(hubs, "bucket", "members", members))
    crowded = tables.save(crowded, "crowded", files)
    hot_hubs = hot_keys(hubs.groupBy("hub").agg(F.sum("members").alias("n")), "hub", "n", members)

    def placed(reached: DataFrame | None, name: str = "") -> DataFrame:
        """The crowded buckets' members with their component and that of their hub."""
        if reached is None:
            return crowded.select("bucket", "id", "n", "hub", "hub_n", F.col("id").alias("c"), F.col("hub").alias("hub_c"))
        found = crowded.join(reached.select("id", F.col("component").alias("c")), "id", "left")
        found = join_split(found, reached.select(F.col("id").alias("hub"), F.col("component").alias("hub_c")), "hub", "id", hot_hubs, "left")
        found = found.select("bucket", "id", "n", "hub", "hub_n", F.coalesce("c", "id").alias("c"), F.coalesce("hub_c", "hub").alias("hub_c"))
        return tables.save(found, name, files)

    def joined(pairs: DataFrame, reached: DataFrame | None, name: str) -> DataFrame:
        """Components after the links that full sets confirm among candidate pairs."""
        tables.settle()
        links = _confirmed(tables.save(pairs, f"{name}-pairs", files), body, p, tables)
        if reached is not None:
            if not links.limit(1).count():
                return reached
            links = links.union(reached.select(F.col("component").alias("a"), F.col("id").alias("b")))
        return components(links, tables, name)

    faces = nodes.select("id", "n", *sketch)

    def spokes(members: DataFrame) -> DataFrame:
        """(hub, member) in different components whose size and sketch allow a link."""
        return members.where((F.col("c") != F.col("hub_c")) & (F.col("id") != F.col("hub")) & _may_link(F.col("n"), F.col("hub_n"), p))

    def sketched(pairs: DataFrame) -> DataFrame:
        hub_faces = faces.select(F.col("id").alias("a"), F.struct("n", *sketch).alias("x"))
        return (
            join_split(pairs, hub_faces, "a", "b", hot_hubs)
            .join(faces.select(F.col("id").alias("b"), F.struct("n", *sketch).alias("y")), "b")
            .where(_sketches_allow("x", "y", p))
            .select("a", "b")
        )

    one = spokes(placed(None)).groupBy(F.col("id").alias("b")).agg(F.min("hub").alias("a"))
    reached = joined(sketched(one.select("a", "b")), None, "one")
    every = spokes(placed(reached, "placed-every")).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    reached = joined(sketched(every), reached, "every")

    settled = placed(reached, "placed-across")
    strays = settled.where("c <> hub_c")
    mixed = settled.where("id <> hub").join(strays.select("bucket").distinct(), "bucket", "left_semi")
    banded = nodes.select("id", "bands", *sketch)
    x, y = strays.join(banded, "id").alias("x"), mixed.join(banded, "id").alias("y")
    across = x.join(
        y,
        (F.col("x.bucket") == F.col("y.bucket"))
        & (F.col("x.c") != F.col("y.c"))
        & ((F.col("y.c") == F.col("y.hub_c")) | (F.col("x.id") < F.col("y.id")))
        & _may_link(F.col("x.n"), F.col("y.n"), p)
        & _sketches_allow("x", "y", p)
        # of the buckets that two nodes share, one makes the pair
        & (F.col("x.bucket") == F.array_min(F.array_intersect("x.bands", "y.bands"))),
    ).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    reached = joined(across.distinct(), reached, "across")
    reps = copies.select("key", "rep", "copies").join(reached.select(F.col("id").alias("rep"), "component"), "rep", "left")
    reps = reps.select("key", F.coalesce("component", "rep").alias("least"), "copies")
    known = join_split(keyed, reps.drop("copies"), "key", "id", hot_keys(reps, "key", "copies", total), "left")
    found = known.withColumn("component_id", F.coalesce("least", "id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull())
    found = found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))
    found = tables.save(found, "found", files)
    tables.drop(*(name for name in tuple(tables.saved) if name != "found"))
    return found


def drop_near_duplicates(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", **options) -> DataFrame:
    """The documents with one of each group of near-duplicates, with their own columns whatever their names.

    An id goes if none of its rows is kept.
    """
    found = near_duplicates(docs, params, id_col=id_col, **options)
    gone = found.where(column(id_col).isNotNull()).groupBy(column(id_col).alias("gone_")).agg(F.bool_or("kept").alias("any_")).where("not any_").select("gone_")
    if gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    whole = docs.select(F.struct(*(column(c).alias(c) for c in docs.columns)).alias("row_"), column(id_col).alias("id_"))
    kept = whole.join(gone, F.col("id_") == F.col("gone_"), "left_anti")
    return kept.select(*(F.col("row_").getField(c).alias(c) for c in docs.columns))

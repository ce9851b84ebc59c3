"""Benchmark decontamination by winnowing: fingerprints are joined and hits extended."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import ALNUM, WORDS, SharedTables, column, focus, gram_hashes, join_split, prepare, raw_texts

#: Consecutive words that make a hit; K-gram hashes, the least of each run of WINDOW - K + 1 kept,
#: so any shared run of WINDOW words shares a kept hash.
WINDOW, K = 10, 6
#: A benchmark of more bytes than this is joined through an exchange, not sent to the executors.
BROADCAST_BYTES = 8_000_000

SCHEMA = "struct<n_words:long,n_hit:long,n_items:long,items_sha256:string,spans:array<struct<first:int,words:int>>>"
_KIND = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("n_items", pa.int64()),
        ("items_sha256", pa.string()),
        ("spans", pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())]))),
    ]
)


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(ALNUM).split()


def winnow(h: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes kept: the least k-gram hash, the last of equals, of each run of window - k + 1."""
    g = gram_hashes(h, k)
    w = window - k + 1
    n = len(g) - w + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    best, at = g[:n].copy(), np.arange(n)
    for j in range(1, w):
        later = g[j : j + n]
        took = later <= best
        best = np.where(took, later, best)
        at = np.where(took, np.arange(j, j + n), at)
    places = np.unique(at)
    return places, g[places]


class Index:
    """Fingerprints of benchmark items: hash -> places; short items by the hash of all their words."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW, k: int = K):
        self.window, self.k = window, k
        self.names = [name for name, _ in items]
        self.words = [words_of(raw) for _, raw in items]
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, ws in enumerate(self.words):
            h = WORDS.array(ws)
            if 0 < len(ws) < window:
                self.short[len(ws)][int(gram_hashes(h, len(ws))[0])].append(i)
            for place, value in zip(*winnow(h, k, window)):
                self.places[int(value)].append((i, int(place)))
        self.sieve = self._sieve(self.places)
        self.sieves = {n: self._sieve(found) for n, found in self.short.items()}

    @staticmethod
    def _sieve(hashes) -> np.ndarray:
        sieve = np.zeros(1 << 20, bool)
        sieve[(np.array(list(hashes), dtype=np.uint64) >> np.uint64(44)).astype(np.int64)] = True
        return sieve

    def hits(self, ws: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Mask of hit words, and the items with an occurring window."""
        hit, found = np.zeros(len(ws) + 1, np.int32), set()
        h = WORDS.array(ws)
        reached: dict[tuple[int, int], int] = {}
        places, values = winnow(h, self.k, self.window)
        for p, value in zip(*self._sifted(places, values, self.sieve)):
            for item, q in self.places.get(int(value), ()):
                if reached.get((item, p - q), -1) >= p:
                    continue
                other = self.words[item]
                a, b = p, q
                while a and b and ws[a - 1] == other[b - 1]:
                    a, b = a - 1, b - 1
                c, d = p, q
                while c < len(ws) and d < len(other) and ws[c] == other[d]:
                    c, d = c + 1, d + 1
                reached[item, p - q] = c
                if c - a >= self.window:
                    hit[a] += 1
                    hit[c] -= 1
                    found.add(item)
        for n, items in self.short.items():
            g = gram_hashes(h, n)
            for p, value in zip(*self._sifted(np.arange(len(g)), g, self.sieves[n])):
                for item in items.get(int(value), ()):
                    if ws[p : p + n] == self.words[item]:
                        hit[p] += 1
                        hit[p + n] -= 1
                        found.add(item)
        return np.cumsum(hit)[:-1] > 0, found

    @staticmethod
    def _sifted(places, values, sieve):
        keep = sieve[(values >> np.uint64(44)).astype(np.int64)]
        return places[keep].tolist(), values[keep].tolist()


def verdict(ws: list[bytes], index: Index | None) -> tuple:
    """``n_words, n_hit, n_items, items_sha256, spans`` of one document."""
    mask, found = index.hits(ws) if index else (np.zeros(len(ws), bool), set())
    names = sorted({index.names[i] for i in found}) if found else []
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    spans = [{"first": int(a), "words": int(b - a)} for a, b in edges.reshape(-1, 2)]
    return len(ws), int(mask.sum()), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), spans


def _table(rows: list[tuple]) -> pa.Array:
    columns = list(zip(*rows)) if rows else [[]] * 5
    return pa.StructArray.from_arrays(
        [pa.array(x, f.type) for x, f in zip(columns, _KIND)], fields=[*_KIND]
    )


def _items(bench: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return bench.select(column(item_col).cast("string").alias("item"), column(text_col).alias("body")).where(
        "item is not null and body is not null"
    )


def decontaminate(
    docs: DataFrame,
    bench: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Hits of benchmark windows in documents, a row for each row of ``docs``.

    Columns ``id_col, n_words, n_hit, n_items, items_sha256, contaminated, spans`` (runs of hit
    words). Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. A window
    is ten consecutive words of an item, or all words of a shorter item; items without words, and with
    a null id or text, have none. Rows of one item id count as one item. Null texts have no words and
    are clean. An empty benchmark leaves every document clean. Other columns of either table are not
    read.

    The benchmark's bytes are summed first. Up to ``broadcast_bytes`` its index goes to the
    executors and documents are read in one pass without a shuffle. Beyond it, a sieve of the
    benchmark's fingerprints goes there, and what passes is joined through an exchange.
    """
    prepare(docs.sparkSession)
    items = _items(bench, item_col, text_col)
    text, id_of = column(text_col), column(id_col).alias(id_col)
    if _bytes_of(items) <= broadcast_bytes:
        judged = docs.select(id_of, _judge(items)(text).alias("r_"))
    else:
        keyed = docs.select(id_of, _keyed(text).alias("k_")).select(column(id_col), F.col("k_.n_words").alias("n_words"), F.col("k_.key").alias("key_"))
        none = F.struct(F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"), F.array().cast(_SPANS).alias("spans"))
        found = _joined(docs, items, text_col).select("key_", F.struct("n_hit", "n_items", "items_sha256", "spans").alias("f_"))
        keyed = join_split(keyed, found, "key_", id_col, how="left").withColumn("f_", F.coalesce("f_", none))
        judged = keyed.select(column(id_col), F.struct("n_words", "f_.*").alias("r_"))
    return judged.select(
        column(id_col),
        *(F.col(f"r_.{c}").alias(c) for c in ("n_words", "n_hit", "n_items", "items_sha256")),
        (F.col("r_.n_hit") > 0).alias("contaminated"),
        F.col("r_.spans").alias("spans"),
    )


def drop_contaminated(
    docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """The documents without a hit word, with their own columns whatever their names."""
    prepare(docs.sparkSession)
    items, text = _items(bench, item_col, text_col), column(text_col)
    if _bytes_of(items) <= broadcast_bytes:
        return docs.where(_judge(items)(text)["n_hit"] == 0)
    whole = docs.select(F.struct(*(column(c).alias(c) for c in docs.columns)).alias("row_"), _keyed(text)["key"].alias("key_"))
    kept = whole.join(_joined(docs, items, text_col).select("key_"), "key_", "left_anti")
    return kept.select(*(F.col("row_").getField(c).alias(c) for c in docs.columns))


def _bytes_of(items: DataFrame) -> int:
    return items.agg(F.coalesce(F.sum(F.octet_length("body") + 64), F.lit(0))).first()[0]


def _judge(items: DataFrame):
    """The verdict of a text against items that are few enough to send."""
    sent = items.sparkSession.sparkContext.broadcast([(r["item"], r["body"].encode()) for r in items.collect()])

    @F.arrow_udf(SCHEMA)
    def judge(text: pa.Array) -> pa.Array:
        focus("words")
        index = _index_of(sent)
        return _table([verdict(words_of(raw), index) for raw in raw_texts(text)])

    return judge.asNondeterministic()


_indexes: dict[int, tuple[object, Index]] = {}


def _index_of(sent) -> Index:
    key = id(sent.value)
    if key not in _indexes:
        _indexes.clear()
        _indexes[key] = (sent.value, Index(sent.value))
    return _indexes[key][1]


_SPANS = "array<struct<first:int,words:int>>"
#: Bits of the sieve of fingerprints: 32 MB, whatever the benchmark's size.
SIEVE_BITS = 28


def _keyed(text):
    """A text's number of words and 128-bit key; equal texts have one verdict."""

    @F.arrow_udf("struct<n_words:long,key:binary>")
    def keyed(text: pa.Array) -> pa.Array:
        raws = raw_texts(text)
        words, keys = pa.array([len(words_of(raw)) for raw in raws], pa.int64()), pa.array([xxhash.xxh3_128_digest(raw) for raw in raws], pa.binary())
        return pa.StructArray.from_arrays([words, keys], names=["n_words", "key"])

    return keyed.asNondeterministic()(text)


def _bits(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)


def _window_key(ws: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(ws))


def item_windows(ws: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Bits of an item's fingerprints, and the keys of its windows."""
    h, n = WORDS.array(ws), min(len(ws), WINDOW)
    if not n:
        return [], []
    prints = winnow(h)[1] if n == WINDOW else gram_hashes(h, n) + np.uint64(n)
    return _bits(prints).tolist(), [_window_key(ws[i : i + n]) for i in range(len(ws) - n + 1)]


def text_windows(ws: list[bytes], sieve: np.ndarray, lengths: list[int]) -> list[tuple[int, int, bytes]]:
    """(first word, words, key) of the windows that hold a fingerprint which passes the sieve."""
    h = WORDS.array(ws)

    def passed(hashes: np.ndarray) -> np.ndarray:
        at = _bits(hashes)
        return (sieve[at >> 3] >> (at & 7)) & 1 == 1

    places, prints = winnow(h)
    starts: set[int] = set()
    for p in places[passed(prints)].tolist():
        starts.update(range(max(0, p - (WINDOW - K)), min(p, len(ws) - WINDOW) + 1))
    out = [(i, WINDOW, _window_key(ws[i : i + WINDOW])) for i in sorted(starts)]
    for n in lengths:
        g = gram_hashes(h, n) + np.uint64(n)
        out += [(i, n, _window_key(ws[i : i + n])) for i in np.flatnonzero(passed(g)).tolist()]
    return out


def _joined(docs: DataFrame, items: DataFrame, text_col: str) -> DataFrame:
    """``key_, n_hit, n_items, items_sha256, spans`` of the texts with a hit, for a benchmark too large to send.

    Documents' windows are keyed only around fingerprints that the sieve passes, and equi-joined with
    the benchmark's windows by 128-bit keys; the windows of a passage that many documents share go to
    many tasks. No text is moved or stored, and equal texts are one.
    """
    tables = SharedTables(docs.sparkSession, "decontam")

    @F.arrow_udf("struct<n:int,bits:array<long>,wins:array<binary>>")
    def of_item(text: pa.Array) -> pa.Array:
        rows = [(len(ws := words_of(raw)), *item_windows(ws)) for raw in raw_texts(text)]
        columns = list(zip(*rows)) if rows else [[]] * 3
        kinds = (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.binary()))
        return pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=["n", "bits", "wins"])

    with tables:
        marked = tables.save(items.select("item", of_item.asNondeterministic()("body").alias("m")).select("item", "m.*"), "items")
        lengths = [r[0] for r in marked.where(F.col("n").between(1, WINDOW - 1)).select("n").distinct().orderBy("n").collect()]

        def pack(frame: pd.DataFrame) -> pd.DataFrame:
            bits = np.zeros(1 << 20, np.uint8)
            bits[(frame["bit"] & ((1 << 20) - 1)).to_numpy()] = 1
            return pd.DataFrame({"block": [int(frame["bit"].iloc[0]) >> 20], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

        bits = marked.select(F.explode("bits").alias("bit")).distinct()
        sieve = np.zeros(1 << (SIEVE_BITS - 3), np.uint8)
        for r in bits.groupBy(F.shiftright("bit", 20).alias("b")).applyInPandas(pack, "block long, bits binary").collect():
            sieve[r["block"] << 17 : (r["block"] + 1) << 17] = np.frombuffer(r["bits"], np.uint8)
        sent = docs.sparkSession.sparkContext.broadcast(sieve)

        @F.arrow_udf("array<struct<key_:binary,first:int,words:int,win:binary>>")
        def of_text(text: pa.Array) -> pa.Array:
            kind = pa.struct([("key_", pa.binary()), ("first", pa.int32()), ("words", pa.int32()), ("win", pa.binary())])
            out = []
            for raw in raw_texts(text):
                found = text_windows(words_of(raw), sent.value, lengths)
                key = xxhash.xxh3_128_digest(raw) if found else b""
                out.append([{"key_": key, "first": a, "words": n, "win": win} for a, n, win in found])
            return pa.array(out, pa.list_(kind))

        windows = docs.select(F.explode(of_text.asNondeterministic()(column(text_col))).alias("w")).select("w.*")
        windows = tables.save(windows.distinct(), "windows")
        hits = join_split(windows, marked.select("item", F.explode("wins").alias("win")).distinct(), "win", "key_")
        by_text = hits.groupBy("key_").agg(F.collect_set("item").alias("items"), F.collect_set(F.struct("first", "words")).alias("runs"))
        names = F.array_sort("items")
        found = by_text.select(
            "key_",
            _merged(F.array_sort("runs")).alias("spans"),
            F.size(names).cast("long").alias("n_items"),
            F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        )
        n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["words"])
        found = tables.save(found.withColumn("n_hit", n_hit), "found")
        tables.drop("items", "windows")
    return found


def _merged(runs):
    """Disjoint runs of words that cover the given ones, which are sorted."""

    @F.arrow_udf(_SPANS)
    def merged(runs: pa.Array) -> pa.Array:
        out = []
        for group in runs.to_pylist():
            spans: list[dict] = []
            for r in group:
                end = r["first"] + r["words"]
                if spans and r["first"] <= spans[-1]["first"] + spans[-1]["words"]:
                    spans[-1]["words"] = max(end, spans[-1]["first"] + spans[-1]["words"]) - spans[-1]["first"]
                else:
                    spans.append({"first": r["first"], "words": r["words"]})
            out.append(spans)
        return pa.array(out, pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())])))

    return merged.asNondeterministic()(runs)

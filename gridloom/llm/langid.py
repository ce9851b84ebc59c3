"""Language identification by prediction by partial matching over bytes, with frozen statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import column, held_out, prepare, raw_texts

#: Longest context in bytes.
ORDER = 3
#: Documents and bytes that a language is learnt from, bytes of all languages, and most languages (the most frequent).
TRAIN_DOCS, TRAIN_BYTES, ALL_BYTES, LANGUAGES = 300, 1_000_000, 16_000_000, 200
#: Most bytes of the frozen tables, which go to every worker; languages learn from less text until they fit.
TABLE_BYTES = 256_000_000
#: The cost of what a context leaves no probability for.
_MOST_BITS = float(-np.log2(1e-30))
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Slots:
    """Sorted distinct numbers under a hash: ``find`` gives places among them, -1 for others."""

    def __init__(self, numbers: np.ndarray):
        bits = max(4, int(2 * len(numbers)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.numbers = np.append(numbers.astype(np.uint64), np.uint64(2**64 - 1))
        self.places = np.full(1 << bits, -1, np.int32)
        left = np.arange(len(numbers), dtype=np.int32)
        slot = self._slot(self.numbers[:-1])
        while len(left):
            free = self.places[slot] < 0
            self.places[slot[free]] = left[free]
            lost = self.places[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & self.mask

    def _slot(self, numbers: np.ndarray) -> np.ndarray:
        return ((numbers * _MIX) >> self.shift).astype(np.int64)

    def find(self, numbers: np.ndarray) -> np.ndarray:
        slot = self._slot(numbers)
        found = self.places[slot]
        open_ = np.flatnonzero((found >= 0) & (self.numbers[found] != numbers))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & self.mask
            at = self.places[slot]
            found[open_] = at
            wrong = (at >= 0) & (self.numbers[at] != numbers[open_])
            open_, slot = open_[wrong], slot[wrong]
        return found


@dataclass
class Model:
    """Code lengths in bits, frozen for each run of bytes that some language's tries know.

    ``symbol`` maps bytes to symbols: 0 stands before a text, 1 is any byte never seen in training.
    A run is a number to the base of the alphabet. ``long`` holds the runs of four seen, and
    ``cost4`` what the last byte costs each language there. After a run that no language has seen, a
    byte costs the escape ``leave3`` of the three bytes before it (nothing if those are unknown too)
    and then ``cost3`` of the last three bytes, or ``leave2`` and ``cost2`` of the last two.
    """

    languages: list[str]
    symbol: np.ndarray
    long: Slots
    cost4: np.ndarray
    short: Slots
    cost3: np.ndarray
    leave3: np.ndarray
    cost2: np.ndarray
    leave2: np.ndarray

    @property
    def nbytes(self) -> int:
        tables = (self.cost4, self.cost3, self.leave3, self.cost2, self.leave2)
        return sum(t.nbytes for t in tables) + sum(x.numbers.nbytes + x.places.nbytes for x in (self.long, self.short))

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language's statistics."""
        out = np.zeros((len(texts), len(self.languages)))
        most = max(20_000, 1_600_000 // max(len(self.languages), 1))
        group: list[int] = []
        size = 0
        for i, raw in enumerate([*texts, None]):
            if group and (raw is None or size + len(raw) > most):
                out[group] = self._lengths([texts[j] for j in group])
                group, size = [], 0
            if raw is not None and len(raw) > most:
                # a byte's cost depends on the three before it alone, so long texts are summed by stretches
                for at in range(0, len(raw), most):
                    out[i] += self._lengths([raw[at : at + most]], raw[max(at - ORDER, 0) : at])[0]
            elif raw is not None:
                group.append(i)
                size += len(raw) + ORDER
        return out

    def _lengths(self, texts: list[bytes], before: bytes = b"") -> np.ndarray:
        """Sums over texts, each of which follows ``before`` or stands at the start."""
        base = np.uint64(int(self.symbol.max()) + 1)
        lead = np.zeros(ORDER, np.uint8)
        codes = np.zeros(sum(map(len, texts)) + ORDER * len(texts), np.uint64)
        if before:
            lead = self.symbol[np.frombuffer(before, np.uint8)]
        starts, at = [], 0
        for raw in texts:
            codes[at + ORDER - len(lead) : at + ORDER] = lead
            at += ORDER
            codes[at : at + len(raw)] = self.symbol[np.frombuffer(raw, np.uint8)]
            starts.append(at)
            at += len(raw)
        total = np.zeros((len(texts), len(self.languages)))
        if len(codes) == ORDER * len(texts):
            return total
        pair = codes[1:] + base * codes[:-1]
        run = pair[2:] + base * base * pair[:-2]  # the run of four that ends at each byte from the fourth place on
        found = self.long.find(run)
        cost = self.cost4[found]
        odd = np.flatnonzero(found < 0)
        if len(odd):
            cube = base * base * base
            context, last = self.short.find(run[odd] // base), self.short.find(run[odd] % cube)
            two = (run[odd] % (base * base)).astype(np.int64)
            over = (run[odd] % cube // base).astype(np.int64)
            below = np.where((last >= 0)[:, None], self.cost3[last], self.leave2[over] + self.cost2[two])
            cost[odd] = np.minimum(below + np.where((context >= 0)[:, None], self.leave3[context], 0), _MOST_BITS)
        for i, (raw, start) in enumerate(zip(texts, starts)):
            total[i] = cost[start - ORDER : start - ORDER + len(raw)].sum(axis=0, dtype=np.float64)
        return total


def _blend(counts: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities after contexts (rows) with these counts, and the factor of escaping from each.

    Escape method C: a context seen n times with q distinct bytes codes a seen byte with
    count / (n + q), and escapes with q / (n + q) to the shorter context, from which the bytes seen
    here are excluded. A context never seen passes on to the shorter one at no cost.
    """
    n = counts.sum(axis=-1, keepdims=True)
    seen = counts > 0
    q = seen.sum(axis=-1, keepdims=True)
    rest = np.where(seen, 0, below).sum(axis=-1, keepdims=True)
    full = (rest <= 1e-12) & (n > 0)  # nothing is left to escape to
    leave = np.where(n == 0, 1.0, np.where(full, 0, q / np.maximum(n + q, 1) / np.where(rest <= 1e-12, 1, rest)))
    p = np.where(seen, counts / np.maximum(np.where(full, n, n + q), 1), leave * below)
    return p, leave[..., 0]


def _bits(p: np.ndarray) -> np.ndarray:
    return -np.log2(np.maximum(p, 1e-30))


def _sparse(runs: np.ndarray, counts: np.ndarray, base: int, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits of seen runs (sorted), contexts seen, and the bits of escaping from those; ``below`` is p one byte shorter."""
    contexts, at = np.unique(runs // base, return_inverse=True)
    n = np.bincount(at, counts, len(contexts))
    q = np.bincount(at, minlength=len(contexts))
    rest = 1 - np.bincount(at, below, len(contexts))
    full = rest <= 1e-12
    p = counts / np.where(full, n, n + q)[at]
    leave = np.where(full, 0, q / (n + q) / np.where(full, 1, rest))
    return _bits(p), contexts, _bits(leave)


def fit(texts: dict[str, list[bytes]], order: int = ORDER, table_bytes: int = TABLE_BYTES) -> Model:
    """Context tries of each language, frozen into tables of code lengths of at most ``table_bytes``.

    While the tables would be larger, each language learns from the first half of its texts' bytes.
    """
    if order != ORDER:
        raise ValueError("the tables are laid out for contexts of three bytes")
    languages = sorted(texts)
    while True:
        model = _freeze(languages, texts, table_bytes)
        if model is not None:
            return model
        texts = {language: _half(group) for language, group in texts.items()}


def _half(group: list[bytes]) -> list[bytes]:
    left, out = sum(map(len, group)) // 2, []
    for raw in group:
        if left > 0:
            out.append(raw[:left])
            left -= len(raw)
    return out


def _freeze(languages: list[str], texts: dict[str, list[bytes]], table_bytes: int) -> Model | None:
    seen = sorted({b for group in texts.values() for raw in group for b in set(raw)})
    symbol = np.ones(256, np.int64)
    symbol[seen] = np.arange(2, len(seen) + 2)
    s = len(seen) + 2
    runs = {}
    for language in languages:
        parts = []
        for raw in texts[language]:
            codes = np.zeros(len(raw) + ORDER, np.int64)
            codes[ORDER:] = symbol[np.frombuffer(raw, np.uint8)]
            parts.append(((codes[:-3] * s + codes[1:-2]) * s + codes[2:-1]) * s + codes[3:])
        runs[language] = np.unique(np.concatenate(parts) if parts else np.empty(0, np.int64), return_counts=True)
    four = np.unique(np.concatenate([g for g, _ in runs.values()])) if runs else np.empty(0, np.int64)
    three = np.union1d(four % s**3, four // s)
    k = len(languages)
    # a slot takes 8 bytes for its number, and 4 in each of 2 to 4 places of the hash
    if (4 * k + 24) * len(four) + (8 * k + 24) * len(three) + 8 * k * s * s > table_bytes and any(len(g) > 1 for g, _ in runs.values()):
        return None
    cost4, cost3, leave3 = (np.zeros((len(x), k), np.float32) for x in (four, three, three))
    cost2, leave2 = np.zeros((s * s, k), np.float32), np.zeros((s * s, k), np.float32)
    # A byte outside the alphabet shares its symbol's probability with all such bytes.
    unseen = 256 - len(seen)
    flat = np.full(s, 1 / 256)
    flat[0], flat[1] = 0, unseen / 256
    share = np.ones(s)
    share[1] = max(unseen, 1)
    for i, language in enumerate(languages):
        g, times = runs[language]
        c2 = np.bincount(g % (s * s), times, s * s).reshape(s, s)
        p0 = _blend(c2.sum(axis=0)[None], flat[None])[0][0]
        p1, _ = _blend(c2, np.broadcast_to(p0, (s, s)))
        cost2[:, i] = _bits(p1 / share).reshape(-1)
        r3, at = np.unique(g % s**3, return_inverse=True)
        n3 = np.bincount(at, times, len(r3))
        bits3, two, leave = _sparse(r3, n3, s, p1.reshape(-1)[r3 % (s * s)])
        leave2[two, i] = leave
        cost3[:, i] = np.minimum(leave2[three % s**3 // s, i] + cost2[three % (s * s), i], _MOST_BITS)
        cost3[np.searchsorted(three, r3), i] = bits3
        bits4, known, leave = _sparse(g, times, s, np.exp2(-bits3)[np.searchsorted(r3, g % s**3)])
        leave3[np.searchsorted(three, known), i] = leave
        cost4[:, i] = np.minimum(leave3[np.searchsorted(three, four // s), i] + cost3[np.searchsorted(three, four % s**3), i], _MOST_BITS)
        cost4[np.searchsorted(four, g), i] = bits4
    if not len(four):
        cost4, cost3, leave3 = (np.zeros((1, k), np.float32) for _ in range(3))
    return Model(languages, symbol.astype(np.uint16), Slots(four), cost4, Slots(three), cost3, leave3, cost2, leave2)


def training_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    most_docs: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES, all_bytes: int = ALL_BYTES, languages: int = LANGUAGES,
) -> dict[str, list[bytes]]:
    """A bounded sample of labelled documents: for each language up to ``most_docs`` whole texts.

    The ``languages`` most frequent values are learnt, each from up to ``most_bytes`` and an even
    part of ``all_bytes``. Rows with a null language or without text, and those held out (crc32 of
    the id modulo 3 is 1), are never learnt from. Rows are counted by language, those whose hash lies
    in the share that is needed go to one task for each language, which takes the first by hash as
    long as they fit, texts over a tenth of the bytes after the others; the first one is always taken.
    """
    rows = docs.select(
        column(lang_col).cast("string").alias("lang"), column(text_col).alias("body"), F.xxhash64(column(id_col)).alias("dealt"),
        held_out(column(id_col)).alias("held"),
    ).where("not held and lang is not null and body <> ''")
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages)
    found = {r["lang"]: r["count"] for r in counts.collect()}
    if not found:
        return {}
    most = min(most_bytes, all_bytes // len(found))
    shares = docs.sparkSession.createDataFrame(
        [(lang, min(1.0, (1.3 * most_docs + 30) / n) * 2.0**64 - 2.0**63) for lang, n in found.items()], "lang string, below double"
    )
    near = rows.join(F.broadcast(shares), "lang").where(F.col("dealt").cast("double") <= F.col("below"))
    size = F.octet_length("body").cast("long")
    order = Window.partitionBy("lang").orderBy(size * 10 > most, "dealt", "body")
    taken = (
        near.select("lang", "body", F.row_number().over(order).alias("at"), F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("sum"))
        .where(F.col("at").between(1, most_docs) & ((F.col("at") == 1) | (F.col("sum") <= most)))
        .orderBy("lang", "at")
    )
    texts: dict[str, list[bytes]] = {lang: [] for lang in sorted(found)}
    for r in taken.select("lang", "body").collect():
        texts[r["lang"]].append(r["body"].encode())
    return texts


def identify_language(
    docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds: int
) -> DataFrame:
    """``id_col, held_out, lang_pred, score, bits_per_byte``, a row for each row of ``docs``.

    Every byte of a text is coded under each language's frozen statistics; the shortest code names
    the language (the first by name among equals), and ``score`` is its share of the probability,
    all languages being as likely beforehand. Null texts and those without a letter are ``und``
    with score 0, as is every text if there is nothing to learn from. ``bounds`` are those of
    ``training_texts``. Repeated rows are judged
    apiece; an empty table gives an empty one; other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    model = fit(training_texts(docs, id_col, text_col, lang_col, **bounds)) if model is None else model
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double,bits_per_byte:double>")
    def predict(text: pa.Array, letters: pa.Array) -> pa.Array:
        model, texts = sent.value, raw_texts(text)
        names, scores, rates = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        if model.languages:
            bits = model.code_lengths(texts)
            best = bits.argmin(axis=1)
            for i, some in enumerate(letters.to_pylist()):
                if some:
                    names[i] = model.languages[best[i]]
                    scores[i] = float(1 / np.exp2(np.maximum(bits[i, best[i]] - bits[i], -1000)).sum())
                    rates[i] = float(bits[i, best[i]] / len(texts[i]))
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())],
            names=["lang_pred", "score", "bits_per_byte"],
        )

    id_of = column(id_col)
    letters = F.coalesce(column(text_col).rlike(r"\p{L}"), F.lit(False))
    judged = docs.select(
        id_of.alias(id_col), held_out(id_of).alias("held_out"), predict.asNondeterministic()(column(text_col), letters).alias("r_")
    )
    return judged.select(id_of, "held_out", "r_.lang_pred", "r_.score", "r_.bits_per_byte")

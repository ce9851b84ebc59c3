"""Quality rules: base counts, and divergence of a text's histograms from its language's."""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import WORDS, column, focus, gram_hashes, prepare, raw_texts

#: The most frequent function words of four languages, for the word histograms.
COMMON_WORDS = (
    "the of and to in is that for it as was with be by on not he this are or at from "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les des en un du une que est pour qui dans par sur pas au avec "
    "el los se del las por con no una su para es al lo como más o pero sus y a"
).split()
_WORD_AT = {w.encode(): i for i, w in reversed(list(enumerate(dict.fromkeys(COMMON_WORDS))))}
N_WORDS = len(_WORD_AT) + 1
#: Most languages with a reference, the most frequent ones.
LANGUAGES = 200

#: Character classes of the histogram, by byte: lead bytes of UTF-8 stand for their characters.
CLASSES = ("lower", "upper", "digit", "space", "newline", "sentence", "comma", "dash", "symbol", "other", "latin", "wide")
_CLASS = np.full(256, 9, np.int8)
for _chars, _k in ((range(97, 123), 0), (range(65, 91), 1), (range(48, 58), 2), (b" \t\r\x0b\x0c", 3), (b"\n", 4), (b".!?", 5), (b",;:'\"", 6), (b"-()/", 7), (b"#*$%&|<>", 8), (range(0xC2, 0xCA), 10), (range(0xCA, 0xF8), 11)):
    _CLASS[list(_chars)] = _k
_CLASS[0x80:0xC0] = -1  # continuation bytes are no characters
N_CLASSES = len(CLASSES)
_SYMBOLS = b"#*$%&|<>"
_PUNCT = b".,;:!?\"'()"


@dataclass(frozen=True)
class Limits:
    """Guards and limits of the distances, which are Jensen-Shannon distances to base 2, in 0 to 1.

    A short text's histogram strays by chance, by about the inverse root of its length: the limit
    is ``distance + noise / sqrt(length)``, in characters or words.
    """

    min_chars: int = 200  #: shorter texts are not held against character histograms
    min_words: int = 50  #: shorter texts are not held against word histograms, nor part of the references
    class_distance: float = 0.2
    class_noise: float = 2.0
    word_distance: float = 0.24
    word_noise: float = 1.5


def base_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a whole text."""
    words = raw.split()
    n = len(words)
    chars = sum(map(len, words))
    if not raw.isascii():
        chars -= int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) == 0x80))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n > 5:
        g = gram_hashes(WORDS.array(words), 5)
        _, inverse, times = np.unique(g, return_inverse=True, return_counts=True)
        if len(times) < len(g):
            edges = np.zeros(n + 1, np.int32)
            at = np.flatnonzero(times[inverse] > 1)
            edges[at] += 1
            np.subtract.at(edges, at + 5, 1)
            repeated = int((np.cumsum(edges)[:n] > 0).sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


def histograms(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Counts of character classes and of common words (the last: all other words)."""
    k = _CLASS[np.frombuffer(raw, np.uint8)]
    classes = np.bincount(k[k >= 0], minlength=N_CLASSES)
    words = np.zeros(N_WORDS, np.int64)
    tokens = Counter(w.strip(_PUNCT) for w in raw.lower().split())
    for w in tokens.keys() & _WORD_AT.keys():
        words[_WORD_AT[w]] = tokens[w]
    words[-1] = tokens.total() - words.sum()
    return classes, words


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms, 0 if one is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(d, 0) / 2))


def references(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", limits: Limits = Limits()
) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Histograms of each language, over all texts that pass the base rules and have ``min_words`` words.

    Each text counts once, by its shares, so that long texts don't stand for their language. Every
    task returns one row for each language, and only the sums of the ``LANGUAGES`` values with the
    most texts reach the driver; texts of other values are held against the nearest of these.
    """
    prepare(docs.sparkSession)
    names = [f"c{i}" for i in range(N_CLASSES)] + [f"w{i}" for i in range(N_WORDS)] + ["texts"]

    def sums(batches):
        total: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(names)))
        for batch in batches:
            for lang, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
                counts = base_counts(raw)
                if lang is None or counts[0] < limits.min_words or base_failed(counts[0], counts[4]):
                    continue
                c, w = histograms(raw)
                total[lang] += np.concatenate((c / max(c.sum(), 1), w / max(w.sum(), 1), [1]))
        yield pa.RecordBatch.from_pydict(
            {"lang": pa.array(list(total), pa.string())}
            | {n: pa.array([float(v[i]) for v in total.values()], pa.float64()) for i, n in enumerate(names)}
        )

    found = (
        docs.select(column(lang_col).cast("string").alias("lang"), column(text_col).alias("body"))
        .mapInArrow(sums, "lang string, " + ", ".join(f"{n} double" for n in names))
        .groupBy("lang")
        .agg(*(F.sum(n).alias(n) for n in names))
        .orderBy(F.desc("texts"), "lang")
        .limit(LANGUAGES)
        .collect()
    )
    return {r["lang"]: (np.array(r[1 : N_CLASSES + 1]), np.array(r[N_CLASSES + 1 : -1])) for r in sorted(found)}


def verdict(raw: bytes, lang: str | None, refs: dict, limits: Limits) -> tuple:
    """The base counts, ``base_failed``, ``class_distance, word_distance`` and ``kept``."""
    counts = base_counts(raw)
    failed = base_failed(counts[0], counts[4])
    classes, words = histograms(raw)
    near = [refs[lang]] if lang in refs else list(refs.values())
    by_class = min((distance(classes, c) for c, _ in near), default=0.0)
    by_word = min((distance(words, w) for _, w in near), default=0.0)
    chars = int(classes.sum())
    far_classes = chars >= limits.min_chars and by_class > limits.class_distance + limits.class_noise / chars**0.5
    far_words = counts[0] >= limits.min_words and by_word > limits.word_distance + limits.word_noise / counts[0] ** 0.5
    kept = not failed and not far_classes and not far_words
    return *counts, failed, by_class, by_word, kept


_FIELDS = [
    *((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    ("base_failed", pa.bool_()),
    ("class_distance", pa.float64()),
    ("word_distance", pa.float64()),
    ("kept", pa.bool_()),
]


def quality_rules(
    docs: DataFrame,
    limits: Limits = Limits(),
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    refs: dict | None = None,
) -> DataFrame:
    """Counts, distances and verdict, a row for each row of ``docs``.

    A text fails the base rules with under ten words or over a fifth of its words in repeated
    five-word windows. Else it is kept unless its character classes or common words are further
    than the limits from the reference of its language; texts under ``min_chars`` or ``min_words``
    are too short for that and kept. A null or unknown language takes the nearest reference, and
    without any reference distances are 0. Null texts are empty and fail. Repeated rows are judged
    apiece; an empty table gives an empty one; other columns are not read.
    """
    prepare(docs.sparkSession)
    refs = references(docs, text_col, lang_col, limits) if refs is None else refs
    plain = json.dumps({k: [c.tolist(), w.tolist()] for k, (c, w) in refs.items()})

    @F.arrow_udf("struct<" + ",".join(f"{n}:{'boolean' if t == pa.bool_() else 'double' if t == pa.float64() else 'long'}" for n, t in _FIELDS) + ">")
    def judge(text: pa.Array, lang: pa.Array) -> pa.Array:
        focus("words")
        known = {k: (np.array(c), np.array(w)) for k, (c, w) in json.loads(plain).items()}
        rows = [verdict(raw, la, known, limits) for raw, la in zip(raw_texts(text), lang.to_pylist())]
        columns = list(zip(*rows)) if rows else [[]] * len(_FIELDS)
        return pa.StructArray.from_arrays([pa.array(x, t) for x, (_, t) in zip(columns, _FIELDS)], names=[n for n, _ in _FIELDS])

    judged = docs.select(
        column(id_col).alias(id_col), judge.asNondeterministic()(column(text_col), column(lang_col).cast("string")).alias("r_")
    )
    return judged.select(column(id_col), *(F.col(f"r_.{n}").alias(n) for n, _ in _FIELDS))

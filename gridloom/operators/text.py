"""Text and embedding operators: TF-IDF tables, contrastive losses, nearest labels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.joins import against_all
from gridloom.roles import require


#: Labels, of a vector each, that are sent to every task; more are joined without a hint.
SENT_LABELS = 10_000


#: Words that carry little meaning, in English.
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her his i if in into is it its me my no not of on or our she "
    "so that the their them then there they this to was we were what when which who will with you your"
).split()


def tokens(text: str | Column, stop_words: list[str] | tuple[str, ...] = ()) -> Column:
    """Lower-cased runs of letters and digits, less the stop words."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda t: (t != "") & ~t.isin(*stop_words)) if stop_words else F.filter(words, lambda t: t != "")


def normalise(text: str | Column, stop_words: list[str] | tuple[str, ...] = STOP_WORDS) -> Column:
    """A text's words, lower-cased and without stop words, joined by one space; null is empty."""
    return F.array_join(tokens(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), stop_words), " ")


def tf_idf(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, term, tf, df, idf, tf_idf`` with idf = ln((1 + n) / (1 + df)) + 1.

    Two shuffles: term counts by document, and document frequencies, which are joined back by term.
    """
    counts = df.select(key, F.explode(tokens(text)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    frequency = counts.groupBy("term").agg(F.count("*").alias("df"))
    n = df.agg(F.count("*").alias("n_"))
    idf = F.log((1.0 + F.col("n_")) / (1.0 + F.col("df"))) + 1
    wide = counts.join(frequency, "term").join(F.broadcast(n), F.lit(True))
    return wide.select(key, "term", "tf", "df", idf.alias("idf"), (F.col("tf") * idf).alias("tf_idf"))


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(v: str | Column) -> Column:
    """The vector over its length; a null vector's stays zeros."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x.cast("double"), norm), F.lit(0.0)))


def label_centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """``label, centroid``: the mean vector of each label, by place."""
    parts = df.select(F.col(label).alias("label"), F.posexplode(vector).alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("centroid"))


def nearest_labels(df: DataFrame, key: str, vector: str, labels: DataFrame, k: int = 3) -> DataFrame:
    """``key, rank, label, confidence``: the k labels of greatest cosine; up to ``SENT_LABELS`` go to every task."""
    side = labels.select("label", unit("centroid").alias("c_"))
    side = F.broadcast(side) if labels.limit(SENT_LABELS + 1).count() <= SENT_LABELS else side
    scored = df.select(key, unit(vector).alias("v_")).join(side, F.lit(True)).select(key, "label", dot("v_", "c_").alias("confidence"))
    top = scored.groupBy(key).agg(F.slice(F.sort_array(F.collect_list(F.struct("confidence", (-F.col("label")).alias("o_"), "label")), asc=False), 1, k).alias("t_"))
    return top.select(key, F.posexplode("t_").alias("at_", "p_")).select(key, (F.col("at_") + 1).alias("rank"), "p_.label", "p_.confidence")


def _units(table) -> np.ndarray:
    """Rows of a batch's vector column, over their lengths; a null vector's stays zeros."""
    flat = table.column("v").combine_chunks() if isinstance(table, pa.Table) else table.column("v")
    v = flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(norm > 0, norm, 1)


def _labelled(df: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """Rows with a vector: key and label as hashes (a null label's is null) and the vector."""
    require(df, key, label, vector)
    hashed = F.when(F.col(label).isNotNull(), F.xxhash64(label))
    return df.where(F.col(vector).isNotNull()).select(F.xxhash64(key).alias("k"), hashed.alias("l"), F.col(vector).cast("array<double>").alias("v"))


def _blocks(batches, chunk: pa.Table):
    """For blocks of rows: their keys, cosines with the chunk's rows, and where labels are the same, known, and rows others."""
    names = lambda t: (t.column("k").to_numpy(), t.column("l").fill_null(0).to_numpy(), ~t.column("l").is_null().to_numpy(zero_copy_only=False))
    k2, l2, known2 = names(chunk)
    u2 = _units(chunk)
    step = max(1, 2_000_000 // max(len(k2), 1))
    for batch in batches:
        for lo in range(0, batch.num_rows, step):
            part = pa.Table.from_batches([batch.slice(lo, step)])
            k1, l1, known1 = names(part)
            both = known1[:, None] & known2
            yield k1, _units(part) @ u2.T, both & (l1[:, None] == l2), both, k1[:, None] != k2


def pair_losses(df: DataFrame, key: str, label: str, vector: str, margin: float = 1.0) -> DataFrame:
    """One row ``n_pairs, contrastive, backbone`` over all pairs of rows with different keys.

    ``contrastive`` is the mean of d**2 for equal labels, else max(0, margin - d)**2; ``backbone`` is
    mean(d of equal)**2 + mean(max(0, margin - d) of unequal)**2, d being one less the cosine; a null
    label is neither equal nor unequal. All pairs are looked at, by definition: as products of blocks,
    of which only sums leave a task, so no table is too large for memory. Rows without a vector are
    left out.
    """

    def sums(batches, chunk):
        total = np.zeros(7)
        for _, cosine, same, both, other in _blocks(batches, chunk):
            d = 1 - cosine
            gap = np.maximum(0, margin - d)
            same, unlike = same & other, both & ~same & other
            total += [other.sum(), (d * d)[same].sum(), (gap * gap)[other & ~same].sum(), same.sum(), d[same].sum(), unlike.sum(), gap[unlike].sum()]
        yield pa.RecordBatch.from_pydict({f"s{i}": [float(v)] for i, v in enumerate(total)})

    rows = _labelled(df, key, label, vector)
    parts, _ = against_all(rows, "k", sums, ", ".join(f"s{i} double" for i in range(7)), _row_bytes(rows))
    s = [F.sum(f"s{i}") for i in range(7)]
    mean = lambda a, b: F.try_divide(s[a], s[b])
    return parts.agg(
        F.coalesce(s[0] / 2, F.lit(0)).cast("long").alias("n_pairs"),
        F.try_divide(s[1] + s[2], s[0]).alias("contrastive"),
        (mean(4, 3) ** 2 + mean(6, 5) ** 2).alias("backbone"),
    )


def info_nce(df: DataFrame, key: str, label: str, vector: str, temperature: float = 0.07) -> DataFrame:
    """One row ``loss``: supervised NT-Xent over all anchors that have a positive.

    Products of blocks, as in ``pair_losses``; of an anchor's row only the sum of exponentials, the
    sum over positives and their number leave a task.
    """

    def sums(batches, chunk):
        for k, cosine, same, _, other in _blocks(batches, chunk):
            s, same = cosine / temperature, same & other
            e = np.where(other, np.exp(s - 1 / temperature), 0).sum(axis=1)
            yield pa.RecordBatch.from_pydict({"k": k, "e": e, "p": np.where(same, s, 0).sum(axis=1), "n": same.sum(axis=1)})

    rows = _labelled(df, key, label, vector)
    parts, chunks = against_all(rows, "k", sums, "k long, e double, p double, n long", _row_bytes(rows))
    if chunks > 1:
        # repeated keys: each row has one part for each chunk
        parts = parts.groupBy("k").agg(F.sum("e").alias("e"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return parts.where("n > 0").agg(F.avg(F.log("e") + 1 / temperature - F.col("p") / F.col("n")).alias("loss"))


def _row_bytes(rows: DataFrame) -> int:
    one = rows.select(F.size("v").alias("n")).first()
    return 8 * (one["n"] + 2) if one else 8


def predict_labels(df: DataFrame, key: str, vector: str, labels: DataFrame, k: int = 3) -> DataFrame:
    """``key, prediction, confidence, top_k_predictions, top_k_confidences``: a row for each row with a vector."""
    ranked = nearest_labels(df, key, vector, labels, k)
    top = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "label", "confidence"))).alias("t_"))
    first = F.get("t_", F.lit(0))
    return top.select(
        key, first["label"].alias("prediction"), first["confidence"].alias("confidence"),
        F.transform("t_", lambda t: t["label"]).alias("top_k_predictions"), F.transform("t_", lambda t: t["confidence"]).alias("top_k_confidences"),
    )


def hashed_embeddings(df: DataFrame, key: str, text: str, size: int = 64) -> DataFrame:
    """``key, embedding``: words hashed to ``size`` places with a sign, log counts summed, of length one.

    A substitute for neural embeddings, which it is not: texts are near that share words. Place and
    sign come from md5, counts are summed before the shuffle; texts without a word get zeros. Keys are
    unique.
    """
    require(df, key, text)
    words = df.select(key, F.explode_outer(tokens(F.coalesce(F.col(text), F.lit("")))).alias("w"))
    counts = words.groupBy(key, "w").agg(F.count("w").alias("n"))
    number = F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long")
    sign = F.when(number >= 1 << 31, -1.0).otherwise(1.0)
    cells = counts.select(key, F.coalesce(F.pmod(number, F.lit(size)), F.lit(0)).alias("p"), F.coalesce(sign * F.log1p("n"), F.lit(0.0)).alias("v"))
    summed = cells.groupBy(key, "p").agg(F.sum("v").alias("v"))
    placed = summed.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("p", "v"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.get(F.array(F.try_element_at("m", i.cast("long"))), F.lit(0)), F.lit(0.0)))
    return placed.select(key, unit(dense).alias("embedding"))


def label_frequencies(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))

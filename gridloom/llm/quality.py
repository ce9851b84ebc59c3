"""Quality classifier: a byte-level convolutional network in numpy over whole documents."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import column, held_out, prepare, raw_texts

#: Bytes a filter sees, filters, size of a byte's embedding, hidden units of the last layers.
WIDTH, FILTERS, EMBED, HIDDEN = 8, 16, 8, 16
#: A chunk is two blocks of this many bytes and overlaps the next by one.
BLOCK = 256
#: Most labelled documents to learn from, and their bytes altogether; each is learnt from as a whole.
TRAIN_DOCS, TRAIN_BYTES = 3000, 64_000_000
EPOCHS, STEP, BATCH = 14, 0.01, 32
#: Positions convolved at a time; bounds memory, not the text.
SLAB = 64 * BLOCK


@dataclass
class Network:
    """Filters as tables (place in filter, byte) -> outputs, and the layers above the pooled chunks."""

    table: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray
    hidden: np.ndarray  # 3 * FILTERS x HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float

    def slabs(self, raw: bytes):
        """First block, bytes and outputs (blocks x BLOCK x FILTERS) of each slab; every byte is covered."""
        count = -(-max(len(raw), 1) // BLOCK)
        data = np.zeros(count * BLOCK + WIDTH, np.uint8)
        data[: len(raw)] = np.frombuffer(raw, np.uint8)
        for at in range(0, count * BLOCK, SLAB):
            size = min(SLAB, count * BLOCK - at)
            z = self.table[0][data[at : at + size]]
            for w in range(1, WIDTH):
                z += self.table[w][data[at + w : at + w + size]]
            yield at // BLOCK, data, z.reshape(-1, BLOCK, FILTERS)

    def blocks(self, raw: bytes) -> np.ndarray:
        """Greatest output of each filter in each block of a text."""
        return np.concatenate([z.max(axis=1) for _, _, z in self.slabs(raw)])

    def features(self, raw: bytes) -> np.ndarray:
        """Chunks of two overlapping blocks, rectified; then the greatest, the mean and the least over chunks.

        The least tells texts with a stretch where the filters find little, such as one word repeated.
        """
        pooled = self.blocks(raw)
        chunks = np.maximum(pooled[:-1], pooled[1:]) if len(pooled) > 1 else pooled
        chunks = np.maximum(chunks + self.bias, 0)
        return np.concatenate((chunks.max(axis=0), chunks.mean(axis=0), chunks.min(axis=0)))

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        x = np.stack([self.features(raw) for raw in texts]).astype(np.float64)
        logit = np.maximum(x @ self.hidden + self.hidden_bias, 0) @ self.out + self.out_bias
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def fit(texts: list[bytes], labels: list[int], seed: int = 5) -> Network:
    """Adam on the logistic loss; the gradient runs through the places where each maximum stood.

    Every step looks at whole texts. Labels of one kind only, or none, give a network that returns
    their share (1 with no labels).
    """
    rng = np.random.default_rng(seed)
    y = np.array(labels, float)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 1 - 1e-3
    p = {
        "embed": rng.normal(0, 0.5, (256, EMBED)),
        "mix": rng.normal(0, 0.35, (WIDTH, EMBED, FILTERS)),
        "bias": np.zeros(FILTERS),
        "hidden": rng.normal(0, 0.2, (3 * FILTERS, HIDDEN)),
        "hidden_bias": np.full(HIDDEN, 0.1),
        "out": rng.normal(0, 0.25, HIDDEN),
        "out_bias": np.array(np.log(share / (1 - share))),
    }

    def network() -> Network:
        table = np.stack([p["embed"] @ m for m in p["mix"]]).astype(np.float32)
        return Network(table, p["bias"].astype(np.float32), p["hidden"], p["hidden_bias"], p["out"], float(p["out_bias"]))

    if len(set(labels)) < 2:
        p["out"][:] = 0
        return network()
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            net, rows = network(), order[at : at + BATCH]
            grads = {k: np.zeros_like(v) for k, v in p.items()}
            g_table = np.zeros((WIDTH, 256, FILTERS))
            for i in rows:
                _learn(net, p, texts[i], y[i], grads, g_table)
            for w in range(WIDTH):
                grads["embed"] += g_table[w] @ p["mix"][w].T
                grads["mix"][w] = p["embed"].T @ g_table[w]
            step += 1
            rate = STEP * (1 - epoch / EPOCHS) + 1e-4
            for k in p:
                g = grads[k] / len(rows) + 1e-4 * p[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] = p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return network()


def _learn(net: Network, p: dict, raw: bytes, label: float, grads: dict, g_table: np.ndarray) -> None:
    """Add one text's gradient."""
    tops, places = [], []
    for first, data, z in net.slabs(raw):
        at = z.argmax(axis=1)
        tops.append(np.take_along_axis(z, at[:, None, :], axis=1)[:, 0, :])
        places.append(at + BLOCK * np.arange(first, first + len(z))[:, None])
    pooled, where = np.concatenate(tops), np.concatenate(places)
    if len(pooled) > 1:
        right = pooled[1:] > pooled[:-1]
        pooled, where = np.where(right, pooled[1:], pooled[:-1]), np.where(right, where[1:], where[:-1])
    chunks = np.maximum(pooled + net.bias, 0)
    top, low = chunks.argmax(axis=0), chunks.argmin(axis=0)
    x = np.concatenate((chunks.max(axis=0), chunks.mean(axis=0), chunks.min(axis=0))).astype(float)
    pre = x @ p["hidden"] + p["hidden_bias"]
    act = np.maximum(pre, 0)
    prob = 1 / (1 + np.exp(-np.clip(act @ p["out"] + p["out_bias"], -40, 40)))
    d = prob - label
    grads["out"] += d * act
    grads["out_bias"] += d
    d_pre = d * p["out"] * (pre > 0)
    grads["hidden"] += np.outer(x, d_pre)
    grads["hidden_bias"] += d_pre
    d_x = p["hidden"] @ d_pre
    d_chunks = np.tile(d_x[FILTERS : 2 * FILTERS] / len(chunks), (len(chunks), 1))
    d_chunks[top, np.arange(FILTERS)] += d_x[:FILTERS]
    d_chunks[low, np.arange(FILTERS)] += d_x[2 * FILTERS :]
    d_chunks *= chunks > 0
    grads["bias"] += d_chunks.sum(axis=0)
    f = np.broadcast_to(np.arange(FILTERS), where.shape)
    for w in range(WIDTH):
        np.add.at(g_table[w], (data[where + w], f), d_chunks)


def training_rows(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    most: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES,
) -> tuple[list[bytes], list[int]]:
    """Up to ``most`` labelled documents, the first by a hash of their ids, of up to ``most_bytes`` altogether.

    Held-out ids (crc32 modulo 3 is 1) and null ids or labels are never among them. The ids are
    chosen from the labels, so the driver sees ``most`` texts whatever the size of the corpus; the
    first is taken whatever its size.
    """
    id_of, label = column(id_col), column(label_col)
    chosen = (
        labels.where(label.isNotNull() & id_of.isNotNull() & ~held_out(id_of))
        .select(id_of.alias("id_"), label.cast("int").alias("label_"), F.xxhash64(id_of).alias("dealt_"))
        .orderBy("dealt_", "id_", "label_")
        .limit(most)
    )
    order = ("dealt_", "id_", "body_", "label_")
    before = Window.partitionBy().orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)  # over at most ``most`` rows
    size = F.coalesce(F.octet_length("body_"), F.lit(0)).cast("long")
    rows = (
        docs.select(column(id_col).alias("id_"), column(text_col).alias("body_"))
        .join(F.broadcast(chosen), "id_")
        .orderBy(*order)
        .limit(most)
        .withColumn("before_", F.sum(size).over(before))
        .where(F.coalesce("before_", F.lit(0)) + size <= F.when(F.col("before_").isNull(), size).otherwise(most_bytes))
        .orderBy(*order)
        .select("body_", "label_")
        .collect()
    )
    return [(r["body_"] or "").encode() for r in rows], [int(r["label_"] == 1) for r in rows]


def _scorer(net: Network, spark):
    sent = spark.sparkContext.broadcast(net)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(sent.value.score(raw_texts(text)), pa.float64())

    return score.asNondeterministic()


def classify_quality(
    docs: DataFrame,
    labels: DataFrame,
    net: Network | None = None,
    threshold: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    most: int = TRAIN_DOCS,
    most_bytes: int = TRAIN_BYTES,
) -> DataFrame:
    """``id_col, held_out, score, predicted``, a row for each row of ``docs``.

    ``score`` is the network's probability of label 1, from all bytes of the text and nothing else;
    it learns from at most ``most`` labelled texts of ``most_bytes`` altogether, all of their bytes.
    Null texts are empty and scored as such. Without labels to learn from every text gets the same
    score, over the threshold. Repeated rows are scored apiece; an empty table gives an empty one;
    other columns are not read.
    """
    prepare(docs.sparkSession)
    net = fit(*training_rows(docs, labels, id_col, text_col, label_col, most, most_bytes)) if net is None else net
    id_of, score = column(id_col), _scorer(net, docs.sparkSession)(column(text_col))
    scored = docs.select(id_of.alias(id_col), held_out(id_of).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_low_quality(
    docs: DataFrame, labels: DataFrame, net: Network | None = None, threshold: float = 0.5,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> DataFrame:
    """The documents that the classifier gives label 1, with their own columns whatever their names."""
    prepare(docs.sparkSession)
    net = fit(*training_rows(docs, labels, id_col, text_col, label_col)) if net is None else net
    return docs.where(_scorer(net, docs.sparkSession)(column(text_col)) >= threshold)

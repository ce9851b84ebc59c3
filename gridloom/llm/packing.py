"""Packing by power-of-two decomposition: no sequence crosses documents and none is padded."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import column, prepare
from gridloom.llm.pieces import LATIN1_LETTERS, TAIL, Memo, as_bytes, measure_each, memo_for

#: Words of one generation of a worker's memo.
ENTRIES = 200_000
#: Bytes of text that are encoded together.
GROUP_BYTES = 4_000_000


_SPACE, _TAIL = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t\n\r\x0b\x0c")] = _SPACE
_KIND[list(TAIL)] = _TAIL
#: Letters of one byte, and the second byte of small letters of Latin-1.
_LETTER = np.array([bytes([i]).isalpha() for i in range(256)])
_LATIN = np.array([i in LATIN1_LETTERS for i in range(256)])


def split_lengths(n: int, most: int) -> list[int]:
    """Lengths of the pieces of n ids: full ones, then the binary digits of the rest, largest first."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


class WordIds:
    """Ids of many words at once: a word of letters is one pre-token, whose last piece ends a word."""

    group = 256

    def __init__(self):
        self.ends: np.ndarray | None = None

    def __call__(self, tokenizer, words: list[bytes]) -> list[bytes]:
        if self.ends is None:
            vocabulary = tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        found = dict.fromkeys(words)
        plain = [w for w in words if w.isalpha() or (t := w.decode()).isalpha() and max(t) < "\u0180"]
        groups = [plain[at : at + self.group] for at in range(0, len(plain), self.group)]
        lines = [b" ".join(g).decode() for g in groups]
        for g, x in zip(groups, tokenizer.encode_batch_fast(lines, add_special_tokens=False)):
            ids = np.array(x.ids, dtype="<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) == len(g):
                raw, at = ids.tobytes(), 0
                for word, cut in zip(g, cuts):
                    found[word] = raw[at:cut]
                    at = cut
        rest = [w for w, ids in found.items() if ids is None]
        found.update(zip(rest, measure_each(tokenizer, rest, as_bytes)))
        return list(found.values())


def apart(texts: pa.Array) -> pa.Array:
    """Texts with a space between a letter and the punctuation that ends its word, so that fewer words differ."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    kind = np.zeros(len(data) + 2, np.uint8)  # what stands before and behind is white space
    kind[0] = kind[-1] = _SPACE
    kind[1:-1] = _KIND[data]
    tail = kind == _TAIL
    first = np.flatnonzero(tail[1:-1] & ~tail[:-2])
    behind = np.flatnonzero(tail[:-1] & ~tail[1:])  # of each run, counted in ``data``
    first = first[(kind[behind + 1] == _SPACE) & (first > 0)]
    last, before = data[first - 1], data[first - 2]
    first = first[_LETTER[last] | ((before == 0xC3) & _LATIN[last] & (first > 1))]
    moved = offsets + np.searchsorted(first, offsets)
    wide = np.insert(data, first, 32)
    made = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(moved), pa.py_buffer(wide))
    return made


def encode_texts(texts: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids on end, each text's followed by ``end_id``, and the number of ids of each.

    The tokenizer drops white space and works word by word, so a text's ids are those of its words on
    end. Words are numbered by a dictionary of the group, so that each distinct one is looked up
    once, and ids are gathered by number. A-Z are lower-cased beforehand, as the tokenizer does, which
    makes the memo smaller. Texts with ``<|`` keep their case: special strings are matched before
    lower-casing.
    """
    memo = memo_for("packing", path, lambda: Memo(path, as_bytes, WordIds(), ENTRIES))
    special = pc.match_substring(texts, "<|")
    texts = pc.if_else(special, texts, pc.ascii_lower(texts)) if pc.any(special).as_py() else pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(apart(texts))
    numbered = lists.flatten().dictionary_encode()
    words = numbered.dictionary.cast(pa.large_binary()).to_pylist()
    memo.learn(set(words))
    found = [memo[w] for w in words]
    pool = np.frombuffer(b"".join(found), "<u4")
    size = np.fromiter(map(len, found), np.int64, len(found)) // 4
    first = np.cumsum(size) - size
    of = numbered.indices.to_numpy()
    taken = size[of]  # ids of each word of the group
    upto = np.zeros(len(of) + 1, np.int64)
    np.cumsum(taken, out=upto[1:])
    ids = pool[np.repeat(first[of] - upto[:-1], taken) + np.arange(upto[-1])]
    ends = upto[np.cumsum(pc.list_value_length(lists).to_numpy().astype(np.int64))]  # of each text, among the ids
    totals = np.diff(ends, prepend=0) + 1
    out = np.empty(len(ids) + len(totals), "<u4")
    last = np.cumsum(totals) - 1
    inner = np.ones(len(out), bool)
    inner[last] = False
    out[inner], out[last] = ids, end_id
    return out, totals


def by_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts, null ones empty, in runs of about ``GROUP_BYTES``; a longer text is a run of its own."""
    ids: list[pa.Array] = []
    texts: list[pa.Array] = []
    size = 0

    def group() -> tuple[pa.Array, pa.Array]:
        out = pa.concat_arrays(ids), pa.concat_arrays(texts)
        ids.clear()
        texts.clear()
        return out

    for batch in batches:
        column_ids, column_texts, at = batch.column(0), batch.column(1).fill_null(""), 0
        for i, n in enumerate(pc.binary_length(column_texts).to_pylist()):
            if size and size + n > GROUP_BYTES:
                ids.append(column_ids.slice(at, i - at))
                texts.append(column_texts.slice(at, i - at))
                yield group()
                at, size = i, 0
            size += max(n, 1)
        ids.append(column_ids.slice(at))
        texts.append(column_texts.slice(at))
    if size:
        yield group()


def pieces_of(totals: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and length of the pieces of texts of so many ids."""
    rows: list[int] = []
    lengths: list[int] = []
    for i, n in enumerate(totals.tolist()):
        parts = split_lengths(n, most)
        rows += [i] * len(parts)
        lengths += parts
    row, length = np.array(rows, np.int64), np.array(lengths, np.int64)
    before = np.cumsum(totals) - totals
    return row, np.cumsum(length) - length - before[row], length


def pack_power_of_two(
    docs: DataFrame,
    tokenizer_path: str,
    sequence_length: int = 4096,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents: ``id_col, start, length, ids, doc_tokens, sequence_id, offset``.

    A document's ids end with ``end_id``; they are cut into pieces of ``sequence_length`` and of the
    powers of two of the remainder. A piece is a sequence of its own (``offset`` 0), equal lengths
    form one bucket (``length``), so batches of a bucket need no padding and no sequence holds two
    documents. ``ids`` is binary, little-endian unsigned 32-bit. Null and empty texts have the end id
    alone: one piece of length 1. Repeated rows are packed apiece; an empty table gives an empty one;
    other columns are not read. ``sequence_length`` must be a power of two. Nothing is shuffled.
    """
    if sequence_length & (sequence_length - 1) or sequence_length < 1:
        raise ValueError("sequence_length must be a power of two")
    prepare(docs.sparkSession)
    id_type = next(f.dataType for f in docs.schema if f.name == id_col).simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs_ids, texts in by_bytes(batches):
            ids, totals = encode_texts(texts, tokenizer_path, end_id)
            row, start, length = pieces_of(totals, sequence_length)
            edges = np.zeros(len(length) + 1, np.int64)
            np.cumsum(4 * length, out=edges[1:])
            cut = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(edges), pa.py_buffer(ids)])
            columns = [docs_ids.take(pa.array(row)), pa.array(start), pa.array(length), cut.cast(pa.binary()), pa.array(totals[row])]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "start", "length", "ids", "doc_tokens"])

    schema = f"`{id_col}` {id_type}, start long, length long, ids binary, doc_tokens long"
    packed = docs.select(column(id_col), column(text_col)).mapInArrow(pieces, schema)
    return packed.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn(
        "offset", F.lit(0).cast("long")
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write pieces as Parquet, a folder for each length: batches of a folder need no padding.

    Each task writes its own pieces of a length, so nothing is shuffled; ``packed`` may be repartitioned
    by ``length`` and a hash beforehand where fewer files are wanted.
    """
    packed.write.mode("overwrite").partitionBy("length").parquet(path)

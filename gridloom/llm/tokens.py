"""Token counts: pieces of each distinct pre-token, joined to a document's pre-token frequencies."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import column, prepare, raw_texts
from gridloom.llm.pieces import Memo, memo_for

#: A run of white space belongs to what follows it; the tokenizer's pattern starts a new pre-token at
#: each such place, so chunks can be counted apart.
CHUNK = re.compile(rb"[ \t-\r]*+[^ \t-\r]++|[ \t-\r]++")
#: White space beyond ASCII, and the chunks of a text that has some.
_WIDE = rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
WIDE_SPACE = re.compile(_WIDE)
_WIDE_LEADS = (b"\xc2", b"\xe1", b"\xe2", b"\xe3")
WIDE_CHUNK = re.compile(rb"(?:[ \t-\r]|%s)*+(?:(?![ \t-\r]|%s)[\s\S])++|(?:[ \t-\r]|%s)++" % ((_WIDE,) * 3))


def count_tokens(texts: list[bytes], path: str) -> list[int]:
    """Token counts of whole texts, as ``Tokenizer.encode(text, add_special_tokens=False)`` has them.

    No ids are built for a text: it becomes frequencies of chunks, a chunk's number of pieces is
    found once a worker, and the sum of frequency times number is the count. Empty texts have 0.
    """
    memo = memo_for("tokens", path, lambda: Memo(path, len))
    out = [0] * len(texts)
    tables: list[tuple[int, Counter]] = []
    size = 0

    def settle() -> None:
        memo.learn(set().union(*(table for _, table in tables)))
        for i, table in tables:
            out[i] = sum(n * memo[chunk] for chunk, n in table.items())
        tables.clear()

    for i, raw in enumerate(texts):
        wide = not raw.isascii() and any(lead in raw for lead in _WIDE_LEADS) and WIDE_SPACE.search(raw)
        tables.append((i, Counter((WIDE_CHUNK if wide else CHUNK).findall(raw))))
        size += len(raw)
        if size > 4_000_000:
            settle()
            size = 0
    settle()
    return out


def token_counts(
    docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Columns ``id_col, n_bytes, n_tokens, over_limit``, a row for each row of ``docs``.

    Null texts are empty: 0 bytes, 0 tokens. Repeated rows give repeated rows, an empty table an
    empty one; further columns of ``docs``, whatever their names, are not read. Special tokens'
    strings inside a text count as the library's default has it. Nothing is shuffled: a join
    through an exchange would move every document's distinct pre-tokens.
    """
    prepare(docs.sparkSession)

    @F.arrow_udf("long")
    def tokens(text: pa.Array) -> pa.Array:
        return pa.array(count_tokens(raw_texts(text), tokenizer_path), pa.int64())

    counted = docs.select(
        column(id_col).alias(id_col),
        F.coalesce(F.octet_length(column(text_col)), F.lit(0)).cast("long").alias("n_bytes"),
        tokens.asNondeterministic()(column(text_col)).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

import re
import struct
from pathlib import Path

import corpus_pipeline as cp
import pytest

from gridloom.llm.common import SharedTables
from tests.llm.test_dedup import brute
from tests.llm.test_text_operators import brute_hits, library


@pytest.fixture(scope="module")
def stages(spark, tiny, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{tiny}/documents.parquet"), []
    for i, (_, stage) in enumerate(cp.STAGES):
        path = str(folder / str(i))
        stage(spark, docs, tiny).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns_and_order(spark, tiny, stages):
    columns = spark.read.parquet(f"{tiny}/documents.parquet").columns
    assert [name for name, _ in cp.STAGES] == ["quality classifier", "minhash near-dedup", "benchmark decontamination", "secret scans", "packing"]
    assert all(df.columns == columns for df in stages[:-1])
    counts = [df.count() for df in stages[:-1]]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0


def test_near_dedup_stage(stages):
    before, after = texts(stages[0]), texts(stages[1])
    expected = {i for i, (_, least) in brute(list(before.items()), k=5).items() if i == least}
    assert after.keys() == expected and all(after[i] == before[i] for i in after)


def test_decontamination_stage(spark, tiny, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    before = texts(stages[1])
    assert texts(stages[2]) == {i: t for i, t in before.items() if not brute_hits(t, items)[-1]}


def test_secret_stage(stages):
    before, after = texts(stages[2]), texts(stages[3])
    planted = re.compile(r'(token = ")[0-9a-f]{40}"', re.I)
    assert after == {i: planted.sub(r'\1[SECRET]"', t) for i, t in before.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in stages[3].collect())


def test_packing_stage_and_run(spark, tiny, stages):
    lib = library("word_bpe_49k.json")
    docs, joined = texts(stages[3]), {}
    for r in sorted(stages[4].collect(), key=lambda r: (r["doc_id"], r["start"])):
        joined[r["doc_id"]] = joined.get(r["doc_id"], b"") + r["ids"]
    for i, t in docs.items():
        ids = lib.encode(t, add_special_tokens=False).ids + [2]
        assert joined[i] == struct.pack(f"<{len(ids)}I", *ids)
    key = lambda r: (r["doc_id"], r["start"], r["length"], bytes(r["ids"]))
    assert sorted(map(key, cp.run(spark, tiny).collect())) == sorted(map(key, stages[4].collect()))


def test_stages_start_on_collected_heaps(spark, tiny):
    """Each stage has the executors, here the driver's JVM, collect their garbage before its own work."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if re.search("Old|MarkSweep", b.getName()))
    docs = spark.read.parquet(f"{tiny}/documents.parquet").limit(20)
    for name, stage in cp.STAGES[2:]:
        before = full()
        stage(spark, docs, tiny)
        assert full() > before, name


def test_tables_return_freed_native_memory(spark):
    """What the driver's JVM has freed natively goes back to the system with each intermediate table."""
    jvm = spark._jvm
    maps = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps")

    def resident():
        """MB in the C library's arenas, which are of 64 MB at most and start at a multiple of that."""
        total = arena = 0
        for line in maps.read_text().splitlines():
            if found := re.match(r"([0-9a-f]+)-([0-9a-f]+) ", line):
                start, end = (int(x, 16) for x in found.groups())
                arena = start % (64 << 20) == 0 and end - start <= 64 << 20
            elif arena and line.startswith("Anonymous:"):
                total += int(line.split()[1]) / 1024
        return total

    with SharedTables(spark, "native") as tables:
        for i in range(2):
            tables.save(spark.range(1), f"before-{i}")
        blocks = [jvm.java.util.zip.Deflater() for _ in range(1000)]
        for block in blocks[:-1]:  # the last one stands at the end of its arena
            block.end()
        freed = resident()
        tables.save(spark.range(1), "after")
        assert resident() < freed - 40
        blocks[-1].end()
        assert spark.read.parquet(f"{tables.base}/after").count() == 1
        tables.drop("before-0", "before-1", "after")

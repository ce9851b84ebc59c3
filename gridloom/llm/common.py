"""What the text operators share: session settings, shared tables, word hashes."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from py4j.protocol import Py4JError
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of one Arrow batch; a row is a whole document, so the default of 10 000 is too many.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: Bytes of an intermediate table's row group, which its writer holds in memory.
ROW_GROUP_BYTES = 16 << 20
#: Entries of a worker's memo of words; it is emptied when full.
MEMO_ENTRIES = 400_000

LOWER_ASCII = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: A-Z to a-z; every other ASCII character that is no letter or digit becomes a space.
ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)
UPPER_SQL, LOWER_SQL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches and make this package importable on the workers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = str(Path(__file__).resolve().parents[2])
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.getcwd() == root:
        return
    sc = spark.sparkContext
    if getattr(sc, "_gridloom_shipped", None) is None:
        import shutil

        stage = Path(tempfile.mkdtemp(prefix="gridloom-ship-"))
        package = Path(root) / "gridloom"
        shutil.copytree(package, stage / "src" / "gridloom", ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(str(stage / "gridloom"), "zip", stage / "src"))
        sc._gridloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a local one only where driver and executors are one process."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_gridloom_dir", None)
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = sc._gridloom_dir = f"file://{tempfile.mkdtemp(prefix='gridloom-')}"
    return found


def trim_native_heap(spark: SparkSession) -> bool:
    """Return what the driver's JVM has freed of its native memory to the system; False where it cannot.

    Compiling and planning on hundreds of threads leaves freed blocks in as many arenas of the C
    library, which keeps them. JVMs on glibc have a diagnostic command that gives them back.
    """
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    try:
        beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        # by the interface's method, since the server's own class is not open to reflection
        kind = jvm.java.lang.Class.forName("javax.management.MBeanServer")
        invoke = next(m for m in kind.getMethods() if m.getName() == "invoke")
        given = gateway.new_array(jvm.java.lang.Object, 4)
        given[0], given[1] = command, "systemTrimNativeHeap"
        invoke.invoke(beans, given)
    except Py4JError:  # another JVM or C library
        return False
    return True


def collect_on_executors(spark: SparkSession) -> None:
    """Have each executor's JVM collect its garbage, with a task for each.

    A JVM grows its heap as work comes and seldom gives any back by itself, so what a stage of large
    joins took would stand beside the memory of the next stage's Python workers. After a full
    collection it keeps little more than what is in use.
    """
    n = max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)  # the driver is among them
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


class SharedTables:
    """Parquet tables in the shared folder, which outlive lost executors, and kept frames.

    A kept frame is cached on the executors' disks with its lineage: what is lost with an executor
    is computed again. As a context, a failure drops everything at once; what is left at the end of
    the application, such as a returned table, goes with it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.kept: list[DataFrame] = []
        self.saved: list[str] = []
        self.base = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def __enter__(self) -> SharedTables:
        return self

    def __exit__(self, kind, error, trace) -> None:
        self.release()
        if kind is not None:
            files, path = self._files(self.base)
            files.delete(path, True)

    def _files(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark._jsc.hadoopConfiguration()), found

    def save(self, df: DataFrame, name: str, files: int = 0) -> DataFrame:
        """Write and reread; ``files`` deals small results out to so many files."""
        path = f"{self.base}/{name}"
        self.saved.append(name)
        writer = (df.repartition(files) if files else df).write.mode("overwrite")
        # a marker of success would be one more file, and on local disks a process, of the driver
        writer = writer.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
        writer.option("parquet.block.size", str(ROW_GROUP_BYTES)).parquet(path)
        if len(self.saved) == 1:
            system, folder = self._files(self.base)
            system.deleteOnExit(folder)
        trim_native_heap(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def settle(self) -> None:
        """Have the driver forget plans, broadcasts and shuffles that no frame refers to any more, and all JVMs return freed memory."""
        self.spark._jvm.System.gc()
        trim_native_heap(self.spark)
        collect_on_executors(self.spark)

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.append(df.persist(StorageLevel.DISK_ONLY))
        return self.kept[-1]

    def release(self, *frames: DataFrame) -> None:
        """Uncache these frames, or all."""
        for df in frames or tuple(self.kept):
            df.unpersist()
            self.kept = [x for x in self.kept if x is not df]

    def drop(self, *names: str) -> None:
        for name in names:
            self.saved.remove(name)
            files, path = self._files(f"{self.base}/{name}")
            files.delete(path, True)


def column(name: str):
    """A column by its name, whatever signs that holds."""
    return F.col("`" + name.replace("`", "``") + "`")


#: A key of over a thousandth of the rows, and of this many, is hot; its rows go to so many tasks.
HOT_ROWS, HOT_PARTS = 1000, 200


def hot_keys(counted: DataFrame, key: str, n: str, total: int) -> list:
    """The hot keys, at most a thousand, of a table of keys with their numbers of rows."""
    return [r[0] for r in counted.where((F.col(n) > HOT_ROWS) & (F.col(n) * 1000 > total)).select(key).collect()]


def join_split(rows: DataFrame, other: DataFrame, key: str, by: str, hot: list | None = None, how: str = "inner") -> DataFrame:
    """``rows.join(other, key, how)``, in which the rows of a hot key are dealt by a hash of ``by``.

    ``other`` is repeated for the hot keys alone. Rows with a null key, which match nothing, are
    dealt in the same way. Without ``hot`` the rows are counted by key first, so they should be kept.
    """
    if hot is None:
        counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_"))
        hot = hot_keys(counts, key, "n_", rows.count())
    if not hot and how == "inner":
        return rows.join(other, key)
    kind = rows.select(key).schema[0].dataType
    marks = F.broadcast(rows.sparkSession.createDataFrame([(k, True) for k in hot], T.StructType([T.StructField(key, kind), T.StructField("hot_", T.BooleanType())])))
    part = F.pmod(F.xxhash64(by), F.lit(HOT_PARTS)).cast("int")
    dealt = rows.join(marks, key, "left").withColumn("part_", F.when(F.col("hot_") | F.col(key).isNull(), part).otherwise(0)).drop("hot_")
    parts = F.when(F.col("hot_"), F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0)))
    copies = other.join(marks, key, "left").withColumn("part_", F.explode(parts)).drop("hot_")
    return dealt.join(copies, [key, "part_"], how).drop("part_")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(column):
    """Lower-case A-Z only, as the contracts say."""
    return F.translate(column, UPPER_SQL, LOWER_SQL)


def held_out(column):
    """Rows that no model learns from: crc32 of the id's text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(column.cast("string")) % 3 == 1, F.lit(False))


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word bytes -> xxh3 64-bit hash; a memo, so each frequent word is hashed once a worker."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


WORDS = WordHashes()
#: A worker's memos by name. A reused worker holds those of one operator at a time.
MEMOS: dict[str, dict] = {"words": WORDS}


def focus(name: str) -> None:
    """Empty the memos that the operator at work doesn't use."""
    stale = [memo for key, memo in MEMOS.items() if key != name and memo]
    for memo in stale:
        memo.clear()
    if stale:
        pa.default_memory_pool().release_unused()


_STEP = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of k consecutive word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out = (out ^ (out >> np.uint64(29))) * _STEP + h[j : j + n]
    return mix64(out)


def list_array(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))

"""What the text operators share: tables, words, hashes, shared storage, batches."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java pattern of a word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of rows that go to a Python worker at once (a longer row goes alone); Spark's own bound
#: is 64 MB, which each task would hold several times.
BATCH_BYTES, _SPARKS_BYTES = "4000000b", 67_108_864
MASK64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what Arrow hands to Python at once, by bytes, as texts may be long. The option is
    read when a plan runs, so it stays set; a session's own value is left as it is."""
    option = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(option, "1").rstrip("b") == str(_SPARKS_BYTES):
        spark.conf.set(option, BATCH_BYTES)


def native_words(text: Column) -> Column:
    """The words of a text, in order, with built-in functions; null: none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a temporary one,
    if driver and executors are one process; ValueError on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pcframe-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    # with its file system's name, which the writers in Python need as well
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A new folder's path below the shared one; removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/pcframe-{what}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may have gone first; the folder is scratch space
        pass


def cut(df: DataFrame, what: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it: later reads don't recompute
    it, and survive a lost executor."""
    spark = df.sparkSession
    path = fresh_dir(spark, what)
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of cut() that nothing reads any more."""
    for df in tables:
        _remove(df.sparkSession, df.cut_path)


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system for side files and the path there, from a Spark path."""
    if "://" not in uri:
        uri = "file://" + re.sub("^file:", "", uri)
    return pafs.FileSystem.from_uri(uri)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b or b"" for b in column.cast(kind).to_pylist()]


def _odd(seed: int, n: int) -> list[int]:
    out, x = [], seed
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & MASK64
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK64
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & MASK64
        out.append((z ^ (z >> 31)) | 1)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the splitmix64 one)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def window_hashes(words: np.ndarray, k: int, lane: int) -> np.ndarray:
    """Multilinear 64-bit hashes of all windows of k words, from one lane of word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    w, out = np.ascontiguousarray(words[:, lane]), np.zeros(n, np.uint64)
    for j, c in enumerate(_odd(0xA5A5 + 977 * lane, k)):
        out += w[j : j + n] * np.uint64(c)
    return mix64(out)


def release() -> None:
    """Give memory that is free back to the system, at a task's end: workers are used again, and
    what they keep counts beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def attempt_name(stem: str) -> str:
    """A file name of this task attempt's own: a retried or speculative attempt can't spoil
    the file that a committed one has reported."""
    from pyspark import TaskContext

    c = TaskContext.get()
    return f"{stem}-{c.partitionId():06d}-{c.taskAttemptId()}" if c else f"{stem}-{os.getpid()}"

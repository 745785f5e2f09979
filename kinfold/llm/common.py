"""Session, scratch-table and Arrow helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import ctypes.util
import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a numpy kernel works on at a time; its scratch arrays take some 80 times as much.
SLICE_BYTES = 1_000_000
#: Bytes of an Arrow batch between the JVM and Python, which holds one row at least. Both sides hold batches whole.
BATCH_BYTES = 4_000_000
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes, as Spark estimates them (of compressed files, for stored tables), of a join's side that it may broadcast: the driver holds
#: a broadcast table whole, several times and with others beside it.
BROADCAST_BYTES = 1_000_000
_BROADCAST_CONF, _ADAPTIVE_CONF = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of the session take BATCH_BYTES at most; a smaller setting stays."""
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def small_broadcasts(spark: SparkSession) -> None:
    """Joins of the session broadcast BROADCAST_BYTES at most; a smaller setting, or none, stays."""
    if spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold() > BROADCAST_BYTES:
        spark.conf.set(_BROADCAST_CONF, str(BROADCAST_BYTES))
    adaptive = spark.conf.get(_ADAPTIVE_CONF, None)  # where it isn't set, the other one holds
    if adaptive is not None and not adaptive.startswith("-") and spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(adaptive) > BROADCAST_BYTES:
        spark.conf.set(_ADAPTIVE_CONF, str(BROADCAST_BYTES))


@functools.cache
def _libc() -> ctypes.CDLL | None:
    lib = ctypes.CDLL(ctypes.util.find_library("c") or None)
    return lib if hasattr(lib, "malloc_trim") else None


def release() -> None:
    """Hands free memory back to the system. Executors keep idle Python workers, which would hold their peak otherwise."""
    pa.default_memory_pool().release_unused()
    if _libc():
        _libc().malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    small_broadcasts(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.
    Only where that is unset (tests, local mode) a temporary folder takes its place."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir", None) or getattr(spark, "_kinfold_shared", None)
    if where is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="kinfold-")
        sc.setCheckpointDir(where)
        spark._kinfold_shared = where
    return where.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/kinfold/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def remove() -> None:
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # the JVM may have ended first; the folder's owner then clears it by application id
            pass

    atexit.register(remove)
    return path


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: its lineage is cut and a lost executor
    costs no recomputation of what came before."""
    small_batches(spark)
    small_broadcasts(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def blob(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string or binary column, without copies where Arrow allows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    chars = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return chars, bounds


def slices(bounds: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of rows with at most limit bytes, or one row. Memory that they leave free goes back after the last."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j
    release()


def cut(chars: np.ndarray, bounds: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    return chars[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]


def binary_array(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Rows data[bounds[i]:bounds[i + 1]] as an Arrow binary column."""
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def partitions(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores put in front until no column of df has them."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        out.append(n)
    return out

"""What the operators share: tables, the shared folder, and columnar text access."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. A temporary one stands in only for a local session that has none set."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = getattr(spark.sparkContext, "_pairlens_dir", None) or "file://" + tempfile.mkdtemp(prefix="pairlens-")
        spark.sparkContext._pairlens_dir = found
    return found


def _file_system(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again: cuts the lineage, survives lost executors.

    The table goes when the driver's JVM ends, or by discard().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pairlens/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    system, where = _file_system(spark, path)
    system.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._pairlens_path = path
    return out


def discard(table: DataFrame) -> None:
    """Deletes a table of written() that nothing reads any more."""
    system, where = _file_system(table.sparkSession, table._pairlens_path)
    system.delete(where, True)
    system.cancelDeleteOnExit(where)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_sample(df: DataFrame, most: int, *order: str) -> DataFrame:
    """At most ``most`` rows of df, those of smallest hash of the first column named; ties by all of them.

    A threshold on the hash, set by the number of rows, leaves about a tenth more than ``most`` before the sort, so no
    task and not the driver gets as many rows from each partition.
    """
    spread = 1 << 30
    share = 1.1 * most / max(1, df.count()) + 1e-7
    hashed = F.pmod(F.xxhash64(order[0]), F.lit(spread))
    return df.where(hashed < int(min(1.0, share) * spread) + 1).orderBy(F.xxhash64(order[0]), *order).limit(most)


#: Rows of text in an Arrow batch, at most: Spark counts rows, not bytes, and texts may be long.
TEXT_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows in an Arrow batch to TEXT_ROWS."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, giving unused memory back to the system at its end: workers live on, idle, beside the next stages' work."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def doc_id_text(df: DataFrame) -> DataFrame:
    """doc_id and text only; further columns, whatever their names, stay behind."""
    small_batches(df.sparkSession)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that ``column`` holds about ``most`` bytes in each; a longer row stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(lengths, dtype=np.int64) - lengths) // most
        cuts = np.flatnonzero(np.diff(group)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def joined_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column as one array, and each row's start (one more at the end); nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads the bits of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x

"""What the operators share: the shared folder, materialised tables, partition counts and packed key lists."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.ship import ship  # noqa: F401

TEXT_PER_BLOCK = 24 << 20  # estimated bytes of text that one task holds
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a temporary one only in local mode without that setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the Python process ends, or with :func:`release`."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def materialise(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder (in folders ``by`` some columns) and read it again: cuts lineage, and outlives executors."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete all tables that :func:`materialise` has left."""
    while _made:
        spark, path = _made.pop()
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may be gone already  # noqa: BLE001, S110
            pass


atexit.register(release)


def blocks_for(df: DataFrame, per_block: int = TEXT_PER_BLOCK) -> int:
    """As many blocks as shuffle partitions, more where the plan's size estimate asks for it."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(n, size // per_block + 1) if size < 1 << 60 else n


def ranges_for(df: DataFrame, blocks: int) -> int:
    """Ranges of the hash space: as many as shuffle partitions, or an eighth of the blocks, whose distinct keys a range's task can still hold."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks // 8)


def deal(blocks: int) -> Column:
    """Block of a row with doc_id and text: by both, and by the row's partition, so that neither repeated rows nor null ids gather.

    A row's partition is the same whenever its task is run again, and the places
    that use the blocks share one exchange.
    """
    return F.pmod(F.xxhash64("doc_id", F.length("text"), F.spark_partition_id()), F.lit(blocks)).cast("int")


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(of)


def sorted_distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each occurs."""
    if not len(x):
        return x, np.zeros(0, np.int64)
    x = np.sort(x)
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return x[first], np.diff(np.append(first, len(x)))


def with_inverse(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and the place of each entry's value among them."""
    if not len(x):
        return x, np.zeros(0, np.int64)
    order = np.argsort(x)
    y = x[order]
    first = np.concatenate([[True], y[1:] != y[:-1]])
    inverse = np.empty(len(x), np.int64)
    inverse[order] = np.cumsum(first) - 1
    return y[first], inverse


def pack_ints(x: np.ndarray) -> bytes:
    """Nonnegative integers with as many bytes each as the largest needs; the first byte says how many."""
    if not len(x):
        return b""
    wide = max(1, (int(x.max()).bit_length() + 7) // 8)
    return bytes([wide]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide]).tobytes()


def unpack_ints(b: bytes) -> np.ndarray:
    if not b:
        return np.zeros(0, np.uint64)
    flat = np.frombuffer(b, np.uint8, offset=1).reshape(-1, b[0])
    out = np.zeros((len(flat), 8), np.uint8)
    out[:, : b[0]] = flat
    return out.view("<u8").ravel()


def pack_keys(x: np.ndarray) -> bytes:
    """Sorted distinct keys as packed differences."""
    return pack_ints(np.diff(x, prepend=np.uint64(0))) if len(x) else b""


def unpack_keys(b: bytes) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(unpack_ints(b), dtype=np.uint64)


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of ``buckets`` equal ranges of the 64-bit space begins among sorted keys (one more entry at the end)."""
    edges = np.arange(1, buckets, dtype=np.uint64) * np.uint64(2**64 // buckets) if buckets > 1 else np.zeros(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).astype(np.int64)


def merge_totals(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys of several sorted lists, each key's summed count, and each list's entries' places among them."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), []
    every = np.concatenate(keys)
    found, inverse = with_inverse(every)
    total = np.bincount(inverse, weights=np.concatenate(counts).astype(np.float64), minlength=len(found)).astype(np.int64)
    return found, total, np.split(inverse, np.cumsum([len(k) for k in keys])[:-1])


def arrow_batches(rows: pa.Table, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    yield from rows.to_batches(max_chunksize=size)


def as_array(col: pa.ChunkedArray | pa.Array) -> pa.Array:
    """One contiguous array."""
    if isinstance(col, pa.ChunkedArray):
        return col.chunk(0) if col.num_chunks == 1 else pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    return col

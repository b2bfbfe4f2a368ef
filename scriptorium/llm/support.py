"""What the operators share: the shared work folder, Arrow helpers, stable sampling."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_ROWS = 2000

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``. Only a local session gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not (spark.conf.get("spark.master", "") or "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='scriptorium-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    _made.append((spark, own))
    return own


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may already be gone when the interpreter ends
        pass


@atexit.register
def _clean() -> None:
    while _made:
        _delete(*_made.pop())


def deleted_at_exit(spark: SparkSession, path: str, now: bool = False) -> str:
    """``path``, which goes when the driver ends, or at once."""
    if (spark, path) not in _made:
        _made.append((spark, path))
    if now:
        _delete(spark, path)
        _made.remove((spark, path))
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` cut from its lineage: written as Parquet to the shared folder and read again.

    The folder goes when the driver ends; lost executors lose nothing of it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete tables made by :func:`written` that nothing reads any more."""
    for df in frames:
        for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            name = root.rsplit("/", 1)[1]
            for entry in [m for m in _made if m[1].endswith(name)]:
                _delete(*entry)
                _made.remove(entry)


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` over batches of ``BATCH_ROWS`` at most, so that neither the JVM nor Python holds many long texts at once."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        release_memory()

    return df.mapInArrow(run, schema)


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n`` (0 for a null key)."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % F.lit(n), F.lit(0)).cast("int")


def hash_share(key: Column, rows: int, total: int) -> Column:
    """Whether the hash of ``key`` is among the lowest share that leaves about ``rows`` of ``total``; always, if there are no more."""
    scale = 1 << 30
    return F.lit(True) if total <= rows else F.pmod(F.xxhash64(key, F.lit(17)), F.lit(scale)) < int(scale * rows / total)


def bounded_sample(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """About ``rows`` rows of ``df`` at most, the same ones every time; all of them if there are fewer.

    Rows whose hashed key falls below the needed share are kept, so nothing is sorted or shuffled."""
    return df.filter(hash_share(key, rows, df.count()))


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from the joined values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def texts(column: pa.Array) -> pa.Array:
    """Texts without nulls (which become empty) as a large_string array that starts at its buffers' beginning.

    Some Arrow kernels misread arrays that are a slice of a longer one, such as ascii_lower in pyarrow 23."""
    import pyarrow.compute as pc

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return pa.array([], pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = data.slice(int(ends[0]), int(ends[-1] - ends[0])) if data is not None else pa.py_buffer(b"")
    return pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(np.ascontiguousarray(ends - ends[0])), body)


def sized(batches: Iterable[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text at most, so long documents don't pile up."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if not len(column):
            continue
        import pyarrow.compute as pc

        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(column):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def gathered(batches: Iterable[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in fewer batches: one is given out when it has ``limit`` bytes of text."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def release_memory() -> None:
    """Hand what Arrow and the C library hold back for later to the system; a Python worker lives on after its task."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more; it does so only when the driver collects its garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()

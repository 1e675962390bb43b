"""Shared plumbing of the training-data operators: tables, shared-folder tables, flat byte views."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A batch is cut into pieces of about this many bytes of text before numpy sees it.
PIECE_BYTES = 256 << 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Keep Arrow batches of whole texts small on both sides of the pipe, for this session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; one of our own only where that is unset and all work is local."""
    sc = spark.sparkContext
    if not (sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)):
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="orrery-"))
    return sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")


def files_for(rows: int, a_file: int = 1_000_000) -> int:
    """How many files a table of so many rows is written to."""
    return 1 + rows // a_file


#: Written tables that still stand: path -> what deletes it.
_tables: dict[str, Callable[[], None]] = {}


def materialize(df: DataFrame, *, what: str = "table", files: int | None = None) -> DataFrame:
    """Cut the lineage: write a table to the shared folder and read it back.

    A number of files, from the rows at hand, keeps narrow tables behind wide shuffles from
    becoming one small file a task; the rows are dealt evenly, without a key. The table goes
    with release(), at the latest when the process ends.
    """
    spark = df.sparkSession
    if files is not None:
        df = df.repartition(files)
    path = f"{shared_dir(spark).rstrip('/')}/orrery-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)

    def remove() -> None:
        jvm = spark.sparkContext._jvm
        if jvm is not None and spark.sparkContext._jsc is not None:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    _tables[path] = remove
    out = spark.read.schema(df.schema).parquet(path)
    out._orrery_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more: only finished, rewritten results may stand on them."""
    for t in tables:
        _tables.pop(t._orrery_path, lambda: None)()


@atexit.register
def _remove_the_rest() -> None:
    while _tables:
        _tables.popitem()[1]()


@lru_cache(1)
def _libc() -> ctypes.CDLL | None:
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def give_back() -> None:
    """Return the memory that a task has freed: workers live on and would hold it."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow whose workers give memory back when a task ends."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(lean, schema)


def bucket_runs(buckets: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of the runs of an ordered array of buckets."""
    if not len(buckets):
        return []
    cuts = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1]))
    return list(zip(buckets[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(buckets)], strict=True))


def extended(schema: T.StructType, columns: str) -> T.StructType:
    """The schema with columns given as DDL appended."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(columns).fields])


def free_shuffles(spark: SparkSession) -> None:
    """Let the context cleaner drop the shuffle files of plans nobody holds any more."""
    import gc
    import time

    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.3)  # the cleaner works beside us


def id_crc(col: str = "doc_id"):
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")))


def flat(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; nulls count as empty."""
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offs, data = arr.buffers()
    n = len(arr)
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def pieces(batch: pa.RecordBatch, col: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch by the bytes of one column; a text over the limit is a piece by itself."""
    if batch.num_rows == 0:
        return
    _, o = flat(batch.column(batch.schema.get_field_index(col)))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(o, o[start] + limit, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated aranges: for each i, starts[i], starts[i]+1, ... (lengths[i] of them)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)

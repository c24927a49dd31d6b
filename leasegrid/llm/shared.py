"""Small helpers of the operators: lineage cuts in the shared folder, the train split, Arrow text access."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leasegrid.session import ensure_checkpoint_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the cluster's shared checkpoint folder and read it back.

    Cuts the lineage, survives lost executors, and gives the planner real sizes.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    # the write's shuffle files go once nothing refers to them: a collection now lets Spark's cleaner drop
    # them before the next step adds its own
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def free(*tables: DataFrame) -> None:
    """Delete the files of ``stored`` tables after their last reader has been written. Later steps must not
    depend on them: a lost executor's work is redone from the tables that remain."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 16 MB in this session: texts can be long, and executors hold several batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def lean(fn):
    """``fn`` over Arrow batches for ``mapInArrow``; its worker gives freed memory back when a task ends,
    as workers stay between tasks."""

    def run(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from fn(batches)
        finally:
            with contextlib.suppress(OSError, AttributeError):  # only where the C library can
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """``df`` marked for broadcast if its measured row count allows; else as it is, for a shuffled join.

    Only for narrow rows of a stored table, as they are counted first.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32(id as text) mod 4 is 2; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 offsets into them; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, dtype=np.int64, count=len(col) + 1 + col.offset)[col.offset:]
    if data is None or len(col) == 0 or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[off[0]:off[-1]], off - off[0]


def row_blocks(offsets: np.ndarray, size: int):
    """Row ranges (lo, hi) of about ``size`` bytes each; a longer row is a block of its own."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi

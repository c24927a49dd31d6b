"""Shared plan helpers."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Largest side we are willing to broadcast, in rows. Dimension tables (markets,
# cluster centroids, medians per market) are far below it; anything beyond goes
# through a shuffle join.
BROADCAST_MAX_ROWS = 200_000


def broadcast_checked(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast ``df`` only after proving it has at most ``max_rows`` rows.

    The side is checkpointed first so the size check does not recompute it; when
    it is larger the plain DataFrame is returned and the planner shuffles. The
    session's cleaner drops the checkpoint with the last reference, so nothing
    stays cached.
    """
    kept = df.checkpoint()
    n = kept.limit(max_rows + 1).count()
    return F.broadcast(kept) if n <= max_rows else kept


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the cluster's shared checkpoint folder, read back: a lineage cut like ``checkpoint``, but
    computed once and compressed. Shuffle files that nothing refers to any more go before the next step adds its own."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def free(table: DataFrame) -> None:
    """Delete the files of a ``stored`` table after its last reader has been written."""
    path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._stored_at)
    path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def is_string(df: DataFrame, col: str) -> bool:
    return df.schema[col].dataType.typeName() == "string"

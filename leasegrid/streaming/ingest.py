"""Structured Streaming: landed listing pages -> listings table, and request scoring.

STR1 reads page files as they land (one JSON page per file, under
``city_slug=<slug>/`` folders), flattens them and appends only listings whose
de-dup key the table does not hold yet. The append is idempotent: a replayed
micro-batch finds its keys present and writes nothing, so the file source's
exactly-once bookkeeping plus this anti-join give exactly-once output.

STR2 scores a stream of requests with any batch scoring function (the estimate
job) in ``foreachBatch``; each epoch's responses are one folder, replaced on replay.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.clean import dedupe_key
from ..sources.listings import flatten_items, page_rows, parse_pages
from ..sources.stored_runs import Serving, estimate_stored, load_serving, newest_version


# Stored keys lie in this many folders, so a micro-batch reads only those its own keys fall into.
KEY_BUCKETS = 256


def _stored_keys(spark: SparkSession, path: str) -> DataFrame | None:
    """Keys of the table with their bucket, or None before the first batch wrote a file."""
    try:
        have = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return have.select("dedupe_key", "key_bucket")


def page_stream(spark: SparkSession, landing_dir: str) -> DataFrame:
    """Streaming page rows with their market taken from the folder name."""
    return page_rows(spark.readStream.format("text").option("wholetext", True).load(landing_dir))


def append_batch(table_dir: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch body: write rows with unseen de-dup keys (and none twice)."""

    def run(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        inc = batch.withColumn("dedupe_key", dedupe_key(batch))
        # first row per key inside the batch, aggregated map-side
        cols = [c for c in inc.columns if c != "dedupe_key"]
        inc = inc.groupBy("dedupe_key").agg(F.min_by(F.struct(*cols), F.struct("source_file", "item_pos")).alias("_r")) \
            .select("dedupe_key", "_r.*") \
            .withColumn("key_bucket", F.pmod(F.xxhash64("dedupe_key"), F.lit(KEY_BUCKETS)).cast("int")).checkpoint()
        have = _stored_keys(spark, table_dir)
        if have is not None:
            buckets = [r["key_bucket"] for r in inc.select("key_bucket").distinct().collect()]  # at most KEY_BUCKETS
            inc = inc.join(have.filter(F.col("key_bucket").isin(buckets)), ["dedupe_key", "key_bucket"], "left_anti")
        inc.withColumn("ingest_epoch", F.lit(epoch_id)).write.mode("append") \
            .partitionBy("key_bucket").parquet(table_dir)

    return run


def start_listing_ingest(spark: SparkSession, landing_dir: str, table_dir: str, checkpoint_dir: str,
                         markets: DataFrame | None = None, available_now: bool = True) -> StreamingQuery:
    items = flatten_items(parse_pages(page_stream(spark, landing_dir)), markets)
    w = items.writeStream.foreachBatch(append_batch(table_dir)).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def start_request_scoring(spark: SparkSession, request_dir: str, schema: str, out_dir: str, checkpoint_dir: str,
                          score: Callable[[DataFrame], DataFrame], available_now: bool = True) -> StreamingQuery:
    """STR2: score each micro-batch of JSON requests; responses lie under ``score_epoch=`` folders."""
    stream = spark.readStream.schema(schema).json(request_dir)

    def run(batch: DataFrame, epoch_id: int) -> None:
        # a replayed epoch replaces its own folder, so no answer is stored twice
        score(batch).withColumn("score_epoch", F.lit(epoch_id)).write.mode("overwrite") \
            .option("partitionOverwriteMode", "dynamic").partitionBy("score_epoch").parquet(out_dir)

    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def start_estimate_stream(spark: SparkSession, request_dir: str, schema: str, out_dir: str, checkpoint_dir: str, store: str,
                          available_now: bool = True, **modes) -> StreamingQuery:
    """STR2 with the stored training: every epoch looks up the newest version, reloads its static sides only when
    it changed, and answers with that version named in each row. ``modes``: comps_first and pooled markets."""
    held: dict[str, Serving] = {}

    def score(batch: DataFrame) -> DataFrame:
        version = newest_version(spark, store)
        if version is None:
            raise ValueError(f"no stored training under {store}")
        if version not in held:
            held.clear()
            held[version] = load_serving(spark, store, version)
        return estimate_stored(held[version], batch, **modes).withColumn("version", F.lit(version))

    return start_request_scoring(spark, request_dir, schema, out_dir, checkpoint_dir, score, available_now)


def land_pages(pages: DataFrame, landing_dir: str) -> None:
    """Write one JSON page per file under city_slug=/page= folders (test helper
    and replay tool for archived pages)."""
    pages.repartition("city_slug", "page").select("city_slug", "page", "page_json") \
        .write.mode("append").partitionBy("city_slug", "page").text(os.path.join(landing_dir))

"""Spark session helpers.

The library never creates its own session inside operators; jobs receive one.
``local_session`` is for tests, the bench and the driver smoke check.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # HotSpot never compiles a method beyond this many bytes; Spark then compiles step by step instead
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # checkpoints written by iterative jobs are removed once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "leasegrid") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("LEASEGRID_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is. Only when it is unset (local tests) do we create a scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="leasegrid-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return conf_dir


def prepare_session(spark: SparkSession) -> None:
    """What every job expects of a session it is handed: a checkpoint folder for
    lineage cuts (the cluster's shared one when configured), UTC session time,
    under which listing dates are interpreted, and no generated method too long to compile:
    the listings' price and type texts make one that ran several times slower."""
    ensure_checkpoint_dir(spark)
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    limit = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.set(limit, str(min(int(spark.conf.get(limit)), int(DEFAULT_CONF[limit]))))

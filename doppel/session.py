"""Spark session and checkpoint-directory helpers.

The library never creates a session on its own inside an operator; callers
pass one in. ``local_session`` is what tests, ``bench.py`` and the smoke entry
use.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job in this package is written for. AQE re-plans joins at
# runtime (skew splitting, partition coalescing); the session time zone is
# pinned so that date formatting is reproducible.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "doppel") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app_name)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("DOPPEL_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory of this session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder (HDFS, object
    store) and is used as is. Only a local-mode session without that setting
    (tests, the smoke entry) gets a private scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder so that "
            "iterative jobs can cut their lineage")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="doppel-ckpt-"))
    return sc.getCheckpointDir()


def written(rows: DataFrame) -> DataFrame:
    """The rows written once below the checkpoint folder and read from there.

    As ``checkpoint()`` it cuts the lineage, but what follows reads only the columns that it
    needs, in tasks of even size. Joins shuffle it unless told otherwise: files of few bytes
    may hold many rows, too many for a broadcast.
    """
    spark = rows.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/doppel-rows-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path).hint("merge")

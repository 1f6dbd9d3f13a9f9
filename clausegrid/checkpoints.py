"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only for a local master without one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        found = tempfile.mkdtemp(prefix="clausegrid-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: After so many checkpoints the driver's garbage is collected: its heap stays small however many plans it has run, and no more than these leave shuffle files.
RELEASE_AFTER = 3
#: Seconds that Spark's cleaner has between two collections: what the first one frees holds the shuffles that the second one does.
PAUSE = 0.1
_written = [0]


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage there."""
    spark = df.sparkSession
    found = shared_dir(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    out = df.checkpoint(eager=True)
    _written[0] += 1
    if _written[0] % RELEASE_AFTER == 0:
        release(spark)
    return out


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files, broadcasts and plans that only cut lineage needed; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(PAUSE)
    spark.sparkContext._jvm.System.gc()

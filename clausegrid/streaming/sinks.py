"""Streams run to their present end, batch by batch into files of the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from clausegrid.checkpoints import shared_dir


def settle(stream: DataFrame, mode: str) -> DataFrame:
    """All rows that a stream's batches give until its source is read; a batch that is run again overwrites its own files."""
    spark, schema = stream.sparkSession, stream.schema
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    spark.createDataFrame([], schema).write.parquet(f"{folder}/rows/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/rows").select(*schema.names)

"""Incremental ingest: a file stream of documents whose chunks replace those of earlier versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import graph


def chunk_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Chunks (id, kind, file_path, idx, text) of Parquet files of (file_path, text) as they arrive."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return graph.chunk_nodes(source)


def run_available(chunks: DataFrame, target: str, checkpoint: str) -> None:
    """Write what has arrived, batch by batch: each batch is a folder of its own, so a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, target: str) -> DataFrame:
    """The chunks of each file's latest batch; a file that became shorter keeps no chunk of its longer version."""
    held = spark.read.parquet(target)
    latest = held.groupBy("file_path").agg({"batch": "max"}).withColumnRenamed("max(batch)", "batch")
    return held.join(latest, ["file_path", "batch"]).drop("batch")

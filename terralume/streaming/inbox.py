"""Folder inbox as a stream: every file is claimed once and grouped into batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.shapes_text import folder_manifest

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def watch(spark: SparkSession, path: str, per_batch: int | None = None) -> DataFrame:
    """Files below a folder; the checkpoint remembers which were claimed."""
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", True)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).load(path)


def collect_batches(files: DataFrame, path: str, checkpoint: str, folder_depth: int = -2) -> None:
    """One manifest row per source folder and micro-batch, written with the batch id."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        folder = F.element_at(F.split("path", "/"), folder_depth)
        folder_manifest(rows, folder).write.mode("overwrite").parquet(f"{path}/lote={batch_id}")

    query = (
        files.writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()

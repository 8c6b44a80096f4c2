"""An extension: files that arrive in a folder, parsed as they come. Every run takes what is new and then ends."""

from __future__ import annotations

from pyspark.sql import SparkSession

from docquarry.sources.text_files import parse


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str) -> None:
    """Blocks of the files that are new in folder, a Parquet folder batch=n under out for each run. A batch that is run again
    after a failure takes the place of its first attempt, so blocks are there once."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    keep = lambda batch, n: parse(batch).write.mode("overwrite").parquet(f"{out}/batch={n}")
    files.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

"""Incremental ingest: the batch sources as streams, for packages that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arriving_files(spark: SparkSession, folder: str, most_a_batch: int = 1000) -> DataFrame:
    """A stream of the files below ``folder``, each once: path, bytes, arrived, suffix, sha256."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", most_a_batch).load(folder)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("arrived"), suffix.alias("suffix"), F.sha2("content", 256).alias("sha256"))


def first_by_digest(files: DataFrame, late: str = "1 day") -> DataFrame:
    """The stream's files without copies of one digest that arrive within ``late`` of each other; older state is dropped."""
    return files.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["sha256"])


def arrivals_by_suffix(files: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Files and bytes by suffix in tumbling windows of their arrival."""
    grouped = files.withWatermark("arrived", late).groupBy(F.window("arrived", window).alias("w"), "suffix")
    return grouped.agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes")).select(F.col("w.start").alias("since"), "suffix", "files", "bytes")


def ingest(files: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what has arrived to a Parquet table and stops; a later run takes up where this one ended."""
    return files.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

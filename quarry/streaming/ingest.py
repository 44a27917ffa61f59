"""Ingest as a stream: new files of a folder, or micro-batches of documents, through the same idempotent upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources import parsers


def watch_folder(spark: SparkSession, engine, folder: str, checkpoint: str, ocr=None):
    """Each micro-batch of new files is parsed and ingested; a batch that comes twice changes nothing."""
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def each(batch: DataFrame, _: int) -> None:
        parsed = parsers.parse_files(batch, ocr).filter("error IS NULL")
        engine.ingest(parsed.select(F.lit("arquivo").alias("source"), F.col("path").alias("external_id"), F.regexp_extract("path", r"([^/]+?)(\.[^./]+)?$", 1).alias("title"), F.col("path").alias("url"), F.col("text").alias("content"), F.create_map(F.lit("extracao"), F.col("kind")).alias("metadata")))

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changed_documents(stream: DataFrame, key: str = "external_id", late: str = "1 hour") -> DataFrame:
    """Of a stream of document versions (key, content, ts) those whose content hash is new for the key within the watermark."""
    return stream.withWatermark("ts", late).withColumn("content_hash", F.sha2("content", 256)).dropDuplicatesWithinWatermark([key, "content_hash"])

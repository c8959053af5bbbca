"""Continuous ingestion of file snapshots into a keyed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators import chunking
from weftline.sources.tables import Store


def stream_files(spark: SparkSession, path: str, schema: str, max_files: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def ingest(files: DataFrame, store: Store, checkpoint: str, most: int = chunking.MOST) -> StreamingQuery:
    """Chunks each micro-batch and puts it into the table: chunks of a file in the batch replace those it had.

    Only the buckets that the batch's files fall into are read and written. Reruns of a batch end alike.
    """

    def merge(batch: DataFrame, _: int) -> None:
        chunks = chunking.chunked(batch, most=most).withColumn("chunk_id", F.concat_ws("::", "file_path", F.col("part").cast("string")))
        store.replace("chunks", chunks, batch.select("file_path"))

    return files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_rates(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Counts and means by window and type; events later than `late` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))

"""Streaming ingestion: landed rows are upserted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import get_or_create


def upsert_stream(landed: DataFrame, table: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Appends the rows of a stream that a Parquet folder lacks by `keys`. A repeated batch adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table)
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        existing = spark.read.schema(batch.schema).parquet(table) if there else spark.createDataFrame([], batch.schema)
        get_or_create(existing, batch, keys).where("created").drop("created").write.mode("append").parquet(table)

    return landed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events by tumbling window and type, for streams and tables alike; rows later than `late` are left out of streams."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")

"""An extension: rows that arrive, packed into chunks as a stream, each input file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest(spark: SparkSession, source: str, schema, output: str, checkpoint: str, files_per_trigger: int = 8):
    """A query that writes what is in source and not in output yet, and stops; run again, it goes on. Chunks are files, a batch a folder."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    return stream.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, key: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Rows of each key and window of event time; rows later than `late` are left out when events is a stream."""
    timed = events.withColumn("_ts", F.col(time).cast("timestamp")).withWatermark("_ts", late)
    counts = timed.groupBy(F.window("_ts", width), key).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), key, "n")

"""Streams that end: files that are there are worked through with watermarks and state, then the result is a table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.storage import shared_path


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is available, with its state and output in the shared folder; the output as a table."""
    spark = stream.sparkSession
    base = shared_path(spark, name)
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", f"{base}/out").outputMode("append")
    else:  # complete: each batch replaces the table
        writer = stream.writeStream.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out"))
    query = writer.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A parquet file or folder as a stream."""
    schema = spark.read.parquet(path).schema
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    one = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    folder = os.path.dirname(path) if one else path
    reader = spark.readStream.schema(schema)
    if folder != path:
        reader = reader.option("pathGlobFilter", os.path.basename(path))
    return reader.parquet(folder)


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "30 days") -> DataFrame:
    """(start, event_type, n, total): events of each type in tumbling windows, with a watermark for late ones."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def first_results(results: DataFrame, key: str = "custom_id", late: str = "400 days") -> DataFrame:
    """Each key once, from the first of its rows that arrives; the state holds keys of the last ``late`` only."""
    return results.withWatermark("finished_at", late).dropDuplicatesWithinWatermark([key])

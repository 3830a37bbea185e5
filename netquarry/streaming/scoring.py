"""Scoring of a stream: each micro-batch goes through a table-to-table function and is appended once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def scored_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append what score makes of each batch to Parquet below `out`, a folder for each batch: a batch that is run again overwrites its own."""

    def sink(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def windowed_counts(stream: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by kind and window of time, for streams and tables alike; later rows than `late` are dropped from streams."""
    own = stream.withWatermark(time, late) if stream.isStreaming else stream
    return own.groupBy(F.window(time, width)["start"].alias("start"), F.col(kind)).agg(F.count("*").alias("n"))


def stream_of(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)

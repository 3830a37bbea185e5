"""Helpers that the document operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from netquarry.session import shared_dir

#: Rows of a table that may be broadcast, and bytes of their texts; larger ones are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
#: Longest key, in bytes, of those that `join_hot` broadcasts.
KEY_BYTES = 1 << 16
#: Largest Arrow batch handed to Python, in rows and bytes.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20
#: Bytes of a row group of a written table; a task holds one in memory.
ROW_GROUP = 16 << 20
#: The six separators of words, and what a word is.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def tune(spark: SparkSession) -> SparkSession:
    """Bound the batches of readers and of Arrow, so that a run of very long texts can't fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(BATCH_ROWS))
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: the rows as a Parquet table in the shared folder, read again. A lost executor costs no more than its own tasks."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").option("parquet.block.size", str(ROW_GROUP)).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete written tables that no later step reads. What was made of them must be written too."""
    for df in frames:
        spark, path = df.sparkSession, df.__dict__.pop("_written_at", None)
        if path:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores as it takes to clash with no column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """df with a broadcast hint if a count shows at most `most` rows, with BROADCAST_BYTES of texts and bytes at most, and whether it has one; df should be written already."""
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if isinstance(f.dataType, BinaryType | StringType)]
    one = df.limit(most + 1).agg(F.count("*").alias("n"), F.sum(sum(texts, F.lit(0)).cast("long")).alias("bytes")).first()
    few = one["n"] <= most and (one["bytes"] or 0) <= BROADCAST_BYTES
    return (F.broadcast(df) if few else df), few


def join_hot(left: DataFrame, right: DataFrame, key: str, n: str, spread: str, hot: int = 1000) -> DataFrame:
    """Left join on `key`, whatever the skew. `right` has one row a key; its column `n` counts the rows of the key in `left`.

    Keys with a thousandth of the rows or more, a thousand at most, are broadcast;
    their rows are then dealt out by `spread`, where they meet nothing. No other key has more than that share.
    Texts over KEY_BYTES are never broadcast.
    """
    total = right.agg(F.sum(n).alias("t")).first()["t"] or 0
    is_hot = F.col(n) >= max(2.0, total / hot)
    if isinstance(right.schema[key].dataType, BinaryType | StringType):
        is_hot &= F.octet_length(key) <= KEY_BYTES
    is_hot = F.coalesce(is_hot, F.lit(False))
    extra = [c for c in right.columns if c != key]
    top = F.broadcast(right.filter(is_hot).select(F.col(key).alias("_hot_key"), F.struct(*extra).alias("_hot")))
    rest = right.filter(~is_hot).select(F.col(key).alias("_cold_key"), F.struct(*extra).alias("_cold"), F.xxhash64(key).alias("_cold_deal"))
    met = left.join(top, F.col(key) == F.col("_hot_key"), "left")
    # dealt by a hash beside the key: that of the key, or for rows that are done or have none, one of their own
    deal = F.when(F.col("_hot").isNotNull() | F.col(key).isNull(), F.xxhash64(F.lit("apart"), spread)).otherwise(F.xxhash64(key))
    met = met.withColumn("_deal", deal).join(rest, (F.col("_deal") == F.col("_cold_deal")) & (F.col(key) == F.col("_cold_key")), "left")
    both = F.coalesce("_hot", "_cold")
    return met.select(*[left[c] for c in left.columns], *[both[c].alias(c) for c in extra])


def fresh(df: DataFrame) -> DataFrame:
    """The same columns as new attributes, for use beside another frame of the same tables."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])

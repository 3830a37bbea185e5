"""Ranks over a whole table without a single task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def ranked(df: DataFrame, order: Column, name: str = "rank", by: tuple[str, ...] = (), digits: int = 3) -> DataFrame:
    """df with the place (from 1) of each row by `order`, a text of hexadecimal digits, within the values of `by`, and `<name>_of`, how many rows there are.

    Rows are ranked within the first digits of the text; what stands before each of
    these groups is a running sum over their counts, in two steps: over groups of
    all digits but three, and over the 4096 at most in each of those.
    """
    part, key = f"_{name}_part", f"_{name}_key"
    df = df.withColumn(key, order).withColumn(part, F.substring(key, 1, digits))
    counts = df.groupBy(*by, part).agg(F.count("*").alias("_n")).withColumn("_above", F.substring(part, 1, max(0, digits - 3)))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    tops = counts.groupBy(*by, "_above").agg(F.sum("_n").alias("_n"))
    tops = tops.select(*[F.col(c).alias(f"_{c}_top") for c in by], F.col("_above").alias("_top"), before(W.partitionBy(*by).orderBy("_above")).alias("_before_top"), F.sum("_n").over(W.partitionBy(*by)).alias(f"{name}_of"))
    counts = counts.withColumn("_inner", before(W.partitionBy(*by, "_above").orderBy(part)))
    counts = counts.join(tops, [F.col("_above") == F.col("_top"), *[F.col(c).eqNullSafe(F.col(f"_{c}_top")) for c in by]])
    counts = counts.select(*[F.col(c).alias(f"_{c}_own") for c in by], F.col(part).alias("_part"), (F.col("_before_top") + F.col("_inner")).alias("_before"), f"{name}_of")
    met = df.join(counts, (F.col(part) == F.col("_part")) if not by else [F.col(part) == F.col("_part"), *[F.col(c).eqNullSafe(F.col(f"_{c}_own")) for c in by]])
    place = F.row_number().over(W.partitionBy(*by, part).orderBy(key))
    return met.withColumn(name, F.col("_before") + place).drop(key, part, "_part", "_before", *[f"_{c}_own" for c in by])

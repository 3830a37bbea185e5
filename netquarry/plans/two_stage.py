"""The two-stage classification as a plan: categories by vote, subcategories by category, one confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.operators import models

STAGE1 = "array<struct<category:string,confidence:double>>"
STAGE2 = "array<struct<category:string,subcategory:string,confidence:double>>"


def classify(entities: DataFrame, votes: dict[str, DataFrame], labels: list[str], subs: DataFrame, valid: DataFrame, key: str = "asn", name: str = "organization_name", weights: dict[str, float] | None = None) -> DataFrame:
    """(key, name, stage1, stage2, overall_confidence) for each entity. votes: scores by model; subs: (key, category, subcategory, confidence) as the second stage's models answer.

    An entity that no model knows falls back to Enterprise at 0.1.
    """
    scores = models.vote(votes, key, labels, weights)
    first = scores.select(F.col(key).alias("_key"), models.chosen(F.array(*labels), labels).alias("stage1"))
    rest = F.array(F.struct(F.lit("Enterprise").alias("category"), F.lit(models.FALLBACK).alias("confidence")))
    one = entities.select(key, F.coalesce(F.col(name), F.concat(F.lit("AS"), F.col(key).cast("string"))).alias(name)).join(first, F.col(key) == F.col("_key"), "left").withColumn("stage1", F.coalesce("stage1", rest)).drop("_key")
    two = models.with_subcategories(one, subs, key, valid).groupBy(F.col(key).alias("_key")).agg(F.sort_array(F.collect_list(F.struct("category", "subcategory", "confidence"))).alias("stage2"))
    out = one.join(two, F.col(key) == F.col("_key"), "left").withColumn("stage2", F.coalesce("stage2", F.array().cast(STAGE2))).drop("_key")
    conf = lambda c: F.transform(c, lambda s: s["confidence"])
    return out.withColumn("overall_confidence", models.overall_confidence(conf("stage1"), conf("stage2")))


def batch_summary(results: DataFrame) -> DataFrame:
    """One row: mean confidences overall and by stage, and counts."""
    mean = lambda c: F.aggregate(F.transform(c, lambda s: s["confidence"]), F.lit(0.0), lambda a, x: a + x)
    return results.agg(
        F.count("*").alias("rows"), F.avg("overall_confidence").alias("mean_confidence"), F.try_divide(F.sum(mean("stage1")), F.sum(F.size("stage1"))).alias("mean_stage1"), F.try_divide(F.sum(mean("stage2")), F.sum(F.size("stage2"))).alias("mean_stage2"),
    )

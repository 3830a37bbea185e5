"""Whole jobs: sources processed and validated, labels released, predictions scored and compared."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry import schemas
from netquarry.functions import exprs as X
from netquarry.operators import chat, evaluate, labels, models, quality, split
from netquarry.session import listed, write_text
from netquarry.sources import readers, sinks

#: Where each source's newest file is looked for, below the input folder.
PATTERNS = {"asrank": "asrank*.jsonl", "peeringdb": "peeringdb*.json", "aspop": "aspop*.csv", "ipinfo": "ipinfo*.json"}
READ = {"asrank": readers.read_ranking, "peeringdb": readers.read_network_dump, "aspop": readers.read_population, "ipinfo": readers.read_info}


def newest_sources(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Each source that has a file, read from its newest one; FileNotFoundError if none has."""
    found = {name: f"{folder.rstrip('/')}/{pattern}" for name, pattern in PATTERNS.items() if listed(spark, f"{folder.rstrip('/')}/{pattern}")}
    if not found:
        raise FileNotFoundError(f"no source in {folder}")
    return {name: READ[name](spark, readers.newest_file(spark, pattern)) for name, pattern in found.items()}


def report_of(name: str, df: DataFrame, countries: DataFrame) -> DataFrame:
    """The quality report of a source as its reader gives it."""
    if name == "asrank":
        return quality.ranking_report(df, "asn", "asn_name", "rank", "organization_name", "latitude", "longitude", "country_iso", "cone_asns")
    if name == "peeringdb":
        return quality.peering_report(df, "asn", "name", "website", ["looking_glass", "info_type", "info_scope"])
    if name == "aspop":
        return quality.population_report(df, "asn", "name", "country", "rir", countries)
    return quality.info_report(df.withColumn("error", F.lit(None).cast("string")), "asn", "name", "org", "domain", "error")


def process_all(spark: SparkSession, folder: str, out: str, countries: DataFrame) -> dict[str, bool]:
    """Every source that is there as Parquet and JSON lines, a Markdown report of them all, and whether each passed."""
    reports = {}
    for name, df in newest_sources(spark, folder).items():
        df.write.mode("overwrite").parquet(f"{out}/{name}.parquet")
        sinks.write_keyed(spark.read.parquet(f"{out}/{name}.parquet"), f"{out}/{name}.jsonl")
        reports[name] = report_of(name, spark.read.parquet(f"{out}/{name}.parquet"), countries)
    write_text(spark, f"{out}/quality.md", quality.report_text(list(reports.values())))
    return {name: r.first()["passed"] for name, r in reports.items()}


def release_labels(wide: DataFrame, out: str, splits: tuple[float, float, float] = (0.7, 0.15, 0.15), seed: int = 42) -> dict:
    """Sub-level, top-level and long labels, split assignments and metadata below one folder, Parquet and CSV."""
    sub = labels.canonical(wide, schemas.sub_columns()).select("asn", *schemas.sub_columns())
    top = labels.to_top_level(sub, ["asn"])
    mapping = {c: (p, c.split("_", 1)[1] if "_" in c else None) for c, p in schemas.parents().items()}
    long = labels.to_long(sub, "asn", mapping)
    found = {"labels/sublevel": sub, "labels/toplevel": top, "labels/hierarchical": long, "splits/assignments": split.hash_split(sub, "asn", *splits, seed)}
    for name, df in found.items():
        sinks.write_both(df, f"{out}/{name}")
    return sinks.merge_metadata(f"{out}/metadata.json", sinks.metadata(found))


def scored(labels_df: DataFrame, predictions: DataFrame, columns: list[str], key: str = "asn") -> tuple[DataFrame, DataFrame]:
    """(summary, metrics by label) over the keys and label columns that both have; ValueError without common keys."""
    own = [c for c in columns if c in labels_df.columns and c in predictions.columns]
    pairs = evaluate.paired(labels_df, predictions, key, own)
    if pairs.isEmpty():
        raise ValueError("labels and predictions share no key")
    return evaluate.summary(pairs, own), evaluate.rates(evaluate.confusion(pairs, own))


def against_stored(summary: DataFrame, stored: DataFrame, names: dict[str, str], tolerance: float = 0.05) -> DataFrame:
    """(metric, measured, stored, delta, close) of a summary and a stored metrics file; names: of the file to those of the summary."""
    own = summary.select(F.inline(F.array(*[F.struct(F.lit(k).alias("name"), F.col(v).alias("measured")) for k, v in names.items()])))
    met = own.join(stored, "name").select(F.col("name").alias("metric"), "measured", F.col("value").alias("stored"))
    return met.withColumn("delta", F.col("measured") - F.col("stored")).withColumn("close", F.abs("delta") < tolerance)


def unified(scores: DataFrame, key: str, columns: list[str], threshold: float = 0.0) -> DataFrame:
    """(key, tags, confidence_scores) of a score matrix: what is over the threshold."""
    pairs = F.array_compact(F.array(*[F.when(F.col(c) > threshold, F.struct(F.lit(c).alias("t"), F.col(c).cast("double").alias("s"))) for c in columns]))
    return scores.select(key, F.transform(pairs, lambda p: p["t"]).alias("tags"), F.map_from_entries(pairs).alias("confidence_scores"))


def parsed_long(df: DataFrame, key: str, keys: str, response: str) -> DataFrame:
    """(key, category, subcategory, probability) of answers {responses: [{tags: [{category, subcategory}]}]}; a failed batch gives no row."""
    answers = F.from_json(F.col(response), "responses array<struct<tags:array<struct<category:string,subcategory:string>>>>")["responses"]
    rows = df.select(F.posexplode(keys).alias("at", key), answers.alias("answers")).select(key, F.explode(F.get("answers", F.col("at"))["tags"]).alias("t"))
    return rows.select(key, "t.category", X.filled(F.col("t.subcategory")).alias("subcategory"), F.lit(1.0).alias("probability")).dropDuplicates([key, "category", "subcategory"])


def training_files(examples: DataFrame, out: str, key: str, share: float = 0.8, seed: int = 42) -> None:
    """Chat examples as JSON lines of a training and a validation file."""
    marks = split.hash_split(examples, key, share, 1 - share, 0.0, seed)
    for name, part in (("train", "train"), ("validation", "val")):
        sinks.write_lines(split.members(examples, marks, key, part), f"{out}/{name}.jsonl")


class SubModels:
    """Second-stage models by category: callables of a table of entities to (key, category, subcategory, confidence)."""

    def __init__(self):
        self.models = {}

    def add(self, category: str, model) -> None:
        self.models[category] = model

    def remove(self, category: str) -> bool:
        return self.models.pop(category, None) is not None

    def categories(self) -> list[str]:
        return sorted(self.models)

    def predict(self, stage1: DataFrame, key: str, valid: DataFrame) -> DataFrame:
        """Each model sees the entities of its own category only; the rest falls back to first subcategories."""
        asked = stage1.select(key, F.explode("stage1.category").alias("category"))
        none = asked.limit(0).select(key, "category", F.lit(None).cast("string").alias("subcategory"), F.lit(None).cast("double").alias("confidence"))
        out = none
        for category in self.categories():
            out = out.unionByName(self.models[category](asked.filter(F.col("category") == category).select(key)))
        return models.with_subcategories(stage1, out, key, valid)


def prompts_for(entities: DataFrame, key: str = "asn", size: int = 5) -> DataFrame:
    return chat.batch_prompts(entities, key, "name", "website", "country", size)


def as_keys(spark: SparkSession, data, key: str = "asn") -> DataFrame:
    """(key) of a table with the key, a list of keys, or a list of records with it; repeated ones stay."""
    if isinstance(data, DataFrame):
        return labels.with_key(data, key).select(key)
    rows = [(int(x[key]) if isinstance(x, dict) else int(x),) for x in data]
    return spark.createDataFrame(rows, f"{key} bigint")


def summary_json(path: str, summary: DataFrame, by_label: DataFrame) -> None:
    write_text(summary.sparkSession, path, json.dumps({"summary": summary.first().asDict(), "labels": [r.asDict() for r in by_label.orderBy("label").collect()]}, indent=2))

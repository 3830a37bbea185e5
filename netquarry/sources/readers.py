"""Readers of the sources' files. Schemas are declared; what can't be parsed becomes null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry import schemas
from netquarry.functions import exprs as X
from netquarry.operators import integrate, labels, split
from netquarry.session import is_folder, listed
from netquarry.sources import json_split


def flat_ranking(df: DataFrame) -> DataFrame:
    """Nested ranking records as flat columns."""
    return df.select(
        "asn", F.col("asnName").alias("asn_name"), "rank", F.col("organization.orgId").alias("organization_id"), F.col("organization.orgName").alias("organization_name"),
        F.col("cliqueMember").alias("clique_member"), "seen", "longitude", "latitude", F.col("country.iso").alias("country_iso"), F.col("country.name").alias("country_name"),
        F.col("cone.numberAsns").alias("cone_asns"), F.col("cone.numberPrefixes").alias("cone_prefixes"), F.col("cone.numberAddresses").alias("cone_addresses"),
        *[F.col(f"asnDegree.{c}").alias(f"degree_{c}") for c in ("provider", "peer", "customer", "total", "transit", "sibling")],
        F.col("announcing.numberPrefixes").alias("announcing_prefixes"), F.col("announcing.numberAddresses").alias("announcing_addresses"),
    )


def read_ranking(spark: SparkSession, path: str) -> DataFrame:
    """A ranking as JSON lines, flat."""
    return flat_ranking(spark.read.schema(schemas.ASRANK).json(path))


def typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Text columns by kind: bigint, double, boolean ('true' in any case), string; blanks are null."""
    def one(c: str, kind: str) -> Column:
        if kind == "boolean":
            return X.as_flag(F.col(c))
        return X.filled(F.col(c)) if kind == "string" else X.number(F.col(c), kind)

    return df.select(*[one(c, k).alias(c) for c, k in kinds.items()])


def read_keyed_csv(spark: SparkSession, path: str, key: str = "asn", kinds: dict[str, str] | None = None) -> DataFrame:
    """A CSV whose last row of each key counts. Rows are ordered by file and place in it."""
    raw = spark.read.option("header", True).csv(path).withColumn("_at", F.struct(F.col("_metadata.file_name"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    rows = split.newest(labels.with_key(raw, key), key, [F.col("_at")]).drop("_at")
    return typed(rows.withColumn(key, F.col(key).cast("string")), {key: "bigint", **kinds}) if kinds else rows


def read_keyed_json(spark: SparkSession, path: str, record: str, key: str = "asn") -> DataFrame:
    """A JSON object of key to record, however large; the key column is that of the object. A missing file is an empty table."""
    names = [f.name for f in spark.createDataFrame([], record).schema if f.name != key]
    entries = json_split.records(spark, path).filter("key is not null").select(F.col("key").alias("_key"), _record("value", record).alias("_row"))
    return entries.select(X.normalized_key(F.col("_key")).alias(key), *[F.col(f"_row.{n}") for n in names])


def read_countries(spark: SparkSession, path: str) -> DataFrame:
    """(code, name, rir, continent) of the countries of a registry file; keys that are no code of two upper-case letters are left out."""
    rows = json_split.records(spark, path, "countries").select(F.col("key").alias("code"), _record("value", "name string, rir string, continent string").alias("r"))
    return rows.filter(F.col("code").rlike("^[A-Z]{2}$")).select("code", "r.*")


def _record(text: str, record: str) -> Column:
    return F.from_json(text, f"struct<{_struct_body(record)}>")


def _struct_body(ddl: str) -> str:
    """A column list as the inside of a struct type: the first blank of each top-level column becomes a colon."""
    out, depth, new, part = [], 0, True, ""
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(part.strip())
            part, new = "", True
            continue
        if ch == " " and depth == 0 and new and part.strip():
            part, new = part + ":", False
            continue
        part += ch
    return ",".join([*out, part.strip()])


def read_network_dump(spark: SparkSession, path: str) -> DataFrame:
    """A dump {net: {data: [...]}}; the last record of each key counts."""
    rows = json_split.records(spark, path, "net", "data").select(F.col("at").alias("_at"), _record("value", schemas.PEERINGDB).alias("r")).select("_at", "r.*")
    return split.newest(rows.filter(F.col("asn").isNotNull() & (F.col("asn") != 0)), "asn", [F.col("_at")]).drop("_at")


def read_population(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with ASN, Name, CC, RIR and three cone counts; blank counts are null."""
    raw = spark.read.option("header", True).csv(path)
    n = lambda c: X.number(F.col(c), "bigint")
    return raw.select(
        X.digits_key(F.col("ASN")).alias("asn"), F.col("Name").alias("name"), F.col("CC").alias("country"), F.col("RIR").alias("rir"),
        n("Cust_cone_ASN").alias("customer_cone_asns"), n("Cust_cone_pfx").alias("customer_cone_prefixes"), n("Cust_cone_addr").alias("customer_cone_addresses"),
    ).filter("asn is not null")


def clean_info(rows: DataFrame, key: str = "_key") -> DataFrame:
    """Info records without errors, with the key of their metadata, else that which begins org."""
    asn = F.coalesce(F.col("_ipinfo_metadata.asn"), X.normalized_key(F.regexp_extract("org", r"^(AS\d+)(\s|$)", 1)))
    out = rows.filter(~X.truthy(F.col("error"))).withColumn("asn", asn).filter("asn is not null and asn <> 0")
    return out.select("asn", *[c for c in out.columns if c not in ("asn", "error", "_ipinfo_metadata", key)])


def read_info(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object {metadata, data: key to record}, or key to record itself."""
    rows = json_split.records(spark, path, "data")
    rows = rows if not rows.isEmpty() else json_split.records(spark, path)
    return clean_info(rows.filter("key is not null").select(F.col("key").alias("_key"), _record("value", schemas.IPINFO).alias("r")).select("_key", "r.*"))


def read_labels(spark: SparkSession, path: str, key: str = "asn", text: tuple[str, ...] = ("ASName / Org.", "organization_name", "name")) -> DataFrame:
    """A wide CSV of labels: headers are stripped, cells that are no number are 0."""
    raw = spark.read.option("header", True).csv(path)
    raw = labels.with_key(raw.toDF(*[c.strip() for c in raw.columns]), key)
    return raw.select(*[F.col(f"`{c}`") if c == key or c in text else X.whole_number(F.col(f"`{c}`")).alias(c) for c in raw.columns])


def read_predictions_json(spark: SparkSession, path: str) -> DataFrame:
    """Predictions, a list or {classifications: list}: asn, organization_name, tags, confidence_scores, model_used."""
    one = "asn bigint, organization_name string, tags array<string>, confidence_scores map<string,double>, model_used string"
    rows = json_split.records(spark, path, "classifications")
    rows = rows if not rows.isEmpty() else json_split.records(spark, path).filter("key is null")
    return rows.select(_record("value", one).alias("r")).select("r.*")


def read_predictions_csv(spark: SparkSession, path: str) -> DataFrame:
    """asn, organization_name, tags (comma-separated), confidence_* columns, model_used."""
    raw = spark.read.option("header", True).csv(path)
    scores = [c for c in raw.columns if c.startswith("confidence_")]
    tags = F.filter(F.transform(F.split(F.coalesce("tags", F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")
    conf = F.map_filter(F.create_map(*[x for c in scores for x in (F.lit(c.removeprefix("confidence_")), X.number(F.col(c)))]), lambda k, v: v.isNotNull()) if scores else F.create_map().cast("map<string,double>")
    return raw.select(X.normalized_key(F.col("asn")).alias("asn"), "organization_name", tags.alias("tags"), conf.alias("confidence_scores"), "model_used")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of lines 'name: value'; lines of = and values that are no number are left out."""
    parts = F.split("value", ":", 2)
    rows = spark.read.text(path).filter(~F.col("value").startswith("=") & F.col("value").contains(":"))
    return rows.select(F.trim(F.get(parts, F.lit(0))).alias("name"), X.number(F.get(parts, F.lit(1))).alias("value")).filter("value is not null")


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """Input of a classification: asn, and name or organization_name; website and country may be there. ValueError without the first two."""
    raw = spark.read.option("header", True).csv(path)
    name = next((c for c in ("name", "organization_name") if c in raw.columns), None)
    if "asn" not in raw.columns or name is None:
        raise ValueError("input needs asn and name or organization_name")
    return raw.select(X.normalized_key(F.col("asn")).alias("asn"), F.col(name).alias("name"), *[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in ("website", "country")])


def newest_file(spark: SparkSession, pattern: str) -> str | None:
    """The path of the files of a pattern that was changed last."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
    one = files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("p")).first()
    return one["p"] if one else None


class Release:
    """A released snapshot: labels, features, predictions, splits and metadata below one folder, Parquet or CSV."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str) -> DataFrame:
        for ext in ("parquet", "csv"):
            if listed(self.spark, path := f"{self.root}/{name}.{ext}"):
                reader = self.spark.read.option("header", True)
                return reader.parquet(path) if ext == "parquet" else reader.option("inferSchema", True).csv(path)
        raise FileNotFoundError(f"{self.root}/{name}")

    def labels(self, level: str = "toplevel") -> DataFrame:
        return self._read(f"labels/{level}")

    def predictions(self, level: str, model: str) -> DataFrame:
        return self._read(f"predictions/{level}/{model}")

    def splits(self) -> DataFrame:
        return self._read("splits/assignments")

    def features(self, source: str = "all") -> DataFrame:
        """One source's, or all in the order of their names, outer-joined with the leftmost column of a name kept."""
        if source != "all":
            return self._read(f"features/{source}")
        names = sorted({p.rsplit("/", 1)[1].rsplit(".", 1)[0] for ext in ("parquet", "csv") for p in listed(self.spark, f"{self.root}/features/*.{ext}")})
        return integrate.joined_left_first([self._read(f"features/{n}") for n in names], "asn")

    def split(self, name: str, level: str = "toplevel") -> DataFrame:
        return split.members(self.labels(level), self.splits(), "asn", name)

    def problems(self) -> list[str]:
        """What the folder lacks."""
        out = [f"no {d}" for d in ("labels", "features", "predictions", "splits") if not is_folder(self.spark, f"{self.root}/{d}")]
        if out:
            return out
        top = self.labels()
        if dict(top.dtypes).get("asn") not in ("int", "bigint"):
            out.append("asn is no whole number")
        out += [f"no column {c}" for c in schemas.TOP if c not in top.columns]
        have = {r["split"] for r in self.splits().select("split").distinct().collect()}
        return out + [f"no split {s}" for s in ("train", "val") if s not in have]

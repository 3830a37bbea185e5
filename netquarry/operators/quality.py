"""Quality of source tables: each report is one pass of conditional counts and one row.

Columns: source, records, valid, completeness, consistency, accuracy, overall, passed, and counts of each fault.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.functions import exprs as X

#: Least completeness and overall score of a source that passes.
LEAST = {"completeness": 0.8, "overall": 0.8}


def _n(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def _scored(counts: DataFrame, source: str, completeness: Column, consistency: Column, accuracy: Column, valid: Column, faults: list[str], extra: list[str] | None = None) -> DataFrame:
    """Shares are of max(records, 1); an empty source scores 0 throughout."""
    some = lambda c: F.when(F.col("records") > 0, c.cast("double")).otherwise(0.0)
    out = counts.select(F.lit(source).alias("source"), "records", valid.alias("valid"), some(completeness).alias("completeness"), some(consistency).alias("consistency"), some(accuracy).alias("accuracy"), *faults, *(extra or []))
    out = out.withColumn("overall", (F.col("completeness") + F.col("consistency") + F.col("accuracy")) / 3)
    return out.withColumn("passed", (F.col("records") > 0) & (F.col("completeness") >= LEAST["completeness"]) & (F.col("overall") >= LEAST["overall"]))


def _share(n: str | Column, per: int = 1) -> Column:
    return (F.col(n) if isinstance(n, str) else n) / (F.greatest(F.col("records"), F.lit(1)) * per)


def bad_coordinate(lat: Column, lon: Column) -> Column:
    """Row by row; a null is no fault."""
    return F.coalesce(~lat.between(-90, 90), F.lit(False)) | F.coalesce(~lon.between(-180, 180), F.lit(False))


def bad_name(c: Column) -> Column:
    return F.coalesce(F.length(X.stripped(c)) < 2, F.lit(True))


def ranking_report(df: DataFrame, key: str, name: str, rank: str, organisation: str, lat: str, lon: str, country: str, cone: str, source: str = "asrank") -> DataFrame:
    """A ranking: keys, coordinates, ranks and organisations' names. Nulls count as equal among repeated keys."""
    fields = (key, name, rank, organisation, lat, lon, country, cone)
    k = X.normalized_key(F.col(key))
    counts = df.agg(
        F.count("*").alias("records"), *[F.count(c).alias(f"_{i}") for i, c in enumerate(fields)],
        _n(~X.valid_key(k)).alias("bad_keys"), _n(bad_coordinate(F.col(lat), F.col(lon))).alias("bad_coordinates"), _n(F.col(rank) < 1).alias("bad_ranks"), _n(bad_name(F.col(organisation))).alias("bad_names"),
        (F.count("*") - F.count_distinct(F.col(key)) - F.max(F.col(key).isNull().cast("int"))).alias("repeated"),
        F.avg(rank).alias("mean_rank"), F.count_distinct(country).alias("countries"), _n(F.col(lat).isNotNull() & F.col(lon).isNotNull()).alias("located"), F.avg(cone).alias("mean_cone"),
    )
    filled = sum((F.col(f"_{i}") for i in range(1, len(fields))), F.col("_0"))
    consistency = 1 - _share(F.col("bad_keys") + F.col("bad_coordinates") + F.col("bad_ranks"))
    return _scored(counts, source, _share(filled, len(fields)), consistency, 1 - _share("bad_names"), F.col("records") - F.col("bad_keys") - F.coalesce("repeated", F.lit(0)), ["bad_keys", "bad_coordinates", "bad_ranks", "bad_names", "repeated"], ["mean_rank", "countries", "located", "mean_cone"])


def peering_report(df: DataFrame, key: str, name: str, site: str, others: list[str], source: str = "peeringdb") -> DataFrame:
    """Networks: names and web addresses are looked at only where the key is valid."""
    ok = X.valid_key(X.normalized_key(F.col(key)))
    fields = [name, site, *others]
    counts = df.agg(
        F.count("*").alias("records"), *[_n(X.truthy(F.col(c).cast("string"))).alias(f"_{i}") for i, c in enumerate(fields)], _n(X.normalized_key(F.col(key)) != 0).alias("_key"),
        _n(~ok).alias("bad_keys"), _n(ok & X.truthy(F.col(site)) & ~X.valid_url(F.col(site))).alias("bad_urls"), _n(ok & ~X.truthy(F.col(name))).alias("missing_names"), _n(ok).alias("_valid"),
    )
    filled = sum((F.col(f"_{i}") for i in range(len(fields))), F.col("_key"))
    return _scored(counts, source, _share(filled, len(fields) + 1), 1 - _share(F.col("bad_keys") + F.col("bad_urls")), 1 - _share("missing_names"), F.col("_valid"), ["bad_keys", "bad_urls", "missing_names"])


def population_report(df: DataFrame, key: str, name: str, country: str, rir: str, countries: DataFrame, source: str = "aspop") -> DataFrame:
    """Countries must be two letters of the registry's, registries one of the five; `valid` may go below zero where faults overlap."""
    dim = F.broadcast(countries.select(F.upper("code").alias("_code"), F.lit(True).alias("_known")).distinct())
    met = df.join(dim, F.upper(F.col(country)) == F.col("_code"), "left")
    known = F.coalesce("_known", F.lit(False)) & (F.length(country) == 2)
    fields = (key, name, country, rir)
    counts = met.agg(
        F.count("*").alias("records"), *[F.count(c).alias(f"_{i}") for i, c in enumerate(fields)],
        _n(~X.valid_key(X.normalized_key(F.col(key)))).alias("bad_keys"), _n(F.col(country).isNotNull() & ~known).alias("bad_countries"), _n(~F.col(rir).isin(*X.REGISTRIES)).alias("bad_registries"),
    )
    filled = F.col("_0") + F.col("_1") + F.col("_2") + F.col("_3")
    faults = F.col("bad_keys") + F.col("bad_countries") + F.col("bad_registries")
    return _scored(counts, source, _share(filled, 4), 1 - _share(faults), 1 - _share(F.col("records") * 4 - filled, 4), F.col("records") - faults, ["bad_keys", "bad_countries", "bad_registries"])


def info_report(df: DataFrame, key: str, name: str, organisation: str, domain: str, error: str, source: str = "ipinfo") -> DataFrame:
    failed = X.truthy(F.col(error))
    k = X.normalized_key(F.col(key))
    counts = df.agg(
        F.count("*").alias("records"), _n(~failed & (k > 0)).alias("_valid"), _n(failed).alias("errors"),
        _n(~failed & X.truthy(F.col(domain)) & ~X.valid_domain(F.col(domain))).alias("bad_domains"), _n(~failed & ~X.truthy(F.col(name)) & ~X.truthy(F.col(organisation))).alias("nameless"),
    )
    return _scored(counts, source, _share("_valid"), 1 - _share("bad_domains"), 1 - _share(F.col("nameless") + F.col("errors")), F.col("_valid"), ["errors", "bad_domains", "nameless"])


def report_text(reports: list[DataFrame]) -> str:
    """The reports as Markdown."""
    out = ["# Data quality"]
    for r in (x.first().asDict() for x in reports):
        out += ["", f"## {r['source']}: {'passed' if r['passed'] else 'failed'}", "", f"- records {r['records']}, valid {r['valid']}"]
        out += [f"- {k} {r[k]:.4f}" for k in ("completeness", "consistency", "accuracy", "overall")]
        out += [f"- {k} {v}" for k, v in r.items() if k not in ("source", "records", "valid", "completeness", "consistency", "accuracy", "overall", "passed") and v is not None]
    return "\n".join(out) + "\n"


def accepted_text(lines: DataFrame, column: str = "value") -> DataFrame:
    """One row: whether a CSV text has ten lines, the needed header and over a hundred rows that aren't blank."""
    numbered = lines.withColumn("_header", F.lower(column).rlike("asn") & F.lower(column).rlike("name") & F.lower(column).rlike("cc") & F.lower(column).rlike("rir"))
    one = numbered.agg(F.count("*").alias("lines"), _n(F.col("_header")).alias("headers"), _n(X.stripped(F.col(column)) != "").alias("rows"))
    return one.select("lines", "rows", ((F.col("lines") >= 10) & (F.col("headers") >= 1) & (F.col("rows") - 1 > 100)).alias("accepted"))


def completeness(df: DataFrame, fields: list[str]) -> DataFrame:
    """One row, the share of filled cells of the fields; 0 without rows or fields."""
    if not fields:
        return df.agg(F.lit(0.0).alias("completeness"))
    filled = sum((F.count(c) for c in fields), F.lit(0))
    return df.agg(X.ratio(filled, F.count("*") * len(fields)).alias("completeness"))


def first_violations(df: DataFrame, key: str, bad: Column, n: int = 10) -> DataFrame:
    """The first n rows, by key, that break a rule."""
    return df.filter(F.coalesce(bad, F.lit(False))).orderBy(key).limit(n)

"""Integration of sources that share a key: lookups, unions of keys, and fields by priority.

Joins are plain equi-joins; which side is broadcast is left to the optimizer and
its size threshold, so that none grows with the data unchecked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.functions import exprs as X


def as_struct(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): the row as one struct, null where the key isn't there after an outer join."""
    return df.select(key, F.struct(*[c for c in df.columns if c != key]).alias(name))


def lookup(probe: DataFrame, sources: dict[str, DataFrame], key: str, any_of: bool = False) -> DataFrame:
    """The probe's rows with a struct for each source, null where the source lacks the key; with any_of only keys that some source has."""
    out = reduce(lambda d, kv: d.join(as_struct(kv[1], key, kv[0]), key, "left"), sources.items(), probe)
    return out.filter(reduce(lambda a, b: a | b, [F.col(s).isNotNull() for s in sources])) if any_of else out


def lookup_default(probe: DataFrame, table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The probe's rows, repeated keys kept, with the table's columns, 0 for keys that it lacks; `found` tells them apart."""
    own = table.select(F.col(key).alias("_key"), *columns, F.lit(True).alias("_there"))
    met = probe.drop(*[c for c in columns if c in probe.columns]).join(own, F.col(key) == F.col("_key"), "left")
    return met.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in columns}).withColumn("found", F.coalesce("_there", F.lit(False))).drop("_key", "_there")


def complete(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """All keys of all sources, with the sources' columns under their names' prefix."""
    wide = [df.select(key, *[F.col(c).alias(f"{s}_{c}") for c in df.columns if c != key]) for s, df in sources.items()]
    return reduce(lambda a, b: a.join(b, key, "full"), wide)


def joined_left_first(frames: list[DataFrame], key: str) -> DataFrame:
    """Full outer join of all; of columns with one name the leftmost is kept as it is, nulls included."""
    def step(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b.select(key, *[c for c in b.columns if c != key and c not in a.columns]), key, "full")

    return reduce(step, frames)


def name_by_priority(asrank: str = "asrank", peeringdb: str = "peeringdb", ipinfo: str = "ipinfo", aspop: str = "aspop", blocking: bool = False) -> Column:
    """An organisation's name: asrank's organisation, peeringdb's, ipinfo's name or cleaned organisation, aspop's name; empty counts as missing.

    blocking: an ipinfo record, even one without a name, keeps aspop's from being used.
    """
    last = F.col(f"{aspop}.name")
    if blocking:
        last = F.when(F.col(ipinfo).isNull(), last)
    return X.first_filled(F.col(f"{asrank}.organization_name"), F.col(f"{peeringdb}.organization"), F.col(f"{ipinfo}.name"), X.organisation(F.col(f"{ipinfo}.org")), last)


def entities(probe: DataFrame, sources: dict[str, DataFrame], key: str = "asn") -> DataFrame:
    """Entities that any of asrank, peeringdb, ipinfo and aspop knows, with organization_name, country and website derived."""
    met = lookup(probe, sources, key, any_of=True)
    return met.withColumns({
        "organization_name": name_by_priority(blocking=True),
        "country": X.first_filled(F.col("asrank.country_iso"), F.col("ipinfo.country"), F.col("aspop.country")),
        "website": X.website(F.col("peeringdb.website"), F.col("ipinfo.domain")),
    })


def described(entities: DataFrame, key: str = "asn") -> DataFrame:
    """(key, name, description, website, country) as a model is given them; names default to AS and the key."""
    name = F.coalesce(X.filled(F.col("organization_name")), F.concat(F.lit("AS"), F.col(key).cast("string")))
    parts = F.concat_ws(" | ", F.concat(F.lit("IPinfo: "), X.filled(F.col("ipinfo.name"))), F.concat(F.lit("Type: "), X.filled(F.col("peeringdb.info_type"))))
    return entities.select(key, name.alias("name"), X.filled(parts).alias("description"), F.coalesce(F.col("website"), F.lit("Not available")).alias("website"), F.coalesce(F.col("country"), F.lit("Unknown")).alias("country"))


def by_registry(countries: DataFrame, by: str) -> DataFrame:
    """(by, codes): the country codes of a registry or continent, in order."""
    return countries.groupBy(by).agg(F.sort_array(F.collect_set("code")).alias("codes"))


def with_registry(df: DataFrame, code: str, countries: DataFrame) -> DataFrame:
    """df with rir and continent of the upper-cased country code."""
    dim = countries.select(F.col("code").alias("_code"), "rir", "continent")
    return df.join(F.broadcast(dim), F.upper(code) == F.col("_code"), "left").drop("_code")  # a row for each country of the world

"""Schemas, category vocabularies and the tables made of them."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Canonical top-level columns, in order.
TOP = (
    "Access", "Transit", "Mobile", "Satellite", "ContentProvider", "EducationalResearch", "Government", "IXP", "DNS", "EnergyAndUtility",
    "Enterprise", "Finance", "LawEnforcement", "Health", "Cooperatives", "TvRadioCulturalAmenities", "Transportation", "VPNs", "Personal", "Community",
)

# Subcategories of the label columns, in order; categories without any are left out.
SUB = {
    "Access": ("LargeISP", "SmallISP"),
    "Transit": ("Global", "Regional", "Domestic"),
    "ContentProvider": ("Cloud", "Hosting", "CDN"),
    "EducationalResearch": ("University", "AcademicBackbone", "Schools", "ResearchInstitutes"),
    "Government": ("Executive", "Legislative", "Judiciary", "FederalNational", "StateProvince", "CityCountyMunicipality", "Regulators", "Agencies"),
    "DNS": ("Roots", "ccTLD", "ANS"),
    "Enterprise": ("Ecommerce", "Entertainment", "IndustrialManufacturing", "Technology"),
    "Finance": ("Bank", "CentralBanks", "CreditUnion", "Entities", "StockExchanges"),
    "Health": ("Insurances", "Hospitals"),
    "Transportation": ("Trains", "Ships", "TransitAuthority", "Airports"),
}

# Subcategories that predictions may have beyond the label columns.
SUB_EXTRA = {"Government": ("AgenciesSpace", "AgenciesCentralBanks", "PoliticalParties"), "Transportation": ("Buses",)}

# Older names of columns, and a column that is dropped.
RENAMED = {
    "Financial": "Finance", "Financial_Bank": "Finance_Bank", "Financial_CentralBanks": "Finance_CentralBanks", "Financial_CreditUnion": "Finance_CreditUnion",
    "Financial_Entities": "Finance_Entities", "Financial_StockExchanges": "Finance_StockExchanges", "Enterprise_E_commerce": "Enterprise_Ecommerce",
    "Enterprise_Industrial_Manufacturing": "Enterprise_IndustrialManufacturing", "Government_National": "Government_FederalNational",
}
DROPPED = ("Government_SOE",)


def sub_columns() -> list[str]:
    """The canonical sub-level columns: a category's subcategories, or the category itself."""
    return [c for t in TOP for c in ([f"{t}_{s}" for s in SUB[t]] if t in SUB else [t])]


def parents() -> dict[str, str]:
    """The category of each sub-level column."""
    return {c: t for t in TOP for c in ([f"{t}_{s}" for s in SUB[t]] if t in SUB else [t])}


def _struct(**kinds: str) -> T.StructType:
    return T._parse_datatype_string(", ".join(f"`{k}` {v}" for k, v in kinds.items()))


# Nested records of the sources, with their field names, as they are read.
ASRANK = (
    "asn bigint, asnName string, rank bigint, organization struct<orgId:string,orgName:string>, cliqueMember boolean, seen boolean, longitude double, latitude double, "
    "country struct<iso:string,name:string>, cone struct<numberAsns:bigint,numberPrefixes:bigint,numberAddresses:bigint>, "
    "asnDegree struct<provider:bigint,peer:bigint,customer:bigint,total:bigint,transit:bigint,sibling:bigint>, announcing struct<numberPrefixes:bigint,numberAddresses:bigint>"
)
PEERINGDB = (
    "asn bigint, name string, organization string, website string, looking_glass string, route_server string, irr_as_set string, policy_url string, "
    "info_type string, info_scope string, policy_general string, info_unicast boolean, info_multicast boolean, info_ipv6 boolean"
)
ASPOP = "asn bigint, name string, country string, rir string, customer_cone_asns bigint, customer_cone_prefixes bigint, customer_cone_addresses bigint"
IPINFO = (
    "org string, name string, domain string, country string, region string, city string, type string, route string, num_ips bigint, registry string, allocated string, "
    "error string, _ipinfo_metadata struct<asn:bigint,downloaded_at:string,api_source:string>"
)
CHAT = "messages array<struct<role:string,content:string>>"


def categories(spark: SparkSession, extra: bool = False) -> DataFrame:
    """(ord, category, subcategory), the valid pairs: subcategory is null where a category has none. With `extra` also those that only predictions have."""
    rows = []
    for t in TOP:
        subs = SUB.get(t, ()) + (SUB_EXTRA.get(t, ()) if extra else ())
        rows += [(len(rows) + k, t, s) for k, s in enumerate(subs or (None,))]
    return spark.createDataFrame(rows, "ord int, category string, subcategory string")


def load_taxonomy(path: str | Path) -> dict[str, str | dict[str, str]]:
    """A taxonomy file: category to description, or to subcategories and theirs."""
    found = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(found, dict) or not all(isinstance(v, str | dict) for v in found.values()):
        raise ValueError("a taxonomy maps categories to descriptions or to subcategories")
    return found


def taxonomy_rows(spark: SparkSession, taxonomy: dict[str, str | dict[str, str]]) -> DataFrame:
    """(ord, category, subcategory, description) in file order."""
    flat = [(c, s, d) for c, v in taxonomy.items() for s, d in (v.items() if isinstance(v, dict) else [(None, v)])]
    return spark.createDataFrame([(k, *x) for k, x in enumerate(flat)], "ord int, category string, subcategory string, description string")


def load_registry(spark: SparkSession, path: str | Path) -> tuple[DataFrame, DataFrame]:
    """(countries, registries) of a country registry file; a country's code must be two upper-case letters."""
    return registry_tables(spark, json.loads(Path(path).read_text(encoding="utf-8")))


def registry_tables(spark: SparkSession, found: dict) -> tuple[DataFrame, DataFrame]:
    """(countries, registries) of what a registry file holds."""
    bad = [c for c in found["countries"] if not (len(c) == 2 and c.isalpha() and c.isupper())]
    if bad:
        raise ValueError(f"not country codes: {bad[:5]}")
    countries = [(c, v["name"], v["rir"], v["continent"]) for c, v in found["countries"].items()]
    registries = [(r, v["name"], v.get("region"), v.get("website"), v.get("countries_count")) for r, v in found["registries"].items()]
    return spark.createDataFrame(countries, "code string, name string, rir string, continent string"), spark.createDataFrame(registries, "rir string, name string, region string, website string, countries_count int")

"""Features of entities: numbers, presence flags, words in names, one-hots of a fitted vocabulary; imputing, scaling and selecting them.

Three cases are kept apart: no source has the entity (zeros), one source lacks it
(null, to be imputed), a source has it without the field (0).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.functions import exprs as X
from netquarry.session import shared_dir

#: Cells of a block of rows at most; what a task compares is two blocks. Distances that it has at a time.
CELLS, DISTANCES = 1 << 21, 1 << 19
# Fields of the sources, words looked for in names, and countries of the regions.
ASRANK = ("rank", "clique_member", "seen", "longitude", "latitude", "cone_asns", "cone_prefixes", "cone_addresses", "degree_provider", "degree_peer", "degree_customer", "degree_total", "degree_transit", "degree_sibling", "announcing_prefixes", "announcing_addresses")
RATIOS = {
    "cone_density": ("cone_addresses", "cone_prefixes"), "peer_customer_ratio": ("degree_peer", "degree_customer"), "provider_customer_ratio": ("degree_provider", "degree_customer"),
    "transit_ratio": ("degree_transit", "degree_total"), "announce_efficiency": ("announcing_addresses", "announcing_prefixes"),
}
LOGS = {"cone_size_log": "cone_asns", "address_size_log": "cone_addresses", "prefix_size_log": "announcing_prefixes"}
PRESENT = {"has_website": "website", "has_looking_glass": "looking_glass", "has_route_server": "route_server", "has_irr_as_set": "irr_as_set", "has_policy_url": "policy_url"}
INFO = ("info_unicast", "info_multicast", "info_ipv6")
ONE_HOT = {"type": "info_type", "scope": "info_scope", "policy": "policy_general"}
ASPOP = {"customer_cone_asns": "customer_cone_asns", "customer_cone_prefixes": "customer_cone_prefixes", "customer_cone_addresses": "customer_cone_addresses", "customer_cone_unique": "customer_cone_unique"}
RIRS = {"rir_afrinic": "AFRINIC", "rir_apnic": "APNIC", "rir_arin": "ARIN", "rir_lacnic": "LACNIC", "rir_ripe": "RIPE NCC"}
WORDS = {
    "isp": ("isp",), "telecom": ("telecom", "telco", "telecommunications"), "university": ("university", "college", "edu"), "government": ("gov", "government", "municipal"),
    "network": ("network",), "cloud": ("cloud",), "hosting": ("hosting",),
}
REGIONS = {
    "north_america": ("US", "CA", "MX"), "europe": ("DE", "FR", "GB", "IT", "ES", "NL", "PL"), "asia_pacific": ("CN", "JP", "KR", "IN", "AU", "SG"), "south_america": ("BR", "AR", "CL", "CO", "PE"),
}


def _in(there: Column, value: Column, none: Column) -> Column:
    """0.0 where no source has the entity, null where this one lacks it."""
    return F.when(none, 0.0).when(there, value.cast("double"))


def _field(df: DataFrame, source: str, name: str) -> Column:
    kind = df.schema[source].dataType
    return F.col(f"{source}.{name}") if name in kind.fieldNames() else F.lit(None)


def vocabulary(df: DataFrame, source: str = "peeringdb", fields: dict[str, str] | None = None, most: int = 200) -> dict[str, list[str]]:
    """Values of the one-hot fields, found in one pass; ValueError over `most` of a field."""
    fields = fields or ONE_HOT
    one = df.agg(*[F.slice(F.sort_array(F.collect_set(X.filled(F.col(f"{source}.{c}")))), 1, most + 1).alias(k) for k, c in fields.items()]).first()
    if any(len(one[k]) > most for k in fields):
        raise ValueError(f"over {most} values in a one-hot field")
    return {k: list(one[k]) for k in fields}


def features(entities: DataFrame, vocab: dict[str, list[str]], key: str = "asn") -> DataFrame:
    """All features of entities with the structs asrank, peeringdb, aspop and ipinfo and the columns organization_name, country and website."""
    a, p, s = (F.col(c).isNotNull() for c in ("asrank", "peeringdb", "aspop"))
    none = ~(a | p | s | F.col("ipinfo").isNotNull())
    num = lambda src, c: X.nz(_field(entities, src, c).cast("double"))
    out: dict[str, Column] = {}
    for c in ASRANK:
        out[f"asrank_{c}"] = _in(a, num("asrank", c), none)
    for c, (n, d) in RATIOS.items():
        out[f"asrank_{c}"] = _in(a, X.ratio(num("asrank", n), num("asrank", d)), none)
    for c, x in LOGS.items():
        out[f"asrank_{c}"] = _in(a, F.log1p(num("asrank", x)), none)
    for c, x in PRESENT.items():
        out[f"peeringdb_{c}"] = _in(p, X.truthy(_field(entities, "peeringdb", x).cast("string")), none)
    for c in INFO:
        out[f"peeringdb_{c}"] = _in(p, num("peeringdb", c), none)
    for k, values in vocab.items():
        for v in values:
            out[X.one_hot_name(f"peeringdb_{k}", v)] = _in(p, F.coalesce(F.col(f"peeringdb.{ONE_HOT[k]}") == v, F.lit(False)), none)
    for c, x in ASPOP.items():
        out[f"aspop_{c}"] = _in(s, num("aspop", x), none)
    for c, x in RIRS.items():
        out[f"aspop_{c}"] = _in(s, F.coalesce(F.col("aspop.rir") == x, F.lit(False)), none)
    name, country = X.filled(F.col("organization_name")), X.filled(F.col("country"))
    for c, x in (("has_name", name), ("has_website", X.filled(F.col("website"))), ("has_country", country)):
        out[f"org_{c}"] = F.when(none, 0.0).otherwise(x.isNotNull().cast("double"))
    for c, words in WORDS.items():
        out[f"org_name_{c}"] = _in(name.isNotNull(), X.contains_any(name, words), none)
    out["org_name_length"] = _in(name.isNotNull(), F.length(name), none)
    for c, codes in REGIONS.items():
        out[f"org_region_{c}"] = _in(country.isNotNull(), F.upper(country).isin(*codes), none)
    return entities.select(key, *[v.alias(k) for k, v in out.items()])


def minimal(df: DataFrame, columns: list[str], key: str = "asn") -> DataFrame:
    """Zeros of all features."""
    return df.select(key, *[F.lit(0.0).alias(c) for c in columns])


def numeric(entities: DataFrame, columns: dict[str, str], key: str) -> DataFrame:
    """A projection of numbers; what is missing is 0."""
    return entities.select(key, *[X.nz(F.col(v).cast("double")).alias(k) for k, v in columns.items()])


@dataclass(frozen=True)
class Scaler:
    """Means and population deviations; a constant column keeps scale 1."""

    means: dict[str, float]
    scales: dict[str, float]

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], first: int | None = None, order: str | None = None) -> Scaler:
        """From all rows, or from the `first` ones by `order`."""
        if first is not None:
            df = df.orderBy(order).limit(first)
        one = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
        return cls({c: one[f"m_{c}"] or 0.0 for c in columns}, {c: one[f"s_{c}"] or 1.0 for c in columns})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(self.scales[c]) for c, m in self.means.items()})


def _nearest(x: np.ndarray, d: np.ndarray, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row, column, its k nearest donors that have the column, their squared distances) of each missing cell of x; of equally far donors the first ones of d."""
    there = ~np.isnan(d)
    filled, f = np.where(there, d, 0.0), there.astype(float)
    squares = (filled * filled).T
    most = min(len(d), 2 * k + 6)
    rows = np.flatnonzero(np.isnan(x).any(axis=1))
    step = max(1, min(256, DISTANCES // max(1, len(d))))
    for lo in range(0, len(rows) if len(d) else 0, step):
        part = rows[lo : lo + step]
        own = ~np.isnan(x[part])
        z = np.where(own, x[part], 0.0)
        both = own.astype(float) @ f.T
        square = (z * z) @ f.T - 2 * z @ filled.T + own.astype(float) @ squares
        with np.errstate(divide="ignore", invalid="ignore"):
            far = np.where(both > 0, np.maximum(square, 0) * d.shape[1] / both, np.inf)
        # The nearest few of all donors; those below the farthest of them are complete, and mostly enough.
        few = np.sort(np.argpartition(far, most - 1, axis=1)[:, :most], axis=1)
        few = np.take_along_axis(few, np.argsort(np.take_along_axis(far, few, 1), axis=1, kind="stable"), 1)
        close = np.take_along_axis(far, few, 1)
        complete = np.isfinite(close) & ((close < close[:, -1:]) | (most == len(d)))
        for r, j in zip(*np.nonzero(~own), strict=True):
            best = few[r][complete[r] & there[few[r], j]][:k]
            if len(best) < k and most < len(d):
                near = np.where(there[:, j], far[r], np.inf)
                best = np.flatnonzero((near <= np.partition(near, k - 1)[k - 1]) & np.isfinite(near))
                best = best[np.argsort(near[best], kind="stable")][:k]
            if len(best):
                yield part[r], j, best, far[r, best]


def _cells(table: pa.Table) -> np.ndarray:
    x = table["_x"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.asarray(x, float).reshape(table.num_rows, -1)


def _tile(k: int):
    """The k nearest of a block of donors for each missing cell of a block of rows, as flat arrays: there are more of them than cells in the blocks."""

    def tile(key: tuple[pa.Scalar, ...], queries: pa.Table, donors: pa.Table) -> pa.Table:
        place, ids = donors["_place"].to_numpy(), queries["_uid"].to_numpy()
        x, d = (_cells(t) if t.num_rows else np.zeros((0, 0)) for t in (queries, donors))
        order = np.argsort(place, kind="stable")
        place, d = place[order], d[order]
        n = int(np.isnan(x).sum()) if len(d) else 0
        row, col, size = (np.zeros(n, np.int32) for _ in range(3))
        far, donor, done, at = np.zeros(n * k), np.zeros(n * k, np.int32), 0, 0
        for r, j, best, away in _nearest(x, d, k) if n else ():
            end = at + len(best)
            row[done], col[done], size[done], far[at:end], donor[at:end] = r, j, len(best), away, best
            done, at = done + 1, end
        row, col, size, far, donor = row[:done], col[:done], size[:done], far[:at], donor[:at]
        near = pa.StructArray.from_arrays([pa.array(far), pa.array(place[donor], pa.int64()), pa.array(d[donor, np.repeat(col, size)] if done else far)], ["far", "place", "value"])
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        return pa.table({"_uid": pa.array(ids[row], pa.int64()), "_col": pa.array(col), "_near": pa.ListArray.from_arrays(pa.array(ends), near)})

    return tile


def knn_impute(df: DataFrame, columns: list[str], donors: DataFrame | None = None, k: int = 5, donor_limit: int | None = None, key: str = "asn") -> DataFrame:
    """Nulls become the mean of the k nearest donors that have the column, by the distance over what both have; without one, the column's mean.

    Donors are all rows of `donors`, or of df; of equally far ones those of the
    least hash of their key. More than `donor_limit`, if given, raise an error.
    Each block of rows meets each block of donors in a task of its own, which
    returns its k best; the k best of all blocks are merged.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    if donors is not None and donor_limit is not None and donors.limit(donor_limit + 1).count() > donor_limit:
        raise ValueError(f"over {donor_limit} donors")

    def cells(rows: DataFrame) -> DataFrame:
        return rows.withColumns({c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}).withColumn("_uid", F.monotonically_increasing_id()).checkpoint()

    rows = cells(df)
    given = rows if donors is None else cells(donors)
    place = F.conv(F.substring(X.mix(0, F.col(key)), 1, 15), 16, 10).cast("long") if key in given.columns else F.col("_uid")
    x = F.array(*[F.coalesce(c, F.lit(float("nan"))) for c in columns]).alias("_x")
    means = rows.agg(*[F.avg(c).alias(c) for c in columns], F.count("*").alias("_n")).first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    many = [max(math.ceil(math.sqrt(parts)), math.ceil(n * len(columns) / CELLS)) for n in (means["_n"], given.count())]
    block = [F.pmod(F.xxhash64("_uid"), F.lit(n)).cast("int") for n in many]
    each = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in many]
    lacking = rows.filter(F.greatest(*[F.col(c).isNull().cast("int") for c in columns], F.lit(0), F.lit(0)) == 1)
    asked = lacking.select("_uid", x, block[0].alias("_q"), each[1].alias("_d")).repartition(parts, "_q", "_d")
    met = given.select(place.alias("_place"), x, each[0].alias("_q"), block[1].alias("_d")).repartition(parts, "_q", "_d")
    near = asked.groupBy("_q", "_d").cogroup(met.groupBy("_q", "_d")).applyInArrow(_tile(k), "_uid long, _col int, _near array<struct<far:double,place:long,value:double>>")
    best = near.groupBy("_uid", "_col").agg(F.slice(F.array_sort(F.flatten(F.collect_list("_near"))), 1, k).alias("_best"))
    value = F.aggregate("_best", F.lit(0.0), lambda a, b: a + b["value"]) / F.size("_best")
    found = best.groupBy(F.col("_uid").alias("_of")).agg(F.map_from_entries(F.collect_list(F.struct("_col", value.alias("v")))).alias("_put"))
    out = rows.join(found, F.col("_uid") == F.col("_of"), "left")
    mean = {c: 0.0 if means[c] is None else means[c] for c in columns}
    return out.withColumns({c: F.coalesce(F.col(c), F.col("_put")[j], F.lit(mean[c])) for j, c in enumerate(columns)}).select(*df.columns)


def anova_f(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(feature, f): the one-way F score of each feature over the values of a label, from one pass of sums by label."""
    sums = df.filter(F.col(label).isNotNull()).groupBy(label).agg(*[x for c in columns for x in (F.count(c).alias(f"n_{c}"), F.sum(F.col(c).cast("double")).alias(f"s_{c}"), F.sum(F.col(c).cast("double") * F.col(c)).alias(f"q_{c}"))])
    rows = sums.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"n_{c}").alias("n"), F.col(f"s_{c}").alias("s"), F.col(f"q_{c}").alias("q")) for c in columns]))).filter("n > 0")
    one = rows.groupBy("feature").agg(F.count("*").alias("g"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"))
    whole = F.col("s") * F.col("s") / F.col("n")
    return one.select("feature", F.try_divide((F.col("between") - whole) / (F.col("g") - 1), (F.col("q") - F.col("between")) / (F.col("n") - F.col("g"))).alias("f"))


def multilabel_f(df: DataFrame, columns: list[str], labels: list[str]) -> DataFrame:
    """(feature, f): the mean over labels of each feature's F score."""
    from functools import reduce

    each = reduce(DataFrame.unionByName, [anova_f(df, columns, y) for y in labels])
    return each.groupBy("feature").agg(F.avg("f").alias("f"))


def top_features(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc_nulls_last("f"), "feature").limit(k)

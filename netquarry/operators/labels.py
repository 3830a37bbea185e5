"""Label matrices: wide columns of 0 and 1 by key, and long rows (key, category, subcategory)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry import schemas
from netquarry.functions import exprs as X


def with_key(df: DataFrame, key: str = "asn") -> DataFrame:
    """df with its key column, whatever the case of its name, as a normalised bigint."""
    found = next((c for c in df.columns if c.lower() == key.lower()), None)
    if found is None:
        raise ValueError(f"no column {key}")
    return df.withColumn(found, X.normalized_key(F.col(found))).withColumnRenamed(found, key)


def renamed(df: DataFrame, names: dict[str, str] | None = None, dropped: tuple[str, ...] | None = None) -> DataFrame:
    """Older columns under their new names, without the dropped ones."""
    names = schemas.RENAMED if names is None else names
    return df.drop(*(schemas.DROPPED if dropped is None else dropped)).withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def ensured(df: DataFrame, columns: list[str], fill: int = 0) -> DataFrame:
    """Other columns first, then `columns` in their order; missing ones are filled."""
    return df.select(*[c for c in df.columns if c not in columns], *[F.col(c) if c in df.columns else F.lit(fill).alias(c) for c in columns])


def canonical(df: DataFrame, columns: list[str], key: str = "asn") -> DataFrame:
    return ensured(renamed(with_key(df, key)), columns)


def to_long(df: DataFrame, key: str, mapping: dict[str, tuple[str, str | None]], name: str | None = None) -> DataFrame:
    """(key, name, category, subcategory), distinct, of the cells that equal 1. Columns without mapping are left out. The name's default is AS and the key."""
    own = [c for c in df.columns if c in mapping]
    label = F.coalesce(F.col(name), F.concat(F.lit("AS"), F.col(key).cast("string"))) if name else F.concat(F.lit("AS"), F.col(key).cast("string"))
    cells = F.array(*[F.when(F.col(c) == 1, F.struct(F.lit(mapping[c][0]).alias("category"), F.lit(mapping[c][1]).cast("string").alias("subcategory"))) for c in own])
    long = df.select(key, label.alias("name"), F.explode(F.array_compact(cells)).alias("cell"))
    return long.select(key, "name", "cell.category", "cell.subcategory").dropDuplicates([key, "category", "subcategory"])


def to_wide(df: DataFrame, key: str, value: str, columns: list[str]) -> DataFrame:
    """A row for each key, with 1 where it has the value; values beyond `columns` only make the row."""
    return df.groupBy(key).agg(*[F.coalesce(F.max(F.when(F.col(value) == c, 1)), F.lit(0)).alias(c) for c in columns])


def collapsed(df: DataFrame, groups: dict[str, list[str]], keep: list[str]) -> DataFrame:
    """A column for each group, the greatest of its columns; absent ones are ignored, a group without any is 0."""
    out = []
    for g, cols in groups.items():
        have = [F.col(c) for c in cols if c in df.columns]
        out.append((F.greatest(*have) if len(have) > 1 else have[0] if have else F.lit(0)).alias(g))
    return df.select(*keep, *out)


def collapsed_by_prefix(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """Columns collapsed to what stands before their first underscore: each prefix takes all columns whose names begin with it."""
    prefixes = list(dict.fromkeys(c.split("_")[0] for c in columns))
    return collapsed(df, {p: [c for c in columns if c.startswith(p)] for p in prefixes}, keep)


def to_top_level(df: DataFrame, keep: list[str]) -> DataFrame:
    """The sub-level matrix as the top-level one."""
    groups: dict[str, list[str]] = {t: [] for t in schemas.TOP}
    for c, t in schemas.parents().items():
        groups[t].append(c)
    return collapsed(df, groups, keep)


def merged(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row for each key: 1 where any of its rows is over 0."""
    return df.groupBy(key).agg(*[(F.max(F.coalesce(F.col(c), F.lit(0))) > 0).cast("int").alias(c) for c in columns])


def reduced(df: DataFrame, key: str, columns: list[str], select: str = "all_tags", names: dict[str, str] | None = None) -> DataFrame:
    """all_tags: the columns; reduce_tags: collapsed by prefix; else the columns that begin with `select`. Nulls are 0. ValueError if there are none."""
    df = df.select(key, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in columns])
    if select == "all_tags":
        out = df
    elif select == "reduce_tags":
        out = merged(collapsed_by_prefix(df, columns, [key]), key, list(dict.fromkeys(c.split("_")[0] for c in columns)))
    elif own := [c for c in columns if c.startswith(select)]:
        out = df.select(key, *own)
    else:
        raise ValueError(f"no label column begins with {select!r}")
    return out.withColumnsRenamed(names or {})


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def first_values(df: DataFrame, key: str, order: Column, columns: list[str]) -> DataFrame:
    """The first value of each column that isn't null, by `order`."""
    return df.groupBy(key).agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns])


def tags(columns: list[str]) -> Column:
    """Names of the columns that equal 1, in their order."""
    return F.array_compact(F.array(*[F.when(F.col(c) == 1, F.lit(c)) for c in columns]))


def tag_matrix(df: DataFrame, key: str, tag_array: str, columns: list[str], scores: str | None = None) -> DataFrame:
    """Tag arrays as a matrix of 0 and 1, or of scores (1.0 for assigned tags without one)."""
    has = lambda c: F.coalesce(F.array_contains(tag_array, c), F.lit(False))
    if scores is None:
        return df.select(key, *[has(c).cast("int").alias(c) for c in columns])
    return df.select(key, *[F.coalesce(F.try_element_at(scores, F.lit(c)), has(c).cast("double")).alias(c) for c in columns])


def parents_of(leaves: Column, parents: dict[str, str]) -> Column:
    """Distinct parents of an array of leaf tags, in order; unknown tags are left out."""
    table = F.create_map(*[F.lit(x) for kv in parents.items() for x in kv])
    return F.array_distinct(F.array_compact(F.transform(leaves, lambda x: F.try_element_at(table, x))))


def children_of(tops: Column, parents: dict[str, str]) -> Column:
    """All leaf tags of an array of parents, in the order of the parents."""
    groups: dict[str, list[str]] = {}
    for leaf, p in parents.items():
        groups.setdefault(p, []).append(leaf)
    table = F.create_map(*[y for p, ls in groups.items() for y in (F.lit(p), F.array(*map(F.lit, ls)))])
    return F.flatten(F.array_compact(F.transform(tops, lambda x: F.try_element_at(table, x))))


def synced(df: DataFrame, leaves: str, tops: str, approach: str, parents: dict[str, str]) -> DataFrame:
    """Top-level tags derived where only leaves are given; `violation` where the approach is hierarchical without leaves."""
    derive = (F.size(leaves) > 0) & (F.coalesce(F.size(tops), F.lit(0)) <= 0)
    out = df.withColumn(tops, F.when(derive, parents_of(F.col(leaves), parents)).otherwise(F.col(tops)))
    bad = (F.col(approach) == "hierarchical") & ~(F.coalesce(F.size(leaves), F.lit(0)) > 0)
    return out.withColumn("violation", F.when(bad, "hierarchical without leaf tags")).withColumn("all_tags", F.array_distinct(F.concat(F.coalesce(leaves, F.array()), F.coalesce(tops, F.array()))))


def stage_tags(stage1: Column, stage2: Column) -> Column:
    """category:sub of each stage-2 child, else the category, in the order of stage 1. stage1: array of categories, stage2: array of structs (parent, sub)."""
    def of(c: Column) -> Column:
        own = F.filter(stage2, lambda s: s["parent"] == c)
        return F.when(F.size(own) > 0, F.transform(own, lambda s: F.concat_ws(":", c, s["sub"]))).otherwise(F.array(c))

    return F.flatten(F.transform(stage1, of))


def violations(long: DataFrame, key: str, valid: DataFrame) -> DataFrame:
    """(key, category, subcategory, problem) of the rows that break the hierarchy: no key, no such category, a subcategory missing, not allowed, or not of the category. `valid` has the pairs."""
    dim = valid.groupBy("category").agg(F.array_compact(F.collect_set("subcategory")).alias("subs")).withColumnRenamed("category", "_category")
    met = long.join(F.broadcast(dim), F.col("category") == F.col("_category"), "left")
    sub = F.col("subcategory")
    problem = (
        F.when(F.col(key).isNull(), "no key").when(F.col("_category").isNull(), "unknown category")
        .when((F.size("subs") > 0) & sub.isNull(), "subcategory missing").when((F.size("subs") == 0) & sub.isNotNull(), "subcategory not allowed")
        .when(sub.isNotNull() & ~F.array_contains("subs", sub), "subcategory of another category")
    )
    return met.withColumn("problem", problem).filter("problem is not null").select(key, "category", "subcategory", "problem")


def inconsistent(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, not_binary, unlabelled) of the rows with a cell other than 0 and 1, or without any label."""
    cells = F.array(*[F.col(c).cast("double") for c in columns])
    odd = F.exists(cells, lambda x: x.isNull() | ~x.isin(0.0, 1.0))
    none = F.coalesce(F.aggregate(cells, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))) == 0, F.lit(True))
    return df.select(key, odd.alias("not_binary"), none.alias("unlabelled")).filter("not_binary or unlabelled")


def category_counts(long: DataFrame) -> DataFrame:
    """(category, subcategory, n): by pair, and by category alone (subcategory null)."""
    pairs = long.filter(X.truthy(F.col("subcategory"))).groupBy("category", "subcategory").agg(F.count("*").alias("n"))
    return long.groupBy("category").agg(F.count("*").alias("n")).select("category", F.lit(None).cast("string").alias("subcategory"), "n").unionByName(pairs)


def flat_categories(long: DataFrame, key: str, order: str) -> DataFrame:
    """(key, categories): distinct, by their first appearance."""
    firsts = long.groupBy(key, "category").agg(F.min(order).alias("_at"))
    return firsts.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "category"))), lambda x: x["category"]).alias("categories"))


def statistics(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, keys, and count, mean, sample deviation, least, quartiles and greatest of the rows of a key."""
    per = df.groupBy(key).agg(F.count("*").alias("n"))
    q = F.percentile("n", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    one = per.agg(F.sum("n").alias("records"), F.count("*").alias("keys"), F.avg("n").alias("mean"), F.stddev_samp("n").alias("std"), F.min("n").alias("least"), q.alias("q"), F.max("n").alias("greatest"))
    return one.select("records", "keys", "mean", "std", "least", *[F.col("q")[k].alias(n) for k, n in enumerate(("q25", "q50", "q75"))], "greatest")


def categories_of(long: DataFrame, key: str, value: int) -> DataFrame:
    """(category, subcategory) of one key, in order."""
    return long.filter(F.col(key) == value).select("category", "subcategory").distinct().orderBy("category", F.col("subcategory").asc_nulls_first())


def of_categories(long: DataFrame, wanted: list[str]) -> DataFrame:
    """The rows of the categories asked for."""
    return long.filter(F.col("category").isin(*wanted))


def specialised(df: DataFrame, key: str, parent: str) -> DataFrame:
    """Label columns of the subcategories of one category, for the keys that have it."""
    own = [c for c, p in schemas.parents().items() if p == parent and c in df.columns]
    if not own:
        raise ValueError(f"no label column of {parent}")
    return df.select(key, *own).filter(F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in own], F.lit(0)) > 0)


def common_columns(one: DataFrame, other: DataFrame, wanted: list[str]) -> list[str]:
    """Those of the columns asked for that both have, in that order."""
    return [c for c in wanted if c in one.columns and c in other.columns]

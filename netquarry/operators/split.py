"""Splits, folds and batches. All are by key and drawn by md5, so that any engine draws the same ones."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from netquarry.functions import exprs as X
from netquarry.operators.ranks import ranked


def _cut(place: Column, of: Column, train: float, val: float) -> Column:
    return F.when(place <= F.round(of * train), "train").when(place <= F.round(of * (train + val)), "val").otherwise("test")


def _checked(train: float, val: float, test: float) -> None:
    if abs(train + val + test - 1) > 1e-6:
        raise ValueError(f"shares of train, val and test sum to {train + val + test}, not 1")


def hash_split(df: DataFrame, key: str, train: float = 0.7, val: float = 0.15, test: float = 0.15, seed: int = 42) -> DataFrame:
    """(key, split) of the distinct keys, in exact shares."""
    _checked(train, val, test)
    keys = df.select(key).filter(F.col(key).isNotNull()).distinct()
    return ranked(keys, X.mix(seed, F.col(key))).select(key, _cut(F.col("rank"), F.col("rank_of"), train, val).alias("split"))


def stratified_split(df: DataFrame, key: str, stratum: str, train: float = 0.7, val: float = 0.15, test: float = 0.15, seed: int = 42, least: int = 2) -> DataFrame:
    """(key, stratum, split), in exact shares of each stratum; strata with fewer than `least` keys go together. A key's stratum is its least one."""
    _checked(train, val, test)
    keys = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(stratum).alias(stratum))
    sizes = keys.groupBy(F.col(stratum).alias("_stratum")).agg(F.count("*").alias("_size"))
    met = keys.join(sizes, F.col(stratum).eqNullSafe(F.col("_stratum")))
    drawn = met.withColumn("_drawn_by", F.when(F.col("_size") >= least, F.col(stratum)))
    return ranked(drawn, X.mix(seed, F.col(key)), by=("_drawn_by",)).select(key, stratum, _cut(F.col("rank"), F.col("rank_of"), train, val).alias("split"))


def overlaps(splits: DataFrame, key: str, split: str = "split") -> DataFrame:
    """(first, second, n) of the pairs of splits that share keys; none for sound splits."""
    a = splits.select(F.col(key).alias("_k"), F.col(split).alias("first")).distinct()
    b = splits.select(F.col(key).alias("_l"), F.col(split).alias("second")).distinct()
    return a.join(b, (F.col("_k") == F.col("_l")) & (F.col("first") < F.col("second"))).groupBy("first", "second").agg(F.count("*").alias("n"))


def checked_splits(splits: DataFrame, key: str, split: str = "split") -> DataFrame:
    """The splits; ValueError if any two share keys."""
    bad = overlaps(splits, key, split).collect()
    if bad:
        raise ValueError("; ".join(f"{r['first']} and {r['second']} share {r['n']} keys" for r in bad))
    return splits


def members(df: DataFrame, splits: DataFrame, key: str, split: str) -> DataFrame:
    """The rows of one split."""
    return df.join(splits.filter(F.col("split") == split).select(key), key, "left_semi")


def remainder(all_keys: DataFrame, train: DataFrame, val: DataFrame, key: str) -> DataFrame:
    """Split assignments: test is what neither train nor val has."""
    parts = [d.select(key).distinct() for d in (all_keys, train, val)]
    test = parts[0].join(parts[1], key, "left_anti").join(parts[2], key, "left_anti")
    out = parts[1].withColumn("split", F.lit("train")).unionByName(parts[2].withColumn("split", F.lit("val")))
    return out.unionByName(test.withColumn("split", F.lit("test")))


def group_kfold(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """(key, fold): the first n % k folds have one key more. ValueError with fewer keys than folds."""
    keys = df.select(key).filter(F.col(key).isNotNull()).distinct()
    if keys.limit(k).count() < k:
        raise ValueError(f"fewer than {k} keys")
    r, n = F.col("rank") - 1, F.col("rank_of")
    small, more = F.floor(n / k), n % k
    large = more * (small + 1)
    fold = F.when(r < large, F.floor(r / (small + 1))).otherwise(more + F.floor((r - large) / F.greatest(small, F.lit(1))))
    return ranked(keys, X.mix(seed, F.col(key))).select(key, fold.cast("int").alias("fold"))


def stratified_kfold(df: DataFrame, key: str, label: str, k: int, seed: int = 42) -> DataFrame:
    """(key, label, fold): a key's label is its most frequent one, the least of several; folds go round within a label."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key, label).agg(F.count("*").alias("n"))
    keys = counts.groupBy(key).agg(F.min(F.struct(-F.col("n"), F.col(label)))[label].alias(label))
    return ranked(keys, X.mix(seed, F.col(key)), by=(label,)).select(key, label, ((F.col("rank") - 1) % k).cast("int").alias("fold"))


def multilabel_kfold(df: DataFrame, key: str, labels: list[str], k: int, seed: int = 42) -> DataFrame:
    """(key, fold) by iterative stratification of label combinations: the combinations are counted over all rows, and each one's keys are dealt to the folds that want its rarest label most.

    The driver sees a row for each combination, at most 2^labels; keys stay where they are.
    """
    keys = df.filter(F.col(key).isNotNull()).groupBy(key).agg(*[F.max(c).alias(c) for c in labels]).withColumn("_combo", F.concat_ws("", *[F.coalesce(F.col(c), F.lit(0)).cast("int").cast("string") for c in labels]))
    combos = {r["_combo"]: r["n"] for r in keys.groupBy("_combo").agg(F.count("*").alias("n")).collect()}
    total = [sum(n for c, n in combos.items() if c[j] == "1") for j in range(len(labels))]
    want = [[t / k for t in total] for _ in range(k)]
    room = [sum(combos.values()) / k] * k
    offsets: dict[str, list[int]] = {}

    def rarest(combo: str) -> int:
        return min((total[j] for j, x in enumerate(combo) if x == "1"), default=1 << 62)

    for combo in sorted(combos, key=lambda c: (rarest(c), c)):
        own = [j for j, x in enumerate(combo) if x == "1"]
        given: dict[int, int] = defaultdict(int)
        each, rest = divmod(combos[combo], k)
        for f in range(k):
            given[f] += each
        j = min(own, key=lambda j: (total[j], j)) if own else None
        for f in sorted(range(k), key=lambda f: (-(want[f][j] if j is not None else room[f]), -room[f], f))[:rest]:
            given[f] += 1
        for f in range(k):
            room[f] -= given[f]
            for i in own:
                want[f][i] -= given[f]
        ends, at = [], 0
        for f in range(k):
            at += given[f]
            ends.append(at)
        offsets[combo] = ends
    spark = df.sparkSession
    table = F.broadcast(spark.createDataFrame([(c, e) for c, e in offsets.items()], "_c string, _ends array<int>"))
    met = ranked(keys, X.mix(seed, F.col(key)), by=("_combo",)).join(table, F.col("_combo") == F.col("_c"))
    return met.select(key, F.size(F.filter("_ends", lambda e: e < F.col("rank"))).alias("fold"))


def fold_label_counts(rows: DataFrame, labels: list[str], k: int, fold: str = "fold") -> DataFrame:
    """(fold, part, label, n): positives of each label in each fold and in what is left to train on, from one sum by fold."""
    sums = rows.groupBy(fold).agg(*[F.count_if(F.col(y) > 0).alias(y) for y in labels])
    each = sums.select(F.col(fold).alias("_own"), F.inline(F.array(*[F.struct(F.lit(y).alias("label"), F.col(y).alias("n")) for y in labels])))
    both = each.select("_own", "label", "n", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"))
    part = F.when(F.col("_own") == F.col("fold"), "test").otherwise("train")
    return both.groupBy("fold", part.alias("part"), "label").agg(F.sum("n").alias("n"))


def first_fold_split(df: DataFrame, key: str, test: float = 0.3, seed: int = 42) -> DataFrame:
    """(key, split): test is the first of int(1 / test) folds."""
    return group_kfold(df, key, int(1 / test), seed).select(key, F.when(F.col("fold") == 0, "test").otherwise("train").alias("split"))


def sampled(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, drawn by the hash of the key."""
    return df.orderBy(X.mix(seed, F.col(key)), key).limit(n)


def batches(df: DataFrame, key: str, size: int, seed: int | None = 23) -> DataFrame:
    """df with `batch` and its place in it; shuffled by seed, or in the order of an integer key."""
    order = X.mix(seed, F.col(key)) if seed is not None else F.lpad(F.hex(F.col(key).cast("long")), 16, "0")
    digits = 3 if seed is not None else 13
    return ranked(df, order, digits=digits).withColumn("batch", F.floor((F.col("rank") - 1) / size).cast("long")).withColumn("in_batch", ((F.col("rank") - 1) % size).cast("int")).drop("rank", "rank_of")


def split_statistics(rows: DataFrame, splits: DataFrame, key: str, category: str) -> DataFrame:
    """(split, category, records, keys) by split and category, and by split alone (category null, `whole` true)."""
    met = rows.join(splits.select(key, "split"), key)
    out = met.groupingSets([[F.col("split")], [F.col("split"), F.col(category)]], F.col("split"), F.col(category))
    return out.agg(F.count("*").alias("records"), F.countDistinct(key).alias("keys"), (F.grouping(category) == 1).alias("whole"))


def newest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row for each key, the last by `order`."""
    cols = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_row"))
    return best.select(key, *[F.col(f"_row.{c}").alias(c) for c in cols])


def nearest_date(dates: DataFrame, date: str, target: str, reach: int = 7, past_first: bool = True) -> DataFrame:
    """The available date nearest to the target within `reach` days; of two the earlier."""
    away = F.date_diff(F.col(date), F.lit(target).cast("date"))
    near = dates.select(F.col(date).cast("date").alias(date)).distinct().withColumn("days_off", away).filter(F.abs("days_off") <= reach)
    return near.orderBy(F.abs("days_off"), "days_off" if past_first else F.desc("days_off")).limit(1)


def last_n(df: DataFrame, order: list[Column], n: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The n last rows by order (of each value of by)."""
    if not by:
        return df.orderBy(*order).limit(n)
    return df.withColumn("_nth", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("_nth") <= n).drop("_nth")

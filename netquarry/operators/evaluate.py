"""Metrics of multi-label predictions. Counts of all labels come from one pass; rows are never multiplied by labels.

0/0 is 0 in precision, recall, F1 and Jaccard.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from netquarry.functions import exprs as X

CELLS = ("tp", "fp", "fn", "tn")


def paired(truth: DataFrame, pred: DataFrame, key: str, labels: list[str]) -> DataFrame:
    """(key, t_<label>, p_<label>) of the keys in both; predictions without a label count as 0."""
    t = truth.select(key, *[(F.coalesce(F.col(c), F.lit(0)) > 0).alias(f"t_{c}") for c in labels])
    p = pred.select(F.col(key).alias("_key"), *[((F.coalesce(F.col(c), F.lit(0)) > 0) if c in pred.columns else F.lit(False)).alias(f"p_{c}") for c in labels])
    return t.join(p, F.col(key) == F.col("_key")).drop("_key")


def _cells(label: str) -> list[Column]:
    t, p = F.col(f"t_{label}"), F.col(f"p_{label}")
    return [F.count_if(c).alias(f"{n}_{label}") for n, c in zip(CELLS, (t & p, ~t & p, t & ~p, ~t & ~p), strict=True)]


def confusion(pairs: DataFrame, labels: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, label, tp, fp, fn, tn)."""
    wide = pairs.groupBy(*(by or [])).agg(*[c for x in labels for c in _cells(x)])
    rows = F.array(*[F.struct(F.lit(x).alias("label"), *[F.col(f"{n}_{x}").alias(n) for n in CELLS]) for x in labels])
    return wide.select(*(by or []), F.inline(rows))


def rates(counts: DataFrame) -> DataFrame:
    """confusion with accuracy, precision, recall, f1, jaccard and support."""
    tp, fp, fn, tn = (F.col(c) for c in CELLS)
    return counts.withColumns({
        "accuracy": X.ratio(tp + tn, tp + fp + fn + tn), "precision": X.ratio(tp, tp + fp), "recall": X.ratio(tp, tp + fn),
        "f1": X.ratio(2 * tp, 2 * tp + fp + fn), "jaccard": X.ratio(tp, tp + fp + fn), "support": tp + fn,
    })


def label_metrics(truth: DataFrame, pred: DataFrame, key: str, labels: list[str]) -> DataFrame:
    return rates(confusion(paired(truth, pred, key, labels), labels))


def summary(pairs: DataFrame, labels: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, rows, exact_match, subset, macro_*, micro_*): exact match is the share of rows with all labels right, subset of those without a label too many."""
    own = by or []
    same = reduce(lambda a, b: a & b, [F.col(f"t_{c}") == F.col(f"p_{c}") for c in labels])
    within = reduce(lambda a, b: a & b, [F.col(f"t_{c}") | ~F.col(f"p_{c}") for c in labels])
    wide = pairs.groupBy(*own).agg(F.count("*").alias("rows"), F.count_if(same).alias("same"), F.count_if(within).alias("within"), *[c for x in labels for c in _cells(x)])
    rate = lambda n, d: X.ratio(n, d)
    c = lambda n, x: F.col(f"{n}_{x}")
    mean = lambda f: sum((f(x) for x in labels), F.lit(0.0)) / len(labels)
    total = {n: sum((c(n, x) for x in labels), F.lit(0)) for n in CELLS}
    return wide.select(
        *own, "rows", rate(F.col("same"), F.col("rows")).alias("exact_match"), rate(F.col("within"), F.col("rows")).alias("subset"),
        mean(lambda x: rate(c("tp", x), c("tp", x) + c("fp", x))).alias("macro_precision"), mean(lambda x: rate(c("tp", x), c("tp", x) + c("fn", x))).alias("macro_recall"),
        mean(lambda x: rate(2 * c("tp", x), 2 * c("tp", x) + c("fp", x) + c("fn", x))).alias("macro_f1"), mean(lambda x: rate(c("tp", x), c("tp", x) + c("fp", x) + c("fn", x))).alias("macro_jaccard"),
        rate(total["tp"], total["tp"] + total["fp"]).alias("micro_precision"), rate(total["tp"], total["tp"] + total["fn"]).alias("micro_recall"), rate(2 * total["tp"], 2 * total["tp"] + total["fp"] + total["fn"]).alias("micro_f1"),
    )


def pr_auc(scores: DataFrame, label: str = "label", truth: str = "truth", score: str = "score", bins: int = 4096) -> DataFrame:
    """(label, positives, pr_auc): the area below the precision-recall curve by trapezoids, from (recall 0, precision 1); null without positives.

    Rows are summed by score, then cumulated from the highest down within bins of
    scores in 0..1, after what all bins above hold: no task sees all of a label.
    """
    at = scores.groupBy(label, score).agg(F.sum(F.col(truth).cast("long")).alias("tp"), F.sum(1 - F.col(truth).cast("long")).alias("fp"))
    at = at.withColumn("bin", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score))) * bins).cast("int"))
    tops = at.groupBy(label, "bin").agg(F.sum("tp").alias("btp"), F.sum("fp").alias("bfp"))
    down = W.partitionBy(label).orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, -1)
    tops = tops.select(F.col(label).alias("_l"), F.col("bin").alias("_b"), F.coalesce(F.sum("btp").over(down), F.lit(0)).alias("atp"), F.coalesce(F.sum("bfp").over(down), F.lit(0)).alias("afp"), F.sum("btp").over(W.partitionBy(label)).alias("positives"))
    own = W.partitionBy(label, "bin").orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, W.currentRow)
    run = at.join(tops, (F.col(label) == F.col("_l")) & (F.col("bin") == F.col("_b"))).withColumn("ctp", F.col("atp") + F.sum("tp").over(own)).withColumn("cfp", F.col("afp") + F.sum("fp").over(own))
    before_tp, before_fp = F.col("ctp") - F.col("tp"), F.col("cfp") - F.col("fp")
    before = F.when(before_tp + before_fp == 0, 1.0).otherwise(X.ratio(before_tp, before_tp + before_fp))
    area = F.try_divide(F.col("tp").cast("double"), F.col("positives").cast("double")) * (X.ratio(F.col("ctp"), F.col("ctp") + F.col("cfp")) + before) / 2
    return run.groupBy(label).agg(F.max("positives").alias("positives"), F.sum(area).alias("pr_auc"))


def compared(models: dict[str, DataFrame], truth: DataFrame, key: str, labels: list[str]) -> DataFrame:
    """summary of each model, best macro F1 first."""
    each = [summary(paired(truth, p, key, labels), labels).select(F.lit(m).alias("model"), "*") for m, p in models.items()]
    return reduce(DataFrame.unionByName, each).orderBy(F.desc("macro_f1"), "model")


def deltas(one: DataFrame, other: DataFrame, metric: str, tolerance: float = 0.05) -> DataFrame:
    """(label, first, second, delta, close) of two models' metrics of each label."""
    met = one.select("label", F.col(metric).alias("first")).join(other.select("label", F.col(metric).alias("second")), "label")
    return met.withColumn("delta", F.col("second") - F.col("first")).withColumn("close", F.abs("delta") < tolerance)


# Two-stage predictions: (key, cats array<string>, subs array<struct<cat, sub>>), and the same of the truth.


def system_tags(cats: Column, subs: Column) -> Column:
    """category:sub for each sub, else the category."""
    has = F.transform(subs, lambda s: s["cat"])
    bare = F.array_except(cats, has)
    return F.array_distinct(F.concat(bare, F.transform(subs, lambda s: F.concat_ws(":", s["cat"], s["sub"]))))


def met_stages(pred: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    t = truth.select(F.col(key).alias("_key"), F.col("cats").alias("t_cats"), F.col("subs").alias("t_subs"))
    p = pred.select(key, F.col("cats").alias("p_cats"), F.col("subs").alias("p_subs"))
    return p.join(t, F.col(key) == F.col("_key")).drop("_key")


def stage1_pairs(met: DataFrame, key: str, labels: list[str]) -> DataFrame:
    return met.select(key, *[F.array_contains(f"{s}_cats", c).alias(f"{s}_{c}") for c in labels for s in ("t", "p")])


def stage2_by_category(met: DataFrame, key: str) -> DataFrame:
    """(category, n, jaccard, coverage): of each row and category with true subs, the Jaccard similarity of the sets of subs and whether any was predicted."""
    each = met.select(key, "t_subs", "p_subs", F.explode(F.array_distinct(F.transform("t_subs", lambda s: s["cat"]))).alias("category"))
    own = lambda c: F.array_distinct(F.transform(F.filter(c, lambda s: s["cat"] == F.col("category")), lambda s: s["sub"]))
    each = each.withColumn("t", own(F.col("t_subs"))).withColumn("p", own(F.col("p_subs")))
    return each.groupBy("category").agg(F.count("*").alias("n"), F.avg(X.jaccard(F.col("t"), F.col("p"))).alias("jaccard"), F.avg((F.size("p") > 0).cast("double")).alias("coverage"))


def consistency(pred: DataFrame, key: str, valid: DataFrame) -> DataFrame:
    """One row: rows, subs of categories that stage 1 lacks, invalid subs, and 1 - violations / rows."""
    each = pred.select(key, F.explode_outer("subs").alias("s"), "cats").select(key, "cats", "s.cat", "s.sub")
    dim = F.broadcast(valid.filter("subcategory is not null").select(F.col("category").alias("_c"), F.col("subcategory").alias("_s"), F.lit(True).alias("_ok")))
    met = each.join(dim, (F.col("cat") == F.col("_c")) & (F.col("sub") == F.col("_s")), "left")
    n = met.agg(F.count_if(F.col("cat").isNotNull() & ~F.array_contains("cats", F.col("cat"))).alias("without_stage1"), F.count_if(F.col("cat").isNotNull() & F.col("_ok").isNull()).alias("invalid_sub"))
    rows = pred.agg(F.count("*").alias("rows"))
    return rows.join(F.broadcast(n)).withColumn("rate", 1 - (F.col("without_stage1") + F.col("invalid_sub")) / F.greatest(F.col("rows"), F.lit(1)))


def system_match(met: DataFrame) -> DataFrame:
    """One row: shares of rows whose tags agree exactly, and in any one."""
    t, p = system_tags(F.col("t_cats"), F.col("t_subs")), system_tags(F.col("p_cats"), F.col("p_subs"))
    each = met.select(t.alias("t"), p.alias("p"))
    same = F.array_sort("t") == F.array_sort("p")
    return each.agg(F.count("*").alias("rows"), F.avg(same.cast("double")).alias("exact"), F.avg((same | F.arrays_overlap("t", "p")).cast("double")).alias("partial"))


def errors_top(met: DataFrame, n: int = 10) -> DataFrame:
    """(error, count): the most frequent missed_ and extra_ categories."""
    missed = F.transform(F.array_except("t_cats", "p_cats"), lambda c: F.concat(F.lit("missed_"), c))
    extra = F.transform(F.array_except("p_cats", "t_cats"), lambda c: F.concat(F.lit("extra_"), c))
    return met.select(F.explode(F.concat(missed, extra)).alias("error")).groupBy("error").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error").limit(n)

"""Host-level quality rules, by DataFrame functions alone.

Each document is measured and held against base rules. Failures are summed by
host; a host's failure rate is shrunk towards the rate of all hosts by a beta
prior whose weight comes from how far the hosts' rates spread beyond chance
(moments of the beta-binomial). Hosts whose shrunk rate reaches the limit are
rejected with all their documents; verdicts are joined back.

Defined cases: a null or empty text has no words and fails; a very long text is
measured whole; documents of a null host are judged by the base rules alone; a
rate that equals the limit is rejected; if all hosts' rates are equal, all are
shrunk to the common one; rows that occur more than once count each time; without
documents there is no prior and no row; extra columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.llm import common

#: Fixed values of the base rules: fewest words, words of a window, greatest share of repeated words in percent, symbols.
MIN_WORDS, WINDOW, MAX_REPEATED = 10, 5, 20
SYMBOLS = "#*$%&|<>"
#: Shrunk failure rate from which a host is rejected.
HOST_LIMIT = 0.5
#: Documents that the prior counts as at least, so that a host of one or two isn't judged by them alone.
LEAST_WEIGHT = 2.0
_POS = (1 << 31) - 1


def _neighbours(of: str, same) -> Column:
    """Elements of a sorted array that equal the one before or after by `same`."""
    a = F.col(of)
    return F.filter(a, lambda x, j: F.coalesce(same(F.get(a, j - 1)) == same(x), F.lit(False)) | F.coalesce(same(F.get(a, j + 1)) == same(x), F.lit(False)))


def measured(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", host: Column | None = None) -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of each row.

    Windows found twice are sought by sorting (hash, place) packed in a long; what
    sorts beside an equal hash is then compared as text.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.select(F.col(doc_id).alias("doc_id"), (F.col("source") if host is None else host).cast("string").alias("host"), t.alias("t"))
    out = out.withColumn("w", F.filter(F.split(F.translate("t", common.SPACES, " " * 6), " "), lambda x: x != ""))
    out = out.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    window = lambda i: F.xxhash64(*[F.get(F.col("w"), i + k) for k in range(WINDOW)])
    packed = F.transform(F.sequence(F.lit(0), F.size("w") - WINDOW), lambda i: F.shiftleft(window(i), 31).bitwiseOR(i.cast("long")))
    none = F.array().cast("array<bigint>")
    out = out.withColumn("near", F.when(F.size("w") > WINDOW, F.sort_array(packed)).otherwise(none))
    out = out.withColumn("near", F.transform(_neighbours("near", lambda x: F.shiftright(x, 31)), lambda x: x.bitwiseAND(F.lit(_POS)).cast("int")))
    words = F.sort_array(F.transform("near", lambda p: F.struct(F.array_join(F.slice("w", p + 1, WINDOW), " ").alias("g"), p.alias("p"))))
    out = out.withColumn("found", words)
    out = out.withColumn("found", F.sort_array(F.transform(_neighbours("found", lambda x: x["g"]), lambda x: x["p"])))
    places = F.col("found")
    fresh = F.transform(places, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(places, j + 1) - p, F.lit(WINDOW))).cast("long"))
    out = out.select(
        "doc_id", "host", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(fresh, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def prior(hosts: DataFrame) -> tuple[float, float]:
    """(rate of all documents, weight in documents) of the beta prior; an infinite weight where the rates spread no more than chance has it.

    With r the correlation within a host, E[sum n (x/n - m)^2] = m (1 - m) ((h - 1) + r (N - sum n^2 / N - (h - 1))), and the weight is 1/r - 1.
    """
    s = hosts.agg(F.count("*").alias("h"), F.sum("n").alias("n"), F.sum("f").alias("f"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"), F.sum(F.col("f").cast("double") * F.col("f") / F.col("n")).alias("ff")).first()
    if not s["n"]:
        return 0.0, float("inf")
    m = s["f"] / s["n"]
    free = s["n"] - s["nn"] / s["n"] - (s["h"] - 1)
    if m in (0.0, 1.0) or free <= 0:
        return m, float("inf")
    r = ((s["ff"] - m * m * s["n"]) / (m * (1 - m)) - (s["h"] - 1)) / free
    return m, (max(LEAST_WEIGHT, 1 / min(r, 1.0) - 1) if r > 1e-9 else float("inf"))


def judged(base: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """`measured` with kept, host_docs, host_failed and host_rejected; base should be written already."""
    hosts = common.written(base.filter("host is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("f")), "host-rules")
    mean, weight = prior(hosts)
    rate = F.lit(mean) if weight == float("inf") else (F.col("f") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
    verdict = common.join_hot(base, hosts.withColumn("rejected", rate >= limit), "host", "n", "doc_id")
    rejected = F.coalesce("rejected", F.lit(False))
    return verdict.select(*base.columns, (~F.col("base_failed") & ~rejected).alias("kept"), F.col("n").alias("host_docs"), F.col("f").alias("host_failed"), rejected.alias("host_rejected"))


def quality_rules(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", host: Column | None = None, limit: float = HOST_LIMIT) -> DataFrame:
    """Measures and verdicts of each row."""
    return judged(common.written(measured(docs, text, doc_id, host), "quality-base"), limit)

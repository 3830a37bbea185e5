"""Audit of how filters interact, over all orders in which they may be applied.

Each document fails a set of the filters. Whether a filter removes it depends on
the set of filters applied before, not on their order: the pairs (filters applied
already, next filter) are the edges of the lattice of sets, n 2^(n-1) of them, 80
for five filters. Documents are counted by part and by the set that they fail, and
these counts contribute to each edge. A permutation is a path through the lattice:
its steps are joined with their edges, and the Shapley value of a filter is the
sum of what it removes over the steps of all paths.

Defined cases: a null or empty text has no words and no characters; words are cut
at the six separators, case-sensitive; equal texts are equal in SHA-256 and length;
a text with a null doc_id is identical to any row's that has one, and no row's
text is identical to that of a null doc_id, or to another row's of its own doc_id,
by that rule; rows that occur more than once count each time, and a doc_id with
several labels has each that any of them gives; documents without labels lose
neither; a null part is the empty string, and so one with it; a very long text is
measured whole; an empty table gives no rows; extra columns are left alone.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.llm import common

#: Fewest words; least share of distinct words and greatest of capitals, in percent; marks; the filters' letters.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, MARKS, FILTERS = 50, 65, 5, "[#$%&*|]", "ABCDE"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def failures(text: Column) -> list[Column]:
    """Whether a text fails the filters that look at it alone: A (few words), B (few distinct ones), C (many capitals), D (marks)."""
    t = F.coalesce(text, F.lit(""))
    w = F.filter(F.split(F.translate(t, common.SPACES, " " * 6), " "), lambda x: x != "")
    few = F.size(w) < MIN_WORDS
    alike = 100 * F.size(F.array_distinct(w)).cast("long") < MIN_DISTINCT * F.size(w).cast("long")
    loud = 100 * (F.length(t) - F.length(F.translate(t, CAPITALS, ""))).cast("long") > MAX_CAPITALS * F.length(t).cast("long")
    return [few, alike, loud, t.rlike(MARKS)]


def masks(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "source") -> DataFrame:
    """doc_id, part and mask of each row: the sum of 2^k over the filters that it fails, the k-th of FILTERS each. Written twice, the light rows alone."""
    t = F.coalesce(F.col(text), F.lit(""))
    own = sum(f.cast("int") * (1 << k) for k, f in enumerate(failures(F.col(text))))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), own.alias("own"), F.concat(F.unhex(F.sha2(t.cast("binary"), 256)), F.encode(F.octet_length(t).cast("string"), "utf-8")).alias("digest"))
    rows = common.written(rows, "audit-rows")
    # Only texts that occur more than once are looked up.
    first = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1")
    met = common.join_hot(rows, common.written(first, "audit-copies"), "digest", "n", "doc_id")
    copy = F.coalesce(F.col("doc_id").isNull() & F.col("first").isNotNull() | (F.col("doc_id") > F.col("first")), F.lit(False))
    return met.select("doc_id", "part", (F.col("own") + copy.cast("int") * (1 << len(FILTERS) - 1)).alias("mask"))


def counted(masked: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Rows, rows of good documents and of toxic ones by part and mask."""
    marks = labels.groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # Summed by document first: rows that share a doc_id meet its labels once.
    each = masked.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n")).join(marks, "doc_id", "left")
    of = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).alias(c)
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def edges(counts: DataFrame, n: int = len(FILTERS)) -> DataFrame:
    """By part and edge (applied, next): the rows that `next` keeps, removes, and fails although they are gone already, those that fail it alone, and the good and toxic ones among the removed. Parts have all their edges."""
    every = [(s, f) for f in range(n) for s in range(1 << n) if not s >> f & 1]
    each = counts.withColumn("edge", F.explode(F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(f).alias("next")) for s, f in every])))
    applied, bit = F.col("edge.applied"), F.expr("shiftleft(1, edge.next)")
    gone, fails = F.col("mask").bitwiseAND(applied) != 0, F.col("mask").bitwiseAND(bit) != 0
    total = lambda of, when, name: F.sum(F.when(when, F.col(of)).otherwise(0)).alias(name)
    return each.groupBy("part", applied.alias("applied"), F.col("edge.next").alias("next")).agg(
        total("n", ~gone & ~fails, "kept"), total("n", ~gone & fails, "removed"), total("n", gone & fails, "redundant"),
        total("n", F.col("mask") == bit, "unique_fails"), total("good", ~gone & fails, "good_lost"), total("toxic", ~gone & fails, "toxic_lost"),
    )


def paths(of: DataFrame, letters: str = FILTERS) -> DataFrame:
    """A row (filter_order, step, applied, next) for each step of each permutation: n n! rows. of: any frame of the session."""
    rows = [("".join(letters[f] for f in order), k + 1, sum(1 << f for f in order[:k]), order[k]) for order in permutations(range(len(letters))) for k in range(len(letters))]
    return of.sparkSession.createDataFrame(rows, "filter_order string, step int, applied int, next int")


def audited(counts: DataFrame, letters: str = FILTERS) -> DataFrame:
    """The steps of all permutations by part, of counts by part and mask."""
    n = len(letters)
    lattice = common.written(edges(counts, n), "audit-edges")
    # An edge lies on as many paths as its applied filters, and those that are left, have orders.
    ways = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), F.bit_count("applied") + 1)
    value = lattice.groupBy("part", "next").agg(F.sum(F.col("removed") * ways).alias("shapley"))
    steps = lattice.join(F.broadcast(paths(counts, letters)), ["applied", "next"]).join(value, ["part", "next"])
    return steps.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley: a row for each step of each order of the five filters, by part."""
    return audited(counted(masks(docs, text, doc_id, part), labels))

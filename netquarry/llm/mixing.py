"""Mixing sources to target weights by temperature.

The token shares p of the sources are raised to an exponent a and normalised:
w = p^a / sum(p^a). a is bisected: 1 keeps the shares, 0 makes them equal. The
target is an entropy (as a share of the greatest one) or a limit on how often
any source is repeated, relative to the source repeated least; with both, the
entropy is sought as far as the limit lets it. The weights are
then realised: each source gets a budget of tokens, and spends it on passes over
its documents. Each pass takes the source's blocks, and the documents of each in
a permutation of that pass; the last pass of a source takes its blocks in a
permutation of their own until the budget is spent. The mixture is one seeded
permutation of the blocks of all sources and passes: `passes` gives each copy of
a document its pass and its position, and `keep` writes the documents in that order.

A source far smaller than its weight takes its rows millions of times; such rows
are split into runs of passes that are dealt out before the copies are made, so
that no task makes all copies of a row.

Tokens are those of a byte-level BPE vocabulary, `tokenizer`; callers that have
none count words. Defined cases: a null source is a source of its own; null and
empty texts, and others without tokens, cost one token, so that they are placed
too; a very long text is counted whole, and its block is as much longer; rows
that occur more than once are separate documents, which share a place: a broken
pass takes all of them or none, and which of them comes first is not defined; of
blocks with equal hashes the order is that of source, pass and number; sources
with equal shares have equal weights; an empty table gives no rows; extra columns
pass through.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from netquarry.llm import bpe, common
from netquarry.llm.pretokens import splitter

#: Tokens of a block, about; the rows of a block are ordered in one task.
BLOCK_TOKENS = 1 << 16
#: Pre-tokens whose number of tokens a worker remembers.
MEMO = 200_000
#: Exponents measured at once, and how often: 42 steps of bisection in seven.
POINTS, ROUNDS = 63, 7
#: Copies of a row that one task makes; a row with more of them is dealt out in runs.
RUN = 4096


def _bisected(measure: Callable[[list[float]], list[tuple[float, float]]], entropy: float | None, repeats: float | None) -> float:
    """The greatest exponent in [0, 1] that reaches the entropy, or the least that keeps the limit of repeats; with both, the greater of the two. measure: of exponents, the entropy as a share of the greatest one, and the ratio of the greatest and the least rate."""
    if entropy is not None and repeats is not None:
        return max(_bisected(measure, entropy, None), _bisected(measure, None, repeats))

    def enough(m: tuple[float, float]) -> bool:
        return m[0] >= entropy if entropy is not None else m[1] <= repeats * (1 + 1e-12)

    least, greatest = measure([0.0, 1.0])
    if entropy is not None and enough(greatest):
        return 1.0
    if entropy is None and enough(least):
        return 0.0
    low, high = 0.0, 1.0  # entropy: enough at low; repeats: enough at high
    for _ in range(ROUNDS):
        at = [low + (high - low) * k / (POINTS + 1) for k in range(1, POINTS + 1)]
        below = sum(enough(m) == (entropy is not None) for m in measure(at))
        low, high = (at[below - 1] if below else low), (at[below] if below < POINTS else high)
    return low if entropy is not None else high


def exponent(shares: list[float], entropy: float | None = None, repeats: float | None = None) -> float:
    """The exponent of a few shares at hand; see `_bisected`. `plan` finds it where the table of sources is."""
    p = [x for x in shares if x > 0]
    if len(p) < 2:
        return 1.0

    def measure(at: list[float]) -> list[tuple[float, float]]:
        out, top = [], max(p)
        for a in at:
            w = [(x / top) ** a for x in p]
            total, rates = sum(w), [x / q for x, q in zip(w, p, strict=True)]
            out.append((-sum(x / total * math.log(x / total) for x in w if x) / math.log(len(p)), max(rates) / max(min(rates), 1e-300)))
        return out

    return _bisected(measure, entropy, repeats)


@dataclass(frozen=True)
class Plan:
    """exponent, and per source its tokens and budget, in a table of few columns."""

    exponent: float
    sources: DataFrame


def tokens_of(text: Column) -> Column:
    """Words of a text, one at least."""
    return F.greatest(F.lit(1), F.size(F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), common.SPACES[1:], " " * 5), " "), lambda x: x != "")))


def _solved(groups: DataFrame, entropy: float | None, repeats: float | None) -> float:
    """The exponent, bisected where the table of sources is, however many they are: each step is a sum over it."""
    size = groups.agg(F.count("*").alias("n"), F.max("tokens").alias("top")).first()
    if size["n"] < 2:
        return 1.0
    x = F.log(F.col("tokens") / F.lit(float(size["top"])))

    def measure(at: list[float]) -> list[tuple[float, float]]:
        each = groups.select(x.alias("x"), F.posexplode(F.array(*map(F.lit, at))).alias("nth", "a"))
        raised, rate = F.exp(F.col("a") * F.col("x")), (F.col("a") - 1) * F.col("x")
        sums = each.groupBy("nth").agg(F.sum(raised).alias("z"), F.sum(raised * F.col("a") * F.col("x")).alias("s"), (F.max(rate) - F.min(rate)).alias("apart")).collect()
        return [((math.log(r["z"]) - r["s"] / r["z"]) / math.log(size["n"]), math.exp(min(r["apart"], 700.0))) for r in sorted(sums, key=lambda r: r["nth"])]

    return _bisected(measure, entropy, repeats)


def plan(sized: DataFrame, source: str, tokens: str, entropy: float | None = None, repeats: float | None = None, budget: float | None = None) -> Plan:
    """Weights and budgets. `budget` is a multiple of all tokens; without one it is the least that takes every document once at least."""
    groups = common.written(sized.groupBy(F.col(source).alias("source")).agg(F.sum(tokens).alias("tokens"), F.count("*").alias("rows")), "mix-sources")
    a = _solved(groups, entropy, repeats)
    top = groups.agg(F.max("tokens").alias("m"), F.sum("tokens").alias("t")).first()
    raised = groups.withColumn("raised", F.pow(F.col("tokens") / F.lit(float(top["m"] or 1)), F.lit(a)))
    z = raised.agg(F.sum("raised").alias("z"), F.max(F.col("tokens") / F.col("raised")).alias("need")).first()
    whole = budget * (top["t"] or 0) if budget is not None else (z["z"] or 0) * (z["need"] or 0)
    share = F.col("raised") / F.lit(z["z"] or 1.0)
    return Plan(a, raised.select("source", "tokens", "rows", share.alias("weight"), F.round(share * F.lit(float(whole))).cast("long").alias("budget")))


def _counter(path: str, pattern: str):
    """(doc_id, source, place, text) to (doc_id, source, place, tokens)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, enc, vocabulary, memo = splitter(pattern), bpe.encoder(path), bpe.ranks(path), {}
        for b in batches:
            tokens = []
            for t in b.column(3).to_pylist():
                total = 0
                for w in split(t or ""):
                    n = memo.get(w)
                    if n is None:
                        if len(memo) >= MEMO:
                            memo.clear()
                        raw = w.encode("utf-8", "replace")
                        n = memo[w] = 1 if raw in vocabulary else len(enc.encode_ordinary(raw.decode()))
                    total += n
                tokens.append(max(1, total))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(tokens, pa.int64())], ["doc_id", "source", "place", "tokens"])

    return count


def _sized(docs: DataFrame, source: str, text: str, doc_id: str, seed: int, tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """What the plan needs of each row; `place` is its rank within any block. tokenizer: place of a vocabulary file, and the pattern of its pre-tokens."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), place_of(F.col(doc_id), F.col(text), seed).alias("place"), F.col(text).alias("text"))
    if tokenizer is None:
        return rows.select("doc_id", "source", tokens_of(F.col("text")).cast("long").alias("tokens"), "place")
    common.tune(docs.sparkSession)
    return rows.mapInArrow(_counter(*tokenizer), "doc_id long, source string, place long, tokens long")


def place_of(doc_id: Column, text: Column, seed: int) -> Column:
    return F.xxhash64(doc_id.cast("long"), text, F.lit(seed))


def _copies(full: Column, block: Column, place: Column, seed: int) -> Column:
    """Full passes, and one more up to where the broken pass ends."""
    rank = rank_of(block, seed)
    more = (rank < F.col("cut_rank")) | ((rank == F.col("cut_rank")) & (place <= F.col("cut_place")))
    return full + F.when(F.coalesce(more, F.lit(False)), 1).otherwise(0)


def rank_of(block: Column, seed: int, epoch: Column | None = None) -> Column:
    """Rank of a block in the permutation of a pass; the broken pass is the one without number."""
    return F.xxhash64(block, F.coalesce(epoch, F.lit(-1)) if epoch is not None else F.lit(-1), F.lit(seed))


def block_of(place: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(place), blocks).cast("int")


def cuts(sized: DataFrame, drawn: Plan, seed: int = 0, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """A row for each source: full passes, number of blocks, and the block and place at which its broken pass ends."""
    spend = drawn.sources.select(
        F.col("source").alias("own"), F.xxhash64("source").alias("key"), "rows", "weight", F.expr("budget div tokens").alias("full"), F.expr("budget % tokens").alias("left"),
        F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.lit(block_tokens))).cast("int").alias("blocks"),
    )
    spend = common.written(spend, "mix-spend")
    met = common.join_hot(sized.withColumn("key", F.xxhash64("source")), spend, "key", "rows", "place")
    placed = met.filter("source <=> own").withColumn("block", block_of(F.col("place"), F.col("blocks"))).withColumn("rank", rank_of(F.col("block"), seed))
    # Running sums over the permuted blocks in two steps, so that no task holds all blocks of a hot source.
    blocks = common.written(placed.groupBy("key", "own", "rank", "left").agg(F.sum("tokens").alias("tokens")).withColumn("part", F.shiftright("rank", 54)), "mix-blocks")
    parts = blocks.groupBy("key", "own", "part").agg(F.sum("tokens").alias("part_tokens"))
    parts = parts.select("key", F.col("own").alias("_own"), "part", F.coalesce(F.sum("part_tokens").over(W.partitionBy("key", "own").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("part_before"))
    inner = F.coalesce(F.sum("tokens").over(W.partitionBy("key", "own", "part").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    run = blocks.withColumn("inner", inner).join(parts, ["key", "part"]).filter("own <=> _own").withColumn("room", F.col("left") - F.col("part_before") - F.col("inner"))
    broken = common.written(run.filter("room > 0 and room <= tokens").select(F.col("key").alias("_key"), F.col("own").alias("_own"), F.col("rank").alias("cut_rank"), "room"), "mix-broken")
    few, _ = common.bounded(broken)
    # One block of each source is gone through in the order of its places; rows that agree in doc_id and text share a place.
    inside = placed.join(few, (F.col("key") == F.col("_key")) & (F.col("rank") == F.col("cut_rank"))).filter("own <=> _own").groupBy("key", "own", "cut_rank", "room", "place").agg(F.sum("tokens").alias("tokens"))
    spent = F.coalesce(F.sum("tokens").over(W.partitionBy("key", "own").orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ends = inside.withColumn("spent", spent).filter("spent < room").groupBy("key", "own").agg(F.max("cut_rank").alias("cut_rank"), F.max("place").alias("cut_place"))
    ends = ends.withColumnRenamed("own", "_own").withColumnRenamed("key", "_key")
    out = spend.join(ends, (F.col("key") == F.col("_key")) & F.col("own").eqNullSafe(F.col("_own")), "left")
    return common.written(out.select("key", "own", "rows", "weight", "full", "blocks", "cut_rank", "cut_place"), "mix-cuts")


def mixed(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", entropy: float | None = None, repeats: float | None = None, budget: float | None = None, seed: int = 0, block_tokens: int = BLOCK_TOKENS, tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, source, tokens, weight of the source, block, and copies: how often the mixture takes the row."""
    sized = common.written(_sized(docs, source, text, doc_id, seed, tokenizer), "mix-sized")
    drawn = plan(sized, "source", "tokens", entropy, repeats, budget)
    met = common.join_hot(sized.withColumn("key", F.xxhash64("source")), cuts(sized, drawn, seed, block_tokens), "key", "rows", "place").filter("source <=> own")
    block = block_of(F.col("place"), F.col("blocks"))
    return met.select("doc_id", "source", "tokens", "weight", block.alias("block"), "place", _copies(F.col("full"), block, F.col("place"), seed).alias("copies"))


def order(epoch: Column, seed: int = 0) -> list[Column]:
    """Sort keys of the rows of a pass: that of the block among those of all sources and passes, and that of the row in its block."""
    return [deal_of(F.xxhash64("source"), epoch, F.col("block"), seed), F.xxhash64("place", _seeding(epoch), F.lit(seed))]


def deal_of(key: Column, epoch: Column, block: Column, seed: int) -> Column:
    """What the blocks of all sources and passes are ordered by."""
    return F.xxhash64(key, _seeding(epoch), block, F.lit(seed))


def _seeding(epoch: Column) -> Column:
    """What a pass gives to a hash: passes that are a multiple of 2^31 apart have the same permutation."""
    return epoch.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")


def _each_copy(rows: DataFrame, seed: int, most: int, run: int = RUN) -> DataFrame:
    """A row for each copy, with pass_no from 0, deal and inner; one row, where these are null, for rows without copies. most: the greatest number of copies.

    Runs of more than `run` copies are cut into that many shorter ones and dealt out before they are cut further.
    """

    def cut(df: DataFrame, step: int) -> DataFrame:
        starts = F.when(F.col("until") > F.col("pass_no"), F.sequence("pass_no", F.col("until") - 1, F.lit(step).cast("long")))
        return df.withColumn("from", F.explode_outer(starts)).withColumn("until", F.least("until", F.col("from") + step)).withColumn("pass_no", F.col("from")).drop("from")

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = []  # from the shortest run to the longest
    while run ** (len(steps) + 1) < most:
        steps.append(run ** (len(steps) + 1))
    each = rows.withColumn("pass_no", F.lit(0).cast("long")).withColumn("until", F.col("copies").cast("long"))
    for step in reversed(steps):
        each = cut(each, step).repartition(parts, F.xxhash64("place", "pass_no"))
    each = cut(each, 1).drop("until")
    some = F.col("pass_no").isNotNull()
    return each.withColumn("deal", F.when(some, deal_of(F.col("key"), F.col("pass_no"), F.col("block"), seed))).withColumn("inner", F.when(some, F.xxhash64("place", _seeding(F.col("pass_no")), F.lit(seed))))


def passes(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", entropy: float | None = None, repeats: float | None = None, budget: float | None = None, seed: int = 0, block_tokens: int = BLOCK_TOKENS, tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """The realised mixture: doc_id, source, tokens, weight, block, copies, and for each copy pass_no (from 0) and position (gapless, from 0); a document that the mixture leaves out has one row without these two."""
    rows = common.written(mixed(docs, source, text, doc_id, entropy, repeats, budget, seed, block_tokens, tokenizer).withColumn("key", F.xxhash64("source")), "mix-rows")
    most = rows.agg(F.max("copies").alias("m")).first()["m"] or 0
    each = common.written(_each_copy(rows, seed, most), "mix-copies")
    common.dropped(rows)
    taken = each.filter("pass_no is not null")
    own = ("key", "pass_no", "block")
    blocks = common.written(taken.groupBy(*own, "deal").agg(F.count("*").alias("n")).withColumn("part", F.shiftright("deal", 54)), "mix-dealt")
    # What stands before a block: the parts before its own, at most 1024 of them, and the blocks before it in its part.
    parts = blocks.groupBy("part").agg(F.sum("n").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before(W.orderBy("part")).alias("part_before"))
    starts = blocks.withColumn("inner_before", before(W.partitionBy("part").orderBy("deal", *own))).join(F.broadcast(parts), "part").select(*own, (F.col("part_before") + F.col("inner_before")).alias("start"))
    nth = F.row_number().over(W.partitionBy(*own).orderBy("inner", "place", "doc_id"))
    placed = taken.withColumn("nth", nth).join(starts, [*own]).withColumn("position", F.col("start") + F.col("nth") - 1)
    left_out = each.filter("pass_no is null").withColumn("position", F.lit(None).cast("long"))
    columns = ("doc_id", "source", "tokens", "weight", "block", "copies", "pass_no", "position")
    return placed.select(*columns).unionByName(left_out.select(*columns))


def keep(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", entropy: float | None = None, repeats: float | None = None, budget: float | None = None, seed: int = 0, block_tokens: int = BLOCK_TOKENS, tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """The documents, each as often as the mixture takes it, with all their columns and in its order: sorted partitions, one after the other."""
    spark = docs.sparkSession
    sized = common.written(_sized(docs, source, text, doc_id, seed, tokenizer), "mix-sized")
    held = cuts(sized, plan(sized, "source", "tokens", entropy, repeats, budget), seed, block_tokens)
    common.dropped(sized)
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.xxhash64(F.col(source).cast("string")).alias("key"), F.col(source).cast("string").alias("_source"), place_of(F.col(doc_id), F.col(text), seed).alias("place"))
    most = 1 + (held.agg(F.max("full").alias("m")).first()["m"] or 0)
    few, small = common.bounded(held)
    met = (whole.join(few, "key") if small else common.join_hot(whole, held, "key", "rows", "place")).filter("_source <=> own").withColumn("block", block_of(F.col("place"), F.col("blocks")))
    each = _each_copy(met.select("doc", "key", "place", "block", _copies(F.col("full"), F.col("block"), F.col("place"), seed).alias("copies")), seed, most).filter("pass_no is not null")
    # Blocks are dealt by ranges of their hash, so that partitions follow each other in the mixture's order.
    parts = min(1 << 16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    part = F.shiftright((F.shiftright("deal", 48) + F.lit(1 << 15)) * parts, 16).cast("int")
    return each.repartitionById(parts, part).sortWithinPartitions("deal", "key", "pass_no", "block", "inner", "place").select("doc.*")

"""Personal data: patterns, and information-theoretic sanitisation of the terms that tell them.

Base spans are found by pattern. Each found value is a protected entity. Over the
whole corpus it is counted in how many documents an entity, a term, and the two
together occur, wherever they stand in these. How much of an entity c a term t tells is
PMI(c; t) = log2(N n(c,t) / (n(c) n(t))), at most what the entity itself tells,
IC(c) = log2(N / n(c)). A few documents prove little: for n(c,t) / n(t) stands its
lower confidence bound, the least share p of which n(c,t) out of n(t) documents
aren't rarer than CHANCE has it (n(t) KL(n(c,t)/n(t) | p) <= ln(1 / CHANCE)). So a rare
word that only one document has tells nothing, and a nickname that many documents
with an address have, and no others, tells it. Terms that tell DISCLOSES of any entity
or more are generalised wherever they occur, also in documents without the entity;
those that tell REVEALS of it or more are removed. Copies of a text with entities
count as one document; near copies are documents of their own.

The bound also says how many documents a pair needs (`least_together`): entities and
terms of fewer are left out before pairs are made. Entities that have the same
documents are one class, and so are terms with the same documents and count, so that
a text of many entities and terms gives pairs of classes; those of a text with many
classes are dealt to several tasks.

Defined cases: a null or empty text has no spans; a very long text is scanned
whole, in time that grows with its length; spans of different kinds may overlap,
and where they do the text is replaced up to where the last of them ends; of
terms that tell several entities the most they tell of any counts; rows that
occur more than once are sanitised each by itself; an entity of all documents is told
by no term; null and repeated
doc_ids are rows like any others; an empty table gives no rows; extra columns are
left alone.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from math import ceil, inf, log

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from netquarry.llm import common

#: Shares of an entity's information from which a term is generalised or removed.
DISCLOSES, REVEALS = 0.8, 0.95
#: Chance that a share of documents is as high as counted though its bound is the true one.
CHANCE = 0.001
#: Pairs of classes of a document that one task makes.
PAIRS = 4 << 20
#: Terms that a worker counts before it passes the counts on.
HELD = 400_000
#: The kinds in their order; patterns are the contract's, written so that no run of characters is scanned twice.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"\w+")
#: Places of the table of bits that tells which terms may be marked; 64 to a row.
BITS = 1 << 26


def emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, (end := m.end())
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then kind as listed."""
    out = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(q) <= 3 and int(q or 0) <= 255 for q in (p.lstrip("0") for p in m[0].split("."))):
            out.append((*m.span(), 1))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((*m.span(), 2))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((*m.span(), 3))
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda s: (s[0], s[2], s[1]))]


def _hash(x: str) -> int:
    h = xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def outside(text: str, spans: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """(start, end) of the words that no span overlaps; spans are sorted by start."""
    at, until = 0, 0
    for m in WORD.finditer(text):
        x, y = m.span()
        while at < len(spans) and spans[at][0] < y:
            until = max(until, spans[at][1])
            at += 1
        if until <= x:
            yield x, y


def places(text: str, words: list[str], spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, word) of the words wherever they stand whole in the text and no span overlaps them, in order."""
    ends = list(accumulate((b for _, b, _ in spans), max))
    starts, out = [a for a, _, _ in spans], []
    for w in words:
        x = text.find(w)
        while x >= 0:
            y = x + len(w)
            if not (x and (text[x - 1].isalnum() or text[x - 1] == "_")) and not (y < len(text) and (text[y].isalnum() or text[y] == "_")):
                before = bisect_left(starts, y)
                if not before or ends[before - 1] <= x:
                    out.append((x, y, w))
            x = text.find(w, y)
    return sorted(out)


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, entities, terms, others) of each text with entities, others being words that it has within spans alone; and (terms, counts) of the other documents that have a term, summed as far as a worker's memory goes."""
    held: Counter[str] = Counter()
    names, kind = ["digest", "entities", "terms", "others", "counts"], pa.list_(pa.int64())
    kinds = [pa.binary(), kind, kind, kind, kind]

    def out() -> pa.RecordBatch:
        columns = [[None], [None], [list(map(_hash, held))], [None], [list(held.values())]]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    for b in batches:
        rows = []
        for t in b.column(0).to_pylist():
            if not t:
                continue
            words = {w.lower() for w in set(WORD.findall(t))}
            if spans := base_spans(t):
                terms = {t[x:y].lower() for x, y in outside(t, spans)}
                digest = xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass"))
                rows.append((digest, [*{_hash(f"{kind}:{t[x:y].lower()}") for x, y, kind in spans}], [*map(_hash, terms)], [*map(_hash, words - terms)], None))
                continue
            held.update(words)
            if len(held) >= HELD:
                yield out()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    if held:
        yield out()


def lower_bound(both: np.ndarray, docs: np.ndarray, chance: float = CHANCE) -> np.ndarray:
    """Logarithms of the least p with docs KL(both / docs | p) <= ln(1 / chance)."""
    x, n, level = both.astype(float), docs.astype(float), -log(chance)
    q = x / n
    rest = np.where(q < 1, 1 - q, 1.0)
    own = np.where(q < 1, (n - x) * np.log(rest), 0.0)
    high = np.log(q)
    low = high - (level - own) / x
    for _ in range(60):
        mid = (low + high) / 2
        apart = x * (np.log(q) - mid) + own - np.where(q < 1, (n - x) * np.log1p(-np.exp(np.minimum(mid, -1e-300))), 0.0)
        low, high = np.where(apart > level, mid, low), np.where(apart > level, high, mid)
    return high


def least_together(own: float, total: float, discloses: float = DISCLOSES, chance: float = CHANCE) -> float:
    """Documents that an entity of `own` documents and a term need to have in common, at least, for the term to tell `discloses` of it."""
    return max(2, ceil(-log(chance) / ((1 - discloses) * log(total / own)) - 1e-9)) if own < total and discloses < 1 else inf


BASE = "uid long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, found array<struct<term:bigint,start:int,stop:int,shape:string>>"
_FOUND = pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("shape", pa.string())]))


def shape(word: str) -> str:
    """What a term is generalised to."""
    return "number" if word.isdigit() else "name" if word[:1].isupper() else "word"


def _marker(bits):
    """Base spans of each row, and the words outside them that may be terms to mark."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["uid", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "found"]
        types = [pa.int64()] * 6 + [pa.string()] * 2 + [_FOUND]
        table, known, marked = bits.value, set(), {}

        def may_be(words: set[str]) -> list[str]:
            """Those of the words that may be marked."""
            if new := words - known:
                if len(known) > HELD:
                    known.clear()
                    marked.clear()
                    new = words
                for w in new:
                    h = _hash(w.lower())
                    if int(table[h % BITS >> 6]) >> (h % 64) & 1:
                        marked[w] = h
                known.update(new)
            return list(marked.keys() & words) if len(marked) < len(words) else [w for w in words if w in marked]

        for b in batches:
            rows = []
            for u, i, t in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                t = t or ""
                spans = base_spans(t)
                joined = ",".join(f"{k}:{a}:{e}" for a, e, k in spans)
                kinds = [k for _, _, k in spans]
                found = [{"term": marked[w], "start": x, "stop": y, "shape": shape(w)} for x, y, w in places(t, may_be(set(WORD.findall(t))), spans)]
                rows.append((u, i, *(kinds.count(k) for k in KINDS), hashlib.sha256(joined.encode()).hexdigest() if spans else _NOTHING, joined, found))
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return mark


_NOTHING = hashlib.sha256(b"").hexdigest()


@F.pandas_udf(DoubleType())
def _bound(both: pd.Series, docs: pd.Series) -> pd.Series:
    return pd.Series(lower_bound(both.to_numpy(), docs.to_numpy()))


def _classes(rows: DataFrame, items: str, by: str, least: float) -> DataFrame:
    """(by, k, class) of what `items` of the documents hold: k documents, and a class for those that have the same ones."""
    each = rows.select("uid", F.explode(items).alias(by)).groupBy(by).agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("uid")).alias("_a"), F.bit_xor(F.xxhash64("uid", F.lit(1))).alias("_b"))
    return each.filter(F.col("k") >= least).withColumn("class", F.struct("_a", "_b")).drop("_a", "_b")


def telling(docs: DataFrame, text: str = "text", discloses: float = DISCLOSES) -> DataFrame:
    """(term, share) of the terms that tell `discloses` of an entity or more: the most that they tell of any. Written."""
    spark = common.tune(docs.sparkSession)
    texts = docs.select(F.col(text).alias("text"))
    found = common.written(texts.mapInArrow(_told, "digest binary, entities array<long>, terms array<long>, others array<long>, counts array<long>"), "pii-found")
    with_entities = found.filter("digest is not null")
    base = common.written(with_entities.dropDuplicates(["digest"]).withColumn("uid", F.monotonically_increasing_id()), "pii-base")
    total = float(texts.count() - with_entities.count() + base.count())
    entities = _classes(base, "entities", "entity", 2).withColumn("own", F.col("k")).filter(F.col("k") < F.lit(total)).filter(F.col("k") >= need_of(total, discloses))
    entities = common.written(entities, "pii-entities")
    # share >= discloses takes own / docs >= (own / N)^(1 - discloses) at least: too frequent terms tell too little of any entity
    bound = F.pow("own", F.lit(discloses)) * F.lit(total ** (1 - discloses) * (1 + 1e-9))
    top = entities.agg(F.max(bound).alias("bound"), F.min("k").alias("least")).first()
    least = least_together(top["least"], total, discloses) if top["least"] else inf
    wanted = common.written(_classes(base, "terms", "term", least), "pii-wanted")
    more = found.filter("counts is not null").select(F.inline(F.arrays_zip("terms", "counts"))).select(F.col("terms").alias("term"), "counts")
    more = more.unionByName(base.select(F.explode("others").alias("term"), F.lit(1).cast("long").alias("counts"))).groupBy("term").agg(F.sum("counts").alias("more"))
    n = F.col("k") + F.coalesce("more", F.lit(0))
    terms = common.written(wanted.join(more, "term", "left").withColumn("docs", n).drop("more").filter(F.col("docs") <= F.lit(top["bound"] or 0.0)), "pii-terms")
    # One of each class stands for it: the others have the same documents.
    of_entities = common.written(entities.groupBy("class", "own", "k").agg(F.min("entity").alias("entity")), "pii-entity-classes")
    of_terms = common.written(terms.groupBy("class", "docs", "k").agg(F.min("term").alias("term")), "pii-term-classes")
    named = _standing(base, "entities", "entity", of_entities).select("uid", "class", "own")
    rare = _standing(base, "terms", "term", of_terms).select("uid", F.struct("class", "docs").alias("term"), "docs", "k")
    named, rare = common.written(named, "pii-named"), common.written(rare, "pii-rare")
    pairs = _dealt(named, rare).filter((F.col("docs") <= bound) & (F.col("k") >= need_of(total, discloses))).groupBy("class", "term").agg(F.count("*").alias("both"), F.first("own").alias("own"), F.first("docs").alias("docs"))
    own = F.log(F.lit(max(total, 1.0)) / F.col("own"))
    share = (_bound("both", "docs") + own) / own
    shares = pairs.select(F.col("term.class").alias("class"), "docs", share.alias("share")).groupBy("class", "docs").agg(F.max("share").alias("share")).filter(F.col("share") >= discloses)
    out = common.written(terms.join(shares, ["class", "docs"]).select("term", "share"), "pii-telling")
    common.dropped(found, base, entities, wanted, terms, of_entities, of_terms, named, rare)
    return out


def _standing(base: DataFrame, items: str, by: str, few: DataFrame) -> DataFrame:
    """(uid, and the columns of few) of each document that holds an item of few; few: `by` once each, in `k` documents, written already."""
    each = base.select("uid", F.explode(items).alias(by))
    right, small = common.bounded(few)
    return each.join(right, by) if small else common.join_hot(each, few, by, "k", "uid").filter("k is not null")


def need_of(total: float, discloses: float):
    """`least_together` of the column `own`."""
    return F.greatest(F.lit(2.0), F.ceil(F.lit(-log(CHANCE) / (1 - discloses)) / F.log(F.lit(max(total, 1.0)) / F.col("own")) - F.lit(1e-9)))


def _dealt(named: DataFrame, rare: DataFrame) -> DataFrame:
    """named and rare joined by uid; the terms of a document with more than PAIRS pairs are dealt to several tasks, and its entities go to each."""
    sizes = named.groupBy("uid").agg(F.count("*").alias("e")).join(rare.groupBy("uid").agg(F.count("*").alias("t")), "uid")
    large = common.written(sizes.select("uid", F.ceil(F.col("e") * F.col("t") / PAIRS).cast("int").alias("parts")).filter("parts > 1"), "pii-large")
    few, _ = common.bounded(large)
    parts = F.coalesce("parts", F.lit(1))
    left = named.join(few, "uid", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    right = rare.join(few, "uid", "left").withColumn("part", F.pmod(F.xxhash64("term"), parts).cast("int")).drop("parts")
    return left.join(right, ["uid", "part"])


def _bits(told: DataFrame) -> np.ndarray:
    """A bit for each term's hash, in a table of fixed size."""
    at = F.pmod("term", F.lit(BITS))
    rows = told.select(F.shiftright(at, 6).cast("int").alias("at"), F.expr(f"shiftleft(1L, cast(pmod(term, {BITS}L) % 64 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(BITS >> 6, np.int64)
    out[rows["at"].to_numpy(int)] = rows["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def found(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", discloses: float = DISCLOSES, reveals: float = REVEALS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, `shares` (of the added spans, in their order), n_generalised and n_removed, and `replaced`: the spans with what each is replaced by, nothing if it is removed."""
    told = telling(docs, text, discloses)
    bits = docs.sparkSession.sparkContext.broadcast(_bits(told))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = common.written(rows.mapInArrow(_marker(bits), BASE), "pii-marked")
    some = F.size("found") > 0
    words = rows.filter(some).select("uid", F.inline("found"))
    met = common.join_hot(words, common.written(told.join(words.groupBy("term").agg(F.count("*").alias("n")), "term"), "pii-told"), "term", "n", "start").filter("share is not null")
    added = met.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "share", "shape"))).alias("added"))
    # Rows without a candidate are done; only the others meet their terms.
    rest = rows.filter(~some).drop("found").withColumn("added", F.lit(None).cast("array<struct<start:int,stop:int,share:double,shape:string>>"))
    rows = rest.unionByName(rows.filter(some).drop("found").join(added, "uid", "left"))
    return rows.mapInArrow(_joined(reveals), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, shares array<double>, n_generalised long, n_removed long, replaced string")


def _joined(reveals: float):
    order = {k: n for n, k in enumerate((*KINDS, "term"))}

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep, more = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"], ["spans", "shares", "n_generalised", "n_removed", "replaced"]
        kinds = [pa.string(), pa.list_(pa.float64()), pa.int64(), pa.int64(), pa.string()]
        for b in batches:
            rows = []
            for base, added in zip(b.column("base").to_pylist(), b.column("added").to_pylist(), strict=True):
                if not added:
                    rows.append((base, [], 0, 0, base))
                    continue
                parts = [(int(a), order[k], int(e), k, k) for k, a, e in (x.split(":") for x in base.split(",") if x)]
                parts += [(x["start"], order["term"], x["stop"], "term", x["shape"] if x["share"] < reveals else "") for x in added]
                parts.sort()
                gone = sum(x["share"] >= reveals for x in added)
                rows.append((",".join(f"{k}:{a}:{e}" for a, _, e, k, _ in parts), [x["share"] for x in added], len(added) - gone, gone, ",".join(f"{r}:{a}:{e}" for a, _, e, _, r in parts)))
            cols = list(zip(*rows, strict=True)) or [()] * len(more)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], [*keep, *more])

    return join


def replaced_text(text: str, replaced: str) -> str:
    """The text with each span replaced as told; a span within what is replaced already goes."""
    out, at = [], 0
    for put, a, b in (x.split(":") for x in replaced.split(",") if x):
        a, b = int(a), int(b)
        if b <= at:
            continue
        out += [text[at : max(a, at)], f"[{put}]" if put else ""]
        at = b
    return "".join(out) + text[at:]


def sanitised_text(text: str, spans: str, shares: list[float], reveals: float = REVEALS) -> str:
    """The text with base spans named by kind, disclosing terms generalised to their shape, revealing ones removed."""
    share, parts = iter(shares), [x.split(":") for x in spans.split(",") if x]
    told = [((shape(text[int(a) : int(b)]) if next(share) < reveals else "") if k == "term" else k, a, b) for k, a, b in parts]
    return replaced_text(text, ",".join(map(":".join, told)))


def sanitised(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", discloses: float = DISCLOSES, reveals: float = REVEALS) -> DataFrame:
    """doc_id, text (sanitised) and spans of each row. Rows are told apart by themselves, whatever their doc_ids."""
    held = common.written(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row")), "pii-rows")
    spans = found(held, "text", "row", discloses, reveals).filter("spans <> ''").select(F.col("doc_id").alias("row"), "spans", "replaced")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [replaced_text(t, r or "") for t, r in zip(b.column("text").to_pylist(), b.column("replaced").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string()), b.column("spans")], ["doc_id", "text", "spans"])

    met = held.join(common.written(spans, "pii-spans"), "row", "left").select("doc_id", "text", F.coalesce("spans", F.lit("")).alias("spans"), "replaced")
    return met.mapInArrow(put, "doc_id long, text string, spans string")

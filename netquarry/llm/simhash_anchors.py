"""Near duplicates by SimHash, sought by covering codes.

A bit of a document's fingerprint is 1 if it is set in over half the hashes of its
shingles. Fingerprints link at `bits` differing bits, three at most. Equal ones are
one row from then on. Of two that link, the left or the right halves differ in one
bit at most. For each half, the code words of the (31, 26) Hamming code beside a
free bit are the anchors: each half is within one bit of its own anchor. The other
one of the pair is then within two bits of that anchor, so that each fingerprint is
copied to the anchors within two bits, 17 of 2^27 for each half, and compared there
with the fingerprints whose own anchor it is. No pair is lost.

Anchors with many fingerprints are cut into squares of PART by PART, in tasks of
their own. A square passes on no pairs, but a link from each fingerprint to the
least of those that links within the square reach: as many rows as fingerprints,
however many pairs. Time still grows with the pairs of different fingerprints that
share an anchor; copies cost nothing.

Defined cases: a null or empty text has no words and the fingerprint zero, which
links like any other; fewer words than a shingle make one shingle; a very long text
is hashed whole, some thousand shingles at a time; a null doc_id has a fingerprint,
and the component of those that it links with, null if none of them has a doc_id;
rows that occur more than once have a row each; an empty table gives no rows; extra
columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.llm import common
from netquarry.llm.components import connected

#: Words of a shingle; the hash's seed, Spark's own; greatest number of differing bits.
SHINGLE, SEED, BITS = 3, 42, 3
#: Shingles hashed at a time; fingerprints of an anchor that are compared in one task; of a group whose pairs are told one by one.
CHUNK, PART, FEW = 1 << 15, 2048, 16
#: Positions of the Hamming code's bits, 1 to 31; a half has one bit more.
LENGTH = 31


def fingerprint(text: bytes | None, k: int = SHINGLE) -> int:
    """Of a text in UTF-8, as a signed number."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, k = b" ".join(words), min(k, len(words))
    ends = list(accumulate(len(w) + 1 for w in words))
    starts, n, ones = [0, *ends[: len(words) - k]], len(words) - k + 1, np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        h = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts[at : at + CHUNK], ends[at + k - 1 : at + k - 1 + CHUNK], strict=False)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def _fingerprints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t, k) for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of each row."""
    common.tune(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text")).mapInArrow(_fingerprints(k), "doc_id long, fp long")


def syndrome(half: Column) -> Column:
    """Position of the bit that the nearest code word differs in, 0 for code words: the exclusive or of the positions of all set bits."""
    odd = lambda j: F.bit_count(half.bitwiseAND(F.lit(sum(1 << p - 1 for p in range(1, LENGTH + 1) if p >> j & 1)).cast("long"))) % 2
    return sum(odd(j) * (1 << j) for j in range(5)).cast("int")


def _half(fp: Column, side: int) -> Column:
    return F.shiftrightunsigned(fp, 32 * side).bitwiseAND(F.lit((1 << 32) - 1).cast("long"))


def _of_half(half: Column, at: Column, side: int) -> Column:
    """Array of (anchor, own) of a half whose syndrome is `at`; the side stands in the anchor's bit 32."""
    bit = lambda p: F.when(p > 0, F.call_function("shiftleft", F.lit(1).cast("long"), p - 1)).otherwise(F.lit(0).cast("long"))
    named = lambda word, own: F.struct(word.bitwiseOR(F.lit(side << 32).cast("long")).alias("anchor"), F.lit(own).alias("own"))
    own = half.bitwiseXOR(bit(at))
    # Two bits off: the code words that flip the bits p and q with p xor q = at, each pair once; none where the half is a code word.
    pairs = F.when(at > 0, F.filter(F.sequence(F.lit(1), F.lit(LENGTH)), lambda p: p < p.bitwiseXOR(at))).otherwise(F.array().cast("array<int>"))
    others = F.transform(pairs, lambda p: named(half.bitwiseXOR(bit(p)).bitwiseXOR(bit(p.bitwiseXOR(at))), False))
    return F.concat(F.array(named(own, True), named(own.bitwiseXOR(F.lit(1 << LENGTH).cast("long")), False)), others)


def anchors(fp: Column, s: tuple[Column, Column]) -> Column:
    """Array of (anchor, own) of a fingerprint: its own anchor of each half, and the others within two bits of the half. s: syndromes of the halves."""
    return F.concat(*[_of_half(_half(fp, side), at, side) for side, at in enumerate(s)])


def reached(own: np.ndarray, near: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect what the pairs of an own and a near fingerprint connect."""
    links = np.bitwise_count((own[:, None] ^ near[None, :]).view(np.uint64)) <= bits  # of signed numbers it would count the bits of the absolute value
    if links.size <= FEW * FEW:
        a, b = np.nonzero(links)
        return own[a], near[b]
    every = np.unique(np.concatenate([own, near]))
    top = len(every)
    label, of_own, of_near = np.arange(top), np.searchsorted(every, own), np.searchsorted(every, near)
    while True:
        before = label.copy()
        for rows, here, there in ((links, of_own, of_near), (links.T, of_near, of_own)):
            for k in range(0, len(here), 256):
                least = np.where(rows[k : k + 256], label[there][None, :], top).min(axis=1)
                np.minimum.at(label, here[k : k + 256], least)
        label = label[label]
        if np.array_equal(label, before):
            some = label < np.arange(top)
            return every[some], every[label[some]]


def _linked(bits: int):
    """(anchor, row, col, fp, own), sorted by the first three, to links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return reached(a["fp"][a["own"]], a["fp"], bits)

        def groups(a: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
            """Links of all whole groups; the last one may go on."""
            new = np.flatnonzero((a["anchor"][1:] != a["anchor"][:-1]) | (a["row"][1:] != a["row"][:-1]) | (a["col"][1:] != a["col"][:-1])) + 1
            cuts = np.concatenate([[0], new, [len(a)]])
            if not last:
                held.append(a[cuts[-2] :])
                cuts = cuts[:-1]
            owns = np.concatenate([[0], np.cumsum(a["own"])])
            some = (np.diff(cuts) > 1) & (owns[cuts[1:]] > owns[cuts[:-1]])  # others have nothing to compare
            found = [links(a[x:y]) for x, y in zip(cuts[:-1][some].tolist(), cuts[1:][some].tolist(), strict=True)]
            if found:
                x, y = (np.concatenate(c) for c in zip(*found, strict=True))
                x, y = np.maximum(x, y), np.minimum(x, y)
                keep = x != y
                yield pa.RecordBatch.from_arrays([pa.array(x[keep], pa.int64()), pa.array(y[keep], pa.int64())], ["a", "b"])

        kinds = [("anchor", np.int64), ("row", np.int32), ("col", np.int32), ("fp", np.int64), ("own", bool)]
        for b in batches:
            if not len(b):
                continue
            a = np.zeros(len(b), kinds)
            for k, (name, _) in enumerate(kinds):
                a[name] = b.column(k).to_numpy(zero_copy_only=False)
            one = lambda r: (r["anchor"], r["row"], r["col"])
            if held and one(held[0][0]) == one(a[0]) == one(a[-1]):  # all of one group that goes on
                held.append(a)
                continue
            whole = np.concatenate([*held, a])
            held.clear()
            yield from groups(whole, False)
        if held:
            yield from groups(np.concatenate(held), True)

    return run


def links(classes: DataFrame, bits: int = BITS, part: int = PART) -> DataFrame:
    """(a, b), a > b, of fingerprints: enough of the pairs that differ in `bits` bits to connect what all of them connect. classes: `fp`, each once, written already."""
    if not 0 <= bits <= 3:
        raise ValueError("anchors of halves reach three differing bits")
    at = classes.select("fp", *[syndrome(_half(F.col("fp"), side)).alias(f"s{side}") for side in (0, 1)])
    placed = at.select("fp", F.explode(anchors(F.col("fp"), (F.col("s0"), F.col("s1")))).alias("at")).select("fp", F.col("at.anchor").alias("anchor"), F.col("at.own").alias("own"))
    sizes = placed.groupBy("anchor").agg(F.count("*").alias("n"), F.sum(F.col("own").cast("long")).alias("n_own")).filter(F.col("n") > part)
    sizes = sizes.filter("n_own > 0").select(F.col("anchor").alias("_anchor"), F.ceil(F.col("n_own") / part).cast("int").alias("rows"), F.ceil(F.col("n") / part).cast("int").alias("cols"))
    large, _ = common.bounded(common.written(sizes, "anchor-sizes"))
    met = placed.join(large, F.col("anchor") == F.col("_anchor"), "left")
    rows, cols = F.coalesce("rows", F.lit(1)), F.coalesce("cols", F.lit(1))
    row, col = F.pmod(F.xxhash64("fp"), rows).cast("int"), F.pmod(F.xxhash64("fp", F.lit(1)), cols).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    # An own fingerprint goes to the squares of its row as own, and every one to the squares of its column as near.
    square = lambda r, c, own: F.struct(r.cast("int").alias("row"), c.cast("int").alias("col"), F.lit(own).alias("own"))
    own = F.when(F.col("own"), F.transform(upto(cols), lambda c: square(row, c, True))).otherwise(F.array().cast("array<struct<row:int,col:int,own:boolean>>"))
    near = F.transform(upto(rows), lambda r: square(r, col, False))
    one = F.array(square(F.lit(0), F.lit(0), True))
    lone = F.coalesce(F.col("rows"), F.lit(1)) * F.coalesce(F.col("cols"), F.lit(1)) == 1
    squares = F.when(lone & F.col("own"), one).when(lone, F.array(square(F.lit(0), F.lit(0), False))).otherwise(F.concat(own, near))
    dealt = met.select("anchor", "fp", F.explode(squares).alias("at")).select("anchor", F.col("at.row").alias("row"), F.col("at.col").alias("col"), "fp", F.col("at.own").alias("own"))
    dealt = dealt.repartition("anchor", "row", "col").sortWithinPartitions("anchor", "row", "col")
    return dealt.mapInArrow(_linked(bits), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id that links reach) and component_docs of each row."""
    rows = common.written(fingerprints(docs, text, doc_id, k), "simhash")
    classes = common.written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-classes")
    roots = connected(common.written(links(classes, bits), "simhash-links"))
    of = common.written(classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    tops = of.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("component_docs"), F.count("*").alias("members"))
    named = common.join_hot(of, common.written(tops, "simhash-components"), "root", "members", "fp").select("fp", "n", "component_id", "component_docs")
    return common.join_hot(rows, common.written(named, "simhash-named"), "fp", "n", "doc_id").select("doc_id", "fp", "component_id", "component_docs")

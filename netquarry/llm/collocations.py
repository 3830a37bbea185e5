"""Phrase collocations by count-min sketches and exact counts of what survives them.

Texts are cut into pieces at marks and line ends, pieces into words, and phrases
are the runs of words of a piece. A pass hashes all words and pairs of words into a
sketch per task; sketches are merged cell by cell, and a cell that reaches `least`
becomes a bit. A sketch only overestimates, so that whatever occurs `least` times has
all its bits. A second sketch takes the longer phrases whose pairs all have theirs:
others can't occur often. The last pass counts exactly what survives: a phrase does
if it and both phrases within it that are a word shorter have their bits, since these
occur at least as often. Counts of survivors are summed by phrase, and those below
`least` go, so that the result doesn't depend on the sketches.

Each cut of a phrase in two compares its count a with those of its parts, l and r:
floor(1000 a n / (l r)) for n words in all; the lowest one is its score. A phrase
within a longer one that occurs as often is subsumed. All this is by language.

Cells grow with the text up to MOST_CELLS a row; a worker holds ROWS such rows of
four bytes a cell, and the merged bits, an eighth of a byte a cell, are broadcast.
For texts of more than about 50 x MOST_CELLS words the sketch lets ever more
through: the result stays exact, and the second pass comes to be a count of all
phrases, combined in each task before the exchange.

Defined cases: a null or empty text has no words; a null language is `und`; a very
long text is gone through in chunks that overlap by a phrase; rows that occur more
than once count each time; products are decimals of 38 digits, quotients longs:
n may reach 9 x 10^15; ties in score and count go by the phrase's bytes; an empty
table gives no rows; doc_id and extra columns don't matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from netquarry.llm import common

#: Words of the longest phrase, fewest occurrences, phrases of a language in the result.
LONGEST, LEAST, TOP = 5, 100, 2000
#: Rows of the sketch; cells of a row; bytes of text for each cell; cells of a block in the merge.
ROWS, LEAST_CELLS, MOST_CELLS, BYTES_A_CELL, BLOCK = 2, 1 << 18, 1 << 24, 32, 1 << 16
#: Tasks of a pass for each core of the cluster: the sizes of a sketch, and of the counts of frequent phrases, hardly depend on how much text a task has.
TASKS = 2
#: Phrases that a worker counts before it passes the counts on; words that it remembers; bytes of a chunk.
HELD, MEMO, CHUNK = 400_000, 1_000_000, 2 << 20
#: Marks that end a piece become line feeds, tabs become spaces.
MARKS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
#: Odd multipliers that spread hashes over the rows, and the one of the chain.
SPREAD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
CHAIN = np.uint64(0xD6E8FEB86659FD93)


class Words(dict):
    """Numbers of words, by first use; `hashes` and `names` are by number, `raw` are the hashes of the last ones. Empty strings and line feeds have numbers below 0."""

    def __init__(self):
        super().__init__({b"": -2, b"\n": -1})
        self.names: list[bytes] = []
        self.raw: list[int] = []
        self.hashes = np.zeros(0, np.uint64)

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.names)
        self.names.append(word)
        self.raw.append(xxhash.xxh64_intdigest(word))
        return n

    def hashed(self) -> np.ndarray:
        if self.raw:
            self.hashes = np.concatenate([self.hashes, np.array(self.raw, np.uint64)])
            self.raw.clear()
        return self.hashes


def chunks(text: bytes, words: Words, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(numbers of words, piece of each, how many of them the chunk before had too) for each chunk of a text."""
    text = text.lower().translate(MARKS)
    at, held, carried = 0, np.zeros(0, np.int64), 0
    while at < len(text):
        end = len(text)
        if end - at > CHUNK:
            cut = [x for x in (text.find(b" ", at + CHUNK), text.find(b"\n", at + CHUNK)) if x >= 0]
            end = min(cut) if cut else end
        part = text[at:end].replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(words.__getitem__, part), np.int64, len(part))
        ids = np.concatenate([held, ids[ids > -2]])
        seen, at = carried, end
        piece = np.cumsum(ids < 0)
        some = ids >= 0
        yield ids[some], piece[some], seen
        tail = ids[max(0, len(ids) - (longest - 1)) :]
        last = np.flatnonzero(tail < 0)
        held = tail[last[-1] + 1 :] if len(last) else tail
        carried = len(held)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * CHAIN
    return h ^ (h >> np.uint64(29))


def _seed(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 11))


def _cells(h: np.ndarray, row: int, cells: int) -> np.ndarray:
    return ((h * np.uint64(SPREAD[row])) >> np.uint64(65 - cells.bit_length())).astype(np.int64)


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(language, its texts): texts joined by line feeds, a chunk of a language or so at a time."""
    held: dict[str, list[bytes]] = {}
    size: Counter[str] = Counter()
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            held.setdefault(lang, []).append(text or b"")
            size[lang] += len(text or b"") + 1
            if size[lang] > CHUNK:
                del size[lang]
                yield lang, b"\n".join(held.pop(lang))
        if size.total() > 4 * CHUNK:  # many languages
            size.clear()
            while held:
                yield (one := held.popitem())[0], b"\n".join(one[1])
    for lang, texts in held.items():
        yield lang, b"\n".join(texts)


def _sketcher(lengths: range, longest: int, least: int, cells: int, pairs=None):
    """Sketches of a task for phrases of these lengths, in blocks whose counts stop at `least`. pairs: the bits of words and pairs, a broadcast; phrases need those of all their pairs."""
    kind = np.uint8 if least < 256 else np.uint16 if least < 1 << 16 else np.uint32

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, words, one = np.zeros((ROWS, cells), np.uint32), Words(), np.uint32(1)  # a number of the table's own kind is added much faster
        kept = None if pairs is None else _unpacked(pairs.value)
        for lang, text in _by_lang(batches):
            if len(words) > MEMO:
                words = Words()
            seed = _seed(lang)
            for w, piece, seen in chunks(text, words, longest):
                of = words.hashed()[w]
                h, some = _mixed(of ^ seed), np.ones(len(w), bool)  # of the phrases that begin at each word, and whether their pairs are often enough
                often = some
                for m in range(1, lengths.stop):
                    if m > 1:
                        h = _mixed(h[:-1] * CHAIN + of[m - 1 :])
                    if not len(h):
                        break
                    if m == 2 and kept is not None:
                        often = _has(kept, h)
                    some = some[: len(h)]
                    if m > 1:
                        some = some & (piece[: len(h)] == piece[m - 1 :])
                        if kept is not None:
                            some &= often[m - 2 :]
                    if m not in lengths:
                        continue
                    start = max(0, seen - m + 1)  # what ends within the carried words was counted before
                    whole = h[start:][some[start:]]
                    for row in range(ROWS):
                        np.add.at(table[row], _cells(whole, row, cells), one)
        flat = np.minimum(table.reshape(-1), least).astype(kind)
        del table
        for k in range(0, len(flat), BLOCK):
            block = flat[k : k + BLOCK]
            if block.any():
                yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK], pa.int32()), pa.array([block.tobytes()], pa.binary())], ["block", "cells"])

    return sketch


def _unpacked(bits: bytes) -> np.ndarray:
    """(row, cell) of a sketch's bits."""
    return np.unpackbits(np.frombuffer(bits, np.uint8)).view(bool).reshape(ROWS, -1)


def _has(kept: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether hashes have all their bits."""
    out = np.ones(len(h), bool)
    for row in range(ROWS):
        out &= kept[row][_cells(h, row, kept.shape[1])]
    return out


def _merger(least: int):
    """Blocks in order to the bits of their sums."""
    kind = np.uint8 if least < 256 else np.uint16 if least < 1 << 16 else np.uint32

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], ["block", "bits"])

        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != at:
                    if at is not None:
                        yield out()
                    at, total = k, np.zeros(len(raw) // kind().itemsize, np.uint64)
                total += np.frombuffer(raw, kind)
        if at is not None:
            yield out()

    return merge


def sketched(texts: DataFrame, lengths: range, longest: int, least: int, cells: int, pairs=None) -> bytes:
    """The merged sketch of (lang, text) for phrases of these lengths: a bit for each cell of each row, whether it reaches `least`."""
    blocks = texts.mapInArrow(_sketcher(lengths, longest, least, cells, pairs), "block int, cells binary")
    bits = np.zeros(ROWS * cells, bool)
    # A bit for each cell: MOST_CELLS of them a row at most, whatever the texts.
    for r in blocks.repartition("block").sortWithinPartitions("block").mapInArrow(_merger(least), "block int, bits binary").collect():
        found = np.unpackbits(np.frombuffer(r["bits"], np.uint8)).view(bool)
        start = r["block"] * BLOCK
        bits[start : start + min(BLOCK, len(bits) - start)] = found[: len(bits) - start]
    return np.packbits(bits).tobytes()


def _counter(longest: int, bits):
    """bits: of the sketch of words and pairs and of that of longer phrases, a broadcast. (lang, phrase, words, count) of surviving phrases, summed as far as a worker's memory goes; a row without phrase has the words of a language."""
    names, kinds = ["lang", "phrase", "words", "n"], [pa.string(), pa.binary(), pa.int32(), pa.int64()]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short, long = map(_unpacked, bits.value)
        held: Counter[tuple] = Counter()
        words = Words()

        def out() -> pa.RecordBatch:
            columns = list(zip(*((*key, n) for key, n in held.items()), strict=True))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for lang, text in _by_lang(batches):
            if len(words) > MEMO:
                words = Words()
            seed = _seed(lang)
            for w, piece, seen in chunks(text, words, longest):
                of, name = words.hashed()[w], words.names
                held[lang, None, 0] += len(w) - seen
                pos, h = np.arange(len(w)), _mixed(of ^ seed)  # surviving phrases of m words: where they begin, their hash, their number
                known = np.full(len(w), -1)
                for m in range(1, longest + 1):
                    if m > 1:
                        inside = np.flatnonzero(pos + m - 1 < len(w))
                        inside = inside[(known[pos[inside] + 1] >= 0) & (piece[pos[inside]] == piece[pos[inside] + m - 1])]
                        key = known[pos[inside]] * np.int64(len(name)) + w[pos[inside] + m - 1]
                        pos, h = pos[inside], _mixed(h[inside] * CHAIN + of[pos[inside] + m - 1])
                    else:
                        key = w
                    some = _has(short if m <= 2 else long, h)
                    pos, h, key = pos[some], h[some], key[some]
                    if not len(pos):
                        break
                    _, first, number = np.unique(key, return_index=True, return_inverse=True)
                    fresh = pos + m - 1 >= seen
                    times = np.bincount(number[fresh], minlength=len(first))
                    for x, n in zip(pos[first].tolist(), times.tolist(), strict=True):
                        if n:
                            held[lang, b" ".join([name[k] for k in w[x : x + m].tolist()]), m] += n
                    known = np.full(len(w), -1)
                    known[pos] = number
            if len(held) >= HELD:
                yield out()
        if held:
            yield out()

    return count


def counted(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, most_cells: int = MOST_CELLS) -> DataFrame:
    """(lang, phrase, words, n) of all phrases that occur `least` times, exactly; a row of a language without phrase has its number of words. Written."""
    spark = common.tune(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").cast("binary").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    texts = texts.coalesce(TASKS * spark.sparkContext.defaultParallelism)
    cells = LEAST_CELLS
    while cells < most_cells and cells * BYTES_A_CELL < size:
        cells *= 2
    pairs = sketched(texts, range(1, min(longest, 2) + 1), longest, least, cells)
    more = sketched(texts, range(3, longest + 1), longest, least, cells, spark.sparkContext.broadcast(pairs)) if longest > 2 else pairs
    each = texts.mapInArrow(_counter(longest, spark.sparkContext.broadcast((pairs, more))), "lang string, phrase binary, words int, n long")
    return common.written(each.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).filter(F.col("phrase").isNull() | (F.col("n") >= least)), "phrases")


def _looked_up(rows: DataFrame, part: str, phrases: DataFrame, name: str) -> DataFrame:
    """rows with the count of the phrase in `part`, whatever the skew; rows has `lang`, and `part` has the phrase with the language behind a tab."""
    asked = rows.groupBy(part).agg(F.count("*").alias("_rows"))
    found = common.written(phrases.select(_key("phrase").alias(part), F.col("n").alias(name)).join(asked, part), "phrase-parts")
    return common.join_hot(rows, found, part, "_rows", "spread").drop("_rows")


def _key(phrase: str):
    """A phrase and its language; phrases hold no tab."""
    return F.concat(F.col(phrase).cast("string"), F.lit("\t"), F.col("lang"))


def scored(phrases: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, n, score of each phrase of two words or more in `counted`: those of its lowest cut. Written."""
    sizes = phrases.filter("phrase is null").select(F.col("lang").alias("_lang"), F.col("n").alias("size"))
    known = phrases.filter("phrase is not null")
    w = F.split(F.col("phrase").cast("string"), " ")
    cuts = known.filter("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), w.alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    tail = F.concat(F.lit("\t"), F.col("lang"))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", F.xxhash64("phrase", "k").alias("spread"), F.concat(F.array_join(F.slice("w", F.lit(1), F.col("k")), " "), tail).alias("first"), F.concat(F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " "), tail).alias("rest"))
    cuts = common.written(cuts, "phrase-cuts")
    both = _looked_up(_looked_up(cuts, "first", known, "l"), "rest", known, "r")
    few, _ = common.bounded(common.written(sizes, "phrase-sizes"))
    both = both.join(few, F.col("lang") == F.col("_lang"))
    big = lambda c: F.col(c).cast("decimal(19,0)")
    both = both.withColumn("up", F.lit(1000).cast("decimal(4,0)") * (big("a") * big("size"))).withColumn("down", big("l") * big("r"))
    least = F.min(F.struct(F.expr("cast(up div down as bigint)").alias("score"), "k", "l", "r", "size")).alias("cut")
    return common.written(both.groupBy("lang", "phrase", "words", "a").agg(least).select("lang", "phrase", "words", "a", "cut.l", "cut.r", F.col("cut.size").alias("n"), "cut.score"), "phrase-scores")


def subsumed(scores: DataFrame) -> DataFrame:
    """(lang, phrase, cover): the greatest count of a longer phrase that holds the phrase."""
    w = F.split(F.col("phrase").cast("string"), " ")
    long = scores.filter("words > 2").select("lang", "words", "a", w.alias("w"))
    spans = long.select("lang", "words", "a", "w", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("m"))
    spans = spans.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)).alias("at"))
    return spans.groupBy("lang", F.array_join(F.slice("w", F.col("at"), F.col("m")), " ").cast("binary").alias("phrase")).agg(F.max("a").alias("cover"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = TOP, most_cells: int = MOST_CELLS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the `top` phrases of each language that no longer one subsumes."""
    scores = scored(counted(docs, text, lang, longest, least, most_cells))
    left = scores.join(subsumed(scores), ["lang", "phrase"], "left").filter(F.coalesce("cover", F.lit(0)) < F.col("a"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The first of each share of a language before the first of all, so that no task sorts a language.
    shares = left.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    shares = shares.withColumn("rank", F.row_number().over(W.partitionBy("lang", "share").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = shares.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", "n", "score")

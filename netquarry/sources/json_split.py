"""Records of one large JSON document, read by several tasks.

A document is one object or array, whose records are the members of the container
at a path of keys. Spark's text reader cuts the file at commas, each task within
its own range of bytes; a task's text begins after a comma and ends before one. What
a range needs to know of those before it are three things: whether it begins in a
string, how deep, and how much of the path is open. Each pass reads the ranges
once: the first one counts quotes and brackets for both cases of the string, and
running sums give each range's string state and depth; the second one tells what
each range makes of an open part of the path, and these are applied one after the
other; the third one gives the records. A record that spans ranges comes as
fragments, which are put together by their order.

Defined cases: an empty or missing file has no records, nor has a path that isn't
there; strings may hold brackets, commas, quotes and escapes; blanks and line ends
count nowhere outside of strings; a key that occurs more than once is a record each
time; a document that ends early has its last record as far as it goes. Compressed
files can't be cut and are read by one task. Several files are documents of their own.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from netquarry.session import listed, scratch

#: Ranges whose states are broadcast; beyond them rows are exchanged to meet theirs.
MOST_RANGES = 100_000
QUOTE, ESCAPE, COMMA, COLON = b'"\\,:'
STRING = re.compile(rb'"[^"\\]*(?:\\.[^"\\]*)*"\s*', re.S)
_OPEN, _CLOSE = np.zeros(256, np.int8), np.zeros(256, np.int8)
_OPEN[list(b"{[")] = 1
_CLOSE[list(b"}]")] = 1


def _quotes(a: np.ndarray) -> np.ndarray:
    """Whether each byte is a quote that no escape stands before."""
    quote = a == QUOTE
    for at in np.flatnonzero(quote[1:] & (a[:-1] == ESCAPE)) + 1:
        k = at - 1
        while k >= 0 and a[k] == ESCAPE:
            k -= 1
        quote[at] = (at - 1 - k) % 2 == 0
    return quote


def _outside(a: np.ndarray, in_string: int) -> np.ndarray:
    """Whether each byte stands outside of strings; opening quotes count as inside, closing ones as outside."""
    return (np.cumsum(_quotes(a)) + in_string) % 2 == 0


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict, bytes]]:
    """(place, state, text) of each batch's part of a range: (path, start), the columns beside it, and the bytes with their commas."""
    for b in batches:
        paths, starts = b.column("path"), b.column("start").to_numpy()
        if not len(b):
            continue
        ends = [*(np.flatnonzero((np.diff(starts) != 0) | np.array([x != y for x, y in zip(paths[:-1].to_pylist(), paths[1:].to_pylist(), strict=True)], bool)) + 1).tolist(), len(b)]
        at = 0
        for end in ends:
            one = b.slice(at, end - at)
            state = {c: one.column(c)[0].as_py() for c in one.schema.names if c != "value"}
            yield (state["path"], state["start"]), state, b",".join(x or b"" for x in one.column("value").to_pylist()) + b","
            at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, start, parity of quotes, depth gained if the range begins outside of a string, and if inside)."""
    sums: dict[tuple, list[int]] = {}
    for place, _, text in _ranges(batches):
        a = np.frombuffer(text, np.uint8)
        own = sums.setdefault(place, [0, 0, 0])
        odd = (np.cumsum(_quotes(a)) + own[0]) % 2
        step = _OPEN[a].astype(int) - _CLOSE[a]
        own[1] += int(step[odd == 0].sum())
        own[2] += int(step[odd == 1].sum())
        own[0] = int(odd[-1])
    rows = [(*k, *v) for k, v in sums.items()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["path", "start", "odd", "outside", "inside"])


class Walker:
    """Goes through the text of a range part by part. keys: the path; matched: how many of them are open."""

    def __init__(self, keys: tuple[str, ...], in_string: int, depth: int, matched: int):
        self.keys, self.in_string, self.depth, self.matched = keys, in_string, depth, matched

    def marks(self, text: bytes) -> Iterator[tuple[int, str]]:
        """(place, mark) of what concerns the path: `open` and `close` of its container, `comma` between its records. Keeps the state."""
        a = np.frombuffer(text, np.uint8)
        out = _outside(a, self.in_string)
        up, down = (_OPEN[a] > 0) & out, (_CLOSE[a] > 0) & out
        deep = self.depth + np.cumsum(up.astype(np.int64) - down)
        level = len(self.keys) + 1
        some = np.flatnonzero((up & (deep <= level)) | (down & (deep < level)) | ((a == COMMA) & out & (deep == level)))
        for at in some.tolist():
            d = int(deep[at])
            if up[at]:
                if self.matched == d - 2 and d >= 2 and self._key(text, at) == self.keys[d - 2]:
                    self.matched = d - 1
                if d == level and self.matched == level - 1:
                    yield at, "open"
            elif down[at]:
                if d == level - 1 and self.matched == level - 1:
                    yield at, "close"
                self.matched = max(0, min(self.matched, d - 1))
            elif self.matched == level - 1:
                yield at, "comma"
        self.in_string = int(not out[-1])
        self.depth = int(deep[-1])

    @staticmethod
    def _key(text: bytes, at: int) -> str | None:
        """The key before a bracket, None in arrays."""
        before = text[max(0, text.rfind(b",", 0, at) - 4096) : at].rstrip()
        if not before.endswith(b":"):
            return None
        end = before[:-1].rstrip()
        k = len(end) - 1
        while k > 0:
            k = end.rfind(b'"', 0, k)
            slashes = len(end[:k]) - len(end[:k].rstrip(b"\\"))
            if slashes % 2 == 0:
                break
        try:
            return json.loads(end[max(k, 0) :].decode("utf-8", "replace"))
        except ValueError:
            return None


def _matching(keys: tuple[str, ...]):
    """(path, start, matched): how much of the path is open behind a range, by how much was before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks: dict[tuple, list[Walker]] = {}
        for place, s, text in _ranges(batches):
            for w in walks.setdefault(place, [Walker(keys, s["in_string"], s["depth"], j) for j in range(len(keys) + 1)]):
                for _ in w.marks(text):
                    pass
        rows = [(*k, [w.matched for w in v]) for k, v in walks.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, (pa.string(), pa.int64(), pa.list_(pa.int32())), strict=True)], ["path", "start", "matched"])

    return run


def member(text: bytes) -> tuple[str | None, bytes]:
    """(key, value) of a member of an object; the key is null for one of an array."""
    text = text.strip()
    m = STRING.match(text)
    if m and text[m.end() : m.end() + 1] == b":":
        return json.loads(m[0].decode("utf-8", "replace"), strict=False), text[m.end() + 1 :].strip()
    return None, text


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, text) to (at, key, value)."""
    for b in batches:
        found = [member(x) for x in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("at"), pa.array([k for k, _ in found], pa.string()), pa.array([v for _, v in found], pa.binary())], ["at", "key", "value"])


def _records(keys: tuple[str, ...]):
    """(path, start, nth, part, text) of the records in each range; part: whole, or head, middle and tail of one that spans ranges."""
    level = len(keys) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["path", "start", "nth", "part", "text"], [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        place, walk, held, part, nth, rows = None, None, [], "", 0, []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names)
            rows.clear()
            return out

        def over() -> None:
            """What is open where a range ends goes on in the next one; the last comma stands between them."""
            if place is not None and part:
                text = b"".join(held)
                if part == "whole" and not text.strip():
                    return
                rows.append((*place, nth, "tail" if part == "whole" else "middle", text))

        for at_place, s, text in _ranges(batches):
            if at_place != place:
                over()
                place, nth, held = at_place, 0, []
                walk = Walker(keys, s["in_string"], s["depth"], s["matched"])
                inside = s["matched"] == len(keys) and s["depth"] >= level
                part = ("whole" if s["depth"] == level and not s["in_string"] else "head") if inside else ""
            at = 0
            for k, mark in walk.marks(text):
                if mark == "open":
                    held, part = [], "whole"
                else:
                    held.append(text[at:k])
                    one = b"".join(held)
                    if part == "head" or one.strip():
                        rows.append((*place, nth, part, one))
                        nth += 1
                    held, part = [], "whole" if mark == "comma" else ""
                at = k + 1
            if part:
                held.append(text[at:])
            if len(rows) >= 1000:
                yield batch()
        over()
        yield batch()

    return run


def _kept(df: DataFrame) -> DataFrame:
    """A small table, written and read again."""
    path = scratch(df.sparkSession, "json-ranges")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _with_state(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows in their order, each with the state of its range."""
    if state.limit(MOST_RANGES + 1).count() <= MOST_RANGES:
        return rows.join(F.broadcast(state), ["path", "start"])
    met = rows.withColumn("_at", F.monotonically_increasing_id()).join(state.hint("merge"), ["path", "start"])
    return met.repartition("path", "start").sortWithinPartitions("path", "start", "_at").drop("_at")


def records(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """(at, key, value) of each member of the object or array at `keys`: its place, its key (null in arrays), and its value as JSON text."""
    empty = spark.createDataFrame([], "at struct<path:string,start:bigint,nth:bigint>, key string, value string")
    if not listed(spark, path):
        return empty
    raw = spark.read.option("lineSep", ",").text(path)
    rows = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))
    before = W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    counts = rows.mapInArrow(_counted, "path string, start long, odd int, outside long, inside long")
    # A task may have several ranges, but has each of them whole.
    state = counts.withColumn("in_string", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    state = state.withColumn("gain", F.when(F.col("in_string") == 0, F.col("outside")).otherwise(F.col("inside")))
    state = _kept(state.select("path", "start", F.col("in_string").cast("int").alias("in_string"), F.coalesce(F.sum("gain").over(before), F.lit(0)).alias("depth")))
    if keys:
        tells = _with_state(rows, state).mapInArrow(_matching(keys), "path string, start long, matched array<int>")
        one = tells.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start", "matched"))).alias("r"))
        # Of each range what is open before it: the ranges before it, applied to nothing open.
        open_at = F.aggregate("r", F.array(F.lit(0)), lambda done, x: F.concat(done, F.array(F.get(x["matched"], F.element_at(done, -1)))))
        opened = one.select("path", F.inline(F.arrays_zip(F.col("r.start").alias("start"), F.slice(open_at, 1, F.size("r")).alias("matched"))))
        state = _kept(state.join(opened, ["path", "start"]))
    else:
        state = state.withColumn("matched", F.lit(0))
    found = _with_state(rows, state).mapInArrow(_records(keys), "path string, start long, nth long, part string, text binary")
    whole = found.filter("part = 'whole'").select(F.struct("path", "start", "nth").alias("at"), "text")
    # Two fragments a range at most: a tail opens a record, and those up to the next tail belong to it.
    number = F.sum(F.when(F.col("part") == "tail", 1).otherwise(0)).over(W.partitionBy("path").orderBy("start", "nth").rowsBetween(W.unboundedPreceding, 0))
    parts = found.filter("part <> 'whole'").withColumn("record", number).filter("record > 0")
    joined = parts.groupBy("path", "record").agg(F.sort_array(F.collect_list(F.struct("start", "nth", "text"))).alias("p"))
    text = F.aggregate("p", F.lit(b""), lambda done, x: F.concat(done, x["text"]))
    spanning = joined.select(F.struct("path", F.col("p")[0]["start"].alias("start"), F.col("p")[0]["nth"].alias("nth")).alias("at"), text.alias("text"))
    every = whole.unionByName(spanning).mapInArrow(_members, "at struct<path:string,start:bigint,nth:bigint>, key string, value binary")
    return every.withColumn("value", F.col("value").cast("string"))

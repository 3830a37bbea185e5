"""Exact deduplication over a log-structured merge index.

Digests of the normalised texts go through memtables of bounded size. A full
memtable is flushed as a run, sorted by digest, with a Bloom filter. Compaction
deals the runs by ranges of the digest, merges them as sorted streams and keeps
the smallest identifier of each digest; each segment of the merged run has a
filter of the digests that it holds more than once.

Documents are then looked up in the index: the segment whose range holds the
digest is found by halves, and its filter asked. A document that the filter
doesn't know is alone, and goes no further. The hits alone are joined with the
index, and the texts of hits alone are compared byte by byte; texts that only
share a digest are told apart by the texts themselves. The filters together are
bounded: where they would be larger they are folded by halves, which lets more
rows through to the join and misses none.

Defined cases: a null or empty text is the empty text; a very long text is
normalised, hashed and compared whole; rows with a null doc_id come after all
others, also after the greatest doc_id; of rows that agree in doc_id and text
exactly one stays, any of them; an empty table gives no rows; extra columns,
whatever their names, pass through `keep`.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.llm import common

#: Entries of a memtable and of a batch of merged ones, and repeated digests of a segment.
MEMTABLE, SEGMENT = 65_536, 1 << 17
#: Bits an entry, at least, and probes of a Bloom filter.
BLOOM_BITS, BLOOM_PROBES = 10, 7
#: Bytes of all segments' filters together, about, and of a folded one at least.
FILTER_BYTES, LEAST_BYTES = 32 << 20, 8
RUN = "digest binary, first_id long, first_uid long, n long, run string, filter binary"
MERGED = "digest binary, first_id long, first_uid long, n long, low binary, filter binary"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), common.SPACE_RUN, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _probes(digests: list[bytes], bits: int) -> np.ndarray:
    """Bit positions, a row for each digest; digests shorter than 16 bytes are padded. bits is a power of two, so that a filter can be folded."""
    two = np.frombuffer(b"".join(d[:16].ljust(16, b"\0") for d in digests), "<u8").reshape(-1, 2)
    return (two[:, :1] + np.arange(1, BLOOM_PROBES + 1, dtype="u8") * (two[:, 1:] | np.uint64(1))) & np.uint64(bits - 1)


def bloom(digests: list[bytes]) -> bytes:
    size = 1 << max(6, (BLOOM_BITS * len(digests) - 1).bit_length())
    bits = np.zeros(size, bool)
    if digests:
        bits[_probes(digests, size).ravel()] = True
    return np.packbits(bits).tobytes()


def folded(held: bytes, times: int) -> bytes:
    """A filter of half the size, and so on: nothing that it holds gets lost."""
    bits = np.frombuffer(held, np.uint8)
    while times and len(bits) > LEAST_BYTES:
        bits, times = bits[: len(bits) // 2] | bits[len(bits) // 2 :], times - 1
    return bits.tobytes()


def may_hold(held: bytes, digests: list[bytes]) -> np.ndarray:
    if not digests:
        return np.zeros(0, bool)
    bits = np.frombuffer(held, np.uint8)
    at = _probes(digests, 8 * len(bits)).astype(np.int64)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(axis=1)


def _order(i: int | None, u: int) -> tuple:
    return (i is None, i or 0, u)


def _flushes(memtable: int) -> Callable:
    def flush(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seq, table = TaskContext.get().partitionId(), 0, {}

        def out() -> pa.RecordBatch:
            digests = sorted(table)
            i, u, n = zip(*(table[d] for d in digests), strict=True)
            held = [bloom(digests), *[None] * (len(digests) - 1)]
            columns = [pa.array(digests, pa.binary()), *(pa.array(c, pa.int64()) for c in (i, u, n)), pa.array([f"{task}-{seq}"] * len(digests)), pa.array(held, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["digest", "first_id", "first_uid", "n", "run", "filter"])

        for b in batches:
            for d, i, u in zip(*(b.column(k).to_pylist() for k in ("digest", "id", "uid")), strict=True):
                old = table.get(d)
                if old is None:
                    table[d] = (i, u, 1)
                else:
                    table[d] = (*min((i, u), old[:2], key=lambda x: _order(*x)), old[2] + 1)
                if len(table) >= memtable:
                    yield out()
                    table.clear()
                    seq += 1
        if table:
            yield out()

    return flush


def _merges(most: int) -> Callable:
    """Entries sorted by digest, the smallest identifier of each first, to one entry a digest. The last one of a segment holds its filter and its least digest."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, repeated, low, last = [], [], None, None

        def out(end: bool) -> pa.RecordBatch:
            nonlocal rows, repeated, low
            cols = list(zip(*rows, strict=True))
            none = [None] * (len(rows) - 1)
            lows, held = ([*none, low], [*none, bloom(repeated)]) if end else ([*none, None], [*none, None])
            if end:
                repeated, low = [], None
            rows = []
            columns = [pa.array(cols[0], pa.binary()), *(pa.array(c, pa.int64()) for c in cols[1:]), pa.array(lows, pa.binary()), pa.array(held, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["digest", "first_id", "first_uid", "n", "low", "filter"])

        def add(row: tuple) -> None:
            nonlocal low
            rows.append(row)
            low = row[0] if low is None else low
            if row[3] > 1:
                repeated.append(row[0])

        for b in batches:
            for d, i, u, n in zip(*(b.column(k).to_pylist() for k in ("digest", "first_id", "first_uid", "n")), strict=True):
                if last and last[0] == d:
                    last = (*last[:3], last[3] + n)
                    continue
                if last:
                    add(last)
                    if len(rows) >= MEMTABLE or len(repeated) >= most:
                        yield out(len(repeated) >= most)
                last = (d, i, u, n)
        if last:
            add(last)
            yield out(True)

    return merge


def flush(rows: DataFrame, memtable: int = MEMTABLE) -> DataFrame:
    """Sorted runs of (digest, id, uid), written; the first row of each run holds its filter."""
    return common.written(rows.select("digest", "id", "uid").mapInArrow(_flushes(memtable), RUN), "lsm-runs")


def compact(runs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One run: the smallest (id, uid) and the number of rows of each digest, sorted by digest within ranges of its first two bytes."""
    parts = min(1 << 16, int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    first = F.conv(F.rpad(F.hex(F.substring("digest", 1, 2)), 4, "0"), 16, 10).cast("long")
    rows = runs.select("digest", "first_id", "first_uid", "n").repartitionById(parts, F.shiftright(first * parts, 16).cast("int"))
    return common.written(rows.sortWithinPartitions("digest", F.col("first_id").asc_nulls_last(), "first_uid").mapInArrow(_merges(segment), MERGED), "lsm-merged")


def absorb(index: DataFrame, rows: DataFrame, memtable: int = MEMTABLE) -> DataFrame:
    """The index with a later batch of (digest, id, uid) in it: new runs, merged with what is there."""
    same = ("digest", "first_id", "first_uid", "n")
    return compact(index.select(*same).unionByName(flush(rows, memtable).select(*same)))


def lookup(index: DataFrame, most: int = FILTER_BYTES) -> Callable[[Column], Column]:
    """Whether the index may hold a digest more than once: its segment's filter is asked. `most` bounds the filters, which are broadcast."""
    held = index.filter("filter is not null").select("low", "filter")
    total = held.agg(F.sum(F.length("filter")).alias("b")).first()["b"] or 0
    times = max(0, (-(-total // most) - 1).bit_length())

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([folded(x, times) for x in b.column(1).to_pylist()], pa.binary())], ["low", "filter"])

    segments = sorted((bytes(r["low"]), bytes(r["filter"])) for r in held.mapInArrow(fold, "low binary, filter binary").collect())
    told = index.sparkSession.sparkContext.broadcast(segments)

    @F.pandas_udf("boolean")
    def hit(digests: pd.Series) -> pd.Series:
        own, filters = [bytes(d) for d in digests], told.value
        lows = [low for low, _ in filters]
        segment = np.array([bisect_right(lows, d) - 1 for d in own], int)
        out = np.zeros(len(own), bool)
        for s in np.unique(segment[segment >= 0]):
            at = np.flatnonzero(segment == s)
            out[at] = may_hold(filters[s][1], [own[k] for k in at])
        return pd.Series(out)

    return hit


def _with_digest(docs: DataFrame, text: str, doc_id: str, digest: Callable[[Column], Column]) -> DataFrame:
    norm = normalised(F.col(text))
    return docs.select(F.col(doc_id).cast("long").alias("id"), norm.alias("norm")).withColumn("digest", digest(F.col("norm")))


def _indexed(docs: DataFrame, text: str, doc_id: str, digest: Callable[[Column], Column], memtable: int, most: int) -> tuple[DataFrame, DataFrame, Callable[[Column], Column], DataFrame]:
    """(rows, repeated, hit, collided): a row of digests for each document, the entries of digests with several rows, `lookup`, and the digests that more than one text has."""
    common.tune(docs.sparkSession)
    found = _with_digest(docs, text, doc_id, digest)
    rows = common.written(found.select("id", "digest", F.sha2("norm", 256).alias("text_sha256"), F.monotonically_increasing_id().alias("uid")), "lsm-rows")
    runs = flush(rows, memtable)
    index = compact(runs)
    common.dropped(runs)
    hit = lookup(index, most)
    # Every member of a group equals the others byte by byte if and only if the least text is the greatest.
    same = found.filter(hit(F.col("digest"))).groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("most"))
    return rows, index.filter("n > 1").select("digest", "first_id", "first_uid", "n"), hit, common.written(same.filter("least <> most").select("digest"), "lsm-collided")


def _first() -> Column:
    return F.struct(F.col("id").isNull().alias("absent"), "id", "uid")


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", digest: Callable[[Column], Column] = sha256, memtable: int = MEMTABLE, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows, repeated, hit, collided = _indexed(docs, text, doc_id, digest, memtable, filter_bytes)
    asked = rows.withColumn("hit", hit(F.col("digest")))
    hits = common.written(asked.filter("hit").drop("hit"), "lsm-hits")
    alone = asked.filter("not hit").select(F.col("id").alias("doc_id"), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    none = collided.isEmpty()
    plain, entries = (hits, repeated) if none else (x.join(collided, "digest", "left_anti") for x in (hits, repeated))
    met = common.join_hot(plain, entries, "digest", "n", "uid")
    there = F.col("n").isNotNull()
    out = alone.unionByName(met.select(
        F.col("id").alias("doc_id"), F.when(there, F.col("first_id")).otherwise(F.col("id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.when(there, F.col("uid") == F.col("first_uid")).otherwise(True).alias("kept"), "text_sha256",
    ))
    if none:
        return out
    odd = common.written(_with_digest(docs, text, doc_id, digest).join(collided, "digest").withColumn("uid", F.monotonically_increasing_id()), "lsm-odd")
    told = odd.groupBy("norm").agg(F.min(_first()).alias("first"), F.count("*").alias("n"))
    met = common.join_hot(odd, common.written(told, "lsm-told"), "norm", "n", "uid")
    return out.unionByName(met.select(F.col("id").alias("doc_id"), F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("uid") == F.col("first.uid")).alias("kept"), F.sha2("norm", 256).alias("text_sha256")))


def keep(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", digest: Callable[[Column], Column] = sha256, memtable: int = MEMTABLE, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """The documents that stay, with all their columns. Only hits are written and joined; all others pass as they are."""
    rows, repeated, hit, collided = _indexed(docs, text, doc_id, digest, memtable, filter_bytes)
    common.dropped(rows)
    asked = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.col(doc_id).cast("long").alias("id"), normalised(F.col(text)).alias("norm"))
    asked = asked.withColumn("digest", digest(F.col("norm"))).withColumn("hit", hit(F.col("digest")))
    hits = common.written(asked.filter("hit").select("doc", "id", "digest", F.monotonically_increasing_id().alias("uid")), "lsm-hits")
    # Of a group stays the row of the index's smallest identifier; rows that agree in that are told apart by their number.
    met = common.join_hot(hits.select("id", "digest", "uid"), repeated, "digest", "n", "uid").filter(F.col("n").isNull() | F.col("first_id").eqNullSafe(F.col("id")))
    stay = met.groupBy("digest").agg(F.min("uid").alias("uid"))
    if not collided.isEmpty():
        odd = hits.join(collided, "digest", "left_semi").withColumn("norm", normalised(F.col(f"doc.`{text}`")))
        stay = stay.join(collided, "digest", "left_anti").select("uid").unionByName(odd.groupBy("norm").agg(F.min(_first())["uid"].alias("uid")).select("uid"))
    few, _ = common.bounded(common.written(stay.select("uid"), "lsm-stay"))
    return asked.filter("not hit").select("doc.*").unionByName(hits.join(few, "uid", "left_semi").select("doc.*"))

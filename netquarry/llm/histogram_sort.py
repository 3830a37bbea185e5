"""Sharding by histogram sort, by DataFrame functions alone.

Rows are ordered by a key of several whole numbers. Exact bytes below candidate
boundaries are counted over all partitions at once; around each target new ones
are put within the cell that holds it, until the bytes below a boundary are within
tolerance or the boundary can't be refined. Cells are ranges of equal leading
bits, so that a round is one join with the table of the cells that are still
looked into, and one sum. Only then are rows exchanged, once, with all their
columns, and written as a Parquet table with a folder for each shard.

The key is the hash of the text, then that of doc_id, then a row number: equal
texts stand together, and a boundary falls inside a group of them only where the
group is too large to stay whole within tolerance.

Defined cases: a null text counts as empty, a row's size is its UTF-8 bytes plus
one; a very long text is a row like any other, and its shard is larger by what
it has beyond a boundary; null or repeated doc_ids and repeated rows are placed
by their row number, in any order; with fewer rows than shards some shards are
empty; an empty table gives no rows; extra columns are left alone.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.llm import common

#: Leading bits that a round adds at most, and cells that the driver gets of a round, about, however many targets there are.
BITS, MOST_CELLS = 8, 1 << 20
#: Flips the order of signed numbers to that of their bits.
SIGN, MASK = 1 << 63, (1 << 64) - 1
#: Error of a shard's boundary and of a part's within a shard, as shares of their sizes.
TOLERANCE, PART_TOLERANCE = 0.0005, 0.2
#: Hashes are 62 bits long, so that differences of them are exact.
TOP = 1 << 62
#: Parts of all shards together at most; a part is what one task sorts, and may spill.
PARTS = 1 << 14


@dataclass
class _Search:
    """Where a target is looked for: values fixed so far, the leading bits of the next one, bytes below what begins with them."""

    target: int
    slack: int
    fixed: tuple = ()
    lead: int = 0
    below: int = 0
    cut: tuple | None = field(default=None)


def _bits(x: int) -> int:
    return (x ^ SIGN) & MASK


def _leading(column: Column, bits: int) -> Column:
    """What is left of a number's bits without the last ones, the sign bit flipped; 64 bits give 0."""
    return F.shiftrightunsigned(column.bitwiseXOR(F.lit(-SIGN)), bits) if bits < 64 else F.lit(0).cast("long")


def splitters(rows: DataFrame, levels: list[tuple[str, int, int]], size: str, targets: list[tuple[int, int]]) -> list[tuple]:
    """For each (bytes, slack) a key: about `bytes` bytes have lesser keys. levels: (column, least value, greatest value + 1) of the parts of the key, whole numbers. rows should be written already."""
    spark = rows.sparkSession
    searches = [_Search(t, s) for t, s in targets]
    for level, (name, low, high) in enumerate(levels):
        open_ = [s for s in searches if s.cut is None]
        last, left = level + 1 == len(levels), (_bits(low) ^ _bits(high - 1)).bit_length()  # bits that the values differ in
        for s in open_:
            s.lead = _bits(low) >> left
            if not left and not last:
                s.fixed = (*s.fixed, low)
        while open_ and (left or last):
            nodes = sorted({(*s.fixed, s.lead) for s in open_})
            step = min(left, BITS, max(1, (MOST_CELLS // len(nodes)).bit_length() - 1))
            keys = [f"_k{k}" for k in range(level + 1)]
            own = [F.col(levels[k][0]).alias(keys[k]) for k in range(level)] + [_leading(F.col(name), left).alias(keys[level])]
            keyed = rows.select(*own, _leading(F.col(name), left - step).alias("_cell"), F.col(size).alias("_size"))
            if len(nodes) > 1 or level:
                # long keys: leading bits of 64-bit numbers are unsigned
                table = spark.createDataFrame([tuple(x - (1 << 64) if x >= SIGN else x for x in n) for n in nodes], ", ".join(f"{k} long" for k in keys))
                if len(nodes) <= common.BROADCAST_ROWS:
                    keyed = keyed.join(F.broadcast(table), keys, "left_semi")
                else:
                    keyed = keyed.groupBy(*keys, "_cell").agg(F.sum("_size").alias("_size"), F.count("*").alias("_rows")).join(table, keys, "left_semi")
            count = F.sum("_rows") if "_rows" in keyed.columns else F.count("*")
            found: dict[tuple, list] = {}
            for r in keyed.groupBy(*keys, "_cell").agg(F.sum("_size").alias("bytes"), count.alias("rows")).collect():
                found.setdefault((*r[:level], r[level] & MASK), []).append((r["_cell"] & MASK, r["bytes"], r["rows"]))
            left -= step
            for cells in found.values():
                cells.sort()
            for s in open_:
                _refine(s, found.get((*s.fixed, s.lead), []), left, last)
            open_ = [s for s in open_ if s.cut is None and len(s.fixed) == level]
    return [s.cut for s in searches]


def _refine(s: _Search, cells: list[tuple[int, int, int]], left: int, last: bool) -> None:
    """Go into the cell that holds the target; cells are known but for the last `left` bits. Once a value is whole it is fixed, if there are further ones."""
    value = lambda lead: ((lead << left) ^ SIGN) - (1 << 64 if (lead << left) ^ SIGN >= SIGN else 0)
    below = s.below
    for cell, size, n in cells:
        if s.target >= below + size:
            below += size
            continue
        before, after = s.target - below, below + size - s.target
        if min(before, after) <= s.slack or n == 1 or (not left and last):
            s.cut = (*s.fixed, value(cell) if before <= after else value(cell) + (1 << left))
        elif left:
            s.lead, s.below = cell, below
        else:
            s.fixed, s.below = (*s.fixed, value(cell)), below
        return
    s.cut = (*s.fixed, value(cells[-1][0]) + (1 << left)) if cells else (*s.fixed, value(s.lead))  # beyond all rows


def _numbers(values: list[int]) -> Column:
    return F.expr("array(" + ", ".join(f"{v}L" if v > -SIGN else f"-{SIGN - 1}L - 1L" for v in values) + ")")


def part_of(levels: list[tuple[str, int, int]], cuts: list[tuple]) -> Column:
    """How many cuts, sorted, a key reaches, by halves; a cut that fixes fewer values than the key stands before all keys that begin with it."""
    if not cuts:
        return F.lit(0)
    least = [low for _, low, _ in levels]
    full = sorted((*c, *least[len(c) :]) for c in cuts)
    # values go up to 2^63 only where a cut is beyond all rows
    sides = [_numbers([min(c[k], SIGN - 1) for c in full]) for k in range(len(levels))]
    key = F.struct(*[F.col(n).alias(f"k{k}") for k, (n, _, _) in enumerate(levels)])
    steps = [1 << k for k in reversed(range(len(full).bit_length()))]

    def half(at: Column, step: Column) -> Column:
        cut = F.struct(*[F.get(side, at + step - 1).alias(f"k{k}") for k, side in enumerate(sides)])
        return F.when((at + step <= len(full)) & (cut <= key), at + step).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), half)


def shards(docs: DataFrame, n: int = 8, text: str = "text", doc_id: str = "doc_id", tolerance: float = TOLERANCE, parts: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row, from the written shards."""
    rows, shard, slot = sharded(docs, n, text, doc_id, tolerance, parts)
    t = F.coalesce(F.col(text), F.lit(""))
    return rows.select(F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.col(shard).alias("shard"), F.col(slot).alias("slot"))


def sharded(docs: DataFrame, n: int = 8, text: str = "text", doc_id: str = "doc_id", tolerance: float = TOLERANCE, parts: int | None = None, path: str | None = None) -> tuple[DataFrame, str, str]:
    """The rows with all columns, read from the shards, and the names of their columns of shard and slot (with underscores if docs has such).

    Shards are nearly equal in bytes, slots count from 0 in each. `path` gets the
    shards, a folder each; without one they are in the shared folder.
    """
    spark = docs.sparkSession
    size, h, i, uid, part, place, shard, slot = (common.free_name(docs, c) for c in ("_size", "_h", "_i", "_uid", "_part", "_place", "shard", "slot"))
    t = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.withColumns({
        size: (F.octet_length(t) + 1).cast("long"), h: F.shiftrightunsigned(F.xxhash64(t), 2), i: F.shiftrightunsigned(F.xxhash64(F.col(doc_id).cast("long")), 2), uid: F.monotonically_increasing_id(),
    })
    light = common.written(keyed.select(size, h, i, uid), "shard-keys")
    levels = [(h, 0, TOP), (i, 0, TOP), (uid, 0, 1 << 63)]
    total = light.agg(F.sum(size).alias("b")).first()["b"] or 0
    each = max(1, min(PARTS, parts or int(spark.conf.get("spark.sql.shuffle.partitions"))) // n)
    wanted = [(total * k // (n * each), int(total / n * (tolerance if k % each == 0 else PART_TOLERANCE / each))) for k in range(1, n * each)]
    found = splitters(light, levels, size, wanted)
    common.dropped(light)
    firsts = [c for k, c in enumerate(found, 1) if k % each == 0]
    # A part's boundary may not pass a shard's.
    cuts = sorted(found, key=lambda c: (*c, *[0] * (3 - len(c))))
    shard_of = [bisect.bisect_right(sorted((*c, *[0] * (3 - len(c))) for c in firsts), (*c, *[0] * (3 - len(c)))) for c in [(0,), *cuts]]
    dealt = keyed.withColumn(part, part_of(levels, cuts)).repartitionById(n * each, F.col(part)).withColumn(shard, F.get(F.array(*[F.lit(x) for x in shard_of]), F.col(part)))
    # sorted by shard first, as the writer would else sort by it again
    dealt = dealt.sortWithinPartitions(shard, part, h, i, uid).select(*docs.columns, part, F.monotonically_increasing_id().alias(place), shard)
    path = path or common.scratch(spark, "shards")
    dealt.write.partitionBy(shard).option("compression", "zstd").option("parquet.block.size", str(common.ROW_GROUP)).parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    starts, before, last = [], 0, 0
    for r in sorted(dealt.groupBy(part).agg(F.min(place).alias("first"), F.count("*").alias("n")).collect(), key=lambda r: r[part]):
        s = shard_of[r[part]]
        before, last = (before if s == last else 0), s
        starts.append((r[part], before - r["first"]))
        before += r["n"]
    shift = common.free_name(docs, "_shift")
    table = F.broadcast(spark.createDataFrame(starts, f"{part} int, {shift} long"))  # a row for each part, PARTS at most
    return dealt.join(table, part).select(*docs.columns, shard, (F.col(place) + F.col(shift)).alias(slot)), shard, slot

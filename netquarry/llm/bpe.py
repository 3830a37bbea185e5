"""Byte-level BPE by a global shuffle of distinct words.

Encoding: documents are gathered into blocks. A block's pre-tokens are exploded
with their positions: each distinct one is written once, and the text becomes a
list of places in that list. The distinct words of all blocks are dealt by their
hash; each word meets there from all blocks and is encoded once. The ids are
joined back to the blocks and the documents reassembled by position.

Decoding joins the ids with the token-byte table, whose size is the vocabulary's.

Word lists travel packed: for each block and share of the hash, one row of
compressed words goes out and one of their ids comes back. A share whose words,
summed over the blocks, are more than a worker should remember is cut by a second
hash into as many ranges as it takes; each range is a key of its own.

Defined cases: a null or empty text has no ids; a very long text is a block of
its own, split, encoded and reassembled whole; rows with equal or null doc_ids
are separate documents; an empty table gives no rows; extra columns are left
alone. Ids outside the vocabulary raise KeyError in decoding.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm import common
from netquarry.llm.pretokens import splitter

#: Bytes of text in a block, about; a longer document is a block of its own.
BLOCK_BYTES = 32 << 20
#: Words of a share, or of a range of it, that a worker remembers at once, about; shares at most.
WORDS, SHARES = 1 << 20, 1 << 16
PACKED = "block long, share int, words binary"
BLOCK = "block long, doc_ids array<long>, ends array<long>, places binary"


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    """The token-byte table of a rank file: base64 of the bytes and the id, a line each."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=2)
def encoder(path: str):
    """Merges one pre-token: the pattern takes whatever it is given as one piece."""
    import tiktoken

    return tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks(path), special_tokens={})


def _pack(words: list[str]) -> bytes:
    """A list of words, compressed: lengths in bytes, then the bytes."""
    raw = [w.encode("utf-8", "replace") for w in words]
    return zstandard.compress(np.array([len(raw), *map(len, raw)], "<u4").tobytes() + b"".join(raw), 9)


def _unpack(packed: bytes) -> list[bytes]:
    raw = zstandard.decompress(packed)
    n = int.from_bytes(raw[:4], "little")
    ends = (np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64) + 4 * (n + 1)).tolist()
    return [raw[a:b] for a, b in zip([4 * (n + 1), *ends], ends, strict=False)]


def _share(word: bytes, shares: int) -> int:
    return zlib.crc32(word) % shares


def _range(word: bytes, ranges: int) -> int:
    return xxhash.xxh3_64_intdigest(word) % ranges


def _blocks(pattern: str, shares: int, block_bytes: int):
    """Rows (doc_id, text) to rows of blocks and packed words, told apart by which columns are null; n is the number of words."""

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        split, task = splitter(pattern), TaskContext.get().partitionId()
        kinds = [("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("places", pa.binary()), ("share", pa.int32()), ("n", pa.int64()), ("words", pa.binary())]
        seq, size, ids, ends, table, places = 0, 0, [], [0], {}, array("i")

        def out() -> pa.RecordBatch:
            # Places follow how often a word occurs, so that the common ones are small numbers.
            own = np.frombuffer(places, np.int32) if places else np.zeros(0, np.int32)
            words = list(table)
            table.clear()
            share = np.fromiter((_share(w.encode("utf-8", "replace"), shares) for w in words), np.int32, len(words))
            often = np.bincount(own, minlength=len(words))
            order = np.argsort(-often, kind="stable")
            to = np.empty(len(words), np.int32)
            to[order] = np.arange(len(words), dtype=np.int32)
            # Words that occur once come last, in the order of the text: of them the place is left out.
            once = int((often > 1).sum())
            name = (task << 32) + seq
            rows = [{"block": name, "doc_ids": ids, "ends": ends[1:], "places": once.to_bytes(4, "little") + _numbers(np.minimum(to, once)[own])}]
            # Words of a share are sent in the order of their places, so that ids need no key to come back.
            by_share = order[np.argsort(share[order], kind="stable")]
            ends_of = np.cumsum(np.bincount(share, minlength=shares)).tolist()
            for s, (lo, hi) in enumerate(zip([0, *ends_of], ends_of, strict=False)):
                if hi > lo:
                    rows.append({"block": name, "share": s, "n": hi - lo, "words": _pack([words[i] for i in by_share[lo:hi]])})
            # and which share each place belongs to
            rows.append({"block": name, "share": -1, "words": zstandard.compress(share[order].astype("<u2").tobytes(), 3)})
            return pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

        for b in batches:
            for i, t in zip(*(b.column(k).to_pylist() for k in (0, 1)), strict=True):
                t = t or ""
                if ids and size + len(t) > block_bytes:
                    yield out()
                    seq, size, ids, ends, table, places = seq + 1, 0, [], [0], {}, array("i")
                get = table.setdefault
                for w in split(t):
                    places.append(get(w, len(table)))
                ids.append(i)
                ends.append(len(places))
                size += len(t)
        if ids:
            yield out()

    return block


def _numbers(x: np.ndarray) -> bytes:
    """Small numbers, compressed: low and high bytes apart, so that each plane compresses by itself."""
    x = x.astype("<u4", copy=False)
    used = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    return zstandard.compress(bytes([used]) + b"".join((x >> np.uint32(8 * k)).astype(np.uint8).tobytes() for k in range(used)), 9)


def _numbered(packed: bytes) -> np.ndarray:
    raw = zstandard.decompress(packed)
    used = raw[0]
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(used, -1)
    out = np.zeros((planes.shape[1], 4), np.uint8)
    out[:, :used] = planes.T
    return out.view("<u4").ravel()


def _with_once(packed: bytes) -> np.ndarray:
    places, once = _numbered(packed[4:]), int.from_bytes(packed[:4], "little")
    left_out = np.flatnonzero(places == once)
    places[left_out] = once + np.arange(len(left_out), dtype=places.dtype)
    return places


def _cut(ranges: dict[int, int]):
    """Rows (block, share, words) cut into ranges of a second hash; `at` has the places of a range's words in its row, null for a share of one range."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ("block", "share", "part", "at", "words"), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        for b in batches:
            out = []
            for name, s, packed in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if (n := ranges.get(s, 1)) == 1:
                    out.append((name, s, 0, None, packed))
                    continue
                words = [w.decode() for w in _unpack(packed)]
                part = np.fromiter((_range(w.encode(), n) for w in words), np.int64, len(words))
                out += [(name, s, int(k), _numbers(at), _pack([words[i] for i in at])) for k in np.unique(part) for at in [np.flatnonzero(part == k)]]
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], list(names))

    return cut


def _encoded(path: str):
    """Packed words of one range of a share, from all blocks, to their ids. Rows come sorted by range, so its words are remembered from its first row to its last."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        vocabulary = ranks(path)
        memo: dict[bytes, list[int]] = {}
        own = None
        for b in batches:
            counted, flats = [], []
            for key, packed in zip(zip(b.column("share").to_pylist(), b.column("part").to_pylist(), strict=True), b.column("words").to_pylist(), strict=True):
                if key != own:
                    memo.clear()
                    own = key
                counts, flat = [], []
                for w in _unpack(packed):
                    ids = memo.get(w)
                    if ids is None:
                        one = vocabulary.get(w)
                        ids = memo[w] = [one] if one is not None else enc.encode_ordinary(w.decode())
                    counts.append(len(ids))
                    flat += ids
                counted.append(_numbers(np.array(counts, "<u4")))
                flats.append(_numbers(np.array(flat, "<u4")))
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("share"), b.column("at"), pa.array(counted, pa.binary()), pa.array(flats, pa.binary())], ["block", "share", "at", "counts", "ids"])

    return encode


def _gather(starts: np.ndarray, counts: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the runs starts[k] .. + counts[k], for each k of `of`, and how long each is."""
    n = counts[of].astype(np.int64)
    return np.repeat(starts[of] - (np.cumsum(n) - n), n) + np.arange(n.sum()), n


def _assembled(give):
    """One block's places with its words' ids, to what `give` makes of (doc_ids, ends of each document in ids, ids)."""

    def assemble(key: tuple[pa.Scalar, ...], blocks: pa.Table, words: pa.Table) -> pa.Table:
        block = blocks.filter(pc.is_valid(blocks["places"])).slice(0, 1).to_pylist()[0]
        shares = np.frombuffer(zstandard.decompress(blocks.filter(pc.equal(blocks["share"], -1))["words"][0].as_py()), "<u2")
        places, ends = _with_once(block["places"]), np.array(block["ends"], np.int64)
        counts, starts, flats, at = np.zeros(len(shares), np.int64), np.zeros(len(shares), np.int64), [], 0
        for row in words.to_pylist():
            mine = np.flatnonzero(shares == row["share"])
            mine = mine if row["at"] is None else mine[_numbered(row["at"])]
            n, ids = _numbered(row["counts"]).astype(np.int64), _numbered(row["ids"])
            counts[mine], starts[mine] = n, at + np.cumsum(n) - n
            flats.append(ids)
            at += len(ids)
        flat = np.concatenate(flats) if flats else np.zeros(0, np.uint32)
        outs, first = [], 0
        while first < len(ends):  # some documents at a time, to bound the memory
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + (1 << 20), "right")))
            low = ends[first - 1] if first else 0
            where, n = _gather(starts, counts, places[low : ends[last - 1]])
            cum = np.concatenate([[0], np.cumsum(n)])
            outs.append(give(block["doc_ids"][first:last], cum[ends[first:last] - low], flat[where]))
            first = last
        return pa.concat_tables(outs)

    return assemble


def _lists(doc_ids: list, ends: np.ndarray, ids: np.ndarray) -> pa.Table:
    return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32), pa.int32()))})


class TokenBytes:
    """The token-byte table, to join ids with."""

    def __init__(self, path: str):
        table = sorted((i, b) for b, i in ranks(path).items())
        self.size = 1 + table[-1][0]
        self.counts = np.zeros(self.size, np.int64)
        self.counts[[i for i, _ in table]] = [len(b) for _, b in table]
        self.starts = np.cumsum(self.counts) - self.counts
        self.flat = np.frombuffer(b"".join(b for _, b in table), np.uint8)

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of the ids, and where each id's bytes end."""
        if len(ids) and (ids.max() >= self.size or not self.counts[ids].all()):
            raise KeyError("an id without bytes")
        where, n = _gather(self.starts, self.counts, ids)
        return self.flat[where].tobytes(), np.cumsum(n)


def digests(path: str):
    """give: number of ids, sha256 of the ids and of the decoded bytes."""

    def give(doc_ids: list, ends: np.ndarray, ids: np.ndarray) -> pa.Table:
        table = _table(path)
        raw, byte_ends = table.decode(ids)
        text = ids.astype(str).tolist() if len(ids) else []
        starts, out = np.concatenate([[0], ends[:-1]]), []
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            low, high = (int(byte_ends[a - 1]) if a else 0), (int(byte_ends[b - 1]) if b else 0)
            out.append((b - a, hashlib.sha256(",".join(text[a:b]).encode()).hexdigest(), hashlib.sha256(raw[low:high]).hexdigest()))
        n, x, y = zip(*out, strict=True)
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(x, pa.string()), "decoded_sha256": pa.array(y, pa.string())})

    return give


@lru_cache(maxsize=2)
def _table(path: str) -> TokenBytes:
    return TokenBytes(path)


def _run(docs: DataFrame, path: str, pattern: str, give, schema: str, text: str, doc_id: str, block_bytes: int, shares: int | None, words: int = WORDS) -> DataFrame:
    spark = common.tune(docs.sparkSession)
    shares = shares or min(SHARES, max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    blocks = common.written(rows.mapInArrow(_blocks(pattern, shares, block_bytes), f"{BLOCK}, share int, n long, words binary"), "bpe-blocks")
    sent = blocks.filter("share >= 0")
    sizes = sent.groupBy("share").agg(F.sum("n").alias("n")).filter(F.col("n") > words).collect()  # a row for each share, SHARES at most
    cut = sent.select("block", "share", "words").mapInArrow(_cut({r["share"]: -(-r["n"] // words) for r in sizes}), "block long, share int, part int, at binary, words binary")
    ids = cut.repartition("share", "part").sortWithinPartitions("share", "part").mapInArrow(_encoded(path), "block long, share int, at binary, counts binary, ids binary")
    own = blocks.filter("share is null or share = -1").drop("n")
    return common.fresh(own).groupBy("block").cogroup(common.fresh(ids).groupBy("block")).applyInArrow(_assembled(give), schema)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id", block_bytes: int = BLOCK_BYTES, shares: int | None = None) -> DataFrame:
    """doc_id and ids of each document."""
    return _run(docs, path, pattern, _lists, "doc_id long, ids array<int>", text, doc_id, block_bytes, shares)


def encode_digests(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id", block_bytes: int = BLOCK_BYTES, shares: int | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document: encoded, then decoded."""
    return _run(docs, path, pattern, digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", text, doc_id, block_bytes, shares)


def decode(tokens: DataFrame, path: str, ids: str = "ids", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and decoded bytes of each row of ids."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(path)
        for b in batches:
            raw = [table.decode(np.array(x or [], np.int64))[0] for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["doc_id", "decoded"])

    common.tune(tokens.sparkSession)
    return tokens.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(join, "doc_id long, decoded binary")

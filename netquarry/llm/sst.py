"""Token ids in sorted-string-table shards.

A shard file holds documents in the order of their keys:

    block, block, ... | index | filter | footer

Keys are 17 bytes: 0, or 1 for null doc_ids, then doc_id with its sign bit flipped
and a tie number, both big-endian, so that bytes sort as numbers and nulls come
last. A block is compressed and holds
entries (bytes shared with the key before, length of the rest, length of the
value, rest, value), numbers as varints; its first entry shares nothing. Values
are ids as little-endian numbers of two bytes, or four where an id of the
vocabulary or the end id is over 65,535. The index has each block's first key, place, length and number of
entries and ids; the filter is a Bloom filter of the doc_ids. The footer has a
fixed length and says where index and filter are. A lookup reads the footer, asks
the filter, searches the index by halves and reads one block.

Rows are dealt by exact splitters of (doc_id, hash of the text, salt), so that a
doc_id with many rows spreads over shards. There are as many parts as hold
SHARD_BYTES of text each, MOST_PARTS at most; a task writes the files of its part
one after the other, each up to SHARD_BYTES of ids, under names of their own; only files in the manifest that Spark has kept count, so tasks that
are run again do no harm.

Encoding is the library's. Texts that hold the string of one of its added tokens
are given to it whole; of others, each distinct pre-token, as these can't touch.

Defined cases: a null or empty text holds the end id alone; a very long text is
one value, in a block of its own; null doc_ids come after all others; rows with
one doc_id are ordered by the hash of their text, those that agree in that too in
any order; an empty table gives no file; extra columns are left alone.
"""

from __future__ import annotations

import bisect
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from io import BytesIO

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from netquarry.llm import common, histogram_sort
from netquarry.llm.pretokens import splitter

#: Bytes of entries in a block before compression, about, and of text in a shard.
BLOCK_BYTES, SHARD_BYTES = 256 << 10, 48 << 20
#: Parts that rows are dealt to, each sorted and written by one task.
MOST_PARTS = 1 << 14
BLOOM_BITS, BLOOM_PROBES = 10, 7
#: Pre-tokens whose ids a worker remembers.
MEMO = 1_200_000
#: The file's mark and its footer (index place, index length, filter place, filter length, documents, ids, bytes of an id, mark).
MARK = b"SSTIDS02"
FOOTER = struct.Struct("<6QI8s")
KEY = struct.Struct(">BQQ")
ENTRY = struct.Struct("<4Q")
SALTS = 1024


def key_of(doc_id: int | None, tie: int) -> bytes:
    return KEY.pack(doc_id is None, (doc_id or 0) + (1 << 63), tie)


def doc_of(key: bytes) -> tuple[int | None, int]:
    absent, a, tie = KEY.unpack(key)
    return None if absent else a - (1 << 63), tie


def _varint(out: bytearray, n: int) -> None:
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def _read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bits(doc_ids: list[int | None], size: int) -> np.ndarray:
    h = np.array([xxhash.xxh3_128_intdigest(b"null" if i is None else struct.pack("<q", i)) for i in doc_ids], object)
    low, high = (h & ((1 << 64) - 1)).astype("u8"), (h >> 64).astype("u8") | np.uint64(1)
    return (low[:, None] + np.arange(BLOOM_PROBES, dtype="u8") * high[:, None]) % np.uint64(size)


class Writer:
    """A shard file; documents must come in the order of their keys."""

    def __init__(self, sink, width: int, block_bytes: int = BLOCK_BYTES):
        self.sink, self.width, self.most = sink, width, block_bytes
        self.at = self.docs = self.ids = 0
        self.index: list[tuple] = []
        self.doc_ids: list[int | None] = []
        self.last_key = None
        self._fresh()

    def _fresh(self) -> None:
        self.block, self.first, self.before, self.n, self.n_ids = bytearray(), None, b"", 0, 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.last_key is not None and key < self.last_key:
            raise ValueError("keys out of order")
        value = ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        shared = 0
        while shared < len(self.before) and self.before[shared] == key[shared]:
            shared += 1
        for n in (shared, len(key) - shared, len(value)):
            _varint(self.block, n)
        self.block += key[shared:] + value
        self.first = self.first or key
        self.before = self.last_key = key
        self.n, self.n_ids, self.ids, self.docs = self.n + 1, self.n_ids + len(ids), self.ids + len(ids), self.docs + 1
        self.doc_ids.append(doc_of(key)[0])
        if len(self.block) >= self.most:
            self._flush()

    def _flush(self) -> None:
        if not self.n:
            return
        raw = zstandard.compress(bytes(self.block), 3)
        self.sink.write(raw)
        self.index.append((self.first, self.at, len(raw), self.n, self.n_ids))
        self.at += len(raw)
        self._fresh()

    def close(self) -> None:
        self._flush()
        index = b"".join(k + ENTRY.pack(*rest) for k, *rest in self.index)
        size = max(64, BLOOM_BITS * len(self.doc_ids))
        bits = np.zeros(size, bool)
        if self.doc_ids:
            bits[_bits(self.doc_ids, size).ravel()] = True
        held = struct.pack("<Q", size) + np.packbits(bits).tobytes()
        footer = FOOTER.pack(self.at, len(index), self.at + len(index), len(held), self.docs, self.ids, self.width, MARK)
        self.sink.write(index + held + footer)


class Reader:
    """A shard file, by a source with read(), seek() and size()."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        a, n, b, m, self.docs, self.ids, self.width, mark = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if mark != MARK:
            raise ValueError("not a shard file")
        raw = self._at(a, n)
        each = KEY.size + ENTRY.size
        self.index = [(raw[k : k + KEY.size], *ENTRY.unpack_from(raw, k + KEY.size)) for k in range(0, n, each)]
        self.keys = [x[0] for x in self.index]
        held = self._at(b, m)
        self.size = struct.unpack("<Q", held[:8])[0]
        self.bits = np.unpackbits(np.frombuffer(held[8:], np.uint8), count=self.size).astype(bool)

    def _at(self, place: int, n: int) -> bytes:
        self.source.seek(place)
        return self.source.read(n)

    def may_hold(self, doc_id: int | None) -> bool:
        return bool(self.bits[_bits([doc_id], self.size)].all())

    def block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, place, n, _, _ = self.index[k]
        raw, at, key = zstandard.decompress(self._at(place, n)), 0, b""
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, np.frombuffer(raw, "<u2" if self.width == 2 else "<u4", size // self.width, at)
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.index)):
            yield from self.block(k)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of each document of this doc_id."""
        if not self.may_hold(doc_id):
            return []
        low, high = key_of(doc_id, 0), key_of(doc_id, (1 << 64) - 1)
        out, k = [], max(0, bisect.bisect_left(self.keys, low) - 1)
        while k < len(self.index) and self.keys[k] <= high:
            out += [ids for key, ids in self.block(k) if low <= key <= high]
            k += 1
        return out


class Encoder:
    """Whole texts to packed ids by the tokenizers library. Where the pre-tokenizer is byte-level, each distinct pre-token of texts without added tokens is given to the library once and remembered."""

    def __init__(self, path: str, pattern: str, end_id: int = 0):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.added = [x["content"] for x in spec.get("added_tokens") or []]
        vocabulary = self.tokenizer.get_vocab()
        self.kind = np.dtype("<u2" if max(end_id, *vocabulary.values()) < 1 << 16 else "<u4")
        self.bytes_of = np.zeros(1 + max(vocabulary.values()), np.int64)  # a byte-level token has a character for each byte
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)
        self.split, self.memo = splitter(pattern), {}

    def _learn(self, words: list[str]) -> None:
        """Ids of new pre-tokens, many in a call; the bytes that tokens stand for tell where each ends."""
        ids = np.array(self.tokenizer.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0].ids, np.int64)
        ends = np.cumsum([len(w.encode("utf-8", "replace")) for w in words])
        at = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1
        if not np.array_equal(np.cumsum(self.bytes_of[ids])[at - 1], ends):
            self.memo.update((w, np.array(e.ids, self.kind).tobytes()) for w, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True))
            return
        raw, cuts = ids.astype(self.kind).tobytes(), [0, *(at * self.kind.itemsize).tolist()]
        self.memo.update(zip(words, (raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)), strict=True))

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.plain:
            return self._whole(texts)
        held = [k for k, x in enumerate(texts) if any(a in x for a in self.added)]
        whole = dict(zip(held, self._whole([texts[k] for k in held]), strict=True)) if held else {}
        if len(self.memo) > MEMO:
            self.memo.clear()
        parts = [[] if k in whole else self.split(x) for k, x in enumerate(texts)]
        memo = self.memo
        new = list(set().union(*parts).difference(memo))
        for k in range(0, len(new), 4096):
            self._learn(new[k : k + 4096])
        of = memo.__getitem__
        return [whole[k] if k in whole else b"".join(map(of, p)) for k, p in enumerate(parts)]


@lru_cache(maxsize=1)
def _encoder(path: str, pattern: str, end_id: int) -> Encoder:
    return Encoder(path, pattern, end_id)


def _encode(path: str, pattern: str, end_id: int, cuts):
    """cuts: a broadcast list of where the parts begin."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _encoder(path, pattern, end_id)
        end = np.array([end_id], of.kind).tobytes()
        for b in batches:
            keys = zip(*(b.column(k).to_pylist() for k in ("absent", "id", "tie", "salt")), strict=True)
            texts = [x or "" for x in b.column("text").to_pylist()]
            at, values = 0, []
            while at < len(texts):  # a few megabytes of text at a time
                to, size = at, 0
                while to < len(texts) and (to == at or size < 4 << 20):
                    size += len(texts[to])
                    to += 1
                values += [x + end for x in of(texts[at:to])]
                at = to
            shard = [bisect.bisect_right(cuts.value, k) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), b.column("absent"), b.column("id"), b.column("tie"), pa.array(values, pa.binary())], ["shard", "absent", "id", "tie", "value"])

    return encode


def _write(folder: str, width: int, shard_bytes: int):
    """Files of one part each, a new one where the last has shard_bytes of ids."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, path = fs.FileSystem.from_uri(folder)
        names = ["part", "nth", "file", "n_docs", "n_ids"]
        out, nth = None, 0
        done: list[tuple] = []

        def close() -> None:
            if out:
                out[1].close()
                out[2].close()
                done.append((out[0], nth, out[3], out[1].docs, out[1].ids))

        for b in batches:
            for s, absent, i, tie, value in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if out is None or out[0] != s or out[1].ids * width >= shard_bytes:
                    close()
                    nth = nth + 1 if out and out[0] == s else 0
                    name = f"{s:06d}-{nth:06d}-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}.sst"
                    sink = files.open_output_stream(f"{path}/{name}")
                    out = (s, Writer(sink, width), sink, name)
                out[1].add(key_of(None if absent else i, tie), np.frombuffer(value, "<u2" if width == 2 else "<u4"))
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else [[]] * 5, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names)

    return write


def open_shard(folder: str, name: str) -> Reader:
    files, path = fs.FileSystem.from_uri(folder)
    return Reader(files.open_input_file(f"{path}/{name}"))


def write_shards(docs: DataFrame, tokenizer: str, pattern: str, end_id: int, folder: str | None = None, text: str = "text", doc_id: str = "doc_id", shard_bytes: int = SHARD_BYTES, most_parts: int = MOST_PARTS) -> tuple[str, DataFrame]:
    """(folder, manifest): a row (shard, file, n_docs, n_ids, start) for each file; shard counts the files in the order of keys, from 0."""
    spark = common.tune(docs.sparkSession)
    folder = folder or common.scratch(spark, "sst")
    files, path = fs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    t = F.coalesce(F.col(text), F.lit(""))
    own = F.col(doc_id).cast("long")
    keys = docs.select(
        own.isNull().cast("int").alias("absent"), F.coalesce(own, F.lit(0)).alias("id"), F.shiftrightunsigned(F.xxhash64(t), 1).alias("tie"),
        F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("salt"), t.alias("text"),
    )
    light = common.written(keys.select("absent", "id", "tie", "salt", (F.octet_length("text") + 32).cast("long").alias("size")), "sst-keys")
    s = light.agg(F.sum("size").alias("size"), F.min("id").alias("low"), F.max("id").alias("high")).first()
    cuts = []
    if s["size"]:
        n = min(most_parts, -(-s["size"] // shard_bytes))
        levels = [("absent", 0, 2), ("id", s["low"], s["high"] + 1), ("tie", 0, 1 << 63), ("salt", 0, SALTS)]
        found = histogram_sort.splitters(light, levels, "size", [(s["size"] * k // n, shard_bytes // 8) for k in range(1, n)])
        cuts = sorted({(*c, *(low for _, low, _ in levels[len(c) :])) for c in found})
    common.dropped(light)
    width = _encoder(tokenizer, pattern, end_id).kind.itemsize
    dealt = keys.mapInArrow(_encode(tokenizer, pattern, end_id, spark.sparkContext.broadcast(cuts)), "shard int, absent int, id long, tie long, value binary")
    dealt = dealt.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", "absent", "id", "tie")
    kept = common.written(dealt.mapInArrow(_write(folder, width, shard_bytes), "part int, nth int, file string, n_docs long, n_ids long"), "sst-files")
    # What stands before a file: that of the parts before its own, MOST_PARTS of them, and of the files before it in its part.
    before = lambda x, w: F.coalesce(F.sum(x).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = kept.groupBy("part").agg(F.count("*").alias("files"), F.sum("n_ids").alias("ids"))
    parts = parts.select("part", before("files", W.orderBy("part")).alias("files_before"), before("ids", W.orderBy("part")).alias("ids_before"))
    start = F.col("ids_before") + before("n_ids", W.partitionBy("part").orderBy("nth"))
    manifest = kept.join(F.broadcast(parts), "part").select((F.col("files_before") + F.col("nth")).alias("shard"), "file", "n_docs", "n_ids", start.alias("start"))
    return folder, common.written(manifest, "sst-manifest")


def _lookup(folder: str):
    def lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                for key, ids in open_shard(folder, name):
                    rows.append((doc_of(key)[0], start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) >= 10_000:
                        yield _rows(rows)
                        rows = []
                yield _rows(rows)

    return lookup


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 4)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_back(folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""
    n = min(MOST_PARTS, max(1, manifest.count()))
    return manifest.repartitionById(n, (F.col("shard") % n).cast("int")).select("file", "start").mapInArrow(_lookup(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def in_memory(docs: list[tuple[int, list[int]]], width: int = 4, block_bytes: int = BLOCK_BYTES) -> Reader:
    """A shard of a few documents without a file."""
    sink = BytesIO()
    w = Writer(sink, width, block_bytes)
    for i, ids in docs:
        w.add(key_of(i, 0), np.array(ids, np.uint32))
    w.close()
    return Reader(pa.BufferReader(sink.getvalue()))

"""Exact n-gram Jaccard join by a token-group matrix.

A document's set holds its distinct word shingles, as 64-bit hashes. Documents
with equal sets are one class. Two sets of similarity >= t share l tokens or more
among their first s - ceil(t s) + l ones in any common order, l being that of the
smaller set; here rare tokens come first, by a table of counts of fixed size over
all documents, and l grows with the set (`needed`). A class is posted once under
each of its first tokens, however many documents it has; classes that share too
few of them with all others together link with none.

1. Similar classes are partitioned into groups: the most central class of each
   token leads it, and each class joins the leader of most of its tokens. Groups
   have a bounded size; larger ones are split. A class stands in one part.
2. Within a part all pairs are compared, in memory.
3. The matrix holds the tokens of each part. Parts meet in it, not classes: a part
   finds those after its own that have one of its members' rarer first tokens,
   connected to it or not. Tokens of many parts are dealt out in squares.
4. Of two parts that meet, the union of the first tokens of each bounds the
   overlap with any member of the other. Parts between which no member is left
   go; only for the others the sets are sent, a part's as one row, and compared.
5. Components of all links come from repeated minimum and pointer steps over
   tables in the shared folder.

Every pair of classes is thus either below the bound or compared, once. A part
counts the links of each class, weighed by the documents of the other, and names
as many of them as connect what they connect; two parts name as many as connect
what each of them doesn't. Counts and components are exact. Rows grow with the
classes, and with the pairs of parts of a group, of PART classes each; the time
to compare a group of near copies grows with its pairs, as each is a link to find.

Defined cases: a text without words, null or empty, has an empty set and links
with nothing; a text of fewer words than a shingle is one shingle; a very long
text is one set like any other, which makes its part smaller in members; of
equally central classes the first one leads, of equal votes the more central
leader counts; rows with one doc_id are one vertex; rows with a null doc_id are
left unlinked, their own component null and their links 0; each row that has a
doc_id counts as a link of those it is linked with; an empty table gives no rows;
extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from netquarry.llm import common
from netquarry.llm.components import connected

#: Places of the table of token counts, and members of a part of a group, about.
COUNTS, PART = 1 << 18, 1024
#: Tokens of a part's members together, about, so that a task's memory doesn't depend on how long its texts are.
PART_TOKENS = 1 << 19
MEMO = 150_000
#: Tokens that a worker gathers before it packs them, of a share, about, and digests that it remembers to have signed.
HELD, SHARE_TOKENS, SEEN = 1 << 20, 1 << 21, 200_000
#: Classes with a token, of those a worker gathers, that are posted to its share; more of them go apart, and the share is told their number, as a size from NOTICE.
OFTEN, NOTICE = 16, 1 << 40
#: Parts of a token that meet in one square, and pairs of members below which a token is counted pair by pair.
SQUARE, LIGHT = 256, 64
CHUNK = 1 << 12
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
MIX, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _Hashes(dict):
    """Hashes of words, computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Sets of a text's word shingles; remembers the hashes of words."""

    def __init__(self, k: int):
        self.k, self.memo = k, _Hashes()

    def __call__(self, text: str | None) -> np.ndarray:
        if len(self.memo) > MEMO:
            self.memo.clear()
        # Without arguments, bytes are split at runs of the six separators of words.
        words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        x = np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words))
        if (n := len(x) - self.k + 1) < 1:
            return np.array([xxhash.xxh3_64_intdigest(x.tobytes())], np.uint64)
        z = x[:n].copy()
        for j in range(1, self.k):
            z *= MIX
            z ^= z >> np.uint64(29)
            z += x[j : n + j]
        z *= MIX2
        z ^= z >> np.uint64(32)
        return np.unique(z)


def least_overlap(size: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Overlap that a set of this size has at least with any set that links with it: ceil(size * percent / 100)."""
    return -(-size * percent // 100)


def needed(size: int) -> int:
    """l of a set: one token, and one more for each twenty."""
    return 1 + size * 5 // 100


def linked(common_: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return (common_ > 0) & (100 * common_ >= percent * (a + b - common_))


def _counter(k: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, table = Shingler(k), np.zeros(COUNTS, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                np.add.at(table, (of(t) % np.uint64(COUNTS)).astype(np.int64), 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(COUNTS // CHUNK), pa.int32()), pa.array([zstandard.compress(table[i : i + CHUNK].astype("<i8").tobytes(), 3) for i in range(0, COUNTS, CHUNK)], pa.binary())], ["chunk", "counts"])

    return count


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for c, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            sums[c] = sums.get(c, 0) + np.frombuffer(zstandard.decompress(x), "<i8")
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["chunk", "counts"])


def token_counts(texts: DataFrame, k: int) -> np.ndarray:
    """Counts of all documents' tokens by their hash, in a table of fixed size."""
    rows = texts.mapInArrow(_counter(k), "chunk int, counts binary").repartition("chunk").mapInArrow(_added, "chunk int, counts binary").collect()
    out = np.zeros(COUNTS, np.int64)
    for r in rows:
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] += np.frombuffer(r["counts"], "<i8")
    return out


def _six(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :6])


def _unsix(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _signer(k: int, percent: int, counts):
    """Rows (doc_id, text) to (doc_id, n_shingles, digest, firsts). First tokens are given once for each digest, as far as a worker remembers.

    They are cut to their upper 48 bits: equal tokens stay equal, and the few others that become so are compared like any candidates.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, table, seen = Shingler(k), counts.value, set()
        for b in batches:
            sizes, digests, firsts = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = of(t)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                if not len(s) or i is None or digests[-1] in seen:
                    firsts.append(None)
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(digests[-1])
                f = table[(s % np.uint64(COUNTS)).astype(np.int64)]
                first = s[np.lexsort((s, f))[: len(s) - least_overlap(len(s), percent) + needed(len(s))]]
                firsts.append(_six(np.sort(first) >> np.uint64(16)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(firsts, pa.binary())], ["doc_id", "n_shingles", "digest", "firsts"])

    return sign


def _dealer(shares: int):
    """Rows (rep, size, firsts) of classes to first tokens packed by share of the token, or apart."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, reps, sizes, held = [], [], [], 0
        for b in batches:
            for r, n, f in zip(*(b.column(c).to_pylist() for c in ("rep", "size", "firsts")), strict=True):
                tokens.append(_unsix(f))
                reps.append(np.full(len(tokens[-1]), r, np.int64))
                sizes.append(np.full(len(tokens[-1]), n, np.int64))
                held += len(tokens[-1])
            if held > HELD:
                yield _packed_rows(tokens, reps, sizes, shares)
                tokens, reps, sizes, held = [], [], [], 0
        if held:
            yield _packed_rows(tokens, reps, sizes, shares)

    return deal


def _packed_rows(tokens: list, reps: list, sizes: list, shares: int) -> pa.RecordBatch:
    """Packed by share, but tokens of more than OFTEN classes here: these are known to be shared and go apart, so that no token makes a share large."""
    token, rep, size = (np.concatenate(x) for x in (tokens, reps, sizes))
    distinct, at, n = np.unique(token, return_inverse=True, return_counts=True)
    frequent = n > OFTEN
    apart = frequent[at]
    share = (token % np.uint64(shares)).astype(np.int32)
    share[apart] = -1 - xxhash.xxh3_64_intdigest(rep.tobytes()) % (1 << 30)
    told = distinct[frequent]
    token, rep = np.concatenate([token, told]), np.concatenate([rep, np.full(len(told), rep.min())])
    size, share = np.concatenate([size, NOTICE + n[frequent]]), np.concatenate([share, (told % np.uint64(shares)).astype(np.int32)])
    order = np.lexsort((token, share))
    token, rep, size, share = token[order], rep[order], size[order], share[order]
    names, starts = np.unique(share, return_index=True)
    out = []
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(share)], strict=True):
        base, steps = int(rep[lo:hi].min()), np.diff(token[lo:hi], prepend=np.uint64(0))
        body = _six(steps).T.tobytes() + _six(rep[lo:hi] - base).T.tobytes() + _six(size[lo:hi]).T.tobytes()
        out.append(base.to_bytes(8, "little") + zstandard.compress(body, 3))
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(out, pa.binary())], ["share", "packed"])


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(packed[8:]), np.uint8).reshape(3, 6, -1)
    token, rep, size = (_unsix(np.ascontiguousarray(x.T).tobytes()) for x in raw)
    return np.cumsum(token), rep.astype(np.int64) + int.from_bytes(packed[:8], "little"), size.astype(np.int64)


def _shared_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, rep, size, n) of the tokens that several classes have, n of them (of those that went apart, n there); rows come sorted by share."""
    share, lists = None, []

    def out() -> Iterator[pa.RecordBatch]:
        if not lists:
            return
        token, rep, size = (np.concatenate(x) for x in zip(*lists, strict=True))
        order = np.argsort(token, kind="stable")
        token, rep, size = token[order], rep[order], size[order]
        told = size >= NOTICE
        _, at = np.unique(token, return_inverse=True)
        n = np.bincount(at, np.where(told, size - NOTICE, 1)).astype(np.int64)
        several = ~told & (n[at] > 1)
        yield pa.RecordBatch.from_arrays([pa.array(x[several]) for x in (token.astype(np.int64), rep, size, n[at])], ["token", "rep", "size", "n"])

    for b in batches:
        for s, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if s != share:
                yield from out()
                share, lists = s, []
            lists.append(_unpacked(packed))
    yield from out()


def _sets(k: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingler(k)
        for b in batches:
            tokens = [of(t).astype("<u8").tobytes() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x) for x in tokens], pa.binary()), pa.array(tokens, pa.binary())], ["digest", "tokens"])

    return sets


def _overlaps(own: list[np.ndarray], others: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of own x others, or of own x own but for the diagonal.

    Only tokens of both sides count. Frequent ones are counted by products of
    incidence rows in slices of the tokens, the others pair by pair.
    """
    lengths = lambda x: [len(s) for s in x]
    a, row_a = np.concatenate(own), np.repeat(np.arange(len(own)), lengths(own))
    if others is None:
        both, place_a, n = np.unique(a, return_inverse=True, return_counts=True)
        some = n > 1
        keep, number = some[place_a], np.cumsum(some) - 1
        place_a, row_a = number[place_a[keep]], row_a[keep]
        place_b, row_b, width, n_both = place_a, row_a, len(own), int(some.sum())
    else:
        b, row_b = np.concatenate(others), np.repeat(np.arange(len(others)), lengths(others))
        both = np.intersect1d(a, b)
        width, n_both = len(others), len(both)
        if n_both:
            at_a, at_b = (np.minimum(np.searchsorted(both, x), n_both - 1) for x in (a, b))
            keep_a, keep_b = both[at_a] == a, both[at_b] == b
            place_a, row_a, place_b, row_b = at_a[keep_a], row_a[keep_a], at_b[keep_b], row_b[keep_b]
    out = np.zeros((len(own), width), np.float32)
    if not n_both:
        return out
    (place_a, row_a), (place_b, row_b) = ((p[o], r[o]) for p, r in ((place_a, row_a), (place_b, row_b)) for o in [np.argsort(p, kind="stable")])
    n_a, n_b = np.bincount(place_a, minlength=n_both), np.bincount(place_b, minlength=n_both)
    heavy = n_a * n_b > LIGHT
    number = np.cumsum(heavy) - 1
    heavy_a, heavy_b = heavy[place_a], heavy[place_b]
    ha, ra, hb, rb = number[place_a[heavy_a]], row_a[heavy_a], number[place_b[heavy_b]], row_b[heavy_b]
    step = max(256, (16 << 20) // (4 * (len(own) + width)))
    for at in range(0, int(heavy.sum()), step):
        sides = []
        for h, r, count in ((ha, ra, len(own)), (hb, rb, width)):
            lo, hi = np.searchsorted(h, (at, at + step))
            m = np.zeros((count, step), np.float32)
            m[r[lo:hi], h[lo:hi] - at] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    start_b = np.cumsum(n_b) - n_b
    la, ra = place_a[~heavy_a], row_a[~heavy_a]
    each = n_b[la]
    ends = np.cumsum(each)
    at = 0
    while at < len(la):  # about a million pairs at a time, or those of one token
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20), "right")))
        n = each[at:to]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out += np.bincount(np.repeat(ra[at:to], n) * width + row_b[np.repeat(start_b[la[at:to]], n) + nth], minlength=out.size).reshape(out.shape)
        at = to
    return out


def _links(own: list[np.ndarray], others: list[np.ndarray] | None, percent: int) -> np.ndarray:
    """Whether each of own x others are linked; of own x own the pairs of one with a later one."""
    a = np.array([len(x) for x in own], np.int64)
    b = a if others is None else np.array([len(x) for x in others], np.int64)
    met = linked(_overlaps(own, others).astype(np.int64), a[:, None], b[None, :], percent)
    return np.triu(met, 1) if others is None else met


def _forest(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (a, b) that connect what all links (x, y) of n nodes connect, one less than its nodes for each component; and the component of each node."""
    met = np.zeros((n, n), bool)
    met[x, y] = met[y, x] = True
    label, left, a, b = np.arange(n), met.any(axis=1), [np.zeros(0, int)], [np.zeros(0, int)]
    while left.any():
        front = np.array([left.argmax()])
        first = front[0]
        left[front] = False
        while len(front):
            near = met[front] & left
            new = np.flatnonzero(near.any(axis=0))
            a.append(front[near[:, new].argmax(axis=0)])
            b.append(new)
            left[new], label[new] = False, first
            front = new
    return np.concatenate(a), np.concatenate(b), label


#: A part as one row: what links its members, how many links each has, and, if the part meets others, what these need of it.
PACK = "reps array<long>, counts binary, a array<long>, b array<long>, docs binary, comps binary, sizes binary, firsts binary, first_sizes binary, tokens binary"


def _part(percent: int):
    names, kinds = [x.split()[0] for x in PACK.split(", ")], [pa.list_(pa.int64()) if "array" in x else pa.binary() for x in PACK.split(", ")]
    raw = lambda x: np.asarray(x, "<i8").tobytes()

    def part(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        reps, docs = table["rep"].to_numpy(), table["docs"].to_numpy()
        tokens = table["tokens"].to_pylist()
        sets = [np.frombuffer(x, "<u8") for x in tokens]
        x, y = np.nonzero(_links(sets, None, percent)) if len(sets) > 1 else (np.zeros(0, int), np.zeros(0, int))
        counts = np.zeros(len(reps), np.int64)
        np.add.at(counts, x, docs[y])
        np.add.at(counts, y, docs[x])
        a, b, label = _forest(x, y, len(reps))
        row = [reps.tolist(), raw(counts), reps[a].tolist(), reps[b].tolist()]
        if table["crossed"][0].as_py():
            firsts = table["firsts"].to_pylist()
            row += [raw(docs), raw(label), raw([len(s) for s in sets]), b"".join(firsts), raw([len(f) // 6 for f in firsts]), b"".join(tokens)]
        else:
            row += [None] * 6
        return pa.table([pa.array([key[0].as_py()], table.schema.field("lead").type), pa.array([key[1].as_py()], table.schema.field("part").type), *(pa.array([v], t) for v, t in zip(row, kinds, strict=True))], ["lead", "part", *names])

    return part


def _bounded(percent: int):
    """Pairs of parts to those of whose members some can link: places of the members whose first tokens are enough in the other part's union."""

    def reaching(firsts: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, union: np.ndarray) -> np.ndarray:
        shared = np.add.reduceat(np.isin(firsts, union).astype(np.int64), np.cumsum(lengths) - lengths)
        return np.flatnonzero(shared >= needed(least_overlap(sizes, percent)))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k in range(b.num_rows):
                get = lambda c, k=k: b.column(c)[k].as_py()
                one, two = ((_unsix(get(f"{x}_firsts")), np.frombuffer(get(f"{x}_first_sizes"), "<i8"), np.frombuffer(get(f"{x}_sizes"), "<i8")) for x in "ab")
                left, right = reaching(*one, np.unique(two[0])), reaching(*two, np.unique(one[0]))
                if len(left) and len(right):
                    rows.append((k, left.astype("<i4").tobytes(), right.astype("<i4").tobytes()))
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in ("a", "b")), *(pa.array([r[j] for r in rows], pa.binary()) for j in (1, 2))], ["a", "b", "of_a", "of_b"])

    return bound


def _crossed(percent: int):
    """Opened pairs of parts to the counts of both parts' members and to links between their components."""

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k in range(b.num_rows):
                get = lambda c, k=k: b.column(c)[k].as_py()
                sides = []
                for x in "ab":
                    sizes, docs, comps = (np.frombuffer(get(f"{x}_{c}"), "<i8") for c in ("sizes", "docs", "comps"))
                    at, tokens = np.frombuffer(get(f"of_{x}"), "<i4").astype(int), np.frombuffer(get(f"{x}_tokens"), "<u8")
                    ends = np.cumsum(sizes)
                    sides.append((at, [tokens[ends[j] - sizes[j] : ends[j]] for j in at], docs, comps, get(f"{x}_reps")))
                (at_a, sets_a, docs_a, comps_a, reps_a), (at_b, sets_b, docs_b, comps_b, reps_b) = sides
                x, y = np.nonzero(_links(sets_a, sets_b, percent))
                if not len(x):
                    continue
                x, y = at_a[x], at_b[y]
                counts_a, counts_b = np.zeros(len(docs_a), "<i8"), np.zeros(len(docs_b), "<i8")
                np.add.at(counts_a, x, docs_b[y])
                np.add.at(counts_b, y, docs_a[x])
                ends = np.unique(np.stack([comps_a[x], comps_b[y]]), axis=1)
                nodes, number = np.unique(np.concatenate([ends[0], ends[1] + len(docs_a)]), return_inverse=True)
                p, q, _ = _forest(number[: ends.shape[1]], number[ends.shape[1] :], len(nodes))
                reps = [*reps_a, *reps_b]
                rows.append((k, counts_a.tobytes(), counts_b.tobytes(), [reps[j] for j in nodes[p]], [reps[j] for j in nodes[q]]))
            at = pa.array([r[0] for r in rows], pa.int64())
            columns = [*(b.column(c).take(at) for c in ("a", "b")), *(pa.array([r[j] for r in rows], pa.binary()) for j in (1, 2)), *(pa.array([r[j] for r in rows], pa.list_(pa.int64())) for j in (3, 4))]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "counts_a", "counts_b", "x", "y"])

    return cross


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, n) of the members that have links; rows (home, reps, counts) come sorted by home, each home with its reps once."""
    home, reps, total = None, None, None

    def out() -> Iterator[pa.RecordBatch]:
        if total is not None and total.any():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([reps[k] for k in some], pa.int64()), pa.array(total[some])], ["rep", "n"])

    for b in batches:
        for h, r, c in zip(*(b.column(k).to_pylist() for k in ("home", "reps", "counts")), strict=True):
            if h != home:
                yield from out()
                home, reps, total = h, None, 0
            reps, total = reps if r is None else r, total + np.frombuffer(c, "<i8")
    yield from out()


def jaccard_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = 5, percent: int = 80, part: int = PART) -> DataFrame:
    """doc_id, n_shingles and component_id of each row; see `jaccard_links`."""
    return jaccard_links(docs, text, doc_id, k, percent, part).drop("n_links")


def jaccard_links(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = 5, percent: int = 80, part: int = PART) -> DataFrame:
    """doc_id, n_shingles, component_id, the smallest doc_id that links reach, and n_links, the other rows linked with it, for each row; linked: 100 * intersection >= percent * union."""
    spark = common.tune(docs.sparkSession)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    counts = spark.sparkContext.broadcast(token_counts(texts.select("text"), k))
    signed = common.written(texts.mapInArrow(_signer(k, percent, counts), "doc_id long, n_shingles long, digest binary, firsts binary"), "tgm-signed")
    own = signed.filter("digest is not null and doc_id is not null")
    classes = own.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"), F.max("n_shingles").alias("size"), F.max("firsts").alias("firsts"))
    classes = common.written(classes.withColumn("rep", F.monotonically_increasing_id()), "tgm-classes")
    edges, links = _found(texts, classes, k, percent, part)
    # A doc_id with several sets joins their classes.
    pairs = own.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).filter("x <> y").select("doc_id")
    several = common.written(own.select("doc_id", "digest").join(common.written(pairs, "tgm-several"), "doc_id").distinct().join(classes.select("digest", "rep"), "digest").select("doc_id", "rep"), "tgm-more")
    more = several.join(several.groupBy("doc_id").agg(F.min("rep").alias("b")), "doc_id").select(F.col("rep").alias("a"), "b")
    roots = connected(edges.unionByName(more))
    # Classes of one document that link with none need no name.
    named = classes.select("digest", "n", "rep", "first_id").join(roots.withColumnRenamed("node", "rep"), "rep", "left").filter("n > 1 or root is not null").withColumn("root", F.coalesce("root", "rep"))
    named = named.join(links, "rep", "left").withColumn("n_links", F.coalesce("others", F.lit(0)) + F.col("n") - 1).drop("others")
    named = common.written(named, "tgm-named")
    least = common.written(named.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("classes")), "tgm-least")
    told = common.written(common.join_hot(named, least, "root", "classes", "rep").select("digest", "n", "component_id", "n_links"), "tgm-components")
    common.dropped(classes, edges, links, several, roots, named, least)
    met = common.join_hot(signed.select("doc_id", "n_shingles", "digest"), told, "digest", "n", "doc_id")
    return met.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"))


def _found(texts: DataFrame, classes: DataFrame, k: int, percent: int, part: int) -> tuple[DataFrame, DataFrame]:
    """(a, b) of classes, whose components are those of all links, and (rep, others), the documents of other classes linked with a class; both written."""
    spark = texts.sparkSession
    # A partner has ceil(t s) tokens at least, and with it as many are shared as `needed` says of that.
    enough = F.expr(f"1 + 5 * ((size * {percent} + 99) div 100) div 100")
    total = classes.agg(F.sum(F.length("firsts")).alias("b")).first()["b"] or 0
    shares = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (6 * SHARE_TOKENS)))
    dealt = classes.select("rep", "size", "firsts").mapInArrow(_dealer(shares), "share int, packed binary")
    posted = common.written(dealt.repartition("share").sortWithinPartitions("share").mapInArrow(_shared_tokens, "token long, rep long, size long, n long"), "tgm-posted")
    central = common.written(posted.groupBy("rep", "size").agg(F.count("*").alias("k"), F.sum("n").alias("weight")).filter(F.col("k") >= enough).select("rep", "weight"), "tgm-central")
    if central.isEmpty():
        none = spark.createDataFrame([], "a long, b long, rep long, others long")
        return none.select("a", "b"), none.select("rep", "others")
    weighed = common.written(posted.join(common.bounded(central)[0], "rep").withColumn("rank", F.struct("weight", (-F.col("rep")).alias("minus"))).drop("weight", "n"), "tgm-weighed")
    # The most central class of each token leads it; each class joins the leader of most of its tokens.
    leads = common.written(weighed.groupBy("token").agg(F.max("rank").alias("lead"), F.count("*").alias("n")), "tgm-leads")
    votes = common.join_hot(weighed, leads, "token", "n", "rep").groupBy("rep", "size", "lead").agg(F.count("*").alias("votes"))
    group = votes.groupBy("rep", "size").agg(F.max_by("lead", F.struct("votes", "lead")).alias("lead"))
    group = common.written(group.select("rep", "size", (-F.col("lead.minus")).alias("lead")), "tgm-group")
    volume = common.written(group.groupBy("lead").agg(F.count("*").alias("n"), F.sum("size").alias("volume")), "tgm-volume")
    of = F.ceil(F.greatest(F.col("n") / F.lit(part), F.col("volume") / F.lit(PART_TOKENS))).cast("int")
    homes = common.join_hot(group, volume, "lead", "n", "rep").select("rep", "lead", F.pmod(F.xxhash64("rep"), of).cast("int").alias("part"))
    homes = common.written(homes.withColumn("home", F.struct("lead", "part")), "tgm-homes")
    met = _meetings(weighed.select("token", "rep", "size"), homes.select("rep", "home"), enough, percent)
    crossed = met.select("a").unionByName(met.select(F.col("b").alias("a"))).distinct().select(F.col("a").alias("_home"), F.lit(True).alias("crossed"))
    some = homes.groupBy("home").agg(F.count("*").alias("members")).join(crossed, F.col("home") == F.col("_home"), "left").withColumn("crossed", F.coalesce("crossed", F.lit(False)))
    some = common.written(some.filter("members > 1 or crossed").select(F.col("home").alias("_home"), "crossed"), "tgm-some")
    wanted = homes.join(some, F.col("home") == F.col("_home")).select("rep", "lead", "part", "crossed")
    wanted = common.written(classes.join(wanted, "rep").select("rep", "digest", "first_id", F.col("n").alias("docs"), "firsts", "lead", "part", "crossed"), "tgm-wanted")
    # Sets are made once and then go straight to their part.
    ids, _ = common.bounded(wanted.select(F.col("first_id").alias("doc_id")))
    named, _ = common.bounded(wanted.select("digest", "rep"))
    made = texts.join(ids, "doc_id", "left_semi").select("text").mapInArrow(_sets(k), "digest binary, tokens binary").join(named, "digest").select("rep", "tokens")
    sets = common.written(made, "tgm-sets")
    if sets.select("rep").count() > wanted.count():  # a doc_id on several rows
        sets = common.written(sets.dropDuplicates(["rep"]), "tgm-sets")
    packed = sets.join(wanted.drop("digest", "first_id"), "rep").groupBy("lead", "part").applyInArrow(_part(percent), f"lead long, part int, {PACK}")
    parts = common.written(packed.withColumn("home", F.struct("lead", "part")).drop("lead", "part"), "tgm-parts")

    def side(x: str, *columns: str) -> DataFrame:
        return parts.filter("tokens is not null").select(F.col("home").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in columns])

    needs = ("sizes", "firsts", "first_sizes")
    opened = common.written(met.join(side("a", *needs), "a").join(side("b", *needs), "b").mapInArrow(_bounded(percent), f"a {HOME}, b {HOME}, of_a binary, of_b binary"), "tgm-opened")
    needs = ("reps", "docs", "comps", "sizes", "tokens")
    links = common.written(opened.join(side("a", *needs), "a").join(side("b", *needs), "b").mapInArrow(_crossed(percent), f"a {HOME}, b {HOME}, counts_a binary, counts_b binary, x array<long>, y array<long>"), "tgm-crossed")
    edges = parts.select(F.explode(F.arrays_zip("a", "b")).alias("e")).unionByName(links.select(F.explode(F.arrays_zip(F.col("x").alias("a"), F.col("y").alias("b"))).alias("e")))
    edges = common.written(edges.select("e.a", "e.b"), "tgm-edges")
    none = F.lit(None).cast("array<long>").alias("reps")
    counted = parts.select("home", "reps", "counts").unionByName(links.select(F.col("a").alias("home"), none, F.col("counts_a").alias("counts"))).unionByName(links.select(F.col("b").alias("home"), none, F.col("counts_b").alias("counts")))
    others = common.written(counted.repartition("home").sortWithinPartitions("home").mapInArrow(_summed, "rep long, n long").withColumnRenamed("n", "others"), "tgm-others")
    common.dropped(posted, central, weighed, leads, group, volume, homes, met, some, wanted, sets, parts, opened, links)
    return edges, others


HOME = "struct<lead:long,part:int>"


def _meetings(tokens: DataFrame, homes: DataFrame, enough, percent: int) -> DataFrame:
    """(a, b) of the parts that meet under a token that a class of the first one asks with; tokens: (token, rep, size)."""
    entries = common.written(tokens.join(common.bounded(homes)[0], "rep"), "tgm-placed")
    # only tokens of more than one part are of interest
    mixed = common.written(entries.groupBy("token").agg(F.min("home").alias("x"), F.max("home").alias("y"), F.count("*").alias("n")).filter("x <> y").select("token", "n"), "tgm-mixed")
    entries_ = common.written(common.join_hot(entries, mixed, "token", "n", "rep").filter("n is not null"), "tgm-entries")
    # A link needs `enough` of a class's tokens here, so one of those that are left without its most frequent `enough` - 1.
    by_rep = W.partitionBy("rep")
    asking = F.row_number().over(by_rep.orderBy("n", "token")) <= F.count("*").over(by_rep) - enough + 1
    matrix = entries_.withColumn("asking", asking).groupBy("token", "home").agg(F.min("size").alias("least"), F.max("size").alias("most"), F.max("asking").alias("asking"))
    matrix = common.written(matrix, "tgm-matrix")
    many = common.written(matrix.groupBy("token").agg(F.count("*").alias("parts")).filter(F.col("parts") > SQUARE), "tgm-many")
    matrix_ = common.join_hot(matrix, many, "token", "parts", "home").withColumn("squares", F.ceil(F.coalesce("parts", F.lit(1)) / F.lit(SQUARE)).cast("int"))
    own = matrix_.filter("asking").select("token", F.col("home").alias("a"), F.col("least").alias("least_a"), F.col("most").alias("most_a"), F.pmod(F.xxhash64("home"), F.col("squares")).cast("int").alias("square"))
    other = matrix_.select("token", F.col("home").alias("b"), F.col("least").alias("least_b"), F.col("most").alias("most_b"), F.explode(F.sequence(F.lit(0), F.col("squares") - 1)).alias("square"))
    reach = (F.col("most_a") * 100 >= F.col("least_b") * percent) & (F.col("most_b") * 100 >= F.col("least_a") * percent)
    met = common.written(own.join(other, ["token", "square"]).filter((F.col("a") < F.col("b")) & reach).select("a", "b").distinct(), "tgm-met")
    common.dropped(entries, mixed, entries_, matrix, many)
    return met


def keep(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, that of the smallest doc_id, with all its columns. Rows with a null doc_id stay."""
    rows = common.written(jaccard_components(docs, text, doc_id, k, percent).filter("doc_id <> component_id").select("doc_id").distinct(), "tgm-dropped")
    own = common.free_name(docs, "_dropped")
    few, _ = common.bounded(rows.withColumnRenamed("doc_id", own))
    return docs.join(few, F.col(doc_id).cast("long") == F.col(own), "left_anti")

"""Collocations, the audit of filters and SimHash against plain versions."""

import itertools
import re
from collections import Counter
from math import factorial

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from netquarry.llm import collocations, filter_audit, queries, simhash_anchors
from tests.llm import helpers as H


@pytest.mark.parametrize("name", ["op11_collocations", "op12_filter_audit"])
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{H.SMALL}/{t}.parquet'")
    want = con.execute(queries.ORACLE[name])
    names = [c[0] for c in want.description]
    df = queries.QUERIES[name](spark, H.SMALL)
    assert sorted(df.columns) == sorted(names)
    got = Counter(tuple(r[c] for c in names) for r in df.collect())
    assert got and got == Counter(want.fetchall())


# collocations


def lowered(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def plain_counts(rows, longest):
    """{lang: number of words}, {(lang, phrase): count}."""
    n, f = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered(text)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + m])) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    return n, f


def plain_collocations(rows, longest, least, top):
    n, f = plain_counts(rows, longest)
    often = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    covered = {(lang, p[i : i + m]): 0 for lang, p in often for m in range(2, len(p)) for i in range(len(p) - m + 1)}
    for (lang, p), a in often.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                covered[lang, p[i : i + m]] = max(covered[lang, p[i : i + m]], a)
    out = []
    for lang in n:
        kept = []
        for (x, p), a in often.items():
            if x == lang and covered.get((x, p), 0) < a:
                score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def talk(seed=3, rows=160):
    """Texts with phrases that recur, marks, tabs, capitals and other alphabets."""
    rng = np.random.default_rng(seed)
    vocabulary = ["New", "york", "ÉTÉ", "naïve", "a", "b", "c\x1cd", "日本", "x-y", "\x00", "the", "of"]
    phrases = ["New York city", "of the", "a b a b a", "in the light of the day", "ÉTÉ naïve", "the of the"]
    out = []
    for _ in range(rows):
        parts = [str(rng.choice(phrases)) if rng.random() < 0.5 else str(rng.choice(vocabulary)) for _ in range(rng.integers(0, 30))]
        seps = rng.choice([" ", "  ", "\t", ". ", ",", "\n", "!\r", " \x0b"], len(parts), p=[0.6, 0.1, 0.1, 0.05, 0.05, 0.05, 0.03, 0.02])
        out.append((str(rng.choice(["en", "de"])) if rng.random() < 0.9 else None, "".join(p + s for p, s in zip(parts, seps, strict=True))))
    return [*out, (None, None), ("und", ""), ("en", " , . "), ("zz", "once"), out[0], out[0]]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("longest", "least", "top"), [(5, 3, 2000), (4, 10, 5), (2, 1, 2000), (5, 300, 7)])
def test_collocations(spark, longest, least, top):
    rows = talk()
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "lang string, text string, n long, a long, phrase string")
    got = rows_of(collocations.collocations(docs, longest=longest, least=least, top=top))
    assert got == plain_collocations(rows, longest, least, top) and (got or least == 300)


def test_collocations_full_sketch(spark, monkeypatch):
    """A sketch of few cells lets all through, and nothing changes."""
    monkeypatch.setattr(collocations, "LEAST_CELLS", 64)
    rows = talk(4)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert rows_of(collocations.collocations(docs, least=4, most_cells=64)) == plain_collocations(rows, 5, 4, 2000)


def test_collocations_awkward(spark):
    docs = H.awkward_docs(spark)
    rows = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    assert rows_of(collocations.collocations(docs, least=2, top=10_000)) == plain_collocations(rows, 5, 2, 10_000)
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert collocations.collocations(docs.filter("text is null")).count() == 0


@pytest.mark.parametrize("size", [1, 7, 40, 10_000])
def test_collocations_chunks(monkeypatch, size):
    """Texts in chunks of any size give the same counts, and the sketch's bits cover what occurs often."""
    monkeypatch.setattr(collocations, "CHUNK", size)
    rows = talk(5, 60) + [("en", "w " * 2000), ("en", "longword" * 200 + " tail of it")]
    batch = pa.RecordBatch.from_arrays([pa.array([x or "und" for x, _ in rows]), pa.array([(t or "").encode() for _, t in rows])], ["lang", "text"])
    cells, least = 1 << 18, 3
    class Held:
        def __init__(self, value):
            self.value = value

    def bits_of(lengths, pairs=None):
        bits = np.zeros(collocations.ROWS * cells, bool)
        blocks = sorted(collocations._sketcher(lengths, 5, least, cells, pairs)([batch]), key=lambda b: b.column(0)[0].as_py())
        for b in collocations._merger(least)(blocks):
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                bits[k * collocations.BLOCK : (k + 1) * collocations.BLOCK] = np.unpackbits(np.frombuffer(raw, np.uint8)).view(bool)
        return np.packbits(bits).tobytes()

    pairs = bits_of(range(1, 3))
    both = Held((pairs, bits_of(range(3, 6), Held(pairs))))
    n, f = plain_counts(rows, 5)
    got, words = Counter(), Counter()
    for b in collocations._counter(5, both)([batch]):
        for lang, phrase, m, k in zip(*(b.column(x).to_pylist() for x in range(4)), strict=True):
            if phrase is None:
                words[lang] += k
            else:
                assert len(phrase.split(b" ")) == m
                got[lang, tuple(phrase.decode().split(" "))] += k
    assert words == n
    assert {k: v for k, v in got.items() if v >= least} == {k: v for k, v in f.items() if v >= least}
    assert all(f[k] == v for k, v in got.items()) and len(got) < len(f) / 2


def test_collocations_big_products(spark):
    """Counts whose products pass 64 bits."""
    n, a, left, right = 8_000_000_000_000_000, 3_000_000_000_001, 3_100_000_000_007, 5_000_000_000_003
    rows = [("en", None, 0, n), ("en", b"x y", 2, a), ("en", b"x", 1, left), ("en", b"y", 1, right)]
    got = collocations.scored(spark.createDataFrame(rows, "lang string, phrase binary, words int, n long")).collect()
    assert [(r.a, r.l, r.r, r.n, r.score) for r in got] == [(a, left, right, n, 1000 * a * n // (left * right))]


# audit of filters


def plain_fails(rows):
    """Filters that each (doc_id, text) fails."""
    out = []
    for i, t in rows:
        t = t or ""
        w = H.words(t)
        same = [j for j, x in rows if (x or "") == t and j is not None]
        out.append("".join(x for x, fails in (
            ("A", len(w) < 50), ("B", 100 * len(set(w)) < 65 * len(w)), ("C", 100 * len(re.findall("[A-Z]", t)) > 5 * len(t)), ("D", bool(re.search("[#$%&*|]", t))),
            ("E", bool(same) and (i is None or min(same) < i)),
        ) if fails))
    return out


def plain_audit(rows, labels):
    """rows: (doc_id, part, text); labels: (doc_id, quality, toxic)."""
    fails, out = plain_fails([(i, t) for i, _, t in rows]), set()
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, x in labels if x == 1} - {None}
    for part in {p or "" for _, p, _ in rows}:
        own = [(i, f) for (i, p, _), f in zip(rows, fails, strict=True) if (p or "") == part]
        total, steps = Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, x in enumerate(order):
                gone = [(i, f) for i, f in left if x in f]
                total[x] += len(gone)
                left, before = [(i, f) for i, f in left if x not in f], left
                redundant = sum(x in f for _, f in own) - len(gone)
                steps.append((part, "".join(order), k + 1, len(left), len(gone), redundant, sum(f == x for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)))
                assert len(before) - len(left) == len(gone)
        out |= {(*s, total[s[1][s[2] - 1]]) for s in steps}
    return sorted(out)


LABELS = [(1, 1, 0), (2, 0, 1), (3, 1, 1), (10, 1, 0), (10, 0, 1), (12, None, 1), (None, 1, 1), (999, 1, 1), (15, 1, None)]


def test_filter_audit(spark):
    docs = H.awkward_docs(spark)
    # texts that pass A, and fail one or several of the others; ties at the limits
    w = [f"x{k}" for k in range(200)]
    more = [H.row(30, " ".join(w[:50])), H.row(31, " ".join(w[:49])), H.row(32, " ".join(w[:65] + w[:35])), H.row(33, " ".join(w[:64] + w[:36]), "b"), H.row(34, "AB" + " " + " ".join(w[:100]), "b"), H.row(35, " ".join(x.upper() for x in w[:80]), ""), H.row(36, " ".join(w[:60]) + " #", None)]
    more += [H.row(37, " ".join(w[:50])), H.row(29, " ".join(w[:50]), "b"), H.row(38, "A" + "b" * 19), H.row(39, "AA" + "b" * 38), H.row(40, "AAA" + "b" * 37)]
    docs = docs.unionByName(spark.createDataFrame(more, H.SCHEMA))
    labels = spark.createDataFrame([(*r, "x", 3) for r in LABELS], "doc_id long, quality int, toxic int, part string, mask int")
    got = sorted(tuple(r) for r in filter_audit.filter_audit(docs, labels).collect())
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    assert got == plain_audit(rows, LABELS)
    assert len(got) == 600 * len({r[1] or "" for r in rows})
    assert filter_audit.filter_audit(docs.limit(0), labels).count() == 0
    bare = sorted(tuple(r) for r in filter_audit.filter_audit(docs, labels.limit(0)).collect())
    assert [r[:7] for r in bare] == [r[:7] for r in got] and not any(r[7] or r[8] for r in bare)


def test_filter_audit_edges(spark):
    """80 edges a part, whose sums over paths agree with the orders that an edge lies on; three filters work alike."""
    counts = spark.createDataFrame([("p", m, 1 << m % 7, m % 3, m % 2) for m in range(32)], "part string, mask int, n long, good long, toxic long")
    edges = filter_audit.edges(counts).collect()
    assert len(edges) == 80 and filter_audit.paths(counts).count() == 600
    got = filter_audit.audited(counts)
    by = {r.letter: r.s for r in got.withColumn("letter", F.expr("substring(filter_order, step, 1)")).groupBy("letter").agg(F.sum("removed").alias("s")).collect()}
    assert by == {"ABCDE"[f]: sum(e.removed * factorial(bin(e.applied).count("1")) * factorial(4 - bin(e.applied).count("1")) for e in edges if e.next == f) for f in range(5)}
    assert all(r.shapley == by[r.filter_order[r.step - 1]] for r in got.collect())
    assert filter_audit.audited(counts.filter("mask < 8"), "XYZ").count() == 18


# SimHash


def plain_fingerprint(text, k=3):
    w = H.words(lowered(text))
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, bits=3):
    """Component numbers of a list of fingerprints."""
    label = list(range(len(prints)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= bits:
            a, b = find(i), find(j)
            label[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(prints))]


def plain_simhash(rows, bits=3):
    """Sorted (doc_id, fingerprint, component_id) of (doc_id, text)."""
    prints = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(prints, bits)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return sorted(((i, f, least[r]) for (i, _), f, r in zip(rows, prints, roots, strict=True)), key=str)


def got_simhash(df):
    return sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in df.collect()), key=str)


def test_simhash(spark):
    """Awkward rows, and copies with a few words changed, which differ in a few bits."""
    rng = np.random.default_rng(1)
    docs = [(r[0], r[1]) for r in H.awkward()]
    for g in range(12):
        base = [f"v{x}" for x in rng.integers(0, 5000, 300)]
        for k in range(8):
            other = list(base)
            for at in rng.integers(0, 300, k):
                other[at] = f"u{at}"
            docs.append((100 + 10 * g + k, " ".join(other)))
    df = spark.createDataFrame([(*r, "x", 3) for r in docs], "doc_id long, text string, fp string, n long")
    got = got_simhash(simhash_anchors.near_duplicates(df))
    assert got == plain_simhash(docs)
    assert len({c for i, _, c in got if i and i >= 100}) < 80
    assert simhash_anchors.near_duplicates(df.limit(0)).count() == 0
    assert [tuple(r) for r in simhash_anchors.near_duplicates(df.filter("doc_id is null and text is null")).select("doc_id", "component_id").collect()] == [(None, None)]


def signed(x):
    return int(np.array([x], np.uint64).view(np.int64)[0])


def linked(spark, prints, bits, part):
    """Component of each of the distinct fingerprints by the links found."""
    df = spark.createDataFrame([(signed(x),) for x in prints], "fp long").repartition(3)
    at = {signed(x): k for k, x in enumerate(prints)}
    label = list(range(len(prints)))
    pairs = [(at[r.a], at[r.b]) for r in simhash_anchors.links(df, bits, part).collect()]
    assert all((prints[a] ^ prints[b]).bit_count() <= bits or len(prints) > 300 for a, b in pairs)
    for _ in range(len(prints)):
        before = list(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    return label, len(pairs)


@pytest.mark.parametrize("bits", [0, 1, 3])
def test_simhash_links(spark, bits):
    """Random fingerprints with neighbours at one to five bits, over both halves and at their edges: no link is lost."""
    rng = np.random.default_rng(2)
    prints = {0, 1, (1 << 64) - 1, 1 << 63, 7, 1 << 31, 1 << 32, (1 << 31) | (1 << 32) | 1}
    for _ in range(40):
        x = int(rng.integers(0, 1 << 64, dtype=np.uint64))
        prints |= {x}
        for k in (1, 2, 3, 4, 5):
            prints.add(x ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)))
    prints = sorted(prints)
    label, _ = linked(spark, prints, bits, simhash_anchors.PART)
    assert label == plain_components(prints, bits)


@pytest.mark.parametrize("part", [16, 2048])
def test_simhash_large_group(spark, part):
    """A group of a thousand fingerprints around one: cut into squares or not, all are connected, in rows in proportion to the group."""
    rng = np.random.default_rng(6)
    x = 0x0123456789ABCDEF
    prints = sorted({x ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (1500, 2))} | {x ^ 0xFFFF << 20})
    label, rows = linked(spark, prints, 3, part)
    assert label == plain_components(prints) and len(set(label)) == 2
    assert rows < 40 * len(prints) * (8 if part == 16 else 1)


def test_simhash_anchors(spark):
    """The anchors are code words within two bits of the halves, all of them, and the own ones within one."""
    rng = np.random.default_rng(3)
    prints = [0, (1 << 64) - 1, *map(int, rng.integers(0, 1 << 64, 30, dtype=np.uint64))]
    df = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    half = [simhash_anchors._half(F.col("fp"), k) for k in (0, 1)]
    got = df.select("fp", F.explode(simhash_anchors.anchors(F.col("fp"), tuple(map(simhash_anchors.syndrome, half)))).alias("at")).select("fp", "at.*").collect()

    def is_word(x):
        s = 0
        for p in range(1, 32):
            s ^= p * (x >> p - 1 & 1)
        return s == 0

    for x in prints:
        for side in (0, 1):
            h = x >> 32 * side & 0xFFFFFFFF
            near = {h ^ a ^ b for a in (0, *(1 << k for k in range(32))) for b in (0, *(1 << k for k in range(32)))}
            mine = [(r.anchor & 0xFFFFFFFF, r.own) for r in got if r.fp == signed(x) and r.anchor >> 32 == side]
            assert sorted(a for a, _ in mine) == sorted(y for y in near if is_word(y))
            assert [(a ^ h).bit_count() <= 1 for a, own in mine if own] == [True]


def test_simhash_query(spark, tmp_path):
    """The registered query over the smallest table against a plain version."""
    docs = spark.read.parquet(f"{H.SMALL}/documents.parquet").select("doc_id", "text")
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in queries.op13_simhash(spark, H.SMALL).collect())
    assert got == sorted((i, f"{f:016x}", c) for i, f, c in plain_simhash([tuple(r) for r in docs.collect()]))


def test_simhash_long_text():
    """Shingles are counted in chunks; the result is that of the whole text."""
    rng = np.random.default_rng(9)
    text = " ".join(f"W{x}" for x in rng.integers(0, 300, 2 * simhash_anchors.CHUNK + 5))
    assert simhash_anchors.fingerprint(text.encode()) % (1 << 64) == plain_fingerprint(text)
    for text in ("", None, "one", "One TWO", "É a b", "a b c", "a b c d"):
        assert simhash_anchors.fingerprint(None if text is None else text.encode()) % (1 << 64) == plain_fingerprint(text)

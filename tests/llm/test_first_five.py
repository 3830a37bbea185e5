import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netquarry.llm import bpe, common, exact_dedup, jaccard_join, mixing, queries, toxicity
from netquarry.llm.components import connected
from tests.llm import helpers as H


def docs_of(spark, rows):
    return spark.createDataFrame([H.row(*r) for r in rows], H.SCHEMA)


def small(spark):
    return spark.read.parquet(f"{H.SMALL}/documents.parquet")


# exact dedup


def expected_groups(rows):
    groups = defaultdict(list)
    for n, (i, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append((i is None, i, n))
    return Counter((i, min(g)[1], len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i, _ in g), {k: min(g)[1] for k, g in groups.items()}


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.substring(exact_dedup.sha256(t), 1, 1), lambda t: F.lit(b"one")])
def test_dedup_awkward(spark, digest):
    docs = H.awkward_docs(spark)
    want, kept = expected_groups([(r[0], r[1]) for r in H.awkward()])
    got = exact_dedup.exact_dedup(docs, digest=digest, memtable=4).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sorted(str(r.keep_id) for r in got if r.kept) == sorted(map(str, kept.values()))
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    stay = exact_dedup.keep(docs, digest=digest)
    assert stay.columns == docs.columns
    assert sorted(str(r.doc_id) for r in stay.collect()) == sorted(map(str, kept.values()))


def test_dedup_small(spark):
    docs = small(spark)
    want, _ = expected_groups([(r.doc_id, r.text) for r in docs.collect()])
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.exact_dedup(docs).collect()) == want
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0
    assert exact_dedup.keep(docs.limit(0)).count() == 0


def test_lsm_filters_and_absorb(spark):
    rows = spark.range(500).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), "id", F.col("id").alias("uid"))
    runs = exact_dedup.flush(rows, memtable=64)
    held = [r.filter for r in runs.collect() if r.filter]
    assert len(held) >= 500 // 64
    digests = [bytes(r.digest) for r in rows.collect()]
    assert np.any([exact_dedup.may_hold(h, digests) for h in held], axis=0).all()
    other = [hashlib.sha256(f"x{i}".encode()).digest() for i in range(1000)]
    assert exact_dedup.may_hold(exact_dedup.bloom(digests), other).mean() < 0.05
    index = exact_dedup.absorb(exact_dedup.compact(runs), rows.withColumn("id", F.col("id") - 1))
    assert {(r.first_id, r.n) for r in index.collect()} == {(i - 1, 2) for i in range(500)}


def test_lsm_lookup(spark):
    """Segments of two repeated digests, filters folded to the least: every repeated digest is a hit, and with whole filters (of 64 bits) few others are."""
    rows = spark.range(4000).select(F.unhex(F.sha2((F.col("id") % 3000).cast("string"), 256)).alias("digest"), "id", F.col("id").alias("uid"))
    index = exact_dedup.compact(exact_dedup.flush(rows, memtable=300), segment=2)
    assert index.filter("filter is not null").count() >= 500
    own = rows.filter("id < 3000")
    for most, share in ((1 << 20, 0.1), (1, 1.0)):
        hit = exact_dedup.lookup(index, most)
        got = {r.id: r.hit for r in own.select("id", hit(F.col("digest")).alias("hit")).collect()}
        assert all(got[i] for i in range(1000)) and sum(got[i] for i in range(1000, 3000)) <= share * 2000
    held = exact_dedup.bloom([bytes(r.digest) for r in own.collect()])
    assert exact_dedup.may_hold(exact_dedup.folded(held, 3), [bytes(r.digest) for r in own.collect()]).all()


def test_dedup_ends_of_the_numbers(spark):
    """The greatest doc_id is one like any other; nulls come after it."""
    big = (1 << 63) - 1
    docs = docs_of(spark, [(big, "a b"), (None, "a  b"), (None, "only null"), (None, "only null"), (-big - 1, "x"), (big, "x")])
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect())
    want = {(big, big, 2, True): 1, (None, big, 2, False): 1, (None, None, 2, True): 1, (None, None, 2, False): 1, (-big - 1, -big - 1, 2, True): 1, (big, -big - 1, 2, False): 1}
    assert got == want
    assert Counter((r.doc_id, r.text.split()[0]) for r in exact_dedup.keep(docs).collect()) == Counter([(big, "a"), (None, "only"), (-big - 1, "x")])


def test_dedup_many_groups(spark, monkeypatch):
    """More groups than may be broadcast, and a hot one of a third of all rows."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 100)
    monkeypatch.setattr(common.bounded, "__defaults__", (100,))
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("text "), F.col("id") % 1500)).alias("text"), F.lit(1).alias("hit"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, kept = expected_groups(rows)
    for most in (exact_dedup.FILTER_BYTES, 1):
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.exact_dedup(docs, filter_bytes=most).collect()) == want
        stay = exact_dedup.keep(docs, filter_bytes=most)
        assert stay.columns == docs.columns and sorted(r.doc_id for r in stay.collect()) == sorted(kept.values())


# toxicity


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in queries.op9_toxicity(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 for i, r in got.items())
    known = [(got[r.doc_id].predicted, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(a == b for a, b in known) >= 0.93 * len(known)
    clean = [a for a, b in known if not b]
    assert sum(clean) <= 0.02 * len(clean)


def test_toxicity_awkward(spark):
    docs = H.awkward_docs(spark)
    none = toxicity.trained(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score for r in toxicity.scored(docs, none).collect()] == [0.5] * len(H.awkward())
    assert toxicity.keep(docs, toxicity.fit(["fine. words", "more"], [0, 0])).count() == len(H.awkward())
    texts = [f"fine words here. more {k}" for k in range(40)] + [f"fine words here. you gluzzbo{k}" for k in range(40)]
    model = toxicity.fit(texts, [0] * 40 + [1] * 40)
    rows = [(1, "fine words. a gluzzbat. end"), (2, "fine words here"), (3, None), (None, "gluzzbip")]
    frame = docs_of(spark, rows)
    scores = {r.doc_id: r.score for r in toxicity.scored(frame, model).collect()}
    assert scores[1] > 0.7 and scores[None] > 0.7 and scores[2] < 0.5 and scores[3] < 0.5
    kept = toxicity.keep(frame, model)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    assert [(r.doc_id, r.sentence) for r in toxicity.offending(frame, model).orderBy(F.col("doc_id").asc_nulls_last()).collect()] == [(1, 1), (None, 0)]
    assert toxicity.scored(frame.limit(0), model).count() == 0


def plain_fit(texts, labels, epochs, rate=0.25, ridge=2e-4):
    """The training written out: sentence by sentence, one feature after the other."""
    n, y = len(texts), np.array(labels)
    bags = [[sorted(set(re.findall(r"\w+", s))) for s in toxicity.sentences(t.lower())] for t in texts]
    counts = np.zeros((2, toxicity.SIZE))
    for bag, label in zip(bags, y, strict=True):
        for p in {p for s in bag for w in s for p in toxicity.features(w)}:
            counts[label, p] += 1
    odds = np.log((counts[1] + 0.5) / (y.sum() + 1)) - np.log((counts[0] + 0.5) / (n - y.sum() + 1))
    sure = odds - 2 * np.sqrt(1 / (counts[1] + 0.5) + 1 / (counts[0] + 0.5))
    w, bias, seen, seen_bias = np.where(sure > 1, np.minimum(odds, 6), 0.0), -8.0, np.full(toxicity.SIZE, 1e-8), 1e-8
    for _ in range(epochs):
        grad, total = np.zeros(toxicity.SIZE), 0.0
        for bag, label in zip(bags, y, strict=True):
            p = [1 / (1 + np.exp(-np.clip(bias + sum(w[f] for x in s for f in toxicity.features(x)), -30, 30))) for s in bag]
            whole = np.clip(1 - np.prod([1 - x for x in p]), 1e-9, 1)
            for s, x in zip(bag, p, strict=True):
                g = x * (-(1 - whole) / whole if label else 1.0)
                total += g
                for word in s:
                    np.add.at(grad, toxicity.features(word), g)
        grad, total = grad / n + ridge * w / n, total / n
        seen += grad * grad
        w = np.maximum(w - rate * grad / np.sqrt(seen), -0.3)
        seen_bias += total * total
        bias -= rate * total / np.sqrt(seen_bias)
    return w, bias


def test_toxicity_fit():
    """The flat arrays learn what the plain version learns."""
    rng = np.random.default_rng(3)
    vocabulary = [f"{a}{b}" for a in ("mild", "gross", "plain", "vile") for b in ("", "ly", "ness", "er")]
    texts = [". ".join(" ".join(rng.choice(vocabulary, 4)) for _ in range(int(rng.integers(1, 4)))) for _ in range(60)]
    labels = [int("vile" in t) for t in texts]
    model = toxicity.fit(texts, labels, epochs=4)
    w, bias = plain_fit(texts, labels, 4)
    assert np.allclose(model.weights, w, atol=1e-6) and np.isclose(model.bias, bias, atol=1e-6)


def test_toxicity_scores(spark):
    """Scores and worst sentences of a whole table, against each sentence scored by itself."""
    docs, labels = (spark.read.parquet(f"{H.SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.trained(docs, labels)
    got = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    place = lambda x: zlib.crc32(x.encode()) % toxicity.SIZE
    weight = lambda w: float(model.weights[[place(f"w{w}"), *(place(f"{k}{w[:k]}") for k in (3, 4, 5, 6) if len(w) >= k)]].sum())
    for r in docs.collect():
        z = [math.fsum([model.bias, *map(weight, set(re.findall(r"\w+", s)))]) for s in ([x for x in re.split(r"[.!?\n]+", (r.text or "").lower()) if x.strip()] or [""])]
        assert np.isclose(got[r.doc_id].score, 1 - np.prod([1 - 1 / (1 + np.exp(-x)) for x in z]), atol=1e-9) and got[r.doc_id].worst_sentence == int(np.argmax(z))


def test_toxicity_awkward_labels(spark):
    """Null, repeated and unknown labels and doc_ids; long texts are left out of the fit."""
    docs = H.awkward_docs(spark)
    labels = spark.createDataFrame([(1, 0), (1, 1), (3, None), (None, 1), (10, 0), (11, 0), (12, 1), (13, 0), (99, 1), (15, 7)], "doc_id long, toxic int")
    texts, marks = toxicity.sample(docs, labels, max_chars=50_000)
    assert marks == [1, 0, 0] and len(texts[0]) < 50_000
    assert toxicity.scored(docs, toxicity.trained(docs, labels)).count() == len(H.awkward())
    assert toxicity.sample(docs.limit(0), labels) == ([], [])


def test_noisy_or():
    model = toxicity.Model(np.zeros(toxicity.SIZE), 0.0)
    z = np.array([-1.0, 0.5, 2.0])
    assert np.isclose(model.score(z), 1 - np.prod(1 - 1 / (1 + np.exp(-z))))


# Jaccard join


@pytest.mark.parametrize("k,percent,part", [(3, 90, 192), (5, 80, 2), (1, 50, 3)])
def test_jaccard(spark, k, percent, part):
    for docs in (small(spark), H.awkward_docs(spark)):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        want = H.components(rows, k, percent)
        got = jaccard_join.jaccard_components(docs, k=k, percent=percent, part=part).collect()
        assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((i, len(H.shingles(t, k))) for i, t in rows)
        assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
        assert all(r.component_id is None for r in got if r.doc_id is None)


def test_jaccard_chains_and_splits(spark):
    """Chains of near copies, whose ends don't link, over parts of two members; one doc_id with two texts."""
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for _ in range(12):
        w = [f"t{x}" for x in rng.integers(0, 60, 40)]
        for _ in range(int(rng.integers(1, 9))):
            w[int(rng.integers(0, 40))] = f"t{rng.integers(0, 60)}"
            rows.append((n, " ".join(w)))
            n += 1
    rows.append((3, rows[-1][1]))
    docs = docs_of(spark, rows)
    sets = [(i, H.shingles(t, 2)) for i, t in rows]
    links = [(i, j) for n, (i, a) in enumerate(sets) for j, b in sets[:n] if 100 * len(a & b) >= 80 * len(a | b)]
    parent = {i: i for i, _ in rows}
    for _ in range(len(rows)):
        for i, j in links:
            parent[i] = parent[j] = min(parent[i], parent[j])
    got = jaccard_join.jaccard_components(docs, k=2, percent=80, part=2).collect()
    assert {r.doc_id: r.component_id for r in got} == parent
    kept = jaccard_join.keep(docs, k=2, percent=80)
    assert {r.doc_id for r in kept.collect()} == set(parent.values())
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0
    assert jaccard_join.keep(docs.limit(0)).count() == 0


@pytest.mark.parametrize("part", [192, 2])
def test_jaccard_links(spark, part):
    """Every link counts, also between parts of a group that its leader connects already."""
    rng = np.random.default_rng(6)
    base = [f"t{x}" for x in range(60)]
    rows = []
    for i in range(14):
        w = list(base)
        w[int(rng.integers(0, 60))] = f"u{i}"
        rows.append((i, " ".join(w)))
    rows += [(20, rows[3][1]), (21, rows[3][1]), (22, "other words"), (23, None)]
    for docs in (docs_of(spark, rows), H.awkward_docs(spark)):
        own = [(r.doc_id, H.shingles(r.text, 2)) for r in docs.collect()]
        want = Counter((i, sum(100 * len(a & b) >= 80 * len(a | b) for m, (j, b) in enumerate(own) if m != n and j is not None and a and b) if i is not None else 0) for n, (i, a) in enumerate(own))
        got = jaccard_join.jaccard_links(docs, k=2, percent=80, part=part).collect()
        assert Counter((r.doc_id, r.n_links) for r in got) == want


def test_jaccard_hot_group(spark, monkeypatch):
    """Near copies that share most of their tokens, more than a worker posts of a token, in parts that meet in several squares."""
    monkeypatch.setattr(jaccard_join, "SQUARE", 2)
    rng = np.random.default_rng(8)
    rows = []
    for i in range(90):
        w = [f"t{x}" for x in range(80)]
        w[int(rng.integers(0, 80))] = f"u{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, f"alone {i} " + " ".join(f"v{i}w{x}" for x in range(20))) for i in range(20)]
    own = [(i, H.shingles(t, 2)) for i, t in rows]
    want = {i: sum(100 * len(a & b) >= 90 * len(a | b) for j, b in own if j != i) for i, a in own}
    got = jaccard_join.jaccard_links(docs_of(spark, rows).coalesce(2), k=2, percent=90, part=8).collect()
    assert {r.doc_id: r.n_links for r in got} == want
    assert {r.doc_id: r.component_id for r in got} == H.components(rows, 2, 90)


def test_jaccard_shares():
    """No class of a shared token is lost, and a token's share doesn't grow with its classes."""
    rng = np.random.default_rng(9)
    shares, want, dealt = 4, defaultdict(set), defaultdict(list)
    for chunk in range(6):
        tokens, reps, sizes = [], [], []
        for rep in range(chunk * 300, chunk * 300 + (300 if chunk else 5)):
            own = np.unique(np.concatenate([[77, 2**48 - 1], rng.integers(1000, 9000, 3)]).astype(np.uint64))
            tokens.append(own)
            reps.append(np.full(len(own), rep, np.int64))
            sizes.append(np.full(len(own), len(own) + 5, np.int64))
            for t in own.tolist():
                want[t].add((rep, len(own) + 5))
        made = jaccard_join._packed_rows(tokens, reps, sizes, shares)
        for s, x in zip(*(c.to_pylist() for c in made.columns), strict=True):
            dealt[s].append(x)
    lengths = {s: sum(len(jaccard_join._unpacked(x)[0]) for x in xs) for s, xs in dealt.items()}
    assert max(n for s, n in lengths.items() if s >= 0) < 1800 * 3 / shares * 1.5
    assert max(len(xs) for s, xs in dealt.items() if s < 0) == 1
    batches = [pa.record_batch([pa.array([s] * len(xs), pa.int32()), pa.array(xs, pa.binary())], ["share", "packed"]) for s, xs in sorted(dealt.items())]
    got = defaultdict(set)
    for b in jaccard_join._shared_tokens(iter(batches)):
        for t, rep, size, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            assert n > 1 and (rep, size) not in got[t]
            got[t].add((rep, size))
    assert got == {t: x for t, x in want.items() if len(x) > 1}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(50)] + [(201, 200), (7, 7)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 150), 100), 200: 200, 201: 200}


def test_components_unsettled(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    with pytest.raises(RuntimeError, match="settle"):
        connected(path, rounds=1)
    assert {r.root for r in connected(path).collect()} == {0}


def test_overlaps():
    """Frequent and rare tokens, and those of one side only."""
    rng = np.random.default_rng(7)
    for n, m, width in ((5, 9, 40), (40, 30, 20), (3, 2, 5), (60, 60, 4000)):
        own, others = ([np.unique(rng.integers(0, width, int(rng.integers(1, 30)))).astype("u8") for _ in range(c)] for c in (n, m))
        assert np.array_equal(jaccard_join._overlaps(own, others), [[len(np.intersect1d(a, b)) for b in others] for a in own])
        same = jaccard_join._overlaps(own)
        want = np.array([[len(np.intersect1d(a, b)) for b in own] for a in own])
        assert np.array_equal(same[~np.eye(n, dtype=bool)], want[~np.eye(n, dtype=bool)])


# mixing


def test_exponent():
    shares = [0.7, 0.2, 0.1]
    a = mixing.exponent(shares, entropy=0.95)
    w = np.array(shares) ** a
    w /= w.sum()
    assert 0 < a < 1 and np.isclose(-(w * np.log(w)).sum(), 0.95 * np.log(3), atol=1e-6)
    b = mixing.exponent(shares, repeats=2.0)
    r = np.array(shares) ** b / shares
    assert np.isclose(r.max() / r.min(), 2.0)
    assert mixing.exponent(shares, entropy=0.1) == 1.0 and mixing.exponent([1.0], repeats=2.0) == 1.0


@pytest.mark.parametrize("options", [{"entropy": 0.97, "budget": 1.0}, {"repeats": 2.0}, {"entropy": 1.0, "budget": 0.3}])
def test_mixing_budgets(spark, options):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").when(F.col("doc_id") % 7 == 0, None).otherwise(F.col("source")))
    got = mixing.mixed(docs, block_tokens=3000, **options).collect()
    assert len(got) == docs.count()
    spent, have, longest, weight = Counter(), Counter(), Counter(), {}
    for r in got:
        spent[r.source] += r.tokens * r.copies
        have[r.source] += r.tokens
        longest[r.source] = max(longest[r.source], r.tokens)
        weight[r.source] = r.weight
    assert np.isclose(sum(weight.values()), 1)
    whole = options["budget"] * sum(have.values()) if "budget" in options else max(have[s] / weight[s] for s in have)
    for s in have:
        assert abs(spent[s] - weight[s] * whole) <= longest[s] + 1, s
    if "repeats" in options:
        assert min(r.copies for r in got) >= 1
        rates = [spent[s] / have[s] for s in have]
        assert max(rates) <= 2.05 * min(rates)
    kept = mixing.keep(docs, block_tokens=3000, **options)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.select("doc_id").collect()) == Counter({r.doc_id: r.copies for r in got if r.copies})


def test_mixing_awkward(spark):
    docs = H.awkward_docs(spark)
    got = mixing.mixed(docs, repeats=2.0).collect()
    assert len(got) == len(H.awkward()) and all(r.copies >= 1 for r in got)
    kept = mixing.keep(docs, repeats=2.0)
    assert kept.columns == docs.columns and kept.count() == sum(r.copies for r in got)
    assert mixing.mixed(docs.limit(0), repeats=2.0).count() == 0 and mixing.keep(docs.limit(0), entropy=0.9, budget=1.0).count() == 0
    first, second = (mixing.mixed(docs, repeats=2.0).orderBy(*mixing.order(F.lit(e))).select("doc_id").collect() for e in (0, 1))
    assert first != second and Counter(first) == Counter(second)


def _spark_hash(*values, seed=42):
    """xxhash64 of Spark: of (kind, value) one after the other, the hash so far as the next one's seed; a null leaves it as it is."""
    import xxhash

    for kind, v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v.encode() if kind == "str" else v.to_bytes(4 if kind == "int" else 8, "little", signed=True), seed & (1 << 64) - 1)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def plain_mixture(rows, entropy, whole, block_tokens, seed=0):
    """[(doc_id, source, pass, block)] in the mixture's order, from (doc_id, text, source): exponent by bisection, budgets, full passes, and the broken pass block by block and place by place."""
    tokens = [max(1, len([w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w])) for _, t, _ in rows]
    have = Counter()
    for (_, _, s), n in zip(rows, tokens, strict=True):
        have[s] += n
    low, high = 0.0, 1.0
    for _ in range(60):
        a = (low + high) / 2
        w = np.array([have[s] for s in have], float) ** a
        w /= w.sum()
        low, high = (a, high) if -(w * np.log(w)).sum() >= entropy * np.log(len(w)) else (low, a)
    w = np.array([have[s] for s in have], float) ** low
    budget = {s: round(x / w.sum() * whole * sum(have.values())) for s, x in zip(have, w, strict=True)}
    out = []
    for s in have:
        key = _spark_hash(("str", s))
        n_blocks = max(1, -(-have[s] // block_tokens))
        own = [(i, n, _spark_hash(("long", i), ("str", t), ("int", seed))) for (i, t, x), n in zip(rows, tokens, strict=True) if x == s]
        own = [(i, n, p, _spark_hash(("long", p)) % n_blocks) for i, n, p in own]
        full, left = divmod(budget[s], have[s])
        taken = [(e, r) for e in range(full) for r in own]
        for r in sorted(own, key=lambda r: (_spark_hash(("int", r[3]), ("int", -1), ("int", seed)), r[2])):
            if left > 0:
                taken.append((full, r))
                left -= r[1]
        out += [((_spark_hash(("long", key), ("int", e), ("int", b), ("int", seed)), _spark_hash(("long", p), ("int", e), ("int", seed))), (i, s, e, b)) for e, (i, n, p, b) in taken]
    return [x for _, x in sorted(out)]


@pytest.mark.parametrize("block_tokens", [40, 1 << 16])
def test_mixing_order(spark, block_tokens):
    """Passes, the documents of the broken pass, and the order of blocks and documents, against a plain version."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(["w"] * int(n)) or None, "abc"[int(x)]) for i, (n, x) in enumerate(zip(rng.integers(0, 40, 90), rng.choice(3, 90, p=[0.8, 0.15, 0.05]), strict=True))]
    docs = spark.createDataFrame([(*r, r[2] + "x") for r in rows], "doc_id long, text string, source string, place string")
    want = plain_mixture(rows, 0.9, 1.5, block_tokens)
    got = mixing.passes(docs, entropy=0.9, budget=1.5, block_tokens=block_tokens).collect()
    taken = sorted((r for r in got if r.position is not None), key=lambda r: r.position)
    assert [r.position for r in taken] == list(range(len(want)))
    assert [(r.doc_id, r.source, r.pass_no, r.block) for r in taken] == want
    assert {r.doc_id for r in got} == {r[0] for r in rows} and all(r.copies == 0 for r in got if r.position is None)
    kept = mixing.keep(docs, entropy=0.9, budget=1.5, block_tokens=block_tokens)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [x[0] for x in want]


def test_mixing_many_sources(spark):
    """The exponent of many sources is found as that of few."""
    groups = spark.range(12_000).select(F.col("id").alias("source"), (F.col("id") % 97 * 10 + 1).alias("tokens"))
    shares = [r.tokens for r in groups.collect()]
    for target in ({"entropy": 0.98, "repeats": None}, {"entropy": None, "repeats": 3.0}):
        assert np.isclose(mixing._solved(groups, **target), mixing.exponent(shares, **target), atol=1e-9)


def test_mixing_tokens(spark, tmp_path):
    """Shares are in tokens of the vocabulary, also of texts without blanks."""
    rows = [(i, "我们知道的事情" * 200, "zh") for i in range(5)] + [(10 + i, "some plain words of a text " * 20, "en") for i in range(5)] + [(20, None, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    enc = plain_encoding()
    got = {r.doc_id: r.tokens for r in queries.op7_mixing(spark, str(tmp_path)).collect()}
    assert got == {i: max(1, len(enc.encode_ordinary(t or ""))) for i, t, _ in rows}


# byte-level BPE


def plain_encoding():
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark):
    enc = plain_encoding()
    path, pattern = queries.tokenizer("byte_bpe_multi_50k.tiktoken"), queries.pre_tokens()
    for docs in (small(spark), H.awkward_docs(spark)):
        want = Counter()
        for r in docs.collect():
            ids = enc.encode_ordinary(r.text or "")
            want[(r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())] += 1
        for size in (1000, bpe.BLOCK_BYTES):
            assert Counter(map(tuple, bpe.encode_digests(docs, path, pattern, block_bytes=size).collect())) == want
        tokens = common.written(bpe.encode(docs, path, pattern, block_bytes=50_000), "t")
        assert Counter((r.doc_id, bytes(r.decoded).decode()) for r in bpe.decode(tokens, path).collect()) == Counter((r.doc_id, r.text or "") for r in docs.collect())
    assert bpe.encode(docs.limit(0), path, pattern).count() == 0


def test_bpe_ranges_of_shares(spark, monkeypatch):
    """Shares of more words than a worker should remember are cut, and give the same."""
    path, pattern = queries.tokenizer("byte_bpe_multi_50k.tiktoken"), queries.pre_tokens()
    docs = small(spark).unionByName(H.awkward_docs(spark).select(*small(spark).columns))
    want = Counter(map(tuple, bpe.encode_digests(docs, path, pattern, block_bytes=20_000).collect()))
    monkeypatch.setattr(bpe._run, "__defaults__", (40,))
    assert Counter(map(tuple, bpe.encode_digests(docs, path, pattern, block_bytes=20_000, shares=9).collect())) == want


def test_bpe_unknown_id(spark):
    bad = spark.createDataFrame([(1, [999_999])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="without bytes"):
        bpe.decode(bad, queries.tokenizer("byte_bpe_multi_50k.tiktoken")).collect()


# the pipeline, on what its stages leave


def test_pipeline(spark):
    import corpus_pipeline as P

    d = H.SMALL
    docs = small(spark)
    own = docs.columns
    seen = []
    for name, stage in P.STAGES:
        before = docs
        docs = common.written(stage(spark, docs, d), "test-stage")
        seen.append(docs.count())
        if name != "bpe":
            assert docs.columns == own
        if name == "ngram_jaccard":
            want = H.components([(r.doc_id, r.text) for r in before.collect()], 5, 80)
            assert {r.doc_id for r in docs.collect()} == set(want.values())
        if name == "exact_dedup":
            _, kept = expected_groups([(r.doc_id, r.text) for r in before.collect()])
            assert sorted(r.doc_id for r in docs.collect()) == sorted(kept.values())
    assert seen[0] >= seen[1] >= seen[2] and seen[3] == seen[4] >= seen[2]
    assert P.run(spark, d).count() == seen[-1]


def test_pipeline_awkward(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing columns: every stage against a plain version; then an empty table."""
    import corpus_pipeline as P

    docs = H.awkward_docs(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0) for i in (1, 2, 3, 11)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    own = docs.columns
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    enc = plain_encoding()
    for name, stage in P.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = common.written(stage(spark, docs, str(tmp_path)), "test-stage")
        rows = docs.collect()
        if name != "bpe":
            assert docs.columns == own
            after = [(r.doc_id, r.text) for r in rows]
        if name == "toxicity":
            assert Counter(after) == Counter(before)
        if name == "exact_dedup":
            assert Counter(map(str, (i for i, _ in after))) == Counter(map(str, expected_groups(before)[1].values()))
        if name == "ngram_jaccard":
            stay = set(H.components(before, 5, 80).values())
            assert Counter(after) == Counter(x for x in before if x[0] is None or x[0] in stay)
        if name == "mixing":
            n = Counter(after)
            assert n.keys() == set(before) and max(n.values()) <= 3
        if name == "bpe":
            want = Counter((i, len(ids := enc.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()) for i, t in before)
            assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in rows) == want
    docs = H.awkward_docs(spark).limit(0)
    for name, stage in P.STAGES:
        docs = common.written(stage(spark, docs, str(tmp_path)), "test-stage")
        assert docs.count() == 0 and (name == "bpe" or docs.columns == own)


def test_mixing_tiny_source(spark):
    """One short document beside two thousand others is taken many thousand times; its runs of passes are dealt out before they are made."""
    rows = [(i, "word " * 100, "big") for i in range(2000)] + [(2000, "tiny", "small"), (None, "", "small"), (2001, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    options = {"entropy": 0.95, "budget": 1.0}
    want = {r.doc_id: r.copies for r in mixing.mixed(docs, **options).collect()}
    assert want[2000] > 6 * mixing.RUN
    got = mixing.passes(docs, **options)
    each = got.filter("pass_no is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("pass_no").alias("passes"), F.max("pass_no").alias("last")).collect()
    assert {r.doc_id: r.n for r in each} == {i: n for i, n in want.items() if n} and all(r.n == r.passes == r.last + 1 for r in each)
    n = sum(want.values())
    assert got.agg(F.countDistinct("position"), F.min("position"), F.max("position")).first() == (n, 0, n - 1)
    assert mixing.keep(docs, **options).groupBy("doc_id").count().filter("count > 0").count() == sum(x > 0 for x in want.values())
    held = {r.doc_id: r.copies for r in mixing.mixed(docs, repeats=3.0, **options).collect()}
    assert held[2000] <= 4 and mixing.exponent([0.9, 0.1], entropy=0.99, repeats=1.0) > 0.999999
    rows = spark.createDataFrame([(1, 5, "a"), (2, 0, "a"), (3, 17, "a")], "place long, copies long, source string").selectExpr("*", "1L as key", "0 as block")
    plain = sorted([(p, k) for p, n in ((1, 5), (3, 17)) for k in range(n)] + [(2, None)], key=str)
    assert sorted([(r.place, r.pass_no) for r in mixing._each_copy(rows, 0, 17, run=2).collect()], key=str) == plain
    huge = spark.createDataFrame([(1, 3 << 40, "a")], "place long, copies long, source string").selectExpr("*", "1L as key", "0 as block")
    assert [r.pass_no for r in mixing._each_copy(huge.withColumn("copies", F.lit(5).cast("long")), 0, 3 << 20, run=1 << 10).collect()] == list(range(5))
    sized = spark.createDataFrame([("t", 1, 1), ("b", 5 << 40, 1)], "source string, tokens long, place long")
    drawn = mixing.plan(sized, "source", "tokens", entropy=0.95, budget=1.0)
    assert mixing.cuts(sized, drawn, block_tokens=1 << 45).agg(F.max("full")).first()[0] > 1 << 32

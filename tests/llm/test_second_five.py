import hashlib
import json
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from netquarry.llm import histogram_sort, pii, quality_rules, queries, sst, token_counts
from tests.llm import helpers as H


def small(spark):
    return spark.read.parquet(f"{H.SMALL}/documents.parquet")


def ids_and_texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


# quality rules


def plain_measures(text):
    text = text or ""
    w = H.words(text)
    g = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(g)
    covered = {i + k for i, x in enumerate(g) if n[x] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if H.words(x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_quality_measures(spark):
    for docs in (small(spark), H.awkward_docs(spark)):
        got = quality_rules.measured(docs).drop("host").collect()
        assert Counter(map(tuple, got)) == Counter((i, *plain_measures(t)) for i, t in ids_and_texts(docs))


def test_quality_repeats(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"a{x}" for x in rng.integers(0, 3, int(n)))) for i, n in enumerate(rng.integers(0, 60, 80))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    assert {r.doc_id: r.n_repeat_words for r in quality_rules.measured(docs).collect()} == {i: plain_measures(t)[4] for i, t in rows}


def test_quality_hosts(spark):
    """A host that fails throughout is rejected with its passing document, one of few documents is not; null hosts are judged by document."""
    good, bad = " ".join(f"w{i}" for i in range(30)), "too short"
    rows = [(1000 + i, good, f"h{i % 20}") for i in range(400)] + [(i, bad, "bad") for i in range(60)] + [(60, good, "bad"), (70, bad, "few"), (71, good, "few"), (80, good, None), (81, bad, None)]
    rows += [(90 + i, good, "hot") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert len(got) == len({r[0] for r in rows})
    assert not got[60].kept and not got[60].base_failed and got[71].kept and got[80].kept and not got[81].kept
    assert all(got[1000 + i].kept for i in range(400))
    mean, weight = quality_rules.prior(spark.createDataFrame([("a", 10, 5), ("b", 10, 5)], "host string, n long, f long"))
    assert mean == 0.5 and weight == float("inf")
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0
    assert quality_rules.quality_rules(H.awkward_docs(spark)).count() == len(H.awkward())


def test_quality_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet'")
    want = con.execute(queries.ORACLE["op1_quality_rules"])
    names = [c[0] for c in want.description]
    got = queries.op1_quality_rules(spark, d)
    assert sorted(names) == sorted(got.columns)
    assert Counter(map(tuple, got.select(*names).collect())) == Counter(want.fetchall())


# sharding


def check_shards(rows, got, n):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
    for s, own in shards.items():
        assert 0 <= s < n and sorted(r.slot for r in own) == list(range(len(own)))
    sizes = [sum(r.size for r in shards[s]) for s in range(n)]
    largest = max((r.size for r in got), default=0)
    assert not got or max(sizes) - min(sizes) <= 2 * largest + 0.002 * sum(sizes)
    return shards


@pytest.mark.parametrize("n", [1, 3, 8])
def test_shards(spark, n):
    for docs in (small(spark), H.awkward_docs(spark)):
        check_shards(ids_and_texts(docs), histogram_sort.shards(docs, n).collect(), n)
    assert histogram_sort.shards(small(spark).limit(0), n).count() == 0


def test_shards_hold_rows(spark, tmp_path):
    """The shards are written with texts and all columns, a folder each."""
    for k, docs in enumerate((small(spark), H.awkward_docs(spark).withColumnRenamed("rep", "shard"))):
        rows, shard, slot = histogram_sort.sharded(docs, 3, path=f"{tmp_path}/{k}")
        assert Counter(map(tuple, rows.select(*docs.columns).collect())) == Counter(map(tuple, docs.collect()))
        assert {p.name for p in (tmp_path / str(k)).iterdir() if p.is_dir()} == {f"{shard}={s}" for s in range(3)}
        where = {(r[shard], r[slot]): (r.doc_id, r.text) for r in rows.collect()}
        digests = [(r.shard, r.slot, r.doc_id, r.text_crc32) for r in histogram_sort.shards(docs, 3).collect()]
        assert len(where) == len(digests) and all(where[s, n][0] == i and zlib.crc32((where[s, n][1] or "").encode()) == c for s, n, i, c in digests)


def test_shards_hot(spark):
    """Two thirds are one text, half of those one doc_id; small groups stay whole."""
    rows = [(i if i % 2 else 0, "same text") for i in range(2000)] + [(10_000 + i, f"text {i // 4}") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = histogram_sort.shards(docs, 8).collect()
    shards = check_shards(rows, got, 8)
    where = defaultdict(set)
    for s, own in shards.items():
        for r in own:
            where[r.text_crc32].add(s)
    assert sum(len(x) > 1 for x in where.values()) <= 8


def test_splitters_are_exact(spark):
    rng = np.random.default_rng(1)
    keys = sorted((int(a), int(b)) for a, b in zip(rng.integers(-50, 50, 500), rng.integers(0, 1000, 500), strict=True))
    sizes = [int(x) for x in rng.integers(1, 100, 500)]
    df = spark.createDataFrame([(*k, s) for k, s in zip(keys, sizes, strict=True)], "a long, b long, size long")
    targets = [(sum(sizes) * k // 7, 0) for k in range(1, 7)]
    cuts = histogram_sort.splitters(df, [("a", -50, 51), ("b", 0, 1000)], "size", targets)
    for (t, _), c in zip(targets, cuts, strict=True):
        below = sum(s for k, s in zip(keys, sizes, strict=True) if k < (*c, *(0,) * (2 - len(c))))
        assert abs(below - t) <= 200


def test_many_splitters(spark):
    """50,000 targets, and rows dealt to parts by 5,000 cuts."""
    rows = spark.range(200_000).select((F.xxhash64("id")).alias("h"), F.col("id"), (F.col("id") % 7 + 1).alias("size")).persist()
    own = sorted((r.h, r.id, r.size) for r in rows.collect())
    total = sum(s for _, _, s in own)
    cuts = histogram_sort.splitters(rows, [("h", -(1 << 63), 1 << 63), ("id", 0, 200_000)], "size", [(total * k // 50_000, 8) for k in range(1, 50_000)])
    below = np.cumsum([0, *[s for _, _, s in own]])
    keys = [(h, i) for h, i, _ in own]
    import bisect

    for k, c in list(enumerate(cuts, 1))[::97]:
        assert abs(below[bisect.bisect_left(keys, (*c, *(0,) * (2 - len(c))))] - total * k // 50_000) <= 8
    some = sorted(cuts[::10])
    levels = [("h", -(1 << 63), 1 << 63), ("id", 0, 200_000)]
    got = rows.select("h", "id", histogram_sort.part_of(levels, some).alias("part")).filter("id % 50 = 0").collect()
    full = [(*c, *(0,) * (2 - len(c))) for c in some]
    assert all(r.part == bisect.bisect_right(full, (r.h, r.id)) for r in got)
    rows.unpersist()


def test_splitters_without_broadcast(spark, monkeypatch):
    """More open cells than may be broadcast: rows are summed by cell before they are joined."""
    rows = spark.range(3000).select((F.col("id") % 40 - 20).alias("a"), F.xxhash64("id").alias("b"), F.lit(1).alias("size"))
    levels, targets = [("a", -20, 20), ("b", -(1 << 63), 1 << 63)], [(3000 * k // 90, 0) for k in range(1, 90)]
    want = histogram_sort.splitters(rows, levels, "size", targets)
    monkeypatch.setattr("netquarry.llm.common.BROADCAST_ROWS", 3)
    assert histogram_sort.splitters(rows, levels, "size", targets) == want


# personal data


def plain_base(text):
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.findall("[0-9]", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_base_spans_like_patterns():
    rng = np.random.default_rng(0)
    parts = ["a@b.co", "@", ".", "+1 (23) 456-7890", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", " ", "é", "x..y@z-.q.", "+", "00000000000001.2.3.4", "a@b", "-", "12", "%+@a.b.c@d.e", "0" * 30]
    for _ in range(4000):
        text = "".join(parts[k] for k in rng.integers(0, len(parts), int(rng.integers(1, 9))))
        assert ",".join(f"{k}:{a}:{b}" for a, b, k in pii.base_spans(text)) == plain_base(text), text
    for long in ("x" * 200_000, "1" * 200_000, "a@" * 100_000, "1." * 100_000, "+1" * 100_000, "+1" + " " * 200_000):
        pii.base_spans(long)


def test_pii_rows(spark):
    for docs in (spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), H.awkward_docs(spark)):
        got = pii.found(docs).collect()
        want = []
        for i, t in ids_and_texts(docs):
            base = plain_base(t)
            want.append((i, *(base.count(k + ":") for k in pii.KINDS), hashlib.sha256(base.encode()).hexdigest(), base))
        own = [(*r[:6], ",".join(x for x in r.spans.split(",") if not x.startswith("term"))) for r in got]
        assert Counter(own) == Counter(want)
    assert pii.found(docs.limit(0)).count() == 0


def test_pii_terms(spark):
    """A nickname that only stands beside one address is found and goes; common words beside it stay."""
    filler = [f"the usual words go here {i} and there, write to me at noon or some way" for i in range(200)]
    rows = [(i, f"{t} write to zorblax at zor@mail.example or the usual way {i}") for i, t in enumerate(filler[:20])] + [(100 + i, t) for i, t in enumerate(filler)]
    rows += [(500, "+44 20 7946 0958 the usual words"), (501, "the usual +44 20 7946 0958 and there"), (502, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.found(docs).collect()}
    for i in range(20):
        t = rows[i][1]
        a = t.index("zorblax")
        assert f"term:{a}:{a + 7}" in got[i].spans and f"email:{t.index('zor@')}" in got[i].spans
        assert "usual" not in [t[int(a) : int(b)] for k, a, b in (x.split(":") for x in got[i].spans.split(","))]
    assert all(not got[100 + i].spans for i in range(200)) and got[500].n_phone == 1
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert "zorblax" not in clean[3] and "[email]" in clean[3] and "the usual way 3" in clean[3] and clean[105] == filler[5] and clean[502] == ""
    assert pii.sanitised_text("I am Bob 12 ok", "term:5:8,term:9:11", [0.85, 0.99]) == "I am [name]  ok"


def test_pii_terms_anywhere(spark):
    """A telling term is marked far from the entity and in documents without it; terms are counted by document."""
    far = "some words that all of these texts have here and there in between"
    rows = [(i, f"{far} again {i}") for i in range(600)]
    rows += [(700 + i, f"zorblax {far} zor@mail.example {i % 40}" if i % 2 else f"zor@mail.example {far} zorblax all Zorblax {i % 40}") for i in range(44)] + [(900, f"{far} again zorblax")]
    got = {r.doc_id: r.spans for r in pii.found(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        want = sorted(m.span() for m in re.finditer("[zZ]orblax", t))
        assert [(int(a), int(b)) for k, a, b in (x.split(":") for x in got[i].split(",") if x) if k == "term"] == want


def test_pii_rare_words_stay(spark):
    """A word of one document, or of copies of one, tells nothing; a nickname that a dozen different documents have beside an address goes, removed from more of them."""
    usual = "words that all of these texts have"
    rows = [(i, f"{usual} {i}") for i in range(2000)]
    rows += [(3000, f"zorblax wrote {usual} twice zor@mail.example")] + [(3001 + i, f"quux {usual} +44 20 7946 0958") for i in range(50)]
    rows += [(4000 + i, f"nick{i % 2} {usual} rare{i} nick{i % 2}@home.example") for i in range(24)] + [(5000 + i, f"often {usual} rarely{i} one@home.example") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.found(docs).collect()}
    terms = {i: [t[int(a) : int(b)] for k, a, b in (x.split(":") for x in got[i].spans.split(",") if x) if k == "term"] for i, t in rows}
    assert not any(x for i, x in terms.items() if i < 4000)
    assert all(terms[4000 + i] == [f"nick{i % 2}"] and got[4000 + i].n_generalised == 1 for i in range(24))
    assert all(terms[5000 + i] == ["often"] and got[5000 + i].n_removed == 1 for i in range(60))
    touched = sum(r.n_generalised + r.n_removed for r in got.values())
    assert touched / sum(r.n_email + r.n_phone for r in got.values()) < 1


def test_pii_many_in_one_text(spark):
    """A text of a hundred thousand addresses and as many terms, beside a few that are not, takes no pairs; copies of parts of it are pairs of classes."""
    import time

    text = " ".join(f"user{i}x at a{i}@b.co" for i in range(100_000))
    half = " ".join(f"user{i}x at a{i}@b.co" for i in range(30_000))
    docs = spark.createDataFrame([(text,), ("nothing here",), *((f"{half} {k}",) for k in range(8)), *((f"plain text {k}",) for k in range(300))], "text string")
    start = time.perf_counter()
    got = {r.term: r.share for r in pii.telling(docs, discloses=0.5).collect()}
    assert time.perf_counter() - start < 120
    p = np.exp(pii.lower_bound(np.array([9.0]), np.array([9.0])))[0]
    assert len(got) == 30_001 - (pii._hash("at") not in got) and np.isclose(got[pii._hash("user7x")], np.log(p * 310 / 9) / np.log(310 / 9))


def plain_bound(x, n):
    """Logarithm of the lower bound, by bisection on the share."""
    kl = lambda q, p: sum(a * np.log(a / b) for a, b in ((q, p), (1 - q, 1 - p)) if a > 0)
    low, high = 1e-300, x / n
    for _ in range(3000):
        mid = (low * high) ** 0.5 if high > 2 * low else (low + high) / 2
        low, high = (mid, high) if n * kl(x / n, mid) > -np.log(pii.CHANCE) else (low, mid)
        if low == high or mid in (low, high) and high - low < 1e-15 * high:
            break
    return np.log(high)


def test_pii_bound():
    rows = [(1, 1), (2, 2), (1, 2), (5, 9), (40, 40), (39, 40), (3, 1000), (10**6, 10**7), (10**9, 10**9)]
    got = pii.lower_bound(np.array([x for x, _ in rows]), np.array([n for _, n in rows]))
    assert np.allclose(got, [plain_bound(x, n) for x, n in rows], rtol=1e-6, atol=1e-9)
    for own, total in ((3, 10**4), (20, 10**5), (5, 10**9)):
        need = pii.least_together(own, total)
        shares = [1 + pii.lower_bound(np.array([x]), np.array([x]))[0] / np.log(total / own) for x in (need - 1, need)]
        assert shares[1] >= pii.DISCLOSES - 1e-9 and (shares[0] < pii.DISCLOSES or need == 2)


def plain_telling(texts, discloses):
    """{term: share}, by counting all pairs; equal texts with entities are one document."""
    own, docs, both = Counter(), Counter(), Counter()
    held = [t for t in texts if t and pii.base_spans(t)]
    kept = [t for t in texts if not t or not pii.base_spans(t)] + sorted(set(held))
    n = len(kept)
    for t in kept:
        spans = pii.base_spans(t or "")
        entities = {f"{k}:{t[a:b].lower()}" for a, b, k in spans}
        terms = {t[a:b].lower() for a, b in pii.outside(t or "", spans)}
        own.update(entities)
        docs.update({w.lower() for w in re.findall(r"\w+", t or "")})
        both.update((e, w) for e in entities for w in terms)
    shares = defaultdict(float)
    for (e, w), x in both.items():
        if own[e] < n and x > 1:
            shares[w] = max(shares[w], 1 + plain_bound(x, docs[w]) / np.log(n / own[e]))
    return {w: x for w, x in shares.items() if x >= discloses - 1e-12}


@pytest.mark.parametrize("everywhere", ["", " all@every.where"])
def test_pii_telling(spark, everywhere):
    """Shares of terms against all pairs counted, also with an address that every document has."""
    rng = np.random.default_rng(9)
    texts = []
    for _ in range(700):
        who = [i for i in range(6) if rng.random() < 0.04]
        texts.append(" ".join(f"w{x}" for x in rng.zipf(1.4, 12) % 60) + "".join(f" u{i}@x.co" + f" nick{i}" * (rng.random() < 0.9) + f" more{i}" * (i % 2) for i in who) + everywhere)
    texts += [x for x in texts if "@" in x][:20] + [texts_none for texts_none in ([None] if not everywhere else [])]
    for discloses in (0.3, 0.5, 0.7):
        want = {pii._hash(w): x for w, x in plain_telling(texts, discloses).items()}
        got = {r.term: r.share for r in pii.telling(spark.createDataFrame([(t,) for t in texts], "text string"), discloses=discloses).collect()}
        assert got.keys() == want.keys() and all(np.isclose(got[w], want[w]) for w in want) and len(want) > 2


def test_pii_sanitised_rows(spark):
    """Rows with one doc_id are sanitised each by itself, and as the reported replacements say."""
    usual = [(100 + i, f"the usual words go here and there {i % 7}") for i in range(60)]
    rows = [(1, "write a@b.co now"), (1, "hello wide world"), (None, "zorblax at a@b.co"), (None, None), (2, "zorblax again"), *usual]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, spans string, row int")
    clean = Counter((r.doc_id, r.text) for r in pii.sanitised(docs).collect())
    assert sum(clean.values()) == len(rows) and clean[(1, "hello wide world")] == 1 and clean[(None, "")] == 1 and all(clean[r] for r in usual)
    assert any(i == 1 and "[email]" in t for i, t in clean)
    own = {(r.doc_id, r.base_sha256, r.spans): r for r in pii.found(docs).collect()}
    assert all(r.n_generalised + r.n_removed == r.spans.count("term:") for r in own.values())
    texts = Counter((r.doc_id, pii.replaced_text(t, r.replaced)) for r in pii.found(docs).collect() for i, t in rows if i == r.doc_id and t and i is not None and i != 1)
    assert all(clean[x] for x in texts)


def test_pii_places():
    """Words by search, against going through all of them."""
    rng = np.random.default_rng(4)
    words = ["ab", "a", "a_b", "ba", "é", "x9", "aa"]
    for _ in range(500):
        text = "".join(str(x) for x in rng.choice([*words, " ", " ", "-", "a", "\u0307", "_"], 14))
        spans = sorted((int(a), int(a) + int(n), "ip") for a, n in zip(rng.integers(0, len(text) + 1, 2), rng.integers(1, 4, 2), strict=True))
        some = set(words[:4])
        assert pii.places(text, [*some], spans) == [(x, y, text[x:y]) for x, y in pii.outside(text, spans) if text[x:y] in some], text


def test_pii_long_text():
    """A hundred thousand addresses in one text take seconds."""
    import time

    text = "mail me at a@b.co or " * 100_000
    start = time.perf_counter()
    spans = pii.base_spans(text)
    assert len(spans) == 100_000 and sum(1 for _ in pii.outside(text, spans)) == 400_000
    assert len(pii.places(text, ["mail", "or", "b", "nothing"], spans)) == 200_000 and time.perf_counter() - start < 20


# sorted-string tables


def plain_ids(texts):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return [[*e.ids, 2] for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("shard_bytes", [5_000, 48 << 20])
def test_sst(spark, shard_bytes):
    for docs in (small(spark), H.awkward_docs(spark)):
        rows = ids_and_texts(docs)
        ids = plain_ids([t or "" for _, t in rows])
        folder, manifest = sst.write_shards(docs, queries.tokenizer("byte_bpe_50k.json"), queries.pre_tokens(), 2, shard_bytes=shard_bytes)
        got = sst.read_back(folder, manifest).orderBy("start").collect()
        assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), x in zip(rows, ids, strict=True))
        keys = [(r.doc_id is None, r.doc_id or 0) for r in got]
        assert keys == sorted(keys)
        assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
        if shard_bytes == 5_000:
            assert manifest.count() > 3
            readers = [sst.open_shard(folder, r.file) for r in manifest.collect()]
            for (i, _), x in list(zip(rows, ids, strict=True))[:40]:
                if i is not None:
                    assert x in [y.tolist() for r in readers for y in r.get(i)]
    assert sst.read_back(*sst.write_shards(docs.limit(0), queries.tokenizer("byte_bpe_50k.json"), queries.pre_tokens(), 2)).count() == 0


def test_sst_parts_and_files(spark):
    """Few parts write several files each, in the order of keys; starts run on through all of them."""
    docs = small(spark)
    folder, manifest = sst.write_shards(docs, queries.tokenizer("byte_bpe_50k.json"), queries.pre_tokens(), 2, shard_bytes=4_000, most_parts=3)
    files = manifest.orderBy("shard").collect()
    assert [r.shard for r in files] == list(range(len(files))) and len(files) > 12 and len({r.file.split("-")[0] for r in files}) <= 3
    assert [r.start for r in files] == [sum(x.n_ids for x in files[:k]) for k in range(len(files))]
    got = [r.doc_id for r in sst.read_back(folder, manifest).orderBy("start").collect()]
    assert got == sorted(got) and len(got) == docs.count()
    assert [sst.doc_of(k)[0] for r in files for k, _ in sst.open_shard(folder, r.file)] == got


def test_sst_sparse_vocabulary(tmp_path):
    """The width of an id goes by the greatest one, and by the end id, not by their number."""
    import json

    from tokenizers import Tokenizer, models

    Tokenizer(models.WordLevel({"a": 0, "b": 70_000}, unk_token="a")).save(str(tmp_path / "sparse.json"))
    Tokenizer(models.WordLevel({"a": 0, "b": 7}, unk_token="a")).save(str(tmp_path / "small.json"))
    assert len(json.loads((tmp_path / "sparse.json").read_text())["model"]["vocab"]) == 2
    kinds = [sst.Encoder(str(tmp_path / f), queries.pre_tokens(), end).kind.itemsize for f, end in (("sparse.json", 2), ("small.json", 2), ("small.json", 65_535), ("small.json", 65_536))]
    assert kinds == [4, 2, 2, 4]
    assert np.frombuffer(sst.Encoder(str(tmp_path / "sparse.json"), queries.pre_tokens(), 2)(["b"])[0], "<u4").tolist() == [70_000]


def test_sst_special_tokens(spark):
    """A special token's string is its id, as the library has it, wherever it stands."""
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y it's", "<|endoftext| >", "plain text <|", " <|endoftext|>\n\n z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sst.read_back(*sst.write_shards(docs, queries.tokenizer("byte_bpe_50k.json"), queries.pre_tokens(), 2)).collect()
    want = plain_ids(texts)
    assert want[0] == [64, 220, 50256, 275, 2]
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in got} == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(want)}


def test_sst_ends_of_the_numbers(spark):
    """The least and the greatest doc_id are like any other, and nulls come after them."""
    big = (1 << 63) - 1
    docs = spark.createDataFrame([(None, "null text"), (big, "great"), (-big - 1, "least"), (None, "null"), (0, "")], "doc_id long, text string")
    for size in (1, 48 << 20):
        folder, manifest = sst.write_shards(docs, queries.tokenizer("byte_bpe_50k.json"), queries.pre_tokens(), 2, shard_bytes=size)
        got = sst.read_back(folder, manifest).orderBy("start").collect()
        assert [r.doc_id for r in got] == [-big - 1, 0, big, None, None]
        assert [sum(len(sst.open_shard(folder, r.file).get(i)) for r in manifest.collect()) for i in (big, None, -big - 1, 5)] == [1, 2, 1, 0]


def test_sst_lookup():
    docs = [(i, list(range(i % 7))) for i in range(-300, 3000, 3)]
    r = sst.in_memory(docs, block_bytes=200)
    assert len(r.index) > 20 and [(sst.doc_of(k)[0], x.tolist()) for k, x in r] == docs
    for i, ids in docs[::50]:
        assert [x.tolist() for x in r.get(i)] == [ids]
    missing = [i for i in range(-300, 3000) if (i + 300) % 3]
    assert not any(r.get(i) for i in missing[::20]) and sum(map(r.may_hold, missing)) < 0.05 * len(missing)
    with pytest.raises(ValueError, match="order"):
        sst.in_memory([(2, []), (1, [])])


# token counts


def plain_count(vocabulary, word):
    n, k = 0, 0
    while k < len(word):
        k += max((j for j in range(1, len(word) - k + 1) if word[k : k + j] in vocabulary), default=1)
        n += 1
    return n


def test_longest_match_automaton():
    rng = np.random.default_rng(2)
    for _ in range(300):
        pieces = {bytes(rng.integers(97, 100, int(n)).astype(np.uint8)) for n in rng.integers(1, 7, int(rng.integers(1, 12)))}
        a = token_counts.LongestMatch(pieces)
        for _ in range(30):
            w = bytes(rng.integers(97, 101, int(rng.integers(0, 25))).astype(np.uint8))
            assert a.count(w) == plain_count(pieces, w), (pieces, w)


@pytest.mark.parametrize("whole", [True, False])
def test_word_pieces(whole):
    """Marked pieces within words, and words that can't be cut, against greedy matching."""
    rng = np.random.default_rng(12)

    def plain(pieces, word):
        n, k = 0, 0
        while k < len(word):
            mark = b"##" if k else b""
            size = max((j for j in range(1, len(word) - k + 1) if mark + word[k : k + j] in pieces), default=0)
            if not size and whole:
                return 1
            n, k = n + 1, k + max(1, size)
        return n

    for _ in range(300):
        body = [bytes(rng.integers(97, 100, int(n)).astype(np.uint8)) for n in rng.integers(1, 6, int(rng.integers(1, 14)))]
        pieces = {(b"##" if rng.random() < 0.6 else b"") + x for x in body}
        a = token_counts.LongestMatch(pieces, continuation=b"##", whole=whole)
        for _ in range(30):
            w = bytes(rng.integers(97, 101, int(rng.integers(0, 20))).astype(np.uint8))
            assert a.count(w) == plain(pieces, w), (pieces, w)


def test_token_count_is_linear():
    """Steps over links are at most one for each byte, also where the vocabulary leads far before it fails."""
    a = token_counts.LongestMatch({b"a" * 2000 + b"b", b"a"}, whole=True)

    class Counted(list):
        n = 0

        def __getitem__(self, k):
            Counted.n += 1
            return list.__getitem__(self, k)

    a.link = Counted(a.link)
    word = b"a" * 1999 + b"c"
    assert a.count(word) == 1 and a.count(b"a" * 50_000) == 50_000 and Counted.n <= 52_000


def test_token_counts(spark):
    import regex

    from netquarry.llm import bpe

    path, split = queries.tokenizer("byte_bpe_50k.tiktoken"), regex.compile(queries.pre_tokens())
    vocabulary = bpe.ranks(path)
    longest = max(map(len, vocabulary))

    def plain(word):
        n = k = 0
        while k < len(word):
            k += next(j for j in range(min(longest, len(word) - k), 0, -1) if word[k : k + j] in vocabulary)
            n += 1
        return n

    for docs in (small(spark), H.awkward_docs(spark)):
        want = Counter((i, len(w := split.findall(t or "")), sum(plain(x.encode()) for x in w)) for i, t in ids_and_texts(docs))
        assert Counter(map(tuple, token_counts.token_counts(docs, path, queries.pre_tokens()).collect())) == want
    assert token_counts.token_counts(docs.limit(0), path, queries.pre_tokens()).count() == 0


def test_fast_splitting():
    import regex

    from netquarry.llm import pretokens

    assert queries.pre_tokens() == pretokens.KNOWN
    slow, fast = regex.compile(pretokens.KNOWN).findall, pretokens.splitter(pretokens.KNOWN)
    rng = np.random.default_rng(4)
    chars = [chr(k) for k in range(pretokens.BELOW)] + list(" \n\t'sdlmretv09aé") * 12
    for k in range(4000):
        text = "".join(chars[i] for i in rng.integers(0, len(chars), 40)) + ("\u0420" if k % 9 == 0 else "")
        assert fast(text) == slow(text), repr(text)


def test_registered():
    import __spark_entry__ as e

    names = list(e.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names if re.match(r"op\d", n)) == list(range(1, 11)) and "pipeline" in names
    assert set(e.oracle_sql()) <= set(names)
    assert json.dumps(sorted(names))

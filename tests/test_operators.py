"""Operators on hand-made rows: what SQL proxies don't reach."""

import datetime
import json
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from netquarry import schemas
from netquarry.functions import exprs as X
from netquarry.operators import chat, evaluate, features, integrate, labels, models, monitor, quality, split
from netquarry.plans import two_stage
from netquarry.sources import paged, readers, remote, sinks
from netquarry.streaming import scoring


def test_vocabularies(spark):
    assert len(schemas.TOP) == 20 and len(schemas.sub_columns()) == 48 and set(schemas.RENAMED.values()) <= {*schemas.TOP, *schemas.sub_columns()}
    assert schemas.categories(spark).count() == 48


@pytest.mark.parametrize("raw,want", [("7922", 7922), ("AS7922", 7922), ("as7922", 7922), ("  AS7922  ", 7922), ("7922.0", 7922), ("AS4294967295", 4294967295), ("0", 0), ("x", None), ("", None), (None, None), ("AS", None), ("12 3", None)])
def test_keys(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "k string").select(X.normalized_key(F.col("k"))).first()[0] == want
    assert spark.createDataFrame([(7922.9,)], "k double").select(X.normalized_key(F.col("k"))).first()[0] == 7922


def test_expressions(spark):
    df = spark.createDataFrame([("AS174 Cogent Inc", "//a.b", 3, 0)], "org string, domain string, n int, d int")
    r = df.select(X.organisation(F.col("org")), X.website(F.lit(""), F.col("domain")), X.ratio(F.col("n"), F.col("d")), X.as_flag(F.lit(" True ")), X.sanitised(F.lit("a b/c")), X.jaccard(F.array(), F.array())).first()
    assert tuple(r) == ("Cogent Inc", "https://a.b", 0.0, True, "a_b_c", 1.0)
    urls = {"http://a.com": True, "https://localhost:80/x": True, "ftp://a.com": False, "http://a": False, "HTTP://A.CO.UK/?q": True, "http://1.2.3.4": True}
    got = {r[0]: r[1] for r in spark.createDataFrame([(u,) for u in urls], "u string").select("u", X.valid_url(F.col("u"))).collect()}
    assert got == urls


def record(asn):
    return {
        "asn": asn, "asnName": "COGENT", "rank": 10, "organization": {"orgId": "o", "orgName": "Cogent"}, "cliqueMember": True, "seen": True, "longitude": -77.0, "latitude": 38.9, "country": {"iso": "US", "name": "United States"},
        "cone": {"numberAsns": 15000, "numberPrefixes": 50000, "numberAddresses": 1000000}, "asnDegree": {"provider": 5, "peer": 100, "customer": 500, "total": 605}, "announcing": {"numberPrefixes": 1000, "numberAddresses": 50000},
    }


def test_sources_to_features(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text("\n".join(json.dumps(record(a)) for a in (174, 15169)))
    (tmp_path / "net.json").write_text(json.dumps({"net": {"data": [{"asn": 174, "name": "old"}, {"asn": 174, "name": "Cogent", "website": "http://c.com", "info_type": "NSP", "info_scope": "Global", "info_unicast": True}, {"name": "no key"}]}}))
    (tmp_path / "pop.csv").write_text("ASN,Name,CC,RIR,Cust_cone_ASN,Cust_cone_pfx,Cust_cone_addr\nAS174,Cogent,US,ARIN,12000,,900000\nAS7,Seven,DE,RIPE NCC,1,2,3\nzz,Bad,,,,,\n")
    (tmp_path / "info.json").write_text(json.dumps({"metadata": {"n": 3}, "data": {"174": {"org": "AS174 Cogent", "domain": "c.com"}, "9": {"org": "AS9 Nine", "name": "Nine", "domain": "n.io", "country": "FR"}, "5": {"error": "timeout", "asn": 5}}}))
    rank, net, pop, info = readers.read_ranking(spark, str(tmp_path / "r.jsonl")), readers.read_network_dump(spark, str(tmp_path / "net.json")), readers.read_population(spark, str(tmp_path / "pop.csv")), readers.read_info(spark, str(tmp_path / "info.json"))
    assert [r["name"] for r in net.collect()] == ["Cogent"] and {r["asn"] for r in pop.collect()} == {174, 7} and {r["asn"] for r in info.collect()} == {174, 9}
    assert pop.filter("asn = 174").first()["customer_cone_prefixes"] is None
    probe = spark.createDataFrame([(174,), (15169,), (7,), (9,), (1,)], "asn bigint")
    got = {r["asn"]: r for r in integrate.entities(probe, {"asrank": rank, "peeringdb": net, "aspop": pop, "ipinfo": info}).collect()}
    assert set(got) == {174, 15169, 7, 9} and got[7]["organization_name"] == "Seven" and got[9]["website"] == "https://n.io" and got[9]["organization_name"] == "Nine" and got[174]["website"] == "http://c.com"
    ents = integrate.entities(probe, {"asrank": rank, "peeringdb": net, "aspop": pop, "ipinfo": info})
    vocab = features.vocabulary(ents)
    f = {r["asn"]: r for r in features.features(ents, vocab).collect()}
    a = f[174]
    assert (a["asrank_cone_density"], a["asrank_peer_customer_ratio"], a["asrank_provider_customer_ratio"], a["asrank_announce_efficiency"]) == (20, 0.2, 0.01, 50) and math.isclose(a["asrank_cone_size_log"], math.log(15001))
    assert a["peeringdb_type_nsp"] == 1 and a["asrank_degree_transit"] == 0 and f[9]["asrank_rank"] is None and f[7]["peeringdb_has_website"] is None and f[7]["aspop_rir_ripe"] == 1
    assert {r["asn"]: r["name"] for r in integrate.described(ents).collect()}[15169] == "Cogent"


def test_keyed_json_and_labels(spark, tmp_path):
    (tmp_path / "k.json").write_text(json.dumps({"174": {"name": "a", "info": True}, "AS9": {"name": "b"}}))
    got = readers.read_keyed_json(spark, str(tmp_path / "k.json"), "name string, info boolean")
    assert {tuple(r) for r in got.collect()} == {(174, "a", True), (9, "b", None)}
    assert readers.read_keyed_json(spark, str(tmp_path / "none.json"), "name string").count() == 0
    (tmp_path / "l.csv").write_text("ASN , name, Access ,IXP\nAS1,x,1,\n2,y,bad,1.0\n")
    assert {tuple(r) for r in readers.read_labels(spark, str(tmp_path / "l.csv")).collect()} == {(1, "x", 1, 0), (2, "y", 0, 1)}
    (tmp_path / "d.csv").write_text("asn,rank\n1,5\n2,6\nAS1,7\n")
    assert {tuple(r) for r in readers.read_keyed_csv(spark, str(tmp_path / "d.csv"), kinds={"rank": "bigint"}).collect()} == {(1, 7), (2, 6)}
    (tmp_path / "m.txt").write_text("====\nmacro f1: 0.5\nnone: None\nLabel A\n")
    assert [tuple(r) for r in readers.read_metrics(spark, str(tmp_path / "m.txt")).collect()] == [("macro f1", 0.5)]
    with pytest.raises(ValueError):
        readers.read_entities(spark, str(tmp_path / "d.csv"))


def test_predictions_files(spark, tmp_path):
    one = [{"asn": 1, "organization_name": "x", "tags": ["A"], "confidence_scores": {"A": 0.9}, "model_used": "m"}]
    for k, text in enumerate((one, {"classifications": one})):
        (tmp_path / f"{k}.json").write_text(json.dumps(text))
        assert readers.read_predictions_json(spark, str(tmp_path / f"{k}.json")).first()["tags"] == ["A"]
    (tmp_path / "p.csv").write_text('asn,organization_name,tags,confidence_A,confidence_B,model_used\n1,x,"A, B",0.5,,m\n')
    r = readers.read_predictions_csv(spark, str(tmp_path / "p.csv")).first()
    assert r["tags"] == ["A", "B"] and r["confidence_scores"] == {"A": 0.5}


def test_release(spark, tmp_path):
    for d in ("labels", "features", "predictions/toplevel", "splits"):
        (tmp_path / d).mkdir(parents=True)
    labels.ensured(spark.createDataFrame([(1,), (2,)], "asn bigint"), list(schemas.TOP)).toPandas().to_parquet(tmp_path / "labels/toplevel.parquet")
    (tmp_path / "features/a.csv").write_text("asn,name\n1,x\n2,\n")
    (tmp_path / "features/b.csv").write_text("asn,name,size\n2,late,5\n3,y,6\n")
    (tmp_path / "splits/assignments.csv").write_text("asn,split\n1,train\n2,val\n")
    r = readers.Release(spark, str(tmp_path))
    assert {tuple(x) for x in r.features().collect()} == {(1, "x", None), (2, None, 5), (3, None, 6)}
    assert r.problems() == [] and r.split("train").count() == 1
    assert readers.Release(spark, str(tmp_path / "none")).problems()


def test_paged_and_fetched(spark):
    source = paged.paged_source("numbers", "n long", lambda offset, first: [(k,) for k in range(offset, min(offset + first, 25))], 25, 10)
    spark.dataSource.register(source)
    assert spark.read.format("numbers").load().count() == 25

    def get(k):
        if k == 3:
            raise OSError("down")
        return (404, "") if k == 2 else (200, f"body {k}")

    got = paged.fetched(spark.createDataFrame([(1,), (2,), (3,)], "asn long"), "asn", get, sleep=lambda s: None)
    rows = {r["asn"]: (r["body"], r["error"]) for r in got.collect()}
    assert rows == {1: ("body 1", None), 2: (None, "status 404"), 3: (None, "OSError: down")}
    assert paged.batch_metadata(got).first()["failed"] == 2
    assert [paged.backoff(429, n) for n in range(4)] == [5, 10, 20, 30] and paged.backoff(404, 0) is None and paged.backoff(503, 3) == 10
    assert paged.downloaded(spark, {"a": lambda: "x", "b": lambda: 1 / 0}, ["a", "b"])["a"] == "x"
    with pytest.raises(ValueError):
        paged.downloaded(spark, {}, ["z"])


def test_splits(spark):
    d = spark.range(1003).withColumnRenamed("id", "k").withColumn("lab", (F.col("k") % 10 == 0).cast("int")).withColumn("rare", (F.col("k") % 100 == 0).cast("int"))
    s = split.checked_splits(split.hash_split(d, "k"), "k")
    assert {r["split"]: r["count"] for r in s.groupBy("split").count().collect()} == {"train": 702, "val": 151, "test": 150}
    folds = [r["count"] for r in split.group_kfold(d, "k", 4).groupBy("fold").count().orderBy("fold").collect()]
    assert folds == [251, 251, 251, 250]
    multi = split.multilabel_kfold(d, "k", ["lab", "rare"], 5).join(d, "k").groupBy("fold").agg(F.count("*").alias("n"), F.sum("lab").alias("a"), F.sum("rare").alias("b")).collect()
    assert len(multi) == 5 and max(r["n"] for r in multi) - min(r["n"] for r in multi) <= 3 and {r["a"] for r in multi} <= {19, 20, 21} and {r["b"] for r in multi} <= {2, 3}
    with pytest.raises(ValueError):
        split.hash_split(d, "k", 0.5, 0.1, 0.1)
    with pytest.raises(ValueError):
        split.group_kfold(d.limit(2), "k", 3)
    with pytest.raises(ValueError):
        split.checked_splits(s.unionByName(s.limit(1).withColumn("split", F.lit("other"))), "k")
    assert split.first_fold_split(d, "k").filter("split = 'test'").count() == 335


def test_labels(spark):
    with pytest.raises(ValueError):
        labels.reduced(spark.createDataFrame([(1, 1)], "asn int, a int"), "asn", ["a"], "zz")
    wide = labels.ensured(spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "asn int, Access_LargeISP int, IXP int"), schemas.sub_columns())
    top = {r["asn"]: r for r in labels.to_top_level(wide, ["asn"]).collect()}
    assert top[1]["Access"] == 1 and top[2]["IXP"] == 1 and top[2]["Access"] == 0


def test_knn_impute(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4))
    x[rng.random((60, 4)) < 0.2] = np.nan
    rows = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "asn long, a double, b double, c double, d double")
    got = np.array([list(r)[1:] for r in features.knn_impute(rows, list("abcd"), k=3).orderBy("asn").collect()])
    for i, j in zip(*np.where(np.isnan(x)), strict=True):
        dist = []
        for m in range(60):
            both = ~np.isnan(x[i]) & ~np.isnan(x[m])
            if both.any() and not np.isnan(x[m, j]):
                dist.append((math.sqrt(4 / both.sum() * ((x[i, both] - x[m, both]) ** 2).sum()), x[m, j]))
        near = sorted(dist)[:3]
        assert math.isclose(got[i, j], np.mean([v for _, v in near]) if near else np.nanmean(x[:, j]), abs_tol=1e-9)
    with pytest.raises(ValueError):
        features.knn_impute(rows, list("abcd"), donors=rows, donor_limit=10)


def test_knn_impute_all_donors(spark):
    """Over 5000 rows: the nearest donors are sought among all of them."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 3))
    x[:300, 0] = np.nan
    rows = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "asn long, a double, b double, c double")
    got = np.array([list(r)[1:] for r in features.knn_impute(rows, list("abc")).orderBy("asn").collect()])
    for i in range(300):
        near = np.argsort(((x[300:, 1:] - x[i, 1:]) ** 2).sum(axis=1))[:5]
        assert math.isclose(got[i, 0], x[300:, 0][near].mean(), abs_tol=1e-9)
    assert np.array_equal(got[300:], x[300:])


def test_models(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    rows = spark.createDataFrame([(i, float(a), float(b), int(a * a + b * b < 1.2), 1) for i, (a, b) in enumerate(x)], "asn long, a double, b double, inside int, all int")
    m = models.LabelModels("asn", ["a", "b"], ["inside", "all"], gamma=0.5, size=128).fit(rows)
    s = m.predict(rows)
    pred = s.select("asn", (F.col("inside") > 0.5).cast("int").alias("inside"), (F.col("all") > 0.5).cast("int").alias("all"))
    got = {r["label"]: r["f1"] for r in evaluate.label_metrics(rows, pred, "asn", ["inside", "all"]).collect()}
    assert got["inside"] > 0.9 and got["all"] == 1
    m.save(str(tmp_path / "m"))
    again = models.LabelModels.load(str(tmp_path / "m")).predict(rows)
    assert np.allclose([r["inside"] for r in s.orderBy("asn").collect()], [r["inside"] for r in again.orderBy("asn").collect()])
    best, all_ = models.searched(rows, "asn", "inside", ["a", "b"], [{"gamma": 0.5, "size": 64}, {"gamma": 1e-6, "size": 4}], folds=2)
    assert best["gamma"] == 0.5 and len(all_) == 2
    with pytest.raises(ValueError):
        models.vote({"svm": None}, "asn", ["a"])


def test_two_stage(spark):
    who = spark.createDataFrame([(1, "One"), (2, None), (3, "No scores")], "asn long, organization_name string")
    scores = spark.createDataFrame([(1, 0.9, 0.6), (2, 0.2, 0.3)], "asn long, Access double, IXP double")
    subs = spark.createDataFrame([(1, "Access", "LargeISP", None), (1, "IXP", "LargeISP", 0.9)], "asn long, category string, subcategory string, confidence double")
    out = two_stage.classify(who, {"svm": scores}, ["Access", "IXP"], subs, schemas.categories(spark))
    got = {r["asn"]: r for r in out.collect()}
    assert [s["category"] for s in got[1]["stage1"]] == ["Access", "IXP"] and [tuple(s) for s in got[1]["stage2"]] == [("Access", "LargeISP", 0.8)]
    assert [s["category"] for s in got[2]["stage1"]] == ["IXP"] and got[2]["stage2"] == [] and got[2]["organization_name"] == "AS2"
    assert got[3]["stage1"][0]["category"] == "Enterprise" and got[3]["stage1"][0]["confidence"] == 0.1
    assert math.isclose(got[1]["overall_confidence"], 0.6 * 0.75 + 0.4 * 0.8)
    assert two_stage.batch_summary(out).first()["rows"] == 3


def test_chat(spark):
    good = [("system", "s"), ("user", "u"), ("assistant", '{"tags":[]}')]
    rows = spark.createDataFrame([(1, good), (2, good[:2]), (3, [("user", "u"), ("system", "s"), ("assistant", "no json")]), (4, [("system", ""), *good[1:]])], "k int, messages array<struct<role:string,content:string>>")
    got = {r["k"]: r["p"] for r in rows.select("k", chat.example_problems(rows).alias("p")).collect()}
    assert got[1] == [] and "not three messages" in got[2] and "roles out of order" in got[3] and "answer is no JSON" in got[3] and got[4] == ["empty content"]
    taxonomy = schemas.taxonomy_rows(spark, {"B": {"x y": "d1"}, "A": "d2"})
    assert [r["category"] for r in chat.filtered_taxonomy(taxonomy, ["A", "B"]).orderBy("ord").collect()] == ["A", "B"]
    for bad, error in (("C", KeyError), ("A", ValueError)):
        with pytest.raises(error):
            chat.taxonomy_prompt(taxonomy, "{categories}", bad)
    assert [r["tag"] for r in chat.tag_names(taxonomy, True).orderBy("ord").collect()] == ["A", "B_x_y"]

    def broken(prompts):
        raise TimeoutError("slow")

    r = chat.responses(spark.createDataFrame([("p",)], "prompt string"), broken, sleep=lambda s: None).first()
    assert r["response"] is None and r["error"] == "TimeoutError: slow"


def test_pr_auc_without_positives(spark):
    rows = spark.createDataFrame([("a", 0, 0.3), ("b", 1, 0.9), ("b", 0, 0.9), ("b", 1, 0.1)], "label string, truth int, score double")
    got = {r["label"]: r["pr_auc"] for r in evaluate.pr_auc(rows).collect()}
    assert got["a"] is None and math.isclose(got["b"], 0.5 * (1 + 0.5) / 2 + 0.5 * (0.5 + 2 / 3) / 2)


def test_reports_and_sinks(spark, tmp_path):
    empty = spark.createDataFrame([], "k string, name string, site string, kind string")
    r = quality.peering_report(empty, "k", "name", "site", ["kind"])
    assert r.first()["overall"] == 0 and not r.first()["passed"] and "failed" in quality.report_text([r])
    df = spark.createDataFrame([(1, "a")], "asn long, name string")
    sinks.write_both(df, str(tmp_path / "x"))
    assert spark.read.parquet(str(tmp_path / "x.parquet")).count() == spark.read.option("header", True).csv(str(tmp_path / "x.csv")).count() == 1
    sinks.write_keyed(df, str(tmp_path / "keyed"))
    assert json.loads(spark.read.text(str(tmp_path / "keyed")).first()[0]) == {"key": "1", "record": {"asn": 1, "name": "a"}}
    assert sinks.write_as(df, str(tmp_path / "y"), ["json", "unknown"]) == ["json"]
    with pytest.raises(RuntimeError):
        sinks.write_as(df, str(tmp_path / "y"), ["excel"])
    assert sinks.merge_metadata(str(tmp_path / "m.json"), sinks.metadata({"x": df}))["x"]["rows"] == 1
    assert readers.newest_file(spark, str(tmp_path / "x.csv/*.csv")).endswith(".csv")


def test_monitor(spark):
    m = monitor.Monitor(most=2)
    for name in ("a", "b", "b"):
        with m.step(name):
            pass
    assert len(m.rows) == 2 and monitor.component_summary(m.frame(spark)).first()["component"] == "b"
    slow = spark.createDataFrame([(1, "x", False, 11.0, 600.0)], monitor.Monitor.SCHEMA)
    assert len(monitor.advice(monitor.component_summary(slow))) == 4 and monitor.batch_size(1.0, 0.1) == 10
    assert monitor.fallback("default", 1) == [("Enterprise", 0.1)] and monitor.fallback("skip", 1) == []


def test_stream(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "event_id long, value double"
    spark.range(20).selectExpr("id as event_id", "cast(id as double) as value").repartition(4).write.parquet(src)
    q = scoring.scored_stream(scoring.stream_of(spark, src, schema), lambda d: d.withColumn("high", F.col("value") > 9), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 20 and out.filter("high").count() == 10 and out.select("batch").distinct().count() == 4


def test_vote_keys_of_any_model(spark):
    one, two = spark.createDataFrame([(1, 0.9)], "asn long, a double"), spark.createDataFrame([(1, 0.5), (2, 1.0)], "asn long, a double")
    got = {r["asn"]: r["a"] for r in models.vote({"svm": one, "llm": two}, "asn", ["a"]).collect()}
    assert math.isclose(got[1], 0.4 * 0.9 + 0.6 * 0.5) and math.isclose(got[2], 0.6)


def test_tags_of_many_kinds(spark):
    """Each row's own tag, of 150 kinds."""
    rows = spark.range(300).select("id", F.array(F.concat(F.lit("kind"), F.col("id") % 150, F.lit("_"))).alias("tags"), F.array(F.struct(F.concat(F.lit("KIND"), F.col("id") % 150, F.lit("_x")).alias("token"), F.lit(-0.5).alias("logprob")), F.struct(F.lit("kind").alias("token"), F.lit(0.0).alias("logprob"))).alias("tokens"))
    got = chat.token_probabilities(rows, "id", "tokens", "tags").collect()
    assert len(got) == 300 and all(math.isclose(r["probability"], math.exp(-0.5)) for r in got)
    starts = chat.start_probabilities(spark.createDataFrame([(1, [("a", -1.0), ("ba", -2.0), ("", -9.0), ("b", -3.0)])], "k int, t array<struct<token:string,logprob:double>>"), "k", "t", ["ab", "b", "zz"]).collect()
    assert {(r["tag"], r["at"], round(math.log(r["probability"]))) for r in starts} == {("ab", 0, -1), ("ab", 2, -2), ("b", 1, -2), ("b", 3, -3)}


class _Rule:
    """A model for the searches: how well it does is its parameter."""

    def __init__(self, key, columns, labels, right=True):
        self.key, self.labels, self.right = key, labels, right

    def fit(self, df):
        return self

    def predict(self, df):
        return df.select(self.key, *[(F.col("x") if self.right else 1 - F.col("x")).alias(y) for y in self.labels])


def test_nested_search(spark):
    rows = spark.range(60).select(F.col("id").alias("asn"), (F.col("id") % 2).cast("double").alias("x"), (F.col("id") % 2).cast("int").alias("a"), (F.col("id") % 2).cast("int").alias("b"))
    out, counts, found = models.nested(rows, "asn", ["a", "b"], ["x"], [{"right": False}, {"right": True}], outer=3, inner=2, make=_Rule)
    got = out.collect()
    assert found == [{"right": True}] * 3 and len(got) == 60 and all(r["t_a"] == r["s_a"] and r["t_b"] == r["s_b"] for r in got)
    assert sum(r["n"] for r in counts.filter("part = 'test' and label = 'a'").collect()) == 30
    best, scores = models.searched(rows, "asn", "a", ["x"], [{"right": False}, {"right": True}], folds=2, make=_Rule)
    assert best == {"right": True} and [s for _, s in scores] == [0.0, 1.0]


def test_multilabel_folds_are_even(spark):
    """Each label combination is spread over the folds, against plain counts."""
    rows = spark.range(997).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("int").alias("a"), (F.col("id") % 5 == 0).cast("int").alias("b"), (F.col("id") % 97 == 0).cast("int").alias("c"))
    got = split.multilabel_kfold(rows, "k", ["a", "b", "c"], 4).collect()
    assert len({r["k"] for r in got}) == 997
    for combo in {(k % 3 == 0, k % 5 == 0, k % 97 == 0) for k in range(997)}:
        n = [sum(r["fold"] == f and (r["k"] % 3 == 0, r["k"] % 5 == 0, r["k"] % 97 == 0) == combo for r in got) for f in range(4)]
        assert max(n) - min(n) <= 1


def test_estimators(spark):
    from pyspark.ml import Pipeline

    from netquarry.operators import estimators

    rows = spark.range(80).select(F.col("id").alias("asn"), (F.col("id") % 2).cast("double").alias("x"), (F.col("id") % 2).cast("int").alias("a"))
    model = Pipeline(stages=[estimators.TableFunction(lambda d: d.withColumn("y", -F.col("x"))), estimators.LabelClassifier(["a"], size=32)]).fit(rows)
    out = model.transform(rows).collect()
    assert all((r["tags"] == ["a"]) == (r["a"] == 1) for r in out) and model.stages[1].score(rows.withColumn("y", -F.col("x"))) == 1.0
    with pytest.raises(ValueError, match="no columns"):
        estimators.LabelClassifier(["zz"]).fit(rows)
    ents = spark.createDataFrame([(1, "Net One", None, None), (2, None, "US", None)], "asn long, organization_name string, country string, website string")
    ents = ents.withColumns({"asrank": F.when(F.col("asn") == 1, F.struct(F.lit(5).alias("rank"))), "peeringdb": F.when(F.col("asn") == 2, F.struct(F.lit("NSP").alias("info_type"), F.lit("Global").alias("info_scope"), F.lit("Open").alias("policy_general"))), "aspop": F.lit(None).cast("struct<rir:string>"), "ipinfo": F.lit(None).cast("struct<name:string>")})
    got = {r["asn"]: r for r in estimators.EntityFeatures(scaled=False).fit(ents).transform(ents).collect()}
    assert got[1]["asrank_rank"] == 5 and got[2]["peeringdb_type_nsp"] == 1 and got[1]["org_name_network"] == 0


def test_requests_side_by_side(spark, tmp_path):
    """Requests of a task overlap, begin apart, and are asked for once when saved."""

    def slow(prompts):
        time.sleep(0.3)
        return [p.upper() for p in prompts]

    rows = spark.range(12).select("id", F.col("id").cast("string").alias("prompt")).coalesce(1)
    start = time.perf_counter()
    assert chat.responses(rows, slow, concurrency=12).filter("response is null").count() == 0
    assert time.perf_counter() - start < 3
    start = time.perf_counter()
    chat.responses(rows, lambda p: p, concurrency=12, delay=0.1).collect()
    assert time.perf_counter() - start >= 1.1
    path = str(tmp_path / "saved")

    def some(prompts):
        if int(prompts[0]) % 2:
            raise OSError("down")
        return ["first"]

    assert chat.responses_saved(rows, some, path, "id", rounds=2, sleep=lambda s: None).count() == 6
    got = {r["id"]: r["response"] for r in chat.responses_saved(rows, lambda p: ["second"], path, "id", rounds=2).collect()}
    assert got == {i: "second" if i % 2 else "first" for i in range(12)}


def test_error_log(spark, tmp_path):
    log = monitor.ErrorLog(most=3)

    def broken(asn=None):
        raise TimeoutError("api timeout")

    assert log.guarded(broken, "stage1", lambda asn=None: "rest", tries=2, sleep=lambda s: None)(asn=7) == "rest"
    with pytest.raises(TimeoutError):
        log.guarded(broken, "stage2")()
    assert [r[-1] for r in log.rows] == ["retry", "fallback", "raised"]
    log.export(spark, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log/errors")).filter("category = 'api_error' and asn = 7").count() == 2
    table = log.guarded(lambda: spark.range(3).select(F.raise_error(F.lit("model broke"))), "plan", lambda: spark.range(1))
    assert table().count() == 1


def test_remote(spark, tmp_path):
    nodes = [record(a) for a in range(1, 26)]

    def ranked(url, body):
        text = json.loads(body)["query"]
        first, offset = (int(text.split(f"{x}:")[1].split(",")[0].split(")")[0]) for x in ("first", "offset"))
        return 200, json.dumps({"data": {"asns": {"totalCount": 25, "edges": [{"node": n} for n in nodes[offset : offset + first]]}}})

    assert {r["asn"] for r in remote.ranking(spark, "u", ranked, page=10).collect()} == set(range(1, 26))
    day, text = remote.dated("x/{date}", datetime.date(2024, 5, 10), lambda u, b: (200, "data") if u in ("x/2024-05-08", "x/2024-05-12") else (404, ""))
    assert day == datetime.date(2024, 5, 8) and text == "data"
    assert remote.dated("x/{compact}", datetime.date(2024, 5, 10), lambda u, b: (200, u), today=datetime.date(2024, 5, 9))[0] == datetime.date(2024, 5, 9)
    with pytest.raises(RuntimeError):
        remote.dated("x/{date}", datetime.date(2024, 5, 10), lambda u, b: (404, ""))
    tries = []
    with pytest.raises(RuntimeError, match="503"):
        remote.asked(lambda u, b: tries.append(u) or (503, ""), "u", sleep=lambda s: None)
    assert len(tries) == 3 and remote.http("http://127.0.0.1:9/none", timeout=1)[0] == 0
    assert remote.info(spark.createDataFrame([(5,)], "asn long"), "asn", "u/{key}", lambda u, b: (200, u)).first()["body"] == "u/5"

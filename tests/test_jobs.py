"""Jobs, settings and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from netquarry import schemas
from netquarry.__main__ import main
from netquarry.config import Settings
from netquarry.operators import chat
from netquarry.plans import jobs
from tests.test_operators import record


def test_settings(tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"folds": 5, "other": 1}))
    s = Settings.load(str(tmp_path / "s.json"), environ={"NETQUARRY_SEED": "7"})
    assert (s.folds, s.seed, s.extra) == (5, 7, {"other": 1})
    with pytest.raises(ValueError):
        Settings(vote_svm=0.1)
    with pytest.raises(ValueError):
        Settings(train=0.5)


def test_process_and_status(spark, tmp_path, capsys):
    (tmp_path / "asrank1.jsonl").write_text("\n".join(json.dumps(record(a)) for a in (174, 15169)))
    (tmp_path / "aspop1.csv").write_text("ASN,Name,CC,RIR,Cust_cone_ASN,Cust_cone_pfx,Cust_cone_addr\nAS174,Cogent,US,ARIN,1,2,3\n")
    (tmp_path / "reg.json").write_text(json.dumps({"registries": {"ARIN": {"name": "x"}}, "countries": {"US": {"name": "U", "rir": "ARIN", "continent": "NA"}}}))
    assert main(["process", "--input", str(tmp_path), "--output", str(tmp_path / "out"), "--registry", str(tmp_path / "reg.json")]) == 0
    assert "asrank: passed" in (tmp_path / "out/quality.md").read_text() and spark.read.parquet(str(tmp_path / "out/asrank.parquet")).count() == 2
    assert main(["status", "--input", str(tmp_path)]) == 0 and "asrank: 2" in capsys.readouterr().out


def test_release_train_predict_evaluate(spark, tmp_path, capsys):
    wide = spark.range(60).select(F.concat(F.lit("AS"), F.col("id")).alias("ASN"), (F.col("id") % 2).alias("Access_LargeISP"), (F.col("id") % 3 == 0).cast("int").alias("Financial_Bank"))
    found = jobs.release_labels(wide, str(tmp_path / "r"))
    assert found["labels/toplevel"]["rows"] == 60 and len(found["labels/sublevel"]["columns"]) == 49
    top = spark.read.parquet(str(tmp_path / "r/labels/toplevel.parquet"))
    assert top.filter("Finance = 1").count() == 20
    feats = spark.range(60).select(F.col("id").alias("asn"), (F.col("id") % 2).cast("double").alias("x"), (F.col("id") % 3 == 0).cast("double").alias("y"))
    feats.write.parquet(str(tmp_path / "f"))
    top.select("asn", "Access", "Finance").coalesce(1).write.option("header", True).csv(str(tmp_path / "l.csv"))
    assert main(["train", "--labels", str(tmp_path / "l.csv"), "--features", str(tmp_path / "f"), "--output", str(tmp_path / "m")]) == 0
    assert main(["predict", "--model", str(tmp_path / "m"), "--features", str(tmp_path / "f"), "--output", str(tmp_path / "p"), "--format", "json"]) == 0
    pred = spark.read.json(str(tmp_path / "p.json"))
    marks = pred.select("asn", *[F.array_contains(F.split("tags", ","), c).cast("int").alias(c) for c in ("Access", "Finance")])
    marks.write.parquet(str(tmp_path / "q"))
    assert main(["evaluate", "--labels", str(tmp_path / "l.csv"), "--predictions", str(tmp_path / "q"), "--output", str(tmp_path / "e.json")]) == 0
    got = json.loads((tmp_path / "e.json").read_text())
    assert got["summary"]["macro_f1"] > 0.95 and "exact_match" in capsys.readouterr().out
    stored = spark.createDataFrame([("macro f1", got["summary"]["macro_f1"])], "name string, value double")
    summary, _ = jobs.scored(top, marks, list(schemas.TOP))
    assert jobs.against_stored(summary, stored, {"macro f1": "macro_f1"}).first()["close"]
    with pytest.raises(ValueError):
        jobs.scored(top, marks.withColumn("asn", F.col("asn") + 1000), list(schemas.TOP))


def test_sub_models_and_parsing(spark, tmp_path):
    one = spark.createDataFrame([(1, [("Access", 0.9), ("IXP", 0.7)]), (2, [("Transit", 0.8)])], "asn long, stage1 array<struct<category:string,confidence:double>>")
    m = jobs.SubModels()
    m.add("Access", lambda d: d.select("asn", F.lit("Access").alias("category"), F.lit("SmallISP").alias("subcategory"), F.lit(0.9).alias("confidence")))
    got = {(r["asn"], r["category"]): (r["subcategory"], r["confidence"]) for r in m.predict(one, "asn", schemas.categories(spark)).collect()}
    assert got == {(1, "Access"): ("SmallISP", 0.9), (2, "Transit"): ("Global", 0.1)}
    assert m.categories() == ["Access"] and m.remove("Access") and not m.remove("Access")
    text = json.dumps({"responses": [{"tags": [{"category": "Access", "subcategory": "LargeISP"}]}, {"tags": [{"category": "IXP", "subcategory": ""}]}]})
    rows = spark.createDataFrame([([5, 6], text), ([7], "broken")], "keys array<long>, response string")
    assert {tuple(r) for r in jobs.parsed_long(rows, "asn", "keys", "response").collect()} == {(5, "Access", "LargeISP", 1.0), (6, "IXP", None, 1.0)}
    assert jobs.as_keys(spark, [1, {"asn": 2}]).count() == 2 and jobs.as_keys(spark, one).count() == 2
    ents = spark.range(20).select(F.col("id").alias("asn"), F.lit("n").alias("name"), F.lit(None).cast("string").alias("country"), F.lit(None).cast("string").alias("website"))
    marks = ents.select("asn", F.lit(1).alias("Access"))
    jobs.training_files(chat.examples(marks, ents, "asn", ["Access"], "s"), str(tmp_path / "t"), "asn")
    assert spark.read.text(str(tmp_path / "t/train.jsonl")).count() == 16
    assert jobs.prompts_for(ents).count() == 4


def test_two_stage_commands(spark, tmp_path, capsys):
    spark.createDataFrame([(1, 0.9, 0.7), (2, 0.1, 0.2)], "asn long, Access double, IXP double").write.parquet(str(tmp_path / "svm"))
    spark.createDataFrame([(1, 0.8), (3, 1.0)], "asn long, Access double").write.parquet(str(tmp_path / "llm"))
    spark.createDataFrame([(1, "Access", "SmallISP", 0.9)], "asn long, category string, subcategory string, confidence double").write.parquet(str(tmp_path / "subs"))
    votes = ["--votes", f"svm={tmp_path / 'svm'},llm={tmp_path / 'llm'}", "--subs", str(tmp_path / "subs")]
    assert main(["classify-single", "--asn", "1", "--organization", "One", "--format", "json", "--timing", *votes]) == 0
    one = json.loads(capsys.readouterr().out)
    assert one["stage1"][0]["category"] == "Access" and one["stage2"][0]["subcategory"] == "SmallISP" and one["processing_time"] > 0
    assert main(["classify-single", "--asn", "9", *votes]) == 0 and "Enterprise 0.1000" in capsys.readouterr().out
    (tmp_path / "who.csv").write_text("asn,name\n1,One\n2,Two\n3,Three\n")
    assert main(["classify-batch", "--input", str(tmp_path / "who.csv"), "--output", str(tmp_path / "out"), "--format", "json", *votes]) == 0
    got = {r["asn"]: r["stage1_categories"] for r in spark.read.json(str(tmp_path / "out.json")).collect()}
    assert got[1] == "Access" and got[3] == "Access" and "3 rows" in capsys.readouterr().out
    assert main(["benchmark-stages", "--input", str(tmp_path / "who.csv"), "--sizes", "2", *votes]) == 0 and "2 rows" in capsys.readouterr().out
    long = spark.createDataFrame([(1, "Access", "SmallISP"), (2, "IXP", None)], "asn long, category string, subcategory string")
    long.write.parquet(str(tmp_path / "long"))
    assert main(["evaluate-stages", "--predictions", str(tmp_path / "long"), "--labels", str(tmp_path / "long"), "--output", str(tmp_path / "report.txt")]) == 0
    assert "exact 1.0000" in capsys.readouterr().out and "exact 1.0000" in (tmp_path / "report.txt").read_text()
    spark.createDataFrame([(1, "stage1", True, 9.0, 1.0)], "id long, component string, success boolean, seconds double, mb double").write.parquet(str(tmp_path / "calls"))
    assert main(["monitor-performance", "--calls", str(tmp_path / "calls")]) == 0 and "stage1: 1 calls" in capsys.readouterr().out


def test_download_and_validate_commands(spark, tmp_path, capsys, monkeypatch):
    from netquarry.sources import remote

    monkeypatch.setattr(remote.dated, "__defaults__", (lambda url, body: (200, "ASN,Name,CC,RIR"), 7, None, 1))
    assert main(["download", "--source", "aspop", "--url", "u/{date}", "--output", str(tmp_path / "pop.csv"), "--date", "2024-01-02"]) == 0
    assert (tmp_path / "pop.csv").read_text() == "ASN,Name,CC,RIR" and "2024-01-02" in capsys.readouterr().out
    (tmp_path / "who.csv").write_text("asn,name\n1,One\n2,Two\n")
    monkeypatch.setattr(remote.info, "__defaults__", (lambda url, body: (200, "{}") if url.endswith("1") else (404, ""), 5))
    assert main(["download-info", "--input", str(tmp_path / "who.csv"), "--url", "u/{key}", "--output", str(tmp_path / "info")]) == 0
    assert "'succeeded': 1" in capsys.readouterr().out and spark.read.json(str(tmp_path / "info")).first()["key"] == "1"
    (tmp_path / "asrank1.jsonl").write_text(json.dumps(record(174)))
    assert main(["validate", "--input", str(tmp_path)]) in (0, 1) and "## asrank" in capsys.readouterr().out

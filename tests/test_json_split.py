"""Records of one JSON document cut into ranges, against the plain parser."""

import json
import random

import pytest
from pyspark.sql import functions as F

from netquarry.plans import jobs
from netquarry.sources import json_split, readers

ODD = ['a{b', "}", "[,]", 'quo"te', "back\\slash", "\\", '\\"', "x,y", "line\nend", "é 日本", "", ":", '"', "{\"a\": [1, 2}"]


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind < 2:
        return rng.choice(ODD)
    if kind < 4:
        return rng.choice([1, -2.5, True, None])
    return [value(rng, depth + 1) for _ in range(rng.randrange(4))] if kind < 6 else {rng.choice(ODD) + str(k): value(rng, depth + 1) for k in range(rng.randrange(4))}


@pytest.fixture
def small_ranges(spark):
    """Ranges of two thousand bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def got(spark, path, *keys):
    return [(r.key, json.loads(r.value)) for r in json_split.records(spark, str(path), *keys).orderBy("at").collect()]


@pytest.mark.parametrize(("seed", "indent", "ascii"), [(1, None, True), (2, 2, False)])
def test_records(spark, tmp_path, small_ranges, seed, indent, ascii):
    """Objects and arrays at three depths; strings with brackets, commas and escapes; a record over many ranges."""
    rng = random.Random(seed)
    long = {"long": [rng.choice(ODD) for _ in range(400)], "text": ",{" * 900}
    data = [value(rng) for _ in range(150)] + [long] + [value(rng) for _ in range(10)] + [[], {}, "end"]
    keyed = {f"{rng.choice(ODD)}{k}": v for k, v in enumerate(data)}
    whole = {"meta": {"data": [1, {"data": [2]}], "net": {"data": [3]}}, "net": {"other": [{"data": [4]}], "data": data, "last": {"data": [5]}}, "keyed": keyed, "none": [], "data": [6]}
    text = json.dumps(whole, indent=indent, ensure_ascii=ascii)
    (tmp_path / "d.json").write_text(text, encoding="utf-8")
    ranges = spark.read.option("lineSep", ",").text(str(tmp_path / "d.json")).rdd.getNumPartitions()
    assert ranges >= 5
    assert got(spark, tmp_path / "d.json", "net", "data") == [(None, x) for x in data]
    assert got(spark, tmp_path / "d.json", "keyed") == list(keyed.items())
    assert got(spark, tmp_path / "d.json") == list(whole.items())
    assert got(spark, tmp_path / "d.json", "missing", "data") == []
    assert got(spark, tmp_path / "d.json", "meta", "data") == [(None, x) for x in whole["meta"]["data"]]


def test_arrays_and_empty(spark, tmp_path, small_ranges, monkeypatch):
    """A list at the root, documents without records, several files, and states that are exchanged instead of broadcast."""
    rows = [{"a": k, "b": "x" * (k % 50), "c": ["}", "]"]} for k in range(300)]
    for name, text in (("list", json.dumps(rows)), ("one", "[ 7 ]"), ("blank", "  "), ("empty", ""), ("object", "{}"), ("scalar", '"a,b"'), ("early", json.dumps(rows)[:-20])):
        (tmp_path / f"{name}.json").write_text(text)
    assert got(spark, tmp_path / "list.json") == [(None, r) for r in rows]
    assert got(spark, tmp_path / "one.json") == [(None, 7)]
    assert all(got(spark, tmp_path / f"{x}.json") == [] for x in ("blank", "empty", "object", "scalar", "absent"))
    assert json_split.records(spark, str(tmp_path / "early.json")).count() == 300
    monkeypatch.setattr(json_split, "MOST_RANGES", 3)
    assert got(spark, tmp_path / "list.json") == [(None, r) for r in rows]
    both = json_split.records(spark, str(tmp_path / "[lo][in]*.json"))  # list and one
    assert sorted(json.loads(r.value) == 7 for r in both.collect()) == [False] * 300 + [True]


def test_large_document(spark, tmp_path):
    """A document of some ten megabytes is read by several tasks, with the rows of the plain reader."""
    with open(tmp_path / "big.json", "w") as f:
        f.write('{"net": {"data": [')
        f.write(",".join(json.dumps({"asn": k + 1, "name": "n,{" * 60 + str(k), "info_type": "a\\\"b"}) for k in range(50_000)))
        f.write("]}}")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        df = readers.read_network_dump(spark, str(tmp_path / "big.json"))
        assert df.agg(F.count("*"), F.sum("asn"), F.countDistinct("name")).first() == (50_000, 50_001 * 25_000, 50_000)
        ranges = json_split.records(spark, str(tmp_path / "big.json"), "net", "data").select("at.start").distinct().count()
        assert ranges > 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_any_file_system(spark, tmp_path):
    """Sources on a file system that only Spark opens, by scheme, pattern and plain path; no source is an error."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in/ipinfo1.json").write_text('{"data": {"AS7": {"name": "n", "org": "AS7 x"}}}')
    (tmp_path / "in/asrank1.jsonl").write_text('{"asn": 7, "rank": 1}\n')
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.shop.link./in", f"file://{tmp_path}/in")
    for folder in (f"{tmp_path}/in", f"file:{tmp_path}/in", f"file://{tmp_path}/in/", "viewfs://shop/in"):
        found = jobs.newest_sources(spark, folder)
        assert sorted(found) == ["asrank", "ipinfo"] and [r.asn for r in found["ipinfo"].collect()] == [7] == [r.asn for r in found["asrank"].collect()]
    for path in (f"{tmp_path}/in/ipinfo1.json", f"file:{tmp_path}/in/ipinfo1.json", f"{tmp_path}/in/ip*.json", "viewfs://shop/in/ipinfo1.json"):
        assert readers.read_keyed_json(spark, path, "AS7 struct<name:string>").count() == 1
    for folder in (f"{tmp_path}/none", "viewfs://shop/in/none"):
        with pytest.raises(FileNotFoundError):
            jobs.newest_sources(spark, folder)
    assert readers.read_keyed_json(spark, "viewfs://shop/in/none.json", "name string").count() == 0
    from netquarry import __main__ as cli

    assert cli.main(["validate", "--input", f"{tmp_path}/none"]) == 2

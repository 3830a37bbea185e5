"""Kernel machines, guarded and saved steps, workbooks, approaches and saved pipelines against plain results."""

import collections
import json
import math
import os
import zipfile

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from netquarry import __main__ as cli
from netquarry.operators import estimators, guarded, kernel_svm, saved
from netquarry.plans import approaches
from netquarry.sources import sinks, workbook

# kernel machines


def rings(n, seed=0, noise=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    y = np.where((x * x).sum(axis=1) + noise * rng.normal(size=n) < 1.2, 1.0, -1.0)
    return x, y


def plain_dual(x, y, c, gamma, steps=20_000):
    """The dual by projected coordinate pairs over the whole kernel, in random order, far beyond the tolerance."""
    k = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(-1))
    rng, a, g = np.random.default_rng(1), np.zeros(len(y)), -np.ones(len(y))
    for _ in range(steps):
        i, j = rng.choice(len(y), 2, replace=False)
        bend = max(2 - 2 * k[i, j], 1e-12)
        step = (-y[i] * g[i] + y[j] * g[j]) / bend
        low = max(-a[i] if y[i] > 0 else a[i] - c, a[j] - c if y[j] > 0 else -a[j])
        high = min(c - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else c - a[j])
        step = min(max(step, low), high)
        a[i] += y[i] * step
        a[j] -= y[j] * step
        g += y * step * (k[:, i] - k[:, j])
    return a, k


def test_dual():
    """The gap is below the tolerance, and decisions are those of a plain solver; the cache's size doesn't matter."""
    x, y = rings(300, noise=0.4)
    alpha, bias, gap = kernel_svm.solve(x, y, 2.0, 0.7)
    assert gap < kernel_svm.TOLERANCE and abs(alpha @ y) < 1e-9 and alpha.min() >= 0 and alpha.max() <= 2.0
    other, k = plain_dual(x, y, 2.0, 0.7, 150_000)
    value = lambda a: 0.5 * (a * y) @ k @ (a * y) - a.sum()
    assert value(alpha) <= value(other) + 1e-2 * abs(value(other))
    mine, theirs = k @ (alpha * y), k @ (other * y)
    assert np.abs(mine - theirs).max() < 0.1
    assert np.allclose(kernel_svm.margins(x, x[alpha > 0], (alpha * y)[alpha > 0], bias, 0.7), mine + bias)
    small = kernel_svm.Kernel(x, 0.7, cache=1)
    assert np.allclose([small.row(i) for i in (0, 5, 0, 9, 5)], k[[0, 5, 0, 9, 5]]) and len(small.kept) == 2


def test_cascade(spark, tmp_path):
    """Parts and rounds give the optimum over all rows: that of one part, whatever the order and partitions; saved machines score the same."""
    x, y = rings(900, 3, 0.1)
    rows = [(k, *map(float, v), int(s > 0), 0 if k % 2 else None, 1) for k, (v, s) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame([*rows, (9000, None, None, None, None, 1)], "asn long, a double, b double, ring int, none int, all int")
    one = kernel_svm.KernelMachines("asn", ["a", "b"], ["ring", "none", "all"], c=5.0, gamma=1.0).fit(df)
    many = kernel_svm.KernelMachines("asn", ["a", "b"], ["ring", "none", "all"], c=5.0, gamma=1.0, part=120).fit(df.orderBy(F.desc("a")).repartition(5))
    first, second = ({r.asn: r for r in m.margins(df).collect()} for m in (one, many))
    assert max(abs(first[k].ring - second[k].ring) for k in first) < 0.05
    truth = {r[0]: r[3] for r in rows}
    assert np.mean([(first[k].ring > 0) == bool(truth[k]) for k in truth]) > 0.95
    p = {r.asn: r for r in many.predict(df).collect()}
    assert all(r.none == 0.0 and r.all == 1.0 and 0 <= r.ring <= 1 for r in p.values())
    assert np.mean([(p[k].ring > 0.5) == bool(truth[k]) for k in truth]) > 0.93
    many.save(f"{tmp_path}/m")
    again = {r.asn: r for r in kernel_svm.KernelMachines.load(f"{tmp_path}/m").predict(df).collect()}
    assert all(np.isclose(again[k].ring, p[k].ring) for k in p)
    own = many.rows(df).withColumnRenamed("y_0", "y")
    checked = kernel_svm.violations(many.models["ring"][0].scored(own), many.models["ring"][0], 5.0)
    assert one.models["ring"][0].gap < kernel_svm.TOLERANCE and checked.filter("abs(margin) > 50").count() == 0
    with pytest.raises(RuntimeError):
        kernel_svm.KernelMachines("asn", ["a", "b"], ["ring"], most=10).fit(df)


# errors beside results


def test_guarded(spark, tmp_path):
    """Failing rows alone are errors; tasks that run again count none twice; nulls and repeated rows are rows like others."""
    rows = [(k, None if k % 7 == 0 else k) for k in range(200)] + [(5, 5), (5, 5)]
    df = spark.createDataFrame(rows, "asn long, x long").repartition(4)
    log = tmp_path / "tries"

    def step(r):
        k, x = r["asn"], r["x"]
        if k == 13:
            with open(log, "a") as f:
                f.write("x")
        if k % 10 == 3:
            raise ValueError(f"bad column {k}")
        if k % 50 == 1:
            raise TimeoutError(f"slow {k}")
        return {"twice": None if x is None else 2.0 * x, "name": f"n{k}"}

    schema = "twice double, name string"
    out = guarded.guarded(df, step, schema, "step", batch=lambda rows: [step(r) for r in rows], tries=3, fallback=lambda r: {"twice": -1.0, "name": "f"} if r["asn"] % 50 == 1 else r["none"])
    errors = out.errors().collect()
    assert sorted(r.asn for r in errors) == sorted(k for k, _ in rows if k % 10 == 3 or k % 50 == 1)
    assert {(r.kind, r.category, r.recovery_action, r.tries) for r in errors} == {("ValueError", "data_error", "dropped", 3), ("TimeoutError", "system_error", "fallback", 3)}
    assert len(log.read_text()) == 4  # once with its batch, three times alone, however often results and errors are read
    got = collections.Counter((r.asn, None if r.twice is None or math.isnan(r.twice) else r.twice, r.name) for r in out.results().collect())
    assert got == collections.Counter((k, (-1.0 if k % 50 == 1 else None if x is None else 2.0 * x), "f" if k % 50 == 1 else f"n{k}") for k, x in rows if k % 10 != 3)
    assert out.counts().first().asDict() == {"rows": 202, "results": 182, "errors": 24, "replaced": 4, "lost": 20}
    out.export(f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log/errors").count() == 24 and {r.n for r in spark.read.json(f"{tmp_path}/log/summary").filter("by = 'component'").collect()} == {24}
    short = guarded.guarded(df, lambda r: {"twice": "no number"} if r["asn"] == 5 else step(r), schema, "short", batch=lambda rows: rows[1:])
    assert short.counts().first()["errors"] == 27 and {r.kind for r in short.errors().filter("asn = 5").collect()} <= {"ArrowInvalid", "KeyError"}
    quick = guarded.guarded(df, lambda r: {"twice": 0.0, "name": "slow"}, schema, "quick", batch=lambda rows: [{"twice": 1.0, "name": "fast"} for _ in rows])
    assert quick.results().select("name").distinct().collect()[0].name == "fast" and quick.errors().count() == 0
    assert guarded.guarded(df.limit(0), step, schema, "step").counts().first()["rows"] == 0


# answers, saved once


def test_saved_once(spark, tmp_path):
    """A worker that dies half-way: the next job asks for what has no answer; a job beside one that runs asks for nothing."""
    path, log = f"file://{tmp_path}/saved", tmp_path / "asked"
    rows = [(k, f"p{k}") for k in range(60)] + [(7, "p7")]
    prompts = spark.createDataFrame(rows, "asn long, prompt string")

    def asked():
        return collections.Counter(log.read_text().split()) if log.exists() else collections.Counter()

    def model(prompts, dies):
        with open(log, "a") as f:
            f.write(prompts[0] + " ")
        if dies and int(prompts[0][1:]) % 20 == 19:
            os._exit(1)
        if prompts[0] == "p30":
            raise OSError("refused")
        return [f"answer to {prompts[0]}"]

    options = {"buckets": 4, "flush": 1, "concurrency": 1, "tries": 1}
    with pytest.raises(Exception):  # noqa: B017
        saved.responses_once(prompts, lambda p: model(p, True), path, "asn", **options)
    before, kept = asked(), {r.key for r in saved.answers(spark, path).collect()}
    assert kept and sum(before.values()) < 61
    with pytest.raises(RuntimeError):
        kernel = saved.lease(spark, f"{path}/_lease")
        try:
            saved.responses_once(prompts, lambda p: model(p, False), path, "asn", **options)
        finally:
            saved.released(spark, kernel)
    assert asked() == before
    got = {r.asn: r.response for r in saved.responses_once(prompts, lambda p: model(p, False), path, "asn", **options).collect()}
    assert got == {k: None if k == 30 else f"answer to p{k}" for k in range(60)}
    after = asked()
    assert all(after[f"p{k}"] == before[f"p{k}"] for k in map(int, kept))
    again = saved.responses_once(prompts, lambda p: ["asked again"], path, "asn", **options)
    assert again.filter("response = 'asked again'").select("asn").collect()[0].asn == 30 and again.count() == 61
    with pytest.raises(ValueError):
        saved.responses_once(spark.createDataFrame([(None, "x")], "asn long, prompt string"), model, path, "asn")


# workbooks


def test_workbook(spark, tmp_path):
    """Cells of all kinds read back; more rows than a sheet holds go to further sheets; a failed job leaves nothing."""
    rows = [(k, f"a<b>&\"{k}' \x01 _x0041_ \r\n é 日", k / 3, k % 2 == 0, None if k % 3 else "s", (1 << 60) + k) for k in range(250)] + [(None, "", float("nan"), None, " x ", -1)]
    df = spark.createDataFrame(rows, "n long, t string, d double, b boolean, s string, big long").repartition(3)
    workbook.write(df, f"{tmp_path}/b.xlsx", rows=50)
    got = workbook.read(spark, f"{tmp_path}/b.xlsx", "n long, t string, d double, b boolean, s string, big long")
    same = lambda r: tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r)
    assert sorted(map(same, got.collect()), key=str) == sorted(map(same, rows), key=str)
    with zipfile.ZipFile(tmp_path / "b.xlsx") as z:
        assert z.testzip() is None and sum(n.startswith("xl/worksheets/") for n in z.namelist()) >= 6
        assert all(z.read(f"xl/worksheets/sheet{k}.xml").count(b"<row ") <= 50 for k in range(1, 7))
    assert os.listdir(tmp_path) == ["b.xlsx"]
    workbook.write(df.limit(0), f"{tmp_path}/none.xlsx")
    assert workbook.read(spark, f"{tmp_path}/none.xlsx", "n long, t string").count() == 0
    with pytest.raises(Exception, match="cell holds"):
        workbook.write(spark.createDataFrame([("x" * 40_000,)], "t string"), f"{tmp_path}/long.xlsx")
    assert sorted(os.listdir(tmp_path)) == ["b.xlsx", "none.xlsx"]
    assert sinks.write_as(df.select("n", "t").limit(2), f"{tmp_path}/o", ["excel", "json_by_index", "unknown"]) == ["excel", "json_by_index"]
    assert set(json.loads((tmp_path / "o.json").read_text())) == {"n", "t"}


# approaches


def test_approaches(spark, tmp_path):
    scores = spark.createDataFrame([(1, 0.9, 0.2), (2, 0.1, 0.4)], "asn long, A double, B double")
    tax = approaches.Taxonomy(["A", "B"], {"A_x": "A"})
    request = approaches.Request({"scores": lambda: scores}, tax)
    assert {r.asn: r.tags for r in approaches.predicted("one_model", request).collect()} == {1: ["A"], 2: ["B"]}
    for name in ("hierarchical", "hybrid", "two_stages", "nothing"):
        with pytest.raises(ValueError):
            approaches.predicted(name, request)
    (tmp_path / "tax.json").write_text(json.dumps({"A": {"x": "ex"}, "B": "bee"}))
    assert approaches.Taxonomy.of_file(f"{tmp_path}/tax.json") == tax
    assert [tuple(r) for r in tax.valid(spark).collect()] == [(0, "A", "x"), (1, "B", None)]
    scores.write.parquet(f"{tmp_path}/s")
    assert cli.main(["predict", "--approach", "flat", "--inputs", f"scores={tmp_path}/s", "--taxonomy", f"{tmp_path}/tax.json", "--output", f"{tmp_path}/out", "--format", "parquet"]) == 0
    assert {r.asn: r.tags for r in spark.read.parquet(f"{tmp_path}/out.parquet").collect()} == {1: "A", 2: ""}


# stages


def shifted(df):
    return df.withColumn("z", F.col("a") - F.col("b"))


def test_saved_pipeline(spark, tmp_path):
    """A saved pipeline loads with its settings and scores the same; grids set its settings."""
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(k, float(a), float(b), int(a > b)) for k, (a, b) in enumerate(rng.normal(size=(150, 2)))], "asn long, a double, b double, up int")
    classifier = estimators.LabelClassifier(["up"], make=kernel_svm.KernelMachines, gamma=0.5)
    pipeline = Pipeline(stages=[estimators.TableFunction(shifted), classifier])
    pipeline.write().overwrite().save(f"file://{tmp_path}/unfitted")
    model = Pipeline.load(f"file://{tmp_path}/unfitted").fit(rows)
    model.write().overwrite().save(f"file://{tmp_path}/fitted")
    again = PipelineModel.load(f"file://{tmp_path}/fitted")
    one, two = ({r.asn: r.score_up for r in m.transform(rows).collect()} for m in (model, again))
    assert all(np.isclose(one[k], two[k]) for k in one) and again.stages[1].getLabels() == ["up"] and again.stages[1].uid == model.stages[1].uid
    assert estimators.LabelEvaluator(["up"]).evaluate(model.transform(rows)) > 0.9
    copy = classifier.copy({classifier.threshold: 0.9})
    assert copy.getThreshold() == 0.9 and classifier.getThreshold() == 0.5 and copy.make is classifier.make
    grid = ParamGridBuilder().addGrid(classifier.columns, [["b"], ["a", "b"]]).build()
    best = CrossValidator(estimator=classifier, estimatorParamMaps=grid, evaluator=estimators.LabelEvaluator(["up"]), numFolds=2, seed=1).fit(rows)
    assert best.avgMetrics[1] > best.avgMetrics[0] + 0.1 and best.bestModel.model.columns == ["a", "b"]
    with pytest.raises(TypeError):
        estimators.TableFunction(lambda d: d).write().save(f"file://{tmp_path}/f")

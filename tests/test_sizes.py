"""What steps send or hold at a time, on many partitions and long blocks."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from netquarry.operators import features, kernel_svm, models


def stages(spark, group, run):
    """(result of run, tasks of each stage that it submitted)."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        out = run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    infos = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    return out, [i.numTasks for i in infos if i]


def test_fit_in_few_partitions(spark):
    """The rounds of a fit run on a partition for each core, not on all that the rows came in; the scores are the same."""
    rows = spark.range(2000).select(F.col("id").alias("asn"), ((F.col("id") * 37 % 101) / 101.0).alias("a"), ((F.col("id") * 53 % 97) / 97.0).alias("b")).withColumn("up", (F.col("a") + F.col("b") > 1).cast("int"))
    fit = lambda d: models.LabelModels("asn", ["a", "b"], ["up"], size=16).fit(d)
    many, tasks = stages(spark, "fit", lambda: fit(rows.repartition(60)))
    assert len(tasks) > 20 and sum(n >= 60 for n in tasks) <= 5
    assert np.allclose(*[[r["up"] for r in m.predict(rows).orderBy("asn").collect()] for m in (many, fit(rows.coalesce(2)))], atol=1e-4)


def test_margins_in_blocks():
    """Decision values of many rows from many support vectors hold some tens of megabytes, and are those of the whole kernel."""
    rng = np.random.default_rng(0)
    x, of, weight = rng.normal(size=(6000, 2)), rng.normal(size=(12_000, 2)), rng.normal(size=12_000)
    tracemalloc.start()
    got = kernel_svm.margins(x, of, weight, 0.5, 0.7)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 48 << 20
    want = [np.exp(-0.7 * ((r - of) ** 2).sum(axis=1)) @ weight + 0.5 for r in x[::500]]
    assert np.allclose(got[::500], want) and len(got) == 6000
    assert np.array_equal(kernel_svm.margins(x[:3], of[:0], weight[:0], 0.5, 0.7), np.full(3, 0.5))


def test_tile_in_flat_arrays():
    """What a task finds for a block of rows takes some bytes a donor, and is what a plain search finds; rows without donors have none."""
    rng = np.random.default_rng(0)
    x, d = rng.normal(size=(4000, 16)), rng.normal(size=(500, 16))
    x[rng.random(x.shape) < 0.2] = np.nan
    d[rng.random(d.shape) < 0.2] = np.nan
    queries = pa.table({"_uid": np.arange(4000) + 7, "_x": pa.array(list(x))})
    donors = pa.table({"_place": np.arange(500)[::-1] * 3, "_x": pa.array(list(d))})
    tracemalloc.start()
    got = features._tile(5)((), queries, donors)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 16 << 20
    assert got.num_rows == np.isnan(x).sum() and got["_uid"].to_pylist() == (np.nonzero(np.isnan(x))[0] + 7).tolist()
    for r in got.slice(0, 12_000).take(list(range(0, 12_000, 500))).to_pylist():
        own = x[r["_uid"] - 7]
        both = ~np.isnan(own) & ~np.isnan(d)
        far = np.where(np.isnan(d[:, r["_col"]]) | ~both.any(axis=1), np.inf, (np.where(both, own - d, 0) ** 2).sum(axis=1) * 16 / np.maximum(both.sum(axis=1), 1))
        best = np.argsort(far, kind="stable")[:5]
        assert np.allclose([n["far"] for n in r["_near"]], far[best]) and [n["value"] for n in r["_near"]] == d[best, r["_col"]].tolist()
        assert [n["place"] for n in r["_near"]] == ((499 - best) * 3).tolist()
    assert features._tile(5)((), queries, donors.slice(0, 0)).num_rows == features._tile(5)((), queries.slice(0, 0), donors).num_rows == 0

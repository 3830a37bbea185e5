from collections import Counter

import pytest
from pyspark.sql import functions as F

from netquarry.llm import common


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_join_hot(spark, hot):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50 + 100).alias("k"))
    left = left.union(spark.createDataFrame([(9001, None), (9002, 55)], "id long, k long"))
    right = left.filter("k is not null and k <> 55").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    want = Counter(map(tuple, left.join(right, "k", "left").select("id", "k", "n", "top").collect()))
    got = common.join_hot(left, right, "k", "n", "id", hot=hot)
    assert got.columns == ["id", "k", "n", "top"] and Counter(map(tuple, got.collect())) == want


def test_bounds_in_bytes(spark, monkeypatch):
    """Few rows of long texts are no small table, and a hot key of a long text is not broadcast."""
    df = spark.createDataFrame([(k, "x" * 200, 5) for k in range(10)], "k long, t string, n long")
    assert common.bounded(df)[1]
    monkeypatch.setattr(common, "BROADCAST_BYTES", 1000)
    assert not common.bounded(df)[1] and common.bounded(df.select("k"))[1]
    monkeypatch.setattr(common, "KEY_BYTES", 100)
    left = df.select("t").union(df.select("t")).withColumn("i", F.monotonically_increasing_id())
    right = left.groupBy("t").agg(F.count("*").alias("n"))
    got = common.join_hot(left, right, "t", "n", "i", hot=1)
    assert [r.n for r in got.collect()] == [20] * 20 and "BroadcastHashJoin" in got._jdf.queryExecution().toString()


def test_dropped(spark):
    import os

    df = common.written(spark.range(5), "t")
    path = df.__dict__["_written_at"].removeprefix("file:")
    assert os.path.isdir(path)
    common.dropped(df, spark.range(2))
    assert not os.path.exists(path)


def test_shared_folder_of_clusters(spark, monkeypatch):
    """Without a shared folder a cluster's session is told so."""
    from netquarry import session

    class Conf:
        get, set = staticmethod(lambda k, d=None: None), staticmethod(lambda k, v: None)

    class Context:
        master = "spark://head:7077"

    class Session:
        conf, sparkContext = Conf, Context

    import pytest as p

    with p.raises(RuntimeError, match="checkpoint"):
        session.shared_dir(Session)
    Context.master = "local[2]"
    assert session.shared_dir(Session).startswith("file:///")


def test_written_and_names(spark):
    df = spark.createDataFrame([(1, "a")], "id long, _X string")
    assert common.free_name(df, "_x") == "_x_" and common.free_name(df, "y") == "y"
    assert common.written(df, "t").collect() == df.collect()
    assert common.bounded(df, 1)[1] and not common.bounded(df.union(df), 1)[1]
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")

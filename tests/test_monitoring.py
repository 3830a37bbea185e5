"""Batches of streams and measured writes as rows."""

import pytest
from pyspark.sql import functions as F

from netquarry.operators import monitor
from netquarry.streaming import monitoring, scoring


def test_stream_batches(spark, tmp_path):
    """Each batch appears with its rows and seconds; a query that fails has a row with its error."""
    spark.range(30).selectExpr("id as asn", "id % 3 as kind").repartition(3).write.parquet(f"{tmp_path}/in")
    with monitoring.StreamMonitor()(spark) as live:
        stream = scoring.stream_of(spark, f"{tmp_path}/in", "asn long, kind long")
        good = scoring.scored_stream(stream, lambda b: b.withColumn("x", F.lit(1)), f"{tmp_path}/out", f"{tmp_path}/check")
        good.awaitTermination(120)
        assert live.waited(good)

        def fails(batch, n):
            raise ValueError("no such column")

        bad = stream.writeStream.queryName("bad").foreachBatch(fails).option("checkpointLocation", f"{tmp_path}/check2").trigger(availableNow=True).start()
        with pytest.raises(Exception):  # noqa: B017
            bad.awaitTermination(120)
        assert live.waited(bad)
        rows = live.frame(spark)
        got = rows.filter("success and rows > 0").collect()
        assert sum(r.rows for r in got) == 30 and len(got) == 3 and all(r.seconds > 0 for r in got) and {r.batch for r in got} == {0, 1, 2}
        wrong = rows.filter("not success").collect()
        assert [r.component for r in wrong] == ["bad"] and wrong[0].error
        summary = {r.component: r for r in monitor.component_summary(rows).collect()}
        assert summary["bad"].success_rate < 1 and monitor.bottlenecks(monitor.component_summary(rows)).count() >= 2
    before = live.seen
    scoring.scored_stream(stream, lambda b: b, f"{tmp_path}/out3", f"{tmp_path}/check3").awaitTermination(120)
    assert live.seen == before
    small = monitoring.StreamMonitor(most=2)
    for k in range(5):
        small._add("c", k, True, 1, 1.0, 1.0, 0, 0, 0.0, None)
    assert [r.batch for r in small.frame(spark).orderBy("id").collect()] == [3, 4]


def test_observed(spark, tmp_path):
    df = spark.range(100).withColumn("x", F.col("id") % 7)
    got = monitoring.observed(df, lambda d: d.write.parquet(f"{tmp_path}/o"), "write", most=F.max("x"))
    assert got["rows"] == 100 == spark.read.parquet(f"{tmp_path}/o").count() and got["most"] == 6 and got["success"] and got["seconds"] > 0
    bad = monitoring.observed(df, lambda d: d.write.parquet(f"{tmp_path}/o"), "again")
    assert not bad["success"] and bad["rows"] == 0 and bad["error"]

"""Errors and timings as rows: classified, summed, and turned into advice."""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.operators.split import last_n
from netquarry.session import scratch

# Words of a message by category, first match first; and by severity.
CATEGORIES = {
    "api_error": ("api", "openai", "rate limit", "quota", "connection"), "data_error": ("dataframe", "column", "index", "missing", "empty"),
    "model_error": ("model", "prediction", "inference", "classifier"), "validation_error": ("validation",), "configuration_error": ("config",),
}
TYPES = {"validation_error": ("ValidationError", "ValueError"), "configuration_error": ("KeyError",)}
SEVERE = {"critical": ("critical", "fatal", "corrupt"), "high": ("timeout", "memory", "disk")}
# Limits beyond which a component is slow (s), failing, or large (MB), and a run is long (s).
SLOW, LEAST_SUCCESS, LARGE, HUGE, LONG = 5.0, 0.95, 100.0, 500.0, 10.0


def _any(c: Column, words: tuple[str, ...]) -> Column:
    return F.lower(c).rlike("|".join(words))


def category(message: Column, kind: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, words in CATEGORIES.items():
        out = out.when(_any(message, words) | F.coalesce(kind.isin(*TYPES.get(name, ("",))), F.lit(False)), name)
    return out.otherwise("system_error")


def severity(message: Column, category: Column) -> Column:
    return (
        F.when(_any(message, SEVERE["critical"]), "critical").when(category == "system_error", "high").when(_any(message, SEVERE["high"]), "high")
        .when(category.isin("model_error", "api_error"), "medium").otherwise("low")
    )


def error_summary(errors: DataFrame) -> DataFrame:
    """(by, value, n): counts by category, by severity and by component, in one pass. errors: (category, severity, component)."""
    out = errors.groupingSets([[F.col("category")], [F.col("severity")], [F.col("component")]], F.col("category"), F.col("severity"), F.col("component")).agg(
        F.count("*").alias("n"), F.grouping("category").alias("_c"), F.grouping("severity").alias("_s")
    )
    by = F.when(F.col("_c") == 0, "category").when(F.col("_s") == 0, "severity").otherwise("component")
    return out.select(by.alias("by"), F.coalesce("category", "severity", "component").alias("value"), "n")


def component_summary(calls: DataFrame, recent: int | None = None, order: str = "id") -> DataFrame:
    """(component, calls, success_rate, mean_s, least_s, most_s, total_s, mean_mb) of all calls, or of each component's last ones."""
    if recent:
        calls = last_n(calls, [F.desc(order)], recent, ("component",))
    ok = F.avg(F.col("success").cast("double"))
    return calls.groupBy("component").agg(F.count("*").alias("calls"), ok.alias("success_rate"), F.avg("seconds").alias("mean_s"), F.min("seconds").alias("least_s"), F.max("seconds").alias("most_s"), F.sum("seconds").alias("total_s"), F.avg("mb").alias("mean_mb"))


def bottlenecks(summary: DataFrame, n: int = 5) -> DataFrame:
    """The slowest components with what is wrong with them."""
    wrong = F.array_compact(F.array(
        F.when(F.col("mean_s") > SLOW, "slow"), F.when(F.col("success_rate") < LEAST_SUCCESS, "failing"),
        F.when(F.col("mean_mb") > HUGE, "huge").when(F.col("mean_mb") > LARGE, "large"),
    ))
    return summary.orderBy(F.desc("mean_s"), "component").limit(n).withColumn("problems", F.array_join(wrong, ","))


def advice(summary: DataFrame) -> list[str]:
    """Recommendations from the few rows of a summary."""
    out, total = [], 0.0
    for r in summary.orderBy("component").collect():
        total += r["mean_s"]
        if r["mean_s"] > SLOW:
            out.append(f"{r['component']} takes {r['mean_s']:.1f} s a call: use larger batches or more partitions")
        if r["success_rate"] < LEAST_SUCCESS:
            out.append(f"{r['component']} succeeds in {r['success_rate']:.0%} of calls: look at its errors")
        if (r["mean_mb"] or 0) > LARGE:
            out.append(f"{r['component']} grows by {r['mean_mb']:.0f} MB a call: use smaller batches")
    return [*out, f"one run takes {total:.1f} s: look at the slowest components first"] if total > LONG else out


def batch_size(target_s: float, each_s: float, most: int = 100) -> int:
    """The batch that meets a target latency."""
    return max(1, min(most, int(target_s / each_s))) if each_s > 0 else most


def fallback(strategy: str, stage: int) -> list[tuple[str, float]]:
    """What stands for a failed stage: (category, confidence)."""
    if stage == 2 or strategy == "skip":
        return []
    return [("Enterprise", 0.1 if strategy == "default" else 0.05)]


class ErrorLog:
    """Errors of a driver's steps as rows, kept up to a bound, and steps that go on after an error."""

    SCHEMA = "error_id long, kind string, message string, component string, asn long, recovery_action string"

    def __init__(self, most: int = 10_000):
        self.most, self.rows, self.seen = most, [], 0

    def add(self, error: BaseException, component: str, asn: int | None = None, action: str = "raised") -> None:
        self.seen += 1
        self.rows = [*self.rows[-self.most + 1 :], (self.seen, type(error).__name__, str(error), component, asn, action)]

    def frame(self, spark: SparkSession) -> DataFrame:
        """The errors, classified."""
        e = spark.createDataFrame(self.rows, self.SCHEMA)
        e = e.withColumn("category", category(F.col("message"), F.col("kind")))
        return e.withColumn("severity", severity(F.col("message"), F.col("category")))

    def export(self, spark: SparkSession, path: str) -> None:
        """The errors and their summary as JSON lines below a folder."""
        e = self.frame(spark)
        e.coalesce(1).write.mode("overwrite").json(f"{path}/errors")
        error_summary(e).coalesce(1).write.mode("overwrite").json(f"{path}/summary")

    def guarded(self, f: Callable, component: str, fallback: Callable | None = None, tries: int = 1, sleep: Callable[[float], None] = time.sleep) -> Callable:
        """f, tried again after an error, then replaced by the fallback's result, or its last error raised. A table that it returns is computed, so that its errors show here."""

        def run(*args, **kwargs):
            for n in range(tries):
                try:
                    out = f(*args, **kwargs)
                    if isinstance(out, DataFrame):
                        path = scratch(out.sparkSession, component)
                        out.write.parquet(path)
                        out = out.sparkSession.read.schema(out.schema).parquet(path)
                    return out
                except Exception as e:  # every error is a row
                    last = n + 1 == tries
                    self.add(e, component, kwargs.get("asn"), "retry" if not last else "fallback" if fallback else "raised")
                    if last and fallback is None:
                        raise
                    if not last:
                        sleep(2.0**n)
            return fallback(*args, **kwargs)

        return run


class Monitor:
    """Timings of a driver's steps, kept up to a bound, as rows."""

    SCHEMA = "id long, component string, success boolean, seconds double, mb double"

    def __init__(self, most: int = 1000):
        self.most, self.rows, self.seen = most, [], 0

    @contextmanager
    def step(self, component: str):
        start, ok = time.perf_counter(), False
        try:
            yield
            ok = True
        finally:
            self.seen += 1
            self.rows = [*self.rows[-self.most + 1 :], (self.seen, component, ok, time.perf_counter() - start, 0.0)]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.SCHEMA)

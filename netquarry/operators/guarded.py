"""Steps over rows whose errors become rows too, gathered where the rows are.

A step is given a row. One that works on batches may be given beside it: a batch that
it raises for is gone through row by row, so that only rows that fail by themselves are
errors; these are tried again, and then replaced by the fallback's result, if there is
one. Results and errors come from one pass and are written as one table, of which Spark
keeps the files of one attempt of each task: a task that runs again counts no error
twice. Reading them apart is cheap, as they are columns of that table.

Defined cases: an error that isn't an Exception (a worker that dies, an interrupt)
ends the task, as without a guard; a batch step that returns other than a row for each
row has them gone through one by one; a result that its columns can't hold is an error; a fallback that raises leaves the row without a result;
rows keep all their columns, and nulls and repeated rows are rows like any others.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from netquarry.operators import monitor
from netquarry.session import scratch

ERROR = "struct<kind:string,message:string,tries:int,recovery_action:string>"


@dataclass
class Outcome:
    """rows: those of the input with `result` (null if it failed) and `error`, one table."""

    rows: DataFrame
    component: str

    def results(self) -> DataFrame:
        """The columns of the input and of the step's result, of the rows that have one."""
        own = [c for c in self.rows.columns if c not in ("result", "error")]
        return self.rows.filter("result is not null").select(*own, "result.*")

    def errors(self) -> DataFrame:
        """The columns of the input with kind, message, tries, recovery_action, component, category and severity of each error."""
        own = [c for c in self.rows.columns if c not in ("result", "error")]
        e = self.rows.filter("error is not null").select(*own, "error.*").withColumn("component", F.lit(self.component))
        e = e.withColumn("category", monitor.category(F.col("message"), F.col("kind")))
        return e.withColumn("severity", monitor.severity(F.col("message"), F.col("category")))

    def counts(self) -> DataFrame:
        """One row: rows, results, errors, replaced (errors with a fallback's result) and lost ones, in one pass."""
        has, failed = F.col("result").isNotNull(), F.col("error").isNotNull()
        return self.rows.agg(F.count("*").alias("rows"), F.count_if(has).alias("results"), F.count_if(failed).alias("errors"), F.count_if(has & failed).alias("replaced"), F.count_if(~has).alias("lost"))

    def export(self, path: str) -> None:
        """Errors, and their counts by category, severity and component, as JSON lines below a folder."""
        self.errors().write.mode("overwrite").json(f"{path}/errors")
        monitor.error_summary(self.errors()).coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def guarded(df: DataFrame, step: Callable[[dict], dict], schema: str, component: str, batch: Callable[[list[dict]], list[dict]] | None = None, tries: int = 1, fallback: Callable[[dict], dict] | None = None, wait: Callable[[int], float] = lambda n: 0.0, sleep: Callable[[float], None] = time.sleep) -> Outcome:
    """What `step` makes of the rows, and its errors. step and fallback: a row to a dict of `schema`; batch: rows to such dicts, tried first; tries: of each row by itself."""
    spark = df.sparkSession
    kind = spark.createDataFrame([], schema).schema
    error_kind = spark.createDataFrame([], f"e {ERROR}").schema["e"].dataType
    whole = StructType([*df.schema.fields]).add("result", kind).add("error", error_kind)
    names, of_result, of_error = kind.names, to_arrow_type(kind), to_arrow_type(error_kind)
    result_kinds = [to_arrow_type(f.dataType) for f in kind]

    def made(r: dict) -> dict:
        """The result as its columns hold it, so that one that they can't hold is an error of its row."""
        return {c: pa.scalar(r[c], t).as_py() for c, t in zip(names, result_kinds, strict=True)}

    def one(row: dict) -> tuple[dict | None, dict | None]:
        for n in range(tries):
            try:
                return made(step(row)), None
            except Exception as e:  # every error is a row
                error = {"kind": type(e).__name__, "message": str(e), "tries": n + 1, "recovery_action": "dropped"}
                if n + 1 < tries:
                    sleep(wait(n))
        if fallback is not None:
            try:
                return made(fallback(row)), {**error, "recovery_action": "fallback"}
            except Exception as e:
                error["message"] += f"; fallback: {type(e).__name__}: {e}"
        return None, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found = b.to_pylist(), None
            if batch is not None and rows:
                try:
                    out = batch(rows)
                    found = [(made(r), None) for r in out] if len(out) == len(rows) else None
                except Exception:  # noqa: S110
                    pass  # its rows tell which of them fail
            found = [one(r) for r in rows] if found is None else found
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r for r, _ in found], of_result), pa.array([e for _, e in found], of_error)], [*b.schema.names, "result", "error"])

    path = scratch(spark, "guarded")
    df.mapInArrow(run, whole).write.parquet(path)
    return Outcome(spark.read.schema(whole).parquet(path), component)

"""Live monitoring: batches of streams and writes of tables as rows of timings.

`StreamMonitor` is a listener of streaming queries: each batch of each query becomes a
row as it ends, with its rows, seconds, state rows and late rows, and a query that ends
with an error one with that error. `observed` counts what passes through a plan while it
is being written, in the same pass. Both give the columns that
`operators.monitor.component_summary` takes, so that summaries, bottlenecks and advice
hold for live queries too.

Rows are kept up to a bound, the last ones: a batch is a row, whatever its size. Batches
without input that Spark reports are rows of 0; a query without a name has its id.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable
from threading import Condition

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

BATCHES = "id long, component string, batch long, success boolean, rows long, seconds double, rows_per_second double, state_rows long, late_rows long, mb double, error string"


class StreamMonitor(StreamingQueryListener):
    """Batches of all streaming queries of a session. Use as a context, or with attach and detach."""

    def __init__(self, most: int = 10_000):
        self.rows: deque[tuple] = deque(maxlen=most)
        self.seen, self.ended, self.names, self.news, self.spark = 0, set(), {}, Condition(), None

    def onQueryStarted(self, event) -> None:
        with self.news:
            self.names[str(event.runId)] = event.name or str(event.id)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        took = p.batchDuration / 1000
        state = sum(s.numRowsTotal for s in p.stateOperators)
        late = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        mb = sum(s.memoryUsedBytes for s in p.stateOperators) / 1e6
        self._add(p.name or str(p.id), p.batchId, True, p.numInputRows, took, p.numInputRows / took if took else 0.0, state, late, mb, None)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self._add(self.names.get(str(event.runId), str(event.id)), None, False, 0, 0.0, 0.0, 0, 0, 0.0, event.exception.split("\n")[0])
        with self.news:
            self.ended.add(str(event.runId))
            self.news.notify_all()

    def _add(self, component: str, batch: int | None, *rest) -> None:
        with self.news:
            self.seen += 1
            self.rows.append((self.seen, component, batch, *rest))
            self.news.notify_all()

    def waited(self, query, seconds: float = 60.0) -> bool:
        """Whether all events of a query that has ended have come; events come after what they tell."""
        until = time.monotonic() + seconds
        with self.news:
            while str(query.runId) not in self.ended:
                left = until - time.monotonic()
                if left <= 0:
                    return False
                self.news.wait(left)
        return True

    def frame(self, spark: SparkSession) -> DataFrame:
        with self.news:
            return spark.createDataFrame(list(self.rows), BATCHES)

    def attach(self, spark: SparkSession) -> StreamMonitor:
        self.spark = spark
        spark.streams.addListener(self)
        return self

    def detach(self) -> None:
        self.spark.streams.removeListener(self)

    def __call__(self, spark: SparkSession) -> StreamMonitor:
        self.spark = spark
        return self

    def __enter__(self) -> StreamMonitor:
        return self.attach(self.spark)

    def __exit__(self, *error) -> None:
        self.detach()


def observed(df: DataFrame, write: Callable[[DataFrame], None], component: str, **measures: Column) -> dict:
    """Write df and measure it in the same pass: component, success, rows, seconds, error, and `measures`, aggregates by name. A write that fails is a row with its error."""
    seen = Observation(f"{component}-{time.time_ns()}")
    start, error = time.perf_counter(), None
    try:
        write(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in measures.items()]))
    except Exception as e:  # the error is the row's
        error = f"{type(e).__name__}: {str(e)[:500]}"
    found = {} if error else seen.get
    return {"component": component, "success": error is None, "rows": found.get("rows", 0), "seconds": time.perf_counter() - start, "error": error, **{n: found.get(n) for n in measures}}

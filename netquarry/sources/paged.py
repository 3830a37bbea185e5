"""A paged remote source as a Spark data source: a partition for each page, tried again on failure, failures as rows."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Rows of a page, and tries of a request.
PAGE, TRIES = 10_000, 3


def paged_source(name: str, schema: str, fetch: Callable[[int, int], list[tuple]], total: int, page: int = PAGE) -> type[DataSource]:
    """A data source class to register; fetch(offset, first) gives a page's rows."""

    class Page(InputPartition):
        def __init__(self, offset: int):
            self.offset = offset

    class Reader(DataSourceReader):
        def partitions(self):
            return [Page(k) for k in range(0, max(total, 1), page)]

        def read(self, part):
            yield from fetch(part.offset, page)

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader()

    return Paged


def page_query(first: int, offset: int) -> dict:
    """The body of a page's request."""
    # Fixed value: the fields of a record in the remote interface.
    fields = "asn asnName rank organization{orgId orgName} cliqueMember seen longitude latitude country{iso name} cone{numberAsns numberPrefixes numberAddresses} asnDegree{provider peer customer total transit sibling} announcing{numberPrefixes numberAddresses}"
    return {"query": f"{{asns(first:{first},offset:{offset}){{totalCount pageInfo{{first hasNextPage}} edges{{node{{{fields}}}}}}}}}"}


def backoff(status: int, attempt: int) -> float | None:
    """Seconds to wait after a status, None if it isn't worth another try."""
    if status == 429:
        return float(min(5 * 2**attempt, 30))
    return float(min(2 * 2**attempt, 10)) if status >= 500 or status == 0 else None


def fetched(keys: DataFrame, key: str, get: Callable[[int], tuple[int, str]], concurrency: int = 5, tries: int = TRIES, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(key, body, error) for each key: get gives (status, body); partitions bound the concurrency."""

    def one(k: int) -> tuple[str | None, str | None]:
        error = "no try"
        for n in range(tries):
            try:
                status, body = get(k)
            except Exception as e:  # a failed request is its row's
                status, body, error = 0, "", f"{type(e).__name__}: {e}"
            if status == 200:
                return body, None
            error = f"status {status}" if status else error
            wait = backoff(status, n)
            if wait is None:
                break
            if n + 1 < tries:
                sleep(wait)
        return None, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [one(int(k)) for k in b[key]]
            yield pd.DataFrame({key: b[key], "body": pd.Series([g[0] for g in got], index=b.index, dtype=object), "error": pd.Series([g[1] for g in got], index=b.index, dtype=object)})

    return keys.select(F.col(key).cast("long").alias(key)).repartition(concurrency, key).mapInPandas(run, f"{key} long, body string, error string")


def batch_metadata(rows: DataFrame) -> DataFrame:
    """One row: total, succeeded, failed and the share of successes."""
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.count("error").alias("failed"), F.coalesce(F.avg(F.col("error").isNull().cast("double")), F.lit(0.0)).alias("success_rate"))


def gathered(sources: DataFrame, get: Callable[[str, str], str]) -> DataFrame:
    """(source, body, error) of (source, place): each source in a task of its own; one that fails is a row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, place in zip(b["source"], b["place"], strict=True):
                try:
                    body, error = get(name, place), None
                except Exception as e:  # the other sources go on
                    body, error = None, f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"source": [name], "body": pd.Series([body], dtype=object), "error": pd.Series([error], dtype=object)})

    n = min(1000, max(1, sources.count()))
    return sources.select("source", "place").repartition(n, "source").mapInPandas(run, "source string, body string, error string")


def downloaded(spark: SparkSession, jobs: dict[str, Callable[[], str]], wanted: list[str]) -> dict[str, str]:
    """What each source's job gives, or its error; ValueError for unknown sources."""
    from concurrent.futures import ThreadPoolExecutor

    if bad := [w for w in wanted if w not in jobs]:
        raise ValueError(f"unknown sources: {bad}")

    def run(name: str) -> str:
        try:
            return jobs[name]()
        except Exception as e:  # the other sources go on
            return json.dumps({"error": f"{type(e).__name__}: {e}"})

    with ThreadPoolExecutor(len(wanted) or 1) as pool:
        return dict(zip(wanted, pool.map(run, wanted), strict=True))

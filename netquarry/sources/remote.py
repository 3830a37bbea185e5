"""Downloads of the remote sources as tables or files; the request is an injected callable, by default one of the standard library."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry import schemas
from netquarry.session import write_text
from netquarry.sources import paged

Get = Callable[[str, bytes | None], tuple[int, str]]


def http(url: str, body: bytes | None = None, timeout: float = 60.0) -> tuple[int, str]:
    """(status, text) of a request; 0 where none came back."""
    request = urllib.request.Request(url, data=body, headers={"Content-Type": "application/json"} if body else {})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.status, r.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, ""
    except OSError as e:
        return 0, str(e)


def asked(get: Get, url: str, body: bytes | None = None, tries: int = paged.TRIES, sleep: Callable[[float], None] = time.sleep) -> str:
    """The text of an answer; RuntimeError after the last try."""
    for n in range(tries):
        status, text = get(url, body)
        if status == 200:
            return text
        wait = paged.backoff(status, n)
        if wait is None or n + 1 == tries:
            break
        sleep(wait)
    raise RuntimeError(f"{url}: status {status}")


def ranking(spark: SparkSession, url: str, get: Get = http, page: int = paged.PAGE) -> DataFrame:
    """The whole ranking, a partition for each page; the first page tells how many there are."""

    def one(offset: int, first: int) -> dict:
        found = json.loads(asked(get, url, json.dumps(paged.page_query(first, offset)).encode()))
        if found.get("errors"):
            raise RuntimeError(str(found["errors"])[:200])
        return found["data"]["asns"]

    total = one(0, 1)["totalCount"]
    kind = paged.paged_source("ranking_pages", "value string", lambda offset, first: [(json.dumps(e["node"]),) for e in one(offset, first)["edges"]], total, page)
    spark.dataSource.register(kind)
    rows = spark.read.format("ranking_pages").load()
    return rows.select(F.from_json("value", schemas.ASRANK).alias("r")).select("r.*")


def dated(template: str, target: date, get: Get = http, reach: int = 7, today: date | None = None, least: int = 1) -> tuple[date, str]:
    """(date, text) of the snapshot nearest to the target: the template's {date} is tried from the target outwards, the past first, days to come left out."""
    days = [target, *(target + timedelta(days=s * n) for n in range(1, reach + 1) for s in (-1, 1))]
    for d in days:
        if today is not None and d > today:
            continue
        status, text = get(template.format(date=d.isoformat(), compact=d.strftime("%Y%m%d"), year=f"{d:%Y}", month=f"{d:%m}", day=f"{d:%d}"), None)
        if status == 200 and len(text) >= least:
            return d, text
    raise RuntimeError(f"no snapshot within {reach} days of {target}")


def saved(spark: SparkSession, path: str, text: str) -> str:
    write_text(spark, path, text)
    return path


def info(keys: DataFrame, key: str, template: str, get: Get = http, concurrency: int = 5) -> DataFrame:
    """(key, body, error) of each key's record; the template has {key}."""
    return paged.fetched(keys, key, lambda k: get(template.format(key=k), None), concurrency)

"""Answers of a remote model, saved as they come, each asked for once.

Prompts are dealt to buckets by key. A task writes the answers of a bucket as small
files, each closed under another name and then renamed, so that a file is there whole
or not at all: these files are the log of kept answers, by key and attempt. A task that
begins a bucket reads which keys the log has and asks for the others alone; so do a task
that Spark runs again, and a job that is started again after a crash. Only answers on
their way when a worker dies are asked for again, `flush` of them at most for each task.

A job holds a lease on its folder while it runs: a second one that is started beside it
ends with an error and asks for nothing. A job that died leaves its lease, which
`take_over` sets aside.

Defined cases: failed requests are no answers and are asked for by the next job; a
prompt with a null key has none to be found by and is an error; prompts that share a
key are asked for once; an attempt that Spark gave up and that goes on all the same
may ask for a key twice, of which the answer saved first counts.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor, as_completed

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.operators import chat
from netquarry.session import is_folder, lease, released

BUCKETS, FLUSH = 64, 10


def known(folder: str, bucket: int) -> set[str]:
    """Keys of a bucket that have an answer."""
    files, path = fs.FileSystem.from_uri(folder)
    out: set[str] = set()
    for f in files.get_file_info(fs.FileSelector(f"{path}/bucket={bucket:05d}", allow_not_found=True)):
        if f.path.endswith(".json"):
            with files.open_input_stream(f.path) as s:
                out |= {json.loads(x)["key"] for x in s.read().decode("utf-8").splitlines()}
    return out


def _asker(folder: str, model: Callable[[list[str]], list[str]], tries: int, flush: int, concurrency: int, wait: Callable[[int], float], sleep: Callable[[float], None]):
    def ask(prompt: str) -> str | None:
        for n in range(tries):
            try:
                return model([prompt])[0]
            except Exception:  # a failed request has no answer
                if n + 1 < tries:
                    sleep(wait(n))
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, path = fs.FileSystem.from_uri(folder)
        bucket, have, attempt, nth, asked, failed = None, set(), uuid.uuid4().hex, 0, 0, 0

        def save(bucket: int, answers: list[tuple[str, str]]) -> None:
            nonlocal nth
            files.create_dir(own := f"{path}/bucket={bucket:05d}", recursive=True)
            place, nth = f"{own}/{time.time_ns()}-{attempt}-{nth:06d}", nth + 1
            with files.open_output_stream(f"{place}.part") as s:
                s.write("".join(json.dumps({"key": k, "response": r}) + "\n" for k, r in answers).encode("utf-8"))
            files.move(f"{place}.part", f"{place}.json")

        with ThreadPoolExecutor(concurrency) as pool:
            for b in batches:
                for number, rows in b.groupby("bucket", sort=False):
                    if number != bucket:
                        bucket, have = number, known(folder, int(number))
                    todo = [(k, p) for k, p in zip(rows["key"], rows["prompt"], strict=True) if k not in have]
                    for at in range(0, len(todo), flush):
                        jobs = {pool.submit(ask, p): k for k, p in todo[at : at + flush]}
                        got = [(jobs[j], j.result()) for j in as_completed(jobs)]
                        if kept := [(k, r) for k, r in got if r is not None]:
                            save(int(number), kept)
                            have |= {k for k, _ in kept}
                        asked, failed = asked + len(got), failed + len(got) - len(kept)
        yield pd.DataFrame({"asked": [asked], "failed": [failed]})

    return run


def answers(spark: SparkSession, path: str) -> DataFrame:
    """(key, response) of all that is saved, each key once: the answer that was saved first."""
    own = spark.createDataFrame([], "key string, response string")
    if not is_folder(spark, f"{path}/answers"):
        return own
    rows = spark.read.schema("key string, response string").option("pathGlobFilter", "*.json").json(f"{path}/answers")
    return rows.select("key", "response", F.col("_metadata.file_name").alias("_at")).groupBy("key").agg(F.min_by("response", "_at").alias("response"))


def responses_once(prompts: DataFrame, model: Callable[[list[str]], list[str]], path: str, key: str, buckets: int = BUCKETS, flush: int = FLUSH, tries: int = chat.TRIES, concurrency: int = 5, take_over: bool = False, wait: Callable[[int], float] = lambda n: 2.0 * 2**n, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """The prompts with `response`, null where no answer could be had; see above. prompts: `key` and `prompt`; path: a folder for this table of prompts."""
    spark = prompts.sparkSession
    if not prompts.filter(F.col(key).isNull()).isEmpty():
        raise ValueError("a prompt without key")
    own = lease(spark, f"{path}/_lease", take_over)
    try:
        named = prompts.select(F.col(key).cast("string").alias("key"), "prompt").groupBy("key").agg(F.min("prompt").alias("prompt"))
        dealt = named.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
        dealt = dealt.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "key")
        dealt.mapInPandas(_asker(f"{path}/answers", model, tries, flush, concurrency, wait, sleep), "asked long, failed long").agg(F.sum("asked"), F.sum("failed")).collect()
    finally:
        released(spark, own)
    got = answers(spark, path).withColumnRenamed("key", "_key")
    return prompts.join(got, F.col(key).cast("string") == F.col("_key"), "left").drop("_key")

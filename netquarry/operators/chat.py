"""Requests to language models and their answers: messages, examples, prompts, batches, parsing, retries.

The model itself is an injected callable, list of prompts to list of JSON texts;
`keyword_model` is a deterministic one for tests.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from threading import Lock

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from netquarry.functions import exprs as X
from netquarry.operators import labels as L
from netquarry.operators import split

#: Tries, and dollars for a thousand tokens of training by model family.
TRIES = 3
TOKENS_EACH, PRICES = 1000, {"large": 0.010, "small": 0.008}
ROLES = ("system", "user", "assistant")


def user_message(key: str, name: str, country: str, website: str) -> Column:
    """Lines about an organisation; what is null is left out."""
    line = lambda label, c: F.concat(F.lit(f"{label}: "), F.col(c).cast("string"))
    return F.concat_ws("\n", line("ASN", key), line("Name", name), line("Country", country), line("Website", website))


def examples(labels: DataFrame, features: DataFrame, key: str, tags: list[str], system_prompt: str, names: tuple[str, str, str] = ("name", "country", "website")) -> DataFrame:
    """(key, value): a chat example as JSON for each row with a tag; tags are in the order given, with blanks for underscores."""
    met = labels.select(key, L.tags(tags).alias("_tags")).filter(F.size("_tags") > 0).join(features, key)
    answer = F.to_json(F.struct(F.transform("_tags", lambda t: F.replace(t, F.lit("_"), F.lit(" "))).alias("tags")))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    chat = F.array(message("system", F.lit(system_prompt)), message("user", user_message(key, *names)), message("assistant", answer))
    return met.select(key, F.to_json(F.struct(chat.alias("messages"))).alias("value"))


def example_problems(df: DataFrame, messages: str = "messages") -> Column:
    """Problems of a chat example, an array of texts."""
    m = F.col(messages)
    roles = F.transform(m, lambda x: x["role"])
    answer = F.get(m, F.size(m) - 1)["content"]
    return F.array_compact(F.array(
        F.when(F.coalesce(F.size(m), F.lit(0)) != 3, "not three messages"),
        F.when(~F.coalesce(roles == F.array(*map(F.lit, ROLES)), F.lit(False)), "roles out of order"),
        F.when(F.exists(m, lambda x: ~X.truthy(X.stripped(x["content"]))), "empty content"),
        F.when(F.try_parse_json(answer).isNull(), "answer is no JSON"),
    ))


def batch_prompts(df: DataFrame, key: str, name: str, website: str, country: str, size: int = 5, seed: int | None = None) -> DataFrame:
    """(batch, n, keys, prompt): one message for each batch, its lines in the batch's order."""
    line = F.concat(F.lit("- ASN "), F.col(key).cast("string"), F.lit(": "), F.coalesce(F.col(name), F.lit("Unknown")), F.lit(" ("), F.concat_ws(", ", F.col(website), F.col(country)), F.lit(")"))
    rows = split.batches(df, key, size, seed).groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("in_batch", F.col(key).alias("key"), line.alias("line")))).alias("rows"))
    return rows.select("batch", F.size("rows").alias("n"), F.transform("rows", lambda r: r["key"]).alias("keys"), F.concat_ws("\n", F.lit("Classify these organizations:"), F.transform("rows", lambda r: r["line"])).alias("prompt"))


def taxonomy_prompt(taxonomy: DataFrame, template: str, category: str | None = None) -> DataFrame:
    """One row, prompt: the template with a line for each category in file order, or for each subcategory of one."""
    rows = taxonomy.filter(F.col("category") == category) if category else taxonomy
    if category:
        known = rows.agg(F.count("*").alias("n"), F.count("subcategory").alias("s")).first()
        if not known["n"]:
            raise KeyError(category)
        if not known["s"]:
            raise ValueError(f"{category} has no subcategories")
        line = F.concat(F.lit("- "), "subcategory", F.lit(": "), "description")
    else:
        line = F.concat(F.lit("- "), F.concat_ws(" / ", "category", "subcategory"), F.lit(": "), "description")
    block = rows.agg(F.sort_array(F.collect_list(F.struct("ord", line.alias("line")))).alias("lines"))
    return block.select(F.replace(F.lit(template), F.lit("{categories}"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("prompt"))


def tag_names(taxonomy: DataFrame, flat: bool) -> DataFrame:
    """(ord, tag): sanitised names, flat ones (category_sub) sorted, categories in file order."""
    if not flat:
        return taxonomy.groupBy(X.sanitised(F.col("category")).alias("tag")).agg(F.min("ord").alias("ord"))
    names = taxonomy.select(X.sanitised(F.concat_ws("_", "category", "subcategory")).alias("tag")).distinct()
    return names.select(F.row_number().over(_by("tag")).alias("ord"), "tag")


def _by(c: str):
    from pyspark.sql import Window

    return Window.orderBy(c)  # a row for each category of a taxonomy


def filtered_taxonomy(taxonomy: DataFrame, wanted: list[str]) -> DataFrame:
    """The categories asked for, in that order; ValueError for unknown ones."""
    known = {r["category"] for r in taxonomy.select("category").distinct().collect()}
    if bad := [c for c in wanted if c not in known]:
        raise ValueError(f"unknown categories: {bad}")
    place = F.array_position(F.array(*map(F.lit, wanted)), F.col("category"))
    return taxonomy.filter(F.col("category").isin(*wanted)).withColumn("ord", (place * 100_000 + F.col("ord")).cast("int"))


def parsed(df: DataFrame, key: str, keys: str, response: str, tags: list[str]) -> DataFrame:
    """A row (key, 0/1 for each tag) for each key of a batch; answer j is that of key j; keys without one, and answers that can't be read, have zeros. Tags may have blanks for underscores."""
    answers = F.from_json(F.col(response), "responses array<struct<tags:array<string>>>")["responses"]
    rows = df.select(F.posexplode(keys).alias("at", key), answers.alias("answers"))
    own = F.transform(F.coalesce(F.get("answers", F.col("at"))["tags"], F.array().cast("array<string>")), lambda t: F.replace(t, F.lit(" "), F.lit("_")))
    return rows.select(key, own.alias("own")).select(key, *[F.array_contains("own", t).cast("int").alias(t) for t in tags])


def responses(prompts: DataFrame, model: Callable[[list[str]], list[str]], tries: int = TRIES, wait: Callable[[int], float] = lambda n: 2.0 * 2**n, sleep: Callable[[float], None] = time.sleep, concurrency: int = 5, delay: float = 0.0) -> DataFrame:
    """The prompts with `response` and `error`: failures are tried again after waiting, then become data.

    A task sends up to `concurrency` requests at once, and begins them `delay` seconds apart at least.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gate, due = Lock(), [0.0]

        def begin() -> None:
            with gate:
                now = time.monotonic()
                at = max(now, due[0])
                due[0] = at + delay
            if at > now:
                sleep(at - now)

        def ask(prompt: str) -> tuple[str | None, str | None]:
            for n in range(tries):
                try:
                    begin()
                    return model([prompt])[0], None
                except Exception as e:  # any failure of a remote model is its row's
                    error = f"{type(e).__name__}: {e}"
                    if n + 1 < tries:
                        sleep(wait(n))
            return None, error

        with ThreadPoolExecutor(concurrency) as pool:
            for b in batches:
                got = list(pool.map(ask, b["prompt"]))
                yield b.assign(response=pd.Series([g[0] for g in got], index=b.index, dtype=object), error=pd.Series([g[1] for g in got], index=b.index, dtype=object))

    schema = StructType([*prompts.schema.fields, StructField("response", StringType()), StructField("error", StringType())])
    return prompts.mapInPandas(run, schema)


def responses_saved(prompts: DataFrame, model: Callable[[list[str]], list[str]], path: str, key: str, rounds: int = 8, **options) -> DataFrame:
    """`responses`, saved below `path` round by round; a job that is started again asks only for the keys that have no answer there yet."""
    spark = prompts.sparkSession
    schema = StructType([*prompts.schema.fields, StructField("response", StringType()), StructField("error", StringType())])
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    for k in range(rounds):
        mine = prompts.filter(F.pmod(F.xxhash64(key), F.lit(rounds)) == k)
        done = spark.read.schema(schema).parquet(path).filter("error is null").select(key)
        responses(mine.join(done, key, "left_anti"), model, **options).filter("error is null").write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def keyword_model(words: dict[str, tuple[str, ...]]) -> Callable[[list[str]], list[str]]:
    """Tags each line of a prompt by the words in it."""

    def answer(prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            lines = [x for x in p.split("\n") if x.startswith("- ASN ")]
            out.append(json.dumps({"responses": [{"tags": [t for t, ws in words.items() if any(w in x.lower() for w in ws)]} for x in lines]}))
        return out

    return answer


def _tags(tags: list[str] | str) -> Column:
    """Tags of all rows, or the name of a column of each row's own."""
    return F.col(tags) if isinstance(tags, str) else F.array(*map(F.lit, tags))


def token_probabilities(df: DataFrame, key: str, tokens: str, tags: list[str] | str) -> DataFrame:
    """(key, tag, probability): the greatest probability of a token that holds the tag, in any case. tokens: array of structs (token, logprob)."""
    best = lambda tag: F.array_max(F.transform(F.filter(tokens, lambda t: F.contains(F.lower(t["token"]), F.lower(tag))), lambda t: F.exp(t["logprob"])))
    rows = df.select(key, F.inline(F.transform(F.array_distinct(_tags(tags)), lambda tag: F.struct(tag.alias("tag"), best(tag).alias("probability")))))
    return rows.filter("probability is not null")


def start_probabilities(df: DataFrame, key: str, tokens: str, tags: list[str] | str) -> DataFrame:
    """(key, tag, at, probability): of the token in which a tag's text starts, for each place in the joined tokens."""
    text = F.array_join(F.transform(tokens, lambda t: t["token"]), "")
    rows = df.select(key, F.col(tokens).alias("t"), text.alias("text"), F.explode(F.array_distinct(_tags(tags))).alias("tag")).filter(F.contains("text", F.col("tag")))
    # What stands before each token, only for rows with a tag, in one pass over the tokens.
    ends = F.aggregate("t", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x["token"]))))
    rows = rows.withColumn("starts", F.slice(ends, 1, F.size("t"))).withColumn("at", F.explode(F.filter(F.sequence(F.lit(0), F.length("text")), lambda i: F.substr(F.col("text"), i + 1, F.length("tag")) == F.col("tag"))))
    token = F.size(F.filter("starts", lambda s: s <= F.col("at"))) - 1
    return rows.select(key, "tag", F.col("at").cast("int").alias("at"), F.exp(F.get("t", token)["logprob"]).alias("probability"))


def training_cost(n: Column, model: str = "large") -> Column:
    return n * TOKENS_EACH / 1000 * PRICES[model]

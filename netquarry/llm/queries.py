"""The queries of the document operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.llm import bpe, collocations, exact_dedup, filter_audit, histogram_sort, jaccard_join, mixing, pii, quality_rules, simhash_anchors, sst, token_counts, toxicity


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pre_tokens() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_docs", "host_failed")


def op2_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = histogram_sort.shards(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans, and what each is replaced by: the sanitised text follows from these (`pii.replaced_text`)."""
    return pii.found(table(spark, sf_dir, "documents")).drop("shares")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"), pre_tokens())


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture as large as the corpus, near even: 95 % of the greatest entropy; each copy with its pass and position."""
    return mixing.passes(table(spark, sf_dir, "documents"), entropy=0.95, budget=1.0, tokenizer=(tokenizer("byte_bpe_multi_50k.tiktoken"), pre_tokens()))


def op8_sst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sst.read_back(*sst.write_shards(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), pre_tokens(), end_id=2))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))  # a null doc_id isn't held out, and has no label
    model = toxicity.trained(docs, labels.filter(~held_out))
    out = toxicity.scored(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "worst_sentence")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), pre_tokens())


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), longest=5, least=100, top=2000)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_anchors.near_duplicates(table(spark, sf_dir, "documents"), k=3, bits=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_docs")


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_histogram_sort, op3_pii, op4_jaccard_join, op5_bpe, op6_exact_dedup, op7_mixing, op8_sst, op9_toxicity, op10_token_counts,
        op11_collocations, op12_filter_audit, op13_simhash,
    )
}

ORACLE = {
    "op1_quality_rules": """
        with d as (select doc_id, source, coalesce(text, '') as t from documents),
        w as (select *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
        g as (select doc_id, unnest(range(1, len(w) - 3)) as i, w from w),
        s as (select doc_id, i, count(*) over (partition by doc_id, array_to_string(w[i:i + 4], ' ')) as n from g),
        c as (select doc_id, i + k as p from s, range(5) r(k) where n > 1 group by all),
        r as (select doc_id, count(*) as n_repeat_words from c group by doc_id),
        b as (select w.doc_id, source, len(w) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
                length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
              from w left join r on w.doc_id = r.doc_id),
        f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from b),
        h as (select source, count(*) as n, cast(sum(base_failed::int) as bigint) as f from f where source is not null group by source),
        m as (select sum(f) / sum(n) as m, count(*) as h, sum(n) as nn, sum(n * n) as n2, sum(f * f / n) as ff from h),
        o as (select *, nn - n2 / nn - (h - 1) as free, ((ff - m * m * nn) / nullif(m * (1 - m), 0) - (h - 1)) / nullif(nn - n2 / nn - (h - 1), 0) as r from m),
        p as (select m, case when free > 0 and r > 1e-9 then greatest(1 / least(r, 1.0) - 1, 2.0) end as weight from o),
        v as (select source, n, f, case when weight is null then m else (f + m * weight) / (n + weight) end >= 0.5 as rejected from h, p)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not coalesce(rejected, false) as kept, n as host_docs, f as host_failed
        from f left join v on f.source = v.source
    """,
    "op4_jaccard_join": """
        with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
        s as (select doc_id, case when len(w) >= 3 then list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from w),
        g as (select doc_id, len(s) as n, unnest(s) as g from s),
        l as (select a.doc_id as a, b.doc_id as b from g a join g b on a.g = b.g and a.doc_id <> b.doc_id and 100 * a.n >= 90 * b.n and 100 * b.n >= 90 * a.n
              group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
        r as (select doc_id, doc_id as r from documents union select r.doc_id, l.b from r join l on r.r = l.a)
        select s.doc_id, cast(len(s.s) as bigint) as n_shingles, min(r.r) as component_id from s join r on s.doc_id = r.doc_id group by s.doc_id, len(s.s)
    """,
    "op6_exact_dedup": """
        with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as norm from documents),
        g as (select norm, min(doc_id) as keep_id, count(*) as group_size from n group by norm)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(n.norm) as text_sha256 from n join g on n.norm = g.norm
    """,
    "op11_collocations": r"""
        with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
        w as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w from p),
        g as (select lang, m, array_to_string(w[i:i + m - 1], ' ') as phrase from (select lang, m, w, unnest(range(1, len(w) - m + 2)) as i from w, range(1, 6) r(m))),
        f as (select lang, m, phrase, count(*) as a from g group by all having count(*) >= 100),
        n as (select lang, cast(sum(len(w)) as bigint) as n from w group by lang),
        c as (select lang, m, phrase, a, string_split(phrase, ' ') as w, unnest(range(1, m)) as k from f where m > 1),
        s as (select c.lang, c.m, c.phrase, c.a, k, l.a as l, r.a as r, n.n, (1000::hugeint * c.a * n.n) // (l.a::hugeint * r.a) as score
              from c join n on c.lang = n.lang join f l on l.lang = c.lang and l.phrase = array_to_string(w[1:k], ' ') join f r on r.lang = c.lang and r.phrase = array_to_string(w[k + 1:c.m], ' ')),
        b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
        i as (select lang, phrase, max(a) as cover from (select lang, a, array_to_string(w[i:i + j - 1], ' ') as phrase from (select lang, a, w, j, unnest(range(1, m - j + 2)) as i from (select distinct lang, m, a, w from c), range(2, 5) q(j) where j < m)) group by all),
        o as (select b.*, row_number() over (partition by b.lang order by score desc, b.a desc, b.phrase) as rank from b left join i on b.lang = i.lang and b.phrase = i.phrase where coalesce(cover, 0) < b.a)
        select lang, rank, phrase, a, l, r, n, cast(score as bigint) as score from o where rank <= 2000
    """,
    "op12_filter_audit": r"""
        with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
        w as (select *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w, min(doc_id) over (partition by t) as first from d),
        q as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
        f as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, map {'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w), 'C': 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t), 'D': regexp_matches(t, '[#$%&*|]'), 'E': w.doc_id > first} as fails
              from w left join q on w.doc_id = q.doc_id),
        l as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
        o as (select a.x || b.x || c.x || d.x || e.x as filter_order from l a, l b, l c, l d, l e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        g as (select part, good, toxic, map_values(fails) as v, count(*) as n, list_transform(list_filter(map_entries(any_value(fails)), lambda e: e.value), lambda e: e.key) as failed from f group by part, good, toxic, map_values(fails)),
        s as (select part, filter_order, k as step, filter_order[k] as letter, n, good, toxic, failed, list_contains(failed, filter_order[k]) as here, len(list_filter(failed, lambda e: contains(filter_order[1:k - 1], e))) > 0 as gone from g, o, range(1, 6) r(k)),
        t as (select part, filter_order, step, letter, cast(sum(case when not gone and not here then n else 0 end) as bigint) as kept, cast(sum(case when not gone and here then n else 0 end) as bigint) as removed,
                cast(sum(case when gone and here then n else 0 end) as bigint) as redundant, cast(sum(case when here and len(failed) = 1 then n else 0 end) as bigint) as unique_fails,
                cast(sum(case when not gone and here then n * good else 0 end) as bigint) as good_lost, cast(sum(case when not gone and here then n * toxic else 0 end) as bigint) as toxic_lost from s group by all)
        select part, filter_order, cast(step as int) as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, cast(sum(removed) over (partition by part, letter) as bigint) as shapley from t
    """,
}

"""Queries of files, fetches, jobs, reports and whole-table utilities: what is written is read back and held against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from netquarry import schemas
from netquarry.operators import chat, evaluate, features, integrate, labels, models, quality, split
from netquarry.plans import jobs, two_stage
from netquarry.plans.registry import Registry
from netquarry.session import scratch
from netquarry.sources import paged, readers, sinks
from netquarry.streaming import scoring

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


def _spark(t):
    return t("region").sparkSession


# sources


@query("select n, n * 7 % 101 as rest from (select unnest(range((select count(*) from orders))) as n)")
def paged_source(t):
    """As many rows as orders, fetched page by page."""
    spark, total = _spark(t), t("orders").count()
    kind = paged.paged_source("pages_of_numbers", "n long, rest long", lambda offset, first: [(n, n * 7 % 101) for n in range(offset, min(offset + first, total))], total, 1000)
    spark.dataSource.register(kind)
    return spark.read.format("pages_of_numbers").load()


def _fetched(t):
    def get(k):
        if k % 11 == 0:
            raise OSError(f"down {k}")
        return (404, "") if k % 7 == 0 else (503, "") if k % 13 == 0 else (200, f"body {k}")

    return paged.fetched(t("customer").select(F.col("c_custkey").alias("asn")), "asn", get, sleep=lambda s: None)


_FETCHED = """select c_custkey as asn, case when c_custkey % 11 = 0 or c_custkey % 7 = 0 or c_custkey % 13 = 0 then null else 'body ' || c_custkey end as body,
    case when c_custkey % 11 = 0 then 'OSError: down ' || c_custkey when c_custkey % 7 = 0 then 'status 404' when c_custkey % 13 = 0 then 'status 503' end as error from customer"""


@query(_FETCHED)
def keyed_fetch(t):
    """A request for each key: answers, refusals, and errors that remain after all tries."""
    return _fetched(t)


@query(f"select count(*) as total, count(*) filter (error is null) as succeeded, count(error) as failed, round(avg(case when error is null then 1.0 else 0.0 end), 6) as success_rate from ({_FETCHED})")
def fetch_summary(t):
    return paged.batch_metadata(_fetched(t)).withColumn("success_rate", F.round("success_rate", 6))


@query("""select doc_id as asn, 'Org ' || doc_id as organization_name, case when doc_id % 5 = 0 then 0 else quality end as "Access", toxic as "IXP" from labels""")
def labels_csv(t):
    """A wide file of labels with blanks around headers, blank cells and cells that are no number."""
    spark, k = _spark(t), F.col("doc_id")
    cell = F.when(k % 10 == 0, "").when(k % 5 == 0, "n/a").otherwise(F.concat(F.col("quality").cast("string"), F.lit(".0")))
    wide = t("labels").select(F.concat(F.lit("as"), k).alias(" ASN "), F.concat(F.lit("Org "), k).alias("organization_name"), cell.alias("Access "), F.col("toxic").cast("string").alias(" IXP"))
    path = scratch(spark, "labels")
    wide.write.option("header", True).csv(path)
    return readers.read_labels(spark, path)


_MARKED = "select doc_id as asn, 'Org ' || doc_id as organization_name, case when quality = 1 and toxic = 1 then 'Access|IXP' when quality = 1 then 'Access' when toxic = 1 then 'IXP' else '' end as tags, case when quality = 1 then 0.75 end as access, 'm' as model_used from labels"


def _flat(df):
    return df.select("asn", "organization_name", F.array_join("tags", "|").alias("tags"), F.try_element_at("confidence_scores", F.lit("Access")).alias("access"), "model_used")


def _marked(t):
    tags = F.array_compact(F.array(F.when(F.col("quality") == 1, F.lit("Access")), F.when(F.col("toxic") == 1, F.lit("IXP"))))
    return t("labels").select(F.col("doc_id").alias("asn"), F.concat(F.lit("Org "), "doc_id").alias("organization_name"), tags.alias("tags"), "quality")


@query(_MARKED)
def predictions_csv(t):
    spark = _spark(t)
    path = scratch(spark, "predictions")
    rows = _marked(t).select("asn", "organization_name", F.array_join("tags", ", ").alias("tags"), F.when(F.col("quality") == 1, "0.75").alias("confidence_Access"), F.lit("").alias("confidence_IXP"), F.lit("m").alias("model_used"))
    rows.write.option("header", True).csv(path)
    return _flat(readers.read_predictions_csv(spark, path))


@query("select n_name as name, n_nationkey / 4.0 as value from nation where n_nationkey % 3 <> 0")
def metrics_text_read(t):
    """Lines 'name: value'; rules of = and values that are no number are left out."""
    spark, k = _spark(t), F.col("n_nationkey")
    lines = t("nation").select(F.when(k % 3 != 0, F.concat("n_name", F.lit(": "), (k / 4.0).cast("string"))).when(k % 2 == 0, F.lit("====")).otherwise(F.concat("n_name", F.lit(": none"))).alias("value"))
    path = scratch(spark, "metrics")
    lines.write.text(path)
    return readers.read_metrics(spark, path)


@query("select c_custkey as asn, c_name as name, c_mktsegment as website, cast(null as varchar) as country from customer")
def entities_csv(t):
    spark = _spark(t)
    path = scratch(spark, "entities")
    t("customer").select(F.concat(F.lit("AS"), "c_custkey").alias("asn"), F.col("c_name").alias("organization_name"), F.col("c_mktsegment").alias("website")).write.option("header", True).csv(path)
    return readers.read_entities(spark, path)


# sinks


@query("select 'csv' as kind, o_orderkey, o_orderstatus from orders union all select 'parquet', o_orderkey, o_orderstatus from orders")
def written_both(t):
    spark, base = _spark(t), scratch(_spark(t), "both")
    sinks.write_both(t("orders").select("o_orderkey", "o_orderstatus"), base)
    read = {"parquet": spark.read.parquet(f"{base}.parquet"), "csv": spark.read.option("header", True).csv(f"{base}.csv")}
    each = [df.select(F.lit(k).alias("kind"), F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderstatus") for k, df in read.items()]
    return each[0].unionByName(each[1])


@query("select k as format, count(*) as n, cast(sum(c_custkey) as bigint) as keys, count(distinct c_name) as names from customer, (values ('csv'), ('json'), ('orc'), ('parquet')) f(k) group by k")
def export_formats(t):
    """A table in each format that can be written, read back."""
    spark, base = _spark(t), scratch(_spark(t), "export")
    done = sinks.write_as(t("customer").select("c_custkey", "c_name"), base, ["parquet", "csv", "json", "orc", "unknown"])
    each = [spark.read.format(f).options(header="true").load(f"{base}.{f}").select(F.lit(f).alias("format"), F.col("c_custkey").cast("long").alias("k"), "c_name") for f in done]
    rows = each[0]
    for e in each[1:]:
        rows = rows.unionByName(e)
    return rows.groupBy("format").agg(F.count("*").alias("n"), F.sum("k").alias("keys"), F.count_distinct("c_name").alias("names"))


@query("select 'nation' as name, count(*) as rows, 4 as columns from nation union all select 'orders', count(*), 2 from orders")
def tables_metadata(t):
    found = sinks.metadata({"nation": t("nation").select("n_nationkey", "n_name", "n_regionkey", F.lit(1).alias("one")), "orders": t("orders").select("o_orderkey", "o_custkey")})
    return _spark(t).createDataFrame([(k, v["rows"], len(v["columns"])) for k, v in found.items()], "name string, rows long, columns int")


def _wide(t):
    k = F.col("doc_id")
    return t("labels").select(F.concat(F.lit("AS"), k).alias("ASN"), F.col("quality").alias("Access_LargeISP"), F.col("toxic").alias("Financial_Bank"), (k % 4 == 0).cast("int").alias("IXP"))


@query("""select doc_id as asn, quality as "Access", toxic as "Finance", cast(doc_id % 4 = 0 as int) as "IXP", 0 as "Transit" from labels""")
def released_labels(t):
    """Labels under older names, released, and the top-level ones read back."""
    spark, out = _spark(t), scratch(_spark(t), "release")
    jobs.release_labels(_wide(t), out)
    return spark.read.parquet(f"{out}/labels/toplevel.parquet").select("asn", "Access", "Finance", "IXP", "Transit")


@query("""select doc_id as asn, 'AS' || doc_id as name, 'Access' as category, 'LargeISP' as subcategory from labels where quality = 1
    union all select doc_id, 'AS' || doc_id, 'Finance', 'Bank' from labels where toxic = 1 union all select doc_id, 'AS' || doc_id, 'IXP', null from labels where doc_id % 4 = 0""")
def released_hierarchy(t):
    spark, out = _spark(t), scratch(_spark(t), "release")
    jobs.release_labels(_wide(t), out)
    return spark.read.parquet(f"{out}/labels/hierarchical.parquet")


_RANKED = "select c_custkey, row_number() over (order by md5('42-' || c_custkey)) as r, count(*) over () as n from (select distinct c_custkey from customer where c_custkey % 3 = 0)"


@query(f"select case when r <= round(n * 0.8) then 'train' else 'validation' end as part, count(*) as n, cast(sum(c_custkey) as bigint) as keys from ({_RANKED}) group by 1")
def training_lines(t):
    """Chat examples as JSON lines of two files, and the keys that their messages name."""
    spark, out, k = _spark(t), scratch(_spark(t), "training"), F.col("c_custkey")
    who = t("customer").select(k, F.col("c_name").alias("name"), F.lit(None).cast("string").alias("country"), F.lit(None).cast("string").alias("website"))
    marks = t("customer").select(k, (k % 3 == 0).cast("int").alias("Cloud"))
    jobs.training_files(chat.examples(marks, who, "c_custkey", ["Cloud"], "Classify."), out, "c_custkey")
    lines = [spark.read.text(f"{out}/{p}.jsonl").select(F.lit(p).alias("part"), "value") for p in ("train", "validation")]
    asn = F.regexp_extract(F.get_json_object("value", "$.messages[1].content"), r"ASN: (\d+)", 1).cast("long")
    return lines[0].unionByName(lines[1]).groupBy("part").agg(F.count("*").alias("n"), F.sum(asn).alias("keys"))


_FLAGGED = "select doc_id, quality = 1 as tq, length(text) >= 400 as pq, toxic = 1 as tt, doc_id % 2 = 0 as pt from labels join documents using (doc_id)"
_RATES = f"""select label, count(*) filter (t and p) as tp, count(*) filter (not t and p) as fp, count(*) filter (t and not p) as fn, count(*) filter (not t and not p) as tn
    from (select 'quality' as label, tq as t, pq as p from ({_FLAGGED}) union all select 'toxic', tt, pt from ({_FLAGGED})) group by label"""


def _rated(t):
    rule = t("documents").select("doc_id", (F.length("text") >= 400).cast("int").alias("quality"), (F.col("doc_id") % 2 == 0).cast("int").alias("toxic"))
    return evaluate.paired(t("labels"), rule, "doc_id", ["quality", "toxic"])


@query(f"""with c as ({_RATES}), r as (select label, (tp + tn) / (tp + fp + fn + tn) as a, coalesce(tp / nullif(tp + fp, 0), 0) as p, coalesce(tp / nullif(tp + fn, 0), 0) as r, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f, coalesce(tp / nullif(tp + fp + fn, 0), 0) as j from c)
    select row_number() over (order by p, label) as nth, printf('%s  %.4f  %.4f  %.4f  %.4f  %.4f', label, a, p, r, f, j) as line from r""")
def metrics_lines(t):
    """The lines of a metrics file: labels, least precise first."""
    pairs = _rated(t)
    text = sinks.metrics_text(evaluate.summary(pairs, ["quality", "toxic"]), evaluate.rates(evaluate.confusion(pairs, ["quality", "toxic"])))
    return _spark(t).createDataFrame(list(enumerate(text.strip().split("\n")[-2:], 1)), "nth long, line string")


@query(f"with c as ({_RATES}) select row_number() over (order by 2 * tp / nullif(2 * tp + fp + fn, 0) desc, label) as nth, printf('%s: f1 %.4f', label, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) as line from c")
def best_categories(t):
    """The best labels of a performance report, best F1 first."""
    spark, pairs = _spark(t), _rated(t)
    stage2 = spark.createDataFrame([("x", 0.5, 1.0)], "category string, jaccard double, coverage double")
    system, errors = spark.createDataFrame([(0.5, 0.5, 2)], "exact double, partial double, rows long"), spark.createDataFrame([], "error string, n long")
    lines = sinks.performance_report(evaluate.rates(evaluate.confusion(pairs, ["quality", "toxic"])), stage2, system, errors).split("\n")
    at = lines.index("BEST CATEGORIES")
    return spark.createDataFrame(list(enumerate(lines[at + 1 : lines.index("", at)], 1)), "nth long, line string")


@query("select '- records ' || count(*) || ', valid ' || count(*) filter (s_suppkey % 4 <> 0) as line from supplier")
def quality_lines(t):
    """A line of the Markdown report of a source."""
    k = F.col("s_suppkey")
    rows = t("supplier").select(F.when(k % 4 != 0, k.cast("string")).otherwise("none").alias("k"), "s_name", F.lit("http://a.bc").alias("site"), F.lit("x").alias("kind"))
    text = quality.report_text([quality.peering_report(rows, "k", "s_name", "site", ["kind"])])
    return _spark(t).createDataFrame([(x,) for x in text.split("\n") if x.startswith("- records")], "line string")


@query("""select vec_id as asn, case when vec_id * 7 % 101 > 50 and vec_id * 13 % 101 > 50 then 'Access|IXP' when vec_id * 7 % 101 > 50 then 'Access' when vec_id * 13 % 101 > 50 then 'IXP' else '' end as tags,
    case when vec_id * 7 % 101 > 50 then vec_id * 7 % 101 / 100.0 end as access from embeddings""", doubles=("access",))
def saved_predictions(t):
    """Scores as tags and confidences, saved as JSON and read back."""
    spark, base, k = _spark(t), scratch(_spark(t), "saved"), F.col("vec_id")
    scores = t("embeddings").select(k.alias("asn"), (k * 7 % 101 / 100.0).alias("Access"), (k * 13 % 101 / 100.0).alias("IXP"))
    out = jobs.unified(scores, "asn", ["Access", "IXP"], 0.5)
    sinks.write_as(out, base, ["json"])
    back = spark.read.schema("asn long, tags array<string>, confidence_scores map<string,double>").json(f"{base}.json")
    return back.select("asn", F.array_join("tags", "|").alias("tags"), F.try_element_at("confidence_scores", F.lit("Access")).alias("access"))


@query("select event_id, value > 50 as high from events")
def progressive_stream(t):
    """Events scored as a stream and appended batch by batch."""
    spark = _spark(t)
    source, out, state = (scratch(spark, f"stream-{x}") for x in ("in", "out", "state"))
    t("events").select("event_id", "value").repartition(3).write.parquet(source)
    scoring.scored_stream(scoring.stream_of(spark, source, "event_id long, value double"), lambda d: d.select("event_id", (F.col("value") > 50).alias("high")), out, state).awaitTermination()
    return spark.read.parquet(out).select("event_id", "high")


# labels and joins


@query("select distinct o_orderpriority as category, o_orderstatus as subcategory from orders where o_custkey = (select min(o_custkey) from orders)")
def categories_of_key(t):
    o = t("orders")
    rows = o.select("o_custkey", F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("subcategory"))
    return labels.categories_of(rows, "o_custkey", o.agg(F.min("o_custkey")).first()[0])


@query("select o_orderkey, o_orderpriority as category from orders where o_orderpriority in ('1-URGENT', '5-LOW')")
def category_filter(t):
    return labels.of_categories(t("orders").select("o_orderkey", F.col("o_orderpriority").alias("category")), ["1-URGENT", "5-LOW"])


@query("""select doc_id as asn, quality as "Access", toxic as "Finance", cast(doc_id % 4 = 0 as int) as "IXP" from labels""")
def top_level_matrix(t):
    sub = labels.canonical(_wide(t), schemas.sub_columns())
    return labels.to_top_level(sub, ["asn"]).select("asn", "Access", "Finance", "IXP")


@query("""select doc_id as asn, toxic as "Finance_Bank", 0 as "Finance_Entities" from labels where toxic = 1""")
def specialised_labels(t):
    return labels.specialised(labels.canonical(_wide(t), schemas.sub_columns()), "asn", "Finance").select("asn", "Finance_Bank", "Finance_Entities")


@query(f"""with c as ({_RATES}), s as (select sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from c), m as (select avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) as f from c)
    select round(f, 6) as macro_f1, round(2 * tp / (2 * tp + fp + fn), 6) as micro_f1 from s, m""")
def scored_job(t):
    """Predictions against labels over the keys and columns that both have."""
    rule = t("documents").select("doc_id", (F.length("text") >= 400).cast("int").alias("quality"), (F.col("doc_id") % 2 == 0).cast("int").alias("toxic"))
    summary, _ = jobs.scored(t("labels"), rule, ["quality", "toxic", "absent"], "doc_id")
    return summary.select(F.round("macro_f1", 6).alias("macro_f1"), F.round("micro_f1", 6).alias("micro_f1"))


@query(f"""with c as ({_RATES}), s as (select sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from c), x as (select 2 * tp / (2 * tp + fp + fn) as f from s)
    select 'micro f1' as metric, round(f, 6) as measured, 0.5 as stored, round(f - 0.5, 6) as delta, abs(f - 0.5) < 0.05 as close from x""", doubles=("stored",))
def against_stored(t):
    summary = evaluate.summary(_rated(t), ["quality", "toxic"])
    stored = _spark(t).createDataFrame([("micro f1", 0.5), ("other", 1.0)], "name string, value double")
    out = jobs.against_stored(summary, stored, {"micro f1": "micro_f1", "macro f1": "macro_f1"})
    return out.withColumns({c: F.round(c, 6) for c in ("measured", "delta")})


@query("""with p as (select o_custkey, list_sort(list(distinct o_orderpriority)) as c from orders group by 1), q as (select o_custkey, list_sort(list(distinct o_orderpriority)) as c from orders where o_orderdate < timestamp '1997-01-01' group by 1)
    select p.o_custkey, array_to_string(p.c, '|') as predicted, array_to_string(q.c, '|') as truth from p join q on p.o_custkey = q.o_custkey""")
def met_stages(t):
    own = lambda d: d.groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderpriority")).alias("cats")).withColumn("subs", F.array().cast("array<struct<cat:string,sub:string>>"))
    met = evaluate.met_stages(own(t("orders")), own(t("orders").filter(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp"))), "o_custkey")
    return met.select("o_custkey", F.array_join("p_cats", "|").alias("predicted"), F.array_join("t_cats", "|").alias("truth"))


@query("""select vec_id as asn, 'Access' as category, 'SmallISP' as subcategory, 0.9 as confidence from embeddings where vec_id % 2 = 0
    union all select vec_id, 'Transit', 'Global', 0.1 from embeddings where vec_id % 2 = 1""", doubles=("confidence",))
def sub_models(t):
    """Second-stage models by category, each for its own entities; a category without one falls back to its first subcategory."""
    one = t("embeddings").select(F.col("vec_id").alias("asn"), F.array(F.struct(F.when(F.col("vec_id") % 2 == 0, "Access").otherwise("Transit").alias("category"), F.lit(0.9).alias("confidence"))).alias("stage1"))
    own = jobs.SubModels()
    own.add("Access", lambda d: d.select("asn", F.lit("Access").alias("category"), F.lit("SmallISP").alias("subcategory"), F.lit(0.9).alias("confidence")))
    return own.predict(one, "asn", schemas.categories(_spark(t)))


@query("""select s_suppkey as asn, case when s_suppkey % 3 = 0 then 'AS' || s_suppkey else s_name end as name, nullif(concat_ws(' | ', case when s_suppkey % 2 = 0 then 'IPinfo: i' || s_suppkey end, case when s_suppkey % 5 = 0 then 'Type: NSP' end), '') as description,
    'Not available' as website, case when s_suppkey % 4 = 0 then 'US' else 'Unknown' end as country from supplier""")
def described_entities(t):
    """Entities as a model is given them."""
    k = F.col("s_suppkey")
    rows = t("supplier").select(
        k.alias("asn"), F.when(k % 3 == 0, "").otherwise(F.col("s_name")).alias("organization_name"), F.when(k % 4 == 0, "US").alias("country"), F.lit(None).cast("string").alias("website"),
        F.when(k % 2 == 0, F.struct(F.concat(F.lit("i"), k).alias("name"))).alias("ipinfo"), F.when(k % 5 == 0, F.struct(F.lit("NSP").alias("info_type"))).alias("peeringdb"),
    )
    return integrate.described(rows)


@query("select round((count(c_name) + count(case when c_custkey % 3 = 0 then 1 end)) / (2.0 * count(*)), 6) as completeness from customer")
def completeness(t):
    rows = t("customer").select("c_name", F.when(F.col("c_custkey") % 3 == 0, 1).alias("some"))
    return quality.completeness(rows, ["c_name", "some"]).withColumn("completeness", F.round("completeness", 6))


@query("""select count(*) as rows, round(avg(0.6 * 0.8 + 0.4 * 0.1), 6) as mean_confidence, 0.8 as mean_stage1, 0.1 as mean_stage2 from embeddings""", doubles=("mean_confidence", "mean_stage1", "mean_stage2"))
def two_stage_summary(t):
    """Mean confidences of a batch that goes through both stages."""
    spark, k = _spark(t), F.col("vec_id")
    who = t("embeddings").select(k.alias("asn"), F.lit("x").alias("organization_name"))
    votes = {m: t("embeddings").select(k.alias("asn"), F.lit(0.8).alias("Access"), F.lit(0.1).alias("IXP")) for m in ("svm", "llm")}
    none = spark.createDataFrame([], "asn long, category string, subcategory string, confidence double")
    out = two_stage.batch_summary(two_stage.classify(who, votes, ["Access", "IXP"], none, schemas.categories(spark)))
    return out.select("rows", *[F.round(c, 6).alias(c) for c in ("mean_confidence", "mean_stage1", "mean_stage2")])


@query("""select vec_id, round(0.4 * (case when vec_id % 5 <> 0 then vec_id * 7 % 101 / 100.0 else 0 end) + 0.6 * (case when vec_id % 7 <> 0 then vec_id * 13 % 101 / 100.0 else 0 end), 6) as a from embeddings where vec_id % 5 <> 0 or vec_id % 7 <> 0""")
def vote_all_keys(t):
    """Keys that only one of the models knows are voted on too."""
    k = F.col("vec_id")
    svm = t("embeddings").filter(k % 5 != 0).select(k, (k * 7 % 101 / 100.0).alias("a"))
    llm = t("embeddings").filter(k % 7 != 0).select(k, (k * 13 % 101 / 100.0).alias("a"))
    return models.vote({"svm": svm, "llm": llm}, "vec_id", ["a"]).withColumn("a", F.round("a", 6))


# splits, features, models


@query("""with r as (select doc_id, row_number() over (order by md5('42-' || doc_id)) as r, count(*) over () as n from (select distinct doc_id from documents)),
    f as (select doc_id, case when r - 1 < (n % 3) * (n // 3 + 1) then (r - 1) // (n // 3 + 1) else n % 3 + (r - 1 - (n % 3) * (n // 3 + 1)) // (n // 3) end as fold from r) select doc_id, case when fold = 0 then 'test' else 'train' end as split from f""")
def first_fold_split(t):
    return split.first_fold_split(t("documents"), "doc_id")


@query("""with f as (select doc_id % 3 as fold, quality, toxic from labels), l as (select fold, 'quality' as label, quality as y from f union all select fold, 'toxic', toxic from f), k as (select unnest(range(3)) as fold)
    select cast(k.fold as int) as fold, case when l.fold = k.fold then 'test' else 'train' end as part, label, count(*) filter (y > 0) as n from l, k group by all""")
def fold_label_counts(t):
    rows = t("labels").withColumn("fold", (F.col("doc_id") % 3).cast("int"))
    return split.fold_label_counts(rows, ["quality", "toxic"], 3)


@query("""with f as (select avg(l_quantity) as m, stddev_pop(l_quantity) as s from (select * from lineitem order by l_orderkey, l_linenumber limit 1000)) select l_orderkey, l_linenumber, round((l_quantity - m) / s, 6) as quantity from lineitem, f""")
def scaler_first(t):
    """Scales of the first rows, for all rows."""
    rows = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("quantity"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("_order"))
    return features.Scaler.fit(rows, ["quantity"], 1000, "_order").transform(rows).select("l_orderkey", "l_linenumber", F.round("quantity", 6).alias("quantity"))


@query("select s_suppkey as asn, coalesce(case when s_suppkey % 4 <> 0 then s_acctbal end, 0) as balance, cast(s_nationkey as double) as nation from supplier", doubles=("balance",))
def feature_projection(t):
    rows = t("supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal")).alias("bal"), "s_nationkey").withColumnRenamed("s_suppkey", "asn")
    return features.numeric(rows, {"balance": "bal", "nation": "s_nationkey"}, "asn")


# requests and faults


@query("""select s_suppkey, case when s_suppkey % 5 = 0 then null else 'answer ' || s_suppkey end as response, case when s_suppkey % 5 = 0 then 'TimeoutError: slow ' || s_suppkey end as error from supplier""")
def concurrent_requests(t):
    """Requests sent side by side; those that always fail become rows with their error."""

    def model(prompts):
        k = int(prompts[0])
        if k % 5 == 0:
            raise TimeoutError(f"slow {k}")
        return [f"answer {k}"]

    return chat.responses(t("supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("prompt")), model, sleep=lambda s: None).drop("prompt")


@query("select s_suppkey, 'answer ' || s_suppkey as response from supplier")
def saved_requests(t):
    """Answers saved round by round; a second start asks for nothing that is there."""
    path = scratch(_spark(t), "answers")
    prompts = t("supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("prompt"))
    chat.responses_saved(prompts, lambda p: [f"answer {p[0]}"], path, "s_suppkey", rounds=2)
    return chat.responses_saved(prompts, lambda p: ["asked again"], path, "s_suppkey", rounds=2).select("s_suppkey", "response")


@query("""select s_suppkey, case when s_suppkey % 2 = 0 then 1 else 0 end as "Large_ISP", case when s_suppkey % 3 = 0 then 1 else 0 end as "Cloud" from supplier""")
def parse_spellings(t):
    """Tags with blanks and with underscores are the same; an answer that can't be read gives zeros."""
    k = F.col("s_suppkey")
    large = F.when(k % 4 == 0, '"Large ISP"').when(k % 2 == 0, '"Large_ISP"')
    tags = F.concat_ws(",", large, F.when(k % 3 == 0, '"Cloud"'))
    text = F.when((k % 2 == 0) | (k % 3 == 0), F.concat(F.lit('{"responses":[{"tags":['), tags, F.lit("]}]}"))).otherwise("broken")
    return chat.parsed(t("supplier").select(F.array(k).alias("keys"), text.alias("response")), "s_suppkey", "keys", "response", ["Large_ISP", "Cloud"])


# orders and limits


@query("select o_orderkey, o_totalprice from orders where o_totalprice < 5000 order by o_orderkey limit 10")
def first_violations(t):
    return quality.first_violations(t("orders").select("o_orderkey", "o_totalprice"), "o_orderkey", F.col("o_totalprice") < 5000)


@query("select event_id, event_type from events order by event_id desc limit 100")
def bounded_history(t):
    return split.last_n(t("events").select("event_id", "event_type"), [F.desc("event_id")], 100)


@query("select row_number() over (order by c_custkey) as nth, c_custkey from customer order by c_custkey limit 5")
def first_keys(t):
    """The head of a table in the order of its keys."""
    rows = split.last_n(t("customer").select("c_custkey"), [F.asc("c_custkey")], 5).collect()
    return _spark(t).createDataFrame([(n, r["c_custkey"]) for n, r in enumerate(rows, 1)], "nth long, c_custkey long")

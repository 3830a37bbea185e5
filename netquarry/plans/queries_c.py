"""Queries of models, requests to models, monitoring and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from netquarry import schemas
from netquarry.functions import exprs as X
from netquarry.operators import chat, models, monitor
from netquarry.plans import two_stage
from netquarry.plans.registry import Registry
from netquarry.sources import readers, sinks
from netquarry.streaming import scoring

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

_TOP = ["Access", "Transit", "ContentProvider"]


def _scores(t, shift: int):
    """Scores in 0..1 of three categories, made of the key."""
    k = F.col("vec_id") + shift
    return t("embeddings").select("vec_id", *[((k * (7 + 4 * j) % 101) / 100.0).alias(c) for j, c in enumerate(_TOP)])


_SCORES = "select vec_id, " + ", ".join(f"((vec_id + 3) * {7 + 4 * j} % 101) / 100.0 * 0.4 + ((vec_id + 11) * {7 + 4 * j} % 101) / 100.0 * 0.6 as \"{c}\"" for j, c in enumerate(_TOP)) + " from embeddings"


@query(f'select vec_id, round("Access", 6) as "Access", round("Transit", 6) as "Transit", round("ContentProvider", 6) as "ContentProvider" from ({_SCORES})')
def weighted_vote(t):
    out = models.vote({"svm": _scores(t, 3), "llm": _scores(t, 11)}, "vec_id", _TOP)
    return out.withColumns({c: F.round(c, 6) for c in _TOP})


_CHOSEN = f"""p as (select vec_id, round("Access", 6) as a, round("Transit", 6) as t, round("ContentProvider", 6) as c from ({_SCORES})),
    q as (select *, case when a > 0.5 or t > 0.5 or c > 0.5 then list_filter([case when a > 0.5 then 'Access' end, case when t > 0.5 then 'Transit' end, case when c > 0.5 then 'ContentProvider' end], lambda x: x is not null)
      when a >= t and a >= c then ['Access'] when t >= c then ['Transit'] else ['ContentProvider'] end as cats from p)"""


@query(f"with {_CHOSEN} select vec_id, array_to_string(cats, '|') as categories, len(cats) as n from q")
def argmax_fallback(t):
    s = weighted_vote(t)
    picked = s.select("vec_id", F.transform(models.chosen(F.array(*_TOP), _TOP), lambda x: x["category"]).alias("cats"))
    return picked.select("vec_id", F.array_join("cats", "|").alias("categories"), F.size("cats").cast("long").alias("n"))


@query("""select vec_id, (vec_id * 7 % 101) / 100.0 as "Access", case when (vec_id * 7 % 101) / 100.0 > 0.5 and vec_id % 2 = 0 then (vec_id * 13 % 101) / 100.0 else 0.0 end as "Access_LargeISP" from embeddings""")
def gate_children(t):
    k = F.col("vec_id")
    parents = t("embeddings").select("vec_id", ((k * 7 % 101) / 100.0).alias("Access"))
    kids = t("embeddings").filter("vec_id % 2 = 0").select("vec_id", ((k * 13 % 101) / 100.0).alias("Access_LargeISP"))
    return models.gated(parents, kids, "vec_id", schemas.parents())


@query("""select e.vec_id, greatest((vec_id * 7 % 101) / 100.0, case when vec_id % 2 = 0 then (vec_id * 13 % 101) / 100.0 else 0 end) as a, case when vec_id % 2 = 0 then 1.0 else 0.0 end as b from embeddings e""", doubles=('b',))
def combine_scores(t):
    k = F.col("vec_id")
    e = t("embeddings")
    return models.combined([e.select("vec_id", ((k * 7 % 101) / 100.0).alias("a")), e.filter("vec_id % 2 = 0").select("vec_id", ((k * 13 % 101) / 100.0).alias("a"), F.lit(1.0).alias("b"))], "vec_id", e)


@query("""select vec_id, round(case when vec_id % 5 = 0 then 0.0 when vec_id % 3 = 0 then (vec_id % 11) / 10.0 else least(1.0, greatest(0.0, 0.6 * (vec_id % 11) / 10.0 + 0.4 * ((vec_id % 7) / 10.0 + 0.5) / 2)) end, 6) as confidence from embeddings""")
def overall_confidence(t):
    k = F.col("vec_id")
    one = F.when(k % 5 == 0, F.array().cast("array<double>")).otherwise(F.array(k % 11 / 10.0))
    two = F.when(k % 3 == 0, F.array().cast("array<double>")).otherwise(F.array(k % 7 / 10.0, F.lit(0.5)))
    return t("embeddings").select("vec_id", F.round(models.overall_confidence(one, two), 6).alias("confidence"))


def _asked(t):
    k = F.col("vec_id")
    stage1 = t("embeddings").select("vec_id", F.array(F.struct(F.lit("Access").alias("category"), F.lit(0.9).alias("confidence")), F.struct(F.lit("IXP").alias("category"), F.lit(0.8).alias("confidence"))).alias("stage1"))
    answer = F.when(k % 3 == 0, "LargeISP").when(k % 3 == 1, "nonsense").otherwise("SmallISP")
    subs = t("embeddings").select("vec_id", F.lit("Access").alias("category"), answer.alias("subcategory"), F.when(k % 2 == 0, 0.7).alias("confidence"))
    return stage1, subs


@query("""select vec_id, 'Access' as category, case when vec_id % 3 = 2 then 'SmallISP' else 'LargeISP' end as subcategory, case when vec_id % 3 = 1 then 0.1 when vec_id % 2 = 0 then 0.7 else 0.8 end as confidence from embeddings""", doubles=('confidence',))
def subcategories(t):
    stage1, subs = _asked(t)
    return models.with_subcategories(stage1, subs, "vec_id", schemas.categories(stage1.sparkSession, extra=True))


@query(f"""with {_CHOSEN}, w as (select *, list_contains(cats, 'Access') as has, list_avg(list_transform(cats, lambda x: case x when 'Access' then a when 'Transit' then t else c end)) as m1 from q)
    select vec_id as asn, 'AS' || vec_id as organization_name, array_to_string(cats, '|') as stage1_categories, array_to_string(list_concat(case when has then ['Access:' || case when vec_id % 3 = 2 then 'SmallISP' else 'LargeISP' end] else [] end, case when list_contains(cats, 'ContentProvider') then ['ContentProvider:Cloud'] else [] end, case when list_contains(cats, 'Transit') then ['Transit:Global'] else [] end), '|') as stage2_subcategories,
      round(0.6 * m1 + 0.4 * ((case when has then case when vec_id % 3 = 1 then 0.1 when vec_id % 2 = 0 then 0.7 else 0.8 end else 0 end + case when list_contains(cats, 'ContentProvider') then 0.1 else 0 end + case when list_contains(cats, 'Transit') then 0.1 else 0 end) / len(cats)), 4) as overall_confidence from w""")
def two_stage_batch(t):
    votes = {m: _scores(t, s).withColumnRenamed("vec_id", "asn") for m, s in (("svm", 3), ("llm", 11))}
    subs = _asked(t)[1].withColumnRenamed("vec_id", "asn")
    who = t("embeddings").select(F.col("vec_id").alias("asn"), F.lit(None).cast("string").alias("organization_name"))
    out = two_stage.classify(who, votes, _TOP, subs, schemas.categories(who.sparkSession, extra=True))
    return sinks.flat_predictions(out).select("asn", "organization_name", "stage1_categories", "stage2_subcategories", F.round("overall_confidence", 4).alias("overall_confidence"))


def _odd(t):
    """All places of the vectors, and whether the label is odd."""
    return t("embeddings").select("vec_id", (F.col("label") % 2).alias("odd"), *[F.get("embedding", F.lit(k)).cast("double").alias(f"x{k}") for k in range(64)]), [f"x{k}" for k in range(64)]


@query()
def rff_svm(t):
    """Scores of one label by a kernel machine of random features over all places of the vectors."""
    rows, cols = _odd(t)
    return models.LabelModels("vec_id", cols, ["odd"], size=64).fit(rows).predict(rows)


@query()
def stacking(t):
    """Two kernel machines stacked: out-of-fold scores of each, and the meta model's."""
    rows, cols = _odd(t)
    bases = {"a": lambda d: models.LabelModels("vec_id", cols[:32], ["odd"], size=32).fit(d), "b": lambda d: models.LabelModels("vec_id", cols[32:], ["odd"], size=32).fit(d)}
    _, predict = models.stacked(rows, "vec_id", ["odd"], bases, folds=3)
    return predict(rows)


# requests


_USERS = "select c_custkey, 'ASN: ' || c_custkey || chr(10) || 'Name: ' || c_name || case when c_custkey % 3 = 0 then '' else chr(10) || 'Country: ' || c_mktsegment end as message from customer"


def _users(t):
    k = F.col("c_custkey")
    return t("customer").select(k, F.col("c_name").alias("name"), F.when(k % 3 != 0, F.col("c_mktsegment")).alias("country"), F.lit(None).cast("string").alias("website"))


@query(_USERS)
def user_messages(t):
    return _users(t).select("c_custkey", chat.user_message("c_custkey", "name", "country", "website").alias("message"))


@query(f"""with u as ({_USERS}), x as (select c_custkey, message, case when c_custkey % 2 = 0 then '"Large ISP"' || case when c_custkey % 5 = 0 then ',"Cloud"' else '' end else '"Cloud"' end as tags from u where c_custkey % 2 = 0 or c_custkey % 5 = 0)
    select c_custkey, '{{"messages":[{{"role":"system","content":"Classify."}},{{"role":"user","content":"' || replace(message, chr(10), '\\n') || '"}},{{"role":"assistant","content":"{{\\"tags\\":[' || replace(tags, '"', '\\"') || ']}}"}}]}}' as value from x""")
def chat_examples(t):
    k = F.col("c_custkey")
    marks = t("customer").select(k, (k % 2 == 0).cast("int").alias("Large_ISP"), (k % 5 == 0).cast("int").alias("Cloud"))
    return chat.examples(marks, _users(t), "c_custkey", ["Large_ISP", "Cloud"], "Classify.")


@query("""select conv_id, count(*) = 3 as three, string_agg(role, ',' order by turn) = 'system,user,assistant' as in_order from conversations group by conv_id""")
def chat_validate(t):
    c = t("conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))
    p = chat.example_problems(c, "messages")
    return c.select("conv_id", (~F.array_contains(p, "not three messages")).alias("three"), (~F.array_contains(p, "roles out of order")).alias("in_order"))


@query("""with r as (select *, row_number() over (order by s_suppkey) - 1 as n from supplier) select n // 5 as batch, count(*) as n, 'Classify these organizations:' || chr(10) || string_agg('- ASN ' || s_suppkey || ': ' || s_name || ' (' || s_nationkey || ')', chr(10) order by n) as prompt from r group by n // 5""")
def batch_prompt(t):
    s = t("supplier").select("s_suppkey", "s_name", F.lit(None).cast("string").alias("website"), F.col("s_nationkey").cast("string").alias("country"))
    return chat.batch_prompts(s, "s_suppkey", "s_name", "website", "country", 5).select("batch", F.col("n").cast("long").alias("n"), "prompt")


@query("select 'Choose:' || chr(10) || string_agg('- ' || r_name || ' / ' || n_name || ': nation ' || n_nationkey, chr(10) order by n_nationkey) as prompt from nation join region on n_regionkey = r_regionkey")
def taxonomy_prompt(t):
    rows = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("ord"), F.col("r_name").alias("category"), F.col("n_name").alias("subcategory"), F.concat(F.lit("nation "), "n_nationkey").alias("description"))
    return chat.taxonomy_prompt(rows, "Choose:\n{categories}")


@query("select cast(row_number() over (order by tag) as int) as ord, tag from (select distinct replace(replace(r_name || '_' || n_name, ' ', '_'), '/', '_') as tag from nation join region on n_regionkey = r_regionkey)")
def tag_names(t):
    rows = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("ord"), F.col("r_name").alias("category"), F.col("n_name").alias("subcategory"))
    return chat.tag_names(rows, flat=True)


@query("""select s_suppkey, case when s_name like '%1%' then 1 else 0 end as "Has_One", case when s_nationkey > 9 then 1 else 0 end as "Far", 0 as "None" from supplier""")
def parse_responses(t):
    """Prompts in batches, answered by a deterministic model, answers parsed back to keys."""
    s = t("supplier").select("s_suppkey", F.when(F.col("s_name").contains("1"), "one").otherwise("zero").alias("s_name"), F.lit(None).cast("string").alias("website"), F.when(F.col("s_nationkey") > 9, "far").otherwise("near").alias("country"))
    asked = chat.responses(chat.batch_prompts(s, "s_suppkey", "s_name", "website", "country", 5), chat.keyword_model({"Has One": ("one",), "Far": ("far",)}))
    return chat.parsed(asked, "s_suppkey", "keys", "response", ["Has_One", "Far", "None"])


@query("select event_id, event_type as tag, round(exp(-value / 100.0), 6) as probability from events")
def tag_probs(t):
    tokens = F.array(F.struct(F.upper("event_type").alias("token"), (-F.col("value") / 100.0).alias("logprob")), F.struct(F.lit("#").alias("token"), F.lit(0.0).alias("logprob")))
    e = t("events").select("event_id", tokens.alias("tokens"), F.array("event_type", F.lit("absent")).alias("tags"))
    return chat.token_probabilities(e, "event_id", "tokens", "tags").withColumn("probability", F.round("probability", 6))


@query("select event_id, 'ab' as tag, cast(2 as int) as at, round(exp(-value / 100.0), 6) as probability from events")
def tag_start_probs(t):
    lp = -F.col("value") / 100.0
    token = lambda x, p: F.struct(F.lit(x).alias("token"), p.alias("logprob"))
    e = t("events").select("event_id", F.array(token("x", F.lit(0.0)), token("ya", lp), token("bz", F.lit(0.0))).alias("tokens"))
    return chat.start_probabilities(e, "event_id", "tokens", ["ab", "zz"]).withColumn("probability", F.round("probability", 6))


@query("select n_nationkey, n_nationkey * 1000 / 1000 * 0.01 as large, n_nationkey * 1000 / 1000 * 0.008 as small from nation")
def training_cost(t):
    n = F.col("n_nationkey")
    return t("nation").select("n_nationkey", chat.training_cost(n, "large").alias("large"), chat.training_cost(n, "small").alias("small"))


# monitoring: events as calls


_ERRORS = """select event_id, case event_id % 9 when 0 then 'API rate limit' when 1 then 'missing column' when 2 then 'classifier failed' when 3 then 'validation of input' when 4 then 'bad config' when 5 then 'disk full' when 6 then 'fatal crash' else 'odd' end as message,
    case when event_id % 9 = 7 then 'KeyError' when event_id % 9 = 8 then 'RuntimeError' else 'Exception' end as kind, event_type as component from events"""
_CLASSED = f"""select *, case when regexp_matches(lower(message), 'api|openai|rate limit|quota|connection') then 'api_error' when regexp_matches(lower(message), 'dataframe|column|index|missing|empty') then 'data_error' when regexp_matches(lower(message), 'model|prediction|inference|classifier') then 'model_error'
    when regexp_matches(lower(message), 'validation') then 'validation_error' when regexp_matches(lower(message), 'config') or kind = 'KeyError' then 'configuration_error' else 'system_error' end as category from ({_ERRORS})"""
_SEVERE = f"""select *, case when regexp_matches(lower(message), 'critical|fatal|corrupt') then 'critical' when category = 'system_error' or regexp_matches(lower(message), 'timeout|memory|disk') then 'high' when category in ('model_error', 'api_error') then 'medium' else 'low' end as severity from ({_CLASSED})"""


def _errors(t):
    n = F.col("event_id") % 9
    texts = ("API rate limit", "missing column", "classifier failed", "validation of input", "bad config", "disk full", "fatal crash")
    message = F.coalesce(F.get(F.array(*map(F.lit, texts)), n.cast("int")), F.lit("odd"))
    kind = F.when(n == 7, "KeyError").when(n == 8, "RuntimeError").otherwise("Exception")
    e = t("events").select("event_id", message.alias("message"), kind.alias("kind"), F.col("event_type").alias("component"))
    e = e.withColumn("category", monitor.category(F.col("message"), F.col("kind")))
    return e.withColumn("severity", monitor.severity(F.col("message"), F.col("category")))


@query(f"select event_id, category, severity from ({_SEVERE})")
def error_classify(t):
    return _errors(t).select("event_id", "category", "severity")


@query(f"with s as ({_SEVERE}) select 'category' as by, category as value, count(*) as n from s group by category union all select 'severity', severity, count(*) from s group by severity union all select 'component', component, count(*) from s group by component")
def error_summary(t):
    return monitor.error_summary(_errors(t))


def _calls(t):
    return t("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("component"), (F.col("event_id") % 20 != 0).alias("success"), (F.col("value") / 10).alias("seconds"), (F.col("value") * 2).alias("mb"))


_CALLS = "select event_type as component, event_id, event_id % 20 <> 0 as success, value / 10 as seconds, value * 2 as mb from events"
_SUMMED = "component, count(*) as calls, round(avg(success::int), 6) as success_rate, round(avg(seconds), 6) as mean_s, round(min(seconds), 6) as least_s, round(max(seconds), 6) as most_s, round(sum(seconds), 4) as total_s, round(avg(mb), 6) as mean_mb"


def _summary(df):
    return df.withColumns({**{c: F.round(c, 6) for c in ("success_rate", "mean_s", "least_s", "most_s", "mean_mb")}, "total_s": F.round("total_s", 4)})


@query(f"select {_SUMMED} from ({_CALLS}) group by component")
def component_summary(t):
    return _summary(monitor.component_summary(_calls(t)))


@query(f"select {_SUMMED} from (select *, row_number() over (partition by component order by event_id desc) as rn from ({_CALLS})) where rn <= 100 group by component")
def component_recent(t):
    return _summary(monitor.component_summary(_calls(t), recent=100))


@query(f"""with s as (select component, avg(seconds) as m, avg(success::int) as r, avg(mb) as b from ({_CALLS}) group by component)
    select component, array_to_string(list_filter([case when m > 5 then 'slow' end, case when r < 0.95 then 'failing' end, case when b > 500 then 'huge' when b > 100 then 'large' end], lambda x: x is not null), ',') as problems from s order by m desc, component limit 5""")
def bottlenecks(t):
    return monitor.bottlenecks(monitor.component_summary(_calls(t))).select("component", "problems")


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by all")
def windowed_counts(t):
    return scoring.windowed_counts(t("events"), "ts", "event_type")


@query("""select s_suppkey as asn, trim(s_name) as name, case when s_suppkey % 4 = 0 then null else s_nationkey end as customer_cone_asns from supplier where s_suppkey % 9 <> 0""")
def population_rows(t):
    """A source's CSV cells, typed and keyed."""
    k = F.col("s_suppkey")
    raw = t("supplier").select(F.when(k % 9 == 0, "none").otherwise(F.concat(F.lit("AS"), k)).alias("ASN"), F.trim("s_name").alias("name"), F.when(k % 4 == 0, "").otherwise(F.col("s_nationkey").cast("string")).alias("cone"))
    return raw.select(X.digits_key(F.col("ASN")).alias("asn"), "name", X.number(F.col("cone"), "int").alias("customer_cone_asns")).filter("asn is not null")


@query("""select s_suppkey as asn, s_name as name from supplier where s_suppkey % 5 <> 0""")
def info_clean(t):
    """Records of keyed info: errors go, keys come from metadata or from org."""
    k = F.col("s_suppkey")
    meta = F.when(k % 2 == 0, F.struct(k.alias("asn"), F.lit("").alias("downloaded_at"), F.lit("").alias("api_source")))
    rows = t("supplier").select(k.cast("string").alias("_key"), F.concat(F.lit("AS"), k, F.lit(" Org")).alias("org"), F.col("s_name").alias("name"), F.when(k % 5 == 0, "timeout").alias("error"), meta.alias("_ipinfo_metadata"))
    return readers.clean_info(rows).select("asn", "name")

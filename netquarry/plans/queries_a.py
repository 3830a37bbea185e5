"""Queries of sources, keys, joins, labels and splits, on tables that stand for entities: customers, suppliers, users, documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from netquarry import schemas
from netquarry.functions import exprs as X
from netquarry.operators import integrate, labels, split
from netquarry.plans.registry import Registry
from netquarry.sources import readers

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


def _texts(t):
    """Keys as they come: padded, in either case, some empty."""
    k = F.col("c_custkey")
    raw = F.when(k % 5 == 0, F.concat(F.lit("  as"), k, F.lit(" "))).when(k % 7 == 0, F.lit("n/a")).when(k % 3 == 0, k.cast("string")).otherwise(F.concat(F.lit("AS"), k))
    return t("customer").select("c_custkey", raw.alias("raw"), "c_name", "c_acctbal", "c_mktsegment", "c_nationkey")


_TEXTS = """select c_custkey, case when c_custkey % 5 = 0 then '  as' || c_custkey || ' ' when c_custkey % 7 = 0 then 'n/a' when c_custkey % 3 = 0 then cast(c_custkey as varchar) else 'AS' || c_custkey end as raw,
    c_name, c_acctbal, c_mktsegment, c_nationkey from customer"""


@query(f"select c_custkey, try_cast(regexp_replace(trim(raw), '^AS', '', 'i') as bigint) as asn, coalesce(try_cast(regexp_replace(trim(raw), '^AS', '', 'i') as bigint) between 1 and 4294967295, false) as valid from ({_TEXTS})")
def normalize_key(t):
    k = X.normalized_key(F.col("raw"))
    return _texts(t).select("c_custkey", k.alias("asn"), X.valid_key(k).alias("valid"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k, event_type as kind, cast(json_extract(props, '$.k') as bigint) / 2.0 as half from events")
def flatten_nested(t):
    p = F.from_json("props", "k bigint")
    return t("events").select("event_id", p["k"].alias("k"), F.col("event_type").alias("kind"), (p["k"] / F.lit(2.0)).alias("half"))


@query("""select l_orderkey, l_linenumber, try_cast(nullif(case when l_linenumber % 3 = 0 then '' when l_linenumber % 4 = 0 then 'x' else cast(cast(l_quantity as bigint) as varchar) end, '') as bigint) as quantity,
    nullif(case when l_linenumber % 2 = 0 then '' else l_returnflag end, '') as flag, lower(case when l_linenumber % 5 = 0 then 'True' else 'no' end) = 'true' as seen from lineitem""")
def typed_parse(t):
    n = F.col("l_linenumber")
    raw = t("lineitem").select(
        F.col("l_orderkey").cast("string").alias("l_orderkey"), n.cast("string").alias("l_linenumber"), F.when(n % 3 == 0, "").when(n % 4 == 0, "x").otherwise(F.col("l_quantity").cast("bigint").cast("string")).alias("quantity"),
        F.when(n % 2 == 0, "").otherwise(F.col("l_returnflag")).alias("flag"), F.when(n % 5 == 0, "True").otherwise("no").alias("seen"),
    )
    return readers.typed(raw, {"l_orderkey": "bigint", "l_linenumber": "int", "quantity": "bigint", "flag": "string", "seen": "boolean"})


@query("select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1")
def keyed_last_wins(t):
    return split.newest(t("events").select("user_id", "event_id", "event_type", "value", "ts"), "user_id", [F.col("ts"), F.col("event_id")]).drop("ts")


@query("""with d as (select distinct cast(o_orderdate as date) as o_orderdate, date_diff('day', date '1996-03-15', cast(o_orderdate as date)) as days_off from orders)
    select * from d where abs(days_off) <= 7 order by abs(days_off), days_off limit 1""")
def nearest_date(t):
    return split.nearest_date(t("orders"), "o_orderdate", "1996-03-15").select("o_orderdate", F.col("days_off").cast("long").alias("days_off"))


@query("select max(cast(o_orderdate as date)) as newest, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey from orders")
def latest_snapshot(t):
    return t("orders").agg(F.max(F.col("o_orderdate").cast("date")).alias("newest"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("select doc_id as asn, quality as \"Finance\", toxic as \"Finance_Bank\", 0 as \"IXP\" from labels")
def rename_drop_ensure(t):
    old = t("labels").select(F.col("doc_id").alias("ASN"), F.col("quality").alias("Financial"), F.col("toxic").alias("Financial_Bank"), F.lit(1).alias("Government_SOE"))
    return labels.canonical(old, ["Finance", "Finance_Bank", "IXP"])


@query("select d.doc_id, coalesce(quality, 0) as quality, coalesce(toxic, 0) as toxic, l.doc_id is not null as found from documents d left join labels l on d.doc_id = l.doc_id")
def point_lookup_default_zero(t):
    return integrate.lookup_default(t("documents").select("doc_id"), t("labels"), "doc_id", ["quality", "toxic"])


def _sources(t):
    """Sources of the same key, none with all of them."""
    c = t("customer").filter(F.col("c_custkey") % 3 != 0).select(F.col("c_custkey").alias("asn"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    o = t("orders").filter(F.col("o_custkey") % 4 != 0).groupBy(F.col("o_custkey").alias("asn")).agg(F.count("*").alias("orders"), F.max("o_orderpriority").alias("name"))
    e = t("events").groupBy(F.col("user_id").alias("asn")).agg(F.count("*").alias("events"))
    s = t("supplier").select(F.col("s_suppkey").alias("asn"), F.col("s_name").alias("name"))
    return {"a": c, "b": o, "c": e, "d": s}


_SOURCES = """a as (select c_custkey as asn, c_name as name, c_acctbal as balance from customer where c_custkey % 3 <> 0),
    b as (select o_custkey as asn, count(*) as orders, max(o_orderpriority) as name from orders where o_custkey % 4 <> 0 group by 1),
    c as (select user_id as asn, count(*) as events from events group by 1), d as (select s_suppkey as asn, s_name as name from supplier)"""


@query(f"""with {_SOURCES}, p as (select doc_id as asn from documents)
    select p.asn, a.name as a_name, b.orders, c.events, d.name as d_name from p left join a on p.asn = a.asn left join b on p.asn = b.asn left join c on p.asn = c.asn left join d on p.asn = d.asn
    where a.asn is not null or b.asn is not null or c.asn is not null or d.asn is not null""")
def entity_any_source(t):
    met = integrate.lookup(t("documents").select(F.col("doc_id").alias("asn")), _sources(t), "asn", any_of=True)
    return met.select("asn", F.col("a.name").alias("a_name"), F.col("b.orders").alias("orders"), F.col("c.events").alias("events"), F.col("d.name").alias("d_name"))


@query(f"""with {_SOURCES}, k as (select asn from a union select asn from b union select asn from c union select asn from d)
    select k.asn, a.name as a_name, a.balance as a_balance, b.orders as b_orders, b.name as b_name, c.events as c_events, d.name as d_name
    from k left join a on k.asn = a.asn left join b on k.asn = b.asn left join c on k.asn = c.asn left join d on k.asn = d.asn""")
def complete_dataset(t):
    return integrate.complete(_sources(t), "asn")


@query(f"with {_SOURCES} select coalesce(a.asn, b.asn, d.asn) as asn, a.name, a.balance, b.orders from a full join b on a.asn = b.asn full join d on coalesce(a.asn, b.asn) = d.asn")
def join_left_column_wins(t):
    s = _sources(t)
    return integrate.joined_left_first([s["a"], s["b"], s["d"]], "asn")


_NAMES = f"""with {_SOURCES}, i as (select c_custkey as asn, case when c_custkey % 2 = 0 then '' else 'AS' || c_custkey || ' Org ' || c_mktsegment end as org, c_mktsegment as domain from customer where c_custkey % 5 <> 0)"""


@query(_NAMES + """ select k.asn, coalesce(nullif(case when k.asn % 6 = 1 then '' else a.name end, ''), nullif(b.name, ''), nullif(regexp_replace(i.org, '^AS\\S* ', ''), ''), case when i.asn is null then d.name end) as organization_name,
    case when a.balance > 0 then 'http://' || k.asn else 'https://' || i.domain end as website
    from (select doc_id as asn from documents) k left join a on k.asn = a.asn left join b on k.asn = b.asn left join i on k.asn = i.asn left join d on k.asn = d.asn
    where a.asn is not null or b.asn is not null or i.asn is not null or d.asn is not null""")
def coalesce_name(t):
    s = _sources(t)
    asn = F.col("asn")
    a = s["a"].select("asn", F.when(asn % 6 == 1, "").otherwise(F.col("name")).alias("organization_name"), F.lit(None).cast("string").alias("country_iso"), "balance")
    b = s["b"].select("asn", F.col("name").alias("organization"), F.lit("").alias("website"))
    seg = F.col("c_mktsegment")
    i = t("customer").filter(F.col("c_custkey") % 5 != 0).select(F.col("c_custkey").alias("asn"), F.lit(None).cast("string").alias("name"), F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.concat(F.lit("AS"), "c_custkey", F.lit(" Org "), seg)).alias("org"), seg.alias("domain"), F.lit(None).cast("string").alias("country"))
    d = s["d"].withColumn("country", F.lit(None).cast("string"))
    out = integrate.entities(t("documents").select(F.col("doc_id").alias("asn")), {"asrank": a, "peeringdb": b, "ipinfo": i, "aspop": d})
    return out.select("asn", "organization_name", X.first_filled(F.when(F.col("asrank.balance") > 0, F.concat(F.lit("http://"), asn)), F.col("website")).alias("website"))


@query("select d.doc_id, d.lang from documents d where doc_id in (select doc_id from labels where quality = 1)")
def split_semi(t):
    marks = t("labels").select("doc_id", F.when(F.col("quality") == 1, "train").otherwise("val").alias("split"))
    return split.members(t("documents").select("doc_id", "lang"), marks, "doc_id", "train")


@query("""with tr as (select doc_id from labels where quality = 1), va as (select doc_id from labels where quality = 0)
    select doc_id, 'train' as split from tr union all select doc_id, 'val' from va union all select doc_id, 'test' from documents where doc_id not in (select doc_id from tr) and doc_id not in (select doc_id from va)""")
def split_anti(t):
    l = t("labels")  # noqa: E741
    return split.remainder(t("documents"), l.filter("quality = 1"), l.filter("quality = 0"), "doc_id")


@query("select c_custkey, n_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def registry_lookup(t):
    dim = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.upper("n_name").alias("code"), F.col("n_name").alias("rir"), F.col("r_name").alias("continent"))
    names = t("customer").join(t("nation").select("n_nationkey", F.lower("n_name").alias("country")), F.col("c_nationkey") == F.col("n_nationkey"))
    return integrate.with_registry(names, "country", dim).select("c_custkey", F.col("rir").alias("n_name"), F.col("continent").alias("r_name"))


@query("select r_name, string_agg(n_name, ',' order by n_name) as codes from nation join region on n_regionkey = r_regionkey group by r_name")
def countries_by_rir(t):
    dim = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("code"), "r_name")
    return integrate.by_registry(dim, "r_name").select("r_name", F.array_join("codes", ",").alias("codes"))


@query("""select doc_id, 'AS' || doc_id as name, 'Access' as category, 'LargeISP' as subcategory from labels where quality = 1
    union all select doc_id, 'AS' || doc_id, 'Personal', null from labels where toxic = 1""")
def wide_to_long(t):
    return labels.to_long(t("labels"), "doc_id", {"quality": ("Access", "LargeISP"), "toxic": ("Personal", None)})


@query("""select o_custkey, max(case when o_orderpriority = '1-URGENT' then 1 else 0 end) as "1-URGENT", max(case when o_orderpriority = '2-HIGH' then 1 else 0 end) as "2-HIGH",
    max(case when o_orderpriority = '5-LOW' then 1 else 0 end) as "5-LOW", 0 as none from orders group by o_custkey""")
def long_to_wide(t):
    return labels.to_wide(t("orders"), "o_custkey", "o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW", "none"])


_FLAGS = "select doc_id, case when lang = 'en' then 1 else 0 end as \"Text_en\", case when n_chars > 500 then 1 else 0 end as \"Text_long\", case when source = 'src1' then 1 else 0 end as \"Site\" from documents"


def _flags(t):
    return t("documents").select("doc_id", (F.col("lang") == "en").cast("int").alias("Text_en"), (F.col("n_chars") > 500).cast("int").alias("Text_long"), (F.col("source") == "src1").cast("int").alias("Site"))


@query(f"select doc_id, greatest(\"Text_en\", \"Text_long\") as \"Text\", \"Site\" from ({_FLAGS})")
def collapse_prefix(t):
    return labels.collapsed_by_prefix(_flags(t), ["Text_en", "Text_long", "Site"], ["doc_id"])


@query("""select o_custkey, max(case when o_orderstatus = 'F' then 1 else 0 end) as done, max(case when o_totalprice > 200000 then 1 else 0 end) as large from orders group by o_custkey""")
def or_merge_dups(t):
    marks = t("orders").select("o_custkey", F.when(F.col("o_orderstatus") == "F", 3).otherwise(0).alias("done"), F.when(F.col("o_totalprice") > 200000, 1).alias("large"))
    return labels.merged(marks, "o_custkey", ["done", "large"])


@query(f"select doc_id, \"Text_en\" as en, \"Text_long\" as long from ({_FLAGS})")
def reduce_tags(t):
    return labels.reduced(_flags(t), "doc_id", ["Text_en", "Text_long", "Site"], "Text", {"Text_en": "en", "Text_long": "long"})


_PARENTS = {"LargeISP": "Access", "SmallISP": "Access", "Global": "Transit", "Cloud": "ContentProvider"}


def _leaves(t):
    own = [F.when(F.col("p_size") % k == 0, F.lit(x)) for k, x in ((2, "LargeISP"), (3, "SmallISP"), (5, "Global"), (7, "Cloud"), (11, "unknown"))]
    return t("part").select("p_partkey", F.array_compact(F.array(*own)).alias("leaves"))


_LEAVES = """select p_partkey, list_filter([case when p_size % 2 = 0 then 'LargeISP' end, case when p_size % 3 = 0 then 'SmallISP' end, case when p_size % 5 = 0 then 'Global' end, case when p_size % 7 = 0 then 'Cloud' end], lambda x: x is not null) as leaves from part"""


@query(f"""select p_partkey, array_to_string(list_sort(list_distinct(list_transform(leaves, lambda x: case x when 'Global' then 'Transit' when 'Cloud' then 'ContentProvider' else 'Access' end))), '|') as tops from ({_LEAVES})""")
def hier_to_flat(t):
    return _leaves(t).select("p_partkey", X.ordered_text(labels.parents_of(F.col("leaves"), _PARENTS)).alias("tops"))


@query(f"""select p_partkey, array_to_string(list_sort(flatten(list_distinct(list_transform(leaves, lambda x: case x when 'Global' then ['Global'] when 'Cloud' then ['Cloud'] else ['LargeISP', 'SmallISP'] end)))), '|') as children from ({_LEAVES})""")
def flat_to_hier(t):
    tops = labels.parents_of(F.col("leaves"), _PARENTS)
    return _leaves(t).select("p_partkey", X.ordered_text(labels.children_of(tops, _PARENTS)).alias("children"))


@query(f"""select p_partkey, array_to_string(list_sort(list_distinct(list_concat(leaves, list_transform(leaves, lambda x: case x when 'Global' then 'Transit' when 'Cloud' then 'ContentProvider' else 'Access' end)))), '|') as all_tags,
    case when len(leaves) = 0 then 'hierarchical without leaf tags' end as violation from ({_LEAVES})""")
def sync_tags(t):
    known = F.filter("leaves", lambda x: x != "unknown")
    df = _leaves(t).withColumn("leaves", known).withColumn("tops", F.array().cast("array<string>")).withColumn("approach", F.lit("hierarchical"))
    return labels.synced(df, "leaves", "tops", "approach", _PARENTS).select("p_partkey", X.ordered_text(F.col("all_tags")).alias("all_tags"), "violation")


@query("""select o_custkey, string_agg(case when o_orderpriority = '5-LOW' then o_orderpriority else o_orderpriority || ':' || o_orderstatus end, '|' order by o_orderpriority, o_orderstatus) as tags
    from (select distinct o_custkey, o_orderpriority, case when o_orderpriority = '5-LOW' then '' else o_orderstatus end as o_orderstatus from orders) group by o_custkey""")
def hier_tags(t):
    pair = F.struct(F.col("o_orderpriority").alias("parent"), F.col("o_orderstatus").alias("sub"))
    own = t("orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderpriority")).alias("cats"), F.sort_array(F.collect_set(F.when(F.col("o_orderpriority") != "5-LOW", pair))).alias("subs"))
    return own.select("o_custkey", F.array_join(labels.stage_tags(F.col("cats"), F.col("subs")), "|").alias("tags"))


@query("""select o_orderpriority as category, null as subcategory, count(*) as n from orders group by 1 union all
    select o_orderpriority, o_orderstatus, count(*) from orders group by 1, 2""")
def category_counts(t):
    return labels.category_counts(t("orders").select(F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("subcategory")))


@query("""with f as (select o_custkey, o_orderpriority, min(o_orderkey) as seen from orders group by all)
    select o_custkey, string_agg(o_orderpriority, '|' order by seen, o_orderpriority) as categories from f group by o_custkey""")
def flat_categories(t):
    rows = t("orders").select("o_custkey", F.col("o_orderpriority").alias("category"), "o_orderkey")
    return labels.flat_categories(rows, "o_custkey", "o_orderkey").select("o_custkey", F.array_join("categories", "|").alias("categories"))


@query("""with c as (select o_custkey, count(*) as n from orders group by 1) select cast(sum(n) as bigint) as records, count(*) as keys, round(avg(n), 6) as mean, round(stddev_samp(n), 6) as std, min(n) as least,
    quantile_cont(n, 0.25) as q25, quantile_cont(n, 0.5) as q50, quantile_cont(n, 0.75) as q75, max(n) as greatest from c""")
def prediction_stats(t):
    out = labels.statistics(t("orders"), "o_custkey")
    return out.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query("select l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) filter (l_linenumber % 2 = 0) as part from lineitem group by l_orderkey")
def first_values(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey")).alias("part"))
    return labels.first_values(rows, "l_orderkey", F.struct("l_linenumber", "l_partkey"), ["part"])


@query("select o_custkey, count(*) as n from orders group by 1 having count(*) > 1")
def repeated_keys(t):
    return labels.repeated_keys(t("orders"), "o_custkey")


@query("""select doc_id, case when quality = 1 and toxic = 1 then 'quality|toxic' when quality = 1 then 'quality' when toxic = 1 then 'toxic' else '' end as tags from labels""")
def expected_tags(t):
    return t("labels").select("doc_id", F.array_join(labels.tags(["quality", "toxic"]), "|").alias("tags"))


@query(f"""select p_partkey, case when list_contains(leaves, 'Global') then 0.75 else 0.0 end as "Global", case when list_contains(leaves, 'Cloud') then 1.0 else 0.0 end as "Cloud" from ({_LEAVES})""", doubles=('"Global"', '"Cloud"',))
def tag_matrix(t):
    scores = F.when(F.array_contains("leaves", "Global"), F.create_map(F.lit("Global"), F.lit(0.75))).otherwise(F.create_map().cast("map<string,double>"))
    return labels.tag_matrix(_leaves(t).withColumn("scores", scores), "p_partkey", "leaves", ["Global", "Cloud"], "scores")


_RANK = "select doc_id, row_number() over (order by md5('42-' || doc_id)) as r, count(*) over () as n from (select distinct doc_id from documents)"


@query(f"select doc_id, case when r <= round(n * 0.7) then 'train' when r <= round(n * (0.7 + 0.15)) then 'val' else 'test' end as split from ({_RANK})")
def hash_split(t):
    return split.hash_split(t("documents"), "doc_id")


@query("""select doc_id, lang, case when r <= round(n * 0.7) then 'train' when r <= round(n * (0.7 + 0.15)) then 'val' else 'test' end as split
    from (select doc_id, lang, row_number() over (partition by lang order by md5('42-' || doc_id)) as r, count(*) over (partition by lang) as n from documents)""")
def stratified_split(t):
    return split.stratified_split(t("documents"), "doc_id", "lang")


@query(f"select doc_id, cast(case when r - 1 < (n % 7) * (n // 7 + 1) then (r - 1) // (n // 7 + 1) else n % 7 + (r - 1 - (n % 7) * (n // 7 + 1)) // (n // 7) end as int) as fold from ({_RANK})")
def group_kfold(t):
    return split.group_kfold(t("documents"), "doc_id", 7)


@query("""with c as (select o_custkey, o_orderpriority, count(*) as n from orders group by all),
    m as (select o_custkey, o_orderpriority from (select *, row_number() over (partition by o_custkey order by n desc, o_orderpriority) as rn from c) where rn = 1)
    select o_custkey, o_orderpriority, cast((row_number() over (partition by o_orderpriority order by md5('42-' || o_custkey)) - 1) % 5 as int) as fold from m""")
def stratified_kfold(t):
    return split.stratified_kfold(t("orders"), "o_custkey", "o_orderpriority", 5)


@query("select doc_id, (row_number() over (order by md5('23-' || doc_id)) - 1) // 64 as batch, cast((row_number() over (order by md5('23-' || doc_id)) - 1) % 64 as int) as in_batch from documents")
def batches(t):
    return split.batches(t("documents").select("doc_id"), "doc_id", 64)


@query("select doc_id from documents order by md5('42-' || doc_id), doc_id limit 100")
def sample_keys(t):
    return split.sampled(t("documents").select("doc_id"), "doc_id", 100)


@query("""with s as (select doc_id, case when doc_id % 3 = 0 then 'a' else 'b' end as split from documents union all select doc_id, 'c' from documents where doc_id % 10 = 0)
    select x.split as first, y.split as second, count(*) as n from s x join s y on x.doc_id = y.doc_id and x.split < y.split group by all""")
def split_overlap_check(t):
    d = t("documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "a").otherwise("b").alias("split"))
    return split.overlaps(d.unionByName(t("documents").filter("doc_id % 10 = 0").select("doc_id", F.lit("c").alias("split"))), "doc_id")


@query(f"""with s as (select doc_id, case when r <= round(n * 0.7) then 'train' when r <= round(n * (0.7 + 0.15)) then 'val' else 'test' end as split from ({_RANK})), m as (select d.doc_id, lang, split from documents d join s on d.doc_id = s.doc_id)
    select split, lang, count(*) as records, count(distinct doc_id) as keys, grouping(lang) = 1 as whole from m group by grouping sets ((split), (split, lang))""")
def split_stats(t):
    d = t("documents").select("doc_id", "lang")
    return split.split_statistics(d, split.hash_split(d, "doc_id"), "doc_id", "lang")


@query("""select 'all' as level, p_partkey as asn from part where p_size % 2 = 0 and p_brand not in (select p_brand from part where p_partkey = 1)""")
def key_except(t):
    p = t("part")
    return p.filter("p_size % 2 = 0").join(p.filter("p_partkey = 1").select("p_brand"), "p_brand", "left_anti").select(F.lit("all").alias("level"), F.col("p_partkey").alias("asn"))


@query("""select p_partkey, case when p_size % 11 = 0 then 'unknown category' when p_size % 2 = 0 and p_size % 3 = 0 then 'subcategory missing' when p_size % 5 = 0 and p_size % 2 <> 0 then 'subcategory not allowed' else 'subcategory of another category' end as problem
    from part where p_size % 11 = 0 or (p_size % 2 = 0 and p_size % 3 = 0) or (p_size % 2 <> 0 and p_size % 5 = 0) or (p_size % 2 = 0 and p_size % 7 = 0)""")
def label_violations(t):
    s = F.col("p_size")
    rows = t("part").select(
        "p_partkey", F.when(s % 11 == 0, "Nowhere").when(s % 2 == 0, "Access").otherwise("Mobile").alias("category"),
        F.when((s % 2 == 0) & (s % 3 == 0), None).when((s % 2 == 0) & (s % 7 == 0), "Cloud").when(s % 2 == 0, "SmallISP").when(s % 5 == 0, "Global").alias("subcategory"),
    )
    return labels.violations(rows, "p_partkey", schemas.categories(rows.sparkSession)).select("p_partkey", "problem")


@query("""select doc_id, quality + toxic = 0 and doc_id % 13 <> 0 as unlabelled, doc_id % 13 = 0 as not_binary from labels where quality + toxic = 0 or doc_id % 13 = 0""")
def label_consistency(t):
    odd = t("labels").select("doc_id", "quality", "toxic", F.when(F.col("doc_id") % 13 == 0, F.lit(0.5)).otherwise(0.0).alias("odd"))
    return labels.inconsistent(odd, "doc_id", ["quality", "toxic", "odd"])

"""Queries of quality, features and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from netquarry.functions import exprs as X
from netquarry.operators import evaluate, features, quality
from netquarry.plans.registry import Registry

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


def _rounded(df, *names):
    return df.withColumns({c: F.round(c, 6) for c in names})


_SCORES = ("completeness", "consistency", "accuracy", "overall")


@query("""with s as (select case when s_suppkey % 10 = 0 then null when s_suppkey % 17 = 0 then 0 else s_suppkey end as k, s_name, case when s_suppkey % 9 = 0 then 'x' else s_name end as org, s_acctbal - 500 as r,
      s_acctbal / 50 as lat, case when s_suppkey % 4 = 0 then null else s_acctbal / 30 end as lon, n_name as country, s_nationkey as cone from supplier join nation on s_nationkey = n_nationkey),
    c as (select count(*) as n, count(k) + count(s_name) + count(r) + count(org) + count(lat) + count(lon) + count(country) + count(cone) as filled,
      count(*) filter (not coalesce(k between 1 and 4294967295, false)) as bad_keys, count(*) filter (coalesce(lat not between -90 and 90, false) or coalesce(lon not between -180 and 180, false)) as bad_coordinates,
      count(*) filter (r < 1) as bad_ranks, count(*) filter (length(trim(org)) < 2) as bad_names, count(*) - count(distinct k) - max(case when k is null then 1 else 0 end) as repeated,
      avg(r) as mean_rank, count(distinct country) as countries, count(*) filter (lat is not null and lon is not null) as located, avg(cone) as mean_cone from s),
    x as (select *, filled / (n * 8.0) as completeness, 1 - (bad_keys + bad_coordinates + bad_ranks) / n as consistency, 1 - bad_names / n as accuracy from c)
    select 'asrank' as source, n as records, n - bad_keys - repeated as valid, round(completeness, 6) as completeness, round(consistency, 6) as consistency, round(accuracy, 6) as accuracy, round((completeness + consistency + accuracy) / 3, 6) as overall,
      completeness >= 0.8 and (completeness + consistency + accuracy) / 3 >= 0.8 as passed, bad_keys, bad_coordinates, bad_ranks, bad_names, cast(repeated as bigint) as repeated, round(mean_rank, 6) as mean_rank, countries, located, round(mean_cone, 6) as mean_cone from x""")
def quality_ranking(t):
    k = F.col("s_suppkey")
    rows = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.when(k % 10 == 0, None).when(k % 17 == 0, 0).otherwise(k).alias("k"), "s_name", F.when(k % 9 == 0, "x").otherwise(F.col("s_name")).alias("org"), (F.col("s_acctbal") - 500).alias("r"),
        (F.col("s_acctbal") / 50).alias("lat"), F.when(k % 4 == 0, None).otherwise(F.col("s_acctbal") / 30).alias("lon"), F.col("n_name").alias("country"), F.col("s_nationkey").alias("cone"),
    )
    return _rounded(quality.ranking_report(rows, "k", "s_name", "r", "org", "lat", "lon", "country", "cone"), *_SCORES, "mean_rank", "mean_cone")


@query("""with s as (select case when page_id % 8 = 0 then 'AS0' else 'AS' || page_id end as k, case when page_id % 7 = 0 then '' else 'n' || page_id end as name, case when page_id % 6 = 0 then 'ftp://x' when page_id % 5 = 0 then '' else url end as site, case when page_id % 3 = 0 then null else 'NSP' end as kind from pages),
    v as (select *, try_cast(substr(k, 3) as bigint) between 1 and 4294967295 as ok, regexp_matches(site, '^https?://([a-zA-Z0-9-]+\\.)+[a-zA-Z]{2,6}\\.?(:\\d+)?(/?|[/?]\\S+)$', 'i') as good from s),
    c as (select count(*) as n, count(*) filter (name <> '') + count(*) filter (site <> '') + count(kind) + count(*) filter (k <> 'AS0') as filled, count(*) filter (not ok) as bad_keys, count(*) filter (ok and site <> '' and not good) as bad_urls, count(*) filter (ok and name = '') as missing_names, count(*) filter (ok) as valid from v),
    x as (select *, filled / (n * 4.0) as completeness, 1 - (bad_keys + bad_urls) / n as consistency, 1 - missing_names / n as accuracy from c)
    select 'peeringdb' as source, n as records, valid, round(completeness, 6) as completeness, round(consistency, 6) as consistency, round(accuracy, 6) as accuracy, round((completeness + consistency + accuracy) / 3, 6) as overall,
      completeness >= 0.8 and (completeness + consistency + accuracy) / 3 >= 0.8 as passed, bad_keys, bad_urls, missing_names from x""")
def quality_peering(t):
    k = F.col("page_id")
    rows = t("pages").select(
        F.when(k % 8 == 0, "AS0").otherwise(F.concat(F.lit("AS"), k)).alias("k"), F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("n"), k)).alias("name"),
        F.when(k % 6 == 0, "ftp://x").when(k % 5 == 0, "").otherwise(F.col("url")).alias("site"), F.when(k % 3 != 0, "NSP").alias("kind"),
    )
    return _rounded(quality.peering_report(rows, "k", "name", "site", ["kind"]), *_SCORES)


@query("""with s as (select c_custkey as k, case when c_custkey % 9 = 0 then null else c_name end as name, case when c_custkey % 4 = 0 then 'xx' when c_custkey % 5 = 0 then 'USA' when c_custkey % 7 = 0 then null else 'us' end as country, case when c_custkey % 3 = 0 then 'RIPE' when c_custkey % 11 = 0 then null else 'RIPE NCC' end as rir from customer),
    c as (select count(*) as n, count(k) + count(name) + count(country) + count(rir) as filled, count(*) filter (country in ('xx', 'USA')) as bad_countries, count(*) filter (rir = 'RIPE') as bad_registries, count(*) filter (k < 1) as bad_keys from s),
    x as (select *, filled / (n * 4.0) as completeness, 1 - (bad_countries + bad_registries + bad_keys) / n as consistency, 1 - (n * 4 - filled) / (n * 4.0) as accuracy from c)
    select 'aspop' as source, n as records, n - bad_countries - bad_registries - bad_keys as valid, round(completeness, 6) as completeness, round(consistency, 6) as consistency, round(accuracy, 6) as accuracy, round((completeness + consistency + accuracy) / 3, 6) as overall,
      completeness >= 0.8 and (completeness + consistency + accuracy) / 3 >= 0.8 as passed, bad_keys, bad_countries, bad_registries from x""")
def quality_population(t):
    k = F.col("c_custkey")
    rows = t("customer").select(
        k.alias("k"), F.when(k % 9 != 0, F.col("c_name")).alias("name"), F.when(k % 4 == 0, "xx").when(k % 5 == 0, "USA").when(k % 7 == 0, None).otherwise("us").alias("country"),
        F.when(k % 3 == 0, "RIPE").when(k % 11 == 0, None).otherwise("RIPE NCC").alias("rir"),
    )
    codes = rows.sparkSession.createDataFrame([("US",), ("DE",)], "code string")
    return _rounded(quality.population_report(rows, "k", "name", "country", "rir", codes), *_SCORES)


@query("""with s as (select c_custkey as k, case when c_custkey % 6 = 0 then '' else c_name end as name, '' as org, case when c_custkey % 4 = 0 then 'bad domain' when c_custkey % 3 = 0 then null when c_custkey % 5 = 0 then 'Example.COM.' else 'a.example.com' end as domain, case when c_custkey % 10 = 0 then 'timeout' end as error from customer),
    c as (select count(*) as n, count(*) filter (error is null) as valid, count(error) as errors, count(*) filter (error is null and domain = 'bad domain') as bad_domains, count(*) filter (error is null and name = '') as nameless from s),
    x as (select *, valid / n as completeness, 1 - bad_domains / n as consistency, 1 - (nameless + errors) / n as accuracy from c)
    select 'ipinfo' as source, n as records, valid, round(completeness, 6) as completeness, round(consistency, 6) as consistency, round(accuracy, 6) as accuracy, round((completeness + consistency + accuracy) / 3, 6) as overall,
      completeness >= 0.8 and (completeness + consistency + accuracy) / 3 >= 0.8 as passed, errors, bad_domains, nameless from x""")
def quality_info(t):
    k = F.col("c_custkey")
    rows = t("customer").select(
        k.alias("k"), F.when(k % 6 == 0, "").otherwise(F.col("c_name")).alias("name"), F.lit("").alias("org"), F.when(k % 4 == 0, "bad domain").when(k % 3 == 0, None).when(k % 5 == 0, "Example.COM.").otherwise("a.example.com").alias("domain"), F.when(k % 10 == 0, "timeout").alias("error")
    )
    return _rounded(quality.info_report(rows, "k", "name", "org", "domain", "error"), *_SCORES)


_HOSTS = """select page_id, url, case page_id % 9 when 0 then host || '.' when 1 then '-' || host when 2 then replace(host, '.', '_') when 3 then repeat('a', 64) || '.' || host when 4 then upper(host) when 5 then host || '..' when 6 then 'x-.' || host when 7 then host || '.travels' else host end as host
    from (select *, split_part(regexp_replace(url, '^https?://', ''), '/', 1) as host from pages)"""


@query(f"""with h as ({_HOSTS}), l as (select *, lower(case when ends_with(host, '.') then host[:-2] else host end) as name from h), p as (select *, string_split(name, '.') as parts from l)
    select page_id, starts_with(lower(url), 'http') and contains(url, '://') and len(string_split(split_part(split_part(url, '://', 2), '/', 1), '.')) >= 2 as url_ok,
      len(parts) >= 2 and regexp_matches(parts[-1], '^[a-z]+$') and length(parts[-1]) between 2 and 6
        and len(list_filter(parts[:-2], lambda x: length(x) not between 1 and 63 or starts_with(x, '-') or ends_with(x, '-') or not regexp_matches(x, '^[a-z0-9-]*$'))) = 0 as domain_ok from p""")
def url_valid(t):
    """Addresses as they are, and their hosts with dots, hyphens, long labels and other cases."""
    host, k = F.col("host"), F.col("page_id") % 9
    forms = [F.concat(host, F.lit(".")), F.concat(F.lit("-"), host), F.replace(host, F.lit("."), F.lit("_")), F.concat(F.lit("a" * 64 + "."), host), F.upper(host), F.concat(host, F.lit("..")), F.concat(F.lit("x-."), host), F.concat(host, F.lit(".travels"))]
    rows = t("pages").withColumn("host", F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "/.*$", ""))
    form = F.coalesce(F.get(F.array(*forms), k.cast("int")), host)
    return rows.select("page_id", X.valid_url(F.col("url")).alias("url_ok"), X.valid_domain(form).alias("domain_ok"))


@query("select count(*) as lines, count(*) filter (trim(o_orderpriority) <> '') as rows, true as accepted from (select o_orderpriority from orders union all select 'ASN,Name,CC,RIR')")
def accepted_text(t):
    lines = t("orders").select(F.col("o_orderpriority").alias("value"))
    return quality.accepted_text(lines.unionByName(lines.sparkSession.createDataFrame([("ASN,Name,CC,RIR",)], "value string")))


# features: suppliers stand for entities, their line items for what sources know of them


def _suppliers(t):
    """Structs asrank, peeringdb, aspop and ipinfo of suppliers, each for some only."""
    li = t("lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.countDistinct("l_partkey").alias("parts"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"), F.max("l_returnflag").alias("flag"))
    k = F.col("s_suppkey")
    rows = t("supplier").join(li, k == F.col("l_suppkey"), "left").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    # fmt: off
    return rows.select(
        k.alias("asn"),
        F.when(k % 3 != 0, F.struct(F.col("n").alias("rank"), F.when(k % 4 == 0, None).otherwise(F.col("parts")).alias("cone_prefixes"), F.col("quantity").alias("cone_addresses"), F.col("n").alias("cone_asns"), F.col("parts").alias("degree_peer"), (k % 2 * 100).alias("degree_customer"))).alias("asrank"),
        F.when(k % 5 != 0, F.struct(F.when(k % 2 == 0, "").otherwise(F.lit("http://a.b")).alias("website"), F.when(F.col("flag") == "A", None).otherwise(F.concat(F.lit("Type "), "flag")).alias("info_type"), F.lit("Global").alias("info_scope"), F.when(k % 2 == 0, "Open").alias("policy_general"), (k % 2 == 0).alias("info_ipv6"))).alias("peeringdb"),
        F.when(k % 7 == 0, F.struct((k * 10).alias("customer_cone_asns"), F.when(k % 2 == 0, "RIPE NCC").otherwise("ARIN").alias("rir"))).alias("aspop"),
        F.lit(None).cast("struct<name:string>").alias("ipinfo"),
        F.when(k % 6 == 0, "").when(k % 4 == 0, F.concat(F.lit("Crisp Reduced Networks "), k)).otherwise(F.col("s_name")).alias("organization_name"),
        F.when(k % 8 == 0, None).when(k % 2 == 0, "us").otherwise("DE").alias("country"), F.lit("").alias("website"),
    )
    # fmt: on


_SUPPLIERS = """b as (select l_suppkey, count(*) as n, count(distinct l_partkey) as parts, cast(sum(cast(l_quantity as bigint)) as bigint) as quantity, max(l_returnflag) as flag from lineitem group by 1),
    s as (select s_suppkey as k, n, parts, quantity, case when s_suppkey % 6 = 0 then null when s_suppkey % 4 = 0 then 'Crisp Reduced Networks ' || s_suppkey else s_name end as name, case when s_suppkey % 8 = 0 then null when s_suppkey % 2 = 0 then 'US' else 'DE' end as country,
      s_suppkey % 3 <> 0 as a, s_suppkey % 5 <> 0 as p, s_suppkey % 7 = 0 as c, not (s_suppkey % 3 <> 0 or s_suppkey % 5 <> 0 or s_suppkey % 7 = 0) as none, flag from supplier left join b on s_suppkey = l_suppkey)"""
_VOCAB = {"type": ["Type N", "Type R"], "scope": ["Global"], "policy": ["Open"]}


@query(f"""with {_SUPPLIERS}, i as (select *, case when k % 4 = 0 then 0 else coalesce(parts, 0) end as pre from s)
    select k as asn, case when none then 0.0 when a then cast(coalesce(n, 0) as double) end as asrank_rank, case when none then 0.0 when a then 0.0 end as asrank_degree_total,
      round(case when none then 0.0 when a then coalesce(coalesce(quantity, 0) / nullif(pre, 0), 0.0) end, 6) as asrank_cone_density, round(case when none then 0.0 when a then coalesce(coalesce(parts, 0) / nullif(k % 2 * 100, 0), 0.0) end, 6) as asrank_peer_customer_ratio,
      round(case when none then 0.0 when a then ln(1 + coalesce(n, 0)) end, 6) as asrank_cone_size_log, case when none then 0.0 when c then k * 10.0 end as aspop_customer_cone_asns, case when none then 0.0 when c then cast(k % 2 = 0 as int) * 1.0 end as aspop_rir_ripe from i""", doubles=('asrank_degree_total', 'aspop_customer_cone_asns', 'aspop_rir_ripe',))
def feature_numeric(t):
    out = features.features(_suppliers(t), _VOCAB)
    names = ["asn", "asrank_rank", "asrank_degree_total", "asrank_cone_density", "asrank_peer_customer_ratio", "asrank_cone_size_log", "aspop_customer_cone_asns", "aspop_rir_ripe"]
    return _rounded(out.select(*names), "asrank_cone_density", "asrank_peer_customer_ratio", "asrank_cone_size_log")


@query(f"""with {_SUPPLIERS} select k as asn, case when none then 0.0 else cast(name is not null as int) * 1.0 end as org_has_name, 0.0 as org_has_website, case when none then 0.0 else cast(country is not null as int) * 1.0 end as org_has_country,
    case when none then 0.0 else cast(lower(name) like '%isp%' as int) * 1.0 end as org_name_isp, case when none then 0.0 else cast(lower(name) like '%edu%' as int) * 1.0 end as org_name_university, case when none then 0.0 else cast(lower(name) like '%network%' as int) * 1.0 end as org_name_network, case when none then 0.0 else cast(length(name) as double) end as org_name_length,
    case when none then 0.0 else cast(country = 'US' as int) * 1.0 end as org_region_north_america, case when none then 0.0 else cast(country = 'DE' as int) * 1.0 end as org_region_europe from s""", doubles=('org_has_name', 'org_has_website', 'org_has_country', 'org_name_isp', 'org_name_university', 'org_name_network', 'org_region_north_america', 'org_region_europe',))
def feature_text_flags(t):
    names = ["asn", *[f"org_{c}" for c in ("has_name", "has_website", "has_country", "name_isp", "name_university", "name_network", "name_length", "region_north_america", "region_europe")]]
    return features.features(_suppliers(t), _VOCAB).select(*names)


@query(f"""with {_SUPPLIERS} select k as asn, case when none then 0.0 when p then cast(k % 2 <> 0 as int) * 1.0 end as peeringdb_has_website, case when none then 0.0 when p then cast(k % 2 = 0 as int) * 1.0 end as peeringdb_info_ipv6,
    case when none then 0.0 when p then coalesce(cast(flag = 'R' as int), 0) * 1.0 end as peeringdb_type_type_r, case when none then 0.0 when p then cast(k % 2 = 0 as int) * 1.0 end as peeringdb_policy_open from s""", doubles=('peeringdb_has_website', 'peeringdb_info_ipv6', 'peeringdb_type_type_r', 'peeringdb_policy_open',))
def feature_one_hot(t):
    rows = _suppliers(t)
    out = features.features(rows, features.vocabulary(rows))
    for c in ("peeringdb_type_type_r", "peeringdb_policy_open"):
        out = out if c in out.columns else out.withColumn(c, F.when(F.col("peeringdb_has_website").isNotNull(), 0.0))
    return out.select("asn", "peeringdb_has_website", "peeringdb_info_ipv6", "peeringdb_type_type_r", "peeringdb_policy_open")


@query("select s_suppkey as asn, 0.0 as a, 0.0 as b from supplier", doubles=('a', 'b',))
def feature_minimal(t):
    return features.minimal(t("supplier").select(F.col("s_suppkey").alias("asn")), ["a", "b"])


_PER_PART = "select l_partkey, avg(l_quantity) as quantity, avg(l_extendedprice) as price, 1.0 as one from lineitem group by 1"


def _per_part(t):
    return t("lineitem").groupBy("l_partkey").agg(F.avg("l_quantity").alias("quantity"), F.avg("l_extendedprice").alias("price"), F.lit(1.0).alias("one"))


@query(f"""with p as ({_PER_PART}), m as (select avg(quantity) as mq, stddev_pop(quantity) as sq, avg(price) as mp, stddev_pop(price) as sp from p)
    select l_partkey, round((quantity - mq) / sq, 6) as quantity, round((price - mp) / sp, 6) as price, 0.0 as one from p, m""", doubles=('one',))
def standardize_pop(t):
    rows = _per_part(t)
    return _rounded(features.Scaler.fit(rows, ["quantity", "price", "one"]).transform(rows), "quantity", "price", "one")


DIMS = 64  # of the embeddings


def _vectors(t):
    return t("embeddings").select("vec_id", "label", *[F.get("embedding", F.lit(k)).cast("double").alias(f"x{k}") for k in range(DIMS)])


_CELLS = f"select vec_id, label, unnest(range({DIMS})) as j, cast(unnest(embedding) as double) as x from embeddings"


@query(f"""with l as ({_CELLS}), g as (select j, label, count(*) as n, sum(x) as s, sum(x * x) as q from l group by all), a as (select j, count(*) as g, sum(n) as n, sum(s) as s, sum(q) as q, sum(s * s / n) as b from g group by j)
    select 'x' || j as feature, round(((b - s * s / n) / (g - 1)) / ((q - b) / (n - g)), 4) as f from a order by f desc limit 3""")
def anova_f_topk(t):
    scores = features.anova_f(_vectors(t), [f"x{k}" for k in range(DIMS)], "label")
    return features.top_features(scores, 3).withColumn("f", F.round("f", 4))


@query(f"""with c as ({_CELLS}), m as (select * from c where (vec_id + j) % 7 <> 0), gap as (select vec_id, j from c where (vec_id + j) % 7 = 0),
    d as (select a.vec_id as q, b.vec_id as d, sum((a.x - b.x) * (a.x - b.x)) * {DIMS} / count(*) as far from m a join m b on a.j = b.j group by all),
    near as (select g.vec_id, g.j, m.x, row_number() over (partition by g.vec_id, g.j order by far, md5('0-' || m.vec_id)) as nth from gap g join d on d.q = g.vec_id join m on m.vec_id = d.d and m.j = g.j)
    select vec_id, j, round(x, 6) as x from m union all select vec_id, j, round(avg(x), 6) from near where nth <= 5 group by vec_id, j""")
def knn_impute(t):
    """Every seventh cell is missing; its five nearest donors' mean stands for it."""
    rows, own = _vectors(t), [f"x{k}" for k in range(DIMS)]
    masked = rows.withColumns({c: F.when((F.col("vec_id") + k) % 7 != 0, F.col(c)) for k, c in enumerate(own)})
    out = features.knn_impute(masked, own, key="vec_id")
    return out.select("vec_id", F.posexplode(F.array(*own)).alias("j", "x")).select("vec_id", F.col("j").cast("long").alias("j"), F.round("x", 6).alias("x"))


# metrics: labels of documents against rules


def _truth_and_rule(t):
    d = t("documents")
    rule = d.select("doc_id", (F.length("text") >= 400).cast("int").alias("quality"), (F.instr(F.lower("text"), "idiot") + F.instr(F.lower("text"), "moron") > 0).cast("int").alias("toxic"))
    return t("labels"), rule


_PAIRS = """m as (select l.doc_id, quality = 1 as tq, length(text) >= 400 as pq, toxic = 1 as tt, contains(lower(text), 'idiot') or contains(lower(text), 'moron') as pt from labels l join documents d on l.doc_id = d.doc_id),
    u as (select doc_id, 'quality' as label, tq as t, pq as p from m union all select doc_id, 'toxic', tt, pt from m),
    c as (select label, count(*) filter (t and p) as tp, count(*) filter (not t and p) as fp, count(*) filter (t and not p) as fn, count(*) filter (not t and not p) as tn from u group by label),
    r as (select *, (tp + tn) / (tp + fp + fn + tn) as accuracy, coalesce(tp / nullif(tp + fp, 0), 0) as "precision", coalesce(tp / nullif(tp + fn, 0), 0) as recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1, coalesce(tp / nullif(tp + fp + fn, 0), 0) as jaccard, tp + fn as support from c)"""
_BOTH = ["quality", "toxic"]


@query(f"""with {_PAIRS} select label, tp, fp, fn, tn, round(accuracy, 6) as accuracy, round("precision", 6) as "precision", round(recall, 6) as recall, round(f1, 6) as f1, round(jaccard, 6) as jaccard, support from r""")
def eval_label_metrics(t):
    out = evaluate.label_metrics(*_truth_and_rule(t), "doc_id", _BOTH)
    return _rounded(out, "accuracy", "precision", "recall", "f1", "jaccard")


@query(f"""with {_PAIRS}, s as (select sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from c), e as (select count(*) as rows, count(*) filter (tq = pq and tt = pt) / count(*) as exact_match, count(*) filter ((tq or not pq) and (tt or not pt)) / count(*) as subset from m),
    a as (select avg("precision") as p, avg(recall) as r, avg(f1) as f, avg(jaccard) as j from r)
    select rows, round(exact_match, 6) as exact_match, round(subset, 6) as subset, round(p, 6) as macro_precision, round(r, 6) as macro_recall, round(f, 6) as macro_f1, round(j, 6) as macro_jaccard,
      round(tp / (tp + fp), 6) as micro_precision, round(tp / (tp + fn), 6) as micro_recall, round(2 * tp / (2 * tp + fp + fn), 6) as micro_f1 from e, a, s""")
def eval_macro_micro(t):
    out = evaluate.summary(evaluate.paired(*_truth_and_rule(t), "doc_id", _BOTH), _BOTH)
    return _rounded(out, *[c for c in out.columns if c != "rows"])


_SCORED = """s as (select 'quality' as label, quality as y, least(length(text), 4000) / 4000.0 as score from labels l join documents d on l.doc_id = d.doc_id union all select 'toxic', toxic, (d.doc_id % 100) / 100.0 from labels l join documents d on l.doc_id = d.doc_id)"""


@query(f"""with {_SCORED}, a as (select label, score, sum(y) as tp, count(*) - sum(y) as fp from s group by all),
    b as (select *, sum(tp) over (partition by label order by score desc) as ctp, sum(fp) over (partition by label order by score desc) as cfp, sum(tp) over (partition by label) as pos from a),
    d as (select *, ctp / (ctp + cfp) as p, coalesce(lag(ctp / (ctp + cfp)) over (partition by label order by score desc), 1.0) as q from b)
    select label, cast(max(pos) as bigint) as positives, round(sum(tp / pos * (p + q) / 2), 6) as pr_auc from d group by label""")
def eval_pr_auc(t):
    met = t("labels").join(t("documents"), "doc_id")
    rows = met.select(F.lit("quality").alias("label"), F.col("quality").alias("truth"), (F.least(F.length("text"), F.lit(4000)) / 4000.0).alias("score"))
    rows = rows.unionByName(met.select(F.lit("toxic").alias("label"), F.col("toxic").alias("truth"), ((F.col("doc_id") % 100) / 100.0).alias("score")))
    return _rounded(evaluate.pr_auc(rows), "pr_auc")


@query("""with m as (select 'long' as model, length(text) >= 400 as pq, false as pt, l.* from labels l join documents d on l.doc_id = d.doc_id union all select 'all', true, false, l.* from labels l join documents d on l.doc_id = d.doc_id),
    u as (select model, quality = 1 as t, pq as p, 'quality' as label from m union all select model, toxic = 1, pt, 'toxic' from m),
    c as (select model, label, count(*) filter (t and p) as tp, count(*) filter (not t and p) as fp, count(*) filter (t and not p) as fn from u group by all)
    select model, round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)), 6) as macro_f1 from c group by model""")
def eval_compare_models(t):
    d = t("documents")
    long = d.select("doc_id", (F.length("text") >= 400).cast("int").alias("quality"))
    out = evaluate.compared({"long": long, "all": d.select("doc_id", F.lit(1).alias("quality"))}, t("labels"), "doc_id", _BOTH)
    return _rounded(out.select("model", "macro_f1"), "macro_f1")


@query("""with m as (select lang, quality = 1 as t, length(text) >= 400 as p from labels l join documents d on l.doc_id = d.doc_id)
    select lang, 'quality' as label, count(*) filter (t and p) as tp, count(*) filter (not t and p) as fp, count(*) filter (t and not p) as fn, count(*) filter (not t and not p) as tn from m group by lang""")
def eval_confusion_by_group(t):
    truth, rule = _truth_and_rule(t)
    pairs = evaluate.paired(truth, rule, "doc_id", ["quality"]).join(t("documents").select("doc_id", "lang"), "doc_id")
    return evaluate.confusion(pairs, ["quality"], ["lang"])


@query(f"""with {_PAIRS}, o as (select 'quality' as label, count(*) filter (tq) / count(*) as f from m union all select 'toxic', count(*) filter (tt) / count(*) from m)
    select r.label, round(r.f1, 6) as first, round(r.recall, 6) as second, round(r.recall - r.f1, 6) as delta, abs(r.recall - r.f1) < 0.05 as close from r join o on r.label = o.label""")
def eval_deltas(t):
    one = evaluate.label_metrics(*_truth_and_rule(t), "doc_id", _BOTH)
    other = one.select("label", F.col("recall").alias("f1"))
    return _rounded(evaluate.deltas(one, other, "f1"), "first", "second", "delta")


# two stages: a customer's orders before a date as truth, all of them as prediction


def _stages(t):
    o = t("orders").select("o_custkey", "o_orderdate", F.struct(F.col("o_orderpriority").alias("cat"), F.col("o_orderstatus").alias("sub")).alias("s"))
    own = lambda c: F.sort_array(F.collect_set(c))
    early = F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp")
    pred = o.groupBy("o_custkey").agg(own(F.col("s.cat")).alias("cats"), own(F.when(F.col("s.sub") != "P", F.col("s"))).alias("subs"))
    truth = o.filter(early).groupBy("o_custkey").agg(own(F.col("s.cat")).alias("cats"), own(F.when(F.col("s.sub") == "F", F.col("s"))).alias("subs"))
    return pred, truth


_STAGES = """e as (select o_custkey as k, o_orderpriority as cat, o_orderstatus as sub, o_orderdate < timestamp '1997-01-01' as early from orders), tk as (select distinct k from e where early),
    pc as (select distinct e.k, cat from e join tk on e.k = tk.k), tc as (select distinct k, cat from e where early), ps as (select distinct e.k, cat, sub from e join tk on e.k = tk.k where sub <> 'P'), ts as (select distinct k, cat, sub from e where early and sub = 'F'),
    pt as (select k, cat || ':' || sub as tag from ps union select k, cat from pc where (k, cat) not in (select (k, cat) from ps)), tt as (select k, cat || ':' || sub as tag from ts union select k, cat from tc where (k, cat) not in (select (k, cat) from ts))"""


@query(f"""with {_STAGES}, g as (select tk.k, label from tk, (select distinct cat as label from pc) q),
    f as (select label, (g.k, label) in (select (k, cat) from tc) as t, (g.k, label) in (select (k, cat) from pc) as p from g)
    select label, count(*) filter (t and p) as tp, count(*) filter (not t and p) as fp, count(*) filter (t and not p) as fn, count(*) filter (not t and not p) as tn from f group by label""")
def hier_stage1(t):
    pred, truth = _stages(t)
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return evaluate.confusion(evaluate.stage1_pairs(evaluate.met_stages(pred, truth, "o_custkey"), "o_custkey", names), names)


@query(f"""with {_STAGES}, g as (select distinct k, cat from ts), j as (select g.k, g.cat, count(*) filter (a.sub is not null and b.sub is not null) as both_, count(*) as either, max(case when b.sub is not null then 1 else 0 end) as any_
      from g left join lateral (select sub from ts where ts.k = g.k and ts.cat = g.cat union select sub from ps where ps.k = g.k and ps.cat = g.cat) u on true left join ts a on a.k = g.k and a.cat = g.cat and a.sub = u.sub left join ps b on b.k = g.k and b.cat = g.cat and b.sub = u.sub group by g.k, g.cat)
    select cat as category, count(*) as n, round(avg(both_ / either), 6) as jaccard, round(avg(any_), 6) as coverage from j group by cat""")
def hier_stage2_jaccard(t):
    out = evaluate.stage2_by_category(evaluate.met_stages(*_stages(t), "o_custkey"), "o_custkey")
    return _rounded(out, "jaccard", "coverage")


@query("""with p as (select o_custkey as k, o_orderpriority as cat, o_orderstatus as sub from orders where o_orderstatus <> 'P' group by all), n as (select count(distinct o_custkey) as rows from orders), x as (select count(*) filter (cat = '5-LOW') as w, count(*) filter (cat in ('4-NOT SPECIFIED', '5-LOW') or sub = 'O') as i from p)
    select rows, w as without_stage1, i as invalid_sub, round(1 - (w + i) / rows, 6) as rate from n, x""")
def hier_consistency(t):
    pred, _ = _stages(t)
    pred = pred.withColumn("cats", F.array_remove("cats", "5-LOW"))
    valid = pred.sparkSession.createDataFrame([("1-URGENT", "F"), ("2-HIGH", "F"), ("3-MEDIUM", "F")], "category string, subcategory string")
    return _rounded(evaluate.consistency(pred, "o_custkey", valid), "rate")


@query(f"""with {_STAGES}, j as (select coalesce(pt.k, tt.k) as k, count(*) filter (pt.k is null) as missed, count(*) filter (tt.k is null) as extra, count(*) filter (pt.k is not null and tt.k is not null) as same from pt full join tt on pt.k = tt.k and pt.tag = tt.tag group by 1)
    select count(*) as rows, round(avg(case when missed + extra = 0 then 1.0 else 0 end), 6) as exact, round(avg(case when same > 0 or missed + extra = 0 then 1.0 else 0 end), 6) as partial from j""")
def hier_system_match(t):
    return _rounded(evaluate.system_match(evaluate.met_stages(*_stages(t), "o_custkey")), "exact", "partial")


@query(f"""with {_STAGES}, x as (select 'extra_' || cat as error from pc where (k, cat) not in (select (k, cat) from tc) union all select 'missed_' || cat from tc where (k, cat) not in (select (k, cat) from pc))
    select error, count(*) as n from x group by error order by n desc, error limit 10""")
def hier_errors_top10(t):
    return evaluate.errors_top(evaluate.met_stages(*_stages(t), "o_custkey"))

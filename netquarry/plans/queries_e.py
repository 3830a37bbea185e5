"""Queries of machines, approaches, guarded and saved steps, split documents and stage tables, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from netquarry.operators import estimators, evaluate, guarded, labels, models, quality, saved, split
from netquarry.operators import kernel_svm as machines
from netquarry.plans import approaches, jobs, queries_b
from netquarry.plans.registry import Registry
from netquarry.session import scratch
from netquarry.sources import paged, readers, workbook
from netquarry.streaming import monitoring, scoring

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


def _spark(t):
    return t("region").sparkSession


# documents of JSON


def _document(t, name, first, rows, last):
    """One JSON document in one file: texts in the order of their partitions, by a task that holds a row at a time."""
    spark, path = _spark(t), scratch(t("region").sparkSession, name)
    one = lambda x: spark.createDataFrame([(x,)], "value string").coalesce(1)
    one(first).union(rows).union(one(last)).coalesce(1).write.text(path)
    return path


@query("select c_custkey as asn, c_name as name, c_nationkey % 2 = 0 as info_ipv6 from customer")
def keyed_json(t):
    """One JSON object of key to record, read by ranges; the first member is none."""
    record = F.struct(F.concat(F.col("c_name")).alias("name"), (F.col("c_nationkey") % 2 == 0).alias("info_ipv6"))
    rows = t("customer").select(F.concat(F.lit(',"AS'), F.col("c_custkey").cast("string"), F.lit('":'), F.to_json(record)).alias("value"))
    path = _document(t, "keyed-json", '{"none":0', rows, "}")
    return readers.read_keyed_json(_spark(t), path, "name string, info_ipv6 boolean").filter("asn is not null")


_MARKED = "select doc_id as asn, 'Org {,\"' || doc_id as organization_name, case when quality = 1 and toxic = 1 then 'Access|IXP' when quality = 1 then 'Access' when toxic = 1 then 'IXP' else '' end as tags, case when quality = 1 then 0.75 end as access, 'm' as model_used from labels"


@query(_MARKED, doubles=("access",))
def predictions_json(t):
    """Predictions as one JSON document, read by ranges; names hold brackets, commas and quotes."""
    tags = F.array_compact(F.array(F.when(F.col("quality") == 1, F.lit("Access")), F.when(F.col("toxic") == 1, F.lit("IXP"))))
    conf = F.when(F.col("quality") == 1, F.create_map(F.lit("Access"), F.lit(0.75))).otherwise(F.create_map().cast("map<string,double>"))
    record = F.struct(F.col("doc_id").alias("asn"), F.concat(F.lit('Org {,"'), "doc_id").alias("organization_name"), tags.alias("tags"), conf.alias("confidence_scores"), F.lit("m").alias("model_used"))
    path = _document(t, "predictions", '{"meta":{"classifications":[1]},"classifications":[null', t("labels").select(F.concat(F.lit(","), F.to_json(record)).alias("value")), "]}")
    rows = readers.read_predictions_json(_spark(t), path).filter("asn is not null")
    return rows.select("asn", "organization_name", F.array_join("tags", "|").alias("tags"), F.try_element_at("confidence_scores", F.lit("Access")).alias("access"), "model_used")


# machines


def _margin_rows(t):
    """Labels with lengths of their documents, and random-looking but fixed numbers beside them."""
    d = t("documents").select("doc_id", (F.least(F.col("n_chars"), F.lit(20_000)) / 5000.0).alias("a"), (F.col("doc_id") * 37 % 101 / 101.0).alias("b"))
    return t("labels").select("doc_id", "quality").join(d, "doc_id").withColumn("goal", ((F.col("a") + 0.3 * F.col("b") > 0.35) & (F.col("a") < 1.5)).cast("int"))


@query("""select l.doc_id, case when least(n_chars, 20000) / 5000.0 + 0.3 * ((l.doc_id * 37 % 101) / 101.0) > 0.35 and least(n_chars, 20000) / 5000.0 < 1.5 then 1 else 0 end as goal, true as optimal
    from labels l join documents d on l.doc_id = d.doc_id""")
def kernel_svm(t):
    """A kernel machine over all labelled documents: each row's decision value, summed from the support vectors, meets the conditions of the dual's optimum."""
    rows = _margin_rows(t)
    path = scratch(_spark(t), "svm-query")
    rows.select("doc_id", "goal", F.array("a", "b").alias("x"), F.when(F.col("goal") == 1, 1.0).otherwise(-1.0).alias("y")).withColumn("at", F.monotonically_increasing_id()).write.parquet(path)
    own, c = _spark(t).read.parquet(path), 10.0
    machine = machines.fitted(own.select("at", "x", "y"), c, 2.0, 2)
    return machines.violations(machine.scored(own), machine, c).select("doc_id", "goal", "optimal")


class Above:
    """A model with a parameter and nothing to learn: 1 where the column is over it."""

    def __init__(self, key, columns, own, over):
        self.key, self.column, self.labels, self.over = key, columns[0], own, over

    def fit(self, df):
        return self

    def predict(self, df):
        return df.select(self.key, *[(F.col(self.column) > self.over).cast("double").alias(y) for y in self.labels])


@query("""with o as (select o_orderkey, o_totalprice, case when o_totalprice > 150000 or o_orderkey % 7 = 0 then 1 else 0 end as y from orders),
    g as (select unnest([100000.0, 150000.0, 200000.0]) as over), j as (select over, sum(case when o_totalprice > over and y = 1 then 1 else 0 end) / sum(case when o_totalprice > over or y = 1 then 1.0 else 0 end) as jaccard from o, g group by over),
    b as (select over from j order by jaccard desc limit 1) select o_orderkey, b.over as best, case when o_totalprice > b.over then 1 else 0 end as chosen from o, b""", doubles=("best",))
def best_configuration(t):
    """The best of a grid by nested folds, and its predictions of all rows."""
    rows = t("orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("price"), ((F.col("o_totalprice") > 150_000) | (F.col("o_orderkey") % 7 == 0)).cast("int").alias("y"))
    best, _ = models.searched(rows, "o_orderkey", "y", ["price"], [{"over": v} for v in (100_000.0, 150_000.0, 200_000.0)], 3, Above)
    chosen = Above("o_orderkey", ["price"], ["y"], **best).fit(rows).predict(rows)
    return chosen.select("o_orderkey", F.lit(best["over"]).alias("best"), F.col("y").cast("int").alias("chosen"))


class GroupRate:
    """Predicts the share of positives that the training rows have in a row's group, and the share of all of them where a group is new."""

    def __init__(self, key, by, label):
        self.key, self.by, self.label = key, by, label

    def fit(self, df):
        self.rates = df.groupBy(self.by).agg(F.avg(self.label).alias("rate"))
        self.mean = df.agg(F.avg(self.label).alias("m")).first()["m"]
        return self

    def predict(self, df):
        return df.select(self.key, self.by).join(F.broadcast(self.rates), self.by, "left").select(self.key, F.coalesce("rate", F.lit(self.mean)).alias(self.label))


_FOLDS = "select c_custkey, cast(case when r - 1 < (n % 3) * (n // 3 + 1) then (r - 1) // (n // 3 + 1) else n % 3 + (r - 1 - (n % 3) * (n // 3 + 1)) // (n // 3) end as int) as fold from (select c_custkey, row_number() over (order by md5('42-' || c_custkey)) as r, count(*) over () as n from customer)"


@query(f"""with f as ({_FOLDS}), c as (select c.c_custkey, fold, c_mktsegment as seg, c_nationkey as nation, case when c_acctbal > 4000 then 1 else 0 end as rich from customer c join f on c.c_custkey = f.c_custkey),
    s as (select fold, seg, sum(rich) as p, count(*) as n from c group by all), st as (select seg, sum(p) as p, sum(n) as n from s group by seg),
    q as (select fold, nation, sum(rich) as p, count(*) as n from c group by all), qt as (select nation, sum(p) as p, sum(n) as n from q group by nation),
    a as (select f.fold, sum(case when c.fold <> f.fold then rich else 0 end) / sum(case when c.fold <> f.fold then 1.0 else 0 end) as m from c, (select distinct fold from c) f group by f.fold)
    select c.c_custkey, c.rich, round(coalesce((st.p - s.p) / nullif(st.n - s.n, 0), a.m), 6) as by_segment, round(coalesce((qt.p - q.p) / nullif(qt.n - q.n, 0), a.m), 6) as by_nation
    from c join s on c.fold = s.fold and c.seg = s.seg join st on c.seg = st.seg join q on c.fold = q.fold and c.nation = q.nation join qt on c.nation = qt.nation join a on c.fold = a.fold""")
def out_of_fold(t):
    """Out-of-fold scores of a stack's base models: each key once, by models that were fitted without its fold."""
    rows = t("customer").select("c_custkey", F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("nation"), (F.col("c_acctbal") > 4000).cast("int").alias("rich"))
    bases = {"segment": lambda d: GroupRate("c_custkey", "seg", "rich").fit(d), "nation": lambda d: GroupRate("c_custkey", "nation", "rich").fit(d)}
    oof, _ = models.stacked(rows, "c_custkey", ["rich"], bases, folds=3)
    return oof.select("c_custkey", "rich", F.round("segment__rich", 6).alias("by_segment"), F.round("nation__rich", 6).alias("by_nation"))


def _dealt_sql(k: int) -> str:
    """Iterative stratification in SQL: a table expression for each of the four combinations of two labels, which are dealt one after the other."""
    head = f"""keys as (select doc_id, coalesce(max(quality), 0) as q, coalesce(max(toxic), 0) as x from labels where doc_id is not null group by doc_id),
        tot as (select sum(q) as q, sum(x) as x, count(*) as n from keys), c as (select keys.q, keys.x, count(*) as n, least(case when keys.q = 1 then any_value(tot.q) else 4611686018427387904 end, case when keys.x = 1 then any_value(tot.x) else 4611686018427387904 end) as rare,
            case when keys.q = 1 and (keys.x = 0 or any_value(tot.q) <= any_value(tot.x)) then 'q' when keys.x = 1 then 'x' else '' end as j from keys, tot group by keys.q, keys.x),
        o as (select *, row_number() over (order by rare, q::varchar || x::varchar) as nth from c),
        s0 as (select f as fold, tot.q / {k}::double as wq, tot.x / {k}::double as wx, tot.n / {k}::double as room, 0 as n, 0 as quality, 0 as toxic from range({k}) r(f), tot)"""
    steps = []
    for m in range(1, 5):
        steps.append(f"""d{m} as (select s.*, o.q, o.x, coalesce(o.n // {k} + case when row_number() over (order by -(case o.j when 'q' then wq when 'x' then wx else room end), -room, fold) <= o.n % {k} then 1 else 0 end, 0) as given from s{m - 1} s left join o on o.nth = {m}),
        s{m} as (select fold, wq - given * coalesce(q, 0) as wq, wx - given * coalesce(x, 0) as wx, room - given as room, n + given as n, quality + given * coalesce(q, 0) as quality, toxic + given * coalesce(x, 0) as toxic from d{m})""")
    return f"with {head}, {', '.join(steps)} select cast(fold as int) as fold, cast(n as bigint) as n, cast(quality as bigint) as quality, cast(toxic as bigint) as toxic from s4"


@query(_dealt_sql(5))
def multilabel_kfold(t):
    """Keys and labels' counts of each fold."""
    l = t("labels")  # noqa: E741
    folds = split.multilabel_kfold(l, "doc_id", ["quality", "toxic"], 5)
    return folds.join(l, "doc_id").groupBy("fold").agg(F.count("*").alias("n"), F.sum("quality").alias("quality"), F.sum("toxic").alias("toxic"))


# approaches

_TAXONOMY = approaches.Taxonomy(["A", "B", "C"], {"A_x": "A", "A_y": "A", "B_x": "B"})
_S = "vec_id, (vec_id * 7 % 101) / 100.0 as a, (vec_id * 13 % 101) / 100.0 as b, (vec_id * 29 % 101) / 100.0 as c, (vec_id * 31 % 101) / 100.0 as ax, (vec_id * 37 % 101) / 100.0 as ay, (vec_id * 41 % 101) / 100.0 as bx"


def _part(t, names, factors):
    return lambda: t("embeddings").select(F.col("vec_id"), *[(F.col("vec_id") * f % 101 / 100.0).alias(n) for n, f in zip(names, factors, strict=True)])


def _never():
    raise AssertionError("an input that the approach doesn't need")


def _by(t, name, **inputs):
    every = {n: _never for n in ("scores", "children", "svm", "llm", "entities", "subs")}
    request = approaches.Request({**every, **inputs}, _TAXONOMY, "vec_id")
    return approaches.predicted(name, request).select("vec_id", F.array_join("tags", "|").alias("tags"), F.round(F.aggregate(F.map_values("confidence_scores"), F.lit(0.0), lambda a, x: a + x), 6).alias("sum"))


def _over(*pairs):
    """SQL of the tags over 0.5 and the sum of their scores."""
    tags = ", ".join(f"case when {c} > 0.5 then '{n}' end" for n, c in pairs)
    return f"array_to_string(list_filter([{tags}], lambda x: x is not null), '|') as tags, round({' + '.join(f'case when {c} > 0.5 then {c} else 0 end' for _, c in pairs)}, 6) as sum"


@query(f"select vec_id, {_over(('A', 'a'), ('B', 'b'), ('C', 'c'))} from (select {_S} from embeddings)", doubles=("sum",))
def predict_flat(t):
    return _by(t, "flat", scores=_part(t, "ABC", (7, 13, 29)))


@query(f"""select vec_id, {_over(('A', 'a'), ('B', 'b'), ('C', 'c'), ('A_x', 'gx'), ('A_y', 'gy'), ('B_x', 'hx'))}
    from (select *, case when a > 0.5 then ax else 0 end as gx, case when a > 0.5 then ay else 0 end as gy, case when b > 0.5 then bx else 0 end as hx from (select {_S} from embeddings))""", doubles=("sum",))
def predict_hierarchical(t):
    return _by(t, "hierarchical", scores=_part(t, "ABC", (7, 13, 29)), children=_part(t, ("A_x", "A_y", "B_x"), (31, 37, 41)))


@query(f"select vec_id, {_over(('A', 'va'), ('B', 'vb'), ('C', 'vc'))} from (select vec_id, 0.4 * a + 0.6 * ax as va, 0.4 * b + 0.6 * ay as vb, 0.4 * c + 0.6 * bx as vc from (select {_S} from embeddings))", doubles=("sum",))
def predict_hybrid(t):
    return _by(t, "hybrid", svm=_part(t, "ABC", (7, 13, 29)), llm=_part(t, "ABC", (31, 37, 41)))


@query(f"""select vec_id, case when m > 0.5 then tags when a = m then 'A' when b = m then 'B' else 'C' end as tags, case when m > 0.5 then sum else m end as sum
    from (select vec_id, a, b, c, greatest(a, b, c) as m, {_over(('A', 'a'), ('B', 'b'), ('C', 'c'))} from (select {_S} from embeddings))""", doubles=("sum",))
def predict_one_model(t):
    return _by(t, "one_model", scores=_part(t, "ABC", (7, 13, 29)))


@query(f"""with s as (select {_S} from embeddings), k as (select vec_id, a, b, c, greatest(a, b, c) as m, case when vec_id % 2 = 0 then 'x' else 'y' end as sub from s),
    g as (select *, a > 0.5 or (m <= 0.5 and a = m) as ia, b > 0.5 or (m <= 0.5 and b = m and a < m) as ib, c > 0.5 or (m <= 0.5 and c = m and a < m and b < m) as ic from k)
    select vec_id, array_to_string(list_filter([case when ia then 'A_' || sub end, case when ib then 'B_x' end, case when ic then 'C' end], lambda x: x is not null), '|') as tags,
        round(case when ia then 0.9 else 0 end + case when ib then 0.1 else 0 end + case when ic then c else 0 end, 6) as sum from g""", doubles=("sum",))
def predict_two_stages(t):
    """The second stage answers for A alone: B falls back to its first subcategory, C has none."""
    vec = F.col("vec_id")
    subs = lambda: t("embeddings").select("vec_id", F.lit("A").alias("category"), F.when(vec % 2 == 0, "x").otherwise("y").alias("subcategory"), F.lit(0.9).alias("confidence"))
    entities = lambda: t("embeddings").select("vec_id", F.lit("n").alias("organization_name"))
    request = approaches.Request({"svm": _part(t, "ABC", (7, 13, 29)), "entities": entities, "subs": subs, "children": _never, "scores": _never}, _TAXONOMY, "vec_id")
    out = approaches.predicted("two_stages", request)
    return out.select("vec_id", F.array_join(F.array_sort("tags"), "|").alias("tags"), F.round(F.aggregate(F.map_values("confidence_scores"), F.lit(0.0), lambda a, x: a + x), 6).alias("sum"))


# faults and requests


def _price(row):
    """Fails for a tenth of the rows, in three ways."""
    k = row["o_orderkey"]
    if k % 20 == 3:
        raise ValueError(f"validation of {k}")
    if k % 40 == 7:
        raise TimeoutError(f"api timeout {k}")
    if k % 40 == 27:
        raise MemoryError(f"out of memory at {k}")
    return {"cents": round(float(row["o_totalprice"]) * 100)}


def _guarded(t):
    rows = t("orders").select("o_orderkey", "o_totalprice")
    return guarded.guarded(rows, _price, "cents long", "stage1", fallback=lambda r: {"cents": -1 if r["o_orderkey"] % 20 == 3 else None})


@query("select o_orderkey, case when o_orderkey % 20 = 3 then -1 else cast(round(o_totalprice * 100) as bigint) end as cents from orders where o_orderkey % 40 not in (7, 27)")
def guarded_steps(t):
    """A step over all orders that fails for a tenth of them: results, and what stands for some that failed."""
    return _guarded(t).results().select("o_orderkey", "cents").filter("cents is not null")


@query("""select o_orderkey, case when o_orderkey % 20 = 3 then 'ValueError' when o_orderkey % 40 = 7 then 'TimeoutError' else 'MemoryError' end as kind, case when o_orderkey % 20 = 3 then 'validation_error' when o_orderkey % 40 = 7 then 'api_error' else 'system_error' end as category,
    case when o_orderkey % 20 = 3 then 'low' else 'high' end as severity, 'fallback' as recovery_action, 1 as tries from orders where o_orderkey % 20 = 3 or o_orderkey % 40 in (7, 27)""")
def error_export(t):
    """Errors of all orders, exported where they are and read back."""
    path = scratch(_spark(t), "errors")
    _guarded(t).export(path)
    return _spark(t).read.json(f"{path}/errors").select("o_orderkey", "kind", "category", "severity", "recovery_action", F.col("tries").cast("int").alias("tries"))


@query("select c_custkey, case when c_custkey % 50 = 0 then null else 'answer ' || c_custkey end as response from customer")
def saved_once(t):
    """Answers saved as they come; a second job asks for what failed alone, and finds no other key unanswered."""

    def model(prompts):
        if int(prompts[0]) % 50 == 0:
            raise OSError("refused")
        return [f"answer {prompts[0]}"]

    def again(prompts):
        if int(prompts[0]) % 50 == 0:
            raise OSError("refused")
        return ["asked again"]

    path = scratch(_spark(t), "saved")
    prompts = t("customer").select("c_custkey", F.col("c_custkey").cast("string").alias("prompt"))
    options = {"buckets": 8, "flush": 500, "tries": 1}
    saved.responses_once(prompts, model, path, "c_custkey", **options)
    return saved.responses_once(prompts, again, path, "c_custkey", **options).select("c_custkey", "response")


@query("select n_name as source, case when n_nationkey % 2 = 0 then n_name || ' data' end as body, case when n_nationkey % 2 = 1 then 'OSError: no ' || n_name end as error from nation")
def download_all(t):
    """All sources side by side, a task each; one that fails doesn't stop the others."""

    def get(name, k):
        if int(k) % 2:
            raise OSError(f"no {name}")
        return f"{name} data"

    return paged.gathered(t("nation").select(F.col("n_name").alias("source"), F.col("n_nationkey").cast("string").alias("place")), get)


# tables


@query("select 'quality' as name, count(*) as rows, sum(case when quality = (case when doc_id % 3 = 0 then 1 - quality else quality end) then 1 else 0 end) as same from labels union all select 'toxic', count(*), count(*) from labels")
def common_columns(t):
    """Rows in which two tables agree, for each column that both have."""
    one = t("labels")
    other = one.select("doc_id", "toxic", F.when(F.col("doc_id") % 3 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("quality"))
    own = labels.common_columns(one, other, ["quality", "lang", "toxic"])
    met = one.select("doc_id", *own).join(other.select(F.col("doc_id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in own]), F.col("doc_id") == F.col("_id"))
    return met.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), (F.col(c) == F.col(f"_{c}")).cast("int").alias("same")) for c in own]))).groupBy("name").agg(F.count("*").alias("rows"), F.sum("same").alias("same"))


@query("""select 0 as records, 0 as valid, 0.0 as completeness, 0.0 as overall, false as passed, name as source from (values ('asrank'), ('aspop'), ('ipinfo'), ('peeringdb')) v(name) where (select count(*) from customer where c_acctbal > 1000000) = 0""", doubles=("completeness", "overall"))
def quality_empty(t):
    """Reports of sources whose rows have all been filtered out: all scores are 0, and none passes."""
    none = t("customer").filter("c_acctbal > 1000000").select(
        F.col("c_custkey").cast("string").alias("k"), F.col("c_name").alias("name"), F.col("c_custkey").cast("long").alias("rank"), F.col("c_name").alias("org"), F.col("c_acctbal").cast("double").alias("lat"), F.col("c_acctbal").cast("double").alias("lon"),
        F.col("c_mktsegment").alias("country"), F.col("c_custkey").cast("long").alias("cone"), F.col("c_mktsegment").alias("site"), F.col("c_mktsegment").alias("rir"), F.col("c_mktsegment").alias("domain"), F.lit(None).cast("string").alias("error"),
    )
    codes = _spark(t).createDataFrame([("US",)], "code string")
    reports = [quality.ranking_report(none, "k", "name", "rank", "org", "lat", "lon", "country", "cone"), quality.peering_report(none, "k", "name", "site", ["org"]), quality.population_report(none, "k", "name", "country", "rir", codes), quality.info_report(none, "k", "name", "org", "domain", "error")]
    out = [r.select(F.col("records").cast("int").alias("records"), F.col("valid").cast("int").alias("valid"), "completeness", "overall", "passed", "source") for r in reports]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("select s_suppkey, s_name, cast(s_acctbal as double) as s_acctbal, s_suppkey % 2 = 0 as even, case when s_suppkey % 3 = 0 then null else 'a<b> & \"' || s_suppkey end as note from supplier")
def workbook_cells(t):
    """A table as a workbook, read back cell by cell."""
    spark, path = _spark(t), scratch(_spark(t), "book") + ".xlsx"
    rows = t("supplier").select("s_suppkey", "s_name", F.col("s_acctbal").cast("double").alias("s_acctbal"), (F.col("s_suppkey") % 2 == 0).alias("even"), F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit('a<b> & "'), "s_suppkey")).alias("note"))
    workbook.write(rows, path)
    return workbook.read(spark, path, "s_suppkey long, s_name string, s_acctbal double, even boolean, note string")


@query("select chr(cast(65 + n_nationkey as int)) || 'X' as code, n_name as name, r_name as rir from nation join region on n_regionkey = r_regionkey")
def registry_file(t):
    """A registry of countries in its file, read where it is."""
    rows = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    one = F.struct(F.col("n_name").alias("name"), F.col("r_name").alias("rir"), F.lit("c").alias("continent"))
    value = F.concat(F.lit(',"'), F.char(F.lit(65) + F.col("n_nationkey")), F.lit('X":'), F.to_json(one))
    path = _document(t, "registry", '{"registries":{},"countries":{"":{}', rows.select(value.alias("value")), "}}")
    return readers.read_countries(_spark(t), path).select("code", "name", "rir")



# jobs, stages and scores


@query("select 'aspop' as source, true as passed, count(*) as rows from customer union all select 'ipinfo', true, count(*) from supplier")
def processed_sources(t):
    """Sources processed as a job does it: found in a folder, read, written, judged; the rows that it wrote."""
    spark = _spark(t)
    place, out = scratch(spark, "sources-in"), scratch(spark, "sources-out")
    k = F.col("c_custkey").cast("string")
    population = t("customer").select(k.alias("ASN"), F.col("c_name").alias("Name"), F.lit("US").alias("CC"), F.lit("ARIN").alias("RIR"), k.alias("Cust_cone_ASN"), k.alias("Cust_cone_pfx"), k.alias("Cust_cone_addr"))
    population.write.option("header", True).csv(f"{place}/aspop2.csv")
    s = F.col("s_suppkey") + 1
    record = F.struct(F.col("s_name").alias("name"), F.concat(F.lit("AS"), s, F.lit(" {x}, y")).alias("org"), F.concat(F.lit("s"), s, F.lit(".example.com")).alias("domain"), F.lit("DE").alias("country"))
    lines = t("supplier").select(F.concat(F.lit(',"AS'), s.cast("string"), F.lit('":'), F.to_json(record)).alias("value"))
    one = lambda x: spark.createDataFrame([(x,)], "value string").coalesce(1)
    one('{"data":{"none":{}').union(lines).union(one("}}")).coalesce(1).write.text(f"{place}/ipinfo1.json")
    passed = jobs.process_all(spark, place, out, spark.createDataFrame([("US",)], "code string"))
    found = [spark.read.parquet(f"{out}/{name}.parquet").agg(F.count("*").alias("rows")).select(F.lit(name).alias("source"), F.lit(ok).alias("passed"), "rows") for name, ok in sorted(passed.items())]
    return found[0].unionByName(found[1])


@query(queries_b.ORACLE["feature_numeric"])
def stage_features(t):
    """The features of a pipeline's stage, with the vocabulary that it has fitted."""
    rows = queries_b._suppliers(t)
    out = estimators.EntityFeatures(scaled=False).fit(rows).transform(rows)
    names = ["asn", "asrank_rank", "asrank_degree_total", "asrank_cone_density", "asrank_peer_customer_ratio", "asrank_cone_size_log", "aspop_customer_cone_asns", "aspop_rir_ripe"]
    return queries_b._rounded(out.select(*names), "asrank_cone_density", "asrank_peer_customer_ratio", "asrank_cone_size_log")


_SCORED = f"select vec_id, vec_id % 2 as ta, case when vec_id % 3 = 0 then 1 else 0 end as tb, a, b, ax, ay, 0.4 * a + 0.6 * ax as va, 0.4 * b + 0.6 * ay as vb from (select {_S} from embeddings)"


@query(" union all ".join(f"""select '{m}' as model, '{y}' as label, count(*) filter ({p} > 0.5 and {y2} = 1) as tp, count(*) filter ({p} > 0.5 and {y2} = 0) as fp, count(*) filter ({p} <= 0.5 and {y2} = 1) as fn,
    round(coalesce(2.0 * count(*) filter ({p} > 0.5 and {y2} = 1) / nullif(count(*) filter ({p} > 0.5) + count(*) filter ({y2} = 1), 0), 0), 6) as f1 from ({_SCORED})"""
    for m, pa, pb in (("svm", "a", "b"), ("llm", "ax", "ay"), ("both", "va", "vb")) for y, p, y2 in (("A", pa, "ta"), ("B", pb, "tb"))))
def vote_scores(t):
    """Metrics of each model alone and of their vote, by label."""
    vec = F.col("vec_id")
    truth = t("embeddings").select("vec_id", (vec % 2).cast("int").alias("A"), (vec % 3 == 0).cast("int").alias("B"))
    frames = {"svm": _part(t, "AB", (7, 13))(), "llm": _part(t, "AB", (31, 37))()}
    out = None
    for name, own in (("svm", {"svm": frames["svm"]}), ("llm", {"llm": frames["llm"]}), ("both", frames)):
        marks = models.vote(own, "vec_id", ["A", "B"]).select("vec_id", *[(F.col(c) > models.THRESHOLD).cast("int").alias(c) for c in "AB"])
        one = evaluate.label_metrics(truth, marks, "vec_id", ["A", "B"]).select(F.lit(name).alias("model"), "label", "tp", "fp", "fn", F.round("f1", 6).alias("f1"))
        out = one if out is None else out.unionByName(one)
    return out


@query("select o_orderkey, case when o_totalprice > 150000 or o_orderkey % 7 = 0 then 1 else 0 end as t_y, case when o_totalprice > 150000 then 1.0 else 0.0 end as s_y from orders", doubles=("s_y",))
def nested_search(t):
    """Nested search: each key's score by the configuration that was found best without its fold."""
    rows = t("orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("price"), ((F.col("o_totalprice") > 150_000) | (F.col("o_orderkey") % 7 == 0)).cast("int").alias("y"))
    out, _, _ = models.nested(rows, "o_orderkey", "y", ["price"], [{"over": v} for v in (100_000.0, 150_000.0)], outer=2, inner=2, make=Above)
    return out.select("o_orderkey", "t_y", "s_y")


@query("""select l.doc_id, true as same, true as between from labels l join documents d on l.doc_id = d.doc_id""")
def loaded_machine(t):
    """Probabilities of a saved and loaded kernel machine beside those of the fitted one."""
    rows = _margin_rows(t).select("doc_id", "a", "b", "goal")
    own, path = machines.KernelMachines("doc_id", ["a", "b"], ["goal"], c=1.0, gamma=2.0).fit(rows), scratch(_spark(t), "svm-saved")
    own.save(path)
    again = machines.KernelMachines.load(path).predict(rows).select(F.col("doc_id").alias("_id"), F.col("goal").alias("_goal"))
    met = own.predict(rows).join(again, F.col("doc_id") == F.col("_id"))
    return met.select("doc_id", (F.abs(F.col("goal") - F.col("_goal")) < 1e-9).alias("same"), F.col("goal").between(0.0, 1.0).alias("between"))


@query("select 3 as batches, count(*) as rows, true as timed from events")
def stream_batches(t):
    """Batches of a stream over all events, as a listener has seen them: a file is a batch."""
    spark = _spark(t)
    place, out, check = (scratch(spark, n) for n in ("stream-in", "stream-out", "stream-check"))
    t("events").select("event_id", "event_type").repartition(3).write.parquet(place)
    with monitoring.StreamMonitor()(spark) as live:
        one = scoring.scored_stream(scoring.stream_of(spark, place, "event_id long, event_type string"), lambda b: b, out, check)
        one.awaitTermination()
        live.waited(one)
        return live.frame(spark).filter("rows > 0").agg(F.count("*").alias("batches"), F.sum("rows").alias("rows"), (F.min("seconds") > 0).alias("timed"))

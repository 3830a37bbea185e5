"""python -m netquarry COMMAND: data and model jobs from the command line."""

from __future__ import annotations

import argparse
import json
import sys
import time
from datetime import date

from pyspark.sql import functions as F

from netquarry import schemas
from netquarry.operators import chat, kernel_svm, labels, models, monitor, quality
from netquarry.operators import evaluate as measures
from netquarry.plans import approaches, jobs, two_stage
from netquarry.session import session, write_text
from netquarry.sources import paged, readers, remote, sinks


def _countries(spark, path):
    return schemas.load_registry(spark, path)[0] if path else spark.createDataFrame([], "code string")


def process(a, spark) -> int:
    """Process and validate the sources of a folder."""
    passed = jobs.process_all(spark, a.input, a.output, _countries(spark, a.registry))
    for name, ok in passed.items():
        print(f"{name}: {'passed' if ok else 'failed'}")
    return int(not all(passed.values()))


def status(a, spark) -> int:
    """Records of each source."""
    found = jobs.newest_sources(spark, a.input)
    for name in jobs.PATTERNS:
        print(f"{name}: {found[name].count() if name in found else 'none'}")
    return 0


def evaluate(a, spark) -> int:
    """Score predictions against labels."""
    read = lambda p: readers.read_labels(spark, p) if p.endswith(".csv") else spark.read.parquet(p)
    columns = list(schemas.TOP) if a.level == "toplevel" else schemas.sub_columns()
    summary, by_label = jobs.scored(read(a.labels), read(a.predictions), columns)
    print(sinks.metrics_text(summary, by_label), end="")
    if a.output:
        jobs.summary_json(a.output, summary, by_label)
    return 0


def prepare(a, spark) -> int:
    """Chat examples of labelled entities."""
    marks = readers.read_labels(spark, a.labels)
    rows = chat.examples(marks, readers.read_entities(spark, a.entities), "asn", [c for c in schemas.TOP if c in marks.columns], a.prompt)
    jobs.training_files(rows, a.output, "asn")
    return 0


def train(a, spark) -> int:
    """Fit a model for each label column over the numeric features."""
    marks, features = readers.read_labels(spark, a.labels), spark.read.parquet(a.features)
    columns = [c for c, k in features.dtypes if c != "asn" and k in ("double", "float", "int", "bigint")]
    own = [c for c in schemas.TOP if c in marks.columns]
    (kernel_svm.KernelMachines if a.machine == "kernel" else models.LabelModels)("asn", columns, own, c=a.c).fit(features.join(marks.select("asn", *own), "asn")).save(a.output)
    return 0


def _model(path):
    """A saved model, of whichever kind its specification tells."""
    spec = _spec(path)
    return (kernel_svm.KernelMachines if "part" in spec else models.LabelModels).load(path)


def _spec(path) -> dict:
    return json.loads(session().read.text(f"{path}/spec").first()["value"])


def predict(a, spark) -> int:
    """Tags and confidences by an approach, of a saved model or of tables of scores."""
    taxonomy = approaches.Taxonomy.of_file(a.taxonomy) if a.taxonomy else None
    inputs = {}
    if a.model:
        scores = _model(a.model).predict(spark.read.parquet(a.features))
        inputs["scores"] = lambda: scores
        taxonomy = taxonomy or approaches.Taxonomy([c for c in scores.columns if c != "asn"])
    for pair in (a.inputs or "").split(","):
        if pair:
            name, _, path = pair.partition("=")
            inputs[name] = lambda path=path: _table(spark, path)
    request = approaches.Request(inputs, taxonomy or approaches.Taxonomy.builtin(), threshold=a.threshold)
    out = approaches.predicted(a.approach, request)
    sinks.write_as(out.withColumn("tags", F.array_join("tags", ",")).withColumn("confidence_scores", F.to_json("confidence_scores")), a.output, [a.format])
    return 0


def benchmark(a, spark) -> int:
    """Seconds and rows a second of a model at several sample sizes."""
    features = spark.read.parquet(a.features)
    m = models.LabelModels.load(a.model)
    for n in a.sizes:
        start = time.perf_counter()
        m.predict(features.limit(n)).write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - start
        print(f"{n} rows: {took:.2f} s, {n / took:.0f} a second")
    return 0


def _table(spark, path):
    return spark.read.option("header", True).option("inferSchema", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)


def _classified(a, spark, who):
    """Both stages over the entities, by the score tables of the votes (name=path,...) and the answers of the second stage."""
    votes = {name: _table(spark, path) for name, path in (x.split("=", 1) for x in a.votes.split(","))}
    own = [c for c in schemas.TOP if any(c in v.columns for v in votes.values())]
    votes = {m: labels.ensured(v, own) for m, v in votes.items()}
    subs = _table(spark, a.subs) if a.subs else spark.createDataFrame([], "asn long, category string, subcategory string, confidence double")
    weights = {m: models.VOTE.get(m, 1.0) for m in votes}
    return two_stage.classify(who, votes, own, subs, schemas.categories(spark, extra=True), weights=weights)


def classify_single(a, spark) -> int:
    """Both stages for one entity, as JSON or text."""
    start = time.perf_counter()
    who = spark.createDataFrame([(a.asn, a.organization)], "asn long, organization_name string")
    r = _classified(a, spark, who).first().asDict(recursive=True)
    if a.timing:
        r["processing_time"] = time.perf_counter() - start
    if a.format == "json":
        print(json.dumps(r, indent=2))
    else:
        print("\n".join([f"{r['asn']} {r['organization_name']}: {r['overall_confidence']:.4f}", *(f"  {s['category']} {s['confidence']:.4f}" for s in r["stage1"]), *(f"    {s['category']}:{s['subcategory']} {s['confidence']:.4f}" for s in r["stage2"])]))
    return 0


def classify_batch(a, spark) -> int:
    """Both stages for a file of entities, saved flat, with a summary."""
    who = readers.read_entities(spark, a.input).select("asn", F.col("name").alias("organization_name"))
    out = _classified(a, spark, who).persist()
    sinks.write_as(sinks.flat_predictions(out), a.output, [a.format])
    one = two_stage.batch_summary(out).first()
    print(f"{one['rows']} rows, mean confidence {one['mean_confidence'] or 0.0:.4f}")
    out.unpersist()
    return 0


def evaluate_stages(a, spark) -> int:
    """Two-stage predictions against long labels, as a report."""
    def staged(path):
        rows = _table(spark, path)
        pair = F.struct(F.col("category").alias("cat"), F.col("subcategory").alias("sub"))
        return rows.groupBy("asn").agg(F.sort_array(F.collect_set("category")).alias("cats"), F.sort_array(F.collect_set(F.when(F.col("subcategory").isNotNull(), pair))).alias("subs"))

    met = measures.met_stages(staged(a.predictions), staged(a.labels), "asn").persist()
    names = [c for c in schemas.TOP if not met.filter(F.array_contains("t_cats", c) | F.array_contains("p_cats", c)).isEmpty()]
    stage1 = measures.rates(measures.confusion(measures.stage1_pairs(met, "asn", names), names))
    text = sinks.performance_report(stage1, measures.stage2_by_category(met, "asn"), measures.system_match(met), measures.errors_top(met))
    print(text, end="")
    if a.output:
        write_text(spark, a.output, text)
    met.unpersist()
    return 0


def benchmark_stages(a, spark) -> int:
    """Seconds and rows a second of both stages at several sizes."""
    who = readers.read_entities(spark, a.input).select("asn", F.col("name").alias("organization_name"))
    for n in a.sizes:
        start = time.perf_counter()
        _classified(a, spark, who.limit(n)).write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - start
        print(f"{n} rows: {took:.2f} s, {n / took:.0f} a second")
    return 0


def monitor_performance(a, spark) -> int:
    """Summary and advice of a table of calls (id, component, success, seconds, mb)."""
    calls = _table(spark, a.calls)
    summary = monitor.component_summary(calls, a.recent or None).persist()
    for r in summary.orderBy("component").collect():
        print(f"{r['component']}: {r['calls']} calls, {r['success_rate']:.1%}, {r['mean_s']:.3f} s")
    print("\n".join(monitor.advice(summary)))
    return 0


def download(a, spark) -> int:
    """A remote source, as a Parquet table or the file as it comes."""
    if a.source == "asrank":
        remote.ranking(spark, a.url).write.mode("overwrite").parquet(a.output)
    else:
        day, text = remote.dated(a.url, date.fromisoformat(a.date) if a.date else date.today(), today=date.today())
        remote.saved(spark, a.output, text)
        print(day)
    return 0


def download_info(a, spark) -> int:
    """A record for each key of a file, as JSON lines, and how many succeeded."""
    got = remote.info(readers.read_entities(spark, a.input).select("asn"), "asn", a.url, concurrency=a.concurrency).persist()
    sinks.write_lines(got.filter("error is null").select(F.concat(F.lit('{"key":"'), "asn", F.lit('","record":'), "body", F.lit("}")).alias("value")), a.output)
    print(paged.batch_metadata(got).first().asDict())
    return 0


def validate(a, spark) -> int:
    """Quality reports of the sources of a folder."""
    found = jobs.newest_sources(spark, a.input)
    reports = [jobs.report_of(name, df, _countries(spark, a.registry)) for name, df in found.items()]
    print(quality.report_text(reports), end="")
    return int(not all(r.first()["passed"] for r in reports))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="netquarry", description=__doc__)
    sub = p.add_subparsers(required=True)

    def command(f, *args: str, **options):
        c = sub.add_parser(f.__name__.replace("_", "-"), help=f.__doc__)
        for x in args:
            c.add_argument(f"--{x}", required=True)
        for k, v in options.items():
            c.add_argument(f"--{k}", **v)
        c.set_defaults(run=f)

    command(process, "input", "output", registry={})
    command(status, "input")
    command(evaluate, "labels", "predictions", level={"default": "toplevel", "choices": ["toplevel", "sublevel"]}, output={})
    command(prepare, "labels", "entities", "output", prompt={"default": "Classify the organization."})
    command(train, "labels", "features", "output", c={"type": float, "default": 1.0}, machine={"default": "random", "choices": ["random", "kernel"]})
    command(predict, "output", model={}, features={}, inputs={"help": "name=path,name=path"}, approach={"default": "flat", "choices": sorted(approaches.APPROACHES)}, taxonomy={}, threshold={"type": float, "default": models.THRESHOLD}, format={"default": "csv", "choices": ["csv", "json", "parquet"]})
    command(benchmark, "model", "features", sizes={"type": int, "nargs": "+", "default": [100, 1000]})
    stages = {"subs": {}, "votes": {"required": True, "help": "name=path,name=path"}}
    command(classify_single, asn={"type": int, "required": True}, organization={}, format={"default": "text", "choices": ["text", "json"]}, timing={"action": "store_true"}, **stages)
    command(classify_batch, "input", "output", format={"default": "csv", "choices": ["csv", "json", "parquet"]}, **stages)
    command(evaluate_stages, "predictions", "labels", output={})
    command(benchmark_stages, "input", sizes={"type": int, "nargs": "+", "default": [100, 1000]}, **stages)
    command(monitor_performance, "calls", recent={"type": int, "default": 0})
    command(download, "url", "output", source={"required": True, "choices": ["asrank", "peeringdb", "aspop"]}, date={})
    command(download_info, "input", "url", "output", concurrency={"type": int, "default": 5})
    command(validate, "input", registry={})
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        return a.run(a, session())
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())

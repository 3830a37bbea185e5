"""Writers. Tables go out in parallel; only reports of a few rows are made on the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.session import read_text, write_text
from netquarry.sources import workbook


def write_both(df: DataFrame, base: str) -> None:
    """Parquet and CSV from one evaluation."""
    df = df.persist()
    try:
        df.write.mode("overwrite").parquet(f"{base}.parquet")
        df.write.mode("overwrite").option("header", True).csv(f"{base}.csv")
    finally:
        df.unpersist()


def write_as(df: DataFrame, base: str, formats: list[str]) -> list[str]:
    """The formats written; unknown ones are skipped. Excel is a workbook with a sheet for each partition; json is lines, json_by_index one object of columns by row number for tables of a report's size."""
    done = []
    for f in formats:
        if f in ("parquet", "csv", "json", "orc"):
            df.write.mode("overwrite").options(header="true").format(f).save(f"{base}.{f}")
            done.append(f)
        elif f in ("excel", "xlsx"):
            workbook.write(df, f"{base}.xlsx")
            done.append(f)
        elif f == "json_by_index":
            write_text(df.sparkSession, f"{base}.json", by_index(df))
            done.append(f)
    return done


def by_index(df: DataFrame, most: int = 100_000) -> str:
    """An object of column to {row number: value}; RuntimeError beyond `most` rows, which belong in lines."""
    rows = df.limit(most + 1).toJSON().collect()
    if len(rows) > most:
        raise RuntimeError(f"over {most} rows; write lines")
    found = [json.loads(r) for r in rows]
    return json.dumps({c: {str(k): r.get(c) for k, r in enumerate(found)} for c in df.columns}, ensure_ascii=False)


def write_lines(df: DataFrame, path: str, column: str = "value") -> None:
    """One text a line, such as JSON lines."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_keyed(df: DataFrame, path: str, key: str = "asn") -> None:
    """Lines {key, record} of a keyed table; null fields are left out."""
    write_lines(df.filter(F.col(key).isNotNull()).select(F.to_json(F.struct(F.col(key).cast("string").alias("key"), F.struct(*df.columns).alias("record"))).alias("value")), path)


def flat_predictions(df: DataFrame, key: str = "asn") -> DataFrame:
    """Two-stage predictions as text: categories and confidences joined by |, subs as category:sub."""
    text = lambda c, f: F.array_join(F.transform(c, f), "|")
    return df.select(
        key, "organization_name", text("stage1", lambda s: s["category"]).alias("stage1_categories"), text("stage1", lambda s: F.format_number(s["confidence"], 4)).alias("stage1_confidences"),
        text("stage2", lambda s: F.concat_ws(":", s["category"], s["subcategory"])).alias("stage2_subcategories"), "overall_confidence",
    )


def metadata(tables: dict[str, DataFrame]) -> dict:
    """Rows and columns of each table."""
    return {name: {"rows": df.count(), "columns": df.columns} for name, df in tables.items()}


def merge_metadata(path: str, found: dict) -> dict:
    """found merged into the metadata file."""
    spark = SparkSession.getActiveSession()
    whole = {**json.loads(read_text(spark, path) or "{}"), **found}
    write_text(spark, path, json.dumps(whole, indent=2))
    return whole


def metrics_text(summary: DataFrame, by_label: DataFrame) -> str:
    """A summary as 'name: value' lines, and the labels' metrics as a table, least precise first."""
    one = summary.first().asDict()
    rows = by_label.orderBy("precision", "label").collect()
    head = ("label", "accuracy", "precision", "recall", "f1", "jaccard")
    lines = ["=" * 20, *[f"{k}: {v}" for k, v in one.items()], "=" * 20, "  ".join(head)]
    return "\n".join(lines + ["  ".join([r["label"], *(f"{r[c]:.4f}" for c in head[1:])]) for r in rows]) + "\n"


def performance_report(stage1: DataFrame, stage2: DataFrame, system: DataFrame, errors: DataFrame) -> str:
    """Plain text: the stages' scores, the five best categories and the first five errors."""
    s = system.first()
    out = ["TWO-STAGE PERFORMANCE", f"exact {s['exact']:.4f}, partial {s['partial']:.4f} of {s['rows']} rows", "", "BEST CATEGORIES"]
    out += [f"{r['label']}: f1 {r['f1']:.4f}" for r in stage1.orderBy(F.desc("f1"), "label").limit(5).collect()]
    out += ["", "SUBCATEGORIES"] + [f"{r['category']}: jaccard {r['jaccard']:.4f}, coverage {r['coverage']:.4f}" for r in stage2.orderBy("category").collect()]
    return "\n".join([*out, "", "ERRORS", *[f"{r['error']}: {r['n']}" for r in errors.limit(5).collect()]]) + "\n"

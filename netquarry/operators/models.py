"""Classifiers by label: kernel machines by random features, hierarchies, stacks, votes, and two stages.

Anything with predict(DataFrame) -> DataFrame of (key, a score for each label) can
take the place of a model, a remote one included.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.functions import exprs as X
from netquarry.operators import split
from netquarry.session import scratch

#: Weights of the vote, of the stages' confidences, the vote's threshold (to be passed), and the confidences of fallbacks.
VOTE = {"svm": 0.4, "llm": 0.6}
STAGES = (0.6, 0.4)
THRESHOLD = 0.5
SUB_CONFIDENCE, FALLBACK, LAST_FALLBACK = 0.8, 0.1, 0.05
#: Bytes of features in a partition that a model is fitted on, where there are more partitions than cores.
FITTED = 64 << 20


def gathered(df: DataFrame, n: int, width: int) -> DataFrame:
    """df, of n rows with so many numbers each, in a partition for each core, or as many as FITTED asks for: each round of a fit sends some kilobytes from each partition to the driver, however few rows are in it."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(8 * n * width / FITTED)))


@dataclass
class RandomFeatures:
    """Random Fourier features of the radial kernel exp(-gamma |x - y|^2)."""

    columns: list[str]
    gamma: float | None = None
    size: int = 256
    seed: int = 42

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        rng = np.random.default_rng(self.seed)
        gamma = self.gamma or 1 / len(self.columns)
        w = rng.normal(0, np.sqrt(2 * gamma), (len(self.columns), self.size))
        b = rng.uniform(0, 2 * np.pi, self.size)
        scale = np.sqrt(2 / self.size)

        @F.pandas_udf("array<double>")
        def project(x: pd.Series) -> pd.Series:
            return pd.Series(list(scale * np.cos(np.stack(x.to_numpy()) @ w + b))) if len(x) else pd.Series([], dtype=object)

        return df.withColumn(out, array_to_vector(project(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.columns]))))


@dataclass
class LabelModels:
    """One binary model for each label, over random features."""

    key: str
    columns: list[str]
    labels: list[str]
    c: float = 1.0
    gamma: float | None = None
    size: int = 256
    models: dict[str, LogisticRegressionModel | float] = field(default_factory=dict)

    def _features(self, df: DataFrame) -> DataFrame:
        return RandomFeatures(self.columns, self.gamma, self.size).transform(df)

    def fit(self, df: DataFrame) -> LabelModels:
        """A label with one value only is predicted as that."""
        n = df.count()
        data = gathered(self._features(df).select("features", *self.labels), n, self.size).persist()
        try:
            share = data.agg(*[F.avg((F.coalesce(F.col(y), F.lit(0)) > 0).cast("double")).alias(y) for y in self.labels]).first()
            for y in self.labels:
                rate = share[y] or 0.0
                fitted = data.select("features", (F.coalesce(F.col(y), F.lit(0)) > 0).cast("double").alias("label"))
                self.models[y] = rate if rate in (0.0, 1.0) else LogisticRegression(regParam=1 / (self.c * max(n, 1)), maxIter=50).fit(fitted)
        finally:
            data.unpersist()
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """(key, a probability for each label)."""
        out = self._features(df)
        for k, (y, m) in enumerate(self.models.items()):
            if isinstance(m, float):
                out = out.withColumn(f"_s{k}", F.lit(m))
            else:
                m.setPredictionCol(f"_p{k}").setProbabilityCol(f"_q{k}").setRawPredictionCol(f"_r{k}")
                out = m.transform(out).withColumn(f"_s{k}", vector_to_array(f"_q{k}")[1]).drop(f"_p{k}", f"_q{k}", f"_r{k}")
        return out.select(self.key, *[F.col(f"_s{k}").alias(y) for k, y in enumerate(self.models)])

    def save(self, path: str) -> None:
        """Below a folder of any file system that Spark writes to."""
        spark = SparkSession.getActiveSession()
        spec = {"key": self.key, "columns": self.columns, "labels": self.labels, "c": self.c, "gamma": self.gamma, "size": self.size, "constant": {y: m for y, m in self.models.items() if isinstance(m, float)}}
        spark.createDataFrame([(json.dumps(spec),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/spec")
        for k, (_, m) in enumerate(self.models.items()):
            if not isinstance(m, float):
                m.write().overwrite().save(f"{path}/{k}")

    @classmethod
    def load(cls, path: str) -> LabelModels:
        spec = json.loads(SparkSession.getActiveSession().read.text(f"{path}/spec").first()["value"])
        constant = spec.pop("constant")
        own = cls(**spec)
        own.models = {y: constant[y] if y in constant else LogisticRegressionModel.load(f"{path}/{k}") for k, y in enumerate(own.labels)}
        return own


def gated(parents: DataFrame, children: DataFrame, key: str, of: dict[str, str], threshold: float = THRESHOLD) -> DataFrame:
    """Scores of parents and children: a child's counts only where its parent passes the threshold; keys without children's scores have 0."""
    kids = [c for c in children.columns if c != key and c in of]
    met = parents.join(children.select(F.col(key).alias("_key"), *kids), F.col(key) == F.col("_key"), "left")
    return met.select(*parents.columns, *[F.when(F.col(of[c]) > threshold, X.nz(F.col(c))).otherwise(0.0).alias(c) for c in kids])


def combined(frames: list[DataFrame], key: str, keys: DataFrame) -> DataFrame:
    """The greatest of all frames' scores of a label, for each of the keys; 0 where none has any."""
    labels = list(dict.fromkeys(c for f in frames for c in f.columns if c != key))
    out = keys.select(key)
    for k, f in enumerate(frames):
        out = out.join(f.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{k}_{c}") for c in f.columns if c != key]), F.col(key) == F.col("_key"), "left").drop("_key")
    have = lambda c: [X.nz(F.col(f"_{k}_{c}")) for k, f in enumerate(frames) if c in f.columns]
    return out.select(key, *[(F.greatest(*h) if len(h := have(c)) > 1 else h[0]).alias(c) for c in labels])


def vote(frames: dict[str, DataFrame], key: str, labels: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """The weighted mean of the models that there are, for the keys of any of them; their weights are normalised, a key that a model lacks has 0 from it."""
    weights = weights or VOTE
    used = {m: f for m, f in frames.items() if f is not None}
    if not used:
        raise ValueError("no model to vote")
    total = sum(weights[m] for m in used)
    each = [f.select(key, *[F.col(c).alias(f"{m}_{c}") for c in labels]) for m, f in used.items()]
    out = reduce(lambda a, b: a.join(b, key, "full"), each)
    return out.select(key, *[(sum((F.lit(weights[m] / total) * X.nz(F.col(f"{m}_{c}")) for m in used), F.lit(0.0))).alias(c) for c in labels])


def chosen(scores: Column, labels: list[str], threshold: float = THRESHOLD) -> Column:
    """Structs (category, confidence) of the scores over the threshold, else the first greatest one. scores: an array in the order of labels."""
    names = F.array(*map(F.lit, labels))
    pairs = F.zip_with(names, scores, lambda n, s: F.struct(n.alias("category"), s.alias("confidence")))
    over = F.filter(pairs, lambda p: p["confidence"] > threshold)
    return F.when(F.size(over) > 0, over).otherwise(F.array(F.get(pairs, F.array_position(scores, F.array_max(scores)).cast("int") - 1)))


def overall_confidence(stage1: Column, stage2: Column, weights: tuple[float, float] = STAGES) -> Column:
    """Of arrays of confidences: the weighted means, within 0 and 1; the first stage's alone without a second, 0 without a first."""
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    both = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(weights[0]) * mean(stage1) + F.lit(weights[1]) * mean(stage2)))
    return F.when(F.coalesce(F.size(stage1), F.lit(0)) <= 0, 0.0).when(F.coalesce(F.size(stage2), F.lit(0)) <= 0, mean(stage1)).otherwise(both)


def with_subcategories(stage1: DataFrame, predicted: DataFrame, key: str, valid: DataFrame) -> DataFrame:
    """(key, category, subcategory, confidence) of stage 2. predicted: (key, category, subcategory, confidence?) for the categories of stage 1; invalid subs go; a category with subs but no valid answer gets its first one at FALLBACK."""
    asked = stage1.select(key, F.explode("stage1.category").alias("category")).distinct()
    subs = valid.filter("subcategory is not null")
    ok = predicted.join(F.broadcast(subs.select(F.col("category").alias("_c"), F.col("subcategory").alias("_s"))), (F.col("category") == F.col("_c")) & (F.col("subcategory") == F.col("_s")), "left_semi")
    ok = ok.join(asked, [key, "category"], "left_semi").select(key, "category", "subcategory", F.coalesce("confidence", F.lit(SUB_CONFIDENCE)).alias("confidence"))
    firsts = subs.groupBy("category").agg(F.min_by("subcategory", "ord").alias("subcategory"))
    rest = asked.join(ok, [key, "category"], "left_anti").join(F.broadcast(firsts), "category").select(key, "category", "subcategory", F.lit(FALLBACK).alias("confidence"))
    return ok.unionByName(rest)


def stacked(df: DataFrame, key: str, labels: list[str], bases: dict[str, Callable[[DataFrame], object]], folds: int = 3, parallelism: int = 4) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(out-of-fold scores, predict): base models are fitted without each fold by key, their scores of it are the meta model's features; the bases are then fitted on all rows."""
    fold = split.group_kfold(df, key, folds)
    with_fold = df.join(fold, key).persist()

    def fitted(job: tuple[str, int | None]):
        m, k = job
        return bases[m](df if k is None else with_fold.filter(F.col("fold") != k))

    try:
        with ThreadPoolExecutor(parallelism) as pool:  # fits are many small jobs, which leave room for each other
            jobs = [(m, k) for m in bases for k in (*range(folds), None)]
            done = dict(zip(jobs, pool.map(fitted, jobs), strict=True))
        parts = [_scores({m: done[m, k].predict(with_fold.filter(F.col("fold") == k)) for m in bases}, key, labels) for k in range(folds)]
        oof = reduce(DataFrame.unionByName, parts).join(df.select(F.col(key).alias("_key"), *labels), F.col(key) == F.col("_key")).drop("_key")
        path = scratch(df.sparkSession, "out-of-fold")
        oof.write.parquet(path)
        oof = df.sparkSession.read.schema(oof.schema).parquet(path)
        names = {y: [f"{m}__{y}" for m in bases] for y in labels}
        metas = {y: LabelModelsLinear(key, names[y], y).fit(oof) for y in labels}
        full = {m: done[m, None] for m in bases}
    finally:
        with_fold.unpersist()

    def predict(rows: DataFrame) -> DataFrame:
        scores = _scores({m: f.predict(rows) for m, f in full.items()}, key, labels)
        return reduce(lambda d, y: metas[y].transform(d), labels, scores).select(key, *labels)

    return oof, predict


def _scores(frames: dict[str, DataFrame], key: str, labels: list[str]) -> DataFrame:
    each = [f.select(F.col(key), *[F.col(y).alias(f"{m}__{y}") for y in labels]) for m, f in frames.items()]
    return reduce(lambda a, b: a.join(b, key), each)


@dataclass
class LabelModelsLinear:
    """The meta model of one label."""

    key: str
    columns: list[str]
    label: str
    model: LogisticRegressionModel | None = None

    def _vector(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_v", array_to_vector(F.array(*self.columns)))

    def fit(self, df: DataFrame) -> LabelModelsLinear:
        rows = gathered(df, df.count(), len(self.columns))
        self.model = LogisticRegression(featuresCol="_v", labelCol="_y", maxIter=50, regParam=1e-3).fit(self._vector(rows).withColumn("_y", (F.col(self.label) > 0).cast("double")))
        self.model.setPredictionCol("_p").setProbabilityCol("_q").setRawPredictionCol("_r")
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self._vector(df)).withColumn(self.label, vector_to_array("_q")[1]).drop("_v", "_p", "_q", "_r")

    def importance(self) -> dict[str, float]:
        """Mean absolute coefficient of each component."""
        return dict(zip(self.columns, map(abs, self.model.coefficients.toArray().tolist()), strict=True))


def micro_jaccard(pairs: DataFrame, labels: list[str]) -> float:
    """Of all cells of all labels together; 0 without any positive."""
    from netquarry.operators import evaluate

    c = evaluate.confusion(pairs, labels).agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")]).first()
    whole = (c["tp"] or 0) + (c["fp"] or 0) + (c["fn"] or 0)
    return c["tp"] / whole if whole else 0.0


def _labels(label: str | list[str]) -> list[str]:
    return [label] if isinstance(label, str) else list(label)


def searched(df: DataFrame, key: str, label: str | list[str], columns: list[str], grid: list[dict], folds: int = 5, make: Callable[..., object] | None = None) -> tuple[dict, list[tuple[dict, float]]]:
    """(best, all with their mean micro Jaccard): parameters of `make`, which is LabelModels or gives anything with fit and predict, by stratified folds of the key."""
    from netquarry.operators import evaluate

    own = _labels(label)
    rows = df.join(split.multilabel_kfold(df, key, own, folds), key).persist()
    scores = []
    try:
        for params in grid:
            met = []
            for k in range(folds):
                test = rows.filter(F.col("fold") == k)
                pred = (make or LabelModels)(key, columns, own, **params).fit(rows.filter(F.col("fold") != k)).predict(test)
                marks = pred.select(key, *[(F.col(y) > THRESHOLD).cast("int").alias(y) for y in own])
                met.append(micro_jaccard(evaluate.paired(test, marks, key, own), own))
            scores.append((params, float(np.mean(met))))
    finally:
        rows.unpersist()
    return max(scores, key=lambda s: s[1])[0], scores


def nested(df: DataFrame, key: str, label: str | list[str], columns: list[str], grid: list[dict], outer: int = 3, inner: int = 5, make: Callable[..., object] | None = None) -> tuple[DataFrame, DataFrame, list[dict]]:
    """(out-of-fold rows, label counts, best parameters): (key, fold, t_ and s_ of each label), (fold, part, label, n), and what was found within each outer fold's training rows."""
    own = _labels(label)
    rows = df.join(split.multilabel_kfold(df, key, own, outer), key).persist()
    parts, found = [], []
    for k in range(outer):
        train, test = rows.filter(F.col("fold") != k).drop("fold"), rows.filter(F.col("fold") == k).drop("fold")
        best, _ = searched(train, key, own, columns, grid, inner, make)
        found.append(best)
        scores = (make or LabelModels)(key, columns, own, **best).fit(train).predict(test).select(F.col(key).alias("_key"), *[F.col(y).alias(f"s_{y}") for y in own])
        met = test.select(key, *[F.coalesce(F.col(y), F.lit(0)).cast("int").alias(f"t_{y}") for y in own]).join(scores, F.col(key) == F.col("_key"))
        parts.append(met.select(key, F.lit(k).alias("fold"), *[f"{x}_{y}" for y in own for x in "ts"]))
    return reduce(DataFrame.unionByName, parts), split.fold_label_counts(rows, own, outer), found

"""Features and label classifiers as stages of pyspark.ml pipelines, with Params, copies and persistence.

Stages keep their settings as Params, so that a ParamGridBuilder can set them, and write
and read themselves below a folder of any file system that Spark knows, alone or as
parts of a Pipeline. Anything with fit(DataFrame) and predict(DataFrame) -> (key, a score
for each label) can stand in the classifier's place: `make` gives it. One that is to be
saved has save(path) and a class method load(path), as `models.LabelModels` and
`kernel_svm.KernelMachines` have; others raise a TypeError when they are saved.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable

from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.operators import evaluate, features, models
from netquarry.session import read_text, write_text


class HasKey(Params):
    key = Param(Params._dummy(), "key", "name of the column that tells entities apart", typeConverter=TypeConverters.toString)

    def getKey(self) -> str:
        return self.getOrDefault(self.key)


class HasLabels(HasKey):
    labels = Param(Params._dummy(), "labels", "names of the label columns", typeConverter=TypeConverters.toListString)
    threshold = Param(Params._dummy(), "threshold", "score over which an entity has a label", typeConverter=TypeConverters.toFloat)

    def getLabels(self) -> list[str]:
        return self.getOrDefault(self.labels)

    def getThreshold(self) -> float:
        return self.getOrDefault(self.threshold)


class _StateWriter(MLWriter):
    """Params by Spark's own format, and what a stage has learnt beside them."""

    def __init__(self, stage):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        spark = self.sparkSession
        DefaultParamsWriter.saveMetadata(self.stage, path, spark)
        self.stage._save_state(spark, f"{path}/state")


class _StateReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        own = self.cls._load_state(spark, f"{path}/state")
        own._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(own, metadata)
        return own


class _Stateful(MLWritable, MLReadable):
    """A stage that writes what it has learnt by _save_state and reads it by _load_state."""

    def write(self) -> MLWriter:
        return _StateWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _StateReader(cls)


def _name_of(thing) -> str:
    return f"{thing.__module__}:{thing.__qualname__}"


def _thing_of(name: str):
    module, _, path = name.partition(":")
    out = importlib.import_module(module)
    for part in path.split("."):
        out = getattr(out, part)
    return out


class EntityFeatures(Estimator, HasKey, DefaultParamsReadable, DefaultParamsWritable):
    """Fits the vocabulary of the one-hot fields and, if asked to, the scales of all features."""

    scaled = Param(Params._dummy(), "scaled", "whether features are scaled", typeConverter=TypeConverters.toBoolean)

    def __init__(self, key: str = "asn", scaled: bool = True):
        super().__init__()
        self._setDefault(key="asn", scaled=True)
        self._set(key=key, scaled=scaled)

    def _fit(self, dataset: DataFrame) -> EntityFeaturesModel:
        key = self.getKey()
        vocab = features.vocabulary(dataset)
        rows = features.features(dataset, vocab, key)
        columns = [c for c in rows.columns if c != key]
        return EntityFeaturesModel(key, vocab, columns, features.Scaler.fit(rows, columns) if self.getOrDefault(self.scaled) else None)


class EntityFeaturesModel(Model, HasKey, _Stateful):
    """Entities with structs of their sources to a row of features for each."""

    def __init__(self, key: str, vocab: dict[str, list[str]], columns: list[str], scaler: features.Scaler | None):
        super().__init__()
        self._setDefault(key="asn")
        self._set(key=key)
        self.vocab, self.columns, self.scaler = vocab, columns, scaler

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rows = features.features(dataset, self.vocab, self.getKey())
        return self.scaler.transform(rows) if self.scaler else rows

    def _save_state(self, spark, path: str) -> None:
        scaler = {"means": self.scaler.means, "scales": self.scaler.scales} if self.scaler else None
        write_text(spark, path, json.dumps({"vocab": self.vocab, "columns": self.columns, "scaler": scaler}))

    @classmethod
    def _load_state(cls, spark, path: str) -> EntityFeaturesModel:
        found = json.loads(read_text(spark, path))
        return cls("asn", found["vocab"], found["columns"], features.Scaler(**found["scaler"]) if found["scaler"] else None)


class LabelClassifier(Estimator, HasLabels, _Stateful):
    """Fits a model of several labels over the numeric columns of a table. `options` are those of `make`, by name."""

    columns = Param(Params._dummy(), "columns", "feature columns; all other numbers if there are none", typeConverter=TypeConverters.toListString)
    options = Param(Params._dummy(), "options", "options of the model, by name")

    def __init__(self, labels: list[str], key: str = "asn", columns: list[str] | None = None, make: Callable[..., object] | None = None, threshold: float = models.THRESHOLD, **options):
        super().__init__()
        self._setDefault(key="asn", threshold=models.THRESHOLD, columns=[], options={})
        self._set(labels=labels, key=key, columns=columns or [], threshold=threshold, options=options)
        self.make = make or models.LabelModels

    def _fit(self, dataset: DataFrame) -> LabelClassifierModel:
        numbers, key, labels = ("double", "float", "int", "bigint", "smallint", "tinyint"), self.getKey(), self.getLabels()
        columns = self.getOrDefault(self.columns) or [c for c, k in dataset.dtypes if k in numbers and c != key and c not in labels]
        missing = [c for c in (key, *columns, *labels) if c not in dataset.columns]
        if missing:
            raise ValueError(f"no columns {missing}")
        return LabelClassifierModel(self.make(key, columns, labels, **self.getOrDefault(self.options)).fit(dataset), key, labels, self.getThreshold())

    def _save_state(self, spark, path: str) -> None:
        write_text(spark, path, _name_of(self.make))

    @classmethod
    def _load_state(cls, spark, path: str) -> LabelClassifier:
        return cls([], make=_thing_of(read_text(spark, path).strip()))


class LabelClassifierModel(Model, HasLabels, _Stateful):
    """Adds to a table a score for each label (score_<label>) and the tags over the threshold."""

    def __init__(self, model, key: str, labels: list[str], threshold: float):
        super().__init__()
        self._setDefault(key="asn", threshold=models.THRESHOLD)
        self._set(key=key, labels=labels, threshold=threshold)
        self.model = model

    def predict_proba(self, dataset: DataFrame) -> DataFrame:
        """(key, a score for each label)."""
        return self.model.predict(dataset)

    def predict(self, dataset: DataFrame) -> DataFrame:
        """(key, 0 or 1 for each label)."""
        return self.predict_proba(dataset).select(self.getKey(), *[(F.col(y) > self.getThreshold()).cast("int").alias(y) for y in self.getLabels()])

    def score(self, dataset: DataFrame) -> float:
        """Macro F1 against the labels of a table."""
        return evaluate.summary(evaluate.paired(dataset, self.predict(dataset), self.getKey(), self.getLabels()), self.getLabels()).first()["macro_f1"]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        key, labels = self.getKey(), self.getLabels()
        scores = self.predict_proba(dataset).select(F.col(key).alias("_scored"), *[F.col(y).alias(f"score_{y}") for y in labels])
        tags = F.array_compact(F.array(*[F.when(F.col(f"score_{y}") > self.getThreshold(), F.lit(y)) for y in labels]))
        return dataset.join(scores, F.col(key) == F.col("_scored"), "left").drop("_scored").withColumn("tags", F.coalesce(tags, F.array().cast("array<string>")))

    def _save_state(self, spark, path: str) -> None:
        if not hasattr(self.model, "save") or not hasattr(type(self.model), "load"):
            raise TypeError(f"{type(self.model).__name__} has no save and load")
        write_text(spark, f"{path}/kind", _name_of(type(self.model)))
        self.model.save(f"{path}/model")

    @classmethod
    def _load_state(cls, spark, path: str) -> LabelClassifierModel:
        return cls(_thing_of(read_text(spark, f"{path}/kind").strip()).load(f"{path}/model"), "asn", [], models.THRESHOLD)


class LabelEvaluator(Evaluator, HasLabels, DefaultParamsReadable, DefaultParamsWritable):
    """Macro F1 of the scores that a LabelClassifierModel has added to a table with its labels."""

    def __init__(self, labels: list[str] | None = None, key: str = "asn", threshold: float = models.THRESHOLD):
        super().__init__()
        self._setDefault(key="asn", threshold=models.THRESHOLD, labels=[])
        self._set(labels=labels or [], key=key, threshold=threshold)

    def _evaluate(self, dataset: DataFrame) -> float:
        key, labels = self.getKey(), self.getLabels()
        marks = dataset.select(key, *[(F.col(f"score_{y}") > self.getThreshold()).cast("int").alias(y) for y in labels])
        return evaluate.summary(evaluate.paired(dataset.select(key, *labels), marks, key, labels), labels).first()["macro_f1"]

    def isLargerBetter(self) -> bool:
        return True


class TableFunction(Transformer, _Stateful):
    """Any function of a table as a stage; one that is to be saved is a function of a module."""

    def __init__(self, f: Callable[[DataFrame], DataFrame]):
        super().__init__()
        self.f = f

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.f(dataset)

    def _save_state(self, spark, path: str) -> None:
        if "<" in self.f.__qualname__:
            raise TypeError("only functions of a module can be saved")
        write_text(spark, path, _name_of(self.f))

    @classmethod
    def _load_state(cls, spark, path: str) -> TableFunction:
        return cls(_thing_of(read_text(spark, path).strip()))

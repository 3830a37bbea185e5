"""Support vector machines with the radial kernel, fitted over any number of rows.

The dual problem is solved by sequential minimal optimisation: the pair of rows that
violates the optimum most, by the second-order rule, is improved until the gap of
the dual's conditions is below TOLERANCE. Kernel rows are kept in a cache of bounded
size. Rows are dealt to parts by a hash of their key; each part is solved by itself
and passes on its support vectors, and these are solved again, parts at a time, until
they are one part (a cascade). The machine is then held against all rows: those that
violate its conditions join its support vectors, and the two are solved again, until
no row of the table violates them, so that the result is the optimum over all rows
and not of the parts alone. Margins become probabilities by a sigmoid, fitted on rows
that a machine fitted without them scores.

Defined cases: null features count as 0, null labels as negative; a label with one
value only has that as its probability; rows that agree in all features are rows of
their own; rows of one key stay in one part; without rows every probability is 0. A
machine of more than `most` support vectors raises a RuntimeError: such data are too
noisy for a kernel machine, and `models.LabelModels` with random features takes them.
"""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from netquarry.operators.models import gathered
from netquarry.session import scratch

#: Gap of the dual's conditions at which a solution counts as optimal; slack of the check over all rows.
TOLERANCE = 1e-3
#: Rows of a part; support vectors of a machine at most; bytes of kernel rows that a task keeps; rounds of the check over all rows; bytes of the kernel that a task computes at a time for decision values.
PART, MOST, CACHE, ROUNDS, BLOCK = 2000, 20_000, 256 << 20, 30, 16 << 20
SV = "at long, x array<double>, y double, alpha double"


class Kernel:
    """Rows of the radial kernel, the last used ones kept."""

    def __init__(self, x: np.ndarray, gamma: float, cache: int = CACHE):
        self.x, self.gamma, self.norms = x, gamma, (x * x).sum(axis=1)
        self.kept: OrderedDict[int, np.ndarray] = OrderedDict()
        self.room = max(2, cache // (8 * max(1, len(x))))

    def row(self, k: int) -> np.ndarray:
        got = self.kept.pop(k, None)
        if got is None:
            got = np.exp(-self.gamma * np.maximum(self.norms + self.norms[k] - 2 * (self.x @ self.x[k]), 0))
            if len(self.kept) >= self.room:
                self.kept.popitem(last=False)
        self.kept[k] = got
        return got


def solve(x: np.ndarray, y: np.ndarray, c: float, gamma: float, tolerance: float = TOLERANCE, most: int = 10_000_000) -> tuple[np.ndarray, float, float]:
    """(alpha, bias, gap) of the dual: min 1/2 sum a_i a_j y_i y_j K_ij - sum a_i, 0 <= a <= c, sum a_i y_i = 0."""
    n, kernel = len(y), Kernel(x, gamma)
    alpha, grad = np.zeros(n), -np.ones(n)
    for _ in range(most):
        up = ((y > 0) & (alpha < c)) | ((y < 0) & (alpha > 0))
        low = ((y > 0) & (alpha > 0)) | ((y < 0) & (alpha < c))
        f = -y * grad
        if not up.any() or not low.any():
            break
        i = int(np.argmax(np.where(up, f, -np.inf)))
        lowest = np.where(low, f, np.inf)
        if f[i] - lowest.min() < tolerance:
            break
        ki = kernel.row(i)
        away = f[i] - lowest
        bend = np.maximum(2 - 2 * ki, 1e-12)  # the kernel of a row with itself is 1
        j = int(np.argmax(np.where(away > 0, away * away / bend, -np.inf)))
        kj = kernel.row(j)
        step = away[j] / bend[j]
        room_i = c - alpha[i] if y[i] > 0 else alpha[i]
        room_j = alpha[j] if y[j] > 0 else c - alpha[j]
        step = min(step, room_i, room_j)
        for k, sign in ((i, y[i]), (j, -y[j])):
            alpha[k] = min(c, max(0.0, alpha[k] + sign * step))
            if alpha[k] < 1e-12 * c:
                alpha[k] = 0.0
            elif alpha[k] > c * (1 - 1e-12):
                alpha[k] = c
        grad += y * (step * (ki - kj))
    f = -y * grad
    up = ((y > 0) & (alpha < c)) | ((y < 0) & (alpha > 0))
    low = ((y > 0) & (alpha > 0)) | ((y < 0) & (alpha < c))
    high, least = (f[up].max() if up.any() else f[low].min()), (f[low].min() if low.any() else f[up].max())
    return alpha, float((high + least) / 2), float(high - least)


def margins(x: np.ndarray, of: np.ndarray, weight: np.ndarray, bias: float, gamma: float) -> np.ndarray:
    """Decision values, BLOCK bytes of the kernel at a time, which are worked on in place."""
    out, norms = np.full(len(x), bias), (of * of).sum(axis=1)
    step = max(1, BLOCK // (8 * max(1, len(of))))
    for k in range(0, len(x) if len(of) else 0, step):
        part = x[k : k + step]
        kernel = (-2 * part) @ of.T
        kernel += (part * part).sum(axis=1)[:, None]
        kernel += norms
        np.maximum(kernel, 0, out=kernel)
        kernel *= -gamma
        out[k : k + step] += np.exp(kernel, out=kernel) @ weight
    return out


def _matrix(column, width: int) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in column]) if len(column) else np.zeros((0, width))


def _solver(c: float, gamma: float, width: int):
    """Rows of a part to its support vectors, sorted by key first, so that the order of rows doesn't matter."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at").reset_index(drop=True)
        alpha, _, _ = solve(_matrix(rows["x"], width), rows["y"].to_numpy(float), c, gamma)
        return rows.assign(alpha=alpha)[["at", "x", "y", "alpha"]][alpha > 0]

    return run


def _final(c: float, gamma: float, width: int):
    """All support vectors with their weights, and the bias in a row of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("at").reset_index(drop=True)
        if len(rows):
            alpha, bias, gap = solve(_matrix(rows["x"], width), rows["y"].to_numpy(float), c, gamma)
            yield rows.assign(alpha=alpha)[["at", "x", "y", "alpha"]][alpha > 0]
            yield pd.DataFrame({"at": pd.Series([-1], dtype="int64"), "x": [[bias, gap]], "y": [0.0], "alpha": [0.0]})

    return run


@dataclass
class Machine:
    """Support vectors, their weights (alpha y), the bias, and the gap of the dual."""

    x: np.ndarray
    weight: np.ndarray
    at: np.ndarray
    bias: float
    gap: float
    gamma: float

    def scored(self, rows: DataFrame, column: str = "x", out: str = "margin") -> DataFrame:
        """rows with the decision value of their features."""
        own = rows.sparkSession.sparkContext.broadcast((self.x, self.weight, self.bias, self.gamma))

        @F.pandas_udf(DoubleType())
        def margin(x: pd.Series) -> pd.Series:
            of, weight, bias, gamma = own.value
            return pd.Series(margins(_matrix(x, of.shape[1]), of, weight, bias, gamma))

        return rows.withColumn(out, margin(F.col(column)))


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _one_part(rows: DataFrame, c: float, gamma: float, width: int) -> Machine:
    """The machine of rows that one task holds."""
    got = rows.select("at", "x", "y").coalesce(1).mapInPandas(_final(c, gamma, width), SV).toPandas()
    own, last = got[got["at"] >= 0], got[got["at"] < 0].iloc[0]
    return Machine(_matrix(own["x"], width), (own["alpha"] * own["y"]).to_numpy(float), own["at"].to_numpy(np.int64), *map(float, last["x"]), gamma)


def fitted(rows: DataFrame, c: float, gamma: float, width: int, part: int = PART, most: int = MOST) -> Machine:
    """The optimum over all rows. rows: (at long from 0, once each; x array<double>; y 1 or -1), both signs there, written already."""
    left, n = rows.withColumn("alpha", F.lit(1.0)), rows.count()
    while n > part:
        parts = -(-n // part)
        dealt = left.withColumn("part", F.pmod(F.xxhash64("at", F.lit(n)), F.lit(parts)))
        solved = _kept(dealt.select("part", "at", "x", "y").groupBy("part").applyInPandas(_solver(c, gamma, width), SV), "svm-parts")
        now = solved.count()
        if now > 0.9 * n:  # the parts give up next to nothing: solve what is left at once
            left, n = solved, now
            break
        left, n = solved, now
    signs = left.select("y").distinct().count() if n else 0
    if n > most:
        raise RuntimeError(f"{n} support vectors; use random features")
    machine = _one_part(left if signs == 2 else rows.limit(0).unionByName(_some(rows)), c, gamma, width)
    for _ in range(ROUNDS):
        own = rows.sparkSession.createDataFrame(pa.table({"at": machine.at, "held": np.ones(len(machine.at), bool)}))
        wrong = machine.scored(rows).join(F.broadcast(own), "at", "left").filter("held is null").filter(F.col("y") * F.col("margin") < 1 - 2 * TOLERANCE)
        wrong = _kept(wrong.select("at", "x", "y"), "svm-violators")
        n = wrong.count()
        if not n:
            return machine
        if n + len(machine.at) > most:
            raise RuntimeError(f"{n + len(machine.at)} support vectors; use random features")
        held = rows.join(F.broadcast(own), "at", "left_semi").select("at", "x", "y")
        machine = _one_part(held.unionByName(wrong), c, gamma, width)
    raise RuntimeError(f"rows violate the optimum after {ROUNDS} rounds")


def _some(rows: DataFrame) -> DataFrame:
    """The first row of each sign, where the parts' solutions hold one sign only."""
    return rows.join(rows.groupBy("y").agg(F.min("at").alias("at")).select("at"), "at", "left_semi").select("at", "x", "y")


@dataclass
class KernelMachines:
    """One machine with probabilities for each label; fit and predict as `models.LabelModels` has them."""

    key: str
    columns: list[str]
    labels: list[str]
    c: float = 1.0
    gamma: float | None = None
    part: int = PART
    most: int = MOST
    models: dict[str, tuple[Machine, float, float] | float] = field(default_factory=dict)

    def _x(self):
        return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.columns]).alias("x")

    def rows(self, df: DataFrame) -> DataFrame:
        """(at, fold, key, x, and 1 or -1 for each label), written; at numbers the rows."""
        marks = [F.when(F.coalesce(F.col(y).cast("double"), F.lit(0.0)) > 0, 1.0).otherwise(-1.0).alias(f"y_{k}") for k, y in enumerate(self.labels)]
        own = df.select(F.col(self.key).alias("key"), F.pmod(F.xxhash64(self.key), F.lit(3)).alias("fold"), self._x(), *marks)
        return _kept(own.withColumn("at", F.monotonically_increasing_id()), "svm-rows")

    def fit(self, df: DataFrame) -> KernelMachines:
        rows, gamma, width = self.rows(df), self.gamma or 1 / len(self.columns), len(self.columns)
        for k, label in enumerate(self.labels):
            own = rows.select("at", "fold", "x", F.col(f"y_{k}").alias("y"))
            share = own.agg(F.avg((F.col("y") > 0).cast("double")).alias("s"), F.count_if((F.col("y") > 0) & (F.col("fold") > 0)).alias("p"), F.count_if((F.col("y") < 0) & (F.col("fold") > 0)).alias("q")).first()
            if share["s"] in (None, 0.0, 1.0):
                self.models[label] = share["s"] or 0.0
                continue
            slope, offset = -2.0, 0.0
            if share["p"] and share["q"]:
                part = fitted(own.filter("fold > 0").select("at", "x", "y"), self.c, gamma, width, self.part, self.most)
                slope, offset = sigmoid(part.scored(own.filter("fold = 0")).select("margin", "y"))
            self.models[label] = (fitted(own.select("at", "x", "y"), self.c, gamma, width, self.part, self.most), slope, offset)
        return self

    def margins(self, df: DataFrame) -> DataFrame:
        """(key, a decision value for each label that has a machine)."""
        out = df.select(F.col(self.key), self._x())
        for k, (_, m) in enumerate(self.models.items()):
            out = out.withColumn(f"_m{k}", F.lit(m)) if isinstance(m, float) else m[0].scored(out, "x", f"_m{k}")
        return out.select(self.key, *[F.col(f"_m{k}").alias(y) for k, y in enumerate(self.models)])

    def predict(self, df: DataFrame) -> DataFrame:
        """(key, a probability for each label)."""
        probability = lambda y, m: F.lit(m) if isinstance(m, float) else 1 / (1 + F.exp(F.lit(m[1]) * F.col(y) + F.lit(m[2])))
        return self.margins(df).select(self.key, *[probability(y, m).alias(y) for y, m in self.models.items()])

    def save(self, path: str) -> None:
        """Below a folder of any file system that Spark writes to."""
        spark = SparkSession.getActiveSession()
        spec = {k: getattr(self, k) for k in ("key", "columns", "labels", "c", "gamma", "part", "most")}
        spec["models"] = {y: m if isinstance(m, float) else {"bias": m[0].bias, "gap": m[0].gap, "gamma": m[0].gamma, "slope": m[1], "offset": m[2]} for y, m in self.models.items()}
        spark.createDataFrame([(json.dumps(spec),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/spec")
        for k, m in enumerate(self.models.values()):
            if not isinstance(m, float):
                vectors = pd.DataFrame({"at": m[0].at, "x": [v.tolist() for v in m[0].x], "weight": m[0].weight})
                spark.createDataFrame(vectors, "at long, x array<double>, weight double").write.mode("overwrite").parquet(f"{path}/{k}")

    @classmethod
    def load(cls, path: str) -> KernelMachines:
        spark = SparkSession.getActiveSession()
        spec = json.loads(spark.read.text(f"{path}/spec").first()["value"])
        found, own = spec.pop("models"), cls(**spec)
        for k, y in enumerate(own.labels):
            if isinstance(m := found[y], float):
                own.models[y] = m
                continue
            v = spark.read.parquet(f"{path}/{k}").orderBy("at").toPandas()
            own.models[y] = (Machine(_matrix(v["x"], len(own.columns)), v["weight"].to_numpy(float), v["at"].to_numpy(np.int64), m["bias"], m["gap"], m["gamma"]), m["slope"], m["offset"])
        return own


def sigmoid(scored: DataFrame) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(a margin + b)), fitted by likelihood; (-2, 0) where the rows have one sign only."""
    rows = scored.select(array_to_vector(F.array("margin")).alias("features"), (F.col("y") > 0).cast("double").alias("label"))
    signs = [r["count"] for r in rows.groupBy("label").count().collect()]
    if len(signs) < 2:
        return -2.0, 0.0
    m = LogisticRegression(maxIter=100, regParam=1e-6).fit(gathered(rows, sum(signs), 1))
    return -float(m.coefficients[0]), -float(m.intercept)


def violations(rows: DataFrame, machine: Machine, c: float, tolerance: float = 2 * TOLERANCE) -> DataFrame:
    """rows (at, y, margin) with `optimal`: whether the margin is what the dual's conditions ask of the row's weight, recomputed from the support vectors alone."""
    alpha = rows.sparkSession.createDataFrame(pd.DataFrame({"at": machine.at, "alpha": np.abs(machine.weight)}), "at long, alpha double")
    edge = F.col("y") * F.col("margin")
    free = F.coalesce("alpha", F.lit(0.0))
    return rows.join(F.broadcast(alpha), "at", "left").withColumn("optimal", F.when(free == 0, edge >= 1 - tolerance).when(free >= c, edge <= 1 + tolerance).otherwise(F.abs(edge - 1) <= tolerance))

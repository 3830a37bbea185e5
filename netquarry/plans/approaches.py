"""Classification by approach: one declaration of inputs and taxonomy, from which each approach takes what it needs.

Inputs are functions that give a table; an approach calls those that it declares, so
that tables of other approaches are never read or planned. All approaches give
(key, tags, confidence_scores), tags in the order of the taxonomy.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry import schemas
from netquarry.operators import models
from netquarry.plans import two_stage


@dataclass(frozen=True)
class Taxonomy:
    """Categories in order, and the category of each label below them (category_subcategory)."""

    top: list[str]
    parents: dict[str, str] = field(default_factory=dict)

    @classmethod
    def builtin(cls) -> Taxonomy:
        return cls(list(schemas.TOP), {c: p for c, p in schemas.parents().items() if c != p})

    @classmethod
    def of_file(cls, path: str) -> Taxonomy:
        """Of a file as `schemas.load_taxonomy` reads it."""
        found = schemas.load_taxonomy(path)
        return cls(list(found), {f"{c}_{s}": c for c, v in found.items() if isinstance(v, dict) for s in v})

    def valid(self, spark: SparkSession) -> DataFrame:
        """(ord, category, subcategory), as the two stages ask for it."""
        rows = [(c, s.removeprefix(f"{c}_")) for c in self.top for s in ([x for x, p in self.parents.items() if p == c] or [None]) if s is not None] + [(c, None) for c in self.top if c not in self.parents.values()]
        return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "ord int, category string, subcategory string")


@dataclass
class Request:
    """What an approach is given. inputs: functions by name; weights: of the models that vote."""

    inputs: dict[str, Callable[[], DataFrame]]
    taxonomy: Taxonomy
    key: str = "asn"
    threshold: float = models.THRESHOLD
    weights: dict[str, float] | None = None

    def table(self, name: str) -> DataFrame:
        return self.inputs[name]()


@dataclass(frozen=True)
class Approach:
    needs: tuple[str, ...]
    any_of: tuple[str, ...]
    plan: Callable[[Request], DataFrame]


APPROACHES: dict[str, Approach] = {}


def approach(*needs: str, any_of: tuple[str, ...] = ()):
    """Declare an approach: the inputs that it needs, and those of which it takes any that are there."""

    def put(f: Callable[[Request], DataFrame]):
        APPROACHES[f.__name__] = Approach(needs, any_of, f)
        return f

    return put


def predicted(name: str, request: Request) -> DataFrame:
    """(key, tags, confidence_scores) by the approach; ValueError for one that isn't known, or without its inputs."""
    if name not in APPROACHES:
        raise ValueError(f"no approach {name}; there are {', '.join(sorted(APPROACHES))}")
    one = APPROACHES[name]
    missing = [n for n in one.needs if n not in request.inputs]
    if missing or (one.any_of and not any(n in request.inputs for n in one.any_of)):
        raise ValueError(f"{name} needs {', '.join(missing or one.any_of)}")
    return one.plan(request)


def _tagged(scores: DataFrame, key: str, labels: list[str], threshold: float) -> DataFrame:
    """Labels over the threshold, whatever columns the scores lack."""
    own = [c for c in labels if c in scores.columns]
    pairs = F.array_compact(F.array(*[F.when(F.col(c) > threshold, F.struct(F.lit(c).alias("t"), F.col(c).cast("double").alias("s"))) for c in own]))
    return _named(scores.select(key, pairs.alias("pairs")), key, F.col("pairs"))


def _named(df: DataFrame, key: str, pairs: Column) -> DataFrame:
    return df.select(key, F.transform(pairs, lambda p: p["t"]).alias("tags"), F.map_from_entries(pairs).alias("confidence_scores"))


@approach("scores")
def flat(r: Request) -> DataFrame:
    """One model over categories: those over the threshold."""
    return _tagged(r.table("scores"), r.key, r.taxonomy.top, r.threshold)


@approach("scores", "children")
def hierarchical(r: Request) -> DataFrame:
    """A model over categories that opens those over the labels below them."""
    scores = models.gated(r.table("scores"), r.table("children"), r.key, r.taxonomy.parents, r.threshold)
    return _tagged(scores, r.key, [*r.taxonomy.top, *r.taxonomy.parents], r.threshold)


@approach(any_of=("svm", "llm"))
def hybrid(r: Request) -> DataFrame:
    """The weighted mean of the models that there are."""
    frames = {n: r.table(n) for n in ("svm", "llm") if n in r.inputs}
    return _tagged(models.vote(frames, r.key, r.taxonomy.top, r.weights), r.key, r.taxonomy.top, r.threshold)


@approach("scores")
def one_model(r: Request) -> DataFrame:
    """One model over categories, of which each entity gets one at least: those over the threshold, else the greatest."""
    top = r.taxonomy.top
    rows = r.table("scores").select(r.key, models.chosen(F.array(*[F.col(c).cast("double") for c in top]), top, r.threshold).alias("c"))
    return _named(rows, r.key, F.transform("c", lambda x: F.struct(x["category"].alias("t"), x["confidence"].alias("s"))))


@approach("entities", "subs", any_of=("svm", "llm"))
def two_stages(r: Request) -> DataFrame:
    """Categories by vote, then subcategories of those alone: tags are category_subcategory, or the category where it has none."""
    entities = r.table("entities")
    votes = {n: r.table(n) for n in ("svm", "llm") if n in r.inputs}
    out = two_stage.classify(entities, votes, r.taxonomy.top, r.table("subs"), r.taxonomy.valid(entities.sparkSession), r.key, weights=r.weights)
    below = F.transform("stage2", lambda s: F.struct(F.concat_ws("_", s["category"], s["subcategory"]).alias("t"), s["confidence"].alias("s")))
    bare = F.filter("stage1", lambda c: ~F.exists("stage2", lambda s: s["category"] == c["category"]))
    rest = F.transform(bare, lambda c: F.struct(c["category"].alias("t"), c["confidence"].alias("s")))
    return _named(out, r.key, F.concat(below, rest))

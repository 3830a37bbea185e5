"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence has a logistic score over hashed
features of its words (the word and its beginnings); the document's score is the
noisy-or of its sentences' scores. Only documents carry labels: the gradient of
the noisy-or deals a document's error out to its sentences, so the trained
sentence scores also locate the offending sentences.

The model is fitted on a bounded sample of labelled rows, `max_docs` rows of at
most `max_chars` characters; all documents are scored, as whole texts.

Defined cases: a null or empty text has one empty sentence, scored by the bias;
a very long text is scored whole, sentence by sentence, but not learnt from; a
null label or doc_id is not learnt from; of several labels of a doc_id the
greater counts, of several texts the least; without any labelled row, or with
one class only, the score is the prior alone, however many sentences there are; of equally bad sentences the first
is the worst one; a score that equals the threshold reaches it; doc_ids that
occur more than once are scored row by row; an empty table gives no rows; extra
columns are left alone.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm import common

#: Rows that the model is fitted on at most, and characters of the longest of them.
MAX_DOCS, MAX_CHARS = 6000, 50_000
#: Features are hashed to this many weights, a megabyte.
SIZE = 1 << 18
#: Words whose weight a worker remembers.
MEMO = 150_000
THRESHOLD = 0.7
SENTENCE = re.compile(r"[.!?\n]+")
WORD = re.compile(r"\w+")


def features(word: str) -> list[int]:
    """Places of a word's features: the word, and its first three to six letters."""
    return [zlib.crc32(x.encode("utf-8", "replace")) % SIZE for x in (f"w{word}", *(f"{k}{word[:k]}" for k in (3, 4, 5, 6) if len(word) >= k))]


def sentences(text: str | None) -> list[str]:
    return [x for x in SENTENCE.split(text or "") if x.strip()] or [""]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    prior: float | None = None  # the score of any document, where nothing could be learnt

    def word(self, word: str) -> float:
        return float(self.weights[features(word)].sum())

    def score(self, logits: np.ndarray) -> float:
        """Noisy-or; log(1 - p) of a logit is -log(1 + exp(logit))."""
        if self.prior is not None:
            return self.prior
        return float(-np.expm1(-np.logaddexp(0, logits).sum()))


def fit(texts: list[str], labels: list[int], epochs: int = 40, rate: float = 0.25, ridge: float = 2e-4) -> Model:
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        rate_of = (y.sum() + 0.5) / (len(y) + 1)
        return Model(np.zeros(SIZE), float(np.log(rate_of / (1 - rate_of))), float(rate_of))
    vocabulary: dict[str, int] = {}
    flat, per_sentence, per_doc, places = array("i"), array("i"), array("i"), []
    # Documents of each label that have a feature: the smoothed log odds tell telling words from those that just stand beside them.
    ones, zeros = np.zeros(SIZE), np.zeros(SIZE)
    for t, label in zip(texts, labels, strict=True):
        own = sentences(t.lower())
        per_doc.append(len(own))
        start = len(flat)
        for s in own:
            ids = {vocabulary.setdefault(w, len(vocabulary)) for w in WORD.findall(s)}
            flat.extend(ids)
            per_sentence.append(len(ids))
        for w in islice(vocabulary, len(places), None):
            places.append(array("i", features(w)))
        (ones if label else zeros)[list({p for w in set(flat[start:]) for p in places[w]})] += 1
    flat, per_sentence, per_doc = (np.frombuffer(x, np.int32) for x in (flat, per_sentence, per_doc))
    sentence = np.repeat(np.arange(len(per_sentence), dtype=np.int32), per_sentence)
    doc = np.repeat(np.arange(len(per_doc), dtype=np.int32), per_doc)
    word = np.repeat(np.arange(len(places), dtype=np.int32), [len(x) for x in places])
    place = np.concatenate([np.frombuffer(x, np.int32) for x in places]) if places else np.zeros(0, np.int32)
    del vocabulary, places
    odds = np.log((ones + 0.5) / (y.sum() + 1)) - np.log((zeros + 0.5) / (len(y) - y.sum() + 1))
    sure = odds - 2 * np.sqrt(1 / (ones + 0.5) + 1 / (zeros + 0.5))
    w, bias = np.where(sure > 1, np.minimum(odds, 6), 0.0), -8.0
    seen, seen_bias = np.full(SIZE, 1e-8), 1e-8
    n_words = int(word[-1]) + 1 if len(word) else 0
    for _ in range(epochs):
        of_word = np.bincount(word, w[place], n_words)
        z = bias + np.bincount(sentence, of_word[flat], len(per_sentence))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        whole = np.clip(-np.expm1(-np.bincount(doc, np.logaddexp(0, z), len(per_doc))), 1e-9, 1)
        g = p * np.where(y == 1, -(1 - whole) / whole, 1.0)[doc]
        by_word = np.bincount(flat, g[sentence], n_words)
        grad = np.bincount(place, by_word[word], SIZE) / len(y) + ridge * w / len(y)
        seen += grad * grad
        w = np.maximum(w - rate * grad / np.sqrt(seen), -0.3)  # clean words beside an offending one hardly excuse it
        total = g.sum() / len(y)
        seen_bias += total * total
        bias -= rate * total / np.sqrt(seen_bias)
    return Model(w, float(bias))


def _sampled(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", doc_id: str = "doc_id", max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> DataFrame:
    """(t, y) of at most max_docs labelled texts, by the hash of doc_id, in one sorted partition."""
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("y")).filter("_id is not null and y in (0, 1)")
    chosen = known.groupBy("_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(max_docs)
    rows = docs.select(F.col(doc_id).alias("_own"), F.coalesce(F.col(text), F.lit("")).alias("t")).filter(F.length("t") <= max_chars)
    got = rows.join(F.broadcast(chosen), F.col("_own") == F.col("_id")).groupBy("_id").agg(F.min("t").alias("t"), F.max("y").alias("y"))
    return got.repartition(1).sortWithinPartitions("_id").select("t", "y")


def sample(docs: DataFrame, labels: DataFrame, **options) -> tuple[list[str], list[int]]:
    """The texts and labels that the model is fitted on."""
    got = _sampled(docs, labels, **options).toArrow()
    return got["t"].to_pylist(), got["y"].to_pylist()


def _fitter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, labels = [], []
    for b in batches:
        texts += b.column(0).to_pylist()
        labels += b.column(1).to_pylist()
    model = fit(texts, labels)
    yield pa.RecordBatch.from_arrays([pa.array([model.weights.astype("<f8").tobytes()]), pa.array([model.bias]), pa.array([model.prior], pa.float64())], ["weights", "bias", "prior"])


def _scorer(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}

        def of(sentence: str) -> float:
            parts = [model.bias]
            for w in set(WORD.findall(sentence)):
                x = memo.get(w)
                if x is None:
                    if len(memo) >= MEMO:
                        memo.clear()
                    x = memo[w] = model.word(w)
                parts.append(x)
            return math.fsum(parts)  # the same whatever the order, so that equal sentences are equally bad

        for b in batches:
            scores, worst = [], []
            for t in b.column(1).to_pylist():
                z = np.array([of(s) for s in sentences((t or "").lower())])
                scores.append(model.score(z))
                worst.append(int(z.argmax()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(worst, pa.int32())], ["doc_id", "score", "worst_sentence"])

    return score


def trained(docs: DataFrame, labels: DataFrame, **options) -> Model:
    """The model of a bounded sample of labelled rows, fitted in one task; the driver gets its weights alone."""
    common.tune(docs.sparkSession)
    got = _sampled(docs, labels, **options).mapInArrow(_fitter, "weights binary, bias double, prior double").first()
    return fit([], []) if got is None else Model(np.frombuffer(bytes(got["weights"]), "<f8"), got["bias"], got["prior"])


def scored(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, score and the place of the worst sentence, for each row."""
    common.tune(docs.sparkSession)
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(_scorer(model), "doc_id long, score double, worst_sentence int")


def _sifter(model: Model, text: str, threshold: float):
    score = _scorer(model)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = pa.array(range(b.num_rows), pa.int64())
            one = next(score(iter([pa.RecordBatch.from_arrays([ids, b.column(text)], ["doc_id", "text"])])))
            yield b.filter(pa.array(np.asarray(one.column("score")) < threshold))

    return sift


def keep(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score stays below the threshold, with all their columns."""
    common.tune(docs.sparkSession)
    return docs.mapInArrow(_sifter(model, text, threshold), docs.schema)


def offending(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, sentence number, sentence and score of each sentence that reaches the threshold by itself."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for k, s in enumerate(sentences(t)):
                    p = model.score(np.array([math.fsum([model.bias, *map(model.word, set(WORD.findall(s.lower())))])]))
                    if p >= threshold:
                        out.append({"doc_id": i, "sentence": k, "words": s, "score": p})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("sentence", pa.int32()), ("words", pa.string()), ("score", pa.float64())]))

    common.tune(docs.sparkSession)
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(find, "doc_id long, sentence int, words string, score double")

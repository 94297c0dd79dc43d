"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's score is a logistic function of its words, and 0 without a
word of the model (so that no score rises with length alone); the document's score is the noisy-or of its sentences, 1 - product(1 - p).  Only documents are labelled: the
weights are fitted to the document labels through the noisy-or, and then tell which sentences offend.

The model is fitted on a bounded sample: at most MAX_FIT labelled rows, those of the smallest hashes of
their ids (all toxic and clean rows alike, so rates are kept), whatever their length: words are counted by
document on the executors, and only sentences that hold words of the model come back, as sets of those
words with counts.  Words that occur in fewer than MIN_DOCS fitted documents, or whose log odds are not MIN_SURE standard errors above 0, are left out, and of the
others the MAX_WORDS surest are kept, so the model is small whatever the corpus.  Labels, lang, source and ids are never
inputs of a score.

Defined results: null and empty texts have no sentences and score 0; conflicting labels of one id count
as toxic; unlabelled documents are scored like others; with no labelled row, or none of one kind, all
score 0; repeated rows are kept; of other columns, score and predicted (in upper or lower case) are
replaced, the rest, whatever their names, stay as they are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Container, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import ROW, col, cut, held, others, released, returning, slices

#: Rows to fit on, words of the model, documents that a word must occur in, and the decision threshold.
MAX_FIT, MAX_WORDS, MIN_DOCS, THRESHOLD = 6000, 2000, 4, 0.3
#: Standard errors by which a word's log odds must exceed 0.
MIN_SURE = 3.0
#: Ridge on the weights, in log likelihood of documents.
RIDGE = 2e-3
_PARTS = re.compile(r"[^\W_]+|[.!?\n]+")


def held_out(doc_id: Column) -> Column:
    """True for the quarter of the ids that is kept out of fitting."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(4)) == 2


def sentences(text: str) -> list[list[str]]:
    """Lower-case words of each sentence; sentences end with . ! ? or a new line."""
    out: list[list[str]] = [[]]
    for part in _PARTS.findall(text.lower()):
        if part[0] in ".!?\n":
            out.append([])
        else:
            out[-1].append(part)
    return [s for s in out if s]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass(frozen=True)
class Model:
    weights: dict
    bias: float

    def sentence_scores(self, text: str | None) -> list[float]:
        out = []
        for s in sentences(text or ""):
            found = [self.weights[w] for w in set(s) if w in self.weights]
            out.append(float(_sigmoid(np.float64(self.bias + sum(found)))) if found else 0.0)
        return out

    def score(self, text: str | None) -> float:
        """Noisy-or of the sentences that hold a word of the model."""
        if not text or not self.weights:
            return 0.0
        kept = 0.0
        for found in marked_sentences(text, self.weights):
            kept -= float(np.logaddexp(0.0, self.bias + sum(self.weights[w] for w in found)))
        return float(-np.expm1(kept))


def marked_sentences(text: str, words: Container[str]) -> Iterator[list[str]]:
    """The different ones of `words` of each sentence that holds any, without holding other words in memory."""
    current: dict[str, None] = {}
    for match in _PARTS.finditer(text.lower()):
        part = match.group()
        if part in words:
            current[part] = None
        elif current and part[0] in ".!?\n":
            yield list(current)
            current = {}
    if current:
        yield list(current)


def choose(seen: dict[str, tuple[int, int]], n: tuple[int, int]) -> list[str]:
    """Words to weigh; seen: clean and toxic documents of each word, n: clean and toxic documents."""
    # How sure it is that a word marks toxic documents: its log odds over their standard error.
    sure = {}
    for w, (clean, toxic) in seen.items():
        if clean + toxic >= MIN_DOCS:
            odds = np.log((toxic + 0.5) / (n[1] + 1)) - np.log((clean + 0.5) / (n[0] + 1))
            sure[w] = odds / np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    return [w for w in sorted(sure, key=lambda w: (-sure[w], w)) if sure[w] >= MIN_SURE][:MAX_WORDS]


class Bags:
    """The likelihood of document labels under the noisy-or of their sentences.

    bags: of each document, how many sentences hold which of the chosen words (by place; none: left out).
    Sentences without any of the words have the fixed chance 0.
    """

    def __init__(self, bags: list[dict[tuple[int, ...], int]], labels: list[int], words: int):
        self.words, self.y = words, np.array(labels, float)
        rows, columns, owner, times = [], [], [], []
        for d, bag in enumerate(bags):
            for found, count in sorted(bag.items()):
                rows += [len(owner)] * len(found)
                columns += found
                owner.append(d)
                times.append(count)
        self.row, self.column, self.owner, self.times = np.array(rows, int), np.array(columns, int), np.array(owner, int), np.array(times, float)

    def loss(self, theta: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
        """Mean negative log likelihood with a ridge on the weights, and its gradient; theta: the weights, then the bias."""
        w, y, o, k = theta[:-1], self.y, self.owner, self.times
        z = theta[-1] + np.bincount(self.row, w[self.column], len(o))
        p = _sigmoid(z)
        none = np.bincount(o, -k * np.logaddexp(0, z), len(y))  # log of the chance that no sentence offends
        doc = np.maximum(-np.expm1(none), 1e-9)
        # d loss / d z: p for clean documents, -p (1 - doc) / doc for toxic ones.
        g = k * p * np.where(y[o] == 1, -np.exp(none[o]) / doc[o], 1.0)
        gradient = np.append(np.bincount(self.column, g[self.row], self.words) + ridge * w, g.sum())
        total = -np.where(y == 1, np.log(doc), none).sum() + ridge / 2 * (w @ w)
        return total / len(y), gradient / len(y)


def fit(bags: list[dict[tuple[int, ...], int]], labels: list[int], chosen: list[str], *, rounds: int = 300, ridge: float = RIDGE) -> Model:
    """Weights of words by Adam on the likelihood of the document labels (see Bags)."""
    if not chosen or not labels or min(labels) == max(labels):
        return Model({}, -12.0)
    task = Bags(bags, labels, len(chosen))
    theta = np.append(np.zeros(len(chosen)), -6.0)
    m, v = np.zeros(len(theta)), np.zeros(len(theta))
    for t in range(1, rounds + 1):
        gradient = task.loss(theta, ridge)[1]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-12)
    return Model({word: float(x) for word, x in zip(chosen, theta) if abs(x) > 1e-3}, float(theta[-1]))


def fit_labelled(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_fit: int = MAX_FIT) -> Model:
    """A model from at most max_fit labelled rows that are not held out."""
    key = F.col(id_col)
    sample = (
        labels.where(key.isNotNull() & F.col(label_col).isNotNull() & ~held_out(key))
        .groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64(id_col), id_col).limit(max_fit)
    )
    # One text for an id, the least by hash, so that repeated rows change nothing.
    rows = docs.select(key.alias("k"), F.col(text_col).alias("t")).join(F.broadcast(sample.withColumnRenamed(id_col, "k")), "k")
    rows = cut(rows.groupBy("k", "label").agg(F.min_by("t", F.xxhash64("t")).alias("t")).select("k", (F.col("label") > 0).cast("int").alias("label"), "t"))
    totals = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n = (totals.get(0, 0), totals.get(1, 0))
    if not all(n):
        return fit([], [], [])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", 1 << 22):
            for label, t in zip(batch.column("label").to_pylist(), batch.column("t").to_pylist()):
                found = list({m.group() for m in _PARTS.finditer((t or "").lower()) if m.group()[0] not in ".!?\n"})
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([label] * len(found), pa.int32())], ["w", "label"])

    counts = rows.select("label", "t").mapInArrow(words, "w string, label int").groupBy("w").agg(F.sum(1 - F.col("label")).alias("clean"), F.sum("label").alias("toxic"))
    # No word that is as common among clean documents is sure to mark toxic ones.
    marking = counts.where((F.col("clean") + F.col("toxic") >= MIN_DOCS) & ((F.col("toxic") + 0.5) / (n[1] + 1) > (F.col("clean") + 0.5) / (n[0] + 1)))
    chosen = choose({r.w: (r.clean, r.toxic) for r in marking.collect()}, n)
    index = {w: i for i, w in enumerate(chosen)}

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", 1 << 22):
            for k, label, t in zip(batch.column("k"), batch.column("label").to_pylist(), batch.column("t").to_pylist()):
                bag = Counter(tuple(sorted(index[w] for w in found)) for found in marked_sentences(t or "", index))
                if bag:
                    columns = [pa.array([k.as_py()] * len(bag), batch.column("k").type), pa.array([label] * len(bag), pa.int32()), pa.array(bag.keys(), pa.list_(pa.int32())), pa.array(bag.values(), pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["k", "label", "found", "times"])

    held: dict = {}
    id_type = rows.schema["k"].dataType.simpleString()
    for r in rows.mapInArrow(bags, f"k {id_type}, label int, found array<int>, times long").orderBy("k").collect():
        held.setdefault(r.k, (r.label, {}))[1][tuple(r.found)] = r.times
    # Documents without any such sentence say nothing of the weights, but count in the rates.
    empty = [n[label] - sum(1 for x, _ in held.values() if x == label) for label in (0, 1)]
    return fit([bag for _, bag in held.values()] + [{}] * sum(empty), [x for x, _ in held.values()] + [0] * empty[0] + [1] * empty[1], chosen)


def score_documents(df: DataFrame, model: Model, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df with score and predicted."""
    kept = others(df, ("score", "predicted"))
    # The text travels once: inside the row, where that holds it.
    inside = text_col in kept
    rows = df.select(held(kept)) if inside else df.select(held(kept), col(text_col).alias("t"))
    place = kept.index(text_col) if inside else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            if inside:
                whole = whole.append_column("t", whole.column(ROW).field(place))
            for batch in slices([whole], "t", 1 << 22):
                scores = [model.score(t) for t in batch.column("t").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(ROW), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], [ROW, "score", "predicted"])

    schema = StructType([rows.schema[ROW], StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return rows.mapInArrow(returning(run), schema).select(*released(kept), "score", "predicted")


def offending_sentences(df: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, sentence (number from 0), score of the sentences at or above the threshold."""
    base = df.select(col(id_col).alias("id"), col(text_col).alias("text"))
    id_type = base.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 22):
            hits = [(i, k, s) for i, t in enumerate(batch.column("text").to_pylist()) for k, s in enumerate(model.sentence_scores(t)) if s >= threshold]
            ids = batch.column("id").take(pa.array([h[0] for h in hits], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([h[1] for h in hits], pa.int64()), pa.array([h[2] for h in hits], pa.float64())], ["id", "sentence", "score"])

    return base.mapInArrow(run, f"id {id_type}, sentence long, score double").withColumnRenamed("id", id_col)

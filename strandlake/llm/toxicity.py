"""Toxicity as a severity grade, by cumulative-link ordinal regression.

P(grade > j) = sigmoid(w.x - t_j): one weight vector w for all grades and ordered thresholds t_0 < t_1 < ... The
features are sparse: which words, and which beginnings of words, a text has, hashed into buckets. Most weights are
exactly zero (L1 penalty by proximal gradient steps). The severity of a text is its expected grade.

Labels are yes or no. A toxic text's grade is how much it is so: one, two or three by how many of its words are typical
of toxic texts (hardly ever in texts labelled clean), in thirds of the labelled toxic texts.
"""

from __future__ import annotations

import functools
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import fresh, released, slices
from .unit_encoding import UnitMemory

WORD = re.compile(r"\w+")
BUCKETS = 1 << 18
PREFIXES = (4, 5)


class Model(NamedTuple):
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float  # texts of at least this severity are toxic


@functools.lru_cache(maxsize=1)
def _features() -> UnitMemory:
    def make(word: str) -> tuple[int, ...]:
        own = [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]
        return tuple(xxhash.xxh64_intdigest(x.encode(), 11) % BUCKETS for x in own)

    return UnitMemory(make, 60_000)


def features(text: str) -> np.ndarray:
    """The buckets that occur in a text, ascending."""
    known = _features()
    return np.array(sorted({b for w in set(WORD.findall(text.lower())) for b in known[w]}), np.int32)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def severity(scores: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """The expected grade: the sum of the chances to be above each threshold."""
    return _sigmoid(np.asarray(scores)[:, None] - thresholds).sum(axis=1)


def fit_ordinal(rows: np.ndarray, buckets: np.ndarray, grades: np.ndarray, l1: float = 2e-4, steps: int = 250) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds for the sparse features (rows[i], buckets[i]) of len(grades) texts, by accelerated proximal gradient."""
    n, top = len(grades), int(grades.max(initial=1))
    above = grades[:, None] > np.arange(top)
    w, t = np.zeros(BUCKETS), np.arange(top) * 0.5 + 1.0
    ahead_w, ahead_t, speed = w, t, 1.0
    # the largest curvature is at most a quarter of that of the squares, estimated by a few power iterations
    v = np.ones(BUCKETS)
    for _ in range(8):
        v = np.bincount(buckets, np.bincount(rows, v[buckets], n)[rows], BUCKETS)
        size = np.linalg.norm(v)
        v /= max(size, 1e-12)
    rate = 1 / max(0.25 * top * size / n, 1e-6)
    for _ in range(steps):
        error = _sigmoid(np.bincount(rows, ahead_w[buckets], n)[:, None] - ahead_t) - above
        new_w = ahead_w - rate * np.bincount(buckets, error.sum(axis=1)[rows], BUCKETS) / n
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - rate * l1, 0)
        new_t = np.maximum.accumulate(ahead_t + 2.0 * error.mean(axis=0))
        faster = (1 + (1 + 4 * speed**2) ** 0.5) / 2
        ahead_w, ahead_t = new_w + (speed - 1) / faster * (new_w - w), new_t
        w, t, speed = new_w, new_t, faster
    return w, t


def fit(docs: DataFrame, labels: DataFrame, rows: int = 8_000) -> Model:
    """A model of at most ``rows`` labelled texts, those with the smallest hash of their id; only their features are collected.

    Of rows with the same labelled id the first text counts, so no more than ``rows`` texts come to the driver. Where the
    labels are not of both kinds there is nothing to tell apart, and the model finds nothing toxic.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).na.drop().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(sample, "doc_id")
    labelled = labelled.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    @released(_features)
    def extract(batches):
        for batch in slices(batches):
            found = [features(t or "") for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["toxic"], pa.array(found, pa.list_(pa.int32()))], ["doc_id", "toxic", "buckets"])

    table = labelled.select("doc_id", "text", "toxic").mapInArrow(extract, "doc_id long, toxic int, buckets array<int>").toArrow()
    # in order of the ids, so that sums don't depend on which task was done first
    table = table.take(np.lexsort((table["doc_id"].to_numpy(),))).combine_chunks() if table.num_rows else table
    buckets = table["buckets"].combine_chunks()
    lengths, flat, toxic = buckets.value_lengths().to_numpy(zero_copy_only=False), buckets.flatten().to_numpy(), table["toxic"].to_numpy() > 0
    if not toxic.any() or toxic.all():
        return Model(np.zeros(BUCKETS), np.array([40.0]), 0.5)
    row = np.repeat(np.arange(len(toxic)), lengths)
    grades = np.where(toxic, _grades(row, flat, toxic), 0)
    # sparse features in few texts say nothing: keep those of at least five
    often = np.bincount(flat, minlength=BUCKETS)[flat] >= 5
    row, flat = row[often], flat[often]
    # the cut comes from texts that a first fit has not seen
    first = np.arange(len(toxic)) % 4 != 0
    renumber = np.cumsum(first) - 1
    w, t = fit_ordinal(renumber[row[first[row]]], flat[first[row]], grades[first])
    held = severity(np.bincount(row, w[flat], len(toxic)), t)[~first]
    cut = _best_cut(held, toxic[~first])
    return Model(*fit_ordinal(row, flat, grades), cut)


def _grades(row: np.ndarray, flat: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    in_toxic, in_clean = (np.bincount(flat[toxic[row] == x], minlength=BUCKETS) for x in (True, False))
    typical = (in_toxic >= 5) & (in_toxic * (~toxic).sum() > 50 * (in_clean + 0.1) * toxic.sum())
    hits = np.bincount(row, typical[flat], len(toxic))
    low, high = np.quantile(hits[toxic], [1 / 3, 2 / 3])
    return 1 + (hits > low) + (hits > high)


def _best_cut(scores: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the widest gap among the cuts with the best F1."""
    order = np.argsort(-scores, kind="stable")
    hit = np.cumsum(toxic[order])
    f1 = 2 * hit / (np.arange(1, len(scores) + 1) + max(1, toxic.sum()))
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)[0]
    below = scores[order][best + 1] if best + 1 < len(scores) else 0.0
    return float((scores[order][best] + below) / 2)


def graded(docs: DataFrame, model: Model) -> tuple[DataFrame, tuple[str, ...]]:
    """``docs`` with severity, grade (the likeliest one) and toxic beside its own columns, in one narrow pass; the names of these three, other ones where ``docs`` has them."""
    spark = docs.sparkSession
    used = np.flatnonzero(model.weights)
    shared = spark.sparkContext.broadcast((dict(zip(used.tolist(), model.weights[used].tolist(), strict=True)), model.thresholds, model.cut))
    names = fresh(docs.columns, "severity", "grade", "toxic", "words")

    @released(_features)
    def score(batches):
        weights, thresholds, cut = shared.value
        known = _features()
        words = UnitMemory(lambda w: tuple((b, weights[b]) for b in known[w] if b in weights), 60_000)
        for batch in slices(batches):
            totals, marked = [], []
            for text in batch[names[3]].to_pylist():
                found: dict[int, float] = {}
                for w in set(WORD.findall(text.lower())):
                    if hit := words[w]:
                        found.update(hit)
                totals.append(sum(v for _, v in sorted(found.items())))
                marked.append(any(v > 0 for v in found.values()))
            expected = severity(np.array(totals, float), thresholds)
            chance = 1 - _sigmoid(np.array(totals, float)[:, None] - thresholds)
            steps = np.diff(np.concatenate([np.zeros((len(totals), 1)), chance, np.ones((len(totals), 1))], axis=1), axis=1)
            own = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(expected, pa.float64()), pa.array(steps.argmax(axis=1), pa.int32()), pa.array((expected >= cut) & np.array(marked, bool), pa.bool_())], [*batch.schema.names[:-1], *names[:3]])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(x, t) for x, t in zip(names, (T.DoubleType(), T.IntegerType(), T.BooleanType()), strict=False))])
    return docs.select("*", F.coalesce(docs["text"].cast("string"), F.lit("")).alias(names[3])).mapInArrow(score, schema), names[:3]


def severities(docs: DataFrame, labels: DataFrame, rows: int = 8_000) -> DataFrame:
    """doc_id, severity, grade and toxic of every whole text.

    A null or empty text has no features; without any feature that speaks for toxicity a text is not toxic. Equal texts
    get equal results, whatever their ids, which may repeat or be null. If the labelled texts are all toxic, all clean or
    none, nothing is found toxic. Null ids and labels say nothing; of repeated labels the gravest counts. An empty table
    gives no rows. Other columns of ``docs`` may have any names.
    """
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    found, names = graded(own, fit(own, labels, rows))
    return found.select("doc_id", *names)


def without_toxic(docs: DataFrame, labels: DataFrame, rows: int = 8_000) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with all their columns; each row by its own text. Cases as in severities."""
    found, names = graded(docs, fit(docs, labels, rows))
    return found.where(~F.col(names[2])).select(*docs.columns)

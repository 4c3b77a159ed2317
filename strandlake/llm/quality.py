"""Quality by importance resampling.

Two generative models count hashed word n-grams (words and pairs of neighbouring words): one of target texts, labelled
as good, one of all texts. A document's weight is the log of its importance, the sum of the log ratios of its n-grams
under the two. Standard Gumbel noise on the weights makes the k largest keys a sample without replacement, each draw in
proportion to the importance of what is left.
"""

from __future__ import annotations

import functools
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import fresh, released, scratch, slices, written
from .unit_encoding import UnitMemory

#: Words are runs of word characters or of marks, as in the public recipe for resampling by importance.
TOKEN = re.compile(r"\w+|[^\w\s]+")
BUCKETS = 1 << 14
PAIR = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(maxsize=1)
def _hashes() -> UnitMemory:
    return UnitMemory(lambda word: xxhash.xxh64_intdigest(word.encode(), 7), 100_000)


def ngram_buckets(text: str) -> np.ndarray:
    """The buckets of all words and all pairs of neighbouring words."""
    h = np.fromiter(map(_hashes().__getitem__, TOKEN.findall(text)), np.uint64)
    with np.errstate(over="ignore"):
        pairs = (h[:-1] * PAIR ^ h[1:]) * PAIR
    return np.concatenate([h >> np.uint64(50), pairs >> np.uint64(50)]).astype(np.int64)


def uniform(doc_id: int | None, text: str, seed: int) -> float:
    """A number in (0, 1) for a row, the same for equal rows."""
    return (xxhash.xxh64_intdigest(f"{doc_id}\n{text}".encode("utf-8", "replace"), seed) // 2**11 + 0.5) / 2**53


def _labelled(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, label) of at most ``rows`` labelled rows, those with the smallest hash of their id; a bounded table."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).na.drop().groupBy("doc_id").agg(F.max("label").alias("label"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def fit(docs: DataFrame, labels: DataFrame, rows: int = 20_000) -> tuple[np.ndarray, float]:
    """The log ratio for each bucket, and the share of good documents (with three standard errors on top).

    The raw model counts all documents. The target model counts those of at most ``rows`` labelled ones that are good.
    """
    sample = F.broadcast(_labelled(labels, "quality", rows))

    @released(_hashes)
    def count(batches):
        raw, target, known, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), 0, 0
        for batch in slices(batches):
            for text, label in zip(batch["text"].to_pylist(), batch["label"].to_pylist(), strict=True):
                n = np.bincount(ngram_buckets(text or ""), minlength=BUCKETS)
                raw += n
                if label is not None:
                    known += 1
                    if label > 0:
                        target += n
                        good += 1
        yield pa.RecordBatch.from_pydict({"bucket": np.arange(BUCKETS + 1), "raw": np.append(raw, known), "target": np.append(target, good)})

    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(sample, "doc_id", "left").select("text", "label")
    counts = joined.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).orderBy("bucket").toPandas()
    if not len(counts):
        return np.zeros(BUCKETS), 1.0
    raw, target = (counts[c].to_numpy(np.float64) for c in ("raw", "target"))
    known, good = raw[-1], target[-1]
    raw, target = raw[:-1] + 1, target[:-1] + 1
    share = good / known if known else 1.0
    share = min(1.0, share + 3 * math.sqrt(share * (1 - share) / known)) if known else 1.0
    return np.log(target / target.sum()) - np.log(raw / raw.sum()), share


#: What weigh adds to a table.
ADDED = ("n_ngrams", "weight", "key", "ordinal")


def weigh(docs: DataFrame, ratio: np.ndarray, seed: int = 17) -> tuple[DataFrame, tuple[str, ...]]:
    """``docs`` (doc_id, text, ...) with n_ngrams, weight (sum of log ratios, 0 without n-grams), key (weight plus Gumbel noise) and its order as a long; the names of these four, other ones where ``docs`` has them."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    names = fresh(docs.columns, *ADDED, "id", "words")

    @released(_hashes)
    def score(batches):
        for batch in slices(batches):
            table, n, weight, noise = shared.value, [], [], []
            for doc_id, text in zip(batch[names[4]].to_pylist(), batch[names[5]].to_pylist(), strict=True):
                buckets = ngram_buckets(text)
                n.append(len(buckets))
                weight.append(float(table[buckets].sum()))
                noise.append(-math.log(-math.log(uniform(doc_id, text, seed))))
            key = np.array(weight) + np.array(noise)
            bits = (key + 0.0).view(np.int64)
            own = [batch.column(i) for i in range(batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), pa.array(weight, pa.float64()), pa.array(key, pa.float64()), pa.array(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits), pa.int64())], [*batch.schema.names[:-2], *names[:4]])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(x, t) for x, t in zip(names, (T.LongType(), T.DoubleType(), T.DoubleType(), T.LongType()), strict=False))])
    rows = docs.select("*", docs["doc_id"].cast("long").alias(names[4]), F.coalesce(docs["text"].cast("string"), F.lit("")).alias(names[5]))
    return rows.mapInArrow(score, schema), names[:4]


def kth_largest(df: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a long column, by counts of its leading 16 bits, then the next 16, and so on: no sort."""
    low = 0
    for shift in (48, 32, 16, 0):
        part = F.shiftright(F.col(column), shift)
        counts = df.where(F.shiftright(F.col(column), shift + 16) == low >> shift + 16) if shift < 48 else df
        for value, n in sorted(counts.groupBy(part.alias("p")).count().collect(), reverse=True):  # at most 65,536 rows
            if k <= n:
                low = value << shift
                break
            k -= n
        else:
            return None
    return low


def _resampled(docs: DataFrame, labels: DataFrame, rows: int) -> tuple[DataFrame, tuple[str, ...], Column]:
    """The weighed rows, written with all their columns, the names of what was added, and whether a row is kept."""
    ratio, share = fit(docs, labels, rows)
    weighed, names = weigh(docs, ratio)
    weighed = written(weighed, scratch(docs.sparkSession, "quality"))
    k = math.ceil(share * weighed.count())
    least = kth_largest(weighed, names[3], k) if k else None
    return weighed, names, F.lit(True) if least is None else F.col(names[3]) >= least


def resample(docs: DataFrame, labels: DataFrame, rows: int = 20_000) -> DataFrame:
    """doc_id, n_ngrams, weight, key and kept for every row of ``docs``.

    k, the size of the sample, is the share of good ones among the labelled documents (with three standard errors), times
    the number of rows. All rows whose key equals the k-th largest are kept. A null or empty text has no n-grams and a
    weight of zero. Equal rows share one key; rows with equal ids and other texts have keys of their own, and all of them
    take their id's label. Null ids and labels say nothing, of repeated labels the best counts. Without any labels all
    rows are kept. An empty table gives no rows. Other columns of ``docs`` may have any names.
    """
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    weighed, _, kept = _resampled(own, labels, rows)
    return weighed.select("doc_id", "n_ngrams", "weight", "key", kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = 20_000) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns: each by its own key, whatever ids repeat. Cases as in resample."""
    weighed, _, kept = _resampled(docs, labels, rows)
    return weighed.where(kept).select(*docs.columns)

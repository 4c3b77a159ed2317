"""The pipeline against plain Python: all stages on the smallest tables, and each on awkward ones."""

import itertools
import math
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from strandlake.llm import quality, toxicity

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def ngrams(text):
    h = [xxhash.xxh64_intdigest(w.encode(), 7) for w in re.findall(r"\w+|[^\w\s]+", text)]
    mix = 0x9E3779B97F4A7C15
    return [x >> 50 for x in h + [((a * mix) % 2**64 ^ b) * mix % 2**64 for a, b in itertools.pairwise(h)]]


def good_rows(rows, known):
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(ngrams(t))
        if known.get(i):
            target.update(ngrams(t))
    size = 1 << 14
    ratio = lambda b: math.log((target[b] + 1) / (target.total() + size)) - math.log((raw[b] + 1) / (raw.total() + size))
    labelled = [known[i] for i, _ in rows if i in known]
    share = sum(labelled) / len(labelled)
    k = math.ceil(min(1, share + 3 * math.sqrt(share * (1 - share) / len(labelled))) * len(rows))
    keys = [sum(map(ratio, ngrams(t))) - math.log(-math.log(quality.uniform(i, t, 17))) for i, t in rows]
    least = sorted(keys, reverse=True)[k - 1]
    return [r for r, key in zip(rows, keys, strict=True) if key >= least - 1e-9]


def clean_rows(rows, model):
    out = []
    for i, t in rows:
        own = {xxhash.xxh64_intdigest(x.encode(), 11) % (1 << 18) for w in re.findall(r"\w+", t.lower()) for x in (w, *(w[:k] + "*" for k in (4, 5) if len(w) > k))}
        severity = sum(1 / (1 + math.exp(min(700, c - sum(model.weights[b] for b in own)))) for c in model.thresholds)
        if not (severity >= model.cut and any(model.weights[b] > 0 for b in own)):
            out.append((i, t))
    return out


def distinct_rows(rows):
    best = {}
    for i, t in rows:
        if t not in best or (i is not None and (best[t] is None or i > best[t])):
            best[t] = i
    return [(i, t) for t, i in best.items()]


def shingles(text):
    words = text.encode().lower().split()
    return {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def apart_rows(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] == sets[b] or both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            x, y = root[a], root[b]
            root = [x if r == y else r for r in root]
    groups = {}
    for k, r in enumerate(root):
        groups.setdefault(r, []).append(rows[k])
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def pieces(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    out = []
    for i, x in rows:
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4")
        out += [(str(i), k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    return sorted(out)


def sorted_rows(rows):
    return sorted((str(i), t) for i, t in rows)


def test_run_is_that_of_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    known = {}
    for r in labels.collect():
        if r.doc_id is not None and r.quality is not None:
            known[r.doc_id] = max(known.get(r.doc_id, 0), r.quality)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    rows = clean_rows(rows, toxicity.fit(docs, labels))
    assert sorted_rows(rows) == sorted_rows((r.doc_id, r.text or "") for r in STAGES["toxicity"](spark, docs, SF).collect())
    rows = good_rows(rows, known)
    rows = apart_rows(distinct_rows(rows))
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces(rows)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        assert [o for o, _ in sorted(own)] == [0, *itertools.accumulate(n for _, n in sorted(own))][:-1] and sum(n for _, n in own) <= 2048


@pytest.fixture(scope="module")
def awkward(spark):
    """Repeated and null ids, empty, null and long texts, equal rows, and extra columns with names that the operators use."""
    base = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()][:60]
    long = " ".join(f"word{k % 977} of{k % 31}" for k in range(30_000))
    extra = [(3, "A b c d e f g h"), (5, "A b c d e f g h"), (5, "quite another text that has no copy at all"), (None, "no id here, a text of its own"), (None, "A b c d e f g h"), (None, None), (7, ""), (7, ""), (8, " \n "), (9, long), (9, long + " end")]
    names = ["id", "at", "_at", "words", "severity", "grade", "toxic", "weight", "key", "ordinal", "n_ngrams", "node", "bucket", "bit", "map", "label", "place"]
    df = spark.createDataFrame(base + extra + extra[:3], "doc_id long, text string")
    for name in names:
        df = df.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    return df.repartition(5)


def own_rows(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


def test_stages_on_awkward_rows(spark, awkward):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    known = {r.doc_id: r.quality for r in labels.groupBy("doc_id").agg(F.max("quality").alias("quality")).na.drop().collect()}
    rows = own_rows(awkward)
    want = {
        "toxicity": clean_rows(rows, toxicity.fit(awkward, labels)),
        "quality": good_rows(rows, known),
        "exact dedup": distinct_rows(rows),
        "near dedup": apart_rows(rows),
    }
    for name, expected in want.items():
        got = STAGES[name](spark, awkward, SF)
        assert got.columns == awkward.columns, name
        assert sorted_rows(own_rows(got)) == sorted_rows(expected), name
        assert all(str(r.node) == ("None" if r.doc_id is None else f"node{r.doc_id}") for r in got.collect())
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in STAGES["packing"](spark, awkward, SF).collect()) == pieces(rows)


def test_stages_on_an_empty_table(spark, awkward):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, awkward.limit(0), SF).count() == 0, name

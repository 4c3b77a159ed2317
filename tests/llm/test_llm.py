import itertools
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from strandlake.llm import bpe_codec, components, exact_dedup, packing, quality, simhash, token_counts, token_output, toxicity, unit_encoding, url_filter, vector_search

ODD = ["", None, " ", "\n", "a", "  a  b ", "x\n\ny", "tab\tand\x1cmore", "é" * 300, "word " * 3000, "日本語 と 中文", "😀 don't", "<|endoftext|> a", "<s> </s>", "▁a ▁", "z" * 9000, "same", "same"]


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(2)
    mixed = ["".join(rnd.choice("ab  \n\t▁éß中!'1²") for _ in range(rnd.randint(1, 80))) for _ in range(40)]
    rows = [(k, t, f"d{k}") for k, t in enumerate(ODD + mixed)] + [(None, "no id", None), (3, "\n", "again")]
    # extra columns whose names the operators use inside
    return spark.createDataFrame(rows, "doc_id long, text string, at string").withColumn("keep", F.lit(1)).withColumn("node", F.lit("x")).repartition(3)


def whole(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_token_planes(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    path = f"file://{tmp_path}/ids"
    for kind, block in (("bit", 64), ("byte", 1000)):
        shards = token_output.write_token_files(docs, f"{path}-{kind}", P.path("byte_bpe_50k.json"), 2, kind=kind, block_tokens=block)
        got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_output.read_token_files(spark, f"{path}-{kind}").collect()))
        want = {}
        for i, x in whole(docs):
            ids = np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4")
            want.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
        assert [g[1] for g in got] == sorted((i for i, _ in whole(docs)), key=lambda i: (i is not None, i))
        assert all((n, c) in want[i] for _, i, n, c in got)
        assert [g[0] for g in got] == [0, *itertools.accumulate(g[2] for g in got)][:-1] and sum(s["n_tokens"] for s in shards) == sum(g[2] for g in got)
    with open(f"{tmp_path}/ids-bit/{shards[0]['name']}", "rb") as f:
        reader = token_output.ShardReader(f, f.seek(0, 2))
        all_ids = np.concatenate([b for _, b in reader.blocks()])
        assert np.array_equal(reader.read(70, 200), all_ids[70:270]) and len(reader.read(10**9, 5)) == 0
    empty = token_output.write_token_files(docs.limit(0), f"{path}-none", P.path("byte_bpe_50k.json"))
    assert empty == [] and token_output.read_token_files(spark, f"{path}-none").count() == 0


def test_byte_bpe(docs):
    import tiktoken

    bpe = bpe_codec.ByteBpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, by_units=True)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.file.ranks, special_tokens={})
    rnd = random.Random(4)
    many = [t for _, t in whole(docs)] + ["".join(rnd.choice("theringaon' ") for _ in range(90)) for _ in range(300)] + ["ab" * 20000]
    assert [x.tolist() for x in bpe.encode(many)] == [enc.encode_ordinary(t) for t in many]
    assert all(bpe.decode(x) == t.encode() for x, t in zip(bpe.encode(many), many, strict=True))
    got = {r.doc_id: r for r in bpe_codec.round_trip(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, by_units=True).collect()}
    assert got[1].n_tokens == 0 and len(got) == len({i for i, _ in whole(docs)})
    assert [len(r.ids) for r in bpe_codec.encode_documents(docs.where("doc_id = 15"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()] == [len(enc.encode_ordinary("z" * 9000))]


@pytest.mark.parametrize("pattern", [r"\S+\s*|\s+", r"(?s).+", r"\w+ ?|[^\w]+"])
def test_byte_bpe_of_any_pattern(pattern):
    import tiktoken

    bpe = bpe_codec.ByteBpe(P.path("byte_bpe_50k.tiktoken"), pattern)
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.file.ranks, special_tokens={})
    rnd = random.Random(8)
    many = ["the rings of the tree", "One Two\nthree  four", "", " ", "Ünï çode \U0001f600 and more"] + ["".join(rnd.choice("theringaon' \n") for _ in range(400)) for _ in range(60)] + ["ab" * 3000 + "the" * 2000]
    assert [x.tolist() for x in bpe.encode(many)] == [enc.encode_ordinary(t) for t in many]


def test_token_counts(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    machine = token_counts.CountingTransducer(P.path("piece_bpe_32k.model"))
    rnd = random.Random(6)
    many = [t for _, t in whole(docs)] + ["".join(rnd.choice("ab  \n▁éß中!'1²theringon") for _ in range(rnd.randint(1, 70))) for _ in range(1500)]
    many += ["ab" * 3000, "the" * 999, "\n" * 50 + " " * 50, "e" * 500 + "\U0001f600" * 40 + "in" * 300]
    for chunk in (1, 5, 64, 1 << 14):
        assert [machine.count(t, chunk) for t in many] == [len(sp.encode(t)) for t in many]
    texts = ("▁ab▁c", "dé", "f", "▁g\nh", "i▁", "▁▁x", "theringon")
    maps = [machine.chunk(t, "".join(texts[:k]) if k else None) for k, t in enumerate(texts)]
    left = maps[0]
    for m in maps[1:]:
        left = machine.compose(left, m)
    right = maps[-1]
    for m in maps[-2::-1]:
        right = machine.compose(m, right)
    # associative, and the same as the machine run over the whole text
    for state in range(min(len(machine.states), 40)):
        assert machine.apply(left, state) == machine.apply(right, state) == machine.apply(machine.scan(maps)[-1], state)
    whole_run = machine.run(machine.start, "".join(texts))
    assert machine.apply(left, machine.start) == whole_run
    assert machine.tracks([0, 1, 2, 3, 2], "theringab") == {s: machine.run(s, "theringab") for s in range(4)}
    counts = machine.prefix_counts("the ring " * 200, 100)
    assert counts == [machine.run(machine.start, ("▁" + "the▁ring▁" * 200)[: k + 100])[1] for k in range(0, 1801, 100)]
    machine.forget()
    few, token_counts.MAX_STATES = token_counts.MAX_STATES, 10  # states are forgotten between groups of chunks
    assert [machine.count(t, 3) for t in many[-40:]] == [len(sp.encode(t)) for t in many[-40:]]
    token_counts.MAX_STATES = few
    got = [r for r in token_counts.token_counts(docs, P.path("piece_bpe_32k.model"), 100).collect() if r.doc_id == 9]
    assert got[0].over_limit and got[0].n_bytes == 15000


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(900, 8)), np.repeat(rng.normal(size=(1, 8)), 60, axis=0)]).astype(np.float32)
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(2000, None, ""), (2001, [0.0] * 8, ""), (2002, [float("nan")] * 8, ""), (None, [1.0] * 8, ""), (2003, [None] + [1.0] * 7, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, part string")
    asked = df.where("vec_id % 20 = 0")
    exact = [(q, r, i) for q in range(0, 960, 20) for r, i in enumerate([i for i in np.lexsort((np.arange(960), -np.cumsum(x.astype(float) * x[q].astype(float), axis=1)[:, -1])) if i != q][:20], 1)]
    for shard in (100, 8192):
        got = sorted((r.query_id, r["rank"], r.vec_id) for r in vector_search.nearest(df, asked, 20, 1.0, shard_rows=shard, block_rows=10).collect())
        assert got == exact
    loose = {(r.query_id, r.vec_id) for r in vector_search.nearest(df, asked, 20, 1.5).collect()}
    assert len(loose & {(q, i) for q, _, i in exact}) >= 0.9 * len(exact)
    assert vector_search.nearest(df.limit(0), asked).count() == 0 == vector_search.nearest(df, asked.limit(0)).count()


def test_exact_groups(spark, docs):
    by_text = {}
    for i, t in whole(docs):
        by_text.setdefault(t, []).append(i)
    largest = {t: max((i for i in ids if i is not None), default=None) for t, ids in by_text.items()}
    for source in (docs, spark.createDataFrame(docs.collect(), docs.schema)):
        got = exact_dedup.exact_groups(source).collect()
        assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == sorted((str(i), str(largest[t]), len(ids)) for t, ids in by_text.items() for i in ids)
        assert sum(r.kept for r in got) == len(by_text)
    kept = exact_dedup.without_copies(docs)
    assert kept.count() == len(by_text) and kept.columns == docs.columns
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def test_state_goes_on(spark, tmp_path):
    def feed(n, rows):
        spark.createDataFrame(rows, "digest binary, doc_id long, at struct<file: string, row: long>").write.mode("append").parquet(f"file://{tmp_path}/feed")
        return {bytes(r.digest): (r.n, r.keep.doc_id) for r in exact_dedup.seen(spark, f"file://{tmp_path}/feed", f"file://{tmp_path}/cp").collect()}

    assert feed(1, [(b"a", 1, ("f", 0)), (b"b", 2, ("f", 1))]) == {b"a": (1, 1), b"b": (1, 2)}
    assert feed(2, [(b"a", 7, ("g", 0))]) == {b"a": (2, 7), b"b": (1, 2)}


def reference_print(text, n):
    import xxhash

    words = text.encode().lower().split()
    shingles = [b" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_groups(spark, docs):
    rnd = random.Random(8)
    base = [rnd.choice("abcdefgh") * rnd.randint(1, 4) for _ in range(400)]
    near = []
    for k in range(60):
        w = list(base)
        for _ in range(k % 6):
            w[rnd.randrange(400)] = "changed"
        near.append((1000 + k, " ".join(w)))
    df = docs.select("doc_id", "text", "at", "node").unionByName(spark.createDataFrame(near, "doc_id long, text string").withColumn("at", F.lit("")).withColumn("node", F.lit("")))
    rows = whole(df)
    prints = [reference_print(t, 4) for _, t in rows]
    comp = list(range(len(rows)))

    def root(k):
        while comp[k] != k:
            k = comp[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            comp[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.groups(df, 4, 4, words=1).collect())
    assert got == sorted((str(i), f"{prints[k]:016x}", str(least.get(root(k)))) for k, (i, _) in enumerate(rows))
    wide = {r.doc_id: r.component_id for r in simhash.groups(df).collect()}
    assert all(wide[1000 + k] == 1000 for k in range(60) if k % 6 < 3)
    stay = simhash.without_near_copies(df)
    assert stay.columns == df.columns and stay.where("doc_id IS NULL").count() == 1
    assert simhash.groups(df.limit(0)).count() == 0


def test_forest_joins_what_is_near():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, dtype=np.uint64)
    rows = np.array([[centre ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), False)))] for _ in range(80)])
    edges = simhash.forest(rows, 4)
    parent = list(range(80))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in edges:
        parent[root(a)] = root(b)
    for a, b in itertools.combinations(range(80), 2):
        if int(rows[a][0] ^ rows[b][0]).bit_count() <= 4:
            assert root(a) == root(b)
    assert len(edges) < 80


def test_near_links_are_verified(spark):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghijkl") for _ in range(6))
    texts = []
    for changed in (8, 11):  # of 404 words: Jaccard similarities of 0.82 and 0.76
        for _ in range(30):
            w = [word() for _ in range(404)]
            v = list(w)
            for at in rnd.sample(range(6, 398, 7), changed):
                v[at] = word()
            texts += [" ".join(w), " ".join(v)]
    texts += ["a b c d e f " * 3, "A b c  d e f " * 3, "", "one two"]
    sets = [set(np.unique(simhash.shingle_hashes(t, 5)).tolist()) for t in texts]
    comp = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            comp[b] = comp[a]
    assert sum(c != k for k, c in enumerate(comp)) == 31
    got = {r.doc_id: r.component_id for r in simhash.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(comp))


def test_similar_sets_are_those_of_brute_force():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(40, 60), False), rng.integers(0, 2**63, rng.integers(0, 5)).astype(np.uint64)])) for _ in range(70)] + [np.zeros(0, np.uint64)]
    root = list(range(71))
    for a, b in simhash.similar(sets, 0.8):
        root[a] = b
    brute = list(range(71))
    for a, b in itertools.combinations(range(71), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both) and both:
            brute = [brute[a] if x == brute[b] else x for x in brute]
    assert all((root[a] == root[b]) == (brute[a] == brute[b]) for a, b in itertools.combinations(range(71), 2))


def test_components(spark):
    rnd = random.Random(9)
    edges = [(k, k + 1) for k in range(40)] + [(rnd.randint(100, 160), rnd.randint(100, 160)) for _ in range(50)] + [(5, 5), (7, 6)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: root(k) for k in parent if k not in alone}


def test_packing(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = sorted((str(i), zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 0][s : s + 64], "<u4").tobytes()), s) for i, x in whole(docs) for s in range(0, len(t.encode(x, add_special_tokens=False).ids) + 1, 64))
    got = packing.pack(docs, P.path("word_bpe_49k.json"), 0, 64).collect()
    assert sorted((str(r.doc_id), r.ids_crc32, r.start) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.1 * (sum(r.length for r in got) / 64) + 1
    assert packing.pack(docs.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_url_rules(spark):
    urls = [None, "", "nothing", "http://example.org/es/1", "https://WWW.Example.ORG/es", "http://a.example.org/en/12?x", "http://example.com/de/1#y", "ftp://x.com/fr/", "http://org", "http://org/", "://b.com/de/", "http://notexample.org/es/", "http://" + "a." * 500 + "com/fr/x"] * 2
    pages = spark.createDataFrame([(k if k else None, u, "x") for k, u in enumerate(urls)], "page_id long, url string, host string")
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

    def judge(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(h) + len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else (None, "allow")

    got = url_filter.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert sorted(str((r.page_id, r.rule, r.verdict)) for r in got) == sorted(str((k if k else None, *judge(u))) for k, u in enumerate(urls))
    shuffled = url_filter.judge(pages, spark.createDataFrame(rules * 2, "host string, path string, verdict string"), broadcast_bytes=0).collect()
    assert sorted(map(str, shuffled)) == sorted(map(str, got))
    none = url_filter.judge(pages, spark.createDataFrame([], "host string, path string, verdict string"), "block")
    assert {r.verdict for r in none.collect()} == {"block"}


@pytest.fixture(scope="module")
def labelled(spark):
    rnd = random.Random(12)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    rows = []
    for k in range(900):
        w = [rnd.choice(words) for _ in range(rnd.randint(20, 80))]
        toxic, junk = k % 9 == 0, k % 7 == 0
        if toxic:
            w[3:3] = [rnd.choice(["grimble", "snarkfoul", "wretchy"]) for _ in range(rnd.randint(1, 6))]
        if junk:
            w = [x + rnd.choice(["***", "%%%"]) for x in w]
        rows.append((k, " ".join(w), int(not junk), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int").repartition(4)
    odd = spark.createDataFrame([(9001, None), (9002, ""), (None, "no id"), (9003, "long " * 20000)], "doc_id long, text string")
    return df, df.select("doc_id", "text").unionByName(odd), df.where("doc_id % 2 = 0").select("doc_id", "quality", "toxic")


def test_quality(labelled):
    df, docs, labels = labelled
    got = {r.doc_id: r for r in quality.resample(docs, labels, 400).collect()}
    held = [(got[r.doc_id].kept, r.quality) for r in df.where("doc_id % 2 = 1").collect()]
    # a sample by importance, whose size has three standard errors on top of the good share
    assert sum(k for k, q in held if q) >= 0.97 * sum(q for _, q in held)
    assert sum(not k for k, q in held if not q) >= 0.5 * sum(not q for _, q in held)
    assert got[9002].n_ngrams == 0 and got[9001].weight == 0.0
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.resample(docs.limit(0), labels).count() == 0 and quality.resample(docs, labels.limit(0)).where("kept").count() == docs.count()


def test_quality_is_that_of_plain_counting(labelled):
    import math
    import re
    from collections import Counter

    import xxhash

    _, docs, labels = labelled

    def buckets(text):
        h = [xxhash.xxh64_intdigest(w.encode(), 7) for w in re.findall(r"\w+|[^\w\s]+", text)]
        mix = 0x9E3779B97F4A7C15
        pairs = [((a * mix) % 2**64 ^ b) * mix % 2**64 for a, b in itertools.pairwise(h)]
        return [x >> 50 for x in h + pairs]

    known = {r.doc_id: r.quality for r in labels.collect()}
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(buckets(t))
        if known.get(i):
            target.update(buckets(t))
    size = 1 << 14
    ratio = lambda b: math.log((target[b] + 1) / (target.total() + size)) - math.log((raw[b] + 1) / (raw.total() + size))
    good, n = sum(known.get(i, 0) for i, _ in rows), sum(i in known for i, _ in rows)
    k = math.ceil(min(1, good / n + 3 * math.sqrt(good / n * (1 - good / n) / n)) * len(rows))
    weights = [sum(map(ratio, buckets(t))) for _, t in rows]
    keys = [w - math.log(-math.log(quality.uniform(i, t, 17))) for w, (i, t) in zip(weights, rows, strict=True)]
    least = sorted(keys, reverse=True)[k - 1]
    got = {(r.doc_id, r.n_ngrams): r for r in quality.resample(docs, labels).collect()}
    assert len(got) == len(rows)
    for (i, t), w, key in zip(rows, weights, keys, strict=True):
        r = got[i, len(buckets(t))]
        assert r.weight == pytest.approx(w, abs=1e-6) and r.key == pytest.approx(key, abs=1e-6)
        assert r.kept == (key >= least) or abs(key - least) < 1e-6


def test_severity_is_that_of_a_plain_sum(labelled):
    import math
    import re

    import xxhash

    _, docs, labels = labelled
    model = toxicity.fit(docs, labels, 400)
    again = toxicity.fit(docs.unionByName(docs), labels, 400)  # repeated ids: one text each comes to the driver
    assert np.array_equal(model.weights, again.weights) and model.cut == again.cut
    assert (np.diff(model.thresholds) >= 0).all() and len(model.thresholds) >= 2
    found, names = toxicity.graded(docs, model)
    assert names == ("severity", "grade", "toxic")
    for r in found.collect():
        parts = {x for w in re.findall(r"\w+", (r.text or "").lower()) for x in (w, *(w[:k] + "*" for k in (4, 5) if len(w) > k))}
        own = {xxhash.xxh64_intdigest(x.encode(), 11) % (1 << 18) for x in parts}
        above = [1 / (1 + math.exp(t - sum(model.weights[b] for b in own))) for t in model.thresholds]
        assert r.severity == pytest.approx(sum(above), abs=1e-9)
        chances = [a - b for a, b in zip([1, *above], [*above, 0], strict=True)]
        assert chances[r.grade] == pytest.approx(max(chances), abs=1e-12)
        assert r.toxic == (r.severity >= model.cut and any(model.weights[b] > 0 for b in own))


def test_labels_of_one_kind(labelled):
    _, docs, labels = labelled
    for kind in (0, 1):
        assert not any(r.toxic for r in toxicity.severities(docs, labels.withColumn("toxic", F.lit(kind))).collect())


def test_kth_largest(spark):
    values = [random.Random(k).randint(-(2**62), 2**62) for k in range(200)] + [5, 5, 5, -1]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert [quality.kth_largest(df, "v", k) for k in (1, 77, 204)] == [sorted(values, reverse=True)[k - 1] for k in (1, 77, 204)]


def test_toxicity(labelled):
    df, docs, labels = labelled
    got = {r.doc_id: r for r in toxicity.severities(docs, labels, 400).collect()}
    held = [(got[r.doc_id].toxic, r.toxic) for r in df.where("doc_id % 2 = 1").collect()]
    assert sum(t == bool(x) for t, x in held) >= 0.97 * len(held)
    assert all(0 <= r.severity <= 3 for r in got.values()) and not got[9002].toxic
    kept = toxicity.without_toxic(docs, labels, 400)  # the same model as above
    assert kept.columns == docs.columns and kept.count() == docs.count() - sum(r.toxic for r in got.values())
    assert toxicity.severities(docs.limit(0), labels).count() == 0
    assert not any(r.toxic for r in toxicity.severities(docs, labels.limit(0)).collect())


def test_unit_encoding():
    from tokenizers import Tokenizer

    rnd = random.Random(1)
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        encoder, plain = unit_encoding.LibraryEncoder(P.path(name)), Tokenizer.from_file(P.path(name))
        assert encoder.kind != "whole"
        for _ in range(400):
            t = "".join(rnd.choice("abÀé  \n\t'1²!.中Q") for _ in range(rnd.randint(0, 50)))
            assert np.frombuffer(encoder.packed(t), encoder.code).tolist() == plain.encode(t, add_special_tokens=False).ids


def test_oracles_run():
    from strandlake.llm import queries

    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    assert all(len(c.sql(q).df()) for q in queries.oracle_sql().values())


def brute_nearest(x, ids, asked, k):
    out = []
    for q in asked:
        scores = np.cumsum(x.astype(float) * x[q].astype(float), axis=1)[:, -1]
        out += [(int(ids[q]), r, int(i), float(s)) for r, (s, i) in enumerate(sorted(((s, i) for s, i in zip(scores, ids, strict=True) if i != ids[q]), key=lambda p: (-p[0], p[1]))[:k], 1)]
    return sorted(out)


def test_nearest_keeps_all_ties(spark):
    rng = np.random.default_rng(5)
    ids = rng.permutation(700)
    one_hot = np.eye(32, dtype=np.float32)[rng.integers(0, 32, 700)] + np.float32(0.25) * np.eye(32, dtype=np.float32)[rng.integers(0, 32, 700)]
    hot = one_hot.copy()
    hot[::3] = one_hot[0]  # one vector is a third of all rows
    asked = np.flatnonzero(ids % 20 == 0)
    for x in (one_hot, hot):
        df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)] + [(5000, [1.0, 2.0])], "vec_id long, embedding array<float>").repartition(3)
        for rows in (None, 60):
            got = vector_search.nearest(df, df.where("vec_id % 20 = 0"), 20, 1.0, shard_rows=rows, block_rows=16).collect()
            assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_nearest(x, ids, asked, 20)


def test_balls_rule_out_whole_shards(spark):
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(30, 24)), 40, axis=0) + 0.05 * rng.normal(size=(1200, 24))
    x *= rng.uniform(0.5, 40, size=(1200, 1))
    ids = np.arange(1200)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    asked = np.flatnonzero(ids % 20 == 0)
    exact = brute_nearest(x, ids, asked, 10)
    got = sorted(tuple(r) for r in vector_search.nearest(df, df.where("vec_id % 20 = 0"), 10, 1.0, shard_rows=100, block_rows=30).select("query_id", "rank", "vec_id", "score").collect())
    assert got == exact
    loose = {(r.query_id, r.vec_id) for r in vector_search.nearest(df, df.where("vec_id % 20 = 0"), 10, 1.3, shard_rows=100, block_rows=30).collect()}
    assert len(loose & {(q, i) for q, _, i, _ in exact}) >= 0.9 * len(exact)


def test_packing_is_near_to_best_fit_of_all(spark):
    rnd = random.Random(21)
    texts = ["" if rnd.random() < 0.1 else " ".join("ab"[rnd.random() < 0.5] for _ in range(int(rnd.lognormvariate(4, 1)))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    lengths = []
    for x in texts:
        n = len(t.encode(x, add_special_tokens=False).ids) + 1
        lengths += [256] * (n // 256) + [n % 256] * (n % 256 > 0)
    whole = len(packing.best_fit(np.array(lengths), 256)[2])
    for parts in (1, 20):
        got = packing.pack(df.repartition(parts), P.path("word_bpe_49k.json"), 0, 256).collect()
        bins = {}
        for r in got:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert all(o == s for b in bins.values() for (o, n), s in zip(sorted(b), itertools.accumulate((n for _, n in sorted(b)), initial=0), strict=False))
        assert sorted(r.length for r in got) == sorted(lengths) and max(sum(n for _, n in b) for b in bins.values()) <= 256
        assert len(bins) <= 1.01 * whole + 1


def test_best_fit_is_that_of_a_plain_search():
    rnd = random.Random(22)
    lengths = np.array([rnd.randint(1, 64) for _ in range(300)])
    bin_of, offset, fills = packing.best_fit(lengths, 64)
    plain = []
    for n in sorted(lengths.tolist(), reverse=True):
        fitting = [k for k, f in enumerate(plain) if f + n <= 64]
        if fitting:
            plain[max(fitting, key=lambda k: plain[k])] += n
        else:
            plain.append(n)
    assert sorted(fills.tolist()) == sorted(plain)
    for b in range(len(fills)):
        own = sorted((int(offset[i]), int(lengths[i])) for i in np.flatnonzero(bin_of == b))
        assert [o for o, _ in own] == [0, *itertools.accumulate(n for _, n in own)][:-1]


def test_texts_of_one_digest_are_split_by_their_bytes(spark, docs, tmp_path):
    rows = exact_dedup.texts(exact_dedup.located(docs, f"file://{tmp_path}/docs", "place"), "doc_id", "text", "place")
    got = exact_dedup._groups(rows, f"file://{tmp_path}/own", lambda t: F.unhex(F.sha2(F.substring(t, 1, 1), 256))).collect()
    by_text = {}
    for i, t in whole(docs):
        by_text.setdefault(t, []).append(i)
    largest = {t: max((i for i in ids if i is not None), default=None) for t, ids in by_text.items()}
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == sorted((str(i), str(largest[t]), len(ids)) for t, ids in by_text.items() for i in ids)
    assert sum(r.kept for r in got) == len(by_text)


def test_near_links_are_found(spark):
    """Recall of links at similarities from 0.8 on, of the tables alone and with prefixes."""
    rnd = random.Random(31)
    texts, linked = [], 0
    for k in range(220):
        n = rnd.choice([40, 120, 400])
        w = [f"{rnd.getrandbits(40):x}" for _ in range(n)]
        v = list(w)
        for at in rnd.sample(range(n), max(1, rnd.randint(n // 100, n // 40))):
            v[at] = "changed"
        a, b = (set(zip(*(x[i:] for i in range(5)), strict=False)) for x in (w, v))
        linked += len(a & b) >= 0.8 * len(a | b)
        texts += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    assert linked >= 100
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for complete, probes, least in ((False, 6, 0.97), (True, 2, 1.0), (True, 0, 1.0)):
        found = simhash.groups(df, complete=complete, probes=probes).where("component_id != doc_id").collect()
        assert all(r.component_id == r.doc_id - 1 for r in found) and least * linked <= len(found) <= linked
    load = np.zeros(1 << simhash.LOAD_BITS, np.int64)
    assert simhash.prefix(np.arange(10, dtype=np.uint64), 0.8, load).tolist() == [0, 1, 2] and len(simhash.prefix(np.zeros(0, np.uint64), 0.8, load)) == 0
    load[0] = 5  # the bucket of small hashes is a common one
    assert simhash.prefix(np.array([1, 2, 3, 1 << 60, 1 << 61], np.uint64), 0.8, load).tolist() == [1 << 60, 1 << 61]


def test_sieve_never_misses(spark):
    from strandlake.llm._common import sieved

    rows, among = spark.range(3000).withColumn("bucket", F.lit(1)), spark.range(0, 3000, 7)
    got = sieved(rows, F.xxhash64("id"), among, F.xxhash64("id"), among.count(), "maybe")
    assert got.columns == ["id", "bucket", "maybe"] and got.count() == 3000
    assert got.where("maybe AND id % 7 = 0").count() == among.count() and got.where("maybe AND id % 7 != 0").count() < 300
    assert sieved(rows, F.xxhash64("id"), among.limit(0), F.xxhash64("id"), 0, "maybe").where("maybe").count() == 0

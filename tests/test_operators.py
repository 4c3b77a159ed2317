import math
import random

from pyspark.sql import functions as F

from strandlake.operators import barcodes, clustering, consensus, filters, intervals, pairs, pore, primers, stats, umi


def test_merge_and_overlap(spark):
    i = spark.createDataFrame([("c", -5, 10), ("c", 5, 20), ("c", 40, 60)], "chrom string, start long, end long")
    merged = intervals.merge_intervals(i, spark.createDataFrame([("c", 50)], "chrom string, len long"))
    assert sorted((r.start, r.end) for r in merged.collect()) == [(0, 20), (40, 50)]
    blocks = spark.createDataFrame([(1, "c", 10, 20), (1, "c", 30, 40)], "k long, chrom string, start long, end long")
    target = spark.createDataFrame([("c", 15, 35)], "chrom string, start long, end long")
    assert intervals.interval_overlap(blocks, target, "k").first().overlap == 10


def test_overlap_join_counts_each_pair_once(spark):
    rnd = random.Random(3)
    a = [(k, "c", s, s + rnd.randint(1, 90)) for k, s in enumerate(rnd.randint(0, 500) for _ in range(60))]
    b = [(k, "c", s, s + rnd.randint(1, 90)) for k, s in enumerate(rnd.randint(0, 500) for _ in range(60))]
    got = intervals.overlap_join(spark.createDataFrame(a, "a long, chrom string, start long, end long"), spark.createDataFrame(b, "b long, chrom string, r_start long, r_end long"), size=16)
    assert sorted((r.a, r.b) for r in got.collect()) == sorted((x[0], y[0]) for x in a for y in b if x[2] < y[3] and y[2] < x[3])


def test_pore_idle(spark):
    rows = [(1, 2, 0.0, 10.0, 1), (1, 2, 20.0, 30.0, 2), (1, 2, 102.0, 110.0, 3), (2, 1, 0.0, 50.0, 4), (2, 1, 40.0, 60.0, 5)]
    t = spark.createDataFrame(rows, "ch long, mx long, start_s double, end_s double, ord long")
    got = pore.pore_idle(t).collect()
    assert [(r.ch, r.mx, r.idle_count, r.mean_idle_s, r.long_idles) for r in got] == [(1, 2, 2, 41.0, 1), (2, 1, 1, 0.0, 0)]
    assert pore.pore_idle_total(t.limit(0)).first().long_idle_pct == 0


def test_summary_verdicts(spark):
    s = spark.createDataFrame([("a", "barcode01", 80.0, 80.0, 12.0), ("b", "barcode01", 80.0, None, 9.0), ("c", "barcode02", 80.0, 80.0, 9.0)], "read_id string, barcode string, front_score double, rear_score double, qscore double")
    r = spark.createDataFrame([(x,) for x in "abcd"], "read_id string")
    got = {x.read_id: x.verdict for x in filters.summary_select(r, s, "barcode01", 60.0).collect()}
    assert got == {"a": "Keep", "b": "NotBothEnds", "c": "OtherBarcode", "d": "NotInSummary"}
    assert {x.verdict for x in filters.summary_select(r, s).collect()} == {"Keep"}


def test_upper_median(spark):
    for n in (4, 5):
        assert stats.distribution_stats(spark.range(1, n + 1), "id").first().median == 3
    assert stats.distribution_stats(spark.range(0), "id").first().median == 0


def test_star_clustering_is_the_sequential_one(spark):
    rnd = random.Random(5)
    keys = list(dict.fromkeys("".join(rnd.choice("ACGT") for _ in range(rnd.randint(5, 7))) for _ in range(120)))

    def distance(a, b):
        return umi._levenshtein(a, b, 99)

    centres, want = [], {}
    for k in keys:
        near = [c for c in centres if distance(c, k) <= 2]
        want[k] = near[0] if near else k
        centres += [] if near else [k]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, ord long").repartition(3)
    assert {r.key: r.centre for r in clustering.star_clusters(df, 2).collect()} == want


def test_families(spark):
    rows = [(f"r{i}", i, "ACGT" if i % 13 < 10 else "TTTT", "fwd" if i % 5 < 3 else "rev") for i in range(130)]
    keyed = spark.createDataFrame(rows, "read_id string, ord long, key string, strand string")
    fam = umi.families_exact(keyed)
    assert sorted(r["count"] for r in fam.groupBy("family").count().collect()) == [30, 100]
    cut = umi.family_filter(fam.withColumn("consensus_umi", F.col("key")), 2, 80)
    assert {r.id_cluster: r["written"] for r in umi.family_stats(cut, 2, 80).collect()} == {0: 80, 1: 30}
    even = umi.family_filter(fam.where("key = 'ACGT'"), 2, 80, balance=True).where("written")
    assert all(r["count"] <= 40 for r in even.groupBy("strand").count().collect())


def test_detect_umi_both_strands():
    c = umi.UmiConfig("AAGCAGTGGTATCAACGCAGAGT", "TTCGATCGGCATTACGGATCCAA", "NNNYRNNNYR", "NNNYRNNNYR", min_umi=10, max_umi=14)
    fwd, rev = "ACGTACGTCA", "GGGCATTTCA"
    read = "CC" + c.fwd_context + fwd + "ACGT" * 200 + c.rev_context + rev + "GG"
    got = umi.detect(read, 20, c)
    assert (got["strand"], got["umi_fwd"], got["umi_rev"], got["combined"]) == ("fwd", fwd, rev, fwd + rev)
    assert umi.detect("A" * 500, 20, c) is None


def test_umi_pipeline_groups_reads_of_one_molecule(spark):
    c = umi.UmiConfig("AAGCAGTGGTATCAACGCAGAGT", "TTCGATCGGCATTACGGATCCAA", "NNNYRNNNYR", "NNNYRNNNYR", min_umi=10, max_umi=14)

    def read(fwd, rev):
        return "CC" + c.fwd_context + fwd + "ACGT" * 100 + c.rev_context + rev + "GG"

    one, other = read("ACGTACGTCA", "GGGCATTTCA"), read("TTTCGAAACG", "CCCTACCCTG")
    rows = [("r0", 0, one), ("r1", 1, other), ("r2", 2, one), ("r3", 3, one), ("r4", 4, "A" * 500), ("r5", 5, None)]
    reads = spark.createDataFrame(rows, "read_id string, ord long, seq string").withColumn("mean_q", F.lit(20.0))
    got = {r.read_id: (r.family, r.written) for r in umi.umi_pipeline(reads, c, 2, 2, 2).collect()}
    assert got == {"r0": (0, True), "r2": (0, True), "r3": (0, False), "r1": (1, False)}


def test_consensus():
    assert consensus.align_to("ACGTAC", "ACTAC", 2) == "AC-TAC"
    seq, q = consensus.vote(["ACGTACGT", "ACGTACGT", "ACGAACGT"])
    assert seq == "ACGTACGT" and q[3] == 5 and q[0] == 60


def test_make_pe(spark):
    r = spark.createDataFrame([("a", "ACGT" * 150, "I" * 600), ("b", "A" * 302, "I" * 302), ("c", "A" * 10, "I" * 10)], "read_id string, seq string, qual string")
    assert pairs.make_pe(r.where("read_id = 'a'"), 300, 150, 300).count() == 2
    assert pairs.make_pe(r.where("read_id = 'b'"), 300, 150, 1).count() == 3
    assert tuple(pairs.pe_summary(r, 300, 300).first()) == (3, 3, 1)


def test_primer_errors_and_chimeras(spark):
    p = [primers.Primer("AMP_fwd", "TTACGGATCCAAGCTGATCG"), primers.Primer("AMP_rev", "GGCATTCAGGACTTACGATC")]

    def read(errors):
        head = list(p[0].seq)
        for k in range(errors):
            head[4 + 5 * k] = {"A": "C", "C": "A", "G": "T", "T": "G"}[head[4 + 5 * k]]
        return "AC" + "".join(head) + "ACCA" * 60 + primers._flip(p[1].seq) + "CA"

    r = spark.createDataFrame([(f"r{e}", read(e), e) for e in range(4)], "read_id string, seq string, errors int")
    for most in range(4):
        assert primers.primer_match(r, p, most, 60).where("amplicon = 'AMP_fwd-AMP_rev'").count() == most + 1
    one = "ACCA" * 62
    two = spark.createDataFrame([("x", one[:-1] + p[0].seq + one, "I" * (2 * len(one) + 19)), ("y", one, "I" * len(one))], "read_id string, seq string, qual string")
    got = sorted((x.read_id, len(x.seq) == len(x.qual)) for x in primers.chimera_split(two, p[:1], 0, 150).collect())
    assert got == [("x_split1", True), ("x_split2", True), ("y", True)]


def test_long_umis_are_cut_to_their_pattern():
    from strandlake.operators import umi

    c = umi.UmiConfig("ACGTACGTAC", "TTGCATTGCA", "NNNTNNN", "NNNTNNN", max_edit=2, window=60, min_umi=2, gate=False)
    assert umi._wildcards("AACTGGACC", "NNNTNNN") == "AACGGA" and umi._wildcards("AACTG", "NNNTNNN") is None
    assert umi._wildcards("AACTGGA", "NNNTNNN") == umi._wildcards("AACTGGACC", "NNNTNNN")
    seq = "GG" + c.fwd_context + "AACTGGA" + "G" * 100 + c.rev_context + "CCATAAC" + "GG"
    found = umi.detect(seq, 20.0, c)
    assert found["combined"] == "AACTGGACCATAAC" and found["normalized"] == "AACGGACCAAAC"
    plain = umi.detect(seq, 20.0, umi.UmiConfig(**{**c.__dict__, "normalize": False}))
    assert plain["normalized"] == plain["combined"] == found["combined"]


def test_umi_families_are_those_of_a_plain_search(spark):
    """umi_pipeline and the form by identity, against greedy clustering of all reads one after the other."""
    import random

    from strandlake.operators import umi

    rnd = random.Random(14)
    centres = ["".join(rnd.choices("ACGT", k=rnd.choice([10, 12, 14]))) for _ in range(12)]
    keys = []
    for _ in range(150):
        k = list(rnd.choice(centres))
        for _ in range(rnd.randint(0, 3)):
            k[rnd.randrange(len(k))] = rnd.choice("ACGT")
        keys.append("".join(k)[: rnd.choice([9, 14])])

    def edits(a, b):
        return umi._levenshtein(a, b, 99)

    def greedy(near):
        heads, out = [], []
        for k in keys:
            hit = next((i for i, h in enumerate(heads) if near(h, k)), None)
            if hit is None:
                hit = len(heads)
                heads.append(k)
            out.append(hit)
        return out

    df = spark.createDataFrame(list(enumerate(keys)), "ord long, key string").repartition(3)
    got = {r.ord: r.family for r in umi.families_approx(df, 3).collect()}
    assert [got[k] for k in range(150)] == greedy(lambda h, k: edits(h, k) <= 3)
    for identity in (0.75, 0.9):
        got = {r.ord: r.family for r in umi.families_identity(df, identity).collect()}
        assert [got[k] for k in range(150)] == greedy(lambda h, k: edits(h, k) <= (1 - identity) * max(len(h), len(k)) + 1e-9)


def test_consensus_of_one_read_and_of_unclear_letters(spark):
    from strandlake.operators import consensus

    df = spark.createDataFrame([(1, 0, "ACGNT", "5678!"), (2, 0, "ACGT", "IIII"), (2, 1, "ANNN", "IIII"), (2, 2, "ACGU", "IIII"), (3, 0, "AC", None)], "family long, ord long, seq string, qual string")
    got = {r.family: r for r in consensus.consensus_vote(df).collect()}
    assert (got[1].sequence, got[1].quality) == ("ACGNT", "5678!") and (got[3].sequence, got[3].quality) == ("AC", None)
    third = chr(33 + 5)  # two of three: -10 log10(1/3)
    assert (got[2].sequence, got[2].quality) == ("ACGT", chr(33 + 60) + third * 3)
    votes = {(r.family, r.col): r for r in consensus.column_votes(consensus.read_columns(df)).collect()}
    assert (votes[2, 1].base, votes[2, 1].support, votes[2, 1].total, votes[2, 1].quality) == ("C", 2, 3, 5) and votes[1, 3].base == "-"


def test_report_and_updates(spark):
    from strandlake.operators import primers, variants

    m = spark.createDataFrame([("r1", 500, 9.0, "X", "p1", "p2", 0, 1), ("r2", 600, 9.0, "X", "p1", None, 2, None), ("r3", 10, 9.0, None, None, None, None, None)], "read_id string, length int, qs double, amplicon string, start_primer string, end_primer string, start_dist int, end_dist int")
    r = primers.amplicon_report(m, 100, 1000, 7).collect()
    assert len(r) == 1 and (r[0].counters.raw, r[0].counters.with_pair) == (3, 2)
    assert [(a.amplicon, a["count"]) for a in r[0].amplicons] == [("X", 2)] and [(p.primer, p.matches) for p in r[0].primers] == [("p1", 2), ("p2", 1)]
    names = spark.createDataFrame([("r1", "Y_CONCAT"), ("r2", "Z")], "read_id string, name string")
    got = {x.read_id: (x.amplicon, x.concatemer) for x in variants.update_amplicons(m.select("read_id", "amplicon"), names).collect()}
    assert got["r1"] == ("Y", True) and got["r2"] == ("Z", False) and got["r3"][0] is None


def test_overlaps_by_bins_and_by_join_agree(spark, monkeypatch):
    import random

    from strandlake.operators import intervals

    rnd = random.Random(8)
    at = sorted(rnd.sample(range(0, 200_000), 60))
    targets = spark.createDataFrame([("c1", a, b) for a, b in zip(at[::2], at[1::2], strict=True)] + [("c2", 0, 70_000)], "chrom string, start long, end long")
    reads = [(k, rnd.choice(["c1", "c2", "c3"]), [(s, s + rnd.randint(0, 40_000)) for s in sorted(rnd.sample(range(0, 250_000), 3))], 1) for k in range(200)]
    df = spark.createDataFrame(reads, "read_id long, chrom string, blocks array<struct<start: long, end: long>>, pore int").withColumn("pos", F.col("blocks.start")[0])
    own = {(r.chrom, r.start, r.end) for r in targets.collect()}
    want = {k: sum(max(0, min(e, y) - max(s, x)) for s, e in blocks for c2, x, y in own if c == c2) for k, c, blocks, _ in reads}
    blocks = df.select("read_id", "chrom", F.explode("blocks").alias("b")).select("read_id", "chrom", "b.start", "b.end")
    for limit in (32 << 20, 0):
        monkeypatch.setattr(intervals, "BROADCAST_BYTES", limit)
        assert {r.read_id: r.on_bases for r in intervals.on_target(df, targets).collect()} == {k: v for k, v in want.items() if sum(e - s for s, e in reads[k][2])}
        assert {r.read_id: r.overlap for r in intervals.interval_overlap(blocks, targets, "read_id").collect()} == {k: v for k, v in want.items() if v}


def test_ends_and_discovery(spark):
    from strandlake.operators import discovery

    rnd = random.Random(17)
    base = lambda n: "".join(rnd.choices("ACGT", k=n))
    adapter = base(24)
    df = spark.createDataFrame([("m", "c1", "3H5S10M4S", "AAAAACCCCCGGGGGTTTT"), ("u", None, None, adapter + "ACGT" * 10), ("e", None, None, "")], "read_id string, chrom string, cigar string, seq string")
    got = {r.read_id: r for r in discovery.biological_ends(df, 6, adapter).collect()}
    assert (got["m"].start_region, got["m"].end_region, got["m"].begins_at, got["m"].ends_at) == ("CCCCCG", "CGGGGG", 5, 15)
    assert (got["u"].start_region, got["u"].end_region) == ("ACGTAC", "GTACGT") and got["e"].start_region is None
    assert discovery.biological_ends(df, 6, adapter_end=2).where("read_id = 'u'").first().start_region == adapter[2:8]

    ends = [(base(30), base(30)) for _ in range(3)]
    close = (ends[0][0][:-1] + ("A" if ends[0][0][-1] != "A" else "C"), ends[0][1])  # a variant of the first, one edit away
    reads, truth = [], {}
    for k in range(160):
        kind = k % 5 if k % 5 < 4 else 1
        a, b = [*ends, close][kind]
        reads.append((f"r{k}", base(k % 3 if k % 11 == 0 else 0) + a + base(80) + b))
        truth[f"r{k}"] = 0 if kind == 3 else kind
    reads += [(f"x{k}", base(140)) for k in range(10)]
    found = {r.read_id: r.amplicon for r in discovery.discover_amplicons(spark.createDataFrame(reads, "read_id string, seq string")).collect()}
    assert all(found[f"x{k}"] is None for k in range(10))
    assert len({(found[r], t) for r, t in truth.items()}) == 3 and {found[r] for r in truth} == {"D1", "D2", "D3"}
    assert found["r2"] == "D3" and discovery.merged_pairs([("ACGTACGTAC", "A" * 10), ("ACGTACGTAA", "A" * 10), ("T" * 10, "A" * 10)], [5, 9, 1]) == [1, 1, 2]


def test_lanes_are_those_of_a_plain_search(spark):
    rnd = random.Random(12)
    rows = [(k, rnd.choice("ab"), s, s + rnd.randint(1, 40)) for k, s in enumerate(rnd.randint(0, 300) for _ in range(80))]
    want, ends = {}, {"a": [], "b": []}
    for k, by, start, end in sorted(rows, key=lambda r: (r[2], r[3], r[0])):
        lane = next((x for x, last in enumerate(ends[by]) if last + 5 <= start), len(ends[by]))
        ends[by][lane:lane + 1] = [end]
        want[k] = lane
    got = intervals.lane_assign(spark.createDataFrame(rows, "ord long, region string, start long, end long"), "region")
    assert {r.ord: r.lane for r in got.collect()} == want


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_duplex_pairs_are_those_of_a_plain_search(spark):
    rnd, flip = random.Random(13), str.maketrans("ACGT", "TGCA")
    rows, tail = [], ""
    for k in range(60):
        head = "".join(rnd.choices("ACGT", k=60))
        if rnd.random() < 0.6 and tail:
            head = "".join(rnd.choice("ACGT") if rnd.random() < 0.1 else c for c in tail[::-1].translate(flip))
        tail = "".join(rnd.choices("ACGT", k=60)) if rnd.random() < 0.7 else head[::-1].translate(flip)
        rows.append((f"r{k:02}", k // 30, 1, float(k), rnd.choice([800, 1000, 1400]), head, tail))
    want = set()
    for pore_id in (0, 1):
        own = [r for r in rows if r[1] == pore_id]
        k = 0
        while k + 1 < len(own):
            a, b = own[k], own[k + 1]
            like = 1 - plain_distance(a[6], b[5][::-1].translate(flip)) / 60
            hit = b[4] <= a[4] + 500 and like > 0.7
            if hit:
                want.add((pore_id, a[0], b[0], round(like, 9)))
            k += 2 if hit else 1
    got = pairs.duplex_pairs(spark.createDataFrame(rows, "read_id string, ch long, mx long, start_s double, length long, head string, tail string"))
    assert {(r.ch, r.first, r.second, round(r.identity, 9)) for r in got.collect()} == want
    assert len(want) > 5


def test_density_is_near_to_that_of_all_values(spark):
    rnd = random.Random(14)
    values = [rnd.gauss(300, 40) for _ in range(400)] + [rnd.gauss(700, 60) for _ in range(200)]
    n, mean = len(values), sum(values) / len(values)
    width = (sum((v - mean) ** 2 for v in values) / (n - 1)) ** 0.5 * n ** (-1 / 5)
    got = stats.kde_density(spark.createDataFrame([(v,) for v in [*values, None]], "v double"), "v", 0.0, 1000.0, 51).collect()
    assert sorted(r.x for r in got) == [20.0 * k for k in range(51)]
    for r in got:
        exact = sum(math.exp(-(((r.x - v) / width) ** 2) / 2) for v in values) / (n * width * (2 * math.pi) ** 0.5)
        assert abs(r.density - exact) < 2e-5
    one = spark.createDataFrame([(1.0,)], "v double")
    assert stats.kde_density(one, "v", 0.0, 1.0).count() == 0


def test_barcode_matches_are_those_of_a_plain_search(spark):
    rnd, flip = random.Random(15), str.maketrans("ACGT", "TGCA")
    turned = lambda s: s[::-1].translate(flip)
    sheet = [(f"s{k}", *("".join(rnd.choices("ACGT", k=10)) for _ in range(2))) for k in range(4)]
    rows = []
    for k in range(60):
        _, a, b = rnd.choice(sheet)
        a, b = rnd.choice([(a, turned(b)), (b, turned(a)), (a, a), (b, a), (turned(a), turned(b)), (a, b), ("", "")])
        a, b = ("".join(rnd.choice("ACGT") if rnd.random() < 0.08 else c for c in s) for s in (a, b))
        rows.append((f"r{k:02}", "".join(rnd.choices("ACGT", k=12)) + a + "".join(rnd.choices("ACGT", k=60)) + b + "".join(rnd.choices("ACGT", k=9))))
    reads = spark.createDataFrame([*rows, ("short", "ACG"), ("none", "")], "read_id string, seq string").withColumn("start_region", F.left("seq", F.lit(30))).withColumn("end_region", F.right("seq", F.lit(30)))

    def substitutions(text, tag):
        return min((sum(x != y for x, y in zip(text[i : i + 10], tag, strict=True)) for i in range(len(text) - 9)), default=99)

    fast = {}
    for read, seq in rows:
        totals = []
        for k, (sample, a, b) in enumerate(sheet):
            kinds = {"bc1": a, "bc2": b, "bc1rc": turned(a), "bc2rc": turned(b)}
            for x, y in barcodes.PAIRS:
                d, e = substitutions(seq[:30], kinds[x]), substitutions(seq[-30:], kinds[y])
                if d <= 1 and e <= 1:
                    totals.append((d + e, k, sample))
        fast[read] = min(totals)[::2] if totals else (None, None)
    got = {r.read_id: (r.dist, r.sample) for r in barcodes.barcode_fast_match(reads, sheet).collect()}
    assert got == fast | {"short": (None, None), "none": (None, None)}
    assert len({s for _, s in fast.values()}) == 5

"""Queries over whole sequences and tables, against their SQL or against brute force."""

import random

import duckdb
import pytest

from strandlake.functions import alignment
from strandlake.operators import barcodes, consensus
from strandlake.plans import queries as Q


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """A folder of texts of which all begin alike and few end alike (a B becomes the base C), and of variants at all places."""
    rnd, path = random.Random(21), tmp_path_factory.mktemp("whole")
    base = "".join(rnd.choices("ACGT", k=400))
    texts = []
    for k in range(40):
        t = "AAA" + "C" * 60 + "".join(rnd.choice("ACGT") if rnd.random() < 0.04 else c for c in base[: rnd.randint(150, 400)])
        texts.append(t[:120] + "TTACAGATCGAC"[: 12 - k % 5] + t[120:] if k % 2 else t)
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, 'en', ?)", [(k, t and t.replace("C", "B"), f"s{k % 2}") for k, t in enumerate([*texts, "", "AC", None])])
    c.execute("CREATE TABLE lineitem AS SELECT i AS l_orderkey, 1 + i * 7 % 200 AS l_partkey, i % 10 AS l_suppkey, CAST(i % 7 AS INTEGER) AS l_linenumber, substr('ANR', CAST(i % 3 + 1 AS INTEGER), 1) AS l_returnflag, 0.5 AS l_discount FROM range(300) AS r(i)")
    for t in ("documents", "lineitem"):
        c.execute(f"COPY {t} TO '{path}/{t}.parquet' (FORMAT parquet)")
    return str(path), c


def got(spark, tables, name):
    return [tuple(r) for r in Q.QUERIES[name](spark, tables[0]).collect()]


def wanted(tables, name):
    return tables[1].execute(Q.ORACLES[name]).fetchall()


def rows(found):
    return sorted(found, key=repr)


@pytest.mark.parametrize("name", ["semiglobal_distance", "semiglobal_native", "semiglobal_find"])
def test_primers_are_found_anywhere(spark, tables, name):
    found = got(spark, tables, name)
    assert rows(found) == rows(wanted(tables, name))
    assert sum(r[1] == 0 for r in found) >= 4


def test_long_texts_are_matched_across_pieces():
    rnd, pattern = random.Random(5), "TTACAGATCGAC"
    texts = ["C" * at + pattern[: 12 - k % 4] + "C" * rnd.randint(0, 3000) for k, at in enumerate([0, 1, 1012, 1013, 1018, 1023, 1024, 1025, 2040, 5000])] + [""]
    for text, d, e in zip(texts, *alignment.sellers(texts, pattern), strict=True):
        row, best = list(range(13)), (12, 0)
        for j, c in enumerate(text, 1):
            last, row[0] = row[0], 0
            for i, p in enumerate(pattern, 1):
                last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (c != p))
            best = min(best, (row[12], j))
        assert (d, e) == best


def test_consensus_votes_over_whole_reads(spark, tables):
    path, c = tables
    members = c.execute(f"{Q.FILTERED} SELECT family, list(seq ORDER BY ord) FROM w JOIN {Q.READS} USING (read_id, ord) WHERE written GROUP BY family").fetchall()
    want = {f: consensus.vote(seqs)[0].replace("-", "") for f, seqs in members}
    assert {r[0]: r[1] for r in got(spark, tables, "consensus_vote")} == want
    assert max(map(len, want.values())) > 300


def test_column_votes_over_whole_reads(spark, tables):
    found = got(spark, tables, "column_votes")
    assert rows(found) == rows(wanted(tables, "column_votes"))
    assert max(r[1] for r in found) > 300


def test_long_reads_are_voted_whole(spark):
    rnd = random.Random(6)
    seq = "".join(rnd.choices("ACGT", k=24_000))
    reads = [(1, k, seq[: 6_000 * k] + seq[6_000 * k + k :]) for k in range(4)]
    assert consensus.consensus_vote(spark.createDataFrame(reads, "family long, ord long, seq string")).first()["sequence"] == seq


def test_alignment_is_that_of_the_whole_matrix():
    rnd = random.Random(7)
    for _ in range(300):
        a = "".join(rnd.choices("ACGT", k=rnd.randint(0, 30)))
        q = "".join(c for c in a if rnd.random() > 0.2) if rnd.random() < 0.5 else "".join(rnd.choices("ACGT", k=rnd.randint(0, 30)))
        n, m = len(a), len(q)
        s = [[-2 * (i + j) for j in range(m + 1)] for i in range(n + 1)]
        for i in range(1, n + 1):
            for j in range(1, m + 1):
                s[i][j] = max(s[i - 1][j - 1] + (1 if a[i - 1] == q[j - 1] else -1), s[i - 1][j] - 2, s[i][j - 1] - 2)
        out, i, j = ["-"] * n, n, m
        while i and j:
            if s[i][j] == s[i - 1][j - 1] + (1 if a[i - 1] == q[j - 1] else -1):
                i, j = i - 1, j - 1
                out[i] = q[j]
            elif s[i][j] == s[i - 1][j] - 2:
                i -= 1
            else:
                j -= 1
        assert consensus.align_to(a, q) == "".join(out) == consensus.align_to(a, q, 30)


def test_pileup_of_whole_reads(spark, tables):
    found = got(spark, tables, "pileup_variants")
    assert rows(found) == rows(wanted(tables, "pileup_variants"))
    assert max(r[1] for r in found) > 60


def test_all_variants_are_sorted(spark, tables):
    found = got(spark, tables, "sort_outputs")
    # rows that only differ in columns left out may come in any order, but are equal
    assert found == wanted(tables, "sort_outputs")
    assert len(found) == 300


def pocket_reads():
    """Anchors at all places about the last 150 bases' begin, so that some pockets don't fit and another way has one."""
    rnd, anchors = random.Random(9), [barcodes.BC1_FWD, barcodes.BC1_REV, barcodes.BC2_FWD, barcodes.BC2_REV]
    seqs = ["", "ACG", barcodes.BC2_FWD, "A" * 150, "A" * 30 + barcodes.BC2_FWD + "A" * 130]
    for k in range(400):
        seq = rnd.choices("ACGT", k=rnd.choice([100, 170, 190, 260]))
        for anchor in rnd.choices(anchors, k=3):
            at = min(max(len(seq) - 150 - rnd.randint(-10, 40), 0), len(seq) - 8) if k % 2 else rnd.randint(0, len(seq) - 8)
            seq[at : at + 8] = anchor
        seqs.append("".join(seq))
    return seqs


def plain_pocket(seq, fwd, rev, after):
    cut, k = max(len(seq) - 150, 0), 0
    for text in (seq[:cut], seq[cut:]):
        for anchor, side in ((fwd, after), (rev, not after)):
            at, k = text.find(anchor), k + 1
            first, last = (at + 6, at + 20) if side else (max(at - 12, 0), at + 2)
            if at >= 0 and last <= len(text):
                return text[first:last], k
    return None, None


def test_pockets_of_the_first_way_are_those_of_the_sql(spark, tmp_path):
    c, seqs = duckdb.connect(), pocket_reads()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, 'en', 's')", [(k, s and s.replace("C", "B")) for k, s in enumerate([*seqs, None])])
    c.execute(f"COPY documents TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    own = (str(tmp_path), c)
    found = rows(got(spark, own, "barcode_anchor_pocket"))
    assert found == rows(wanted(own, "barcode_anchor_pocket"))
    other = [s for s in seqs if s.find(barcodes.BC2_FWD, 0, max(len(s) - 150, 0)) >= 0 and plain_pocket(s, barcodes.BC2_FWD, barcodes.BC2_REV, True)[1] in (2, 3, 4)]
    assert len(found) > 20 and len(other) > 5  # the others have that anchor too, but their pocket by another way


def test_pockets_and_ways_are_those_of_a_plain_search(spark):
    seqs = pocket_reads()
    want = [(k, *plain_pocket(s, barcodes.BC1_FWD, barcodes.BC1_REV, False), *plain_pocket(s, barcodes.BC2_FWD, barcodes.BC2_REV, True)) for k, s in enumerate(seqs)]
    found = barcodes.anchor_pockets(spark.createDataFrame(list(enumerate(seqs)), "k long, seq string"))
    assert sorted(tuple(r) for r in found.select("k", "bc1_pocket", "bc1_way", "bc2_pocket", "bc2_way").collect()) == want
    assert {w[2] for w in want} == {w[4] for w in want} == {None, 1, 2, 3, 4}

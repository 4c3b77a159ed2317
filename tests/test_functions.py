from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from strandlake.functions import alignment, cigar, header, names, quality, sequence, timing


def one(df):
    return df.first()


def test_mean_qv(spark):
    df = spark.createDataFrame([([20] * 4, [255, 255])], "a array<int>, b array<int>")
    row = one(df.select(quality.mean_qv(F.col("a")).alias("a"), quality.mean_qv(F.col("b")).alias("b")))
    assert row.a == pytest.approx(20) and row.b == 0


def test_basecaller_qv(spark):
    df = spark.createDataFrame([("&" * 60 + "5" * 500,)], "q string")
    row = one(df.select(quality.basecaller_qv(F.col("q"), F.lit(False)).alias("a"), quality.basecaller_qv(F.col("q"), F.lit(True)).alias("b")))
    assert row.a == pytest.approx(20) and row.b < 19


def test_header_dialects(spark):
    rows = [("@r1 qs:f:11.25 mx:i:2 ch:i:301 RG:Z:run9_dna@v5_barcode01 PU:Z:cellA al:Z:barcode01 pi:Z:p1",), ("@r2 runid=9a flow_cell_id=F barcode=barcode02 basecall_model_version_id=m ch=42 start_time=2025-05-04T01:02:03Z qs=9",)]
    a, b = (r.meta for r in header.parse_header(spark.createDataFrame(rows, "header string")).collect())
    assert (a.read_id, a.run_id, a.basecall_model, a.channel, a.barcode, a.parent_read_id) == ("r1", "run9", "dna@v5", 301, "barcode01", "p1")
    assert (b.read_id, b.run_id, b.flow_cell_id, b.basecall_model, b.channel, b.mean_qscore) == ("r2", "9a", "F", "m", 42, 9.0)


def test_durations_and_windows():
    assert (timing.parse_duration("90"), timing.parse_duration("2h30m"), timing.parse_duration("-1h"), timing.parse_duration("1h30")) == (5400, 9000, -3600, 3600)
    start, end = (datetime(2026, 1, 1, h, tzinfo=timezone.utc) for h in (12, 15))
    assert [t.hour for t in timing.relative_window("1h", "-1h", start, end)] == [13, 14]
    assert timing.parse_range("3-9") == (3, 9) and timing.parse_len("300,900") == (300, 900)
    for bad in (lambda: timing.parse_range("9-3"), lambda: timing.parse_duration("x"), lambda: timing.relative_window("-1h", "1h", start, end)):
        with pytest.raises(ValueError):
            bad()


def test_barcode_names(spark):
    df = spark.createDataFrame([("BC5",), ("13",), ("unclassified",), ("barcode005",), ("NB101",)], "b string")
    assert [r[0] for r in df.select(names.normalize_barcode(F.col("b"))).collect()] == ["barcode05", "barcode13", "unclassified", "barcode05", "barcode101"]


def test_variants_and_distances(spark):
    assert len(sequence.hamming_variants("ATCG", 1)) == 13
    best, end = alignment.sellers(["AAATTGGCCAAA", "AAATTGCCAAA", "CCCCCCCC"], "TTGGCC")
    assert best.tolist() == [0, 1, 4] and end[0] == 9
    df = spark.createDataFrame([("AAATTGGCCAAA",), ("CCCCCCCC",), (None,)], "t string")
    found = df.select(alignment.semiglobal_find("TTGGCC", 2)("t").alias("h"), sequence.semiglobal_native(F.col("t"), "TTGGCC", 2).alias("n")).collect()
    assert (found[0].h.dist, found[0].h.start, found[0].h.end, found[0].n) == (0, 3, 9, 0)
    assert found[1].h.dist is None and found[1].n is None
    assert alignment.iupac_distance("ACGT", "RNYN") == 1


def test_pair_validity(spark):
    # from the rule: words anywhere, a letter after a separator, a capital glued to a small letter or before digits
    good = [("egfr-forward-2", "egfr-reverse-2"), ("kras_f7", "kras_r7"), ("tp53 F", "tp53 R"), ("exonF", "exonR"), ("LOCUSF12", "LOCUSR9"), ("left", "right"), ("fwdside", "right_r")]
    bad = [("egfr_f", "kras_F3"), ("pairreverse", "other-r"), ("plain", "plain"), ("siteR", "REVERSEsite")]
    df = spark.createDataFrame(good + bad, "a string, b string")
    assert [r[0] for r in df.select(sequence.pair_validity(F.col("a"), F.col("b"))).collect()] == [True] * 7 + [False] * 4


def test_cigar(spark):
    c = cigar.parse_cigar(F.lit("3S10M2D5M4I1X"))
    row = one(spark.range(1).select(cigar.cigar_blocks(F.lit(100), c).alias("b"), cigar.reference_end(F.lit(100), c).alias("e"), cigar.cigar_accuracy(cigar.parse_cigar(F.lit("*"))).alias("a")))
    assert [(b.start, b.end) for b in row.b] == [(100, 110), (112, 117), (117, 118)] and row.e == 118 and row.a is None

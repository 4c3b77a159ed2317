import gzip

from strandlake.sinks import files
from strandlake.sources import bam, fastq, tables
from strandlake.streaming import live

RECORD = "@r{0} ch:i:1\nACGT\n+\n@III\n"


def test_fastq(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("".join(RECORD.format(k) for k in range(3)))
    (tmp_path / "b.FQ.gz").write_bytes(gzip.compress(RECORD.format(8).encode()) + gzip.compress(RECORD.format(9).encode()))
    got = fastq.scan_fastq(spark, str(tmp_path)).collect()
    assert sorted(r.read_id for r in got) == ["r0", "r1", "r2", "r8", "r9"] and {r.qual for r in got} == {"@III"}
    assert [r[3] for r in fastq.parse(b"junk\n@a\nACG\n+\nII\n@b\nA\n+\nI\n", "lenient")] == [True, False]
    files.sink_fastq(fastq.scan_fastq(spark, str(tmp_path)), str(tmp_path / "out"))
    assert sum(p.read_text().count("@r") for p in (tmp_path / "out").glob("part-*")) == 5


def test_bam_round_trip(spark, tmp_path):
    rows = [{"read_id": "a", "flag": 16, "chrom": "chr9", "pos": 5, "mapq": 60, "cigar": "2S3M", "seq": "ACGTN", "scores": [1, 2, 3, 4, 5], "tags": {"qs": "12.5", "ts": "+", "RG": "x"}}, {"read_id": "b", "flag": 4, "chrom": None, "pos": -1, "mapq": 0, "cigar": "", "seq": "A", "scores": None, "tags": {}}]
    (tmp_path / "a.bam").write_bytes(bam.encode("@HD\n", [("chr9", 300), ("chr22", 300)], rows))
    got = {r.read_id: r for r in bam.scan_bam(spark, str(tmp_path)).collect()}
    assert (got["a"].chrom, got["a"].pos, got["a"].cigar, got["a"].seq, got["a"].scores, got["a"].tags["qs"]) == ("chr9", 5, "2S3M", "ACGTN", [1, 2, 3, 4, 5], "12.5")
    assert got["b"].chrom is None and got["b"].scores == [255]
    plain = bam.unaligned_copy(bam.scan_bam(spark, str(tmp_path))).where("read_id = 'a'").first()
    assert (plain.flag, plain.seq, plain.scores) == (4, "NACGT", [5, 4, 3, 2, 1]) and "ts" not in plain.tags


def test_tables(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("# c\nA_fwd  acgtn chr9:10-20(G)\nbad ACGX\nB_rev\tTTT\n")
    got = {r.name: r for r in tables.scan_primers(spark, str(tmp_path / "p.tsv")).collect()}
    assert set(got) == {"A_fwd", "B_rev"} and (got["A_fwd"].seq, got["A_fwd"].chrom, got["A_fwd"].end) == ("ACGTN", "chr9", 20)
    (tmp_path / "s.tsv").write_text("read_id\tparent_read_id\tchannel\tstart_time\tduration\na\tp\t3\t1.5\t-\nb\t-\t-\t2\t4\nb\t\t7\t3\t5\n")
    timing = {r.read_id: r for r in tables.scan_summary_timing(spark, str(tmp_path / "s.tsv")).collect()}
    assert set(timing) == {"a", "p", "b"} and timing["b"].s_ch == 7 and timing["a"].s_duration is None
    (tmp_path / "m.csv").write_text("1,s1\nbc02,s2,T\n")
    assert [tuple(r) for r in tables.scan_barcode_map(spark, str(tmp_path / "m.csv")).orderBy("barcode").collect()] == [("barcode01", "s1", "T", "bcr_abl", "cdna"), ("barcode02", "s2", "T", "bcr_abl", "cdna")]
    (tmp_path / "v.vcf").write_text("##x\n#CHROM\n9\t5\t.\tA\tG\t1\tPASS\tDP=100;AF=0.25\n")
    assert tuple(tables.scan_vcf(spark, str(tmp_path / "v.vcf")).first()) == ("9", 5, "A", "G", 0.25, 100, 25.0)
    (tmp_path / "g.fa").write_text(">c1 x\nACGT\nAC\n>c2\nTT\n")
    fasta = tables.scan_fasta(spark, str(tmp_path / "g.fa"))
    assert {r.chrom: r.seq for r in fasta.collect()} == {"c1": "ACGTAC", "c2": "TT"} and tables.fetch(fasta, "c1", 1, 3).first().seq == "CG"


def test_stream_equals_batch(spark, tmp_path):
    src, run = tmp_path / "src" / "barcode01", tmp_path / "run"
    src.mkdir(parents=True)
    for k in range(3):
        (src / f"{k}.fastq").write_text("".join(RECORD.format(10 * k + i) for i in range(4)))
    assert live.replay(str(tmp_path / "src"), str(run), half_first=True) == 3
    reads = live.file_reads(live.watch_files(spark, str(run), per_batch=1))
    live.write_segments(reads, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    snaps = live.Snapshots(spark, str(tmp_path / "out"))
    assert snaps.compact(["barcode", "read_id"]) == 1 and snaps.read().count() == 12
    (run / "barcode01" / "9.fastq").write_text(RECORD.format(99))
    live.write_segments(live.file_reads(live.watch_files(spark, str(run))), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert snaps.compact(["barcode", "read_id"]) == 2
    got = snaps.read()
    assert got.count() == 13 and {r.barcode for r in got.select("barcode").distinct().collect()} == {"barcode01"}


def test_ledger_and_waits():
    text = '{"path": "a"}\n{"path": "b", "si{"path": "c"}\n{"path": "d"}\n{"path": "e"}\n'
    assert [e["path"] for e in live.read_ledger(text)] == ["a", "d", "e"]
    assert live.retry_wait(3) == 15 and live.retry_wait(50) == 60 and live.retry_wait(5, once=True) is None
    run = live.RunAccumulator()
    run.finish(100)
    run.update(50)
    assert run.total == 150
    run.finish(100)
    assert run.total == 200


def test_ord_is_unique_over_files(spark, tmp_path):
    for name in ("b", "a", "c"):
        (tmp_path / f"{name}.fastq").write_text("".join(RECORD.format(f"{name}{k}") for k in range(3)))
        (tmp_path / f"{name}.bam").write_bytes(bam.encode("@HD\n", [("chr9", 300)], [{"read_id": f"r{name}{k}", "flag": 4, "seq": "A"} for k in range(3)]))
    want = [f"r{n}{k}" for n in "abc" for k in range(3)]
    for scan in (fastq.scan_fastq, bam.scan_bam):
        got = scan(spark, str(tmp_path))
        assert [r.read_id for r in got.orderBy("ord").collect()] == want and got.select("ord").distinct().count() == 9
        assert [r.read_id for r in got.repartition(5).orderBy("ord").limit(4).collect()] == want[:4]


def test_barcode_map_has_no_end(spark, tmp_path):
    import pytest

    (tmp_path / "m.csv").write_text("barcode,sample\n" + "".join(f"bc{k},s{k}\n" for k in range(1, 12_001)))
    assert tables.scan_barcode_map(spark, str(tmp_path / "m.csv")).count() == 12_000
    for text in ("1,a\n01,b\n", "1,a\n2,a\n", "x1,a\n"):
        (tmp_path / "m.csv").write_text(text)
        with pytest.raises(ValueError):
            tables.scan_barcode_map(spark, str(tmp_path / "m.csv"))


def test_one_json_document(spark, tmp_path):
    import json

    df = spark.range(0, 12_000, 1, 5).selectExpr("id", "named_struct('x', id * 2) AS s")
    files.sink_json_document(df, f"file://{tmp_path}/out.json")
    files.sink_json_document(df.orderBy("id"), f"file://{tmp_path}/out.json")
    assert json.loads((tmp_path / "out.json").read_text()) == [{"id": k, "s": {"x": 2 * k}} for k in range(12_000)]
    assert json.loads(files.pretty_json(df.limit(0))) == [] and not [p for p in tmp_path.iterdir() if p.name.endswith(".tmp")]


def test_half_written_files_wait_and_are_tried_again(spark, tmp_path, monkeypatch):
    run = tmp_path / "run" / "barcode03"
    run.mkdir(parents=True)
    whole = gzip.compress("".join(RECORD.format(k) for k in range(200)).encode())
    (run / "a.fastq").write_text(RECORD.format("a"))
    (run / "cut.fastq.gz").write_bytes(whole[: len(whole) // 2])
    (run / ".hidden.fastq").write_text(RECORD.format("x"))
    (run / "empty.fastq").write_text("")
    monkeypatch.setattr(live, "retry_wait", lambda attempts, once=False: 0.0)
    reads = live.watch_run(spark, f"file://{tmp_path}/run", f"file://{tmp_path}/ledger", stable=0)
    query = live.write_segments(reads, f"file://{tmp_path}/out", f"file://{tmp_path}/cp", once=False, seconds=1)
    seen = lambda: {r.read_id for r in spark.read.parquet(f"file://{tmp_path}/out/segments").collect()}

    def until(check):
        import time

        for _ in range(120):
            try:
                if check():
                    return True
            except Exception:
                assert query.isActive, query.exception()
            time.sleep(0.5)
        return False

    try:
        assert until(lambda: seen() == {"ra"} and list((tmp_path / "ledger" / "failed").glob("*.json")))
        (run / "cut.fastq.gz").write_bytes(whole)  # the writer has caught up
        assert until(lambda: len(seen()) == 201)
    finally:
        query.stop()
    snaps = live.Snapshots(spark, f"file://{tmp_path}/out")
    snaps.compact(["barcode", "read_id"])
    got = snaps.read()
    assert got.count() == 201 == got.select("ord").distinct().count() and {r.barcode for r in got.select("barcode").distinct().collect()} == {"barcode03"}


def test_readiness():
    assert live.ready(11, 5, 5) and not live.ready(9, 5, 5) and not live.ready(11, 5, None) and not live.ready(11, 6, 5) and not live.ready(11, 0, 0)


def test_generations_fold_by_size(spark, tmp_path):
    snaps = live.Snapshots(spark, f"file://{tmp_path}")
    for k, n in enumerate([5000, 10, 10, 10_000]):
        spark.range(k * 100_000, k * 100_000 + n).selectExpr("id", "uuid() AS v").write.parquet(f"file://{tmp_path}/segments/batch={k}")
        assert snaps.compact(["id"]) == k + 1
        assert snaps.read().select("id").distinct().count() == snaps.read().count()
    assert snaps.read().count() == 15_020 and snaps.current()["parts"] == [4]
    assert snaps.compact(["id"]) == 4
    assert [p.name for p in tmp_path.glob("generation=*")] == ["generation=4"] and not list((tmp_path / "segments").glob("batch=*"))


def test_conversions(spark, tmp_path):
    from strandlake.operators.filters import ReadFilter, filter_convert

    (tmp_path / "a.fastq").write_text("@r1 ch:i:5 qs:f:12.0\nACGTAC\n+\nIIIIII\n@r2 ch:i:9\nACG\n+\nIII\n@r3 ch:i:700\nACGTACGT\n+\nIIIIIIII\n")
    f = ReadFilter(min_len=4, channels=(1, 512))
    filter_convert(spark, f"{tmp_path}/a.fastq", f"file://{tmp_path}/one.bam", f)
    got = bam.scan_bam(spark, f"{tmp_path}/one.bam").collect()
    assert [(r.read_id, r.seq, r.flag, r.chrom, r.scores, r.tags["ch"]) for r in got] == [("r1", "ACGTAC", 4, None, [40] * 6, "5")]
    (tmp_path / "b.bam").write_bytes(bam.encode("@HD\n", [("chr9", 300)], [{"read_id": n, "flag": g, "chrom": "chr9", "pos": 1, "cigar": "5M", "seq": "AACGT", "scores": [20, 30, 30, 30, 30], "tags": {"ch": c}} for n, g, c in (("p", 16, "7"), ("p", 0x900, "7"), ("q", 0, "600"))]))
    filter_convert(spark, f"{tmp_path}/b.bam", f"file://{tmp_path}/two", f, "fastq")
    rows = spark.read.text(f"{tmp_path}/two").collect()
    assert [r.value for r in rows][1:4] == ["ACGTT", "+", "????5"] and rows[0].value.split()[0] == "@p" and len(rows) == 4
    filter_convert(spark, f"{tmp_path}/a.fastq", f"file://{tmp_path}/three", f, "fastq")
    assert [r.value for r in spark.read.text(f"{tmp_path}/three").collect()] == ["@r1 ch:i:5 qs:f:12.0", "ACGTAC", "+", "IIIIII"]
    filter_convert(spark, f"{tmp_path}/b.bam", f"file://{tmp_path}/four.bam", ReadFilter())
    assert sorted((r.read_id, r.seq, r.flag) for r in bam.scan_bam(spark, f"{tmp_path}/four.bam").collect()) == [("p", "ACGTT", 4), ("q", "AACGT", 4)]

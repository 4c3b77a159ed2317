"""Text tables of all kinds as DataFrames. Small lists that travel with a plan are read where the plan is made."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import normalize_barcode
from ..functions.timing import parse_summary_time


def _place():
    """A value that orders rows by file, block of the file and place in it, however the blocks are dealt to tasks."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, ord) without empty lines and comments; ord follows files and lines."""
    return spark.read.text(path).select(F.trim("value").alias("line"), _place().alias("ord")).where("line != '' AND line NOT LIKE '#%'")


def scan_summary(spark: SparkSession, path: str, place: str | None = None) -> DataFrame:
    """A run summary with named columns, whatever they are, as text; - and empty are null. Tabs, gzip too. ``place`` names a column that orders the rows."""
    df = spark.read.csv(path, sep="\t", header=True)
    return df.select(*([_place().alias(place)] if place else []), *(F.when(~F.trim(F.col(f"`{c}`")).isin("-", ""), F.trim(F.col(f"`{c}`"))).alias(c) for c in df.columns))


def _optional(df: DataFrame, *names: str):
    own = [F.col(f"`{n}`") for n in names if n in df.columns]
    return F.coalesce(*own) if own else F.lit(None).cast("string")


def scan_summary_timing(spark: SparkSession, path: str) -> DataFrame:
    """read_id, s_ch, s_mx, s_start, s_duration: a row under its read's id and one under its parent's; the last row of an id counts."""
    df = scan_summary(spark, path, "__ord")
    own = df.select(
        _optional(df, "read_id", "parent_read_id").alias("read_id"), _optional(df, "parent_read_id").alias("parent_id"), _optional(df, "channel").try_cast("long").alias("s_ch"), _optional(df, "mux").try_cast("long").alias("s_mx"),
        parse_summary_time(_optional(df, "start_time")).alias("s_start"), _optional(df, "duration", "template_duration").try_cast("double").alias("s_duration"), "__ord",
    )
    both = own.unionByName(own.where("parent_id IS NOT NULL AND parent_id != read_id").withColumn("read_id", F.col("parent_id"))).where("read_id IS NOT NULL")
    last = both.groupBy("read_id").agg(F.max_by(F.struct("s_ch", "s_mx", "s_start", "s_duration"), "__ord").alias("r"))
    return last.select("read_id", "r.*")


def scan_summary_selection(spark: SparkSession, path: str) -> DataFrame:
    """read_id, barcode, front_score, rear_score, qscore; read_id must be there."""
    df = scan_summary(spark, path)
    if "read_id" not in df.columns:
        raise ValueError("the summary has no read_id column")
    number = lambda n: _optional(df, n).try_cast("double")
    return df.select("read_id", normalize_barcode(_optional(df, "barcode_arrangement", "barcode")).alias("barcode"), number("barcode_front_score").alias("front_score"), number("barcode_rear_score").alias("rear_score"), number("mean_qscore_template").alias("qscore"))


def scan_primers(spark: SparkSession, path: str) -> DataFrame:
    """ord, name, seq, chrom, start, end of ``name seq [chrom:start-end(Gene)]``; sequences of other letters than ACGTN are dropped."""
    f = F.split("line", r"\s+")
    rows = _lines(spark, path).select("ord", f[0].alias("name"), F.upper(f[1]).alias("seq"), F.get(f, F.lit(2)).alias("region")).where(F.col("seq").rlike("^[ACGTN]+$"))
    part = lambda k: F.regexp_extract("region", r"^([^:]+):([0-9]+)-([0-9]+)", k)
    return rows.select("ord", "name", "seq", F.nullif(part(1), F.lit("")).alias("chrom"), part(2).try_cast("long").alias("start"), part(3).try_cast("long").alias("end"))


def scan_primers_tab(spark: SparkSession, path: str) -> DataFrame:
    """name, seq of strictly tab-separated lines; the last of equal names counts."""
    f = F.split("line", "\t")
    rows = _lines(spark, path).where(F.size(f) >= 2).select("ord", F.trim(f[0]).alias("name"), F.upper(F.trim(f[1])).alias("seq"))
    return rows.groupBy("name").agg(F.max_by("seq", "ord").alias("seq"))


def scan_bed(spark: SparkSession, path: str, named: bool = False) -> DataFrame:
    """chrom, start, end (and name: the fourth column or Region_n); fewer than three columns are an error, empty intervals dropped."""
    f = F.split("line", r"\s+")
    rows = _lines(spark, path).where(~F.col("line").rlike("^(track|browser)"))
    checked = rows.withColumn("f", F.when(F.size(f) >= 3, f).otherwise(F.raise_error(F.concat(F.lit("a BED line has fewer than three columns: "), F.col("line")))))
    out = checked.select("ord", F.col("f")[0].alias("chrom"), F.col("f")[1].cast("long").alias("start"), F.col("f")[2].cast("long").alias("end"), F.get("f", F.lit(3)).alias("name")).where("end > start")
    return out.withColumn("name", F.coalesce("name", F.concat(F.lit("Region_"), (F.col("ord") + 1).cast("string")))) if named else out.drop("name", "ord")


def scan_gtf(spark: SparkSession, path: str, feature: str | None = None) -> DataFrame:
    """chrom (without chr), start, end, type, gene, id, exon of GTF or GFF lines; the end is made half-open."""
    f = F.split("line", "\t")
    rows = _lines(spark, path).where(F.size(f) >= 9).select("ord", f.alias("f"))
    attr = lambda k: F.coalesce(F.nullif(F.regexp_extract(F.col("f")[8], rf'(?:^|[; ]){k} "([^"]*)"', 1), F.lit("")), F.nullif(F.regexp_extract(F.col("f")[8], rf"(?:^|;\s*){k}=([^;]*)", 1), F.lit("")))
    out = rows.select("ord", F.regexp_replace(F.col("f")[0], "^chr", "").alias("chrom"), F.col("f")[3].cast("long").alias("start"), (F.col("f")[4].cast("long") + 1).alias("end"), F.col("f")[2].alias("type"), F.coalesce(attr("gene_name"), attr("gene_id"), attr("Name")).alias("gene"), attr("gene_id").alias("id"), attr("exon_number").try_cast("int").alias("exon"))
    return out.where(F.col("type") == feature) if feature else out


def write_gtf_index(features: DataFrame, path: str) -> None:
    """Features by chromosome, so that a range of one is read from its folder alone."""
    features.repartition("chrom").sortWithinPartitions("chrom", "start").write.partitionBy("chrom").parquet(path)


def scan_gtf_indexed(spark: SparkSession, path: str, chrom: str, start: int, end: int) -> DataFrame:
    """Features of an index that overlap a range: the folder is pruned, the bounds are pushed to its files."""
    return spark.read.parquet(path).where((F.col("chrom") == chrom) & (F.col("start") < end) & (F.col("end") > start))


def parse_barcodes(text: str) -> list[tuple[str, str, str]]:
    """(sample, bc1, bc2) of blocks of three lines."""
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    if len(lines) % 3:
        raise ValueError("a barcode block has fewer than three lines")
    return [(s, a.upper(), b.upper()) for s, a, b in zip(lines[::3], lines[1::3], lines[2::3], strict=True)]


def scan_barcodes(spark: SparkSession, path: str) -> list[tuple[str, str, str]]:
    """parse_barcodes of a file: a sheet of a few hundred samples."""
    return parse_barcodes("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def scan_known_mutations(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, ref, alt, aa of a table with a header: chromosome, start, stop, ``A > G``, amino-acid change."""
    f = F.split("line", "\t")
    rows = _lines(spark, path).where((F.size(f) >= 5) & F.col("line").contains(">") & f[1].try_cast("long").isNotNull())
    bases = F.split(f[3], ">")
    return rows.select(F.trim(f[0]).alias("chrom"), f[1].cast("long").alias("pos"), F.trim(bases[0]).alias("ref"), F.trim(bases[1]).alias("alt"), F.trim(f[4]).alias("aa"))


def scan_common_snps(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos from 1, rsid of a BED with names."""
    return scan_bed(spark, path, named=True).select("chrom", (F.col("start") + 1).alias("pos"), F.col("name").alias("rsid"))


def scan_vcf(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, ref, alt, af, depth, vaf (percent) of lines with at least eight columns."""
    f = F.split("line", "\t")
    info = F.str_to_map(f[7], F.lit(";"), F.lit("="))
    rows = _lines(spark, path).where(F.size(f) >= 8).select(f[0].alias("chrom"), f[1].try_cast("long").alias("pos"), f[3].alias("ref"), f[4].alias("alt"), F.try_element_at(info, F.lit("AF")).try_cast("double").alias("af"), F.try_element_at(info, F.lit("DP")).try_cast("long").alias("depth"))
    return rows.withColumn("vaf", F.col("af") * 100)


def scan_barcode_map(spark: SparkSession, path: str) -> DataFrame:
    """barcode, sample, type, assay, library_type of a CSV or TSV; a barcode, or a sample's type, twice is an error."""
    lines = spark.read.text(path).select("value", _place().alias("ord")).where("trim(value) != ''")
    first = lines.orderBy("ord").first()
    cells = F.transform(F.split("value", "\t" if first and "\t" in first["value"] else ","), lambda c: F.trim(c))
    name = F.lower(cells[0])
    rows = lines.where(~name.isin("barcode", "") & ~F.startswith(name, F.lit("#"))).select(F.regexp_replace(name, "^(barcode|bc)", "").alias("digits"), cells.alias("cells"))
    wrong = rows.where(~F.col("digits").rlike("^[0-9]+$")).first()
    if wrong:
        raise ValueError(f"not a barcode: {wrong['cells'][0]}")
    cell = lambda k, default: F.coalesce(F.nullif(F.get("cells", F.lit(k)), F.lit("")), F.lit(default))
    number = F.col("digits").cast("int").cast("string")
    out = rows.select(F.concat(F.lit("barcode"), F.lpad(number, F.greatest(F.length(number), F.lit(2)), F.lit("0"))).alias("barcode"), cell(1, "").alias("sample"), cell(2, "T").alias("type"), cell(3, "bcr_abl").alias("assay"), cell(4, "cdna").alias("library_type"))
    for key in (["barcode"], ["sample", "type"]):
        if not out.groupBy(*key).count().where("count > 1").isEmpty():
            raise ValueError("a barcode or a sample's type is listed twice")
    return out


def scan_tsv_comments(spark: SparkSession, path: str) -> DataFrame:
    """The first line that is no comment names the columns."""
    return spark.read.csv(path, sep="\t", header=True, comment="#")


def scan_json_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def scan_isoforms(results: DataFrame) -> DataFrame:
    """A row for each isoform of fusion results with an ``isoforms`` array."""
    return results.select("*", F.explode_outer("isoforms").alias("isoform")).drop("isoforms")


def scan_workflow_log(spark: SparkSession, path: str) -> DataFrame:
    """ord, done, total, percent, rule, failed_rule of a workflow's log lines that say any of them."""
    rows = spark.read.text(path).select(_place().alias("ord"), F.col("value").alias("line"))
    steps = lambda k: F.regexp_extract("line", r"([0-9]+) of ([0-9]+) steps \(([0-9.]+)%\) done", k)
    failed = F.nullif(F.regexp_extract("line", r"Error in rule ([A-Za-z0-9_]+):", 1), F.lit(""))
    rule = F.nullif(F.regexp_extract("line", r"^\s*(?:local)?rule ([A-Za-z0-9_]+):", 1), F.lit(""))
    out = rows.select("ord", steps(1).try_cast("int").alias("done"), steps(2).try_cast("int").alias("total"), steps(3).try_cast("double").alias("percent"), rule.alias("rule"), failed.alias("failed_rule"))
    return out.where("done IS NOT NULL OR rule IS NOT NULL OR failed_rule IS NOT NULL")


def list_dir(spark: SparkSession, path: str, recursive: bool = False, suffixes: list[str] | None = None) -> DataFrame:
    """path, name, size, modified of a folder's files; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    if suffixes:
        files = files.where(F.lower("name").rlike("(" + "|".join(s.lower().replace(".", r"\.") for s in suffixes) + ")$"))
    return files.orderBy("name")


def scan_fasta(spark: SparkSession, path: str) -> DataFrame:
    """chrom, seq: a contig a row; each file is one row of text first."""
    parts = spark.read.text(path, wholetext=True, lineSep=None).select(F.explode(F.split("value", "(?m)^>")).alias("part")).where("trim(part) != ''")
    return parts.select(F.regexp_extract("part", r"^(\S+)", 1).alias("chrom"), F.regexp_replace(F.regexp_extract("part", r"(?s)^[^\n]*\n(.*)$", 1), r"\s", "").alias("seq"))


def fetch(fasta: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """The bases from start (from 0) to end of a contig."""
    return fasta.where(F.col("chrom") == chrom).select(F.substring("seq", start + 1, end - start).alias("seq"))


def sample_sheet_merge(sheet: DataFrame, files: DataFrame) -> DataFrame:
    """sample_id, files: the files (path) of each row (run_id, sample_id, barcode), by three rules of where they lie.

    A folder of the barcode below one of the run; else a file whose name has the run and the barcode; else the barcode's
    folder anywhere. The first rule that finds any decides.
    """
    pairs = sheet.select("run_id", "sample_id", "barcode").join(files.select("path"), F.contains("path", "barcode"))
    rule = F.when(F.contains("path", F.concat(F.lit("/"), F.col("run_id"), F.lit("/"))) & F.contains("path", F.concat(F.lit("/"), F.col("barcode"), F.lit("/"))), 1).when(F.contains(F.substring_index("path", "/", -1), "run_id") & F.contains(F.substring_index("path", "/", -1), "barcode"), 2).when(F.contains("path", F.concat(F.lit("/"), F.col("barcode"), F.lit("/"))), 3)
    ruled = pairs.withColumn("rule", rule).where("rule IS NOT NULL")
    best = ruled.groupBy("run_id", "sample_id", "barcode").agg(F.min("rule").alias("rule"))
    return ruled.join(best, ["run_id", "sample_id", "barcode", "rule"]).groupBy("sample_id").agg(F.array_sort(F.collect_set("path")).alias("files"))

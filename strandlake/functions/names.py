"""Barcode labels, amplicon names and chromosome order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalize_barcode(text: Column) -> Column:
    """barcode, bc, nb, rb or nothing before digits becomes ``barcode%02d``; anything else only lower case."""
    low = F.lower(F.trim(text))
    digits = F.regexp_extract(low, "^(?:barcode|bc|nb|rb)?([0-9]+)$", 1)
    number = digits.try_cast("int")
    return F.when(number.isNotNull(), F.concat(F.lit("barcode"), F.when(number < 10, F.lit("0")).otherwise(F.lit("")), number.cast("string"))).otherwise(low)


def barcode_from_path(path: Column) -> Column:
    """The first folder named ``unclassified`` or ``barcode`` and digits; null without one."""
    found = F.regexp_extract(path, "(?:^|/)(unclassified|barcode[0-9]+)(?=/)", 1)
    return F.when(found != "", found)


def barcode_from_path_loose(path: Column) -> Column:
    """``barcode`` or ``BC`` with digits in the folder, then in the file's name, else unknown."""
    folder, name = F.regexp_extract(path, "^(.*)/[^/]*$", 1), F.substring_index(path, "/", -1)
    found = lambda c: F.when(F.regexp_extract(c, "(barcode[0-9]+|BC[0-9]+)", 1) != "", F.regexp_extract(c, "(barcode[0-9]+|BC[0-9]+)", 1))
    return F.coalesce(found(folder), found(name), F.lit("unknown"))


def parse_region(name: Column) -> Column:
    """struct(chrom, start, end, genes) of ``A-B:chr:start-end(GENE_ex1,OTHER)``; null fields where there is none."""
    chrom = F.regexp_extract(name, r"(?:^|:)(?:chr)?([A-Za-z0-9_.]+):[0-9]+-[0-9]+", 1)
    span = r":([0-9]+)-([0-9]+)"
    genes = F.regexp_extract(name, r"\(([^()]*)\)\s*$", 1)
    cleaned = F.array_distinct(F.filter(F.transform(F.split(genes, ","), lambda g: F.regexp_replace(F.trim(g), "_ex.*$", "")), lambda g: g != ""))
    return F.struct(F.when(chrom != "", chrom).alias("chrom"), F.regexp_extract(name, span, 1).try_cast("long").alias("start"), F.regexp_extract(name, span, 2).try_cast("long").alias("end"), cleaned.alias("genes"))


def parse_amplicon_name(name: Column) -> Column:
    """struct(primers, chrom, start, end, genes): parse_region with the two primer names before it."""
    region = parse_region(name)
    return F.struct(F.split(F.substring_index(name, ":", 1), "-").alias("primers"), region.chrom.alias("chrom"), region.start.alias("start"), region.end.alias("end"), region.genes.alias("genes"))


def chromosome_order(chrom: Column) -> Column:
    """1 to 22, X 23, Y 24, M or MT 25, others 100."""
    bare = F.upper(F.regexp_replace(chrom, "^(?i)chr", ""))
    return F.coalesce(bare.try_cast("int"), F.when(bare == "X", 23).when(bare == "Y", 24).when(bare.isin("M", "MT"), 25).otherwise(100))


def genome_linearize(contigs: DataFrame) -> DataFrame:
    """chrom, len, offset in natural order; contigs with _ in their name and EBV are left out. One row a contig."""
    own = contigs.where(~F.col("chrom").contains("_") & ~F.upper("chrom").contains("EBV"))
    order = Window.orderBy(chromosome_order(F.col("chrom")), "chrom").rowsBetween(Window.unboundedPreceding, -1)
    return own.withColumn("offset", F.coalesce(F.sum("len").over(order), F.lit(0)))


def to_global(points: DataFrame, genome: DataFrame) -> DataFrame:
    """``points`` (chrom, pos) with their place on the linear genome."""
    return points.join(genome.select("chrom", "offset"), "chrom").withColumn("gpos", F.col("offset") + F.col("pos")).drop("offset")


def from_global(points: DataFrame, genome: DataFrame) -> DataFrame:
    """``points`` (gpos) with chrom and pos; the genome has one row a contig and travels to all."""
    spans = F.array_sort(F.collect_list(F.struct("offset", "len", "chrom")))
    held = points.crossJoin(F.broadcast(genome.agg(spans.alias("spans"))))  # one row: the list of contigs
    hit = F.element_at(F.filter("spans", lambda s: (s.offset <= F.col("gpos")) & (F.col("gpos") < s.offset + s.len)), 1)
    return held.withColumn("hit", F.try_element_at(F.filter("spans", lambda s: (s.offset <= F.col("gpos")) & (F.col("gpos") < s.offset + s.len)), F.lit(1))).withColumn("chrom", F.col("hit.chrom")).withColumn("pos", F.col("gpos") - F.col("hit.offset")).drop("spans", "hit") if hit is not None else held

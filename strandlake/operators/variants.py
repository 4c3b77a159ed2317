"""Variants: counting, annotating, merging and comparing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cigar import parse_cigar

KEY = ["chrom", "pos", "ref", "alt"]


def pileup_bases(alignments: DataFrame) -> DataFrame:
    """(chrom, pos from 1, base) of every aligned base of ``alignments`` (chrom, pos from 0, cigar, seq)."""
    zero = F.struct(F.col("pos").cast("long").alias("r"), F.lit(0).cast("long").alias("q"), F.array().cast("array<struct<r: bigint, q: bigint, n: int>>").alias("blocks"))

    def step(a: Column, c: Column) -> Column:
        on_ref, on_query = c.op.isin("M", "=", "X", "D", "N"), c.op.isin("M", "=", "X", "I", "S")
        block = F.struct(a.r.alias("r"), a.q.alias("q"), c.n.alias("n"))
        return F.struct((a.r + F.when(on_ref, c.n).otherwise(0)).alias("r"), (a.q + F.when(on_query, c.n).otherwise(0)).alias("q"), F.when(c.op.isin("M", "=", "X"), F.concat(a.blocks, F.array(block))).otherwise(a.blocks).alias("blocks"))

    blocks = alignments.select("chrom", "seq", F.explode(F.aggregate(parse_cigar(F.col("cigar")), zero, step, lambda a: a.blocks)).alias("b"))
    letters = F.split(F.upper(F.substr("seq", (F.col("b.q") + 1).cast("int"), F.col("b.n"))), "")
    return blocks.select("chrom", F.col("b.r").alias("r"), F.posexplode(letters).alias("i", "base")).where("base != ''").select("chrom", (F.col("r") + F.col("i") + 1).alias("pos"), "base")


def pileup_variants(bases: DataFrame, min_depth: int = 10, min_af: float = 0.02) -> DataFrame:
    """Per place of at least ``min_depth``: the most frequent base is the reference, others of at least ``min_af`` are variants.

    Of equally frequent bases the first letter is the reference.
    """
    counts = bases.groupBy("chrom", "pos", "base").agg(F.count("*").alias("n"))
    site = Window.partitionBy("chrom", "pos")
    own = counts.withColumn("depth", F.sum("n").over(site)).withColumn("ref", F.max_by("base", F.struct("n", -F.ascii("base"))).over(site))
    af = F.col("n") / F.col("depth")
    return own.where((F.col("depth") >= min_depth) & (F.col("base") != F.col("ref")) & (af >= min_af)).select("chrom", "pos", "ref", F.col("base").alias("alt"), af.alias("af"), "depth")


def annotate(variants: DataFrame, known: DataFrame, snps: DataFrame) -> DataFrame:
    """``variants`` with aa (known mutation by chrom, pos, ref, alt) and rsid (SNP by chrom, pos)."""
    return variants.join(known.select(*KEY, "aa"), KEY, "left").join(snps.select("chrom", "pos", "rsid"), ["chrom", "pos"], "left")


def verdict(vaf_percent: Column, known: Column) -> Column:
    """Tiers of a listed mutation by its share: at least 10, at least 1 percent, below; others are not listed."""
    return F.when(~known, F.lit("unlisted")).when(vaf_percent >= 10, F.lit("high")).when(vaf_percent >= 1, F.lit("low")).otherwise(F.lit("trace"))


def annotate_by_place(variants: DataFrame, known: DataFrame) -> DataFrame:
    """By chromosome and place alone, with the verdict on ``vaf`` in percent."""
    places = known.groupBy("chrom", "pos").agg(F.min("aa").alias("aa"))
    return variants.join(places, ["chrom", "pos"], "left").withColumn("verdict", verdict(F.col("vaf"), F.col("aa").isNotNull()))


def merge_variants(a: DataFrame, b: DataFrame) -> DataFrame:
    """All variants of both; of one in both, the row with the higher af."""
    return a.unionByName(b).groupBy(*KEY).agg(F.max_by(F.struct("af", "depth"), F.struct("af", "depth")).alias("m")).select(*KEY, "m.af", "m.depth")


def candidates(amplicons: DataFrame, scanned: DataFrame, min_qs: float) -> DataFrame:
    """Amplicons (file, name, avg_qs, chrom) good enough and placed, without those scanned before."""
    return amplicons.where((F.col("avg_qs") >= min_qs) & F.col("chrom").isNotNull()).join(scanned.select("file", "name"), ["file", "name"], "left_anti")


def top_amplicon_reads(assigned: DataFrame, k: int = 20, cap: int = 2000) -> DataFrame:
    """Reads of the k largest amplicons, the first ``cap`` of each: what the pileup of an overview looks at."""
    top = assigned.where("amplicon IS NOT NULL").groupBy("amplicon").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "amplicon").limit(k).select("amplicon")
    own = assigned.join(F.broadcast(top), "amplicon", "left_semi")
    return own.withColumn("__k", F.row_number().over(Window.partitionBy("amplicon").orderBy("ord"))).where(F.col("__k") <= cap).drop("__k")


def top_amplicon_variants(aligned: DataFrame, k: int = 20, cap: int = 2000, min_depth: int = 10, min_af: float = 0.02) -> DataFrame:
    """amplicon, chrom, pos, ref, alt, af, depth: what the pileups of the k largest amplicons' reads show, each amplicon by itself.

    ``aligned``: read_id, ord, amplicon, chrom, pos from 0, cigar, seq.
    """
    reads = top_amplicon_reads(aligned, k, cap).withColumn("chrom", F.struct("amplicon", "chrom"))
    return pileup_variants(pileup_bases(reads), min_depth, min_af).select("chrom.amplicon", "chrom.chrom", "pos", "ref", "alt", "af", "depth")


def update_amplicons(reads: DataFrame, names: DataFrame, mark: str = "_CONCAT") -> DataFrame:
    """``reads`` (read_id, amplicon) with the later name (read_id, name) where there is one, and whether it is marked as a concatemer; the mark is no part of the name."""
    later = names.groupBy("read_id").agg(F.max("name").alias("__name"))
    name = F.coalesce("__name", "amplicon")
    joined = reads.join(later, "read_id", "left").withColumn("amplicon", name).drop("__name")
    marked = F.endswith("amplicon", F.lit(mark))
    return joined.withColumn("concatemer", marked).withColumn("amplicon", F.when(marked, F.expr(f"left(amplicon, length(amplicon) - {len(mark)})")).otherwise(F.col("amplicon")))


def sort_variants(variants: DataFrame) -> DataFrame:
    return variants.orderBy(*KEY)


def compare_calls(preliminary: DataFrame, final: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Mutations (name, vaf) of two results side by side: same, differs (by more than ``tolerance``), only_preliminary or only_final."""
    both = preliminary.select("name", F.col("vaf").alias("p_vaf")).join(final.select("name", F.col("vaf").alias("f_vaf")), "name", "full")
    state = F.when(F.col("f_vaf").isNull(), F.lit("only_preliminary")).when(F.col("p_vaf").isNull(), F.lit("only_final")).when(F.abs(F.col("p_vaf") - F.col("f_vaf")) > tolerance, F.lit("differs")).otherwise(F.lit("same"))
    return both.withColumn("state", state)


def compare_values(preliminary: DataFrame, final: DataFrame, key: str, value: str) -> DataFrame:
    """Isoforms or phasing states that differ or that one result lacks."""
    both = preliminary.select(key, F.col(value).alias("preliminary")).join(final.select(key, F.col(value).alias("final")), key, "full")
    return both.where(~F.col("preliminary").eqNullSafe(F.col("final")))


def handoff(snapshots: DataFrame, sheet: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Snapshots (barcode, records, expected) joined to the sheet (barcode, sample, type); then each side's rows without a partner."""
    joined = snapshots.join(sheet, "barcode").withColumn("mismatch", F.col("records") != F.col("expected"))
    return joined, snapshots.join(sheet, "barcode", "left_anti"), sheet.join(snapshots, "barcode", "left_anti")

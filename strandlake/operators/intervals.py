"""Genome intervals, half-open. Overlap joins are equi-joins on fixed bins, so no pair of rows is formed that shares none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 1 << 14


def merge_intervals(intervals: DataFrame, contigs: DataFrame | None = None) -> DataFrame:
    """Overlapping and touching intervals as one, clipped to [0, contig length); empty ones are dropped."""
    own = intervals.select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    if contigs is not None:
        own = own.join(contigs.select("chrom", "len"), "chrom").select("chrom", "start", F.least("end", "len").alias("end"))
    own = own.select("chrom", F.greatest("start", F.lit(0)).alias("start"), "end").where("end > start")
    before = Window.partitionBy("chrom").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    up_to = Window.partitionBy("chrom").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.coalesce((F.col("start") > F.max("end").over(before)).cast("int"), F.lit(1))
    islands = own.withColumn("opens", opens).withColumn("island", F.sum("opens").over(up_to))
    return islands.groupBy("chrom", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def _binned(df: DataFrame, start: str, end: str, size: int) -> DataFrame:
    last = F.greatest(F.floor((F.col(end) - 1) / size), F.floor(F.col(start) / size))
    return df.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / size), last)))


def overlap_join(left: DataFrame, right: DataFrame, size: int = BIN) -> DataFrame:
    """Pairs of rows of ``left`` (chrom, start, end, ...) and ``right`` (chrom, r_start, r_end, ...) that overlap, each once.

    A pair that shares several bins is kept in the first of them only.
    """
    pairs = _binned(left, "start", "end", size).join(_binned(right, "r_start", "r_end", size), ["chrom", "__bin"])
    first = F.col("__bin") == F.greatest(F.floor(F.col("start") / size), F.floor(F.col("r_start") / size))
    return pairs.where(first & (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end"))).drop("__bin")


def shared_bases(start: str = "start", end: str = "end", r_start: str = "r_start", r_end: str = "r_end") -> Column:
    return F.greatest(F.lit(0), F.least(F.col(end), F.col(r_end)) - F.greatest(F.col(start), F.col(r_start)))


#: Bytes of merged targets, cut at bins, that travel to all tasks.
BROADCAST_BYTES = 32 << 20


def _few(targets: DataFrame) -> bool:
    """Whether the targets' bins fit BROADCAST_BYTES: 40 bytes a piece and a bin."""
    last = targets.groupBy("chrom").agg(F.max("end").alias("end"), F.sum(F.floor((F.col("end") - F.col("start")) / BIN) + 2).alias("pieces"))
    n = last.agg(F.sum(F.floor(F.col("end") / BIN) + 1 + F.col("pieces"))).first()[0] or 0
    return 40 * n <= BROADCAST_BYTES


def _bins(targets: DataFrame) -> DataFrame:
    """chrom, __bins: for each bin from 0 on, the pieces (s, e) of disjoint targets in it."""
    pieces = _binned(targets.select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")), "start", "end", BIN)
    piece = F.struct(F.greatest("start", F.col("__bin") * BIN).alias("s"), F.least("end", (F.col("__bin") + 1) * BIN).alias("e"))
    held = pieces.groupBy("chrom", "__bin").agg(F.collect_list(piece).alias("t"))
    every = held.groupBy("chrom").agg(F.max("__bin").alias("last")).select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("__bin"))
    filled = every.join(held, ["chrom", "__bin"], "left").withColumn("t", F.coalesce("t", F.array().cast("array<struct<s: bigint, e: bigint>>")))
    rows = filled.groupBy("chrom").agg(F.array_sort(F.collect_list(F.struct("__bin", "t"))).alias("b"))
    return rows.select("chrom", F.col("b.t").alias("__bins"))


def _on_bins(start: Column, end: Column) -> Column:
    """Bases of [start, end) on the pieces in ``__bins``; null where there are none."""
    first = F.floor(start / BIN).cast("int")
    near = F.flatten(F.slice("__bins", first + 1, F.greatest(F.floor((end - 1) / BIN).cast("int") - first, F.lit(0)) + 1))
    return F.aggregate(near, F.lit(0).cast("long"), lambda a, t: a + F.greatest(F.lit(0).cast("long"), F.least(end, t.e) - F.greatest(start, t.s)))


def interval_overlap(blocks: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Per key of ``blocks`` (key, chrom, start, end): bases on merged targets; keys without any are absent.

    Targets that fit BROADCAST_BYTES travel as arrays of bins, and each block sums its own bases where it is, so a bin
    that most reads hit is no one's load; more targets meet the blocks in a join on bins.
    """
    if _few(targets):
        own = blocks.join(F.broadcast(_bins(targets)), "chrom").withColumn("__on", _on_bins(F.col("start").cast("long"), F.col("end").cast("long")))
        return own.where(F.col("__on") > 0).groupBy(key).agg(F.sum("__on").alias("overlap"))
    right = targets.select("chrom", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return overlap_join(blocks, right).groupBy(key).agg(F.sum(shared_bases()).alias("overlap"))


def on_target(alignments: DataFrame, targets: DataFrame) -> DataFrame:
    """Per alignment (read_id, chrom, pos, blocks, pore): aligned and on-target bases; those without aligned bases are dropped. ``targets`` are merged."""
    aligned = F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a + (b.end - b.start))
    own = alignments.withColumn("aligned", aligned).where("aligned > 0")
    if _few(targets):
        each = F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a + _on_bins(b.start, b.end))
        return own.join(F.broadcast(_bins(targets)), "chrom", "left").withColumn("on_bases", F.coalesce(each, F.lit(0).cast("long"))).drop("__bins")
    blocks = own.select("read_id", "chrom", F.explode("blocks").alias("b")).select("read_id", "chrom", F.col("b.start").alias("start"), F.col("b.end").alias("end"))
    hit = interval_overlap(blocks, targets, "read_id")
    return own.join(hit, "read_id", "left").withColumn("on_bases", F.coalesce("overlap", F.lit(0))).drop("overlap")


def enrichment(measured: DataFrame, target_size: int, genome_size: int) -> DataFrame:
    """Totals of on_target rows: reads, aligned, on and off bases, mean coverages and their ratio (null if nothing is off target)."""
    total = measured.agg(F.count("*").alias("reads"), F.coalesce(F.sum("aligned"), F.lit(0)).alias("aligned"), F.coalesce(F.sum("on_bases"), F.lit(0)).alias("on_bases"))
    total = total.withColumn("off_bases", F.col("aligned") - F.col("on_bases"))
    on, off = F.col("on_bases") / F.lit(float(max(target_size, 1))), F.col("off_bases") / F.lit(float(max(genome_size - target_size, 1)))
    return total.withColumn("on_coverage", on).withColumn("off_coverage", off).withColumn("ratio", F.when(off > 0, on / off))


def pore_enrichment(measured: DataFrame) -> DataFrame:
    return measured.where("pore IS NOT NULL").groupBy("pore").agg(F.count("*").alias("reads"), F.sum("aligned").alias("aligned"), F.sum("on_bases").alias("on_bases"), F.sum(F.col("aligned") - F.col("on_bases")).alias("off_bases"))


def nearest_region(reads: DataFrame, regions: DataFrame, tolerance: int) -> DataFrame:
    """``reads`` (read_id, chrom, start, end) with the region (name, ord) whose ends are both within ``tolerance``.

    The least sum of the two distances wins, then the region's order. Chromosome names lose a leading chr. Starts meet
    in bins of the tolerance and their two neighbours, so the join is an equi-join.
    """
    bare = lambda c: F.regexp_replace(c, "^chr", "")
    width = max(1, tolerance)
    own = reads.withColumn("__chrom", bare("chrom")).withColumn("__bin", F.floor(F.col("start") / width))
    cells = regions.select(bare("chrom").alias("__chrom"), F.col("start").alias("g_start"), F.col("end").alias("g_end"), "name", F.col("ord").alias("g_ord"))
    cells = cells.withColumn("__bin", F.explode(F.transform(F.array(*(F.lit(d) for d in (-1, 0, 1))), lambda d: F.floor(F.col("g_start") / width) + d)))
    far_start, far_end = F.abs(F.col("start") - F.col("g_start")), F.abs(F.col("end") - F.col("g_end"))
    met = own.join(cells, ["__chrom", "__bin"]).where((far_start <= tolerance) & (far_end <= tolerance))
    best = met.groupBy("read_id").agg(F.min(F.struct((far_start + far_end).alias("distance"), F.col("g_ord").alias("ord"), "name")).alias("best"))
    return reads.join(best, "read_id", "left").withColumn("region", F.col("best.name")).withColumn("distance", F.col("best.distance")).drop("best")


def coord_match(reads: DataFrame, primers: DataFrame, tolerance: int) -> DataFrame:
    """nearest_region over primers that have one; if none has, each read's own locus is its name."""
    placed = primers.where("chrom IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL")
    if placed.isEmpty():
        return reads.withColumn("region", F.concat_ws("", "chrom", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))).withColumn("distance", F.lit(0).cast("long"))
    return nearest_region(reads, placed, tolerance)


def gene_annotate(amplicons: DataFrame, genes: DataFrame) -> DataFrame:
    """``amplicons`` (amplicon, chrom, start, end) with the first gene (gene, ord) that overlaps."""
    right = genes.select("chrom", F.col("start").alias("r_start"), F.col("end").alias("r_end"), "gene", F.col("ord").alias("g_ord"))
    first = overlap_join(amplicons, right).groupBy("amplicon").agg(F.min_by("gene", "g_ord").alias("gene"))
    return amplicons.join(first, "amplicon", "left")


def gene_exon_label(amplicons: DataFrame, exons: DataFrame) -> DataFrame:
    """Per amplicon all genes it overlaps as ``GENE_ex2-5,OTHER``: the range of exon numbers where any is known."""
    right = exons.select("chrom", F.col("start").alias("r_start"), F.col("end").alias("r_end"), "gene", "exon")
    spans = overlap_join(amplicons, right).groupBy("amplicon", "gene").agg(F.min("exon").alias("low"), F.max("exon").alias("high"))
    text = F.when(F.col("low").isNull(), F.col("gene")).when(F.col("low") == F.col("high"), F.concat("gene", F.lit("_ex"), F.col("low").cast("string"))).otherwise(F.concat("gene", F.lit("_ex"), F.col("low").cast("string"), F.lit("-"), F.col("high").cast("string")))
    labels = spans.groupBy("amplicon").agg(F.array_join(F.array_sort(F.collect_list(text)), ",").alias("label"))
    return amplicons.join(labels, "amplicon", "left")


def gene_counts(reads: DataFrame, genes: DataFrame) -> DataFrame:
    """Reads per overlapping gene; a read counts for each gene it overlaps, once."""
    right = genes.select("chrom", F.col("start").alias("r_start"), F.col("end").alias("r_end"), "gene")
    return overlap_join(reads, right).groupBy("gene").agg(F.count_distinct("read_id").alias("reads"))


def lane_assign(reads: DataFrame, by: str, gap: int = 5) -> DataFrame:
    """``reads`` (by, ord, start, end) with the first lane that is free ``gap`` bases before them, in order of start.

    Lanes depend on every read before, so a region is one task's work; regions are independent.
    """
    import heapq

    import pandas as pd

    def lanes(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["start", "end", "ord"])
        busy: list[tuple[int, int]] = []
        free: list[int] = []
        out, used = [], 0
        for start, end in zip(group["start"], group["end"], strict=True):
            while busy and busy[0][0] + gap <= start:
                heapq.heappush(free, heapq.heappop(busy)[1])
            if free:
                lane = heapq.heappop(free)
            else:
                lane, used = used, used + 1
            heapq.heappush(busy, (end, lane))
            out.append(lane)
        return group.assign(lane=out)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in reads.schema)
    return reads.groupBy(by).applyInPandas(lanes, f"{kinds}, lane int")

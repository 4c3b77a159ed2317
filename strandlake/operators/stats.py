"""Distributions, histograms and counters. Everything is one aggregation, or two where a first gives the bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upper_median(column: str) -> Column:
    """The element at n // 2 of the ascending values."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{column}` DESC)")


def distribution_stats(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """n, mean, upper median, population std, min and max; zeros for no rows at all."""
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return df.groupBy(*(by or [])).agg(F.count(column).alias("n"), zero(F.avg(column)).alias("mean"), zero(upper_median(column)).alias("median"), zero(F.stddev_pop(column)).alias("std"), zero(F.min(column)).alias("min"), zero(F.max(column)).alias("max"))


def median_avg(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """The mean of the two middle values; 0 without any."""
    return df.groupBy(*(by or [])).agg(F.coalesce(F.median(column), F.lit(0.0)).alias("median"))


def histogram(df: DataFrame, column: str, start: float, end: float, bins: int) -> DataFrame:
    """bin, start, end, count for every bin; values outside are dropped, the right edge belongs to the last bin."""
    width = (end - start) / bins
    value = F.col(column)
    placed = df.where(value.between(start, end)).select(F.least(F.floor((value - start) / width), F.lit(bins - 1)).cast("int").alias("bin"))
    counts = placed.groupBy("bin").agg(F.count("*").alias("count"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(counts), "bin", "left").select("bin", (start + F.col("bin") * width).alias("start"), (start + (F.col("bin") + 1) * width).alias("end"), F.coalesce("count", F.lit(0)).alias("count"))


def length_bin_width(longest: int) -> int:
    """50 up to 5,000 bases, 100 up to 20,000, then 250; the range is never below 1,000."""
    return 50 if max(longest, 1000) <= 5000 else 100 if longest <= 20000 else 250


def histogram_mode(counts: DataFrame) -> DataFrame:
    """The centre of the last of the fullest bins; one row."""
    return counts.agg(F.max_by((F.col("start") + F.col("end")) / 2, F.struct("count", "bin")).alias("mode"))


def density_points(counts: DataFrame) -> DataFrame:
    """Bin centres and densities: count over total and width."""
    total = F.sum("count").over(Window.partitionBy())
    return counts.select("bin", ((F.col("start") + F.col("end")) / 2).alias("x"), F.when(total > 0, F.col("count") / total / (F.col("end") - F.col("start"))).otherwise(0.0).alias("density"))


def length_histogram(reads: DataFrame, width: int, by_bases: bool = False, column: str = "length") -> DataFrame:
    """Reads, or their bases, for each length bin that occurs."""
    bin_start = (F.floor(F.col(column) / width) * width).cast("long")
    return reads.groupBy(bin_start.alias("bin_start")).agg((F.sum(column) if by_bases else F.count("*")).cast("long").alias("value"))


def kde_density(values: DataFrame, column: str, low: float, high: float, points: int = 200) -> DataFrame:
    """A Gaussian kernel density (Scott's bandwidth) on a grid: x, density. The mode is its largest.

    Values are first counted on a grid eight times as fine as a bandwidth, so the sum is over grid cells, not rows.
    """
    n, std = values.where(F.col(column).isNotNull()).agg(F.count(column), F.stddev_samp(column)).first()
    if not n or not std:
        return values.sparkSession.createDataFrame([], "x double, density double")
    width = std * n ** (-1 / 5)
    cell = width / 8
    cells = values.where(F.col(column).isNotNull()).groupBy(F.floor(F.col(column) / cell).alias("c")).agg(F.count("*").alias("n"), F.avg(column).alias("at"))
    step = (high - low) / (points - 1)
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k")
    near = cells.select("n", "at", grid).withColumn("z", (low + F.col("k") * step - F.col("at")) / width)
    summed = near.groupBy("k").agg(F.sum(F.col("n") * F.exp(-F.col("z") * F.col("z") / 2)).alias("s"))
    return summed.select((low + F.col("k") * step).alias("x"), (F.col("s") / (n * width * (2 * 3.141592653589793) ** 0.5)).alias("density"))


def read_stats(reads: DataFrame, min_qs: float, min_len: int) -> DataFrame:
    """Reads (length, qs) that pass, as totals: reads, passed, bases, n50 aside."""
    ok = (F.col("qs") >= min_qs) & (F.col("length") >= min_len)
    return reads.agg(F.count("*").alias("total"), F.count_if(ok).alias("passed"), F.coalesce(F.sum(F.when(ok, F.col("length"))), F.lit(0)).alias("bases"), F.avg(F.when(ok, F.col("qs"))).alias("mean_qs"))


def amplicon_stats(assigned: DataFrame, ids: bool = False) -> DataFrame:
    """Per amplicon: count, upper-median and population std of length, mean qs; ``ids`` adds the reads, which may be many."""
    found = [F.count("*").alias("count"), upper_median("length").cast("double").alias("median_length"), F.stddev_pop("length").alias("std_length"), F.avg("qs").alias("avg_qs")]
    return assigned.groupBy("amplicon").agg(*found, *([F.array_sort(F.collect_list("read_id")).alias("read_ids")] if ids else []))


def amplicon_region(assigned: DataFrame) -> DataFrame:
    """Per amplicon of placed reads: the first read's chromosome, upper medians of start and end."""
    placed = assigned.where("chrom IS NOT NULL")
    return placed.groupBy("amplicon").agg(F.min_by("chrom", "ord").alias("chrom"), upper_median("start").alias("start"), upper_median("end").alias("end"))


def amplicon_stats_plain(reads: DataFrame) -> DataFrame:
    """Per amplicon: count, and mean, mid-pair median and population std of length and qs."""
    both = [f(c).cast("double").alias(f"{n}_{c}") for c in ("length", "qs") for n, f in (("mean", F.avg), ("median", F.median), ("std", F.stddev_pop))]
    return reads.groupBy("amplicon").agg(F.count("*").alias("count"), *both)


def run_stats(reads: DataFrame) -> DataFrame:
    """One row for each file and one for the whole run, in a single pass by grouping sets."""
    sets = reads.groupingSets([[], [F.col("file")]], "file")
    found = sets.agg(F.count("*").alias("reads"), F.sum("length").alias("bases"), F.avg("length").alias("mean_length"), F.avg("qs").alias("mean_qs"), F.max("length").alias("longest"))
    return found.withColumn("file", F.coalesce("file", F.lit("Whole Run")))


def align_counts(records: DataFrame) -> DataFrame:
    """Per barcode, from flags: records, primary, mapped, unmapped, supplementary, secondary."""
    flag = F.col("flag")
    has = lambda bit: flag.bitwiseAND(bit) != 0
    primary = ~has(0x100) & ~has(0x800)
    return records.groupBy("barcode").agg(F.count("*").alias("records"), F.count_if(primary).alias("primary"), F.count_if(primary & ~has(4)).alias("mapped"), F.count_if(primary & has(4)).alias("unmapped"), F.count_if(has(0x800)).alias("supplementary"), F.count_if(has(0x100) & ~has(0x800)).alias("secondary"))


def read_counts(reads: DataFrame, min_len: int, max_len: int, min_qv: float) -> DataFrame:
    """Per barcode: seen, passed, failed_len, failed_qv, bases of passed reads; a wrong length goes before a low quality."""
    wrong = ~F.col("length").between(min_len, max_len)
    low = ~wrong & (F.col("qv") < min_qv)
    ok = ~wrong & (F.col("qv") >= min_qv)
    return reads.groupBy("barcode").agg(F.count("*").alias("seen"), F.count_if(ok).alias("passed"), F.count_if(wrong).alias("failed_len"), F.count_if(low).alias("failed_qv"), F.coalesce(F.sum(F.when(ok, F.col("length"))), F.lit(0)).alias("bases"))


def dashboard_merge(parts: DataFrame) -> DataFrame:
    """Partial results of one amplicon (name, count, avg_qs, median, std) as one: counts add, the others average by count."""
    weighted = lambda c: (F.sum(F.col(c) * F.col("count")) / F.sum("count")).alias(c)
    return parts.where("count > 0").groupBy("name").agg(F.sum("count").alias("count"), weighted("avg_qs"), weighted("median"), weighted("std"))


def merge_histograms(parts: DataFrame) -> DataFrame:
    """Histograms (start, end, count) added bin by bin."""
    return parts.groupBy("start", "end").agg(F.sum("count").alias("count"))


def histogram_median(counts: DataFrame) -> DataFrame:
    """The centre of the bin where the running count reaches half; the first fullest bin's is the mode."""
    running = counts.withColumn("run", F.sum("count").over(Window.orderBy("start"))).withColumn("total", F.sum("count").over(Window.partitionBy()))
    centre = (F.col("start") + F.col("end")) / 2
    return running.agg(F.min(F.when(F.col("run") * 2 >= F.col("total"), centre)).alias("median"), F.max_by(centre, F.struct("count", -F.col("start"))).alias("mode"))


def depth_summary(sites: DataFrame, min_depth: int) -> DataFrame:
    """Depth rows (site, depth, ord): the last row of a site counts. Sites, covered sites, least and upper-median depth."""
    last = sites.groupBy("site").agg(F.max_by("depth", "ord").alias("depth"))
    return last.agg(F.count("*").alias("sites"), F.count_if(F.col("depth") >= min_depth).alias("covered"), F.min("depth").alias("min_depth"), upper_median("depth").alias("median_depth"))


def sufficiency(fusion_called: Column, covered: Column, sites: Column) -> Column:
    """Whether a fusion is called and at least 95 % of the sites are covered."""
    return fusion_called & (sites > 0) & (covered / sites >= 0.95)


def history_series(snapshots: DataFrame) -> DataFrame:
    """Points (mutation, generation, reads_passed, vaf) of snapshots that hold arrays of mutations."""
    return snapshots.select("generation", "reads_passed", F.explode("mutations").alias("m")).select(F.col("m.name").alias("mutation"), "generation", "reads_passed", F.col("m.vaf").alias("vaf"))


def isoform_changed(snapshots: DataFrame, by: str = "barcode") -> DataFrame:
    """Per key: whether two neighbouring primary calls that aren't null ever differ, by generation."""
    called = snapshots.where("isoform IS NOT NULL").withColumn("last", F.lag("isoform").over(Window.partitionBy(by).orderBy("generation")))
    return called.groupBy(by).agg(F.coalesce(F.bool_or(F.col("last") != F.col("isoform")), F.lit(False)).alias("changed"))


def top_n(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key; the limit is pushed below the shuffle."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__k") <= n).drop("__k")


def top_n_reads(assigned: DataFrame, n: int) -> DataFrame:
    """The n best reads of each amplicon; of equal quality the earlier stay."""
    return top_n(assigned, "amplicon", [F.desc("qs"), F.col("ord")], n)


def first_n_per_key(reads: DataFrame, by: str, n: int) -> DataFrame:
    return top_n(reads, by, [F.col("ord")], n)


def max_reads(reads: DataFrame, n: int) -> DataFrame:
    """The first n reads by arrival."""
    return reads.orderBy("ord").limit(n)


def rolling_last_n(reads: DataFrame, n: int) -> DataFrame:
    """The n newest reads, by a top-k on arrival, not a sort."""
    return reads.orderBy(F.desc("ord")).limit(n)


def top_k_groups(df: DataFrame, by: str, k: int) -> DataFrame:
    """The k most frequent keys; equal counts by the key."""
    return df.groupBy(by).agg(F.count("*").alias("count")).orderBy(F.desc("count"), by).limit(k)

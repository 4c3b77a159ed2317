"""How long pores wait between reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve_timing(reads: DataFrame, speed: float | None = None, summary: DataFrame | None = None) -> DataFrame:
    """``reads`` (read_id, ord, ch, mx, start_s, end_s, duration_s, length) with start_s and end_s settled.

    A stated end goes before start plus duration, that before start plus length over ``speed``. A summary row (read_id,
    s_ch, s_mx, s_start, s_duration) overrides all of them. Reads without a channel or a start are dropped.
    """
    if summary is not None:
        reads = reads.join(summary.select("read_id", "s_ch", "s_mx", "s_start", "s_duration"), "read_id", "left")
        listed = F.col("s_start").isNotNull()
        reads = reads.withColumn("ch", F.coalesce("s_ch", "ch")).withColumn("mx", F.coalesce("s_mx", "mx")).withColumn("end_s", F.when(~listed, F.col("end_s")).otherwise(F.col("s_start") + F.col("s_duration")))
        reads = reads.withColumn("start_s", F.coalesce("s_start", "start_s")).drop("s_ch", "s_mx", "s_start", "s_duration")
    guessed = [F.col("start_s") + F.col("length") / speed] if speed else []
    end = F.coalesce(F.col("end_s"), F.col("start_s") + F.col("duration_s"), *guessed)
    return reads.withColumn("end_s", end).where("ch IS NOT NULL AND start_s IS NOT NULL AND end_s IS NOT NULL").withColumn("mx", F.coalesce("mx", F.lit(0)))


def speed_estimate(reads: DataFrame) -> DataFrame:
    """One row: bases per second over reads with a positive duration; null without any."""
    timed = reads.where("duration_s > 0")
    return timed.agg((F.sum("length") / F.sum("duration_s")).alias("speed"))


def _order() -> Window:
    return Window.partitionBy("ch", "mx").orderBy("start_s", "ord")


def idle_gaps(timings: DataFrame, max_idle: float) -> DataFrame:
    """``timings`` (ch, mx, start_s, end_s, ord) with idle: seconds since the pore's read before, at least 0.

    A pore's first read has none; gaps of ``max_idle`` or more are breaks, not waits, and are dropped.
    """
    gap = F.col("start_s") - F.lag("end_s").over(_order())
    found = timings.withColumn("gap", gap).where("gap IS NOT NULL").withColumn("idle", F.greatest(F.col("gap"), F.lit(0.0))).drop("gap")
    return found.where((F.col("idle") < max_idle) & ~F.isnan("idle"))


def _stats(idles: DataFrame, long_idle: float, by: list[str]) -> DataFrame:
    return idles.groupBy(*by).agg(F.count("*").alias("idle_count"), F.avg("idle").alias("mean_idle_s"), F.median("idle").alias("median_idle_s"), F.count_if(F.col("idle") > long_idle).alias("long_idles"))


def pore_idle(timings: DataFrame, max_idle: float = 3600.0, long_idle: float = 60.0) -> DataFrame:
    """Per pore (ch, mx): idle_count, mean, median and long idles; most long idles first, then by ch and mx."""
    return _stats(idle_gaps(timings, max_idle), long_idle, ["ch", "mx"]).orderBy(F.desc("long_idles"), "ch", "mx")


def pore_idle_total(timings: DataFrame, max_idle: float = 3600.0, long_idle: float = 60.0) -> DataFrame:
    """The same over all pores, with the percentage of long idles; zeros without any."""
    total = _stats(idle_gaps(timings, max_idle), long_idle, [])
    share = F.when(F.col("idle_count") > 0, F.col("long_idles") * 100.0 / F.col("idle_count")).otherwise(0.0)
    return total.select("idle_count", F.coalesce("mean_idle_s", F.lit(0.0)).alias("mean_idle_s"), F.coalesce("median_idle_s", F.lit(0.0)).alias("median_idle_s"), "long_idles", share.alias("long_idle_pct"))


def start_gaps(timings: DataFrame, most: float = 3600.0, long_gap: float = 60.0) -> DataFrame:
    """Per pore, from starts alone: gaps below ``most``, their mean, and those above ``long_gap``."""
    gaps = timings.withColumn("gap", F.col("start_s") - F.lag("start_s").over(_order())).where(F.col("gap") < most)
    return gaps.groupBy("ch", "mx").agg(F.count("*").alias("gaps"), F.avg("gap").alias("mean_gap_s"), F.count_if(F.col("gap") > long_gap).alias("long_gaps"))


def top_channels(timings: DataFrame, k: int = 10, max_idle: float = 3600.0, long_idle: float = 60.0) -> DataFrame:
    """The k pores with the most long idles: a top-k, not a sort."""
    return pore_idle(timings, max_idle, long_idle).limit(k)


def progress_reads(timings: DataFrame, every: int) -> Column:
    """The number of the progress step that a read belongs to, by arrival."""
    return F.floor((F.col("ord") - 1) / every).cast("long")

"""Which reads pass. Predicates are cheap before dear: lengths, channels and times before qualities."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SECONDARY, SUPPLEMENTARY = 0x100, 0x800


@dataclass(frozen=True)
class ReadFilter:
    """Closed ranges; what is not set is not asked. A read without a channel or time fails a range of them."""

    min_qv: float = 0.0
    min_len: int = 0
    max_len: int | None = None
    channels: tuple[int, int] | None = None
    window: tuple[datetime, datetime] | None = None


def passes(f: ReadFilter, length: Column, channel: Column | None = None, start: Column | None = None, qv: Column | None = None) -> Column:
    out = length >= f.min_len
    if f.max_len is not None:
        out &= length <= f.max_len
    if f.channels:
        out &= F.coalesce(channel.between(*f.channels), F.lit(False))
    if f.window:
        out &= F.coalesce(start.between(*(F.lit(t) for t in f.window)), F.lit(False))
    return out & (qv >= f.min_qv) if f.min_qv > 0 else out


def filter_reads(reads: DataFrame, f: ReadFilter, *, seq: str = "seq", channel: str = "channel", start: str = "start_time", qv: str = "qv") -> DataFrame:
    """The reads that pass; columns that no range asks for need not exist."""
    col = lambda name: F.col(name) if name in reads.columns else None
    return reads.where(passes(f, F.length(seq), col(channel), col(start), col(qv)))


def extract_channels(reads: DataFrame, low: int, high: int, *, channel: str = "channel") -> DataFrame:
    """All reads of channels low to high, whatever their length or quality."""
    return reads.where(F.col(channel).between(low, high))


def primary_only(alignments: DataFrame, flag: str = "flag") -> DataFrame:
    """Neither secondary nor supplementary."""
    return alignments.where(F.col(flag).bitwiseAND(SECONDARY | SUPPLEMENTARY) == 0)


def duplex_only(reads: DataFrame, dx: str = "dx") -> DataFrame:
    return reads.where(F.col(dx) == 1)


def py_read_filter(reads: DataFrame, min_qs: float, min_len: int, max_len: int | None, allow_unmapped: bool = False, duplex: bool = False) -> DataFrame:
    """The older filter: columns mapped, dx, length, qs; a read without qs passes the quality threshold."""
    keep = (F.col("length") >= min_len) & F.coalesce(F.col("qs") >= min_qs, F.lit(True))
    if max_len is not None:
        keep &= F.col("length") <= max_len
    if not allow_unmapped:
        keep &= F.col("mapped")
    if duplex:
        keep &= F.coalesce(F.col("dx") == 1, F.lit(False))
    return reads.where(keep)


def gui_mask(reads: DataFrame, min_qs: float, min_len: int, max_len: int, duplex: bool = False) -> DataFrame:
    """Thresholds of the display; a largest length of 0 is none."""
    keep = (F.col("qs") >= min_qs) & (F.col("length") >= min_len)
    if max_len:
        keep &= F.col("length") <= max_len
    return reads.where(keep & (F.col("dx") == 1)) if duplex else reads.where(keep)


def join_summary(reads: DataFrame, summary: DataFrame, how: str = "left") -> DataFrame:
    """Reads with their summary row by read_id; ``inner`` drops reads that the summary lacks."""
    return reads.join(summary, "read_id", how)


def summary_select(reads: DataFrame, summary: DataFrame, barcode: str | None = None, both_ends: float | None = None) -> DataFrame:
    """``reads`` with verdict and qs. In this order: NotInSummary, OtherBarcode, NotBothEnds, Keep.

    ``summary``: read_id, barcode, front_score, rear_score, qscore. A read that it lacks is kept if neither a barcode nor
    both ends are asked for. The summary's qscore goes before the read's own qs.
    """
    listed = summary.select("read_id", F.col("barcode").alias("__bc"), "front_score", "rear_score", F.col("qscore").alias("__qs"), F.lit(True).alias("__in"))
    joined = reads.join(listed, "read_id", "left")
    verdict = F.when(F.col("__in").isNull(), F.lit("NotInSummary" if barcode is not None or both_ends is not None else "Keep"))
    if barcode is not None:
        verdict = verdict.when(~F.coalesce(F.col("__bc") == barcode, F.lit(False)), F.lit("OtherBarcode"))
    if both_ends is not None:
        both = (F.col("front_score") >= both_ends) & (F.col("rear_score") >= both_ends)
        verdict = verdict.when(~F.coalesce(both, F.lit(False)), F.lit("NotBothEnds"))
    own = F.col("qs") if "qs" in reads.columns else F.lit(None).cast("double")
    return joined.withColumn("verdict", verdict.otherwise(F.lit("Keep"))).withColumn("qs", F.coalesce("__qs", own)).drop("__bc", "__qs", "__in", "front_score", "rear_score")


def selection_stats(judged: DataFrame) -> DataFrame:
    return judged.groupBy("verdict").agg(F.count("*").alias("reads"))


def time_bounds(reads: DataFrame, start: str = "start_time") -> DataFrame:
    """One row: the first and the last start; nulls are left out."""
    return reads.agg(F.min(start).alias("first_start"), F.max(start).alias("last_start"))


def file_kind(path: str) -> str:
    """bam or fastq, by the name."""
    low = path.lower()
    if low.endswith(".bam"):
        return "bam"
    if low.removesuffix(".gz").endswith((".fastq", ".fq")):
        return "fastq"
    raise ValueError(f"neither BAM nor FASTQ: {path}")


def filter_convert(spark: SparkSession, source: str, target: str, f: ReadFilter, to: str = "auto", *, kind: str = "auto", compress: bool = False) -> None:
    """The reads of ``source`` (a file, or a folder if ``kind`` says of what) that pass, as files below ``target``, in any of the four routes.

    ``to`` is bam or fastq; auto goes by the name of ``target``. What comes from BAM are its primary records, in reading
    direction and without an aligner's tags; into BAM go unaligned records. Qualities, ids, channels and times travel as
    tags or header fields.
    """
    from ..functions import header as H
    from ..functions import quality as Q
    from ..functions.timing import parse_timestamp_multi
    from ..sinks.files import sink_bam, sink_fastq
    from ..sources.bam import scan_bam, unaligned_copy
    from ..sources.fastq import scan_fastq

    came = file_kind(source) if kind == "auto" else kind
    goes = file_kind(target) if to == "auto" else to
    if came == "bam":
        own = unaligned_copy(scan_bam(spark, source))
        qual = F.when(F.exists("scores", lambda q: q != 255), F.array_join(F.transform("scores", Q.phred_to_ascii), ""))
        tag = lambda *names: F.coalesce(*(F.try_element_at("tags", F.lit(n)) for n in names))
        fields = F.array_join(F.transform(F.map_entries("tags"), lambda t: F.concat(t.key, F.lit(":Z:"), t.value)), " ")
        own = own.withColumns({"qual": qual, "channel": tag("ch").try_cast("long"), "start_time": parse_timestamp_multi(tag("st")), "qv": Q.bam_qv(F.col("tags"), F.col("scores"), F.lit(False)), "header": F.trim(F.concat(F.lit("@"), "read_id", F.lit(" "), fields))})
    else:
        m = H.parse_header(scan_fastq(spark, source))
        split = H.is_split_read(F.col("meta.read_id"), F.col("meta.parent_read_id"))
        own = m.withColumns({"channel": F.col("meta.channel"), "start_time": parse_timestamp_multi(F.col("meta.start_time")), "qv": Q.read_mean_qv(F.col("meta.mean_qscore"), F.col("qual"), split), "flag": F.lit(4), "scores": Q.ascii_scores(F.col("qual")), "tags": H.header_tags(F.col("header"))})
    kept = filter_reads(own, f)
    if goes == "bam":
        sink_bam(kept.select("read_id", "flag", "seq", "scores", "tags"), target, [])
    else:
        sink_fastq(kept.select("header", "seq", "qual"), target, compress=compress)


def export_reads(reads: DataFrame, assigned: DataFrame, amplicons: list[str]) -> DataFrame:
    """Reads of the chosen amplicons with the plain mean of their scores; ``assigned``: read_id, amplicon."""
    chosen = assigned.where(F.col("amplicon").isin(amplicons)).select("read_id", "amplicon")
    scores = F.transform(F.split("qual", ""), lambda c: F.when(c == "", F.lit(0)).otherwise(F.ascii(c) - 33))
    mean = F.aggregate(scores, F.lit(0).cast("long"), lambda a, q: a + q) / F.length("qual")
    return reads.join(chosen, "read_id").withColumn("mean_score", F.when(F.length("qual") > 0, mean).otherwise(0.0))


def export_region(alignments: DataFrame, chrom: str, start: int, end: int, margin: int = 100) -> DataFrame:
    """Alignments whose ends both lie within ``margin`` of a region's."""
    return alignments.where((F.col("chrom") == chrom) & (F.abs(F.col("pos") - start) <= margin) & (F.abs(F.col("end") - end) <= margin))

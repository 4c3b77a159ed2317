"""Molecular barcodes (UMIs): finding them in reads, families, and what is reported of families."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alignment import iupac_distance
from ..functions.sequence import IUPAC_BASES
from ..shared import scratch, written
from .clustering import numbered, star_clusters

#: Fixed values of the method: the stretch that a window must share with an anchor, and the length changes tried in turn.
GATE, DELTAS = 8, (0, -2, 2, -4, 4)


@dataclass(frozen=True)
class UmiConfig:
    fwd_context: str
    rev_context: str
    fwd_pattern: str
    rev_pattern: str
    max_edit: int = 3
    window: int = 250
    min_umi: int = 20
    max_umi: int = 40
    min_len: int = 0
    max_len: int = 1 << 40
    min_q: float = 0.0
    amplicon_size: int = 0
    size_tolerance: int | None = None
    normalize: bool = True
    gate: bool = True


def _levenshtein(a: str, b: str, most: int) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return most + 1
    return row[-1]


def scan(text: str, anchor: str, most: int, gate: bool = True) -> tuple[int, int] | None:
    """(start, distance) of the first best window; with the gate, only windows that share an 8-mer with the anchor are asked."""
    n = len(anchor)
    shared = {anchor[i : i + GATE] for i in range(n - GATE + 1)} if gate and n >= GATE else None
    best = None
    hits = None if shared is None else [i for i in range(len(text) - GATE + 1) if text[i : i + GATE] in shared]
    starts = range(len(text) - n + 1) if hits is None else sorted({s for h in hits for s in range(max(0, h - n + GATE), min(h, len(text) - n) + 1)})
    for i in starts:
        d = _levenshtein(text[i : i + n], anchor, most if best is None else best[1] - 1)
        if d <= most and (best is None or d < best[1]):
            best = i, d
            if d == 0:
                break
    return best


def _extract(text: str, at: int, pattern: str, c: UmiConfig, before: bool = False) -> tuple[str, int] | None:
    best = None
    for delta in DELTAS:
        n = len(pattern) + delta
        if not max(1, c.min_umi // 2) <= n <= c.max_umi:
            continue
        a, b = (at - n, at) if before else (at, at + n)
        if a < 0 or b > len(text):
            continue
        d = iupac_distance(text[a:b], pattern)
        if d <= c.max_edit and (best is None or d < best[1]):
            best = text[a:b], d
        if d == 0:
            break
    return best


def _flip(seq: str) -> str:
    return "".join({"A": "T", "C": "G", "G": "C", "T": "A"}.get(b, "N") for b in reversed(seq))


def _wildcards(seq: str, pattern: str) -> str | None:
    """The bases at the pattern's open places; what is longer than the pattern is cut to its length, what is shorter has none."""
    return "".join(s for s, p in zip(seq, pattern, strict=False) if len(IUPAC_BASES[p]) > 1) if len(seq) >= len(pattern) else None


def detect(seq: str, mean_q: float, c: UmiConfig) -> dict | None:
    """The UMI of one read: strand by the better anchor at its start (forward if equal), then the partner at its end."""
    n = len(seq)
    if not c.min_len <= n <= c.max_len or mean_q < c.min_q:
        return None
    w = min(c.window, n)
    head, tail = seq[:w], seq[n - w :]
    fwd, rev = scan(head, c.fwd_context, c.max_edit, c.gate), scan(head, c.rev_context, c.max_edit, c.gate)
    if fwd is None and rev is None:
        return None
    forward = rev is None or fwd is not None and fwd[1] <= rev[1]
    first, partner = (fwd, c.rev_context) if forward else (rev, c.fwd_context)
    last = scan(tail, partner, c.max_edit, c.gate)
    span = n - w + last[0] - first[0] if last else None
    insert = span if span is not None and span >= 0 else None
    if c.amplicon_size:
        tolerance = c.amplicon_size // 5 if c.size_tolerance is None else c.size_tolerance
        if insert is None or abs(insert - c.amplicon_size) > tolerance:
            return None
    if forward:
        f = _extract(head, first[0] + len(c.fwd_context), c.fwd_pattern, c)
        r = _extract(tail, last[0] + len(c.rev_context), c.rev_pattern, c) if last else None
    else:
        r = _extract(head, first[0] + len(c.rev_context), c.fwd_pattern, c)
        r = r and (_flip(r[0]), r[1])
        f = _extract(tail, last[0], c.fwd_pattern, c, before=True) if last else None
    combined = f[0] + r[0] if f and r else None
    normalized = combined
    if combined and c.normalize:
        a, b = _wildcards(f[0], c.fwd_pattern), _wildcards(r[0], c.rev_pattern)
        normalized = a + b if a is not None and b is not None else combined
    return {"strand": "fwd" if forward else "rev", "umi_fwd": f and f[0], "umi_fwd_dist": f and f[1], "umi_rev": r and r[0], "umi_rev_dist": r and r[1], "combined": combined, "normalized": normalized, "insert_size": insert}


UMI = "strand string, umi_fwd string, umi_fwd_dist int, umi_rev string, umi_rev_dist int, combined string, normalized string, insert_size int"


def detect_umi(reads: DataFrame, config: UmiConfig) -> DataFrame:
    """``reads`` (seq, mean_q) with ``umi``; its fields are null where none is found. An Arrow function, row by row inside."""

    @F.pandas_udf(UMI)
    def find(seq: pd.Series, q: pd.Series) -> pd.DataFrame:
        none = dict.fromkeys(f.split()[0] for f in UMI.split(", "))
        rows = [(s and detect(s.upper(), float(x), config)) or none for s, x in zip(seq, q, strict=True)]
        return pd.DataFrame(rows).astype({"umi_fwd_dist": "Int32", "umi_rev_dist": "Int32", "insert_size": "Int32"})

    return reads.withColumn("umi", find("seq", F.coalesce(F.col("mean_q").cast("double"), F.lit(0.0))))


def families_exact(keyed: DataFrame) -> DataFrame:
    """``keyed`` (key, ord, ...) with family, from 0 in order of first arrival; rows without a key are dropped."""
    own = keyed.where("key IS NOT NULL")
    numbers = numbered(own.groupBy("key").agg(F.min("ord").alias("first_ord")), "first_ord", name="family")
    return own.join(numbers.select("key", "family"), "key")


def families_approx(keyed: DataFrame, most: int, also: Column | None = None) -> DataFrame:
    """As families_exact, of keys within ``most`` edits of the family's first: greedy, in order of arrival. ``also`` is asked of pairs of keys a and b."""
    own = keyed.where("key IS NOT NULL")
    clusters = star_clusters(own.groupBy("key").agg(F.min("ord").alias("ord")), most, also)
    numbers = numbered(clusters.groupBy("centre").agg(F.min("centre_ord").alias("first_ord")), "first_ord", name="family")
    named = clusters.join(numbers, "centre").select("key", "family", F.col("centre").alias("consensus_umi"))
    return own.join(named, "key")


def families_identity(keyed: DataFrame, identity: float) -> DataFrame:
    """The form by identity: of each pair of keys, at most (1 - identity) of the longer one's length may differ."""
    longest = keyed.agg(F.max(F.length("key"))).first()[0] or 0
    most = F.greatest(F.length("a"), F.length("b")) * (1 - identity) + 1e-9
    return families_approx(keyed, int(longest * (1 - identity) + 1e-9), F.levenshtein("a", "b") <= most)


def family_filter(members: DataFrame, min_reads: int, max_reads: int, balance: bool = False) -> DataFrame:
    """``members`` (family, ord, strand) with family_reads, passing and written.

    Families below ``min_reads`` fail. Larger ones than ``max_reads`` write the first so many, or with ``balance`` the
    first half as many of each strand; a read without a strand is written while fewer than ``max_reads`` stranded ones are.
    """
    own = Window.partitionBy("family")
    arrival = own.orderBy("ord")
    out = members.withColumn("family_reads", F.count("*").over(own)).withColumn("passing", F.col("family_reads") >= min_reads)
    if balance:
        rank = F.row_number().over(Window.partitionBy("family", "strand").orderBy("ord"))
        out = out.withColumn("__k", rank)
        stranded = F.col("strand").isNotNull() & (F.col("__k") <= max_reads // 2)
        seen = F.sum(stranded.cast("int")).over(arrival.rowsBetween(Window.unboundedPreceding, -1))
        kept = stranded | (F.col("strand").isNull() & (F.coalesce(seen, F.lit(0)) < max_reads))
    else:
        out = out.withColumn("__k", F.row_number().over(arrival))
        kept = F.col("__k") <= max_reads
    small = F.col("family_reads") <= max_reads
    return out.withColumn("written", F.col("passing") & (small | kept)).drop("__k")


def family_stats(filtered: DataFrame, min_reads: int, max_reads: int, balance: bool = False) -> DataFrame:
    """The fourteen columns of the family report; counts before and after downsampling are the true ones."""
    strand = lambda s, more: F.count_if((F.col("strand") == s) & more)
    yes = F.lit(True)
    g = filtered.groupBy("family").agg(
        F.min_by("consensus_umi", "ord").alias("consensus_umi"), F.count("*").alias("n_cluster_consensus"), strand("fwd", yes).alias("n_fwd"), strand("rev", yes).alias("n_rev"),
        strand("fwd", F.col("written")).alias("written_fwd"), strand("rev", F.col("written")).alias("written_rev"), F.count_if("written").alias("written"), F.max(F.col("passing").cast("int")).alias("cluster_written"),
    )
    return g.select(
        F.col("family").alias("id_cluster"), "consensus_umi", "n_cluster_consensus", F.lit(min_reads).alias("min_reads_required"), F.lit(max_reads).alias("max_reads_allowed"), F.lit(balance).alias("balance_strands"),
        "n_fwd", "n_rev", "written_fwd", "written_rev", F.col("written").alias("n"), (F.col("n_cluster_consensus") - F.col("written")).alias("skipped"), "written", "cluster_written",
    )


def umi_summary(stats: DataFrame, detected: DataFrame, sample: str, amplicon: str, normalized: bool, min_reads: int, max_reads: int) -> DataFrame:
    """The one-row summary of a sample, from family_stats rows and ``detected`` (key)."""
    n, passing = F.col("n_cluster_consensus"), F.col("cluster_written") == 1
    zero = lambda c: F.coalesce(c, F.lit(0))
    s = stats.agg(
        F.count("*").alias("total_clusters"), F.count_if(passing).alias("passing_clusters"), F.count_if(~passing).alias("failing_clusters"),
        F.coalesce(F.median(n), F.lit(0.0)).alias("median_reads_per_cluster"), F.coalesce(F.median(F.when(passing, n)), F.lit(0.0)).alias("median_reads_per_passing_cluster"),
        zero(F.max(n)).alias("max_cluster_reads"), zero(F.sum(n)).alias("reads_in_clusters"), zero(F.sum(F.when(passing, n))).alias("reads_in_passing_clusters"),
        zero(F.sum(F.when(~passing, n))).alias("reads_in_failing_clusters"), zero(F.sum(F.when(passing, F.least(n, F.lit(max_reads))))).alias("reads_written_for_consensus"),
        F.count_if(n > max_reads).alias("oversized_clusters"), zero(F.sum("n_fwd")).alias("__fwd"),
    )
    d = detected.agg(F.count("key").alias("detected_umi_reads"), F.count_distinct("key").alias("unique_detected_umis"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) * 100.0 / F.col(b)).otherwise(0.0)
    both = s.crossJoin(d)  # one row each
    return both.select(
        F.lit(sample).alias("sample"), F.lit(amplicon).alias("amplicon"), F.lit(normalized).alias("umi_normalized"), "detected_umi_reads", "unique_detected_umis", "total_clusters", "passing_clusters", "failing_clusters",
        "median_reads_per_cluster", "median_reads_per_passing_cluster", "max_cluster_reads", "reads_in_clusters", "reads_in_passing_clusters", "reads_in_failing_clusters", "reads_written_for_consensus",
        (F.col("reads_in_passing_clusters") - F.col("reads_written_for_consensus")).alias("reads_trimmed_from_large_clusters"), F.col("reads_in_failing_clusters").alias("reads_marked_skipped"),
        F.col("reads_in_failing_clusters").alias("reads_in_small_clusters"), "oversized_clusters", share("passing_clusters", "total_clusters").alias("passing_cluster_pct"),
        share("reads_written_for_consensus", "reads_in_clusters").alias("reads_used_for_consensus_pct"), share("reads_in_failing_clusters", "reads_in_clusters").alias("reads_in_small_clusters_pct"),
        F.when(F.col("reads_in_clusters") > 0, F.col("__fwd") / F.col("reads_in_clusters")).otherwise(0.0).alias("mean_forward_fraction"), F.lit(min_reads).alias("min_reads_required"), F.lit(max_reads).alias("max_reads_allowed"),
    )


def umi_pipeline(reads: DataFrame, config: UmiConfig, most: int, min_reads: int, max_reads: int, balance: bool = False) -> DataFrame:
    """Detection, families and their filter in one: a row per read that has a UMI.

    What is detected is written once to the shared folder, without the sequences, as clustering reads it again and again.
    """
    found = detect_umi(reads, config).select("read_id", "ord", F.coalesce("umi.normalized", "umi.combined").alias("key"), F.col("umi.strand").alias("strand"))
    found = written(found, scratch(reads.sparkSession, "umi"))
    return family_filter(families_approx(found, most), min_reads, max_reads, balance)

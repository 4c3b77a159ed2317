"""Pairs made from reads: paired-end fragments, and duplex pairs of neighbouring reads."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement


def make_pe(reads: DataFrame, insert: int, length: int, step: int) -> DataFrame:
    """``read_id``, frag, r1_id, r1_seq, r1_qual, r2_id, r2_seq, r2_qual for each window of ``insert`` bases.

    R1 is its first ``length`` bases, R2 the reverse complement of its last. Shorter reads give no rows.
    """
    if not 0 < length <= insert or step < 1:
        raise ValueError("a fragment needs 0 < length <= insert and a step")
    long = reads.where((F.length("seq") >= insert) & (F.length("qual") >= insert))
    starts = F.sequence(F.lit(0), F.least(F.length("seq"), F.length("qual")) - insert, F.lit(step))
    cut = lambda c, at: F.substr(F.col(c), at + 1, F.lit(length))
    # the pieces are cut before the rows multiply, so no fragment carries the whole read
    piece = lambda at: F.struct(cut("seq", at).alias("s1"), cut("qual", at).alias("q1"), cut("seq", at + (insert - length)).alias("s2"), cut("qual", at + (insert - length)).alias("q2"))
    f = long.select("read_id", F.posexplode(F.transform(starts, lambda at: piece(at))).alias("frag", "p"))
    name = lambda k: F.concat("read_id", F.lit("_f"), F.col("frag").cast("string"), F.lit(f"/{k}"))
    return f.select("read_id", "frag", name(1).alias("r1_id"), F.col("p.s1").alias("r1_seq"), F.col("p.q1").alias("r1_qual"), name(2).alias("r2_id"), reverse_complement(F.col("p.s2")).alias("r2_seq"), F.reverse("p.q2").alias("r2_qual"))


def pe_summary(reads: DataFrame, insert: int, step: int) -> DataFrame:
    """total_reads, total_pairs, skipped_short, without making the pairs."""
    n = F.least(F.length("seq"), F.length("qual"))
    pairs = F.when(n >= insert, F.floor((n - insert) / step) + 1).otherwise(0)
    return reads.agg(F.count("*").alias("total_reads"), F.coalesce(F.sum(pairs), F.lit(0)).cast("long").alias("total_pairs"), F.count_if(n < insert).alias("skipped_short"))


PAIR = "ch long, mx long, first string, second string, identity double"


def duplex_pairs(reads: DataFrame, mapped: bool = False, least: float = 0.70, shortest: int = 50) -> DataFrame:
    """Neighbouring reads of a pore that are the two strands of one molecule; a pair uses up both.

    By time: the end of the first is like the reverse complement of the second's start, which isn't over 500 bases longer.
    Mapped: same reference, starts within 500, opposite strands, alike starts. ``reads``: read_id, ch, mx, start_s,
    length, head, tail and, if mapped, rid, pos, rev. Candidates are compared natively; only the choice among them, which
    depends on the choice before, is made pore by pore.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("ch", "mx").orderBy(*(["rid", "pos"] if mapped else ["start_s"]), "read_id")
    own = reads.where("rid != -1") if mapped else reads
    other = lambda c: F.lead(c).over(order).alias(f"n_{c}")
    names = ["read_id", "length", "head", *(["rid", "pos", "rev"] if mapped else [])]
    both = own.select("ch", "mx", "read_id", "length", "head", "tail", *(["rid", "pos", "rev"] if mapped else ["start_s"]), *(other(n) for n in names), F.row_number().over(order).alias("k"))
    if mapped:
        near = (F.col("rid") == F.col("n_rid")) & (F.abs(F.col("pos") - F.col("n_pos")) <= 500) & (F.col("rev") != F.col("n_rev"))
        a, b = F.col("head"), F.col("n_head")
    else:
        near = F.col("n_length") <= F.col("length") + 500
        a, b = F.col("tail"), F.translate(F.reverse("n_head"), "ACGTNacgtn", "TGCANtgcan")
    size = F.greatest(F.length(a), F.length(b))
    alike = both.where(near & (size >= shortest)).withColumn("identity", 1 - F.levenshtein(a, b) / size).where(F.col("identity") > least)

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        rows, last = [], -1
        for r in group.sort_values("k").itertuples():
            if r.k > last:
                rows.append((r.ch, r.mx, r.read_id, r.n_read_id, r.identity))
                last = r.k + 1
        return pd.DataFrame(rows, columns=["ch", "mx", "first", "second", "identity"])

    return alike.select("ch", "mx", "k", "read_id", "n_read_id", "identity").groupBy("ch", "mx").applyInPandas(choose, PAIR)

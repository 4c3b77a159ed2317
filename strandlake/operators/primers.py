"""Amplicons by the primers at a read's ends."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alignment import sellers
from ..functions.sequence import kmers, pair_validity, reverse_complement, reverse_complement_upper
from .intervals import nearest_region
from .stats import amplicon_stats, upper_median


class Primer(NamedTuple):
    name: str
    seq: str
    chrom: str | None = None
    start: int | None = None
    end: int | None = None


def seed_length(shortest: int, most: int) -> int:
    """A k for which a match within ``most`` edits keeps one k-mer of the primer whole, held between 4 and 8."""
    return max(4, min(8, shortest // (most + 1)))


def kmer_candidates(reads: DataFrame, primers: DataFrame, k: int, *, region: str = "region") -> DataFrame:
    """(read_id, name, hits): primers of which either strand shares k-mers with a read's region, by number of them.

    Reads are in upper case; function arguments inside the search for k-mers would be worked out anew for each of them.
    """
    strands = primers.select("name", F.explode(F.array(F.upper("seq"), reverse_complement_upper(F.upper("seq")))).alias("seq"))
    seeds = strands.select("name", F.explode(kmers(F.col("seq"), k)).alias("kmer")).distinct()
    own = reads.select("read_id", F.explode(kmers(F.col(region), k)).alias("kmer")).join(F.broadcast(seeds.select("kmer").distinct()), "kmer", "left_semi").distinct()
    return own.join(seeds, "kmer").groupBy("read_id", "name").agg(F.count("*").alias("hits"))


def _flip(seq: str) -> str:
    return "".join({"A": "T", "C": "G", "G": "C", "T": "A"}.get(b, "N") for b in reversed(seq))


def best_primer(primers: list[Primer], most: int):
    """A column function: struct(name, dist) of the primer, either strand, nearest to a stretch of the text.

    The first primer of equal distance wins. All reads of a batch go through each primer's matrix together.
    """

    @F.pandas_udf("name string, dist int")
    def best(text: pd.Series) -> pd.DataFrame:
        texts = text.fillna("").str.upper().tolist()
        dist, which = np.full(len(texts), most + 1), np.full(len(texts), -1)
        for k, p in enumerate(primers):
            for pattern in (p.seq.upper(), _flip(p.seq.upper())):
                d, _ = sellers(texts, pattern)
                closer = d < dist
                dist[closer], which[closer] = d[closer], k
        names = pd.Series([p.name for p in primers] + [None], dtype=object)
        return pd.DataFrame({"name": names.iloc[which].to_numpy(), "dist": pd.Series(dist, dtype="Int32").where(pd.Series(which >= 0))})

    return best


def primer_match(reads: DataFrame, primers: list[Primer], most: int = 3, ends: int = 150) -> DataFrame:
    """``reads`` (seq) with start_primer, start_dist, end_primer, end_dist and amplicon (the two names in order), if they are a pair.

    Primers are few and travel with the function; ties go to the primer that is listed first.
    """
    find = best_primer(primers, most)
    out = reads.withColumn("__s", find(F.left("seq", F.lit(ends)))).withColumn("__e", find(F.right("seq", F.lit(ends))))
    out = out.withColumn("start_primer", F.col("__s.name")).withColumn("start_dist", F.col("__s.dist")).withColumn("end_primer", F.col("__e.name")).withColumn("end_dist", F.col("__e.dist")).drop("__s", "__e")
    return out.withColumn("amplicon", amplicon_name(F.col("start_primer"), F.col("end_primer")))


def amplicon_name(start: Column, end: Column) -> Column:
    """The two names in alphabetical order, if they make a valid pair."""
    return F.when(pair_validity(start, end), F.concat(F.least(start, end), F.lit("-"), F.greatest(start, end)))


def exact_primer_match(reads: DataFrame, primers: DataFrame, ends: int = 150) -> DataFrame:
    """The native form for primers without errors: (read_id, start_primer, end_primer), the first listed of those that occur."""
    strands = primers.select("name", "ord", F.explode(F.array(F.upper("seq"), reverse_complement(F.col("seq")))).alias("pattern"))
    small = F.broadcast(strands)  # a primer table: at most a few hundred rows
    own = reads.select("read_id", F.upper(F.left("seq", F.lit(ends))).alias("head"), F.upper(F.right("seq", F.lit(ends))).alias("tail"))
    found = own.join(small, F.contains("head", "pattern") | F.contains("tail", "pattern"))
    pick = lambda side: F.min_by(F.when(F.contains(side, "pattern"), F.col("name")), F.when(F.contains(side, "pattern"), F.col("ord")))
    return found.groupBy("read_id").agg(pick("head").alias("start_primer"), pick("tail").alias("end_primer"))


def primer_stats(matched: DataFrame) -> DataFrame:
    """Per primer: start, end and total matches, mean edit distance."""
    ends = matched.select(F.explode(F.array(F.struct(F.lit("start").alias("side"), F.col("start_primer").alias("primer"), F.col("start_dist").alias("dist")), F.struct(F.lit("end").alias("side"), F.col("end_primer").alias("primer"), F.col("end_dist").alias("dist")))).alias("m"))
    own = ends.select("m.*").where("primer IS NOT NULL")
    return own.groupBy("primer").agg(F.count_if(F.col("side") == "start").alias("start_matches"), F.count_if(F.col("side") == "end").alias("end_matches"), F.count("*").alias("matches"), F.avg("dist").alias("mean_dist"))


def amplicon_counters(matched: DataFrame, min_len: int, max_len: int, min_qs: float) -> DataFrame:
    """One row: raw, in_length, in_quality, with_primer, with_pair, unmatched."""
    fits = F.col("length").between(min_len, max_len)
    good = fits & (F.col("qs") >= min_qs)
    any_primer = F.col("start_primer").isNotNull() | F.col("end_primer").isNotNull()
    return matched.agg(F.count("*").alias("raw"), F.count_if(fits).alias("in_length"), F.count_if(good).alias("in_quality"), F.count_if(good & any_primer).alias("with_primer"), F.count_if(good & F.col("amplicon").isNotNull()).alias("with_pair"), F.count_if(good & ~any_primer).alias("unmatched"))


def amplicon_report(matched: DataFrame, min_len: int, max_len: int, min_qs: float) -> DataFrame:
    """The report of a run as one row: counters, and arrays of amplicons and primers (by name) of the reads that pass.

    As many entries as there are names, so one document holds it.
    """
    good = matched.where(F.col("length").between(min_len, max_len) & (F.col("qs") >= min_qs))

    def listed(df: DataFrame, name: str, as_: str) -> DataFrame:
        return df.agg(F.array_sort(F.collect_list(F.struct(name, *(c for c in df.columns if c != name)))).alias(as_))

    counters = amplicon_counters(matched, min_len, max_len, min_qs)
    amplicons = listed(amplicon_stats(good.where("amplicon IS NOT NULL")), "amplicon", "amplicons")
    one = counters.select(F.struct(*counters.columns).alias("counters"))
    return one.crossJoin(amplicons).crossJoin(listed(primer_stats(good), "primer", "primers"))  # one row each


def coord_fast_path(reads: DataFrame, primers: DataFrame, tolerance: int) -> DataFrame:
    """``reads`` (read_id, chrom, start, end) with fast_start and fast_end: the last listed primer whose region holds each end."""
    regions = primers.where("chrom IS NOT NULL").select("chrom", F.col("start").alias("g_start"), F.col("end").alias("g_end"), "name", "ord")
    width = 10_000

    def at(place: str, out: str) -> DataFrame:
        cells = regions.withColumn("__bin", F.explode(F.sequence(F.floor((F.col("g_start") - tolerance) / width), F.floor((F.col("g_end") + tolerance) / width))))
        met = reads.withColumn("__bin", F.floor(F.col(place) / width)).join(cells, ["chrom", "__bin"])
        held = met.where(F.col(place).between(F.col("g_start") - tolerance, F.col("g_end") + tolerance))
        return held.groupBy("read_id").agg(F.max_by("name", "ord").alias(out))

    return reads.join(at("start", "fast_start"), "read_id", "left").join(at("end", "fast_end"), "read_id", "left")


def coord_fallback(reads: DataFrame, regions: DataFrame, tolerance: int) -> DataFrame:
    """Reads without an amplicon by sequence get that of the nearest region."""
    placed = nearest_region(reads, regions, tolerance)
    return placed.withColumn("amplicon", F.coalesce("amplicon", "region")).drop("region", "distance")


def rescue_join(assigned: DataFrame, tolerance: int) -> DataFrame:
    """Placed reads without an amplicon, given that of the nearest amplicon's median ends; nothing if ``tolerance`` is 0.

    The tolerance is at least 200 bases. ``assigned``: read_id, ord, amplicon, chrom, start, end.
    """
    lost = assigned.where("amplicon IS NULL AND chrom IS NOT NULL")
    if tolerance <= 0:
        return lost.limit(0).withColumn("rescued", F.lit(None).cast("string"))
    medians = assigned.where("amplicon IS NOT NULL AND chrom IS NOT NULL").groupBy("amplicon").agg(F.min_by("chrom", "ord").alias("chrom"), upper_median("start").alias("start"), upper_median("end").alias("end"), F.min("ord").alias("ord")).withColumnRenamed("amplicon", "name")
    return nearest_region(lost, medians, max(tolerance, 200)).where("region IS NOT NULL").withColumnRenamed("region", "rescued")


def discovery_fallback(reads: int, assigned: int) -> bool:
    """Whether too few reads were assigned to trust the primers: under 5 % of more than 500."""
    return reads > 500 and assigned < 0.05 * reads


def split_reads(seqs: list[str], primers: list[str], most: int, end: int) -> list[list[tuple[int, int]]]:
    """(start, end) of each read's parts: cut at the best primer inside, and the parts again, while both stay long enough.

    All parts that may still be cut go through each primer's matrix together.
    """
    shortest, patterns = max(end, 150), [q for p in primers for q in (p, _flip(p))]
    done: list[list[tuple[int, int]]] = [[] for _ in seqs]
    pending = [(k, 0, len(s)) for k, s in enumerate(seqs)]
    while pending:
        may = [x for x in pending if x[2] - x[1] >= 2 * shortest and x[2] - x[1] > 2 * end]
        for k, a, b in set(pending) - set(may):
            done[k].append((a, b))
        pending = []
        if not may:
            break
        may.sort(key=lambda x: x[2] - x[1])  # parts of like length share a matrix
        best, at = np.full(len(may), most + 1), np.zeros(len(may), np.int64)
        for lot in (slice(n, n + 256) for n in range(0, len(may), 256)):
            inner = [seqs[k][a + end : b - end] for k, a, b in may[lot]]
            for q in patterns:
                d, e = sellers(inner, q)
                better = (d < best[lot]) | ((d == best[lot]) & (d <= most) & (e < at[lot]))
                best[lot], at[lot] = np.where(better, d, best[lot]), np.where(better, e, at[lot])
        for (k, a, b), dist, e in zip(may, best.tolist(), at.tolist(), strict=True):
            place = a + end + e
            if dist > most or place - a < shortest or b - place < shortest:
                done[k].append((a, b))
            else:
                pending += [(k, a, place), (k, place, b)]
    return [sorted(parts) for parts in done]


def chimera_split(reads: DataFrame, primers: list[Primer], most: int = 3, end: int = 150) -> DataFrame:
    """``reads`` (read_id, seq, qual) with chimeras as parts read_id_split1, _split2, ...; other reads as they are."""
    patterns = [p.seq.upper() for p in primers]

    def split(batches):
        for batch in batches:
            rows = []
            cuts = split_reads([x.upper() for x in batch["seq"]], patterns, most, end)
            for r, parts in zip(batch.itertuples(index=False), cuts, strict=True):
                rows += [(f"{r.read_id}_split{k}" if len(parts) > 1 else r.read_id, r.read_id, r.seq[a:b], r.qual[a:b]) for k, (a, b) in enumerate(parts, 1)]
            yield pd.DataFrame(rows, columns=["read_id", "parent_id", "seq", "qual"])

    return reads.select("read_id", "seq", "qual").mapInPandas(split, "read_id string, parent_id string, seq string, qual string")

"""Amplicons that no primer list names, adapters and concatemers."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.alignment import sellers, semiglobal_find
from ..functions.sequence import kmers, reverse_complement
from ..shared import scratch, written
from .clustering import numbered, star_clusters


def biological_ends(reads: DataFrame, size: int = 150, adapter: str | None = None, adapter_end: int | None = None) -> DataFrame:
    """``reads`` with start_region and end_region (``size`` bases, or what there is), ends_at and begins_at: the insert without clips and adapters.

    A mapped read (cigar with a reference place: ``chrom`` not null) begins and ends where its alignment does. Others end
    with the read and begin behind the adapter: at ``adapter_end`` where that is known, else behind its best match in the
    first 300 bases if it is within half its length, else at once. Reads without bases have null regions.
    """
    n, clip = F.length("seq"), lambda at: F.coalesce(F.nullif(F.regexp_extract("cigar", at, 1), F.lit("")).cast("int"), F.lit(0))
    if adapter_end is not None:
        free = F.least(F.lit(adapter_end), n)
    elif adapter:
        free = F.coalesce(semiglobal_find(adapter, len(adapter) // 2)(F.left("seq", F.lit(300))).getField("end"), F.lit(0))
    else:
        free = F.lit(0)
    if {"chrom", "cigar"} <= set(reads.columns):
        mapped = F.col("chrom").isNotNull()
        begin = F.when(mapped, clip(r"^(?:[0-9]+H)?([0-9]+)S")).otherwise(free)
        end = F.when(mapped, n - clip(r"([0-9]+)S(?:[0-9]+H)?$")).otherwise(n)
    else:
        begin, end = free, n
    own = reads.withColumn("begins_at", begin).withColumn("ends_at", end)
    some = F.col("seq").isNotNull() & (n > 0)
    first = F.substr("seq", F.col("begins_at") + 1, F.lit(size))
    low = F.greatest(F.col("ends_at") - size, F.lit(0))
    return own.withColumn("start_region", F.when(some, first)).withColumn("end_region", F.when(some, F.substr("seq", low + 1, F.col("ends_at") - low)))


def end_signatures(reads: DataFrame, k: int = 30, **ends) -> DataFrame:
    """``reads`` (seq) with biological_ends and sig_start and sig_end, the k bases at each end; shorter reads are left out."""
    own = biological_ends(reads, **ends).where(F.col("ends_at") - F.col("begins_at") >= 2 * k)
    return own.withColumn("sig_start", F.left("start_region", F.lit(k))).withColumn("sig_end", F.right("end_region", F.lit(k)))


def signature_pairs(reads: DataFrame, k: int = 30, top: int = 200, **ends) -> DataFrame:
    """The ``top`` most frequent (sig_start, sig_end) seen at least max(10, 0.1 % of the reads) times."""
    signed = end_signatures(reads, k, **ends)
    least = max(10, math.ceil(0.001 * signed.count()))
    return signed.groupBy("sig_start", "sig_end").agg(F.count("*").alias("count")).where(F.col("count") >= least).orderBy(F.desc("count"), "sig_start", "sig_end").limit(top)


def cluster_kmers(counts: DataFrame, most: int = 3) -> DataFrame:
    """(key, count) clustered greedily, most frequent first: centre, count, members."""
    ranked = numbered(counts, F.desc("count"), "key", name="ord")
    merged = star_clusters(ranked.select("key", "ord"), most).join(counts, "key")
    return merged.groupBy("centre").agg(F.sum("count").alias("count"), F.count("*").alias("members"))


def _nearest_pair(pairs: list[tuple[str, str]], most: int):
    """A column function: the place in ``pairs`` of the one whose signatures are found in both regions with the fewest edits together, the first of equals; null if none is within ``most`` at each end.

    A signature within so many edits of a stretch shares one of its most + 1 pieces with it unchanged, so only
    signatures that do are compared, each with all its regions of a batch at once.
    """

    def pieces(sig: str) -> set[str]:
        size = max(1, len(sig) // (most + 1))
        return {sig[k * size : (k + 1) * size if k < most else len(sig)] for k in range(most + 1)} if len(sig) > most else {""}

    def distances(regions: list[str], sigs: list[str]) -> list[dict[str, int]]:
        out: list[dict[str, int]] = [{} for _ in regions]
        for sig in sigs:
            own = pieces(sig)
            asked = [k for k, r in enumerate(regions) if any(p in r for p in own)]
            best, _ = sellers([regions[k] for k in asked], sig) if asked else ([], [])
            for k, d in zip(asked, best, strict=True):
                if d <= most:
                    out[k][sig] = int(d)
        return out

    @F.pandas_udf("int")
    def nearest(start: pd.Series, end: pd.Series) -> pd.Series:
        regions = start.fillna("").tolist(), end.fillna("").tolist()
        first, last = (distances(r, sorted({p[side] for p in pairs})) for side, r in enumerate(regions))
        found = []
        for a, b, s, e in zip(first, last, *regions, strict=True):
            fits = [(a[p] + b[q], k) for k, (p, q) in enumerate(pairs) if s and e and p in a and q in b]
            found.append(min(fits)[1] if fits else None)
        return pd.Series(found, dtype="Int32")

    return nearest


def merged_pairs(pairs: list[tuple[str, str]], counts: list[int], alike: float = 0.90, most: int = 5) -> list[int]:
    """For each pair the place of the one it is merged into: the most frequent one left takes in all that are alike at both ends, on average, and within ``most`` edits at each."""
    into: dict[int, int] = {}
    order = sorted(range(len(pairs)), key=lambda k: (-counts[k], k))
    for k in order:
        if k in into:
            continue
        for other in order:
            if other not in into:
                d = [_edits(a, b) for a, b in zip(pairs[k], pairs[other], strict=True)]
                same = [1 - x / max(len(a), len(b), 1) for x, a, b in zip(d, pairs[k], pairs[other], strict=True)]
                if other == k or (max(d) <= most and sum(same) / 2 >= alike):
                    into[other] = k
    return [into[k] for k in range(len(pairs))]


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def discover_amplicons(reads: DataFrame, k: int = 30, top: int = 200, most: int = 3, alike: float = 0.90, **ends) -> DataFrame:
    """``reads`` (read_id, seq) with the discovered amplicon D1, D2, ... (most frequent first), null for reads of none.

    The ``top`` most frequent pairs of end signatures are searched in the regions at the ends of every read, within
    ``most`` edits each; the pair with the fewest edits together counts. Pairs that are ``alike`` are then one amplicon,
    named by the most frequent. Pairs and their counts are bounded by ``top``, so they travel with the plan; the matched
    reads are written once.
    """
    pairs = [(r["sig_start"], r["sig_end"]) for r in signature_pairs(reads, k, top, **ends).collect()]
    if not pairs:
        return reads.withColumn("amplicon", F.lit(None).cast("string"))
    own = biological_ends(reads, **ends).withColumn("__pair", _nearest_pair(pairs, most)("start_region", "end_region")).select(*reads.columns, "__pair")
    own = written(own, scratch(reads.sparkSession, "discovery"))
    counts = [0] * len(pairs)
    for row in own.where("__pair IS NOT NULL").groupBy("__pair").count().collect():  # a row a pair
        counts[row["__pair"]] = row["count"]
    into = merged_pairs(pairs, counts, alike)
    total = {head: sum(c for c, i in zip(counts, into, strict=True) if i == head) for head in set(into)}
    place = {head: f"D{n}" for n, head in enumerate(sorted(total, key=lambda h: (-total[h], h)), 1)}
    names = F.array(*(F.lit(place[i]) for i in into))
    return own.withColumn("amplicon", F.get(names, F.col("__pair"))).drop("__pair")


def adapter_position(reads: DataFrame, adapter: str, most: int = 3, within: int = 100, sample: int | None = 10_000) -> DataFrame:
    """One row: the median end of the adapter in the first ``within`` bases, over the first ``sample`` reads as the operator offers."""
    own = reads.orderBy("ord").limit(sample) if sample else reads
    hit = own.select(semiglobal_find(adapter, most)(F.left("seq", F.lit(within))).alias("hit"))
    return hit.where("hit.dist IS NOT NULL").agg(F.median("hit.end").alias("position"), F.count("*").alias("hits"))


def concatemer_scan(reads: DataFrame, adapters: list[str], k: int = 15, margin: int = 500, shortest: int = 1000) -> DataFrame:
    """``reads`` (seq) of at least ``shortest`` bases with concatemer: whether an adapter's k-mer, either strand, stands inside."""
    both = F.array(*(F.lit(a) for a in adapters))
    seeds = F.array_distinct(F.flatten(F.transform(F.concat(both, F.transform(both, reverse_complement)), lambda a: kmers(a, k))))
    inner = F.substr("seq", F.lit(margin + 1), F.length("seq") - 2 * margin)
    return reads.where(F.length("seq") >= shortest).withColumn("concatemer", F.exists(seeds, lambda s: F.contains(inner, s)))

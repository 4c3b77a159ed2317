"""One sequence for each family of reads."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the vote's alignment, its letters in the order in which later ones win ties, and the best quality.
MATCH, MISMATCH, GAP, LETTERS, BEST = 1, -1, -2, "ACGT-", 60


UNCLEAR = re.compile("[^ACGT-]")


def consensus_medoid(members: DataFrame, prefix: int = 75) -> DataFrame:
    """family, read_id, sequence, method: the read with the least sum of edit distances over the first ``prefix`` bases.

    Distances are between distinct prefixes, weighted by their reads; of equal sums the first read wins. Families are
    what family_filter leaves, so their size is bounded.
    """
    reads = members.select("family", "ord", "read_id", "seq", F.upper(F.left("seq", F.lit(prefix))).alias("sig"))
    sigs = reads.groupBy("family", "sig").agg(F.count("*").alias("n"))
    other = sigs.select("family", F.col("sig").alias("sig2"), "n")
    sums = sigs.select("family", "sig").join(other, "family").groupBy("family", "sig").agg(F.sum(F.levenshtein("sig", "sig2") * F.col("n")).alias("total"))
    best = reads.join(sums, ["family", "sig"]).groupBy("family").agg(F.min(F.struct("total", "ord", "read_id", "seq")).alias("b"), F.count("*").alias("n"))
    method = F.when(F.col("n") == 1, F.lit("medoid (singleton)")).otherwise(F.concat(F.lit("medoid (n="), F.col("n").cast("string"), F.lit(")")))
    return best.select("family", F.col("b.read_id").alias("read_id"), F.col("b.seq").alias("sequence"), method.alias("method"))


def align_to(anchor: str, query: str, band: int | None = None) -> str | None:
    """The query's letter, or -, under each of the anchor's; None if the band doesn't hold the end.

    Each row of the matrix is computed at once but for gaps along it, a running maximum. Scores are held less the gaps that
    lead to their place, so a gap adds nothing. Only about the root of all rows is held, and only the band of each: every
    so many rows one is kept, from which the way back computes the rows of its block again.
    """
    a, q = (np.frombuffer(s.upper().encode(), np.uint8) for s in (anchor, query))
    n, m = len(a), len(q)
    if band is not None and abs(n - m) > band:
        return None
    low, width, block = -(1 << 28), m if band is None else band, max(1, math.isqrt(n))
    gains = {c: np.where(q == c, MATCH - 2 * GAP, MISMATCH - 2 * GAP).astype(np.int32) for c in set(a.tolist())}
    letters = a.tolist()

    def bounds(i: int) -> tuple[int, int]:
        return (0, m) if band is None else (max(0, i - width), min(m, i + width))

    def after(i: int, last: np.ndarray) -> np.ndarray:
        """Row i within its bounds, from the row before it within its own."""
        (lo, hi), (was_lo, was_hi) = bounds(i), bounds(i - 1)
        row = np.full(hi - lo + 1, low, np.int32)
        row[: was_hi - lo + 1] = last[lo - was_lo :]
        first = max(lo, was_lo + 1)
        to = row[first - lo : min(hi, was_hi + 1) - lo + 1]
        np.maximum(to, last[first - 1 - was_lo :][: len(to)] + gains[letters[i - 1]][first - 1 :][: len(to)], out=to)
        return np.maximum.accumulate(row, out=row)

    row = np.zeros(bounds(0)[1] + 1, np.int32)
    kept = [row]
    for i in range(1, n + 1):
        row = after(i, row)
        if i % block == 0:
            kept.append(row)
    out, i, j, rows, base = ["-"] * n, n, m, [], n + 1
    while i and j:
        if i - 1 < base:
            base = (i - 1) // block * block
            rows = [kept[base // block]]
            for k in range(base + 1, i + 1):
                rows.append(after(k, rows[-1]))
        (lo, _), (was_lo, was_hi) = bounds(i), bounds(i - 1)
        score, last = rows[i - base][j - lo], rows[i - 1 - base]
        if score == last[j - 1 - was_lo] + gains[letters[i - 1]][j - 1]:
            i, j = i - 1, j - 1
            out[i] = query[j]
        elif j <= was_hi and score == last[j - was_lo]:
            i -= 1
        else:
            j -= 1
    return "".join(out)


def vote(sequences: list[str], band: int | None = None) -> tuple[str, list[int]]:
    """The plurality letter of each column of the longest (last if equal) sequence, - included, and its qualities.

    U is T; any other letter says as little as a gap, and counts as one. The support is the share of all sequences.
    """
    anchor = max(enumerate(sequences), key=lambda x: (len(x[1]), x[0]))[1]
    rows = [align_to(anchor, s, band) or align_to(anchor, s) for s in sequences]
    letters, quality = [], []
    total = len(rows)
    for column in zip(*(UNCLEAR.sub("-", r.upper().replace("U", "T")) for r in rows), strict=True):
        n, _, best = max((column.count(c), k, c) for k, c in enumerate(LETTERS))
        letters.append(best)
        quality.append(BEST if n >= total else min(BEST, max(0, round(-10 * np.log10(max(1e-6, 1 - n / total))))))
    return "".join(letters), quality


def consensus_vote(members: DataFrame, band: int = 64) -> DataFrame:
    """family, sequence (gaps left out), quality (ASCII), n: majority vote over alignments to each family's longest read.

    The only read of a family is its consensus as it is, with its own ``qual`` (null if there is none). A family is one
    group; family_filter bounds its reads, so it is no unbounded one.
    """

    def one(group: pd.DataFrame) -> pd.DataFrame:
        if len(group) == 1:
            return pd.DataFrame({"family": group["family"], "sequence": group["seq"], "quality": group["qual"], "n": 1})
        letters, quality = vote(group.sort_values("ord")["seq"].tolist(), band)
        kept = [(c, q) for c, q in zip(letters, quality, strict=True) if c != "-"]
        return pd.DataFrame({"family": [group["family"].iloc[0]], "sequence": ["".join(c for c, _ in kept)], "quality": ["".join(chr(33 + q) for _, q in kept)], "n": [len(group)]})

    qual = F.col("qual") if "qual" in members.columns else F.lit(None).cast("string")
    return members.select("family", "ord", "seq", qual.alias("qual")).groupBy("family").applyInPandas(one, "family long, sequence string, quality string, n long")


def column_votes(aligned: DataFrame) -> DataFrame:
    """The vote itself natively, for rows (family, col, base): base, support and quality of each column; letters as in vote."""
    order = F.instr(F.lit(LETTERS), F.col("base"))
    base = F.regexp_replace(F.translate("base", "U", "T"), "[^ACGT-]", "-")
    counts = aligned.select("family", "col", base.alias("base")).groupBy("family", "col", "base").agg(F.count("*").alias("n")).withColumn("k", order)
    best = counts.groupBy("family", "col").agg(F.max(F.struct("n", "k", "base")).alias("b"), F.sum("n").alias("total"))
    share = F.col("b.n") / F.col("total")
    quality = F.when(F.col("b.n") >= F.col("total"), BEST).otherwise(F.least(F.lit(BEST), F.greatest(F.lit(0), F.round(-10 * F.log10(F.greatest(1 - share, F.lit(1e-6)))).cast("int"))))
    return best.select("family", "col", F.col("b.base").alias("base"), F.col("b.n").alias("support"), "total", quality.alias("quality"))


def read_columns(members: DataFrame) -> DataFrame:
    """Rows (family, col, base) of reads that need no alignment, as all begin at the same place."""
    bases = members.select("family", F.posexplode(F.split(F.upper("seq"), "")).alias("col", "base"))
    return bases.where("base != ''")


"""Read quality. Scores combine as error probabilities, never as scores; all are native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the formats: a missing score, and the first base that basecallers average from.
MISSING, FIRST_BASE = 255, 60


def _mean_qv(scores: Column) -> Column:
    total = F.aggregate(scores, F.lit(0.0), lambda a, q: a + F.pow(F.lit(10.0), -q.cast("double") / 10.0))
    return -10.0 * F.log10(total / F.size(scores))


def mean_qv(scores: Column) -> Column:
    """-10 log10 of the mean error probability of an array of scores; 0 if empty or all are missing (255)."""
    absent = F.forall(scores, lambda q: q == MISSING)
    return F.when(absent, F.lit(0.0)).otherwise(_mean_qv(scores))


def ascii_scores(qual: Column) -> Column:
    """Scores of a FASTQ quality string; characters below ! count as 0."""
    return F.transform(F.filter(F.split(qual, ""), lambda c: c != ""), lambda c: F.greatest(F.ascii(c) - 33, F.lit(0)))


def mean_qv_ascii(qual: Column) -> Column:
    """mean_qv of a FASTQ quality string; 0 if empty."""
    return F.when(F.length(qual) == 0, F.lit(0.0)).otherwise(_mean_qv(ascii_scores(qual)))


def basecaller_qv(qual: Column, split_read: Column) -> Column:
    """mean_qv_ascii from base 60 on; of the whole read if it was split or has 60 bases or fewer."""
    return F.when(split_read | (F.length(qual) <= FIRST_BASE), mean_qv_ascii(qual)).otherwise(mean_qv_ascii(F.substr(qual, F.lit(FIRST_BASE + 1))))


def select_qv(explicit: Column, qual: Column) -> Column:
    """The score that the read states, else that of all its bases."""
    return F.coalesce(explicit, mean_qv_ascii(qual))


def read_mean_qv(explicit: Column, qual: Column, split_read: Column) -> Column:
    """The score that the read states, else as a basecaller computes it."""
    return F.coalesce(explicit, basecaller_qv(qual, split_read))


def _tag(tags: Column, *names: str) -> Column:
    return F.coalesce(*(F.try_element_at(tags, F.lit(n)).try_cast("double") for n in names))


def bam_qv(tags: Column, scores: Column, reverse: Column) -> Column:
    """Of an alignment: tag qs, then QS, else from base 60 in reading direction; split reads have a pi tag."""
    ordered = F.when(reverse, F.reverse(scores)).otherwise(scores)
    tail = F.when(F.try_element_at(tags, F.lit("pi")).isNotNull() | (F.size(scores) <= FIRST_BASE), ordered).otherwise(F.slice(ordered, FIRST_BASE + 1, F.greatest(F.size(ordered) - FIRST_BASE, F.lit(1))))
    return F.coalesce(_tag(tags, "qs", "QS"), mean_qv(tail))


def bam_qv_analysis(tags: Column, scores: Column) -> Column:
    """The analysis variant: tag QS, then qs, else all bases."""
    return F.coalesce(_tag(tags, "QS", "qs"), mean_qv(scores))


def phred_to_ascii(score: Column) -> Column:
    """A score as a FASTQ character: ! if missing, at most ~."""
    return F.when(score == MISSING, F.lit("!")).otherwise(F.char(F.least(score, F.lit(93)) + 33))


def phred_to_accuracy(score: Column) -> Column:
    """Percent of right bases, from 0 to 100."""
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), (1 - F.pow(F.lit(10.0), -score / 10.0)) * 100.0))


def accuracy_to_phred(percent: Column) -> Column:
    """The inverse; the error probability is held between 1e-10 and 1."""
    return -10.0 * F.log10(F.least(F.lit(1.0), F.greatest(F.lit(1e-10), 1 - percent / 100.0)))


def accuracy_from_de(divergence: Column) -> Column:
    """Percent identity by the divergence tag; 0 without it."""
    return F.coalesce((1 - divergence) * 100.0, F.lit(0.0))

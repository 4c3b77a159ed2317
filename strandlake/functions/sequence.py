"""Strings of bases: complements, distances, searches. Native but for the Arrow functions in ``alignment``."""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Complements of the IUPAC codes, and the bases that each code stands for.
IUPAC, IUPAC_COMPLEMENT = "ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN"
IUPAC_BASES = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}


def reverse_complement(seq: Column) -> Column:
    """Upper case; whatever is not A, C, G or T becomes N."""
    return F.translate(F.regexp_replace(F.upper(F.reverse(seq)), "[^ACGT]", "N"), "ACGT", "TGCA")


def reverse_complement_upper(seq: Column) -> Column:
    """For primers: only upper-case bases have a complement, all else becomes N."""
    return F.translate(F.regexp_replace(F.reverse(seq), "[^ACGT]", "N"), "ACGT", "TGCA")


def reverse_complement_iupac(seq: Column) -> Column:
    """For writers: case stays, IUPAC codes are complemented, other characters stay."""
    return F.translate(F.reverse(seq), IUPAC + IUPAC.lower(), IUPAC_COMPLEMENT + IUPAC_COMPLEMENT.lower())


def reverse_complement_plain(seq: Column) -> Column:
    """Upper-case A, T, C and G only; other characters stay."""
    return F.translate(F.reverse(seq), "ATCG", "TAGC")


def hamming_distance(a: Column, b: Column) -> Column:
    """Differing places; null if the lengths differ."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) == F.length(b), F.aggregate(pairs, F.lit(0), lambda s, x: s + x))


def edit_distance(a: Column, b: Column, most: int) -> Column:
    """Levenshtein distance; null beyond ``most``."""
    d = F.levenshtein(a, b, most)
    return F.when(d >= 0, d)


def edit_distance_ci(a: Column, b: Column, most: int) -> Column:
    """edit_distance without regard to case."""
    return edit_distance(F.upper(a), F.upper(b), most)


def iupac_wildcards(seq: Column, pattern: str) -> Column:
    """The bases where the pattern has more than one choice; null if the lengths differ."""
    at = [i + 1 for i, c in enumerate(pattern) if len(IUPAC_BASES[c.upper()]) > 1]
    return F.when(F.length(seq) == len(pattern), F.concat(F.lit(""), *(F.substring(seq, i, 1) for i in at)))


def iupac_match(seq: Column, pattern: str) -> Column:
    """Whether each base is one of those its pattern code stands for."""
    return F.upper(seq).rlike("^" + "".join(f"[{IUPAC_BASES[c.upper()]}]" for c in pattern) + "$")


def windows(text: Column, width: int) -> Column:
    """The starts, from 0, of all windows of ``width``."""
    return F.when(F.length(text) >= width, F.sequence(F.lit(0), F.length(text) - width)).otherwise(F.array().cast("array<int>"))


def anchor_scan(text: Column, anchor: str, most: int) -> Column:
    """struct(dist, start) of the first window of the anchor's length with the least edit distance; null beyond ``most``."""
    hits = F.transform(kmers(text, len(anchor)), lambda w, i: F.struct(F.levenshtein(w, F.lit(anchor), most).alias("dist"), i.alias("start")))
    return F.array_min(F.filter(hits, lambda h: h.dist >= 0))


def fuzzy_contains(text: Column, pattern: Column | str, most: int) -> Column:
    """Whether some window of the pattern's length is within ``most`` edits."""
    if isinstance(pattern, str):
        return F.exists(kmers(text, len(pattern)), lambda w: F.levenshtein(w, F.lit(pattern), most) >= 0)
    starts = F.when(F.length(text) >= F.length(pattern), F.sequence(F.lit(1), F.length(text) - F.length(pattern) + 1)).otherwise(F.array().cast("array<int>"))
    return F.exists(starts, lambda i: F.levenshtein(F.substr(text, i, F.length(pattern)), pattern, most) >= 0)


def semiglobal_native(text: Column, pattern: str, most: int) -> Column:
    """The least edit distance of the whole pattern to any stretch of the text; null beyond ``most``. A parity form of the Arrow one."""
    n = len(pattern)

    def tries(width: int) -> Column:
        return F.transform(kmers(text, width), lambda w: F.levenshtein(w, F.lit(pattern), most))

    none = [F.when(text.isNotNull(), F.array(F.lit(n)))] if n <= most else []
    return F.array_min(F.filter(F.concat(*none, *(tries(w) for w in range(max(1, n - most), n + most + 1))), lambda d: d >= 0))


def kmers(text: Column, k: int) -> Column:
    """All stretches of length k, repeats included, in one pass over the text."""
    return F.regexp_extract_all(text, F.lit(f"(?=(.{{{k}}}))"), 1)


def hamming_variants(seq: str, most: int, alphabet: str = "ACGT") -> list[str]:
    """All strings within ``most`` substitutions, sorted; computed where the plan is made, for a table to join with."""
    out = {seq}
    for n in range(1, most + 1):
        for at in combinations(range(len(seq)), n):
            for bases in product(alphabet, repeat=n):
                changed = list(seq)
                for i, b in zip(at, bases, strict=True):
                    changed[i] = b
                out.add("".join(changed))
    return sorted(out)


def primer_direction(name: Column) -> Column:
    """forward or reverse, null if the name doesn't say: the words anywhere, forward's first; else a last F or R, digits
    after it aside. After a separator (or alone) any case counts; glued to a word only a capital, after a small letter
    or before digits."""
    low, stem = F.lower(name), F.regexp_replace(name, "[0-9]+$", "")
    last = F.upper(F.right(stem, F.lit(1)))
    side = F.when(last == "F", F.lit("forward")).when(last == "R", F.lit("reverse"))
    counts = stem.rlike(r"(^|[^\p{L}\p{N}])[FfRr]$") | (stem.rlike("[FR]$") & (stem.rlike("[a-z][FR]$") | (F.length(stem) < F.length(name))))
    return F.when(low.contains("fwd") | low.contains("forward"), F.lit("forward")).when(low.contains("rev") | low.contains("reverse"), F.lit("reverse")).when(counts, side)


def pair_validity(start: Column, end: Column, amplicon: Column | None = None) -> Column:
    """Whether two primers make an amplicon: opposite directions, or different names if either says none.

    With ``amplicon``, the form for coordinates: also one region at both ends, and any read that lacks one of them.
    """
    a, b = primer_direction(start), primer_direction(end)
    pair = F.when(a.isNotNull() & b.isNotNull(), a != b).otherwise(start != end)
    if amplicon is None:
        return F.coalesce(pair, F.lit(False))
    return F.when(start.isNull() | end.isNull(), F.lit(True)).otherwise((F.coalesce(start == end, F.lit(False)) & amplicon.eqNullSafe(start)) | pair)

"""Samples by barcode pairs, and barcodes that nobody listed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import fuzzy_contains, hamming_variants, kmers, reverse_complement

#: The adapters' anchors beside the barcode pockets, and the barcode length of the fast mode.
BC2_FWD, BC1_FWD, BC2_REV, BC1_REV = "ATCTACAC", "ATCTCGTA", "GTGTAGAT", "TACGAGAT"
TAG = 10
#: Orientation pairs that may stand at a read's start and end.
PAIRS = {("bc1", "bc2rc"), ("bc2rc", "bc1"), ("bc1", "bc2"), ("bc2", "bc1"), ("bc2", "bc1rc"), ("bc1rc", "bc2"), ("bc1rc", "bc2rc"), ("bc2rc", "bc1rc")}


def pair_fits(start: Column, end: Column, bc1: Column, bc2: Column, most: int) -> Column:
    """Whether the two ends hold the pair in one of the five ways that are looked for."""
    rc1, rc2 = reverse_complement(bc1), reverse_complement(bc2)
    ways = [(bc1, rc2), (bc1, bc1), (bc2, rc1), (bc2, bc1), (rc1, rc2)]
    out = F.lit(False)
    for a, b in ways:
        out |= fuzzy_contains(start, a, most) & fuzzy_contains(end, b, most)
    return out


def barcode_pair_match(reads: DataFrame, pairs: list[tuple[str, str, str]], most: int, ends: int = 150) -> DataFrame:
    """``reads`` (seq) with sample: the first of the (sample, bc1, bc2) that fits both ends, null if none.

    A sheet has at most a few hundred pairs, so they are a chain of conditions, not a join.
    """
    start, end = F.left("seq", F.lit(ends)), F.right("seq", F.lit(ends))
    sample = F.lit(None).cast("string")
    for name, bc1, bc2 in reversed(pairs):
        sample = F.when(pair_fits(start, end, F.lit(bc1), F.lit(bc2), most), F.lit(name)).otherwise(sample)
    return reads.withColumn("sample", sample)


def variant_table(reads: DataFrame, pairs: list[tuple[str, str, str]], most: int) -> DataFrame:
    """tag, sample, kind, dist, ord: every string within ``most`` substitutions of every barcode in every orientation."""
    flip = str.maketrans("ACGT", "TGCA")
    rows = []
    for k, (sample, bc1, bc2) in enumerate(pairs):
        for kind, seq in (("bc1", bc1), ("bc2", bc2), ("bc1rc", bc1[::-1].translate(flip)), ("bc2rc", bc2[::-1].translate(flip))):
            rows += [(v, sample, kind, sum(a != b for a, b in zip(v, seq, strict=True)), k) for v in hamming_variants(seq, most)]
    return reads.sparkSession.createDataFrame(rows, "tag string, sample string, kind string, dist int, ord int")


def barcode_fast_match(reads: DataFrame, pairs: list[tuple[str, str, str]], most: int = 1, *, start: str = "start_region", end: str = "end_region") -> DataFrame:
    """``reads`` (read_id, two regions) with sample: the valid pair of 10-mers with the least substitutions in total.

    Each end's 10-mers meet the table of variants by equality; of equal totals the sheet's first pair wins.
    """
    table = variant_table(reads, pairs, most)

    def hits(region: str, side: str) -> DataFrame:
        tags = reads.select("read_id", F.explode(kmers(F.col(region), TAG)).alias("tag"))
        return tags.join(table, "tag").groupBy("read_id", "sample", "ord", F.col("kind").alias(f"{side}_kind")).agg(F.min("dist").alias(f"{side}_dist"))

    allowed = F.lit(False)
    for a, b in sorted(PAIRS):
        allowed |= (F.col("s_kind") == a) & (F.col("e_kind") == b)
    both = hits(start, "s").join(hits(end, "e"), ["read_id", "sample", "ord"]).where(allowed)
    best = both.groupBy("read_id").agg(F.min(F.struct((F.col("s_dist") + F.col("e_dist")).alias("dist"), "ord", "sample")).alias("best"))
    return reads.join(best.select("read_id", F.col("best.sample").alias("sample"), F.col("best.dist").alias("dist")), "read_id", "left")


def _pocket(text: Column, anchor: str, after: bool) -> Column:
    """The 14 bases around the outer edge of the first anchor: two of the anchor's and twelve beside it."""
    at = F.instr(text, anchor)
    first = at + (len(anchor) - 2) if after else F.greatest(at - 12, F.lit(1))
    last = at + (len(anchor) + 11) if after else at + 1
    return F.when((at > 0) & (last <= F.length(text)) & (first <= last), F.substr(text, first, last - first + 1))


def anchor_pockets(reads: DataFrame, ends: int = 150) -> DataFrame:
    """``reads`` (seq) with bc1_pocket and bc2_pocket: at the start by the forward then the reverse anchor, then at the end.

    bc1_way and bc2_way say which of these four gave the pocket (1 to 4; null if none did): where the first anchor's
    pocket doesn't fit, the next way is asked.
    """
    # a generated column: filters on pockets stay above it, else they would derive seq anew wherever they name it
    reads = reads.withColumn("seq", F.explode(F.array("seq")))
    cut = F.greatest(F.length("seq") - ends, F.lit(0))
    head, tail = F.left("seq", cut), F.substr("seq", cut + 1)
    for name, fwd, rev, after in (("bc1", BC1_FWD, BC1_REV, False), ("bc2", BC2_FWD, BC2_REV, True)):
        ways = [_pocket(text, anchor, side) for text in (head, tail) for anchor, side in ((fwd, after), (rev, not after))]
        way = F.coalesce(*(F.when(p.isNotNull(), F.lit(k)) for k, p in enumerate(ways, 1)))
        reads = reads.withColumn(f"{name}_pocket", F.coalesce(*ways)).withColumn(f"{name}_way", way)
    return reads


def discover_barcodes(reads: DataFrame, anchors: list[str], k: int = 20, sample: int | None = None) -> DataFrame:
    """The k most frequent 10-mers right after any of the anchors, on either strand: barcode, count.

    ``sample`` stops after so many reads by arrival, as the operator offers; null reads all.
    """
    own = reads.orderBy("ord").limit(sample) if sample else reads
    strands = own.select(F.explode(F.array(F.col("seq"), reverse_complement(F.col("seq")))).alias("seq"))
    found = strands.select("seq", F.explode(F.array(*(F.lit(a) for a in anchors))).alias("anchor"))
    at = F.instr(F.col("seq"), F.col("anchor"))
    tag = F.substr("seq", at + F.length("anchor"), F.lit(TAG))
    return found.where(at > 0).select(tag.alias("barcode")).where(F.length("barcode") == TAG).groupBy("barcode").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "barcode").limit(k)


def near_known(barcodes: DataFrame, known: list[str], most: int = 1) -> DataFrame:
    """``barcodes`` with known: whether a listed barcode is within ``most`` edits."""
    near = F.lit(False)
    for seq in known:
        near |= F.levenshtein("barcode", F.lit(seq), most) >= 0
    return barcodes.withColumn("known", near)


def discover_pairs(pockets: DataFrame, known: list[tuple[str, str]], more_than: int = 5, k: int = 20, most: int = 1) -> DataFrame:
    """The k most frequent (bc1, bc2) seen more than ``more_than`` times and not within ``most`` edits of a listed pair."""
    counts = pockets.where("bc1 IS NOT NULL AND bc2 IS NOT NULL").groupBy("bc1", "bc2").agg(F.count("*").alias("count")).where(F.col("count") > more_than)
    near = F.lit(False)
    for a, b in known:
        near |= (F.levenshtein("bc1", F.lit(a), most) >= 0) & (F.levenshtein("bc2", F.lit(b), most) >= 0)
    return counts.where(~near).orderBy(F.desc("count"), "bc1", "bc2").limit(k)

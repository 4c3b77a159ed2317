"""Links between distant places of the genome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import genome_linearize


def sa_links(alignments: DataFrame, contigs: DataFrame) -> DataFrame:
    """(read_id, chrom_a, pos_a, chrom_b, pos_b): each supplementary place in the SA text ``chr,pos,...;`` on a known contig."""
    parts = alignments.where("sa IS NOT NULL").select("read_id", "chrom", "pos", F.explode(F.split("sa", ";")).alias("part")).where("part != ''")
    fields = F.split("part", ",")
    links = parts.select("read_id", F.col("chrom").alias("chrom_a"), F.col("pos").alias("pos_a"), fields[0].alias("chrom_b"), fields[1].try_cast("long").alias("pos_b")).where("pos_b IS NOT NULL")
    return links.join(contigs.select(F.col("chrom").alias("chrom_b")), "chrom_b", "left_semi").select("read_id", "chrom_a", "pos_a", "chrom_b", "pos_b")


def sv_matrix(links: DataFrame, contigs: DataFrame, near: int = 100_000) -> DataFrame:
    """Links as places (gx <= gy) on the linear genome with kind inter or intra; those within one chromosome below ``near`` are dropped."""
    genome = F.broadcast(genome_linearize(contigs).select("chrom", "offset"))  # one row a contig
    a = genome.select(F.col("chrom").alias("chrom_a"), F.col("offset").alias("off_a"))
    b = genome.select(F.col("chrom").alias("chrom_b"), F.col("offset").alias("off_b"))
    far = (F.col("chrom_a") != F.col("chrom_b")) | (F.abs(F.col("pos_a") - F.col("pos_b")) >= near)
    x, y = F.col("off_a") + F.col("pos_a"), F.col("off_b") + F.col("pos_b")
    return links.where(far).join(a, "chrom_a").join(b, "chrom_b").select("read_id", F.least(x, y).alias("gx"), F.greatest(x, y).alias("gy"), F.when(F.col("chrom_a") == F.col("chrom_b"), F.lit("intra")).otherwise(F.lit("inter")).alias("kind"))

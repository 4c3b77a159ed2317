"""CIGAR strings as expressions on arrays of (op, n)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_cigar(text: Column) -> Column:
    """array<struct<op, n>>; empty for null, * or an empty string."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([0-9]+[MIDNSHP=X])"), 1)
    return F.transform(parts, lambda p: F.struct(F.right(p, F.lit(1)).alias("op"), F.expr("1").cast("int").alias("one"), F.regexp_extract(p, "^([0-9]+)", 1).cast("int").alias("n")).dropFields("one"))


def ops_length(cigar: Column, ops: str) -> Column:
    """Bases of all operations in ``ops``."""
    return F.aggregate(cigar, F.lit(0).cast("long"), lambda a, c: a + F.when(c.op.isin(*ops), c.n.cast("long")).otherwise(F.lit(0).cast("long")))


def cigar_accuracy(cigar: Column) -> Column:
    """Percent of M and = among M, =, X, I, D and S; null without any."""
    total = ops_length(cigar, "M=XIDS")
    return F.when(total > 0, ops_length(cigar, "M=") * 100.0 / total)


def reference_end(pos: Column, cigar: Column) -> Column:
    """The place after the last aligned reference base; the start if nothing is aligned."""
    return pos + ops_length(cigar, "MDN=X")


def cigar_blocks(pos: Column, cigar: Column) -> Column:
    """array<struct<start, end>> of the reference stretches under M, = or X; D and N move on without a block."""
    zero = F.struct(pos.cast("long").alias("at"), F.array().cast("array<struct<start: bigint, end: bigint>>").alias("blocks"))

    def step(a: Column, c: Column) -> Column:
        end = a.at + c.n
        block = F.struct(a.at.alias("start"), end.alias("end"))
        return F.struct(
            F.when(c.op.isin("M", "=", "X", "D", "N"), end).otherwise(a.at).alias("at"),
            F.when(c.op.isin("M", "=", "X"), F.concat(a.blocks, F.array(block))).otherwise(a.blocks).alias("blocks"),
        )

    return F.aggregate(cigar, zero, step, lambda a: a.blocks)

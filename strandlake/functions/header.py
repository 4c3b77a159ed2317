"""FASTQ headers of long reads: ``key=value`` fields and ``TAG:type:value`` fields, in either order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: a trailing label of a read group that is a barcode, not part of the model's name.
BARCODE_LABEL = r"^(unclassified|no_barcode|(barcode|rb|nb|bc)[0-9]+)$"
TAGGED = r"^([^:]*):([ifZAHB]):(.*)$"


def header_tags(header: Column) -> Column:
    """The fields after the read's id as a map; the last of equal names counts (spark.sql.mapKeyDedupPolicy=LAST_WIN)."""
    words = F.split(F.trim(F.regexp_replace(header, r"\s+", " ")), " ")
    fields = F.slice(words, F.lit(2), F.size(words))
    pairs = F.transform(
        F.filter(fields, lambda f: f.rlike(TAGGED) | f.contains("=")),
        lambda f: F.when(f.rlike(TAGGED), F.struct(F.regexp_extract(f, TAGGED, 1).alias("key"), F.regexp_extract(f, TAGGED, 3).alias("value"))).otherwise(F.struct(F.substring_index(f, "=", 1).alias("key"), F.regexp_extract(f, "^[^=]*=(.*)$", 1).alias("value"))),
    )
    return F.map_from_entries(pairs)


def header_read_id(header: Column) -> Column:
    return F.regexp_extract(header, r"^\s*@*(\S*)", 1)


def first_of(tags: Column, *names: str) -> Column:
    return F.coalesce(*(F.try_element_at(tags, F.lit(n)) for n in names))


def parse_header(reads: DataFrame, header_col: str = "header") -> DataFrame:
    """``reads`` with ``meta``: read_id, run_id, flow_cell_id, barcode, basecall_model, basecall_gpu, channel, start_time, mean_qscore, parent_read_id."""
    tags = F.col("__tags")
    group = F.coalesce(F.try_element_at(tags, F.lit("RG")), F.lit(""))
    rest = F.regexp_extract(group, "^[^_]*_(.*)$", 1)
    tail = F.lower(F.regexp_extract(rest, "_([^_]*)$", 1))
    model = F.when(rest.contains("_") & tail.rlike(BARCODE_LABEL), F.regexp_extract(rest, "^(.*)_[^_]*$", 1)).otherwise(rest)
    some = lambda c: F.when(c != "", c)
    meta = F.struct(
        header_read_id(F.col(header_col)).alias("read_id"),
        F.coalesce(first_of(tags, "runid"), some(F.substring_index(group, "_", 1))).alias("run_id"),
        first_of(tags, "flow_cell_id", "PU").alias("flow_cell_id"),
        first_of(tags, "barcode", "BC", "al", "SM").alias("barcode"),
        F.coalesce(first_of(tags, "basecall_model_version_id"), some(model)).alias("basecall_model"),
        first_of(tags, "basecall_gpu").alias("basecall_gpu"),
        first_of(tags, "ch").try_cast("long").alias("channel"),
        first_of(tags, "start_time", "st").alias("start_time"),
        first_of(tags, "qs").try_cast("double").alias("mean_qscore"),
        first_of(tags, "parent_read_id", "pi").alias("parent_read_id"),
    )
    return reads.withColumn("__tags", header_tags(F.col(header_col))).withColumn("meta", meta).drop("__tags")


def is_split_read(read_id: Column, parent_id: Column) -> Column:
    """Whether the read was cut out of another one."""
    return F.coalesce((parent_id != "") & (parent_id != read_id), F.lit(False))


def read_group_id(run_id: Column, barcode: Column, read_id: Column) -> Column:
    return F.when(run_id.isNotNull() & barcode.isNotNull(), F.concat(run_id, F.lit("_"), barcode)).otherwise(F.coalesce(run_id, read_id))


def header_qs_either(header: Column) -> Column:
    """The stated quality in either dialect, the first that is a number."""
    fields = F.split(header, r"\s+")
    values = F.transform(fields, lambda f: F.coalesce(F.regexp_extract(f, "^qs:[^:]*:(.*)$", 1).try_cast("double"), F.regexp_extract(f, "^qs=(.*)$", 1).try_cast("double")))
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))

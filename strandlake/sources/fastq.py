"""FASTQ files, plain or gzip (several members too), as reads.

A sequencer writes files of a few thousand reads, so a file is one task: gzip can't be split, and only a reader that
counts lines tells a header from a quality string that begins with @.
"""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.header import header_read_id
from ..operators.clustering import numbered

SCHEMA = "file string, ord long, header string, seq string, qual string, malformed boolean"
SUFFIXES = ("fastq", "fq")
PATTERN = r"(?i)\.(fastq|fq)(\.gz)?$"


def is_fastq_path(path: str) -> bool:
    return path.lower().removesuffix(".gz").endswith(tuple(f".{s}" for s in SUFFIXES))


def parse(raw: bytes, mode: str = "exact") -> list[tuple[str, str, str, bool]]:
    """(header, seq, qual, malformed) of a file's bytes.

    exact: four lines a record; what is not a record raises. lenient: lines before an @ are skipped, records whose lengths
    differ are kept as malformed, a cut-off end is dropped. strict: as exact, and a cut-off gzip stream raises too, so
    that the whole file is read again later.
    """
    if raw[:2] == b"\x1f\x8b":
        try:
            raw = gzip.decompress(raw)
        except EOFError:
            if mode != "lenient":
                raise
            raw = _partial(raw)
    lines = raw.decode("latin-1").splitlines()
    out, at = [], 0
    while at < len(lines):
        if not lines[at].startswith("@"):
            if mode == "lenient" or not lines[at].strip():
                at += 1
                continue
            raise ValueError(f"no FASTQ header in line {at + 1}")
        record = lines[at : at + 4]
        if len(record) < 4:
            if mode == "lenient":
                break
            raise ValueError("the last FASTQ record is cut off")
        wrong = len(record[1]) != len(record[3]) or not record[2].startswith("+")
        if wrong and mode != "lenient":
            raise ValueError(f"sequence and quality differ in length in line {at + 1}")
        out.append((record[0], record[1], record[3], wrong))
        at += 4
    return out


def _partial(raw: bytes) -> bytes:
    import zlib

    return zlib.decompressobj(wbits=31).decompress(raw)


#: Reads that a file can have before ord would meet the next file's.
PER_FILE = 1 << 32


def ranked(files: DataFrame) -> DataFrame:
    """``files`` (path, ...) with ``rank``, their place in the order of paths. The listing is numbered without their contents."""
    return files.join(numbered(files.select("path"), "path", name="rank"), "path")


def scan_fastq(spark: SparkSession, path: str | list[str], mode: str = "exact") -> DataFrame:
    """reads: file, ord (unique, in order of file name and place), read_id, header, seq, qual, malformed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = ranked(files.where(F.col("path").rlike(PATTERN)).select("path", "content"))

    def read(batches):
        for batch in batches:
            for name, content, rank in zip(batch["path"], batch["content"], batch["rank"], strict=True):
                rows, first = parse(content, mode), rank * PER_FILE
                for k in range(0, len(rows), 4096):
                    part = rows[k : k + 4096]
                    yield pd.DataFrame({"file": name, "ord": range(first + k, first + k + len(part)), "header": [r[0] for r in part], "seq": [r[1] for r in part], "qual": [r[2] for r in part], "malformed": [r[3] for r in part]})

    reads = files.mapInPandas(read, SCHEMA)
    return reads.withColumn("read_id", header_read_id(F.col("header"))).select("file", "ord", "read_id", "header", "seq", "qual", "malformed")


def scan_fastq_text(spark: SparkSession, path: str) -> DataFrame:
    """The native form for plain files whose quality strings don't begin with @: one record a row, files split by blocks."""
    parts = spark.read.option("lineSep", "\n@").text(path)
    lines = F.split("value", "\n")
    rows = parts.select(F.col("_metadata.file_path").alias("file"), lines.alias("l")).where("size(l) >= 4")
    return rows.select("file", F.concat(F.lit("@"), F.regexp_replace(F.col("l")[0], "^@", "")).alias("header"), F.col("l")[1].alias("seq"), F.col("l")[3].alias("qual")).withColumn("read_id", header_read_id(F.col("header")))

"""Files that others read: FASTQ, TSV, JSON, BAM. Spark's commit makes each of them appear whole or not at all."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import file_system, replace_file


def fastq_record(header: Column, seq: Column, qual: Column) -> Column:
    """Four lines as one value; a leading @ is added once, missing qualities are I."""
    quality = F.coalesce(qual, F.repeat(F.lit("I"), F.length(seq)))
    return F.concat(F.lit("@"), F.regexp_replace(header, "^@", ""), F.lit("\n"), seq, F.lit("\n+\n"), quality)


def sink_fastq(reads: DataFrame, path: str, header: str = "header", compress: bool = False, mode: str = "error") -> None:
    """Reads as FASTQ; ``header`` may be read_id (the bare id) or the full original."""
    reads.select(fastq_record(F.col(header), F.col("seq"), F.col("qual")).alias("value")).write.mode(mode).option("compression", "gzip" if compress else "none").text(path)


def sink_fastq_by_key(reads: DataFrame, path: str, key: str, header: str = "header", compress: bool = False) -> None:
    """A folder for each sample or amplicon; a key's reads are dealt to its own tasks first."""
    rows = reads.select(F.col(key), fastq_record(F.col(header), F.col("seq"), F.col("qual")).alias("value"))
    rows.repartition(key).write.partitionBy(key).option("compression", "gzip" if compress else "none").text(path)


def sink_json(df: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON object a line, in as many files as there are partitions."""
    df.write.mode(mode).json(path)


def sink_atomic(spark: SparkSession, path: str, parts: Iterable[str]) -> None:
    """A single file in any store that Spark writes to: written aside, then renamed, so it is there whole or not at all."""
    store, at = file_system(spark, path)
    aside = at.suffix(f".{uuid.uuid4().hex}.tmp")
    out = store.create(aside)
    for part in parts:
        out.write(bytearray(part.encode()))
    out.close()
    replace_file(spark, aside, at)


def json_document(df: DataFrame) -> Iterator[str]:
    """The rows as one indented JSON array, piece by piece; the driver holds a partition at a time."""
    rows = (json.dumps(json.loads(r), indent=2) for r in df.toJSON().toLocalIterator())
    yield "["
    for k, row in enumerate(rows):
        yield ("," if k else "") + "\n  " + row.replace("\n", "\n  ")
    yield "\n]\n"


def sink_json_document(df: DataFrame, path: str) -> None:
    """One JSON document, whole or not at all."""
    sink_atomic(df.sparkSession, path, json_document(df))


def pretty_json(df: DataFrame) -> str:
    """json_document as a string, for results that are meant to be read."""
    return "".join(json_document(df))


def sink_umi_tsv(found: DataFrame, path: str) -> None:
    """One line a read, appended; NA for what is missing."""
    found.select("read_id", "umi.strand", "umi.umi_fwd", "umi.umi_fwd_dist", "umi.umi_rev", "umi.umi_rev_dist", "umi.combined", "umi.normalized", "umi.insert_size").write.mode("append").csv(path, sep="\t", header=True, nullValue="NA")


def formatted(df: DataFrame, two: list[str], four: list[str]) -> DataFrame:
    """Numbers as text with two or four decimals."""
    own = {c: F.format_string("%.2f", F.col(c).cast("double")) for c in two} | {c: F.format_string("%.4f", F.col(c).cast("double")) for c in four}
    return df.withColumns(own) if own else df


def sink_cluster_stats(stats: DataFrame, path: str) -> None:
    stats.orderBy("id_cluster").write.mode("overwrite").csv(path, sep="\t", header=True)


def sink_summary(summary: DataFrame, path: str) -> None:
    medians = ["median_reads_per_cluster", "median_reads_per_passing_cluster", "passing_cluster_pct", "reads_used_for_consensus_pct", "reads_in_small_clusters_pct"]
    formatted(summary, medians, ["mean_forward_fraction"]).write.mode("append").csv(path, sep="\t", header=True)


def sink_consensus_fastq(consensus: DataFrame, path: str) -> None:
    """@family_000001 method=... length=..., with I where there are no qualities."""
    header = F.concat(F.format_string("family_%06d", F.col("family")), F.lit(" method="), F.col("method"), F.lit(" length="), F.length("sequence").cast("string"))
    consensus.select(fastq_record(header, F.col("sequence"), F.col("quality")).alias("value")).write.text(path)


def sink_duplex_pairs(pairs: DataFrame, path: str) -> None:
    pairs.select(F.concat_ws(" ", "first", "second").alias("value")).write.text(path)


def sink_bam(rows: DataFrame, path: str, contigs: list[tuple[str, int]], text: str = "@HD\tVN:1.6\n") -> None:
    """A BAM file for each partition below ``path``, a folder that all share; written aside and renamed when whole."""
    from pyspark import TaskContext

    from ..sources.bam import encode

    def write(part):
        from pyarrow import fs

        records = [r.asDict(recursive=True) for r in part]
        if records:
            store, folder = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
            store.create_dir(folder, recursive=True)
            name = f"part-{TaskContext.get().partitionId():05d}.bam"
            aside = f"{folder}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(aside) as f:
                f.write(encode(text, contigs, records))
            store.move(aside, f"{folder}/{name}")

    rows.foreachPartition(write)


def unaligned_header(run: str, model: str, version: str) -> str:
    """Header text of an unaligned file: one read group and this program."""
    return f"@HD\tVN:1.6\tSO:unknown\n@RG\tID:{run}\tPL:ONT\tDS:basecall_model={model}\n@PG\tID:strandlake\tPN:strandlake\tVN:{version}\n"

"""Reads, timings, alignments and tables derived from general tables, by expressions that other engines have too.

Each function has its SQL twin in SQL, so a query and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS, BASES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC"

SQL = {
    "reads": f"""SELECT doc_id AS ord, 'r' || doc_id AS read_id, source AS sample, lang AS amplicon, seq, translate(seq, 'ACGT', '+5?I') AS qual, length(seq) AS length
        FROM (SELECT *, translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), '{LETTERS}', '{BASES}') AS seq FROM documents)""",
    "timings": "SELECT user_id AS ch, event_type AS mx, epoch(ts) AS start_s, epoch(ts) + value AS end_s, value AS duration_s, event_id AS ord FROM events",
    "headers": """SELECT o_orderkey AS ord, '@r' || o_orderkey || ' qs:f:' || (o_orderkey % 30) || '.5 ch:i:' || o_custkey || ' st:Z:t' || (o_orderkey % 9) ||
        (CASE WHEN o_orderkey % 5 = 0 THEN ' pi:Z:p' || o_orderkey ELSE '' END) ||
        (CASE WHEN o_orderkey % 2 = 0 THEN ' RG:Z:run' || (o_custkey % 7) || '_model@v' || (o_orderkey % 3) || '_barcode0' || (o_orderkey % 9) ELSE ' runid=x' || (o_custkey % 7) || ' barcode=bc' || (o_orderkey % 9) END) AS header FROM orders""",
    "summary": """SELECT 'r' || o_orderkey AS read_id, 'barcode0' || substr(o_orderpriority, 1, 1) AS barcode, CAST(floor(o_totalprice) AS BIGINT) % 100 AS front_score,
        CAST(floor(o_totalprice / 100) AS BIGINT) % 100 AS rear_score, o_orderkey % 30 AS qscore, o_custkey AS channel FROM orders""",
    "alignments": """SELECT ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS read_id, l_returnflag AS chrom, l_partkey * 10 AS pos, CAST(floor(l_quantity) AS INTEGER) AS q, l_linenumber AS k, l_suppkey AS pore,
        CASE l_linenumber % 5 WHEN 0 THEN 256 WHEN 1 THEN 2048 WHEN 2 THEN 4 ELSE 16 END AS flag, l_linestatus AS barcode FROM lineitem""",
    "bed": "SELECT substr('ANR', p_size % 3 + 1, 1) AS chrom, p_partkey * 10 AS start, p_partkey * 10 + p_size AS \"end\", p_brand AS gene, p_partkey AS ord FROM part",
}


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def reads(spark: SparkSession, d: str) -> DataFrame:
    seq = F.translate(F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "")), LETTERS, BASES)
    own = _table(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("read_id"), F.col("source").alias("sample"), F.col("lang").alias("amplicon"), seq.alias("seq"))
    return own.withColumn("qual", F.translate("seq", "ACGT", "+5?I")).withColumn("length", F.length("seq").cast("long"))


def timings(spark: SparkSession, d: str) -> DataFrame:
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return _table(spark, d, "events").select(F.col("user_id").alias("ch"), F.col("event_type").alias("mx"), start.alias("start_s"), (start + F.col("value")).alias("end_s"), F.col("value").alias("duration_s"), F.col("event_id").alias("ord"))


def headers(spark: SparkSession, d: str) -> DataFrame:
    s = lambda e: F.expr(f"CAST({e} AS STRING)")
    parent = F.when(F.expr("o_orderkey % 5 = 0"), F.concat(F.lit(" pi:Z:p"), s("o_orderkey"))).otherwise("")
    group = F.concat(F.lit(" RG:Z:run"), s("o_custkey % 7"), F.lit("_model@v"), s("o_orderkey % 3"), F.lit("_barcode0"), s("o_orderkey % 9"))
    plain = F.concat(F.lit(" runid=x"), s("o_custkey % 7"), F.lit(" barcode=bc"), s("o_orderkey % 9"))
    header = F.concat(F.lit("@r"), s("o_orderkey"), F.lit(" qs:f:"), s("o_orderkey % 30"), F.lit(".5 ch:i:"), s("o_custkey"), F.lit(" st:Z:t"), s("o_orderkey % 9"), parent, F.when(F.expr("o_orderkey % 2 = 0"), group).otherwise(plain))
    return _table(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), header.alias("header"))


def summary(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "orders").select(
        F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("read_id"), F.concat(F.lit("barcode0"), F.substring("o_orderpriority", 1, 1)).alias("barcode"), (F.floor("o_totalprice") % 100).alias("front_score"),
        (F.floor(F.col("o_totalprice") / 100) % 100).alias("rear_score"), (F.col("o_orderkey") % 30).alias("qscore"), F.col("o_custkey").alias("channel"),
    )


def alignments(spark: SparkSession, d: str) -> DataFrame:
    k, q = F.col("l_linenumber"), F.floor("l_quantity").cast("int")
    cigar = F.concat(k.cast("string"), F.lit("S"), q.cast("string"), F.lit("M2D"), (k + 5).cast("string"), F.lit("M"))
    flag = F.expr("CASE l_linenumber % 5 WHEN 0 THEN 256 WHEN 1 THEN 2048 WHEN 2 THEN 4 ELSE 16 END")
    return _table(spark, d, "lineitem").select(
        (((F.col("l_orderkey") * 10 + k) * 1_000_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")).alias("read_id"), F.col("l_returnflag").alias("chrom"), (F.col("l_partkey") * 10).alias("pos"), q.alias("q"), k.alias("k"), F.col("l_suppkey").alias("pore"), flag.alias("flag"), F.col("l_linestatus").alias("barcode"), cigar.alias("cigar"),
    )


def bed(spark: SparkSession, d: str) -> DataFrame:
    start = F.col("p_partkey") * 10
    return _table(spark, d, "part").select(F.expr("substr('ANR', p_size % 3 + 1, 1)").alias("chrom"), start.alias("start"), (start + F.col("p_size")).alias("end"), F.col("p_brand").alias("gene"), F.col("p_partkey").alias("ord"))


def contigs(spark: SparkSession, length: int = 15_000) -> DataFrame:
    return spark.createDataFrame([(c, length) for c in "ANR"], "chrom string, len long")

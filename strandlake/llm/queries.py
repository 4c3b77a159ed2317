"""The registered query of each operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, exact_dedup, packing, quality, simhash, token_counts, token_output, toxicity, url_filter, vector_search
from ._common import scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-planes")
    token_output.write_token_files(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_output.read_token_files(spark, path)


def op2_rank_queue_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, by_units=True)


def op3_transducer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op4_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return vector_search.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20, relax=1.0)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(_table(spark, sf_dir, "documents"), shingle=4, most=4, words=1)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048)


#: The rules of the registered query: host, path, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, RULES))} AS rules(host, path, verdict)"))


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.severities(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_token_planes, op2_rank_queue_bpe, op3_transducer_counts, op4_vantage_point_search, op5_exact_dedup, op6_simhash, op7_best_fit_packing, op8_url_rules, op9_importance_resampling, op10_ordinal_toxicity)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    host = r"translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return {
        "op4_vantage_point_search": """
            WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
            s AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * v.e[i])) AS score
                  FROM v AS q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
            r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
        "op5_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
                   doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
        "op8_url_rules": f"""
            WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
            u AS (SELECT page_id, {host} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
            r(r_host, r_path, verdict) AS (VALUES {rules}),
            m AS (SELECT u.page_id, r_host || r_path AS rule, verdict,
                         row_number() OVER (PARTITION BY u.page_id ORDER BY length(r_host) + length(r_path) DESC, length(r_host) DESC, verdict DESC) AS k
                  FROM u JOIN r ON (u.host = r_host OR ends_with(u.host, '.' || r_host)) AND starts_with(u.path, r_path))
            SELECT u.page_id, host, path, rule, coalesce(m.verdict, 'allow') AS verdict
            FROM u LEFT JOIN m ON u.page_id = m.page_id AND k = 1""",
    }

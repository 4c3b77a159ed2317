"""Exact duplicates by a stateful stream.

A stream of (digest, row) feeds keyed state in RocksDB, on the executors' disks and in the checkpoint. For each digest
the state retains the stable identifier of the row that stays, the locator of its content (file and row) and how often
the digest was seen; there is no watermark, so nothing expires. Texts that hit a known digest, and only those, are then
checked by their full bytes against the text at the locator: a digest with more than one text is split by text.

Everything runs on DataFrame functions; a group of copies is folded within each task before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fresh, join_few, located, scratch, sieved, texts, without_places, written

#: State on disk; a version adds its changes to the checkpoint, and no store allocates files ahead of what it holds.
STORE = {
    "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "rocksdb.changelogCheckpointing.enabled": "true",
    "rocksdb.allowFAllocate": "false",
    # all stores of an executor share one bounded cache
    "rocksdb.boundedMemoryUsage": "true",
    "rocksdb.maxMemoryUsageMB": "200",
}


@contextmanager
def _setting(spark: SparkSession, **keys: str):
    """Settings for the block only; a query copies them when it starts."""
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def seen(spark: SparkSession, feed: str, checkpoint: str) -> DataFrame:
    """Run the stream over the rows at ``feed`` that it hasn't read yet; the state after it: digest, n, keep (doc_id, at).

    A checkpoint that is used again goes on where it ended: new files in ``feed`` meet all digests of earlier ones.
    """
    rows = spark.readStream.schema("digest binary, doc_id long, at struct<file: string, row: long>").parquet(feed)
    state = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "at")).alias("keep"), F.count("*").alias("n"))
    with _setting(spark, **{f"spark.sql.streaming.stateStore.{k}": v for k, v in STORE.items()}):
        query = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    stored = spark.read.format("statestore").load(checkpoint)
    names = {f.dataType.typeName(): f.name for f in stored.schema["value"].dataType}
    return stored.select(F.col("key.digest").alias("digest"), F.col(f"value.{names['long']}").alias("n"), F.col(f"value.{names['struct']}").alias("keep"))


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, and ``at``, the place of its content.

    Texts are equal when all bytes are, unchanged; a null text is empty. The row with the largest doc_id stays; a null id
    is smaller than any other, and of rows with equal ids the one with the last place stays, so a group keeps exactly
    one row. An empty table gives no rows; other columns of ``docs`` may have any names.
    """
    path, (place,) = scratch(docs.sparkSession, "exact"), fresh(docs.columns, "at")
    return _groups(texts(located(docs, f"{path}/docs", place), id_col, text_col, place), path)


def sha256(text: str) -> Column:
    return F.unhex(F.sha2(text, 256))


def _groups(rows: DataFrame, path: str, digest: Callable[[str], Column] = sha256) -> DataFrame:
    spark = rows.sparkSession
    rows = rows.select(digest("text").alias("digest"), "doc_id", "text", "at")
    feed = written(rows.select("digest", "doc_id", "at"), f"{path}/feed")
    state = written(seen(spark, f"{path}/feed", f"{path}/state"), f"{path}/seen")
    hits = state.where("n > 1")

    # the bytes of hits only: equal texts fold within each task, and must be the one that the state's locator points at
    same = F.max(F.struct("doc_id", "at")).alias("keep"), F.count("*").alias("n")
    contents = sieved(rows, F.xxhash64("digest"), hits, F.xxhash64("digest"), hits.count(), "hit").where("hit").groupBy("digest", "text").agg(*same)
    checked = contents.join(hits.select("digest", F.col("keep.at").alias("located")), "digest")
    other = written(checked.where("keep.at != located").select("digest").distinct(), f"{path}/other")

    def result(members: DataFrame) -> DataFrame:
        stays = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("at") == F.col("keep.at"))
        return members.select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("group_size"), stays.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "at")

    if other.isEmpty():
        return result(join_few(feed, state.withColumn("group_size", F.col("n")), ["digest"], "n"))
    sound = state.join(other, "digest", "left_anti").withColumn("group_size", F.col("n"))
    out = result(join_few(feed.join(other, "digest", "left_anti"), sound, ["digest"], "n"))
    clashing = rows.join(other, "digest")  # two texts of one SHA-256
    own = clashing.groupBy("digest", "text").agg(*same).withColumnRenamed("n", "group_size")
    return out.unionByName(result(clashing.join(own, ["digest", "text"])))


def without_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; cases as in exact_groups."""
    path, (place,) = scratch(docs.sparkSession, "exact"), fresh(docs.columns, "at")
    rows = located(docs, f"{path}/docs", place)
    dropped = written(_groups(texts(rows, id_col, text_col, place), path).where("NOT kept").select(F.col("at").alias(place)), f"{path}/dropped")
    return without_places(rows, dropped, place).select(*docs.columns)

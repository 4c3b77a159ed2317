"""Files in the shared folder and small DataFrame helpers."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import fresh, scratch, written

__all__ = ["fetch", "fresh", "join_few", "located", "put", "released", "scratch", "settle", "sieved", "slices", "store", "texts", "without_places", "written"]


def store(path: str):
    """(Arrow file system, path in it) of a folder that tasks read and write files in themselves."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def put(path: str, data: bytes) -> None:
    """A file at ``path`` that appears only when it is whole, so a task can run twice."""
    system, at = store(path)
    folder, _, name = at.rpartition("/")
    system.create_dir(folder, recursive=True)
    aside = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(aside) as f:
        f.write(data)
    settle(system, aside, at)


def settle(system, aside: str, at: str) -> None:
    """Give a whole file its name. Where a store doesn't replace files, one that another run of the task left there stays: it is the same."""
    from pyarrow import fs

    try:
        system.move(aside, at)
    except OSError:
        if system.get_file_info(at).type != fs.FileType.File:
            raise
        system.delete_file(aside)


def fetch(path: str) -> bytes:
    system, at = store(path)
    with system.open_input_file(at) as f:
        return f.read()


def released(cache: Callable | None = None):
    """For a function over batches: once a task is done, its worker forgets what ``cache`` holds and returns unused memory.

    Idle workers stay beside the tasks of later stages, which need the executor's memory.
    """

    def wrap(run: Callable) -> Callable:
        def until_done(batches):
            try:
                yield from run(batches)
            finally:
                if cache:
                    cache.cache_clear()
                gc.collect()
                pa.default_memory_pool().release_unused()
                if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps freed memory otherwise
                    trim(0)

        return until_done

    return wrap


def slices(batches, rows: int = 512):
    """The batches in parts of at most so many rows, so that few texts are held as Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def located(docs: DataFrame, path: str, name: str) -> DataFrame:
    """``docs`` with the file and row of each row's content as ``name``; what is not read from Parquet files is written to ``path`` first."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias(name)
    try:
        return docs.select("*", place)
    except AnalysisException:
        return written(docs, path).select("*", place)


def join_few(rows: DataFrame, each: DataFrame, keys: list[str], n: str) -> DataFrame:
    """``rows`` joined with ``each``, which has one row a key and in ``n`` how many of ``rows`` have it; ``n`` is left out.

    Keys with over a thousandth of all rows are a thousand at most, so they are broadcast and stay where they are; of the
    others none is much of a task. Both tables should be written ones, as they are read twice.
    """
    total = each.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) * 1000 > total
    many, few = F.broadcast(each.where(hot).drop(n)), each.where(~hot).drop(n)
    return rows.join(many, keys).unionByName(rows.join(many.select(*keys), keys, "left_anti").join(few, keys))


def sieved(rows: DataFrame, hashed: Column, among: DataFrame, of: Column, n: int, name: str) -> DataFrame:
    """``rows`` with ``name``: whether the 64-bit ``hashed`` of a row may be the hash ``of`` one of the ``n`` rows of ``among``.

    Bitmaps of at most 32 MB in all go to every task, at any size: about 32 bits a row, one of them set. Where there are
    more rows than fit that, more is let through. A false answer is always right.
    """
    buckets = min(8192, 1 << max(0, (n * 32 >> 15).bit_length()))
    bucket, bit, bitmap = fresh(rows.columns, "bucket", "bit", "bitmap")
    place = lambda h: (F.pmod(F.shiftright(h, 15), F.lit(buckets)).alias(bucket), h.bitwiseAND(F.lit((1 << 15) - 1)).alias(bit))
    maps = among.select(*place(of)).groupBy(bucket).agg(F.bitmap_construct_agg(bit).alias(bitmap))
    met = rows.select("*", *place(hashed)).join(F.broadcast(maps), bucket, "left")
    byte = F.conv(F.hex(F.expr(f"substring({bitmap}, {bit} div 8 + 1, 1)")), 16, 10).cast("int")
    found = F.call_function("shiftright", byte, (F.col(bit) % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return met.withColumn(name, F.coalesce(found, F.lit(False))).drop(bucket, bit, bitmap)


def without_places(rows: DataFrame, dropped: DataFrame, place: str) -> DataFrame:
    """``rows`` but those whose ``place`` is in ``dropped``, a written table. Only rows that may be among them are shuffled."""
    (maybe,) = fresh(rows.columns, "maybe")
    marked = sieved(rows, F.xxhash64(place), dropped, F.xxhash64(place), dropped.count(), maybe)
    return marked.where(~F.col(maybe)).unionByName(marked.where(maybe).join(dropped, place, "left_anti")).drop(maybe)


def texts(docs: DataFrame, id_col: str, text_col: str, place: str | None = None) -> DataFrame:
    """Only (doc_id, text) of ``docs``, whatever else it has, and ``place`` as at; a null text is empty."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
        *([docs[place].alias("at")] if place else []),
    )

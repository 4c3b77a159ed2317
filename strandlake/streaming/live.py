"""Following a run while it is written: new files become batches, counters go on, segments are folded together.

Spark's checkpoint is the ledger: a file is done when its batch is committed, and a batch that is repeated after a crash
writes to the same place, so nothing counts twice.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from pathlib import Path

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.names import barcode_from_path
from ..operators.clustering import numbered
from ..shared import file_system
from ..sinks.files import sink_atomic
from ..sources.fastq import PATTERN, PER_FILE, parse

READS = "file string, ord long, barcode string, read_id string, seq string, qual string"


def watch_files(spark: SparkSession, path: str, per_batch: int = 100) -> DataFrame:
    """A stream of FASTQ files (path, content), each once; hidden files, empty ones and folders of failed reads are skipped."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(path)
    shown = ~F.col("path").rlike(r"/[._][^/]*(/|$)") & ~F.col("path").contains("/fastq_fail/")
    return files.where(F.col("path").rlike(PATTERN) & shown & (F.col("length") > 0))


def ready(age: float, size: int, last_size: int | None, stable: float = 10.0) -> bool:
    """Whether a file is taken up: not empty, as large as when last seen, and untouched for ``stable`` seconds."""
    return size > 0 and size == last_size and age >= stable


class RunFiles(DataSource):
    """The streaming source ``run_files``: the reads of a run's FASTQ files, each file once it is ready.

    Options: path (the run), ledger (a folder that all share), stable (seconds without a change, 10), once (true: what
    has been untouched that long is ready without a second look), per_batch (files, 100). What is taken up is written to
    the ledger first, so a batch that is repeated has the same files. A file that can't be read leaves a note of its
    failure in the place of its reads and is offered again after retry_wait, under a later number.
    """

    @classmethod
    def name(cls) -> str:
        return "run_files"

    def schema(self) -> str:
        return "file string, ord long, barcode string, read_id string, header string, seq string, qual string"

    def streamReader(self, schema) -> RunFilesReader:
        return RunFilesReader(self.options)


class RunFilesReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.ledger = options["path"], options["ledger"].rstrip("/")
        self.stable, self.once, self.per_batch = float(options.get("stable", 10)), str(options.get("once", "false")).lower() == "true", int(options.get("per_batch", 100))
        self.sizes: dict[str, int] = {}

    def _json(self, folder: str) -> list[tuple[str, dict]]:
        """(name, content) of the notes in a folder of the ledger, by name."""
        store, at = arrow_store(f"{self.ledger}/{folder}")
        found = sorted(f.path for f in store.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.path.endswith(".json") and not f.base_name.startswith("."))
        return [(p.rsplit("/", 1)[1].removesuffix(".json"), json.loads(store.open_input_stream(p).read())) for p in found]

    def _note(self, folder: str, number: int, content: dict) -> None:
        store, at = arrow_store(f"{self.ledger}/{folder}")
        store.create_dir(at, recursive=True)
        aside, to = f"{at}/.{number:012d}.{uuid.uuid4().hex}", f"{at}/{number:012d}.json"
        with store.open_output_stream(aside) as f:
            f.write(json.dumps(content).encode())
        store.move(aside, to)

    def initialOffset(self) -> dict:
        return {"n": 0}

    def latestOffset(self) -> dict:
        taken = [(int(k), e["path"]) for k, e in self._json("taken")]
        failed = {int(k): e for k, e in self._json("failed")}
        tries: dict[str, list[int]] = {}
        for k, path in taken:
            tries.setdefault(path, []).append(k)
        store, at = arrow_store(self.root)
        now, n, offered = time.time(), len(taken), 0
        listed = sorted((f for f in store.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True)) if f.is_file), key=lambda f: f.path)
        for f in listed:
            hidden = any(p[:1] in "._" for p in f.path.removeprefix(at).strip("/").split("/"))
            if hidden or "/fastq_fail/" in f.path or not re.search(PATTERN, f.path) or offered == self.per_batch:
                continue
            last = f.size if self.once else self.sizes.get(f.path)
            self.sizes[f.path] = f.size
            own = tries.get(f.path, [])
            if own:
                # only after a failure, when its wait is over
                wait = retry_wait(len(own), self.once) if own[-1] in failed else None
                if wait is None or now - failed[own[-1]]["at"] < wait:
                    continue
            if ready(now - f.mtime.timestamp(), f.size, last, self.stable):
                self._note("taken", n, {"path": f.path})
                n, offered = n + 1, offered + 1
        return {"n": n}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition((int(k), e["path"])) for k, e in self._json("taken") if start["n"] <= int(k) < end["n"]]

    def read(self, partition: InputPartition):
        number, path = partition.value
        store, at = arrow_store(f"{self.ledger}/failed")
        if store.get_file_info(f"{at}/{number:012d}.json").type == fs.FileType.File:
            return  # this try has failed before, and a later one counts
        try:
            rows = parse(arrow_store(self.root)[0].open_input_file(path).read(), "strict")
        except Exception as e:  # whatever is wrong with one file must not end the run
            self._note("failed", number, {"path": path, "at": time.time(), "error": str(e)[:500]})
            return
        barcode = next((m.lower() for m in re.findall(r"(?i)(?<=/)barcode[0-9]+(?=/)", path)), "unclassified")
        for k, (header, seq, qual, _) in enumerate(rows):
            yield path, number * PER_FILE + k, barcode, header.lstrip("@").split()[0] if header.strip("@ ") else "", header, seq, qual

    def commit(self, end: dict) -> None:
        """Nothing to do: the ledger is what counts."""


def arrow_store(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def watch_run(spark: SparkSession, path: str, ledger: str, **options) -> DataFrame:
    """A stream of the reads of ``path`` by the source run_files."""
    spark.dataSource.register(RunFiles)
    return spark.readStream.format("run_files").options(path=path, ledger=ledger, **options).load()


def file_reads(files: DataFrame) -> DataFrame:
    """The reads of whole files with the barcode of their folder; a cut-off file raises, so its batch is tried again.

    ``ord`` is the place within the file; write_segments makes it unique over the files of a run.
    """
    import pandas as pd

    from ..functions.header import header_read_id

    def read(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = parse(content, "strict")
                for k in range(0, len(rows), 4096):
                    part = rows[k : k + 4096]
                    yield pd.DataFrame({"file": name, "ord": range(k, k + len(part)), "header": [r[0] for r in part], "seq": [r[1] for r in part], "qual": [r[2] for r in part]})

    own = files.select("path", "content").mapInPandas(read, "file string, ord long, header string, seq string, qual string")
    return own.withColumn("barcode", F.coalesce(barcode_from_path(F.col("file")), F.lit("unclassified"))).withColumn("read_id", header_read_id(F.col("header")))


def running_counters(reads: DataFrame, min_len: int, max_len: int, min_qv: float) -> DataFrame:
    """Counters for each barcode as a streaming aggregation; they survive a restart in the state store."""
    from ..operators.stats import read_counts

    return read_counts(reads, min_len, max_len, min_qv)


def write_segments(reads: DataFrame, out: str, checkpoint: str, once: bool = True, seconds: int = 30) -> StreamingQuery:
    """Each batch as a folder ``batch=<id>`` that a repeated batch replaces. ``once``: all that is there, then stop.

    ``ord`` becomes unique over the run: by batch, then by file name, then by place. A batch has fewer than 2^13 files
    (maxFilesPerTrigger bounds them), a file fewer than 2^32 reads.
    """

    def segment(batch: DataFrame, number: int) -> None:
        files = numbered(batch.select("file").distinct(), "file", name="rank")
        own = batch.join(files, "file").withColumn("ord", F.col("ord") + (F.col("rank") + (number << 13)) * F.lit(PER_FILE)).drop("rank")
        own.select(*batch.columns).write.mode("overwrite").parquet(f"{out}/segments/batch={number}")

    writer = reads.writeStream.foreachBatch(segment).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def micro_batches(reads: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return reads.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Snapshots:
    """Generations of sorted reads, in any store that Spark reads. The manifest names those that count; to replace it is the commit.

    Generations are kept by size: a compaction folds the new segments, and of the generations only those that are not
    larger than what is folded already. So each read is written about as often as the log of their number.
    """

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out = spark, out.rstrip("/")
        self.store, self.root = file_system(spark, self.out)

    def _path(self, *parts: str):
        return file_system(self.spark, "/".join([self.out, *parts]))[1]

    def _names(self, folder, begin: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.store.listStatus(folder) if s.getPath().getName().startswith(begin)) if self.store.exists(folder) else []

    def _bytes(self, path) -> int:
        return self.store.getContentSummary(path).getLength()

    def current(self) -> dict:
        manifest = self._path("manifest.json")
        if not self.store.exists(manifest):
            return {"generation": 0, "parts": [], "consumed": []}
        return json.loads(self.spark.read.text(manifest.toString(), wholetext=True).first()[0])

    def read(self) -> DataFrame | None:
        parts = self.current()["parts"]
        return self.spark.read.parquet(*(f"{self.out}/generation={g}" for g in parts)) if parts else None

    def compact(self, order: list[str]) -> int:
        """Fold the segments that no generation holds into the next one; returns its number."""
        self.recover()
        state, segments = self.current(), self._path("segments")
        new = [n for n in self._names(segments, "batch=") if n not in state["consumed"] and self.store.exists(self._path("segments", n, "_SUCCESS"))]
        if not new:
            return state["generation"]
        folded = [f"{self.out}/segments/{n}" for n in new]
        size = sum(self._bytes(self._path("segments", n)) for n in new)
        kept = list(state["parts"])
        while kept and (own := self._bytes(self._path(f"generation={kept[-1]}"))) <= size:
            folded.append(f"{self.out}/generation={kept.pop()}")
            size += own
        number = state["generation"] + 1
        whole = self.spark.read.parquet(*folded)
        whole.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{self.out}/generation={number}")
        done = {"generation": number, "parts": [*kept, number], "consumed": sorted({*state["consumed"], *new})}
        sink_atomic(self.spark, f"{self.out}/manifest.json", [json.dumps(done)])
        return number

    def recover(self) -> None:
        """After a crash: drop generations that the manifest doesn't name and segments that it has taken in."""
        state = self.current()
        for name in self._names(self.root, "generation="):
            if int(name.split("=")[1]) not in state["parts"]:
                self.store.delete(self._path(name), True)
        for name in self._names(self._path("segments"), "batch="):
            if name in state["consumed"]:
                self.store.delete(self._path("segments", name), True)


def read_ledger(text: str) -> list[dict]:
    """Entries of a ledger of JSON lines; a torn line is ignored, later ones count."""
    out = []
    for line in text.splitlines():
        try:
            entry = json.loads(line)
        except ValueError:
            continue
        if isinstance(entry, dict):
            out.append(entry)
    return out


def retry_wait(attempts: int, once: bool = False) -> float | None:
    """Seconds before a file is tried again: five for each attempt, at most sixty; a single run gives up after five."""
    return None if once and attempts >= 5 else min(60.0, 5.0 * attempts)


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """Of queued jobs (barcode, generation, ...) the newest of each barcode."""
    return jobs.groupBy("barcode").agg(F.max("generation").alias("generation"))


def liveness(age: Column, finished: Column, error: Column, stale: float = 120.0):
    """not-started, error, finished, stale or running, from the age of the last heartbeat in seconds."""
    return F.when(error.isNotNull(), F.lit("error")).when(finished, F.lit("finished")).when(age.isNull(), F.lit("not-started")).when(age > stale, F.lit("stale")).otherwise(F.lit("running"))


def run_finished(files: list[str]) -> bool:
    """Whether the sequencer has written its final summary."""
    return any(Path(f).name.startswith("final_summary") and f.endswith(".txt") for f in files)


def stop_when(query: StreamingQuery, stop_file: str, poll: float = 1.0) -> None:
    """Wait for the query to end, or end it once the file is there."""
    store, at = file_system(query_session(), stop_file)
    while not query.awaitTermination(int(max(1, poll))):
        if store.exists(at):
            query.stop()
            return


def query_session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def new_files(seen: DataFrame, listed: DataFrame) -> DataFrame:
    """Files that a listing has and an earlier one hasn't."""
    return listed.select("path").distinct().join(seen.select("path"), "path", "left_anti")


class RunAccumulator:
    """Reads so far: those of finished parts and those of the part that runs; finishing adds a part once."""

    def __init__(self):
        self.base = self.live = 0

    def update(self, live: int) -> None:
        self.live = live

    def finish(self, total: int) -> None:
        self.base, self.live = self.base + total, 0

    @property
    def total(self) -> int:
        return self.base + self.live


def replay(source: str, target: str, seconds: float = 0.0, half_first: bool = False) -> int:
    """Copy a finished run's files in the order of their times, as if it were written now; returns how many."""
    files = sorted((p for p in Path(source).rglob("*") if p.is_file()), key=lambda p: (p.stat().st_mtime, str(p)))
    for p in files:
        to = Path(target, p.relative_to(source))
        to.parent.mkdir(parents=True, exist_ok=True)
        data = p.read_bytes()
        if half_first:
            to.with_name(f".{to.name}.part").write_bytes(data[: len(data) // 2])
        to.with_name(f".{to.name}.part").write_bytes(data)
        to.with_name(f".{to.name}.part").replace(to)
        time.sleep(seconds)
    return len(files)

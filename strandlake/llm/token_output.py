"""Token ids in files of bit planes or byte planes.

A shard holds the ids of consecutive documents. Blocks of ``block_tokens`` ids are transposed into planes, one for each
bit (or byte) of an id; each plane is compressed with zstandard on its own. High planes are nearly constant, so they
shrink to a few bytes. A chunk index at the end of the shard says where each block begins and how long its planes are,
so that any range of ids can be read without the blocks before it.

Layout, little-endian: header MAGIC, version, plane kind, bits of an id, block size; the planes; the documents section
(zstandard: a byte that says whether the id is null, doc_id int64, ids of the document uint64); the index (per block:
offset uint64, first id uint64, ids uint32, then the length of each plane uint32); footer with both sections' offsets.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import settle, texts
from ._common import store as store_of
from .unit_encoding import library_encoder

MAGIC = b"PLNE"
HEADER = struct.Struct("<4sHBBI")
FOOTER = struct.Struct("<QQQQQ4s")


def to_planes(ids: np.ndarray, bits: int, kind: str) -> list[bytes]:
    """The planes of a block, lowest first."""
    raw = ids.astype(f"<u{bits // 8}").view(np.uint8).reshape(len(ids), bits // 8)
    if kind == "byte":
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(bits // 8)]
    planes = np.packbits(np.ascontiguousarray(np.unpackbits(raw, axis=1, bitorder="little").T), axis=1, bitorder="little")
    return [p.tobytes() for p in planes]


def from_planes(planes: list[bytes], n: int, bits: int, kind: str) -> np.ndarray:
    if kind == "byte":
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        ids = np.zeros(n, f"<u{bits // 8}")
        for k, p in enumerate(planes):
            ids |= np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little").astype(ids.dtype) << ids.dtype.type(k)
        return ids
    return np.ascontiguousarray(raw).reshape(-1).view(f"<u{bits // 8}")


class ShardWriter:
    """Writes one shard; only blocks and the documents' lengths are kept in memory."""

    def __init__(self, out, bits: int, kind: str, block_tokens: int, level: int = 3):
        self.out, self.bits, self.kind, self.block = out, bits, kind, block_tokens
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_tokens = self.offset = 0
        self.doc_ids, self.lengths, self.index = [], [], []
        self._put(HEADER.pack(MAGIC, 1, kind == "bit", bits, block_tokens))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.offset += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.block:
            self._flush(self.block)

    def _flush(self, least: int) -> None:
        ids = np.concatenate(self.waiting)
        whole = len(ids) // self.block * self.block if least == self.block else len(ids)
        for at in range(0, whole, self.block):
            block = ids[at : min(at + self.block, whole)]
            packed = [self.zstd.compress(p) for p in to_planes(block, self.bits, self.kind)]
            self.index.append((self.offset, self.n_tokens, len(block), [len(p) for p in packed]))
            self._put(b"".join(packed))
            self.n_tokens += len(block)
        self.waiting, self.n_waiting = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        if self.n_waiting:
            self._flush(1)
        docs_at = self.offset
        missing = np.array([x is None for x in self.doc_ids], np.uint8)
        doc_ids = np.array([x or 0 for x in self.doc_ids], "<i8")
        self._put(self.zstd.compress(missing.tobytes() + doc_ids.tobytes() + np.array(self.lengths, "<u8").tobytes()))
        index_at = self.offset
        for offset, first, n, sizes in self.index:
            self._put(struct.pack(f"<QQI{len(sizes)}I", offset, first, n, *sizes))
        self._put(FOOTER.pack(docs_at, index_at, len(self.index), len(self.doc_ids), self.n_tokens, MAGIC))


class ShardReader:
    """Reads a shard from a seekable file."""

    def __init__(self, source, size: int):
        self.source = source
        magic, _, is_bit, self.bits, self.block = HEADER.unpack(self._at(0, HEADER.size))
        self.docs_at, self.index_at, n_blocks, self.n_docs, self.n_tokens, end = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC or end != MAGIC:
            raise ValueError("not a whole shard of token planes")
        self.kind = "bit" if is_bit else "byte"
        row = struct.Struct(f"<QQI{self.bits if is_bit else self.bits // 8}I")
        self.index = list(row.iter_unpack(self._at(self.index_at, row.size * n_blocks)))
        self.zstd = zstandard.ZstdDecompressor()

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def docs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each document's id is null, the ids, and how many token ids each document has."""
        n = self.n_docs
        raw = self.zstd.decompress(self._at(self.docs_at, self.index_at - self.docs_at), max_output_size=max(1, 17 * n))
        return np.frombuffer(raw, np.uint8, n).astype(bool), np.frombuffer(raw, "<i8", n, n), np.frombuffer(raw, "<u8", n, 9 * n)

    def blocks(self, first: int = 0) -> Iterator[tuple[int, np.ndarray]]:
        """(position of its first id, ids) of each block that reaches beyond ``first``."""
        for offset, at, n, *sizes in self.index:
            if at + n > first:
                raw, cuts = self._at(offset, sum(sizes)), np.cumsum([0, *sizes]).tolist()
                full = (n + 7) // 8 if self.kind == "bit" else n
                yield at, from_planes([self.zstd.decompress(raw[a:b], max_output_size=full) for a, b in pairwise(cuts)], n, self.bits, self.kind)

    def read(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from ``start``; only the blocks that hold them are read."""
        parts = []
        for at, ids in self.blocks(start):
            if at >= start + n:
                break
            parts.append(ids[max(0, start - at) : start + n - at])
        return np.concatenate(parts) if parts else np.zeros(0, f"<u{self.bits // 8}")


#: Units that a worker remembers (about 150 bytes each, and as many of the generation before).
UNITS = 800_000


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, *, id_col: str = "doc_id", text_col: str = "text", kind: str = "bit", block_tokens: int = 1 << 16) -> list[dict]:
    """Encode every text, append ``end_id`` and write the ids in ascending id order below ``path``, a folder that all share.

    Documents are dealt out by ranges of their id, so each task writes one shard and nothing is sorted on one machine.
    A shard appears under its name only when it is whole (written aside, then renamed), so a task can run twice.
    Returns the shards in order, with the place of their first id; the list is also kept as manifest.json. It has one
    row a shard. Null texts are empty and give only the end id; null ids come first; rows with equal ids are all
    written, in the order of their text. An empty table gives no shard.
    """
    dealt = texts(docs, id_col, text_col).withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")

    def shard(batches):
        encoder = library_encoder(tokenizer, UNITS)
        store, folder = store_of(path)
        name = f"shard-{TaskContext.get().partitionId():06d}.planes"
        aside = f"{folder}/.{name}.{uuid.uuid4().hex}"
        end, writer, first, last = np.array([end_id], encoder.code), None, None, None
        out = None
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if writer is None:
                    store.create_dir(folder, recursive=True)
                    out = store.open_output_stream(aside)
                    writer = ShardWriter(out, 8 * end.itemsize, kind, block_tokens)
                    first = doc_id
                last = doc_id
                writer.add(doc_id, np.concatenate([np.frombuffer(encoder.packed(text), encoder.code), end]))
        if writer is not None:
            writer.close()
            out.close()
            settle(store, aside, f"{folder}/{name}")
            yield pa.RecordBatch.from_pydict({"name": [name], "first_id": pa.array([first], pa.int64()), "last_id": pa.array([last], pa.int64()), "n_docs": [len(writer.doc_ids)], "n_tokens": [writer.n_tokens], "n_bytes": [writer.offset]})

    shards = [r.asDict() for r in dealt.mapInArrow(shard, "name string, first_id long, last_id long, n_docs long, n_tokens long, n_bytes long").collect()]
    start = 0
    for s in sorted(shards, key=lambda s: s["name"]):
        s["start"] = start
        start += s["n_tokens"]
    shards.sort(key=lambda s: s["name"])
    store, folder = store_of(path)
    store.create_dir(folder, recursive=True)
    with store.open_output_stream(f"{folder}/manifest.json") as f:
        f.write(json.dumps(shards).encode())
    return shards


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files below ``path``: doc_id, start, n_tokens, ids_crc32, shard."""
    store, folder = store_of(path)
    with store.open_input_stream(f"{folder}/manifest.json") as f:
        shards = json.loads(f.read())

    def read(batches):
        store, folder = store_of(path)
        for batch in batches:
            for name, start in zip(batch["name"].to_pylist(), batch["start"].to_pylist(), strict=True):
                with store.open_input_file(f"{folder}/{name}") as f:
                    reader = ShardReader(f, f.size())
                    missing, doc_ids, lengths = reader.docs()
                    crcs = _crcs(reader, lengths)
                    starts = start + np.concatenate([[0], np.cumsum(lengths.astype(np.int64))])[:-1]
                    ids = pa.array(doc_ids, mask=missing)
                    for at in range(0, len(doc_ids), 10_000):
                        cut = slice(at, at + 10_000)
                        yield pa.RecordBatch.from_arrays([ids[cut], pa.array(starts[cut], pa.int64()), pa.array(lengths[cut].astype(np.int64)), pa.array(crcs[cut], pa.int64()), pa.array([name] * len(starts[cut]))], ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    listed = spark.createDataFrame([(s["name"], s["start"]) for s in shards], "name string, start long").repartition(max(1, len(shards)))
    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard string")


def _crcs(reader: ShardReader, lengths: np.ndarray) -> np.ndarray:
    """The crc32 of each document's ids as unsigned 32-bit integers, block by block."""
    out, k, crc, left = np.zeros(len(lengths), np.int64), 0, 0, int(lengths[0]) if len(lengths) else 0
    for _, ids in reader.blocks():
        wide, at = ids.astype("<u4"), 0
        while at < len(wide):
            take = min(left, len(wide) - at)
            crc = zlib.crc32(wide[at : at + take].data, crc)
            at, left = at + take, left - take
            if not left:
                out[k], k, crc = crc, k + 1, 0
                left = int(lengths[k]) if k < len(lengths) else 0
    return out

"""Best-fit packing of documents into sequences, by rounds over a tree of partitions.

Each partition packs its own documents, longest first, each into the fullest bin that still has room. Nearly full bins
are finished; the others become items of their own for the next round, where a few partitions' bins meet and are packed
best-fit again, and so on up to the root. Only bins with room travel, as their numbers and lengths.
"""

from __future__ import annotations

import zlib
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import released, scratch, texts, written
from .unit_encoding import library_encoder

PIECE = "struct<doc_id: long, piece: int, start: long, length: int, crc: long, offset: int>"
#: What travels: bins that are finished or not, and where in them the bins lie that the partitions packed at first.
BINS = "sequence_id long, fill int, parts array<struct<bin: long, at: int>>"
FAN_IN = 8


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin of each item, its offset there, and how full each bin is.

    Bins wait by the room they have; a bitmap of the rooms that occur gives the least that is enough.
    """
    bin_of, offset, fills = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[item])
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, chosen = capacity, len(fills)
            fills.append(0)
        bin_of[item], offset[item] = chosen, capacity - room
        fills[chosen] += length
        if room > length:  # a full bin is never asked again
            by_room[room - length].append(chosen)
            rooms |= 1 << room - length
    return bin_of, offset, np.array(fills, np.int64)


def _base(level: int) -> int:
    """The first number of a task's bins: no two tasks or rounds share any."""
    return level << 58 | TaskContext.get().partitionId() << 30


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, append ``end_id`` and pack the documents into as few sequences as best fit can.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Only documents longer than
    ``capacity`` are cut, into pieces of that length and a last one that may be shorter. A null text is empty and is one
    token, the end id. Rows are documents of their own whether ids repeat or are null. An empty table gives no rows.

    A bin is finished when no bin that is left anywhere would fit into it, so the measure of nearly full is the emptiest
    bin's tokens. Rounds go on up to one partition, at any size: a task of theirs holds a number or two for each bin, the
    documents stay where the first round wrote them.
    """
    path = scratch(docs.sparkSession, "packing")
    schema = pa.schema([("sequence_id", pa.int64()), ("fill", pa.int32()), ("items", pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("crc", pa.int64()), ("offset", pa.int32())])))])

    @released()
    def encode(batches):
        encoder = library_encoder(tokenizer)
        end = np.array([end_id], encoder.code)
        base, made, rows, waiting = _base(0), 0, [], []
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = np.concatenate([np.frombuffer(encoder.packed(text), encoder.code), end]).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    cut = ids[start : start + capacity]
                    item = (doc_id, piece, start, len(cut), zlib.crc32(cut.data))
                    if len(cut) < capacity:
                        waiting.append(item)
                        continue
                    rows.append({"sequence_id": base + made, "fill": capacity, "items": [_piece(item, 0)]})
                    made += 1
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
        bin_of, offset, fills = best_fit(np.array([x[3] for x in waiting], np.int64), capacity)
        order = np.lexsort((offset, bin_of))
        cuts = np.concatenate([[0], np.cumsum(np.bincount(bin_of, minlength=len(fills)))])
        for k, fill in enumerate(fills.tolist()):
            own = order[cuts[k] : cuts[k + 1]].tolist()
            rows.append({"sequence_id": base + made + k, "fill": fill, "items": [_piece(waiting[i], int(offset[i])) for i in own]})
            if len(rows) == 5000:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, schema)

    def merge(level: int):
        @released()
        def run(batches):
            held = [b for b in batches if b.num_rows]
            if not held:
                return
            table = pa.Table.from_batches(held)
            bin_of, offset, fills = best_fit(table["fill"].to_numpy().astype(np.int64), capacity)
            parts = table["parts"].combine_chunks()
            sizes = parts.value_lengths().to_numpy()
            new, flat = np.repeat(bin_of, sizes), parts.flatten()
            at = flat.field("at").to_numpy() + np.repeat(offset, sizes)
            order = np.lexsort((at, new))
            ends = np.concatenate([[0], np.cumsum(np.bincount(new, minlength=len(fills)))])
            inner = pa.StructArray.from_arrays([flat.field("bin").take(pa.array(order)), pa.array(at[order].astype(np.int32))], ["bin", "at"])
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), inner)
            out = pa.RecordBatch.from_arrays([pa.array(_base(level) + np.arange(len(fills))), pa.array(fills.astype(np.int32)), lists], ["sequence_id", "fill", "parts"])
            for k in range(0, len(fills), 50_000):
                yield out.slice(k, 50_000)

        return run

    packed = written(texts(docs, id_col, text_col).mapInArrow(encode, f"sequence_id long, fill int, items array<{PIECE}>"), f"{path}/0")
    own = F.array(F.struct(F.col("sequence_id").alias("bin"), F.lit(0).alias("at")))
    bins = packed.select("sequence_id", "fill", own.alias("parts"))
    partitions, level, first, moved = packed.rdd.getNumPartitions(), 0, 0, None
    while True:
        least = bins.agg(F.min("fill")).first()[0]
        # a bin that the emptiest one does not fit into can't be joined to any other
        most = capacity - (least or capacity)
        open_bins = bins.where(F.col("fill") <= most)
        last = open_bins.count() < 2 or (level > 0 and partitions == 1)
        if level:
            done = bins if last else bins.where(F.col("fill") > most)
            done = done.select("sequence_id", F.explode("parts").alias("part")).select("sequence_id", F.col("part.bin").alias("bin"), F.col("part.at").alias("base"))
            moved = done if moved is None else moved.unionByName(done)
        if last:
            break
        first = first if level else most
        partitions, level = -(-partitions // FAN_IN), level + 1
        bins = written(open_bins.repartition(partitions).mapInArrow(merge(level), BINS), f"{path}/{level}")

    item = F.col("item")
    out = packed.where(F.col("fill") > first).select("sequence_id", F.lit(0).alias("base"), F.explode("items").alias("item"))
    if moved is not None:
        # the other bins of the first round: where the rounds have put them
        held = packed.where(F.col("fill") <= first).withColumnRenamed("sequence_id", "bin").join(moved, "bin")
        out = out.unionByName(held.select("sequence_id", "base", F.explode("items").alias("item")))
    return out.select(
        item.doc_id.alias("doc_id"), item.piece.alias("piece"), item.start.alias("start"), item.length.cast("long").alias("length"), item.crc.alias("ids_crc32"),
        "sequence_id", (item.offset + F.col("base")).cast("long").alias("offset"),
    )


def _piece(item: tuple, offset: int) -> dict:
    return dict(zip(("doc_id", "piece", "start", "length", "crc"), item, strict=True), offset=offset)

"""Near-duplicates by SimHash and multi-index hashing.

A fingerprint bit is 1 if it is set in over half the hashes of a text's word shingles. Fingerprints that differ in few
bits are found through tables on their segments: with two segments and at most r differing bits, either the first
differs in at most r // 2 bits or the second in at most (r - 1) // 2. The small Hamming balls around each segment are
enumerated and matched by equality; then the complete distance is verified. Where two fingerprints may differ by two
bits in a segment, both enumerate the ball of one bit, which costs 33 keys each instead of 529.

Equal fingerprints are one node, so copies cost nothing, and the members of one table entry are linked by a spanning
forest: links that would only join what is joined already are not emitted, and no pair of a large group need be.

Wide fingerprints only find candidates: nodes are equal sets of shingles, the tables join all that are loosely near, and
within each group so joined the Jaccard similarity of the whole sets decides each link. As Hamming balls that hold all
links of a similarity of 0.8 would be far too large, the tables also hold the rarest shingles of each set, for the rest.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fresh, join_few, located, released, scratch, sieved, slices, texts, without_places, written
from .components import components

SEED = 42
#: Steps of the public splitmix64 generator, which spread a hash over more bits.
GAMMA, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Low bits of a shingle hash by which similar looks for sets that may share enough.
LOW = (1 << 20) - 1
#: Bits of a segment of wide fingerprints.
SEGMENT = 24
#: Buckets (bits) in which shingles are counted, for prefixes to begin with rare ones.
LOAD_BITS = 18
#: Key of a prefix: negative, as those of segments never are.
PREFIX = np.int64(-(1 << 63))
#: Shares of bits in which prints may differ to be candidates: where segments meet, and where prefixes do.
NEAR, FAR = 0.235, 0.35


def shingle_hashes(text: str, n: int) -> np.ndarray:
    """XXH64 of each run of ``n`` words, repeats included; of all words if there are fewer; none without words.

    bytes.lower and bytes.split know ASCII letters and the white space \\x20 \\x09-\\x0D only, as is wanted.
    """
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= n:
        return np.array([hashed(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - n + 1]
    return np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[n - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def widened(hashes: np.ndarray, words: int) -> np.ndarray:
    """Each hash as so many 64-bit words: itself, then mixed values of it."""
    out = [hashes]
    with np.errstate(over="ignore"):
        for k in range(1, words):
            x = hashes + np.uint64(GAMMA * k & (1 << 64) - 1)
            x = (x ^ x >> np.uint64(30)) * np.uint64(MIX_1)
            x = (x ^ x >> np.uint64(27)) * np.uint64(MIX_2)
            out.append(x ^ x >> np.uint64(31))
    return np.stack(out, axis=1)


def bit_votes(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """Per bit, lowest first: twice the hashes that have it set, less all hashes."""
    total = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), 255 * 64):
        part = widened(hashes[at : at + 255 * 64], words).astype("<u8").view(np.uint8).reshape(-1, 8 * words)
        bits = np.unpackbits(part, axis=1, bitorder="little")
        for k in range(0, len(bits), 255):
            total += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return 2 * total - len(hashes)


def forest(prints: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges (row, row of its tree's root) of a spanning forest of the rows within ``most`` bits, for rows of uint64 words.

    Each found row only asks the rows that no tree has yet, so a dense group of any size costs little more than its size.
    """
    left, edges = np.arange(len(prints)), []
    while len(left) > 1:
        root, left = int(left[0]), left[1:]
        waiting = [root]
        while waiting and len(left):
            row = waiting.pop()
            near = np.bitwise_count(prints[left] ^ prints[row]).sum(axis=1) <= most
            if near.any():
                new = left[near].tolist()
                edges += [(x, root) for x in new]
                waiting += new
                left = left[~near]
    return edges


def similar(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Edges (row, row of its tree's root) of a spanning forest of distinct sets with a Jaccard similarity of ``least``.

    As in forest, each found set only asks those that no tree has yet: by shared low bits of the hashes, which are never
    fewer than the shared hashes, then exactly.
    """
    sizes = np.array([len(s) for s in sets])
    left, edges, mark = np.flatnonzero(sizes), [], np.zeros(LOW + 1, bool)
    lows = [(s & np.uint64(LOW)).astype(np.uint32) for s in sets]
    flat = np.concatenate([np.zeros(0, np.uint32), *lows])
    while len(left) > 1:
        root, left, flat = int(left[0]), left[1:], flat[sizes[left[0]] :]
        waiting = [root]
        while waiting and len(left):
            row = waiting.pop()
            mark[lows[row]] = True
            shared = np.add.reduceat(mark[flat], np.cumsum(sizes[left]) - sizes[left], dtype=np.int64)
            mark[lows[row]] = False
            near = shared >= least * (sizes[row] + sizes[left] - shared)
            for k in np.flatnonzero(near).tolist():
                both = len(np.intersect1d(sets[row], sets[left[k]], assume_unique=True))
                near[k] = both >= least * (sizes[row] + sizes[left[k]] - both)
            if near.any():
                new = left[near].tolist()
                edges += [(x, root) for x in new]
                waiting += new
                flat, left = flat[np.repeat(~near, sizes[left])], left[~near]
    return edges


def _verified(least: float):
    """For batches sorted by group: the links of each group's sets, as (a, b) node ids."""

    def runs(table: pa.Table):
        group = table["group"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
        a, b = [], []
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            own = dict(zip(table["node"][s:e].to_pylist(), table["shingles"][s:e].to_pylist(), strict=True))
            node = list(own)
            for x, y in similar([np.frombuffer(v, "<u8") for v in own.values()], least):
                a.append(node[x])
                b.append(node[y])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return _by_run("group", runs)


def _linked(most: int, far: int):
    """For batches (key, print) sorted by both: the forests of each run of equal keys, as (a, b) ids of prints within ``most`` bits, or ``far`` where the key is a prefix."""
    return _by_run("key", lambda table: _runs(table, most, far))


def print_ids(prints: np.ndarray) -> np.ndarray:
    """A long for each print (a row of uint64 words): one of 64 bits itself, else its XXH64, as the engine has it."""
    if prints.shape[1] == 1:
        return prints[:, 0].view(np.int64)
    return np.array([xxhash.xxh64_intdigest(p.tobytes(), SEED) for p in prints], np.uint64).view(np.int64)


def _by_run(column: str, runs):
    """A function over batches sorted by ``column`` that hands ``runs`` whole runs of equal values."""

    @released()
    def link(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            key = table[column].to_numpy()
            if len(key):
                other = np.flatnonzero(key != key[-1])
                last = int(other[-1]) + 1 if len(other) else 0
                held = table.slice(last)
                if last:
                    yield from runs(table.slice(0, last))
        if held is not None:
            yield from runs(held)

    return link


def _runs(table: pa.Table, most: int, far: int):
    if not table.num_rows:
        return
    key = table["key"].to_numpy()
    cuts = np.flatnonzero(np.diff(key)) + 1
    sizes = np.diff(np.concatenate([[0], cuts, [len(key)]]))
    shared = np.repeat(sizes > 1, sizes)
    if not shared.any():
        return
    starts = np.concatenate([[0], np.cumsum(sizes[sizes > 1])])
    prints = np.frombuffer(b"".join(table["print"].filter(pa.array(shared)).to_pylist()), "<u8").reshape(starts[-1], -1)
    two = starts[:-1][np.diff(starts) == 2]
    limit = np.where(key[shared] < 0, far, most)
    near = two[np.bitwise_count(prints[two] ^ prints[two + 1]).sum(axis=1) <= limit[two]]
    a, b = [near], [near + 1]
    for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if e - s > 2 and (edges := forest(prints[s:e], limit[s])):
            pairs = np.array(edges) + s
            a.append(pairs[:, 0])
            b.append(pairs[:, 1])
    a, b = np.concatenate(a), np.concatenate(b)
    yield pa.RecordBatch.from_arrays([pa.array(print_ids(prints[a])), pa.array(print_ids(prints[b]))], ["a", "b"])


def loads(rows: DataFrame, shingle: int) -> np.ndarray:
    """How many texts have a shingle in each bucket, counting each distinct one: a table of fixed size."""

    @released()
    def count(batches):
        total = np.zeros(1 << LOAD_BITS, np.int64)
        for batch in slices(batches):
            for text in batch["text"].to_pylist():
                total += np.bincount((np.unique(shingle_hashes(text, shingle)) >> np.uint64(64 - LOAD_BITS)).astype(np.int64), minlength=len(total))
        bucket = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(total[bucket])], ["bucket", "n"])

    counts = rows.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << LOAD_BITS, np.int64)
    out[counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    return out


def fingerprints(rows: DataFrame, shingle: int, words: int = 1, probes: int = 0, least: float | None = None) -> DataFrame:
    """(doc_id, at, print, node, keys) of ``rows`` (doc_id, text, at); ``print`` is 8 * words bytes, little-endian, zero for a text without words.

    ``node`` is a 64-bit print as a long. Wider prints are of distinct shingles, and ``node`` is a hash of their set.
    ``keys`` holds the ``probes`` least certain bits (nearest to half the votes) of each segment, a byte each, and with
    ``least`` the prefix of the set, see prefix. Equal nodes have equal keys.
    """

    load = rows.sparkSession.sparkContext.broadcast(loads(rows, shingle)) if least is not None else None

    @released()
    def make(batches):
        for batch in slices(batches):
            hashes = [shingle_hashes(t, shingle) for t in batch["text"].to_pylist()]
            if words > 1:
                hashes = [np.unique(h) for h in hashes]
            votes = np.stack([bit_votes(h, words) for h in hashes])
            prints = np.packbits(votes > 0, axis=1, bitorder="little")
            node = prints.view("<i8")[:, 0] if words == 1 else np.array([set_node(h) for h in hashes], np.int64)
            keys = [f.tobytes() for f in uncertain(votes, probes)] if probes else [b""] * len(hashes)
            if least is not None:
                keys = [k + prefix(h, least, load.value).tobytes() for k, h in zip(keys, hashes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["at"], pa.array([p.tobytes() for p in prints], pa.binary()), pa.array(node, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "at", "print", "node", "keys"])

    return rows.mapInArrow(make, f"doc_id long, at {rows.schema['at'].dataType.simpleString()}, print binary, node long, keys binary")


def prefix(hashes: np.ndarray, least: float, load: np.ndarray) -> np.ndarray:
    """The hashes of a sorted set whose buckets have the least load: so many that any set with a similarity of ``least`` to it has one of them in its own prefix.

    That holds for any order that is the same for all sets; this one keeps what very many texts share for the end.
    """
    if not len(hashes):
        return hashes.astype("<u8")
    order = np.lexsort((hashes, load[(hashes >> np.uint64(64 - LOAD_BITS)).astype(np.int64)]))
    return hashes[order[: len(hashes) - math.ceil(least * len(hashes) - 1e-9) + 1]].astype("<u8")


def set_node(hashes: np.ndarray) -> int:
    """A signed 64-bit hash of a sorted set of hashes."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes())).astype(np.int64))


def shingle_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of every whole text: its sorted distinct shingle hashes, 8 bytes each, little-endian."""

    @released()
    def make(batches):
        for batch in slices(batches):
            sets = [np.unique(shingle_hashes(t, shingle)) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_node(h) for h in sets], pa.int64()), pa.array([h.astype("<u8").tobytes() for h in sets], pa.binary())], ["node", "shingles"])

    return rows.select("text").mapInArrow(make, "node long, shingles binary")


def uncertain(votes: np.ndarray, probes: int) -> np.ndarray:
    """For each text and segment the places of its ``probes`` least certain bits."""
    own = np.abs(votes[:, : votes.shape[1] // SEGMENT * SEGMENT]).reshape(len(votes), -1, SEGMENT)
    return np.argsort(own, axis=2, kind="stable")[:, :, :probes].astype(np.uint8)


def probed(prints: np.ndarray, flips: np.ndarray) -> np.ndarray:
    """The table keys of each print (bytes): every segment as it is, and with one or two of its ``flips`` flipped."""
    bits = np.unpackbits(prints, axis=1, bitorder="little")
    n, segments, probes = flips.shape
    own = bits[:, : segments * SEGMENT].reshape(n, segments, SEGMENT) @ (1 << np.arange(SEGMENT, dtype=np.int64)) | np.arange(segments, dtype=np.int64) << SEGMENT
    flip = 1 << flips.astype(np.int64)
    one = [own ^ flip[:, :, i] for i in range(probes)]
    two = [own ^ flip[:, :, i] ^ flip[:, :, j] for i in range(probes) for j in range(i)]
    return np.concatenate([own, *one, *two], axis=1)


def _table_keys(nodes: DataFrame, words: int, probes: int) -> DataFrame:
    """(key, print) of wide fingerprints: probed keys, and what else ``keys`` has, as keys apart from those."""
    segments = 64 * words // SEGMENT

    @released()
    def make(batches):
        for batch in slices(batches, 256):
            if not batch.num_rows:
                continue
            own, held = batch["print"].to_pylist(), batch["keys"].to_pylist()
            cut = segments * probes
            keys = probed(np.frombuffer(b"".join(own), np.uint8).reshape(len(own), -1), np.frombuffer(b"".join(k[:cut] for k in held), np.uint8).reshape(len(own), segments, probes))
            more = [np.frombuffer(k[cut:], "<i8") | PREFIX for k in held]
            sizes = np.array([keys.shape[1] + len(m) for m in more])
            flat = np.concatenate([x for k, m in zip(keys, more, strict=True) for x in (k, m)])
            row = pa.array(np.repeat(np.arange(len(own)), sizes))
            yield pa.RecordBatch.from_arrays([pa.array(flat), batch["print"].take(row)], ["key", "print"])

    return nodes.select("print", "keys").mapInArrow(make, "key long, print binary")


def _ball_keys(nodes: DataFrame) -> DataFrame:
    """Table keys of 64-bit fingerprints: for each of two segments, it and all that differ from it in one bit."""
    one = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    high, low = F.shiftrightunsigned("node", 32), F.col("node").bitwiseAND(F.lit((1 << 32) - 1))
    ball = lambda seg, table: F.transform(F.sequence(F.lit(-1), F.lit(31)), lambda i: F.when(i < 0, seg).otherwise(seg.bitwiseXOR(one(F.greatest(i, F.lit(0))))).bitwiseXOR(F.lit(table << 32)))
    return nodes.select(F.explode(F.concat(ball(high, 0), ball(low, 1))).alias("key"), "print")


def contracted(edges: DataFrame) -> DataFrame:
    """Fewer edges of the same components: each node keeps its smallest neighbour, which its other smaller ones are linked to.

    The forests link a node once a table key at most, so what is collected of a node is no longer than its keys.
    """
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    own = down.groupBy("a").agg(F.min("b").alias("b"), F.collect_set("b").alias("others"))
    return own.select(F.explode(F.array_append("others", F.col("a"))).alias("a"), "b").where("a != b").distinct()


def groups(docs: DataFrame, shingle: int = 5, most: int | None = None, words: int = 4, probes: int = 2, least: float = 0.8, complete: bool = True, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (hex) and component_id, the smallest id of the rows linked directly or through others.

    With ``words`` of 1, fingerprints have 64 bits and link at ``most`` (two to four) differing bits; every such link is
    found. With more, texts link where the Jaccard similarity of their whole shingle sets is ``least`` or more. Fingerprints
    of 64 bits a word find the candidates: tables probe the uncertain bits of 24-bit segments and keep what differs in at
    most ``most`` bits, by default far more than a similarity of 0.8 gives; a link is found with a chance (README), which
    rises with ``probes``. With ``complete`` the tables also hold each set's prefix, its rarest shingles, of which any two
    sets that link share one; what then differs in 35 % of the bits or less, eight standard deviations beyond a similarity
    of 0.8, is a candidate too. So no link is lost. One task holds the sets of one group of candidates.

    Texts are whole; a null text is empty, and texts without words share the zero fingerprint, linked like any other.
    Equal rows count once each; a null id stays null and belongs to its text's component, of which it is never the
    smallest id unless all are null. An empty table gives no rows; other columns of ``docs`` don't matter.
    """
    rows = texts(docs, id_col, text_col).withColumn("at", F.lit(0))
    return _groups(rows, shingle, most, words, probes, least, complete).select("doc_id", "fingerprint", "component_id")


def _groups(rows: DataFrame, shingle: int = 5, most: int | None = None, words: int = 4, probes: int = 2, least: float = 0.8, complete: bool = True) -> DataFrame:
    """groups of ``rows`` (doc_id, text, at), with at and first: the least (missing, doc_id, at) of the component."""
    path = scratch(rows.sparkSession, "simhash")
    exact = words == 1
    most = (4 if exact else round(NEAR * 64 * words)) if most is None else most
    if exact and not 0 <= most <= 4:
        raise ValueError("the two-segment tables hold links of at most four differing bits")
    prints = written(fingerprints(rows, shingle, words, 0 if exact else probes, least if complete and not exact else None), f"{path}/prints")
    own = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "at")
    nodes = prints.groupBy("node", "print").agg(F.min(own).alias("least"), F.count("*").alias("copies"), F.first("keys").alias("keys"))
    nodes = written(nodes.withColumn("id", F.col("node") if exact else F.xxhash64("print")), f"{path}/nodes")
    keyed = _ball_keys(nodes) if exact else _table_keys(nodes, words, probes)
    edges = keyed.repartition("key").sortWithinPartitions("key", "print").mapInArrow(_linked(most, round(FAR * 64 * words)), "a long, b long").distinct()
    if not exact:
        # the sets whose prints are near to another one's or the same
        met = components(contracted(edges)).select(F.col("node").alias("id"), "component")
        same = nodes.groupBy("id").agg(F.count("*").alias("n"))
        group = same.join(met, "id", "left").where("n > 1 OR component IS NOT NULL").select("id", F.coalesce("component", "id").alias("group"))
        near = written(nodes.select("node", "id").join(group, "id").select("node", "group"), f"{path}/near")
        held = sieved(shingle_sets(rows, shingle), F.xxhash64("node"), near, F.xxhash64("node"), near.count(), "near").where("near").join(near, "node")
        edges = held.repartition("group").sortWithinPartitions("group", "node").mapInArrow(_verified(least), "a long, b long")
    joined = nodes.select("node", "print", "least", "copies").join(components(edges), "node", "left")
    of_node = written(joined.select("node", "print", "least", "copies", F.coalesce("component", "node").alias("component")), f"{path}/of-node")
    smallest = written(of_node.groupBy("component").agg(F.min("least").alias("first"), F.count("*").alias("n")), f"{path}/smallest")
    named = written(join_few(of_node.select("node", "print", "copies", "component"), smallest, ["component"], "n").select("node", "print", "copies", "first"), f"{path}/named")
    digits = F.concat(*(F.hex(F.substring("print", k, 1)) for k in range(8 * words, 0, -1)))
    found = join_few(prints.select("doc_id", "at", "node", "print"), named, ["node", "print"], "copies")
    return found.select("doc_id", F.lower(digits).alias("fingerprint"), F.col("first.doc_id").alias("component_id"), "at", "first")


def without_near_copies(docs: DataFrame, complete: bool = True, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one row of each component, the first by id, then by place.

    Rows are told apart by the file and row of their content, so ids may repeat or be null (a null id is never first
    unless all are null), and of equal rows one stays. Cases else as in groups; columns may have any names.
    """
    path, (place,) = scratch(docs.sparkSession, "near"), fresh(docs.columns, "at")
    rows = located(docs, f"{path}/docs", place)
    dropped = written(_groups(texts(rows, id_col, text_col, place), complete=complete).where("at != first.at").select(F.col("at").alias(place)), f"{path}/dropped")
    return without_places(rows, dropped, place).select(*docs.columns)

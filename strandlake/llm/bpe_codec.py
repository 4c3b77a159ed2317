"""Byte-level BPE encoding and decoding by a queue over merge ranks.

A pre-token's bytes form a linked list. Each neighbouring pair that is a token waits in the bucket of its rank; a
two-level bitmap says which buckets hold anything, and find-first-set gives the lowest such rank. Within a bucket, a heap
once it is begun, the leftmost position is next. A merge changes the two pairs beside it; their old entries stay and are skipped when they
come up, as they no longer state the pair's rank. The time is nearly linear in the pre-tokens' length, where a search
of all pairs before each merge would be quadratic. Pre-tokens seen before are remembered, within bounds.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import texts
from .unit_encoding import WORD, BatchMemory, plain_units

WORD_BITS = 8


class RankFile:
    """Ranks of tokens, with those of all pairs of bytes as a table."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.of_pair = np.full(1 << 16, -1, np.int32)
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.of_pair[token[0] << 8 | token[1]] = rank


def merge(pieces: list[bytes], file: RankFile) -> list[list[int]]:
    """The token ids of each pre-token. One queue serves all of them; no pair reaches over a pre-token's end."""
    if not pieces:
        return []
    data, get, low_bits = b"".join(pieces), file.ranks.get, (1 << WORD_BITS) - 1
    n, sizes = len(data), np.fromiter(map(len, pieces), np.int64, len(pieces))
    stops = np.cumsum(sizes)
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    pairs = np.full(n, -1, np.int64)
    pairs[:-1] = file.of_pair[raw[:-1] << 8 | raw[1:]]
    pairs[stops[sizes > 0] - 1] = -1
    first = np.arange(-1, n)
    first[(stops - sizes)[sizes > 0]] = -1
    after, before, stated, end = list(range(1, n + 2)), first.tolist(), pairs.tolist(), np.repeat(stops, sizes).tolist()

    top, words, buckets, begun = 0, {}, {}, set()  # ``begun``: ranks of buckets that are heaps already
    held = np.flatnonzero(pairs >= 0)
    held = held[np.argsort(pairs[held], kind="stable")]
    ranks, cuts = np.unique(pairs[held], return_index=True)
    for rank, positions in zip(ranks.tolist(), np.split(held, cuts[1:]), strict=False):
        buckets[rank] = positions.tolist()
        words[rank >> WORD_BITS] = words.get(rank >> WORD_BITS, 0) | 1 << (rank & low_bits)
        top |= 1 << (rank >> WORD_BITS)

    while top:
        word = (top & -top).bit_length() - 1
        bits = words[word]
        low = bits & -bits
        rank = (word << WORD_BITS) + low.bit_length() - 1
        words[word] = bits = bits ^ low
        if not bits:
            top ^= 1 << word
        bucket = buckets.pop(rank)
        if rank in begun:
            begun.discard(rank)
        else:
            heapify(bucket)
        while bucket:
            i = heappop(bucket)
            if stated[i] != rank:
                continue
            j = after[i]
            after[i] = k = after[j]
            stated[i] = stated[j] = -1
            least = rank
            if k < end[i]:
                before[k] = i
                made = get(data[i : after[k]])
                if made is not None:
                    stated[i] = made
                    if made in begun:
                        heappush(buckets[made], i)
                    elif made in buckets:
                        buckets[made].append(i)
                    else:
                        buckets[made] = [i]
                        word = made >> WORD_BITS
                        words[word] = words.get(word, 0) | 1 << (made & low_bits)
                        top |= 1 << word
                    least = min(least, made)
            h = before[i]
            if h >= 0:
                made = get(data[h:k])
                if made is None:
                    stated[h] = -1
                else:
                    stated[h] = made
                    if made in begun:
                        heappush(buckets[made], h)
                    elif made in buckets:
                        buckets[made].append(h)
                    else:
                        buckets[made] = [h]
                        word = made >> WORD_BITS
                        words[word] = words.get(word, 0) | 1 << (made & low_bits)
                        top |= 1 << word
                    least = min(least, made)
            if least < rank and bucket:  # a lower rank has come up: it is next
                buckets[rank] = bucket
                begun.add(rank)
                word = rank >> WORD_BITS
                words[word] = words.get(word, 0) | 1 << (rank & low_bits)
                top |= 1 << word
                break

    out, i = [], 0
    for stop in stops.tolist():
        ids = []
        while i < stop:
            ids.append(file.ranks[data[i : after[i]]])
            i = after[i]
        out.append(ids)
    return out


class ByteBpe:
    """encode and decode by a rank file (base64 token, space, rank on each line) and a pre-token pattern.

    ``by_units`` says that the pattern ends a pre-token wherever a space or newline follows a non-space, and that a word
    of one case is a pre-token with the space before it: texts are then looked up by such units. Any pattern may go without.
    """

    def __init__(self, path: str, pattern: str, by_units: bool = False):
        import regex

        self.file = RankFile(path)
        self.tokens = {i: t for t, i in self.file.ranks.items()}
        self.code = "H" if max(self.tokens) < 1 << 16 else "I"
        self.pre_tokens = regex.compile(pattern).findall
        self.units_of = plain_units if by_units else lambda text: None
        self.pieces = BatchMemory(self._pieces)
        self.units = BatchMemory(self._units)

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        data = [p.encode() for p in pieces]
        whole = [self.file.ranks.get(d) for d in data]
        merged = iter(merge([d for d, r in zip(data, whole, strict=True) if r is None], self.file))
        return [array(self.code, next(merged) if r is None else [r]).tobytes() for r in whole]

    def _units(self, units: list[str]) -> list[bytes]:
        split = [[" " + m[1], m[2]] if (m := WORD.fullmatch(u)) else self.pre_tokens(u if u[:1] == "\n" else " " + u) for u in units]
        ids = self.pieces.of({p for s in split for p in s})
        ids[""] = b""
        return [b"".join(map(ids.__getitem__, s)) for s in split]

    def encode(self, texts: list[str]) -> list[array]:
        """The ids of each text."""
        units = [self.units_of(t) if t else None for t in texts]
        firsts = [self.pre_tokens(t if u is None else u[0]) for t, u in zip(texts, units, strict=True)]
        pieces = self.pieces.of({p for f in firsts for p in f})
        known = self.units.of({u for us in units if us for u in us[1:]})
        out = []
        for f, us in zip(firsts, units, strict=True):
            ids = array(self.code)
            ids.frombytes(b"".join(map(pieces.__getitem__, f)))
            if us:
                ids.frombytes(b"".join(map(known.__getitem__, us[1:])))
            out.append(ids)
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def batches_of(texts: list[str], chars: int = 4_000_000):
    """Slices of ``texts`` of about so many characters, or one text."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield slice(at, k + 1)
            at, size = k + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str, by_units: bool) -> ByteBpe:
    return ByteBpe(path, pattern, by_units)


def encode_documents(docs: DataFrame, ranks: str, pattern: str, *, by_units: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every whole text. A null text is empty and has no ids; ids may repeat or be null."""

    def encode(batches):
        bpe = byte_bpe(ranks, pattern, by_units)
        for batch in batches:
            each = batch["text"].to_pylist()
            ids = [x for cut in batches_of(each) for x in bpe.encode(each[cut])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return texts(docs, id_col, text_col).mapInArrow(encode, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, ranks: str, pattern: str, *, by_units: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode the ids again, giving digests instead of the ids: doc_id, n_tokens, ids_sha256, decoded_sha256.

    One narrow pass: nothing is shuffled, and a task holds one batch of texts. Nulls as in encode_documents.
    """

    def digests(batches):
        bpe = byte_bpe(ranks, pattern, by_units)
        shown = {i: str(i) for i in bpe.tokens}.__getitem__
        for batch in batches:
            n, of_ids, of_bytes = [], [], []
            each = batch["text"].to_pylist()
            for ids in (x.tolist() for cut in batches_of(each) for x in bpe.encode(each[cut])):
                n.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join(map(shown, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs, id_col, text_col).mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

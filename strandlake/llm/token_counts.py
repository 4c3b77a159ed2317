"""Token counts by a tokenizer compiled to a deterministic transducer.

BPE never needs to look back further than its longest piece: the encoding of each prefix of a text ends in exactly one
piece that is compatible with the piece before it (two pieces are compatible if BPE of their joint text gives them
back). So a machine that knows, for the few last places where a piece could still begin, the piece that ends there and
how many tokens there were, can read one more character and say by how much the count changes. These finite states are
built when they are first reached, and each transition is annotated with the change of the count.

A space after a non-space, or a newline where no piece has one, puts the machine into the same state whatever came
before. So a chunk's map (entry state -> exit state, count) is constant but for its head, the characters before the
first such place. The head is run from all states that could be the entry, as far as the text before it tells; tracks
that meet go on as one. A state that was not among them joins the map when it is asked for. Maps compose associatively:
a text's chunks are scanned in parallel-prefix order, and the prefix maps, applied to the start state, are the counts at
each chunk's end. The stretches between such places, which always begin in the start state, are remembered.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import texts
from .unit_encoding import UnitMemory

SPACE = "▁"
BPE_MODEL, MAX_STATES, MAX_PAIRS = 2, 200_000, 500_000
#: Characters of a chunk, and chunks that are scanned together; between such groups the states are bounded again.
CHUNK, GROUP = 1 << 14, 16
#: Entry states that a chunk's head is run from at once.
TRACKS = 8


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The (number, value) fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            value, at, shift = value | (byte & 127) << shift, at + 1, shift + 7
            if byte < 128:
                return value

    while at < len(data):
        number, wire = divmod(varint(), 8)
        if wire == 0:
            yield number, varint()
        else:
            size = {1: 8, 5: 4}.get(wire) or varint()
            yield number, data[at : at + size]
            at += size


class Chunk(NamedTuple):
    """A chunk's state map: ``known`` entry state -> (state, count) after ``head``; ``rest`` is (exit, count) of what follows, which no entry state changes, or None where nothing does.

    ``parts`` are the two chunks that were composed to this one; a single chunk has none.
    """

    head: str
    known: dict[int, tuple[int, int]]
    rest: tuple[int, int] | None
    parts: tuple[Chunk, Chunk] | None = None


class CountingTransducer:
    """Counts a SentencePiece BPE model's tokens."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            parts = {n: v for n, v in _fields(f.read()) if n in (2, 3)}
        trainer, normal = dict(_fields(parts.get(2, b""))), dict(_fields(parts.get(3, b"")))
        if trainer.get(3) != BPE_MODEL or not trainer.get(35) or normal.get(2) or normal.get(4, 1) or not normal.get(3, 1) or not normal.get(5, 1):
            raise ValueError("only BPE models with byte fallback and no normalisation but a leading space can be compiled")
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.scores = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in self.scores):
            raise ValueError("a piece has a space after another character")
        self.longest = max(map(len, self.scores))
        self.begun = {p[:k] for p in self.scores for k in range(1, len(p))}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.alone: dict[str, bool] = {}
        self.forget()
        self.units = UnitMemory(lambda unit: self.run(self.start, unit)[1])
        # stretches that begin in the start state: a run of spaces after another character, or of newlines that no piece has
        stops = "\n" * (not any("\n" in p for p in self.scores))
        self.stretches = re.compile(f"{SPACE}+[^{SPACE}{stops}]*" + f"|{stops}+[^{SPACE}{stops}]*" * bool(stops)).findall

    def forget(self) -> None:
        """Drop the states built so far; the start state is 0 again."""
        self.states: list[tuple] = []
        self.steps: list[dict[str, tuple[int, int]]] = []
        self.known: dict[tuple, int] = {}
        self.with_suffix: dict[str, list[int]] = {}
        self.start = self._state(("", (("", 0),)))

    def _state(self, key: tuple) -> int:
        if key not in self.known:
            self.known[key] = len(self.states)
            self.with_suffix.setdefault(key[0], []).append(len(self.states))
            self.states.append(key)
            self.steps.append({})
        return self.known[key]

    def _merged(self, text: str) -> list[str]:
        """BPE of a short text of known characters: the best-scored pair merges first, the leftmost of equals."""
        parts = list(text)
        while True:
            best = max(((self.scores[p], -i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in self.scores), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _fits(self, left: str, piece: str) -> bool:
        if not left:
            if piece not in self.alone:
                self.alone[piece] = self._merged(piece) == [piece]
            return self.alone[piece]
        key = (left, piece)
        if key not in self.pairs:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            self.pairs[key] = self._fits("", piece) and self._merged(left + piece) == [left, piece]
        return self.pairs[key]

    def _step(self, state: int, char: str) -> tuple[int, int]:
        """The next state and the change of the count; built once for each state and character.

        A state is the longest suffix read that begins a piece, and for each place in it, from its begin to its end,
        the piece that ends there (None where no piece can begin) and the count there less the count at its end.
        """
        if char not in self.scores:
            return self.start, len(char.encode())
        suffix, ends = self.states[state]
        if char == SPACE and suffix.strip(SPACE) + ends[-1][0].strip(SPACE):
            suffix, ends = "", (("", 0),)
        window, begun = suffix + char, self.begun
        tails = [window[k:] for k in range(len(window))]
        for piece, end in zip(tails, ends, strict=True):
            if end is not None and piece in self.scores and self._fits(end[0], piece):
                delta = end[1] + 1
                break
        else:
            raise AssertionError(f"no piece ends at {window!r}")
        places = [None if t not in begun else (e[0], e[1] - delta) for t, e in zip(tails, ends, strict=True)]
        keep = next((k for k, p in enumerate(places) if p), len(window))
        return self._state((window[keep:], (*places[keep:], (piece, 0)))), delta

    def run(self, state: int, text: str) -> tuple[int, int]:
        """The state after ``text`` and the tokens that it adds."""
        steps, count = self.steps, 0
        for char in text:
            to = steps[state].get(char)
            if to is None:
                to = self._step(state, char)
                steps[state][char] = to
            state = to[0]
            count += to[1]
        return state, count

    def tracks(self, states: list[int], text: str) -> dict[int, tuple[int, int]]:
        """run from each of ``states``; tracks that come to the same state go on as one."""
        at, count = list(dict.fromkeys(states)), [0] * len(set(states))
        leads = {s: (k, 0) for k, s in enumerate(at)}  # state -> its track, and the count by which it is ahead
        live, place = list(range(len(at))), 0
        while len(live) > 1 and place < len(text):
            met: dict[int, int] = {}
            for k in live:
                at[k], more = self.run(at[k], text[place])
                count[k] += more
                met.setdefault(at[k], k)
            if len(met) < len(live):
                for s, (k, ahead) in leads.items():
                    if (other := met[at[k]]) != k:
                        leads[s] = other, ahead + count[k] - count[other]
                live = sorted(met.values())
            place += 1
        if live and place < len(text):
            at[live[0]], more = self.run(at[live[0]], text[place:])
            count[live[0]] += more
        return {s: (at[k], count[k] + ahead) for s, (k, ahead) in leads.items()}

    def chunk(self, text: str, before: str | None = "") -> Chunk:
        """The map of a chunk after the characters ``before`` (the last of what precedes it; None at a text's begin)."""
        stretches = self.stretches(text)
        cut = len(text) - sum(map(len, stretches))
        if stretches and not cut and before is not None and text[0] == SPACE:
            # spaces that may follow on others: they belong to the head
            cut, stretches = len(stretches[0]), stretches[1:]
        head, rest = text[:cut], None
        if stretches:
            state, last = self.run(self.start, stretches[-1])
            rest = state, sum(map(self.units.__getitem__, stretches[:-1])) + last
        if before is None:
            entries = [self.start]
        else:
            guess = self.run(self.start, before)[0]
            entries = [guess, *(s for s in self.with_suffix[self.states[guess][0]][: TRACKS - 1] if s != guess)]
        return Chunk(head, self.tracks(entries, head), rest)

    def apply(self, chunk: Chunk, state: int) -> tuple[int, int]:
        """The exit state and the count of ``chunk`` entered in ``state``."""
        if state not in chunk.known:
            if chunk.parts:
                middle, first = self.apply(chunk.parts[0], state)
                to, second = self.apply(chunk.parts[1], middle)
                chunk.known[state] = to, first + second
            else:
                chunk.known[state] = self.run(state, chunk.head)
        to, count = chunk.known[state]
        return (to, count) if chunk.rest is None else (chunk.rest[0], count + chunk.rest[1])

    def compose(self, left: Chunk, right: Chunk) -> Chunk:
        """The map of ``left`` followed by ``right``, for the entry states that left's map has."""
        known = {}
        for state in left.known:
            middle, first = self.apply(left, state)
            to, second = self.apply(right, middle)
            known[state] = to, first + second
        return Chunk("", known, None, (left, right))

    def scan(self, maps: list[Chunk]) -> list[Chunk]:
        """The composed map of each prefix of ``maps``: pairs compose first, then pairs of pairs."""
        if len(maps) < 2:
            return maps
        pairs = self.scan([self.compose(a, b) for a, b in zip(maps[::2], maps[1::2], strict=False)])
        out = [maps[0]]
        for k in range(1, len(maps)):
            out.append(pairs[k // 2] if k % 2 else self.compose(pairs[k // 2 - 1], maps[k]))
        return out

    def prefix_counts(self, text: str, chunk_chars: int = CHUNK) -> list[int]:
        """How many tokens the machine has counted at the end of each chunk of a whole text; the last is the text's count.

        A piece that goes on into the next chunk is counted as it stands, which the next chunk's count corrects.
        """
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        starts, out, state, total = range(0, len(text), chunk_chars), [], self.start, 0
        for group in range(0, len(starts), GROUP):
            if len(self.states) > MAX_STATES:
                own = self.states[state]
                self.forget()
                state = self._state(own)
            maps = [self.chunk(text[k : k + chunk_chars], text[max(0, k - 2 * self.longest) : k] if k else None) for k in starts[group : group + GROUP]]
            ends = [self.apply(m, state) for m in self.scan(maps)]
            out += [total + count for _, count in ends]
            state, total = ends[-1][0], out[-1]
        return out

    def count(self, text: str, chunk_chars: int = CHUNK) -> int:
        """The tokens of a whole text."""
        return self.prefix_counts(text, chunk_chars)[-1] if text else 0


@functools.lru_cache(maxsize=2)
def transducer(path: str) -> CountingTransducer:
    return CountingTransducer(path)


def token_counts(docs: DataFrame, model: str, limit: int = 4096, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every whole text.

    One narrow pass without a shuffle. A null text is empty: no bytes, no tokens. Ids may repeat or be null.
    """

    def count(batches):
        machine = transducer(model)
        for batch in batches:
            each = batch["text"].to_pylist()
            n = [machine.count(t) for t in each]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([len(t.encode()) for t in each], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts(docs, id_col, text_col).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

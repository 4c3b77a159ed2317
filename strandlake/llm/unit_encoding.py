"""Encoding whole texts through a bounded memory of their space-separated units.

Byte-level and word-end tokenizers never join a non-space character with a space that follows it, so a text's ids are
those of its units, one after the other. Units repeat, so most come from memory; the library sees each new unit once.
Texts with other white space, runs of spaces or special strings go to the library whole, so ids never differ from it.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array
from collections.abc import Callable

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
WORD = re.compile(rf"([{LETTERS}]+)([!-/:-@\[-`{{-~]*)")


class UnitMemory(dict):
    """unit -> value, made on a miss. Two generations bound it: a full one becomes the old one, which is forgotten next."""

    LONGEST = 64

    def __init__(self, make: Callable, limit: int = 300_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, unit):
        if len(unit) > self.LONGEST:
            return self.make(unit)
        value = self.old.get(unit)
        if value is None:
            value = self.make(unit)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[unit] = value
        return value


class BatchMemory:
    """As UnitMemory, filled for a batch of units at a time."""

    def __init__(self, make_all: Callable, limit: int = 300_000):
        self.make_all, self.limit, self.young, self.old = make_all, limit, {}, {}

    def of(self, units: set) -> dict:
        """A mapping that has all of ``units``."""
        if len(self.young) >= self.limit:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        missing = [u for u in units if u not in young]
        out = {u: old[u] for u in missing if u in old}
        missing = [u for u in missing if u not in old]
        out |= zip(missing, self.make_all(missing), strict=True)
        young.update((u, v) for u, v in out.items() if len(u) <= UnitMemory.LONGEST)
        if len(out) < len(units):
            out |= ((u, young[u]) for u in units if u not in out)
        return out


def plain_units(text: str) -> list[str] | None:
    """Units of a text whose white space is single spaces and newlines between words, else None.

    A unit after a newline keeps it as its first character; the others, but for the first, follow a space.
    """
    if " ".join(text.split()) != text.replace("\n", " "):
        return None
    return text.replace("\n", " \n").split(" ")


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level tokenizers use for each byte."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class LibraryEncoder:
    """ids(text) as array of ids, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str, limit: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.code = "H" if max(self.tokenizer.get_vocab().values(), default=0) < 1 << 16 else "I"
        self.letters = {ord(c): x for c, x in ((chr(b), s) for b, s in byte_letters().items())}
        self.kind = self._kind(spec)
        self.after_space = UnitMemory(self._after_space, limit)
        self.words = UnitMemory(self._word_end, limit)
        self.words[""] = b""
        self.marks = UnitMemory(lambda marks: self._pack([t.id for t in self.model.tokenize(marks)]))

    @staticmethod
    def _kind(spec: dict) -> str:
        model, pre, norm = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges") or spec.get("post_processor"):
            return "whole"
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            return "byte"
        steps = [x["type"] for x in pre.get("pretokenizers", [])]
        norms = [x["type"] for x in (norm or {}).get("normalizers", [])]
        if steps == ["Split", "ByteLevel"] and norms == ["NFC", "Replace", "Lowercase"] and pre["pretokenizers"][0].get("behavior") == "Removed":
            return "word"
        return "whole"

    def _pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _whole(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _bytes_shown(self, word: str) -> str:
        return word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)

    def _after_space(self, unit: str) -> bytes:
        if m := WORD.fullmatch(unit):
            if m[2]:
                return self.after_space[m[1]] + self.marks[m[2]]
            return self._pack([t.id for t in self.model.tokenize("Ġ" + self._bytes_shown(unit))])
        return self._whole(unit if unit[:1] == "\n" else " " + unit)

    def _word_end(self, unit: str) -> bytes:
        if (m := WORD.fullmatch(unit)) and not m[2]:
            return self._pack([t.id for t in self.model.tokenize(self._bytes_shown(unit.lower()))])
        if m and m[2]:
            return self.words[m[1]] + self.words[m[2]]
        return self._whole(unit)

    def packed(self, text: str) -> bytes:
        """The ids as native unsigned integers of ``code``."""
        if not text:
            return b""
        if self.kind != "whole" and not any(s in text for s in self.special):
            if self.kind == "word":
                return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))
            if units := plain_units(text):
                return self._whole(units[0]) + b"".join(map(self.after_space.__getitem__, units[1:]))
        return self._whole(text)


@functools.lru_cache(maxsize=2)
def library_encoder(path: str, limit: int = 300_000) -> LibraryEncoder:
    """One encoder for each worker process and file, kept from task to task; it remembers at most twice ``limit`` units."""
    return LibraryEncoder(path, limit)

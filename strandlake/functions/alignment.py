"""Edit distances that no built-in expresses, as Arrow functions that step through all rows of a batch at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .sequence import IUPAC_BASES

#: Texts are cut into pieces of so many letters, and so many pieces are stepped through at once.
PIECE, ROWS = 1024, 4096

_CODES = np.zeros(256, np.uint8)
for _bit, _base in enumerate("ACGT"):
    _CODES[ord(_base)] = _CODES[ord(_base.lower())] = 1 << _bit


def _encoded(texts) -> tuple[np.ndarray, np.ndarray]:
    """Texts as a padded matrix of bytes, and their lengths."""
    raw = [t.encode("latin-1", "replace") for t in texts]
    lengths = np.array([len(r) for r in raw])
    out = np.zeros((len(raw), max(1, lengths.max(initial=0))), np.uint8)
    for i, r in enumerate(raw):
        out[i, : len(r)] = np.frombuffer(r, np.uint8)
    return out, lengths


def _equal(pattern: str, iupac: bool) -> np.ndarray:
    """For each pattern place, the cost of each byte."""
    cost = np.ones((len(pattern), 256), np.int16)
    for i, c in enumerate(pattern):
        for base in IUPAC_BASES.get(c.upper(), c) if iupac else c:
            cost[i, ord(base)] = 0
            if iupac:
                cost[i, ord(base.lower())] = 0
    return cost


def sellers(texts: list[str], pattern: str, iupac: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(distance, end) of the best match of the whole pattern anywhere in each text; the leftmost end of the best.

    A best stretch is at most twice as long as the pattern, so pieces that begin that much earlier see all that end in them.
    """
    before = 2 * len(pattern)
    pieces = [(k, at, max(0, at - before)) for k, t in enumerate(texts) for at in range(0, max(1, len(t)), PIECE)]
    best, end = np.full(len(texts), len(pattern), np.int16), np.zeros(len(texts), np.int64)
    for k in range(0, len(pieces), ROWS):
        part = pieces[k : k + ROWS]
        found = _sellers([texts[t][start : at + PIECE] for t, at, start in part], pattern, iupac)
        for (t, _, start), d, e in zip(part, found[0].tolist(), found[1].tolist(), strict=True):
            if d < best[t]:
                best[t], end[t] = d, start + e
    return best, end


def _sellers(texts: list[str], pattern: str, iupac: bool) -> tuple[np.ndarray, np.ndarray]:
    data, lengths = _encoded(texts)
    cost, m = _equal(pattern, iupac), len(pattern)
    column = np.broadcast_to(np.arange(m + 1, dtype=np.int16), (len(data), m + 1)).copy()
    best, end = column[:, m].copy(), np.zeros(len(data), np.int64)
    for j in range(data.shape[1]):
        step = np.minimum(column[:, :-1] + cost[:, data[:, j]].T, column[:, 1:] + 1)
        column[:, 0] = 0
        # insertions run down the column: a running minimum of value minus place
        grown = np.concatenate([column[:, :1], step], axis=1) - np.arange(m + 1, dtype=np.int16)
        column = (np.minimum.accumulate(grown, axis=1) + np.arange(m + 1, dtype=np.int16)).astype(np.int16)
        better = (column[:, m] < best) & (j < lengths)
        best[better], end[better] = column[better, m], j + 1
    return best, end


def semiglobal_distance(pattern: str, most: int):
    """A column function: the least edit distance of the pattern to a stretch of the text, null beyond ``most``."""

    @F.pandas_udf("int")
    def distance(text: pd.Series) -> pd.Series:
        best, _ = sellers(text.fillna("").tolist(), pattern)
        return pd.Series(best).where(best <= most).astype("Int32").where(text.notna().to_numpy())

    return distance


def semiglobal_find(pattern: str, most: int):
    """A column function: struct(dist, start, end) of the leftmost best match; its start is the shortest stretch's."""

    @F.pandas_udf("dist int, start int, end int")
    def find(text: pd.Series) -> pd.DataFrame:
        texts = text.fillna("").tolist()
        best, end = sellers(texts, pattern)
        # the start: match the reversed pattern backwards from the end and take the nearest end at the same distance
        back = [t[max(0, e - len(pattern) - most) : e][::-1] for t, e in zip(texts, end.tolist(), strict=True)]
        start = end - _anchored(back, pattern[::-1], best)
        out = pd.DataFrame({"dist": best, "start": start, "end": end}).astype("Int32")
        return out.where(pd.Series((best <= most) & text.notna().to_numpy()), pd.NA)

    return find


def _anchored(texts: list[str], pattern: str, want: np.ndarray) -> np.ndarray:
    """The shortest prefix of each text at distance ``want`` from the pattern."""
    data, lengths = _encoded(texts)
    cost, m = _equal(pattern, False), len(pattern)
    column = np.broadcast_to(np.arange(m + 1, dtype=np.int16), (len(data), m + 1)).copy()
    out = np.where(column[:, m] == want, 0, -1)
    for j in range(data.shape[1]):
        step = np.minimum(column[:, :-1] + cost[:, data[:, j]].T, column[:, 1:] + 1)
        grown = np.concatenate([np.full((len(data), 1), j + 1, np.int16), step], axis=1) - np.arange(m + 1, dtype=np.int16)
        column = (np.minimum.accumulate(grown, axis=1) + np.arange(m + 1, dtype=np.int16)).astype(np.int16)
        out = np.where((out < 0) & (column[:, m] == want) & (j < lengths), j + 1, out)
    return np.maximum(out, 0)


def iupac_distance(text: str, pattern: str) -> int:
    """Edit distance of two whole strings; a pattern code matches any of its bases."""
    row = list(range(len(pattern) + 1))
    for i, base in enumerate(text.upper(), 1):
        last, row[0] = row[0], i
        for j, code in enumerate(pattern.upper(), 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (base not in IUPAC_BASES.get(code, code)))
    return row[-1]


def iupac_edit_distance(pattern: str):
    """A column function: iupac_distance to ``pattern``; null for null."""

    @F.pandas_udf("int")
    def distance(text: pd.Series) -> pd.Series:
        return text.map(lambda t: iupac_distance(t, pattern), na_action="ignore").astype("Int32")

    return distance

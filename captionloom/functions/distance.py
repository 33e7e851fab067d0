"""Edit distances of whole long sequences: cheap where they are near, bounded where they are not.

What both begin and end with alike is cut off. Then the furthest place on each diagonal is found edit by
edit, which takes time with the square of the distance, not with the lengths; if the sequences turn out to
be too far apart for that, the table of distances is run down in columns of bits, a machine word at a time.
Both ways are exact.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

#: Places that are compared at once along a diagonal: few at first, more where it goes on.
STRIDES = (8, 64, 512, 4096)

#: About what the two ways cost, in microseconds: a step of the first and each of its diagonals, a column of the second and each byte of it.
STEP, DIAGONAL, COLUMN, BYTE = 60.0, 0.4, 1.0, 0.0015


def trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both without what they begin and end with alike."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    first = int(differ[0]) if len(differ) else n
    a, b, n = a[first:], b[first:], n - first
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    last = int(differ[0]) if len(differ) else n
    return a[: len(a) - last], b[: len(b) - last]


def by_diagonals(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """The edit distance if it is at most `most`, else None.

    reach[d] is the furthest place in a on the diagonal d (place in b less place in a) that so many edits
    get to; an edit more steps over from the diagonals beside it, and equal places are free.
    """
    n, m = len(a), len(b)
    pad = STRIDES[-1]
    x, y = (np.concatenate([v.astype(np.int64), np.full(pad + 1, end)]) for v, end in ((a, -1), (b, -2)))

    def slid(at: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
        going, k = np.flatnonzero(at >= 0), 0
        while len(going):
            places = at[going][:, None] + np.arange(STRIDES[k])
            same = x[np.minimum(places, n)] == y[np.minimum(places + diagonal[going][:, None], m)]
            stops = ~same.all(axis=1)
            at[going] += np.where(stops, np.argmin(same, axis=1), STRIDES[k])
            going, k = going[~stops], min(k + 1, len(STRIDES) - 1)
        return at

    none = -(1 << 40)
    low, high = max(-n, -most), min(m, most)
    reach = np.full(high - low + 3, none)  # a place more at either end
    goal = m - n - low + 1
    if not low <= m - n <= high:
        return None
    reach[-low + 1] = slid(np.zeros(1, np.int64), np.zeros(1, np.int64))[0]
    for edits in range(most + 1):
        if reach[goal] >= n:
            return edits
        if edits == most:
            break
        left, right = max(low, -edits - 1), min(high, edits + 1)
        own = np.arange(left, right + 1)
        s = slice(left - low + 1, right - low + 2)
        best = np.maximum(np.maximum(reach[s] + 1, reach[s.start - 1 : s.stop - 1]), reach[s.start + 1 : s.stop + 1] + 1)
        best = np.minimum(best, np.minimum(n, m - own))
        best[(best < 0) | (best + own < 0)] = none
        reach[s] = slid(best, own)
    return None


def by_columns(a: np.ndarray, b: np.ndarray) -> int:
    """The edit distance by bit vectors: a column's steps up and down as two numbers of len(a) bits."""
    n = len(a)
    if not n:
        return len(b)
    kinds, codes = np.unique(a, return_inverse=True)
    order = np.argsort(codes, kind="stable")
    ends = np.cumsum(np.bincount(codes, minlength=len(kinds)))
    places = {}
    for k, kind in enumerate(kinds.tolist()):
        mask = np.zeros(n, bool)
        mask[order[ends[k - 1] if k else 0 : ends[k]]] = True
        places[kind] = int.from_bytes(np.packbits(mask, bitorder="little").tobytes(), "little")
    every = (1 << n) - 1
    up, down, score, last = every, 0, n, n - 1
    for c in b.tolist():
        match = places.get(c, 0)
        level = match | down
        same = ((((match & up) + up) & every) ^ up) | level
        rise, fall = down | (every & ~(same | up)), up & same
        score += (rise >> last) - (fall >> last)
        rise, fall = ((rise << 1) | 1) & every, (fall << 1) & every
        up, down = fall | (every & ~(same | rise)), rise & same
    return score


def distance(a: np.ndarray, b: np.ndarray) -> int:
    """The edit distance of two arrays of whole numbers."""
    a, b = trimmed(a, b)
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return len(b)
    far = len(b) * (COLUMN + BYTE * len(a) / 8 * 12)
    # So many edits that the first way has cost what the second would.
    most = int((-STEP + math.sqrt(STEP**2 + 4 * DIAGONAL * far)) / (2 * DIAGONAL))
    if most >= len(b) - len(a) and most > 2:
        found = by_diagonals(a, b, min(most, len(b)))
        if found is not None:
            return found
    return by_columns(a, b)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


@pandas_udf(LongType())
def _of_texts(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else 0 if x == y else distance(_points(x), _points(y)) for x, y in zip(a, b, strict=True)], dtype="Int64")


@pandas_udf(LongType())
def _of_tokens(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b, strict=True):
        if x is None or y is None:
            out.append(None)
            continue
        known: dict = {}
        codes = [np.array([known.setdefault(t, len(known)) for t in v], np.int64) for v in (x, y)]
        out.append(distance(*codes))
    return pd.Series(out, dtype="Int64")


def text_distance(a: Column, b: Column) -> Column:
    """Edit distance of two whole texts in characters; null if one is null."""
    return _of_texts(a, b)


def token_distance(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of tokens; null if one is null."""
    return _of_tokens(a, b)

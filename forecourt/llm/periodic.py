"""Periodic runs of words, found by internal pattern matching.

The words of some texts, closed by marks that occur once, form one sequence.
Prefix doubling sorts its suffixes and names, for every power of two, the class
of equal blocks that each place starts; a class is an interval of the suffix
array. A run of period q and at least 4q words holds a dyadic block of b words,
q < b <= 2q, whose copy q words before or after it lies in the run too. Equal
blocks in a neighbouring window of b words form an arithmetic progression, and
the difference of a progression that the nearest copy opens is the only
candidate for q. A wavelet matrix over the suffix array answers the nearest
copies (range successor and predecessor in the block's interval); classes of
blocks extend a candidate to both sides as far as its period holds.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecourt.llm.common import words

#: A run has at least this many words and this many times its period.
LEAST_WORDS, LEAST_TIMES = 6, 4

#: Words of the texts that are searched together; a longer text is searched alone.
CHUNK = 1 << 16


class Blocks:
    """Suffix array of ``codes`` and, for each k, the class of the block of 2^k codes at each place.

    A class is numbered by its first place in the suffix array. The last code
    occurs once, so no block of a class of several runs over the end.
    """

    def __init__(self, codes: np.ndarray) -> None:
        n = len(codes)
        self.suffixes = np.argsort(codes, kind="stable").astype(np.int32)
        classes, alike = self._named(codes[self.suffixes], np.arange(n, dtype=np.int32), self.suffixes, np.empty(n, np.int32))
        self.classes = [classes]
        slots = np.flatnonzero(alike).astype(np.int32)
        size = 1
        while len(slots):
            at = self.suffixes[slots]
            key = classes[at].astype(np.int64) * n + classes[at + size]
            order = np.argsort(key, kind="stable")
            at = at[order]
            self.suffixes[slots] = at
            classes, alike = self._named(key[order], slots, at, classes.copy())
            self.classes.append(classes)
            slots = slots[alike]
            size *= 2

    @staticmethod
    def _named(key: np.ndarray, slots: np.ndarray, at: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes with those of the places ``at``, sorted by ``key`` into ``slots``; and which have company."""
        new = np.ones(len(key) + 1, bool)
        new[1:-1] = key[1:] != key[:-1]
        first = np.maximum.accumulate(np.where(new[:-1], np.arange(len(key)), 0))
        classes[at] = slots[first]
        return classes, ~(new[:-1] & new[1:])

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal codes from the places ``i`` and ``j`` on, i < j."""
        got = np.zeros(len(i), np.int64)
        for k in range(len(self.classes) - 1, -1, -1):
            classes = self.classes[k]
            # Two blocks of a length are in a class at most once, so each length is tried once; the longest may repeat.
            while True:
                to = j + got
                same = to < len(classes)
                same[same] = classes[(i + got)[same]] == classes[to[same]]
                if not same.any():
                    break
                got += same.astype(np.int64) << k
                if k < len(self.classes) - 1:
                    break
        return got

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal codes that end before the places ``i`` and ``j``, i < j."""
        got = np.zeros(len(i), np.int64)
        for k in range(len(self.classes) - 1, -1, -1):
            classes = self.classes[k]
            while True:
                to = i - got - (1 << k)
                same = to >= 0
                same[same] = classes[to[same]] == classes[(j - got - (1 << k))[same]]
                if not same.any():
                    break
                got += same.astype(np.int64) << k
                if k < len(self.classes) - 1:
                    break
        return got


class Wavelet:
    """Wavelet matrix of a permutation: counts and order statistics of any interval, for many queries at once."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.levels = []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit) & 1 == 1
            zeros = np.zeros(len(values) + 1, np.int32)
            np.cumsum(~one, out=zeros[1:])
            self.levels.append((bit, zeros))
            values = np.concatenate([values[~one], values[one]])

    def below(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Values of [low, high) that are less than ``x``."""
        count = np.zeros(len(x), np.int64)
        for bit, zeros in self.levels:
            a, b, all_zeros = zeros[low], zeros[high], zeros[-1]
            up = (x >> bit) & 1 == 1
            count += np.where(up, b - a, 0)
            low, high = np.where(up, all_zeros + low - a, a), np.where(up, all_zeros + high - b, b)
        return count

    def nth(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of rank ``k`` in [low, high)."""
        value = np.zeros(len(k), np.int64)
        for bit, zeros in self.levels:
            a, b, all_zeros = zeros[low], zeros[high], zeros[-1]
            up = k >= b - a
            k = np.where(up, k - (b - a), k)
            value |= up.astype(np.int64) << bit
            low, high = np.where(up, all_zeros + low - a, a), np.where(up, all_zeros + high - b, b)
        return value


def runs(codes: np.ndarray) -> np.ndarray:
    """Runs of a sequence whose last code occurs once: rows (start, length, period), sorted by start and period."""
    blocks = Blocks(codes)
    wavelet, pairs = None, []
    for k in range(1, len(blocks.classes)):
        b, classes = 1 << k, blocks.classes[k]
        at = np.arange(0, len(codes), b)
        low = classes[at]
        many = np.bincount(classes, minlength=len(codes))[low]
        at, low, many = at[many > 1], low[many > 1].astype(np.int64), many[many > 1]
        if not len(at):
            continue
        wavelet = wavelet or Wavelet(blocks.suffixes)
        rank = wavelet.below(low, low + many, at)
        for near, step in ((rank + 1 < many, 1), (rank > 0, -1)):
            place, left = at[near], low[near]
            other = wavelet.nth(left, left + many[near], rank[near] + step)
            far = np.abs(other - place)
            fits = (far >= b // 2) & (far < b)
            pairs.append(np.stack([np.minimum(place, other)[fits], far[fits]]))
    if not pairs:
        return np.zeros((0, 3), np.int64)
    at, period = np.concatenate(pairs, axis=1)
    start = at - blocks.backward(at, at + period)
    length = at + period + blocks.forward(at, at + period) - start
    long = length >= np.maximum(LEAST_WORDS, LEAST_TIMES * period)
    return np.unique(np.stack([start, period, length], axis=1)[long], axis=0)[:, [0, 2, 1]]


def planted(found: list[str], doc_id: int | None) -> list[str]:
    """The words of a document, a tenth of the documents with a period from some word on, by the checksum of the id."""
    h = zlib.crc32(b"%d" % doc_id) if doc_id is not None else 1
    n, g = len(found), h // 10
    if h % 10 or not n:
        return found
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = found[a : a + p]
    return found[:a] + (period * (-(-(n - a) // p)))[: n - a]


def text_runs(texts: list[list[str]]) -> list[np.ndarray]:
    """Runs of each text's words, searched together."""
    known: dict[str, int] = {}
    ends = np.cumsum([len(t) + 1 for t in texts])
    codes = np.empty(int(ends[-1]) if texts else 0, np.int64)
    for end, text in zip(ends.tolist(), texts, strict=True):
        codes[end - 1 - len(text) : end - 1] = [known.setdefault(w, len(known)) for w in text]
    codes[ends - 1] = len(known) + np.arange(len(texts))
    found = runs(codes) if texts else np.zeros((0, 3), np.int64)
    owner = np.searchsorted(ends, found[:, 0], "right")
    begins = ends - [len(t) + 1 for t in texts]
    found[:, 0] -= begins[owner]
    return [found[a:b] for a, b in zip(*(np.searchsorted(owner, np.arange(len(texts)), side) for side in ("left", "right")), strict=True)]


def collapsed(text: list[str], found: np.ndarray) -> list[str]:
    """The words less those that a run holds after its first period."""
    if not len(found):
        return text
    change = np.zeros(len(text) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return list(compress(text, (np.cumsum(change[:-1]) == 0).tolist()))


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _row(text: list[str], found: np.ndarray) -> tuple:
    best = (None,) * 4
    listed = found.tolist()
    if listed:
        # Lengths and periods are compared as whole numbers; the first of equal ones has the smallest start and period.
        top = listed[0]
        for run in listed[1:]:
            if run[1] * top[2] > top[1] * run[2]:
                top = run
        best = (*top, 1000 * top[1] // top[2])
    lines = "".join(f"{start},{length},{period}\n" for start, length, period in listed)
    return (len(listed), *best, _digest(lines), _digest(" ".join(collapsed(text, found))))


_COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
_FOUND = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _chunks(texts: list[list[str]]) -> Iterator[list[list[str]]]:
    part, held = [], 0
    for text in texts:
        if part and held + len(text) > CHUNK:
            yield part
            part, held = [], 0
        part.append(text)
        held += len(text)
    if part:
        yield part


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """Runs of each row of ``docs`` (doc_id, text): number, the one of greatest exponent, digests of all and of what is left.

    ``plant`` makes a tenth of the documents periodic first (``planted``); a
    null doc_id is left as it is. Null and empty texts have no words and no
    runs; repeated rows are searched alike; an empty table gives no rows; other
    columns are ignored. Texts are searched whole; one of n words needs about
    4 bytes a word for each doubling of its longest repeat, and 150 besides.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [words(t) for t in batch.column("text").to_pylist()]
            if plant:
                ids = batch.column("doc_id").to_pylist()
                texts = [planted(t, i) for t, i in zip(texts, ids, strict=True)]
            rows = []
            for part in _chunks(texts):
                rows += [_row(t, found) for t, found in zip(part, text_runs(part), strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * len(_COLUMNS)
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", *_COLUMNS],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _FOUND)

"""Removal of repeated word windows found by rolling hashes.

Every window of a fixed number of words has a Rabin-Karp hash. Tasks send each
hash once per block of documents, with the smallest doc_id that has it there;
the other documents of the block are known to be later at once. The task of a
hash bucket compares blocks and sends back the hashes whose smallest document
is elsewhere. Marked windows merge into maximal intervals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecourt.llm.common import words

WINDOW = 50

#: Windows of a block, which a task holds at once.
BLOCK = 1_500_000

#: Windows that a hash bucket is meant to hold.
BUCKET = 500_000

#: Documents that a group of marks is meant to hold.
GROUP = 1024

#: A null doc_id comes after all others.
LAST_ID = 2**63 - 1

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SENT = "bucket int, docs_group int, hashes binary, docs binary"


def _word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class _Hashes(dict):
    """Hash by word; emptied when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 150_000:
            self.clear()
        h = self[word] = _word_hash(word)
        return h


_known = _Hashes()


def rolling(values: np.ndarray, window: int) -> np.ndarray:
    """Rabin-Karp hash of every window: sum of value times base to the power of its place, modulo 2^64, then mixed.

    Made by doubling: windows of 2k words from two of k.
    """
    n = len(values) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out, done, width, power = np.zeros(n, np.uint64), 0, 1, _BASE
        part = values  # hashes of windows of ``width`` words
        while True:
            if window & width:
                factor = np.uint64(pow(int(_BASE), done, 2**64))
                out += part[done : done + n] * factor
                done += width
            if done == window:
                break
            part = part[:-width] + part[width:] * power
            power *= power
            width *= 2
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out


def window_hashes(text: str | None, window: int) -> np.ndarray:
    found = words(text)
    if len(found) < window:
        return np.zeros(0, np.uint64)
    return rolling(np.fromiter(map(_known.__getitem__, found), np.uint64, len(found)), window)


def _firsts(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different hashes and the smallest document of each."""
    order = np.argsort(hashes, kind="stable")
    hashes, docs = hashes[order], docs[order]
    at = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    return hashes[at], np.minimum.reduceat(docs, at) if len(at) else docs


def _grouped(hashes: np.ndarray, docs: np.ndarray, groups: int) -> list[tuple[int, bytes, bytes]]:
    """Windows by group of documents: (group, hashes, packed ids), in order of documents."""
    with np.errstate(over="ignore"):
        spread = docs.astype(np.uint64) * _BASE >> np.uint64(32)
    group = (spread * np.uint64(groups) >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((docs, group))
    hashes, docs, group = hashes[order], docs[order], group[order]
    edges = np.flatnonzero(np.diff(group, prepend=-1, append=groups))
    return [(int(group[a]), hashes[a:b].tobytes(), _pack(docs[a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _send(blocks: list[np.ndarray], ids: list[int], buckets: int, groups: int) -> list[tuple]:
    """Rows of a block: the first documents by bucket, and windows already known to be later."""
    hashes = np.concatenate(blocks)
    docs = np.repeat(np.array(ids, np.int64), [len(b) for b in blocks])
    keys, first = _firsts(hashes, docs)
    later = docs > first[np.searchsorted(keys, hashes)]
    rows = [(row[0] % buckets, *row) for row in _grouped(hashes[later], docs[later], groups)]
    # Keys are sorted, so a bucket is a stretch of them; in it, order by document packs better.
    bucket = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        order = np.argsort(first[a:b], kind="stable")
        rows.append((int(bucket[a]), -1, keys[a:b][order].tobytes(), _pack(first[a:b][order])))
    return rows


def _pack(docs: np.ndarray) -> bytes:
    """Sorted ids as compressed differences."""
    return pa.Codec("zstd").compress(np.diff(docs, prepend=0).tobytes(), asbytes=True)


def _unpack(body: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(pa.Codec("zstd").decompress(body, 8 * n, asbytes=True), np.int64))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    bucket, group, hashes, docs = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket, pa.int32()), pa.array(group, pa.int32()), pa.array(hashes, pa.binary()), pa.array(docs, pa.binary())],
        ["bucket", "docs_group", "hashes", "docs"],
    )


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows (doc_id, marked): hashes of a document's windows that a smaller doc_id has too, if there are any."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # Words are more than a quarter of the characters only in texts of one-letter words.
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.count("*").alias("docs")).first()
    buckets, groups = max(1, size.chars // 4 // BUCKET), max(1, size.docs // GROUP)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, ids, held = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                hashes = window_hashes(text.as_py(), window)
                if not len(hashes):
                    continue
                blocks.append(hashes)
                ids.append(LAST_ID if doc is None else doc)
                held += len(hashes)
                if held >= BLOCK:
                    yield _batch(_send(blocks, ids, buckets, groups))
                    blocks, ids, held = [], [], 0
        if held:
            yield _batch(_send(blocks, ids, buckets, groups))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        """Marks already known, and those that follow from the first documents of all blocks."""
        known = part["docs_group"] >= 0
        out = [part.loc[known, ["docs_group", "hashes", "docs"]]]
        hashes, owners = _joined(part[~known])
        if len(hashes):
            keys, first = _firsts(hashes, owners)
            later = owners > first[np.searchsorted(keys, hashes)]
            found = _grouped(hashes[later], owners[later], groups)
            out.append(pd.DataFrame(found, columns=["docs_group", "hashes", "docs"]))
        return pd.concat(out)

    def by_doc(part: pd.DataFrame) -> pd.DataFrame:
        hashes, owners = _joined(part)
        order = np.argsort(owners, kind="stable")
        hashes, owners = hashes[order], owners[order]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(owners)) + 1, [len(owners)]])
        marked = [hashes[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pd.DataFrame({"doc_id": owners[edges[:-1]], "marked": marked})

    sent = rows.filter("text is not null").mapInArrow(send, _SENT)
    marks = sent.groupBy("bucket").applyInPandas(compare, "docs_group int, hashes binary, docs binary")
    return marks.groupBy("docs_group").applyInPandas(by_doc, "doc_id long, marked binary")


def _joined(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and documents of packed rows."""
    docs = [_unpack(d, len(h) // 8) for d, h in zip(rows["docs"], rows["hashes"], strict=True)]
    return np.frombuffer(b"".join(rows["hashes"]), np.uint64), np.concatenate([np.zeros(0, np.int64), *docs])


def covered(n_words: int, hashes: np.ndarray, marked: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal intervals of words under marked windows."""
    starts = np.flatnonzero(np.isin(hashes, marked))
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > window)
    begin = starts[np.concatenate([[0], breaks + 1])]
    end = starts[np.concatenate([breaks, [len(starts) - 1]])] + window
    return list(zip(begin.tolist(), end.tolist(), strict=True))


_KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed string, kept string"


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """Each row of ``docs`` (doc_id, text) without the words under repeated windows.

    Columns: doc_id, n_words, n_removed, kept_sha256, removed (intervals of
    words, end exclusive), kept (text, null unless ``with_text``). The document
    with the smallest doc_id keeps a passage, also where it has it twice; rows
    of one doc_id don't count against each other; a null doc_id comes last. Null texts have no words.
    """
    marked = repeated_windows(docs, window).withColumnRenamed("doc_id", "marked_id")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.join(marked, F.coalesce("doc_id", F.lit(LAST_ID)) == F.col("marked_id"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, marks in zip(batch.column("text"), batch.column("marked"), strict=True):
                text, gone = text.as_py(), []
                left = found = words(text)
                if marks.is_valid:
                    hit = np.frombuffer(marks.as_py(), np.uint64)
                    gone = covered(len(found), window_hashes(text, window), hit, window)
                    left, at = [], 0
                    for a, b in gone:
                        left += found[at:a]
                        at = b
                    left += found[at:]
                body = " ".join(left)
                sha = hashlib.sha256(body.encode("utf-8", "surrogatepass")).hexdigest()
                spans = ",".join(f"{a}:{b}" for a, b in gone)
                out.append((len(found), len(found) - len(left), sha, spans, body if with_text else None))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 2 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "removed", "kept"],
            )

    return rows.mapInArrow(run, _KEPT)

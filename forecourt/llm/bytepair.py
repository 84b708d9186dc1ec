"""Byte-pair encoding and decoding through a table of distinct words.

Tasks split texts into the tokenizer's words and keep, for each block of texts,
its different words and the texts as places in that list. The words of all
blocks meet in one table, where each distinct word is encoded once and decoded
through a join of its ids with the vocabulary's pieces. A join brings the ids
back to the blocks, and every text is put together by the places of its words.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text in a block; a longer text is a block of its own.
BLOCK_CHARS = 1 << 25

#: Words whose ids a task groups by block at once, and words or bytes that are put together at once.
GROUPED, JOINED = 1 << 19, 1 << 20

#: Texts in a batch that leaves a block.
TEXTS = 500

# The tokenizer's splitting pattern, a fixed value.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

# Letters, signs and spaces whose classes are the same in every version of Unicode since 3.0.
_SETTLED = re.compile(
    "[\x00-ȟΑ-ΡΣ-ωА-я‐-‧‰-⁆ぁ-ゔァ-ヶ一-龥가-힣]*"
)

_loaded: dict[str, Splitter] = {}


class Splitter:
    """Splits texts as the tokenizer of a file does, its added tokens first."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added) or self.tokenizer.normalizer:
            raise ValueError("only plain added tokens and byte-level words are split")
        contents = sorted((t.content for t in added), key=len, reverse=True)
        self.added = frozenset(contents)
        self.marks = re.compile("(" + "|".join(map(re.escape, contents)) + ")") if contents else None

    def _plain(self, text: str) -> list[str]:
        if text.isascii() or _SETTLED.fullmatch(text):
            return _SPLIT.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def words(self, text: str) -> list[str]:
        if not self.marks or not self.marks.search(text):
            return self._plain(text)
        out = []
        for part in self.marks.split(text):
            out += [part] if part in self.added else self._plain(part)
        return out


def splitter(path: str) -> Splitter:
    """The splitter of a tokenizer's file, kept in the worker."""
    if path not in _loaded:
        _loaded[path] = Splitter(path)
    return _loaded[path]


def _press(values: np.ndarray) -> bytes:
    """Whole numbers, byte by byte of all, compressed."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _loosen(body: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _gather(values: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The ranges [start, start + count) of ``values``, one after the other."""
    ahead = np.cumsum(count) - count
    return values[np.repeat(start - ahead, count) + np.arange(int(count.sum()))]


def _starts(count: np.ndarray) -> np.ndarray:
    return np.cumsum(count) - count


_BLOCKS = "block long, doc_id array<long>, sizes binary, places binary, word_bytes binary, words binary"


def _block(number: int, ids: list, sizes: list[int], places: list[int], known: dict[str, int]) -> pa.RecordBatch:
    at = np.array(places, np.int64)
    # Frequent words get small numbers, which compress well.
    order = np.argsort(-np.bincount(at, minlength=len(known)), kind="stable")
    rank = np.empty(len(known), np.int64)
    rank[order] = np.arange(len(known))
    spelled = [w.encode() for w in known]
    spelled = [spelled[k] for k in order.tolist()]
    row = {
        "block": number,
        "doc_id": ids,
        "sizes": _press(np.array(sizes, np.int64)),
        "places": _press(rank[at]),
        "word_bytes": _press(np.array([len(w) for w in spelled], np.int64)),
        "words": zstandard.ZstdCompressor(level=3).compress(b"".join(spelled)),
    }
    schema = pa.schema(
        [("block", pa.int64()), ("doc_id", pa.list_(pa.int64()))] + [(c, pa.binary()) for c in ("sizes", "places", "word_bytes", "words")]
    )
    return pa.RecordBatch.from_pylist([row], schema)


def _blocks(docs: DataFrame, path: str) -> DataFrame:
    """Texts in blocks: for each its ids, words by text, all words as places, and the different words, most frequent first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(path).words
        number = TaskContext.get().partitionId() << 32
        ids, sizes, places, known, chars = [], [], [], {}, 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py() or ""
                if ids and chars + len(text) > BLOCK_CHARS:
                    yield _block(number, ids, sizes, places, known)
                    number += 1
                    ids, sizes, places, known, chars = [], [], [], {}, 0
                found = split(text)
                ids.append(doc_id)
                sizes.append(len(found))
                places += [known.setdefault(w, len(known)) for w in found]
                chars += len(text)
        if ids:
            yield _block(number, ids, sizes, places, known)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _BLOCKS)


def _spelled(row: dict) -> tuple[np.ndarray, bytes]:
    """Byte lengths of a block's words, and their bytes in a row."""
    return _loosen(row["word_bytes"]), zstandard.ZstdDecompressor().decompress(row["words"])


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each different word of each block, with its place there."""
    for batch in batches:
        for row in batch.to_pylist():
            count, body = _spelled(row)
            ends = np.concatenate([[0], np.cumsum(count)])
            text = pa.LargeStringArray.from_buffers(len(count), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(body))
            order = pc.sort_indices(text)  # neighbours that start alike compress well
            for a in range(0, len(count), GROUPED):
                place = order[a : a + GROUPED]
                block = pa.array(np.full(len(place), row["block"], np.int64))
                yield pa.RecordBatch.from_arrays([text.take(place).cast(pa.string()), block, place.cast(pa.int32())], ["word", "block", "place"])


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """The bytes of each id of the tokenizer, as rows (id, piece)."""
    tokenizer = splitter(path).tokenizer
    added = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
    # Byte-level pieces spell a byte as itself where it is printable, the others by the next code points from 256 on.
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(printable)))}
    rows = [
        (i, bytearray(added[i].encode() if i in added else bytes(byte[c] for c in piece)))
        for piece, i in tokenizer.get_vocab(with_added_tokens=True).items()
    ]
    return spark.createDataFrame(rows, "id int, piece binary")


def _word_table(words: DataFrame, path: str) -> DataFrame:
    """Each distinct word with its ids, encoded once, and the bytes that these decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = splitter(path).tokenizer.encode_batch
        for batch in batches:
            found = [e.ids for e in encode(batch.column("word").to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(found, pa.list_(pa.int32()))], ["word", "ids"])

    # Counting both columns keeps them in the shuffled rows, so that one shuffle serves this table and the join with it.
    distinct = words.groupBy("word").agg(F.count(F.col("block") + F.col("place")).alias("n_blocks"))
    distinct = distinct.filter("n_blocks > 0").select("word").sortWithinPartitions("word")
    encoded = distinct.mapInArrow(run, "word string, ids array<int>").repartition("word")
    encoded = encoded.select("word", F.posexplode("ids").alias("at", "id"))
    # The vocabulary's size is the tokenizer's, whatever the corpus.
    parts = encoded.join(F.broadcast(pieces(words.sparkSession, path)), "id", "left")
    parts = parts.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("at", "id", "piece"))).alias("p"))
    bytes_of = F.aggregate("p.piece", F.lit(b""), lambda a, b: F.concat(a, b))
    return parts.select("word", F.col("p.id").alias("ids"), bytes_of.alias("decoded"))


_IDS = "block long, places binary, counts binary, ids binary, odd_place array<int>, odd_bytes array<binary>"


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, place, ids, odd) of many words as one row for each block."""
    for held in _held(batches):
        table = pa.Table.from_batches(held).combine_chunks()
        order = np.lexsort((table.column("place").to_numpy(), table.column("block").to_numpy()))
        table = table.take(pa.array(order))
        block = table.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        rows = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = table.slice(a, b - a).combine_chunks()
            ids = part.column("ids").chunk(0)
            odd = np.flatnonzero(part.column("odd").is_valid().to_numpy())
            place = part.column("place").to_numpy()
            rows.append(
                {
                    "block": int(block[a]),
                    "places": _press(place),
                    "counts": _press(np.diff(ids.offsets.to_numpy())),
                    "ids": _press(ids.flatten().to_numpy()),
                    "odd_place": place[odd].tolist(),
                    "odd_bytes": part.column("odd").take(pa.array(odd)).to_pylist(),
                }
            )
        schema = [("block", pa.int64())] + [(c, pa.binary()) for c in ("places", "counts", "ids")]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([*schema, ("odd_place", pa.list_(pa.int32())), ("odd_bytes", pa.list_(pa.binary()))]))


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= GROUPED:
            yield held
            held, n = [], 0
    if n:
        yield held


_ENCODED = "doc_id long, ids array<int>, decoded string"
_ENCODED_ARROW = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


def _assembled(blocks: pa.Table, found: pa.Table) -> pa.Table:
    """Texts of one block from its places and its words' ids and bytes."""
    out = []
    for row in blocks.to_pylist():
        length, body = _spelled(row)
        count, flat, changed = np.zeros(len(length), np.int64), [], {}
        start = np.zeros(len(length), np.int64)
        held = 0
        for part in found.to_pylist():
            at, n, ids = _loosen(part["places"]), _loosen(part["counts"]), _loosen(part["ids"])
            count[at], start[at] = n, held + _starts(n)
            flat.append(ids.astype(np.int32))
            held += len(ids)
            changed.update(zip(part["odd_place"], part["odd_bytes"], strict=True))
        flat = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        begin, spelled = _starts(length), np.frombuffer(body, np.uint8)
        if changed:  # words that decode to other bytes than their own
            tail = b"".join(changed.values())
            at, n = np.array(list(changed)), np.array([len(b) for b in changed.values()])
            length, begin = length.copy(), begin.copy()
            begin[at], length[at] = len(spelled) + _starts(n), n
            spelled = np.concatenate([spelled, np.frombuffer(tail, np.uint8)])
        places, sizes = _loosen(row["places"]), _loosen(row["sizes"])
        ends = np.cumsum(sizes)
        for a in range(0, len(sizes), TEXTS):
            ids, texts = [], []
            for k in range(a, min(a + TEXTS, len(sizes))):
                own = places[ends[k] - sizes[k] : ends[k]]
                ids.append(_gather(flat, start[own], count[own]))
                parts = [own[i : i + JOINED] for i in range(0, len(own), JOINED)]
                texts.append(b"".join(_gather(spelled, begin[p], length[p]).tobytes() for p in parts).decode(errors="replace"))
            offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
            out.append(pa.RecordBatch.from_arrays([pa.array(row["doc_id"][a : a + TEXTS], pa.int64()), lists, pa.array(texts, pa.string())], schema=_ENCODED_ARROW))
    return pa.Table.from_batches(out, _ENCODED_ARROW)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """Ids of each row of ``docs`` (doc_id, text) by the byte-level tokenizer of a file, and the text they decode to.

    ``docs`` is a table or a stored copy, whose rows a task that runs again
    finds in the same order. Null texts are empty and have no ids; ids may be
    null or repeated, each row has its own result; an empty table gives no
    rows; other columns are ignored.
    """
    blocks = _blocks(docs, path).repartition("block")
    words = blocks.mapInArrow(_exploded, "word string, block long, place int")
    words = words.filter("word is not null").repartition("word")
    same = F.col("decoded") == F.col("word").cast("binary")
    found = words.join(_word_table(words, path), "word").select(
        "block", "place", "ids", F.when(~same, F.col("decoded")).alias("odd")
    )
    found = found.mapInArrow(_by_block, _IDS)
    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_assembled, _ENCODED)

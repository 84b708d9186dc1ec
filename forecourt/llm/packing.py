"""Mixture-controlled packing of token streams into fixed windows.

Every source is a queue of tokens. Deficit round-robin gives each queue a
quantum per window in proportion to its target, lets it spend whole tokens and
carries the fraction over. Tokens may be cut anywhere, so the number of tokens
that a queue has spent after any number of windows has a closed form: the
window stream is split between two halves of the queues by a rounded share,
each half again, down to single queues. The remainder of each rounding is the
carried deficit; it stays below the depth of that tree. Any task can thus
enter the schedule at any window, and deficits carry across windows and
partitions without a sequential pass. Sources too many for the driver are dealt
to buckets by hash; the same tree goes on inside each bucket, on the executors.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from forecourt.llm import tokens
from forecourt.llm.common import stored

WINDOW = 2048
END_ID = 1

#: A source with at least this share of all tokens has a place of its own in the
#: driver's tree, so there are at most as many, and so has each source with a target.
#: All others are dealt to as many buckets, each with a tree of its sources.
OWN_QUEUE = 4096

#: Tokens of small sources whose pieces a task makes at once. A source with less than a token in a
#: window has a piece for each token.
CUT_TOKENS = 1 << 18

#: Documents, and bytes of their ids, that a task cuts together.
CUT_ROWS, CUT_BYTES = 1000, 1 << 22

#: Parts whose running totals one task adds up.
PART_BLOCK = 256

_STAGED = "part int, source string, doc_id long, n_tokens long, before long, ids binary"
_PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, source string"
)


def token_table(docs: DataFrame, tokenizer: str, end_id: int = END_ID, kept: int = tokens.KEPT) -> DataFrame:
    """Stored token ids of each row of ``docs`` (doc_id, text, source).

    ``part`` numbers the writing task, ``before`` the tokens of the same source
    that come earlier in it. A null text has only ``end_id``; a null source
    counts as the empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        end = end_id.to_bytes(4, "little")
        seen: dict[str, int] = {}
        for batch in batches:
            sources = [s or "" for s in batch.column("source").to_pylist()]
            counts, before, bodies = [], [], []
            for source, text in zip(sources, batch.column("text"), strict=True):
                body = tokens.encode(tokenizer, text.as_py() or "", kept) + end
                counts.append(len(body) // 4)
                before.append(seen.get(source, 0))
                seen[source] = before[-1] + counts[-1]
                bodies.append(body)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * len(sources), pa.int32()),
                    pa.array(sources, pa.string()),
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array(before, pa.int64()),
                    pa.array(bodies, pa.binary()),
                ],
                ["part", "source", "doc_id", "n_tokens", "before", "ids"],
            )

    narrow = docs.select("doc_id", F.col("text").cast("string"), F.col("source").cast("string"))
    return stored(narrow.mapInArrow(run, _STAGED))


Level = tuple[int, int, bool]


def _path(ends: list[int], at: int) -> list[Level]:
    """Splits from all queues down to queue ``at``: left half, both halves, is right.

    ``ends`` holds the running totals of the queues, from 0.
    """
    out = []
    low, high = 0, len(ends) - 1
    while high - low > 1:
        middle = low + (high - low) // 2
        right = at >= middle
        out.append((ends[middle] - ends[low], ends[high] - ends[low], right))
        low, high = (middle, high) if right else (low, middle)
    return out


@dataclass(frozen=True)
class Phase:
    """A stretch of the stream in which the same queues are served."""

    start: int
    total: int
    first: dict[int, int]  # queue: its first token here
    amount: dict[int, int]  # queue: its tokens here
    order: list[int]  # the queues, sorted
    ends: list[int]  # their running totals

    def path(self, queue: int) -> list[Level]:
        return _path(self.ends, bisect_left(self.order, queue))


def schedule(totals: list[int], weights: list[float] | None = None) -> list[Phase]:
    """Phases in which all queues are spent.

    Without weights the targets are the queues' own shares, and one phase ends
    them all. With weights a phase ends when a queue runs dry; the others go on
    in proportion. Queues of weight zero come last, by their own shares.
    """
    left = {q: n for q, n in enumerate(totals) if n}
    spent = dict.fromkeys(left, 0)
    start, out = 0, []
    while left:
        target = {q: Fraction(weights[q]) for q in left if weights[q] > 0} if weights else {}
        target = target or {q: Fraction(n) for q, n in left.items()}
        rounds = min(left[q] / w for q, w in target.items())
        amount = {q: int(w * rounds) for q, w in target.items()}
        amount = {q: n for q, n in amount.items() if n}
        order = sorted(amount)
        ends = list(accumulate((amount[q] for q in order), initial=0))
        total = ends[-1]
        out.append(Phase(start, total, {q: spent[q] for q in amount}, amount, order, ends))
        start += total
        for q, n in amount.items():
            spent[q] += n
            left[q] -= n
        left = {q: n for q, n in left.items() if n}
    return out


def _levels(paths: list[list[Level]], kind: type) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each level of all paths as arrays; levels past a path's end keep a place."""
    shape = max(map(len, paths), default=0), len(paths)
    left, both, right = np.ones(shape, kind), np.ones(shape, kind), np.zeros(shape, bool)
    for k, path in enumerate(paths):
        if path:
            left[: len(path), k], both[: len(path), k], right[: len(path), k] = zip(*path, strict=True)
    return list(zip(left, both, right, strict=True))


def _position(levels: list[tuple], i: np.ndarray) -> np.ndarray:
    """Place in the phase's stream of the queue's token ``i``."""
    for a, b, right in reversed(levels):
        if isinstance(right, np.ndarray):
            mine = np.where(right, b - a, a)
            i = np.where(right, i * b // mine, -(-(i + 1) * b // mine) - 1)
        else:
            i = i * b // (b - a) if right else -(-(i + 1) * b // a) - 1
    return i


def _share(levels: list[tuple], lo: np.ndarray, hi: np.ndarray) -> tuple:
    """Of the stream's [lo, hi): tokens of earlier queues, and the queue's own from and to."""
    ahead = lo * 0
    for a, b, right in levels:
        lo_left, hi_left = lo * a // b, hi * a // b
        if isinstance(right, np.ndarray):
            ahead = np.where(right, ahead + hi_left - lo_left, ahead)
            lo, hi = np.where(right, lo - lo_left, lo_left), np.where(right, hi - hi_left, hi_left)
        elif right:
            ahead = ahead + hi_left - lo_left
            lo, hi = lo - lo_left, hi - hi_left
        else:
            lo, hi = lo_left, hi_left
    return ahead, lo, hi


def _pieces(phase: Phase, window: int, levels: list[tuple], lo: np.ndarray, end: np.ndarray) -> Iterator[tuple]:
    """Row, token of the queue, length, window and offset of the pieces of [lo, end), for all rows at once.

    ``levels`` has numbers, for all rows, or arrays with a place for each.
    """
    row = np.arange(len(lo))
    while len(row):
        w = (phase.start + _position(levels, lo)) // window
        begin = np.maximum(w * window - phase.start, 0)
        stop = np.minimum((w + 1) * window - phase.start, phase.total)
        ahead, mine, until = _share(levels, begin, stop)
        until = np.minimum(end, until)
        yield row, lo, until - lo, w, phase.start + begin - w * window + ahead + lo - mine
        more = until < end
        row, lo, end = row[more], until[more], end[more]
        if levels and isinstance(levels[0][0], np.ndarray):
            levels = [tuple(x[more] for x in level) for level in levels]


def _kind(phases: list[Phase], window: int) -> type:
    size = sum(p.total for p in phases)
    return np.int64 if (size + window) ** 2 < 2**62 else object


def _in_order(pieces: list[np.ndarray]) -> np.ndarray:
    found = np.concatenate(pieces, axis=1) if pieces else np.zeros((5, 0), np.int64)
    return found[:, np.lexsort((found[1], found[0]))]


def cut(phases: list[Phase], window: int, queue: int, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Pieces of documents at [first, first + count) of a queue.

    Columns: row, start in the document, length, window, offset in the window.
    """
    kind = _kind(phases, window)
    out = []
    for phase in phases:
        if queue not in phase.amount:
            continue
        origin = phase.first[queue]
        lo = np.maximum(first - origin, 0).astype(kind)
        end = np.minimum(first + count - origin, phase.amount[queue]).astype(kind)
        live = np.flatnonzero(lo < end)
        if len(live):
            for row, at, length, w, offset in _pieces(phase, window, phase.path(queue), lo[live], end[live]):
                row = live[row]
                out.append(np.stack([row, at + origin - first[row], length, w, offset]).astype(np.int64))
    return _in_order(out)


def cut_small(
    phases: list[Phase], window: int, queue: np.ndarray, inner: list[list[Level]], first: np.ndarray, count: np.ndarray
) -> np.ndarray:
    """The same for rows of any queues that one phase, the last, spends whole, all rows at once.

    Of a source in a bucket, a row has the bucket's queue and the source's path inside; buckets have no target.
    """
    kind = _kind(phases, window)
    outer = {int(q): phases[-1].path(int(q)) for q in np.unique(queue)}
    levels = _levels([outer[q] + path for q, path in zip(queue.tolist(), inner, strict=True)], kind)
    out = []
    lo = first.astype(kind)
    for row, at, length, w, offset in _pieces(phases[-1], window, levels, lo, lo + count):
        out.append(np.stack([row, at - first[row], length, w, offset]).astype(np.int64))
    return _in_order(out)


_SMALL = "source string, bucket int, lefts array<long>, boths array<long>, rights array<boolean>"


def _bucket_paths(table: pa.Table) -> pa.Table:
    """Path of each source of one bucket through the tree of the bucket's sources."""
    table = table.sort_by("source")
    ends = list(accumulate(table.column("n").to_pylist(), initial=0))
    paths = [_path(ends, k) for k in range(len(table))]
    columns = [pa.array([[level[c] for level in path] for path in paths], pa.list_(t)) for c, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))]
    return pa.table([table.column("source"), table.column("bucket"), *columns], ["source", "bucket", "lefts", "boths", "rights"])


def queues(
    staged: DataFrame, targets: dict[str, float] | None = None
) -> tuple[dict[str, int], list[int], list[float] | None, DataFrame]:
    """Queue number of each source that has one; tokens and weight of each queue; the other sources.

    The last ``OWN_QUEUE`` queues are the buckets. The other sources' table has
    the bucket and the path inside it of each.
    """
    spark = staged.sparkSession
    per_source = stored(staged.groupBy("source").agg(F.sum("n_tokens").alias("n")))
    size = per_source.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    wanted = [(s,) for s, w in (targets or {}).items() if w > 0]
    own = per_source.filter(F.col("n") * OWN_QUEUE >= size)
    if wanted:
        own = own.union(per_source.join(spark.createDataFrame(wanted, "source string"), "source").select("source", "n")).distinct()
    own = own.orderBy("source").collect()
    number = {r.source: i for i, r in enumerate(own)}
    numbers = spark.createDataFrame([(s,) for s in number], "source string")
    others = per_source.join(numbers, "source", "left_anti").withColumn(
        "bucket", F.pmod(F.xxhash64("source"), F.lit(OWN_QUEUE)).cast("int")
    )
    totals = [r.n for r in own] + [0] * OWN_QUEUE
    for r in others.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        totals[len(own) + r.bucket] = r.n
    weights = None
    if targets is not None:
        weights = [float(targets.get(r.source, 0)) for r in own] + [0.0] * OWN_QUEUE
    return number, totals, weights, stored(others.groupBy("bucket").applyInArrow(_bucket_paths, _SMALL))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring batches as one, up to ``CUT_ROWS`` rows or ``CUT_BYTES`` bytes and a batch."""
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= CUT_ROWS or size >= CUT_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows, size = [], 0, 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _slices(batch: pa.RecordBatch, own: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows that hold ``CUT_TOKENS`` tokens of small sources at most, or one row of these."""
    begin = held = 0
    queue, count = batch.column("queue").to_numpy(), batch.column("n_tokens").to_numpy()
    for k, n in enumerate(np.where(queue < own, 0, count).tolist()):
        if k > begin and held + n > CUT_TOKENS:
            yield batch.slice(begin, k - begin)
            begin, held = k, 0
        held += n
    if batch.num_rows:
        yield batch.slice(begin)


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = WINDOW,
    end_id: int = END_ID,
    targets: dict[str, float] | None = None,
    kept: int = tokens.KEPT,
) -> DataFrame:
    """Pack every token of ``docs`` (doc_id, text, source) into windows, one row per piece.

    ``targets`` maps a source to its share of each window; without it a source's
    share is that of its tokens in the corpus. All windows but the last are full.
    ``kept`` bounds the words whose ids a worker keeps, and so its memory.
    Repeated rows, also of one doc_id, are packed as they come; null ids stay
    null; an empty table gives no rows; other columns are ignored.
    """
    staged = token_table(docs, tokenizer, end_id, kept)
    number, totals, weights, others = queues(staged, targets)
    phases = schedule(totals, weights)

    # Running totals of each source's parts, by blocks of parts, so that no task adds up all of them.
    spark = docs.sparkSession
    numbers = spark.createDataFrame([(s, q) for s, q in number.items()], "source string, own int")
    cells = (
        staged.groupBy("part", "source")
        .agg(F.sum("n_tokens").alias("n"))
        .withColumn("block", F.expr(f"part div {PART_BLOCK}"))
    )
    blocks = cells.groupBy("source", "block").agg(F.sum("n").alias("n"))
    earlier = W.rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(
        "source",
        "block",
        F.coalesce(F.sum("n").over(earlier.partitionBy("source").orderBy("block")), F.lit(0)).alias("block_at"),
    )
    inside = F.sum("n").over(earlier.partitionBy("source", "block").orderBy("part"))
    cells = stored(
        cells.withColumn("inside", F.coalesce(inside, F.lit(0)))
        .join(blocks, ["source", "block"])
        .join(numbers, "source", "left")
        .join(others, "source", "left")
        .select(
            "part",
            "source",
            F.coalesce("own", F.col("bucket") + len(number)).alias("queue"),
            (F.col("block_at") + F.col("inside")).alias("cell_at"),
            "lefts",
            "boths",
            "rights",
        )
    )
    # The stored cells' size is known, so Spark broadcasts them only below its threshold.
    placed = staged.join(cells, ["part", "source"]).select(
        "doc_id", "source", "queue", "lefts", "boths", "rights", (F.col("cell_at") + F.col("before")).alias("at"), "n_tokens", "ids"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in _joined(batches) for part in _slices(whole, len(number))):
            queue = batch.column("queue").to_numpy()
            at, count = batch.column("at").to_numpy(), batch.column("n_tokens").to_numpy()
            found = []
            # Without targets there is one phase, and all rows are cut together.
            for q in np.unique(queue[queue < len(number)]) if len(phases) > 1 else ():
                rows = np.flatnonzero(queue == q)
                part = cut(phases, window, int(q), at[rows], count[rows])
                part[0] = rows[part[0]]
                found.append(part)
            rows = np.flatnonzero((queue >= len(number)) | (len(phases) == 1))
            if len(rows):
                levels = (batch.column(c).take(pa.array(rows)).to_pylist() for c in ("lefts", "boths", "rights"))
                inner = [list(zip(*(level or [] for level in path), strict=True)) for path in zip(*levels, strict=True)]
                part = cut_small(phases, window, queue[rows], inner, at[rows], count[rows])
                part[0] = rows[part[0]]
                found.append(part)
            if not found:
                continue
            row, start, length, sequence, offset = np.concatenate(found, axis=1)
            ids = batch.column("ids")
            crc = np.zeros(len(row), np.int64)
            body, last = b"", -1
            for k, (r, s, n) in enumerate(zip(row.tolist(), start.tolist(), length.tolist(), strict=True)):
                if r != last:
                    body, last = memoryview(ids[r].as_buffer()), r
                crc[k] = zlib.crc32(body[4 * s : 4 * (s + n)])
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(take),
                    pa.array(start),
                    pa.array(length),
                    pa.array(crc),
                    pa.array(count[row]),
                    pa.array(sequence),
                    pa.array(offset),
                    batch.column("source").take(take),
                ],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"],
            )

    return placed.mapInArrow(run, _PIECES)

"""Near-duplicate detection with MinHash, banding and large-star/small-star components.

Documents with equal shingle sets are one class, and only its smallest doc_id
goes on. Classes that share a band of minima are candidates. Every member of a
bucket is compared with the bucket's smallest, which is linear in its size.
The components of these links leave few buckets with more than one; in those,
members outside the largest component meet the others by blocks, inside tasks
that send a link for each component found and never pairs. Signatures decide
which pairs are compared on their full sets; only these make links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from forecourt.llm.common import ascii_lower, stored, words

SHINGLE = 5
SIMILARITY = 0.8

#: A pair at similarity 0.8 shares no band with probability (1 - 0.8**6)**56, below 1e-7.
BANDS, ROWS = 56, 6
HASHES = BANDS * ROWS

#: Signatures keep one bit of each minimum. A pair goes on to its full sets unless
#: the bits agree less often than expected by this many standard deviations.
DEVIATIONS = 6.0

#: Bucket members compared in one task at a time.
BLOCK = 512

class _Hashes(dict):
    """64-bit hash by word; emptied when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 150_000:
            self.clear()
        digest = hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest()
        h = self[word] = int.from_bytes(digest, "little")
        return h


_known = _Hashes()


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted different 64-bit hashes of the runs of ``size`` words; of all words if there are fewer."""
    found = words(ascii_lower(text)) if text else []
    if not found:
        return np.zeros(0, np.uint64)
    n = max(1, len(found) - size + 1)
    values = np.fromiter(map(_known.__getitem__, found), np.uint64, len(found))
    out = np.full(n, len(found) if len(found) < size else size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(size, len(found))):
            out = (out ^ values[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(61)
    return draw.integers(1, 2**32, HASHES, np.uint32) | np.uint32(1), draw.integers(0, 2**32, HASHES, np.uint32)


_FACTOR, _ADD = _coefficients()


def minima(values: np.ndarray) -> np.ndarray:
    """Least value of each universal hash a x + b modulo 2^32 over the upper halves of ``values``."""
    short = (values >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(short), 512):
            part = _FACTOR[:, None] * short[None, at : at + 512]
            part += _ADD[:, None]
            np.minimum(out, part.min(axis=1), out=out)
    return out


def _bands(least: np.ndarray) -> np.ndarray:
    """64-bit key of each band."""
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for column in least.reshape(BANDS, ROWS).T:
            out = (out ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
    return out.view(np.int64)


def _bits(least: np.ndarray) -> bytes:
    """One mixed bit of each minimum."""
    return np.packbits((least * np.uint32(0x9E3779B1) >> np.uint32(31)).astype(np.uint8)).tobytes()


def _unpacked(column: pa.Array | pd.Series) -> np.ndarray:
    body = column.to_pylist() if isinstance(column, pa.Array) else column
    return np.frombuffer(b"".join(body), np.uint8).reshape(-1, HASHES // 8)


def _agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of equal bits."""
    return 1 - np.unpackbits(x ^ y, axis=-1).mean(axis=-1)


def _least_agreement(similarity: float) -> float:
    expected = (1 + similarity) / 2
    return expected - DEVIATIONS * (expected * (1 - expected) / HASHES) ** 0.5


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """Rows (doc_id, n_shingles, set_key, sign, bands): equal keys are equal sets; null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                values = shingles(text.as_py(), size)
                if not len(values):
                    rows.append((0, None, None, None))
                    continue
                least = minima(values)
                key = hashlib.blake2b(values.tobytes(), digest_size=16).digest()
                rows.append((len(values), key, _bits(least), _bands(least)))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "n_shingles", "set_key", "sign", "bands"],
            )

    schema = "doc_id long, n_shingles long, set_key binary, sign binary, bands array<long>"
    return _texts(docs).mapInArrow(run, schema)


def shingle_sets(rows: DataFrame, size: int) -> DataFrame:
    """Rows (id, body) with the sorted shingle hashes of rows (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [shingles(text.as_py(), size).tobytes() for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(bodies, pa.binary())], ["id", "body"])

    return rows.select("id", "text").mapInArrow(run, "id long, body binary")


def components(edges: DataFrame) -> DataFrame:
    """Rows (id, root) for all ends of ``edges`` (a, b): the smallest id of the connected component.

    Alternates large-star (larger neighbours go to the smallest one around) and
    small-star (smaller neighbours do) until nothing changes. Each step is an
    aggregate and a join on an id, so a star of any size is split by its leaves.
    """
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = stored(links.filter("a <> b").distinct())
    state = None
    while True:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        links = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        kept = F.when(F.col("b") != F.col("m"), F.col("b")).otherwise(F.col("a"))
        links = links.join(least, "a").select(kept.alias("a"), F.col("m").alias("b"))
        links = stored(links.filter("a <> b").distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return links.select(F.col("a").alias("id"), F.col("b").alias("root")).union(links.select("b", "b").distinct())


def _agreeing(pairs: DataFrame, signed: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b, share) whose set sizes and signatures allow the similarity."""
    least = _least_agreement(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share = _agreement(_unpacked(batch.column("sign_a")), _unpacked(batch.column("sign_b")))
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(share)], ["a", "b", "share"])
            yield out.filter(pa.array(share >= least))

    a = signed.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sign").alias("sign_a"))
    b = signed.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sign").alias("sign_b"))
    joined = pairs.join(a, "a").join(b, "b")
    joined = joined.filter(100 * F.least("n_a", "n_b") >= round(100 * similarity) * F.greatest("n_a", "n_b"))
    return joined.select("a", "b", "sign_a", "sign_b").mapInArrow(run, "a long, b long, share double")


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose full sets reach the similarity."""
    percent = round(100 * similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [
                _similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)
                for x, y in zip(batch.column("body_a"), batch.column("body_b"), strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    joined = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("body").alias("body_a")), "a")
    joined = joined.join(sets.select(F.col("id").alias("b"), F.col("body").alias("body_b")), "b")
    return joined.select("a", "b", "body_a", "body_b").mapInArrow(run, "a long, b long")


def _across(buckets: DataFrame, roots: DataFrame, signed: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Confirmed links (a, b) between different components of a bucket (id, band).

    Members outside the bucket's largest component meet all others, block by
    block. One link from a member to a component says all, so a block sends at
    most rows times components.
    """
    percent, least = round(100 * similarity), _least_agreement(similarity)
    rows = buckets.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    sizes = rows.groupBy("band", "root").agg(F.count("*").alias("members"))
    sizes = sizes.groupBy("band").agg(
        F.sum("members").alias("total"), F.max(F.struct("members", "root")).alias("largest"), F.count("*").alias("roots")
    )
    sizes = sizes.filter("roots > 1").select(
        "band", "total", F.col("largest.root").alias("main"), (F.col("total") - F.col("largest.members")).alias("outside")
    )
    rows = stored(rows.join(sizes, "band"))
    blocks = F.expr(f"cast((total + {BLOCK - 1}) div {BLOCK} as int)")
    left_blocks = F.expr(f"cast((outside + {BLOCK - 1}) div {BLOCK} as int)")
    mine, theirs = F.pmod(F.xxhash64("id"), blocks).cast("int"), F.pmod(F.xxhash64("id"), left_blocks).cast("int")
    all_left = F.explode(F.sequence(F.lit(0), left_blocks - 1)).alias("l")
    all_right = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("r")
    right = rows.select("band", "id", "root", F.lit(False).alias("is_left"), mine.alias("r"), all_left)
    left = rows.filter("root <> main").select("band", "id", "root", F.lit(True).alias("is_left"), all_right, theirs.alias("l"))
    both = right.unionByName(left).join(signed.select("id", "n", "sign"), "id").join(sets, "id")

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        left, right = part[part["is_left"]], part[~part["is_left"]]
        out = []
        if len(left) and len(right):
            signs, bodies = _unpacked(right["sign"]), right["body"].to_numpy()
            ids, roots_, sizes_ = right["id"].to_numpy(), right["root"].to_numpy(), right["n"].to_numpy()
            for x, root, n, sign, body in left[["id", "root", "n", "sign", "body"]].itertuples(index=False):
                fits = 100 * np.minimum(sizes_, n) >= percent * np.maximum(sizes_, n)
                fits = np.flatnonzero(fits & (roots_ != root))
                share = _agreement(signs[fits], np.frombuffer(sign, np.uint8))
                mine, done = np.frombuffer(body, np.uint64), set()
                for k in fits[np.argsort(-share, kind="stable")][: int((share >= least).sum())]:
                    if roots_[k] not in done and _similar(mine, np.frombuffer(bodies[k], np.uint64), percent):
                        done.add(roots_[k])
                        out.append((x, int(ids[k])))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return both.groupBy("band", "r", "l").applyInPandas(meet, "a long, b long").distinct()


def links(signed: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """Confirmed links (a, b) that connect the same rows of ``signed`` (id, n, sign, bands) as all links do."""
    flat = signed.select("id", F.posexplode("bands").alias("k", "key"))
    flat = flat.select("id", F.xxhash64("k", "key").alias("band"))
    shared = flat.groupBy("band").agg(F.min("id").alias("a"), F.count("*").alias("members")).filter("members > 1")
    shared = stored(flat.join(shared, "band"))
    ids = stored(shared.select("id").distinct())
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(ids, "id", "left_semi").dropDuplicates(["id"])
    sets = stored(shingle_sets(texts, size))

    stars = shared.filter("id <> a").select("a", F.col("id").alias("b")).distinct()
    stars = stored(_agreeing(stars, signed, similarity))
    # One link a row connects nearly all; the others are compared where it did not.
    best = stars.groupBy("b").agg(F.max_by("a", F.struct("share", -F.col("a"))).alias("a"))
    first = stored(_confirmed(best, sets, similarity))
    roots = stored(components(first))
    of_a = roots.select(F.col("id").alias("a"), F.col("root").alias("root_a"))
    of_b = roots.select(F.col("id").alias("b"), F.col("root").alias("root_b"))
    apart = stars.join(of_a, "a", "left").join(of_b, "b", "left")
    apart = apart.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
    second = stored(first.union(_confirmed(apart, sets, similarity)))
    roots = stored(components(second))
    # The only pair of a bucket of two has been compared.
    larger = shared.filter("members > 2").select("id", "band")
    return second.union(_across(larger, roots, signed, sets, similarity))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id) of each row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id that links of at least the
    similarity (in whole hundredths) reach. Null, empty and wordless texts have
    an empty set and stand alone. Rows of one doc_id are in one component with
    all that any of their texts links to. Rows without an id have no component
    and link nothing. Other columns are ignored.
    """
    rows = _texts(docs)
    signed = stored(signatures(rows, size))
    named = signed.filter("doc_id is not null")
    several = named.groupBy("doc_id").agg(F.count_distinct(F.coalesce("set_key", F.lit(b""))).alias("n")).filter("n > 1")
    if several.limit(1).count():
        return _by_row(rows, size, similarity)
    some = named.filter("set_key is not null")
    classes = stored(some.groupBy("set_key").agg(F.min("doc_id").alias("id")))
    chosen = some.join(classes, "set_key").filter("doc_id = id").dropDuplicates(["id"])
    chosen = stored(chosen.select("id", F.col("n_shingles").alias("n"), "sign", "bands"))
    roots = stored(components(links(chosen, rows, size, similarity)))
    classes = classes.join(roots, "id", "left").select("set_key", F.coalesce("root", "id").alias("root"))
    found = signed.select("doc_id", "n_shingles", "set_key").join(classes, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"))


def _by_row(rows: DataFrame, size: int, similarity: float) -> DataFrame:
    """For ids that carry several texts: rows get numbers, which are linked first and ids by them."""
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
    none = signatures(rows.filter("doc_id is null"), size).select("doc_id", "n_shingles", F.lit(None).cast("long"))
    rows = rows.filter("doc_id is not null")
    found = near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"), size, similarity)
    found = stored(rows.drop("text").join(found.withColumnRenamed("doc_id", "row"), "row"))
    least = found.groupBy("component_id").agg(F.min("doc_id").alias("b"))
    roots = components(found.join(least, "component_id").select(F.col("doc_id").alias("a"), "b"))
    found = found.drop("component_id").join(roots.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id")).union(none)


def keep_one(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each component of near-duplicates, that of the smallest doc_id; columns as they are.

    Of several rows of that id one stays; rows without an id all stay.
    """
    found = near_duplicates(docs, size, similarity).filter("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(stored(found), "doc_id", "left_semi").select(docs.columns)
    return kept.dropDuplicates(["doc_id"]).union(docs.filter("doc_id is null"))

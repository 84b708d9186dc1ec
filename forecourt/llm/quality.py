"""Quality rules whose cutoffs come from labelled documents with a bounded risk.

Each rule rejects a document if a measure reaches a cutoff. For every stratum
(language) and rule the cutoffs are tested from the loosest to the strictest:
a cutoff passes if, were the share of good documents that it rejects above the
allowed risk, as few rejections as were seen would have had a probability of
at most ``error`` over the number of strata and rules (exact binomial tail,
Bonferroni). The first failure ends the sequence, which needs no further
correction along it. Of the cutoffs that pass, the rule takes the one that
gains most: rejected bad less rejected good.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forecourt.llm.common import SPACE, free_name, stored, words

#: Share of good documents that all rules together may reject in a stratum, and
#: the probability that any stratum exceeds it.
RISK = 0.02
ERROR = 0.05

#: Steps of every measure: cutoffs are 1 to STEPS, 0 rejects nothing.
STEPS = 200

STATS = T.StructType(
    [
        T.StructField(c, T.LongType(), False)
        for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    ]
)

_NO_SYMBOL = re.compile(r"[^#*$%&|<>]+")


def text_stats(text: str | None) -> tuple[int, ...]:
    """Counts of one text, in the order of ``STATS``. Lines without a word don't count."""
    found = words(text)
    n = len(found)
    if not n:
        return (0, 0, 0, 0, 0, 0)
    lines = [line for line in text.split("\n") if line.strip(SPACE)] if "\n" in text else [text]
    repeated = 0
    triples = list(zip(found, found[1:], found[2:], strict=False))
    times = Counter(triples)
    if len(times) < len(triples):
        reach = 0  # words up to here are counted
        for i, triple in enumerate(triples):
            if times[triple] > 1:
                repeated += i + 3 - max(i, reach)
                reach = i + 3
    return (n, sum(map(len, found)), len(_NO_SYMBOL.sub("", text)), len(lines), len(lines) - len(set(lines)), repeated)


def with_stats(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a struct column ``name`` of the counts of its text."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, STATS, False)])
    kinds = pa.struct([pa.field(f.name, pa.int64(), False) for f in STATS.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_stats(text.as_py()) for text in batch.column("text")]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * len(kinds)
            stats = pa.StructArray.from_arrays(columns, fields=list(kinds))
            yield pa.RecordBatch.from_arrays([*batch.columns, stats], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def base_failed(stats: str) -> Column:
    s = F.col(stats)
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def measures(stats: str) -> dict[str, Column]:
    """Each rule's measure, 0 to ``STEPS``; more is worse."""
    s = F.col(stats)

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, F.least(F.expr("1L") * F.floor(part * STEPS / whole), F.lit(STEPS))).otherwise(0)

    length = F.when(s["n_words"] > 0, s["word_chars"] / s["n_words"]).otherwise(5.0)
    return {
        "symbols": share(s["n_symbols"], s["word_chars"]),
        "repeated_lines": share(s["n_dup_lines"], s["n_lines"]),
        "repeated_words": share(s["n_repeat_words"], s["n_words"]),
        "long_words": F.least(F.floor(length * 4), F.lit(STEPS)),
        "short_words": F.floor(F.lit(STEPS) / (1 + length)),
    }


def chance_of_fewer(seen: int, n: int, risk: float) -> float:
    """P(at most ``seen`` of ``n``) if each has probability ``risk``."""
    if seen >= n:
        return 1.0
    k = np.arange(seen + 1)
    steps = np.log(n - k[:-1]) - np.log(k[:-1] + 1) + math.log(risk) - math.log1p(-risk)
    logs = n * math.log1p(-risk) + np.concatenate([[0.0], np.cumsum(steps)])
    top = logs.max()
    return min(1.0, math.exp(top) * float(np.exp(logs - top).sum()))


def choose(good: np.ndarray, bad: np.ndarray, risk: float, error: float) -> int:
    """Cutoff for counts of good and bad documents by measure 0..STEPS; 0 if none passes."""
    n, n_bad = int(good.sum()), int(bad.sum())
    if not n or not n_bad:
        return 0
    over_good, over_bad = good[::-1].cumsum()[::-1], bad[::-1].cumsum()[::-1]
    best, gain = 0, 0.0
    for cutoff in range(STEPS, 0, -1):
        if chance_of_fewer(int(over_good[cutoff]), n, risk) > error:
            break
        now = over_bad[cutoff] / n_bad - over_good[cutoff] / n
        if now > gain:
            best, gain = cutoff, now
    return best


def cutoffs(labelled: DataFrame, stats: str, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Cutoffs by stratum, as rows (stratum, one column a rule), from rows (stratum, quality, stats).

    Documents that the base rules reject are no evidence, and rows must be
    independent draws: one for each different text (``evidence``). A stratum
    without enough of them to prove a cutoff has zeros, which reject nothing.
    """
    rules = measures(stats)
    rows = labelled.filter(~base_failed(stats) & F.col("quality").isin(0, 1))
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), m.cast("int").alias("value")) for r, m in rules.items()]))
    counts = rows.select("stratum", "quality", pairs.alias("p")).groupBy("stratum", "p.rule", "p.value")
    counts = stored(counts.agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad")))
    strata = counts.select("stratum").distinct().count()
    allowed, level = risk / len(rules), error / max(1, strata * len(rules))

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        good, bad = np.zeros(STEPS + 1, np.int64), np.zeros(STEPS + 1, np.int64)
        good[part["value"]], bad[part["value"]] = part["good"], part["bad"]
        return pd.DataFrame({"stratum": [key[0]], "rule": [key[1]], "cutoff": [choose(good, bad, allowed, level)]})

    # A group has at most STEPS + 1 rows.
    chosen = counts.groupBy("stratum", "rule").applyInPandas(one, "stratum string, rule string, cutoff int")
    return stored(chosen.groupBy("stratum").pivot("rule", list(rules)).agg(F.max("cutoff")))


def evidence(labelled: DataFrame, stats: str) -> DataFrame:
    """Rows (stratum, quality, stats) of labelled documents (digest of the text, stratum, quality, stats), one for each different text.

    Repeated rows of a document and copies under several ids say nothing new;
    the copies count as bad if any of them does.
    """
    one = labelled.groupBy("stratum", "digest")
    return one.agg(F.min("quality").alias("quality"), F.min(stats).alias(stats)).drop("digest")


def stratum(docs: DataFrame) -> Column:
    return F.coalesce(docs["lang"].cast("string"), F.lit(""))


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> tuple[DataFrame, str, str, str]:
    """Stored ``docs`` (doc_id, text, lang, ...) with stats, ``base_failed`` and ``kept``; and these columns' names.

    Labels that disagree on a document or on copies of a text count as bad;
    null labels and labels of other documents are ignored. A text is evidence
    once, however many rows and ids it has. Null texts have no words; a null
    lang is a stratum of its own. Repeated rows are judged alike.
    """
    stats, failed, kept = (free_name(docs, c) for c in ("text_stats", "base_failed", "kept"))
    rows = stored(with_stats(docs, stats))
    truth = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    digest = F.sha2(F.col("text").cast("string"), 256).alias("digest")
    known = rows.select("doc_id", digest, stratum(rows).alias("stratum"), stats).join(truth, "doc_id")
    limits = cutoffs(evidence(known, stats), stats, risk, error)
    limit, mark = free_name(rows, "limits"), free_name(rows, "limit_stratum")
    limits = limits.select(
        F.col("stratum").alias(mark), F.struct(*[c for c in limits.columns if c != "stratum"]).alias(limit)
    )
    rejected = F.lit(False)
    for rule, measure in measures(stats).items():
        cutoff = F.coalesce(F.col(limit)[rule], F.lit(0))
        rejected = rejected | ((cutoff > 0) & (measure >= cutoff))
    judged = rows.join(limits, stratum(rows) == limits[mark], "left")
    judged = judged.withColumn(failed, base_failed(stats)).withColumn(kept, ~F.col(failed) & ~rejected)
    return judged.drop(limit, mark), stats, failed, kept


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Rows of ``docs`` that pass; columns as they are."""
    judged, _, _, kept = judge(docs, labels, risk, error)
    return judged.filter(F.col(kept)).select(*docs.columns)

"""Exact order statistics per group without holding a group in one task.

Rows shrink to (group, value, count) first. A rank is then found in two steps:
which block of neighbouring values holds it, and where in that block. A group
of 32-bit integers has at most 65,536 blocks and a block at most 65,536 values,
so no window ever sorts more than that, however many rows share a group. Wider
numbers have blocks of nearly equal values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLOCK_BITS = 16
_SMALL_INTS = ("tinyint", "smallint", "int")


def value_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by..., value, n) for values that are neither null nor NaN."""
    present = F.col(value).isNotNull()
    if dict(df.dtypes).get(value) in ("float", "double"):
        present = present & ~F.isnan(value)
    return (
        df.filter(present)
        .groupBy(*by, F.col(value).alias("value"))
        .agg(F.count("*").alias("n"))
    )


def same_group(left: str, right: str, by: Sequence[str]) -> Column:
    """Null-safe equality of the grouping columns of two aliased frames."""
    cond = F.lit(True)
    for c in by:
        cond = cond & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return cond


def _block(kind: str) -> Column:
    """Number of a value's block; larger values never have smaller numbers.

    32-bit integers have blocks of 65,536 neighbours. Blocks of other numbers
    hold values within a factor of about 1.003, or below a millionth; they are
    at most 22,000 for bigint and 270,000 for double.
    """
    v = F.col("value")
    if kind in _SMALL_INTS:
        return F.shiftright(v, _BLOCK_BITS)
    v = v.cast("double")
    return F.floor(F.signum(v) * F.log2(F.abs(v) * F.lit(2.0**20) + F.lit(1.0)) * F.lit(256.0))


def values_at_ranks(
    counts: DataFrame, by: Sequence[str], ranks: Mapping[str, Column]
) -> DataFrame:
    """The values at zero-based ranks of each group.

    ``counts`` has the columns (by..., value, n). A rank is a column over
    ``total``, the rows of the group. The result has (by..., total) and one
    column per rank.
    """
    by = list(by)
    block = _block(dict(counts.dtypes)["value"]).alias("block")
    per_block = counts.groupBy(*by, block).agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*(by or [F.lit(0)]))
    upto = group.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    targets = F.array(
        *[F.struct(F.lit(k).alias("name"), r.cast("bigint").alias("rank")) for k, r in ranks.items()]
    )

    def held(upto: str) -> Column:
        """The targets that fall on the rows before ``upto`` but not before those of this row."""
        last = F.col(upto)
        return F.filter("targets", lambda t: t["rank"].between(last - F.col("n"), last - 1))

    hits = (
        per_block.withColumn("total", F.sum("n").over(group))
        .withColumn("block_upto", F.sum("n").over(upto))
        .withColumn("targets", targets)
        .withColumn("targets", held("block_upto"))
        .filter(F.size("targets") > 0)
        .select(*by, "block", "total", "targets", (F.col("block_upto") - F.col("n")).alias("skipped"))
    )
    inside = Window.partitionBy(*by, "block").orderBy("value")
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = (
        counts.withColumn("block", block)
        .alias("c")
        .join(
            hits.alias("h"),
            # Null-safe, so that no not-null test slips under the shared count
            # and the planner reuses its shuffle.
            same_group("c", "h", [*by, "block"]),
        )
        .select(*[f"c.{k}" for k in by], "c.block", "c.value", "c.n", "h.total", "h.targets", "h.skipped")
        .withColumn("value_upto", F.sum("n").over(inside) + F.col("skipped"))
        .select(*by, "value", "total", F.explode(held("value_upto")).alias("t"))
    )
    return found.groupBy(*by).agg(
        F.max("total").alias("total"),
        *[F.max(F.when(F.col("t.name") == k, F.col("value"))).alias(k) for k in ranks],
    )


def quantiles_of_counts(
    counts: DataFrame, by: Sequence[str], probs: Mapping[str, float]
) -> DataFrame:
    """Interpolated quantiles per group: (by..., total, one column per name)."""
    position = {k: F.lit(float(p)) * (F.col("total") - 1) for k, p in probs.items()}
    ranks = {}
    for k, pos in position.items():
        ranks[f"_lo_{k}"] = F.floor(pos)
        ranks[f"_hi_{k}"] = F.ceil(pos)
    at = values_at_ranks(counts, by, ranks)
    out = []
    for k, pos in position.items():
        lo, hi = F.col(f"_lo_{k}").cast("double"), F.col(f"_hi_{k}").cast("double")
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(k))
    return at.select(*by, "total", *out)


def quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float]
) -> DataFrame:
    """Exact interpolated quantiles of a numeric column per group."""
    return quantiles_of_counts(value_counts(df, by, value), by, probs)


def box_stats(
    df: DataFrame, by: str | Sequence[str], value: str, approx: int | None = None
) -> DataFrame:
    """Quartiles, whiskers (1.5 IQR) and outlier count of ``value`` per group.

    ``approx`` takes quartiles from a sketch of that accuracy, which tasks fill
    and merge; whiskers and outliers then come from a second pass over the rows
    beside their group's fences. No values are shuffled, but for an error of a
    quartile's rank of one in ``approx``.
    """
    by = [by] if isinstance(by, str) else list(by)
    if approx is None:
        counts = value_counts(df, by, value)
        quartiles = quantiles_of_counts(counts, by, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    else:
        present = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        counts = present.select(*by, F.col(value).alias("value"), F.lit(1).alias("n"))
        quartiles = (
            present.groupBy(*by)
            .agg(
                F.count("*").alias("total"),
                F.percentile_approx(value, [0.25, 0.5, 0.75], approx).alias("q"),
            )
            .select(
                *by,
                "total",
                *[F.col("q")[i].cast("double").alias(k) for i, k in enumerate(("q1", "median", "q3"))],
            )
        )
    iqr = F.col("q3") - F.col("q1")
    fences = quartiles.withColumn("low_fence", F.col("q1") - 1.5 * iqr).withColumn(
        "high_fence", F.col("q3") + 1.5 * iqr
    )
    inside = F.col("c.value").between(F.col("q.low_fence"), F.col("q.high_fence"))
    joined = counts.alias("c").join(fences.alias("q"), same_group("c", "q", by))
    return (
        joined.groupBy(*[F.col(f"q.{k}").alias(k) for k in by])
        .agg(
            F.max("q.total").alias("n"),
            *[F.max(f"q.{k}").alias(k) for k in ("q1", "median", "q3")],
            F.min(F.when(inside, F.col("c.value"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("c.value"))).alias("whisker_high"),
            F.sum(F.when(inside, F.lit(0)).otherwise(F.col("c.n"))).alias("n_outliers"),
        )
        .orderBy(*by)
    )

"""Dummies in long form: a table row for each level, however many there are, and no column.

Every statistic of a dummy follows from its rows' count and the sums over them,
so a column is grouped by its levels once, and no level comes to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt.functions.columns import correlation
from forecourt.functions.frames import beside, stored


def level_stats(df: DataFrame, col: str, values: Sequence[str] = ()) -> DataFrame:
    """(level, n) and, for each value k, the count, mean and variance of its known rows: n_k, mean_k, var_k.

    The null level is left in; it has no dummy, but its rows count.
    """
    aggs = [F.count("*").alias("n")]
    for k, v in enumerate(values):
        x = F.col(f"`{v}`").cast("double")
        aggs += [F.count(x).alias(f"n_{k}"), F.avg(x).alias(f"mean_{k}"), F.var_pop(x).alias(f"var_{k}")]
    return df.groupBy(F.col(f"`{col}`").alias("level")).agg(*aggs)


def without_base(levels: DataFrame, base: object = None) -> DataFrame:
    """Rows (level, n, ...) that have a dummy: not the null level, and not the base, by default the rarest level.

    Of equally rare levels the last is the base.
    """
    known = levels.filter(F.col("level").isNotNull())
    if base is not None:
        return known.filter(F.col("level") != F.lit(base))
    rarest = known.orderBy("n", F.desc("level")).limit(1).select(F.col("level").alias("_base"))
    return known.join(F.broadcast(rarest), F.col("level") == F.col("_base"), "left_anti")


def dummy_totals(df: DataFrame, col: str, prefix: str | None = None, base: object = None) -> DataFrame:
    """(feature, n): the rows of each dummy of a column."""
    prefix = f"{col}_" if prefix is None else prefix
    return without_base(level_stats(df, col), base).select(F.concat(F.lit(prefix), F.col("level")).alias("feature"), "n")


def _totals(levels: DataFrame, values: int) -> DataFrame:
    """Of each value k, count, mean and sum of squares around it over all levels, as one row (all_n_k, all_mean_k, all_cross_k)."""
    middle, aggs = [], []
    for k in range(values):
        n, mean, var = F.col(f"n_{k}"), F.col(f"mean_{k}"), F.col(f"var_{k}")
        gap = mean - F.col(f"all_mean_{k}")
        middle.append(F.try_divide(F.sum(n * mean), F.sum(n)).alias(f"all_mean_{k}"))
        aggs.append(F.coalesce(F.sum(n), F.lit(0)).alias(f"all_n_{k}"))
        aggs.append(F.max(f"all_mean_{k}").alias(f"all_mean_{k}"))
        aggs.append(F.sum(n * (var + gap * gap)).alias(f"all_cross_{k}"))
    return beside(levels, levels.agg(*middle)).agg(*aggs)


def _with_value(k: int) -> Column:
    """Pearson r of a level's dummy and value k, from the level's row and the totals; null where one is constant."""
    n = F.col(f"n_{k}").cast("double")
    spread = F.sqrt(n * (1 - F.try_divide(n, F.col(f"all_n_{k}"))) * F.col(f"all_cross_{k}"))
    return F.try_divide(n * (F.col(f"mean_{k}") - F.col(f"all_mean_{k}")), spread)


def correlation_with_levels(
    df: DataFrame, label: str, col: str, prefix: str | None = None, base: object = None
) -> DataFrame:
    """Pearson r of each dummy of a column with the label, as (feature, r), over the rows whose label is known."""
    prefix = f"{col}_" if prefix is None else prefix
    levels = stored(level_stats(df, col, [label]))
    rows = beside(without_base(levels, base), _totals(levels, 1))
    return rows.select(F.concat(F.lit(prefix), F.col("level")).alias("feature"), _with_value(0).alias("r"))


def correlation_matrix(
    df: DataFrame,
    numerics: Sequence[str],
    categoricals: Sequence[str],
    label: str,
    bases: dict[str, object] | None = None,
) -> DataFrame:
    """Pearson r of every pair of columns, dummies included, as (i, j, r) rows.

    Each pair uses the rows where both are present; a null level has zeros in
    all its dummies. The base level defaults to the rarest one.
    """
    values, bases = [*numerics, label], bases or {}
    cols = [F.col(f"`{v}`").cast("double").alias(f"x{k}") for k, v in enumerate(values)]
    few = [(a, b) for a in range(len(values)) for b in range(a, len(values))]
    one = df.select(*cols).agg(*[correlation(F.col(f"x{a}"), F.col(f"x{b}")).alias(f"r{a}_{b}") for a, b in few])
    cells = [(i, j, a, b) for a, b in few for i, j in {(values[a], values[b]), (values[b], values[a])}]
    cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"r{a}_{b}").alias("r")) for i, j, a, b in cells]
    parts = [one.select(F.inline(F.array(*cells)))]

    size = df.agg(F.count("*").cast("double").alias("size"))
    dummies = {}
    for c in categoricals:
        levels = stored(level_stats(df, c, values))
        named = without_base(levels, bases.get(c)).withColumn("feature", F.concat(F.lit(f"{c}_"), F.col("level")))
        named = stored(beside(beside(named, _totals(levels, len(values))), size))
        dummies[c] = named.select("level", "feature", F.col("n").cast("double").alias("n"), "size")
        cells = [(F.col("feature"), F.lit(v), _with_value(k)) for k, v in enumerate(values)]
        cells += [(j, i, r) for i, j, r in cells]
        parts.append(named.select(F.inline(F.array(*[F.struct(i.alias("i"), j.alias("j"), r.alias("r")) for i, j, r in cells]))))
    for c in categoricals:
        for d in categoricals:
            left = dummies[c].select(F.col("level").alias("a"), F.col("feature").alias("i"), F.col("n").alias("n_i"), "size")
            right = dummies[d].select(F.col("level").alias("b"), F.col("feature").alias("j"), F.col("n").alias("n_j"))
            # The matrix has a row for each pair of levels, also of those that no row shares.
            pairs = left.crossJoin(right)
            if c == d:
                both = F.when(F.col("i") == F.col("j"), F.col("n_i")).otherwise(0.0)
            else:
                shared = df.groupBy(F.col(f"`{c}`").alias("a"), F.col(f"`{d}`").alias("b")).agg(F.count("*").cast("double").alias("shared"))
                pairs, both = pairs.join(shared, ["a", "b"], "left"), F.coalesce("shared", F.lit(0.0))
            n, a, b = F.col("size"), F.col("n_i"), F.col("n_j")
            r = F.try_divide(both * n - a * b, F.sqrt(a * (n - a)) * F.sqrt(b * (n - b)))
            parts.append(pairs.select("i", "j", r.alias("r")))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.orderBy("i", "j")

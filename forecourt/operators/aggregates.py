"""Group counts, shares, top-k, histograms and skewness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt.functions.columns import correlation, ratio
from forecourt.functions.frames import beside
from forecourt.operators.cleaning import sold

_STATS = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


def order_by(df: DataFrame, *cols: str) -> DataFrame:
    """Global sort; meant for small, aggregated results."""
    return df.orderBy(*cols)


def order_desc(df: DataFrame, col: str, *ties: str) -> DataFrame:
    """Largest first, ties by the named columns upward."""
    return df.orderBy(F.desc(col), *ties)


def group_stat(
    df: DataFrame,
    by: str,
    values: str | Sequence[str],
    stat: str = "avg",
    bucket: int | None = None,
) -> DataFrame:
    """``stat`` of each value per level of ``by``, sorted by level.

    ``bucket`` first rounds a numeric ``by`` down to a multiple, which keeps a
    result over many distinct levels small.
    """
    values = [values] if isinstance(values, str) else list(values)
    level = F.col(by)
    if bucket is not None:
        level = (F.floor(level / F.lit(bucket)) * bucket).cast("int")
    return (
        df.groupBy(level.alias(by))
        .agg(*[_STATS[stat](v).alias(f"{stat}_{v}") for v in values], F.count("*").alias("n"))
        .orderBy(by)
    )


def count_by(df: DataFrame, *by: str) -> DataFrame:
    """Rows per group, largest first."""
    return order_desc(df.groupBy(*by).agg(F.count("*").alias("num")), "num", *by)


def count_by_make(df: DataFrame) -> DataFrame:
    """Sold quotes per make."""
    return count_by(sold(df), "make")


def make_model_key() -> Column:
    """Make and model in one string; null if either is."""
    return F.concat(F.col("make"), F.lit("_"), F.col("model"))


def count_by_make_model(df: DataFrame) -> DataFrame:
    """Sold quotes per make and model."""
    return count_by(sold(df).select(make_model_key().alias("make_model")), "make_model")


def top_k(df: DataFrame, by: str, value: str, k: int, stat: str = "sum") -> DataFrame:
    """The ``k`` groups with the largest ``stat`` of ``value``."""
    name = f"{stat}_{value}"
    grouped = df.groupBy(by).agg(_STATS[stat](value).alias(name))
    return grouped.orderBy(F.desc(name), by).limit(k)


def share(df: DataFrame, by: str, top: int | None = None) -> DataFrame:
    """Rows per group and their part of all rows, largest first; ``top`` keeps the first few."""
    counts = df.groupBy(by).agg(F.count("*").alias("n"))
    with_total = beside(counts, counts.agg(F.sum("n").alias("total")))
    fraction = ratio(F.col("n"), F.col("total")).alias("fraction")
    ranked = order_desc(with_total.select(by, "n", fraction), "n", by)
    return ranked if top is None else ranked.limit(top)


def without_sale(df: DataFrame, by: str | Sequence[str] = "make") -> DataFrame:
    """Groups with inquiries and no sale, from one grouped count."""
    by = [by] if isinstance(by, str) else list(by)
    return (
        df.groupBy(*by)
        .agg(
            F.count("*").alias("num_inquiries"),
            F.count_if(F.col("expected_margin") != 0).alias("n_sold"),
        )
        .filter("n_sold = 0")
        .drop("n_sold")
        .orderBy(*by)
    )


def histogram(
    df: DataFrame,
    col: str,
    bins: int = 20,
    lo: float | None = None,
    hi: float | None = None,
) -> DataFrame:
    """Equal-width bins (bin, lo, hi, n), empty ones included; the last bin holds its upper edge.

    The range defaults to the smallest and largest value. Rows shrink to
    (value, count) first; range and bins both read that, so the source is
    scanned once. Values outside a given range, nulls and NaN are left out.
    """
    x = F.col(col).cast("double")
    rows = df.filter(x.isNotNull() & ~F.isnan(x))
    if lo is not None:
        rows = rows.filter(x >= float(lo))
    if hi is not None:
        rows = rows.filter(x <= float(hi))
    # The count test is always true; it keeps the count in both branches below,
    # so the planner computes this shuffle once and reuses it.
    counts = rows.groupBy(x.alias("x")).agg(F.count("*").alias("n")).filter(F.col("n") > 0)
    edges = counts.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).select(
        (F.col("lo") if lo is None else F.lit(float(lo))).alias("lo"),
        (F.col("hi") if hi is None else F.lit(float(hi))).alias("hi"),
    )
    w = (F.col("hi") - F.col("lo")) / F.lit(bins)
    place = F.least(F.floor(F.try_divide(F.col("x") - F.col("lo"), w)), F.lit(bins - 1))
    filled = (
        beside(counts, edges)
        .groupBy(F.coalesce(place, F.lit(0)).cast("int").alias("bin"))
        .agg(F.sum("n").alias("n"))
    )
    frame = edges.filter(F.col("lo").isNotNull()).select(
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", "hi"
    )
    return (
        frame.join(filled, "bin", "left")
        .select(
            "bin",
            (F.col("lo") + F.col("bin") * w).alias("lo"),
            F.when(F.col("bin") == bins - 1, F.col("hi"))
            .otherwise(F.col("lo") + (F.col("bin") + 1) * w)
            .alias("hi"),
            F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"),
        )
        .orderBy("bin")
    )


def _unpivot(one_row: DataFrame, names: Sequence[str], key: str, value: str) -> DataFrame:
    """A one-row frame with a column per name, as (key, value) rows."""
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    return one_row.selectExpr(f"stack({len(names)}, {pairs}) as ({key}, {value})")


def skewness_table(df: DataFrame, cols: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Population skewness per column, flagged where its size is above ``threshold``."""
    one = df.agg(*[F.skewness(c).alias(c) for c in cols])
    return (
        _unpivot(one, cols, "feature", "skewness")
        .withColumn("is_skewed", F.abs("skewness") > threshold)
        .orderBy("feature")
    )


def correlation_with(df: DataFrame, label: str, cols: Sequence[str]) -> DataFrame:
    """Pearson r of each column with the label, largest first; null for a constant column."""
    one = df.agg(*[correlation(F.col(f"`{c}`"), F.col(f"`{label}`")).alias(c) for c in cols])
    return _unpivot(one, cols, "feature", "r").orderBy(F.desc_nulls_last("r"), "feature")

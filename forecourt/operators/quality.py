"""Data checks, duplicates, outliers and imputation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forecourt.functions.frames import beside, lookup_where
from forecourt.operators.aggregates import _unpivot
from forecourt.operators.quantiles import (
    quantiles,
    quantiles_of_counts,
    same_group,
    value_counts,
)
from forecourt.sources.quotes import stored


def default_checks() -> dict[str, Column]:
    """Rule name to the condition that breaks it; a null breaks its rule."""

    def bad(ok: Column) -> Column:
        return ~F.coalesce(ok, F.lit(False))

    c = F.col
    return {
        "year": bad(c("year").between(1900, 2100)),
        "make": bad(F.length(F.trim("make")) > 0),
        "model": bad(F.length(F.trim("model")) > 0),
        "mileage": bad(c("mileage") >= 0),
        "location_zip": bad(c("location_zip").between(1, 99999)),
        "market_avg_days_to_sell": bad(c("market_avg_days_to_sell").between(1, 500)),
        "n_similar_vehicles_listed": bad(c("n_similar_vehicles_listed") >= 0),
        "region_short_code": bad(c("region_short_code").rlike("^[a-z]{2}/[a-z]{3}$")),
        "exact_list_price": bad(c("exact_list_price") > 0),
        "wholesale_price": bad(c("wholesale_price") > 0),
        "seller_source": bad(c("seller_source").isin("web", "iOS")),
        "expected_margin": bad(c("expected_margin").between(-50000, 100000)),
    }


def validate(df: DataFrame, checks: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows that break each rule, from one pass."""
    checks = default_checks() if checks is None else checks
    one = df.agg(*[F.count_if(bad).alias(name) for name, bad in checks.items()])
    return _unpivot(one, list(checks), "rule", "violations").orderBy("rule")


def duplicates(df: DataFrame, key: str | Sequence[str] = "quote_id") -> DataFrame:
    """Keys that occur more than once, with their row count."""
    key = [key] if isinstance(key, str) else list(key)
    counts = df.groupBy(*key).agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") > 1).orderBy(*key)


def outliers_iqr(
    df: DataFrame, col: str, by: Sequence[str] = (), reach: float = 1.5, keep: str = "inliers"
) -> DataFrame:
    """Rows within (or, with ``keep="outliers"``, beyond) ``reach`` quartile ranges of the quartiles."""
    q = quantiles(df, list(by), col, {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    fences = q.select(
        *by,
        (F.col("q1") - F.lit(float(reach)) * iqr).alias("low_fence"),
        (F.col("q3") + F.lit(float(reach)) * iqr).alias("high_fence"),
    )
    if by:
        joined = df.alias("d").join(fences.alias("f"), same_group("d", "f", by))
    else:
        joined = beside(df.alias("d"), fences.alias("f"))
    inside = F.col(f"d.{col}").between(F.col("f.low_fence"), F.col("f.high_fence"))
    wanted = inside if keep == "inliers" else ~inside
    return joined.filter(wanted).select("d.*")


def impute_days(
    df: DataFrame,
    col: str = "market_avg_days_to_sell",
    by: Sequence[str] = ("make", "model", "year"),
) -> DataFrame:
    """Replace zero days by the median of like cars, rounded up to a whole day.

    Looks for cars alike in all of ``by``, then in ever fewer of its leading
    columns, then in nothing. Zeros and nulls do not count toward a median.
    Adds ``imputed_days``; the original column stays.
    """
    by = list(by)
    counts = stored(value_counts(df, by, col))
    known = counts.filter("value <> 0")
    sets = [[*by[:depth], "value"] for depth in range(len(by) + 1)]
    depth = len(by) - sum((F.grouping(k).cast("int") for k in by), F.lit(0))
    grouped = known.groupingSets(sets, *by, "value").agg(F.sum("n").alias("n"), depth.alias("depth"))
    medians = stored(quantiles_of_counts(grouped, ["depth", *by], {"median": 0.5}))

    # The search runs over the different keys of rows without days.
    fill, found = counts.filter("value = 0").select(*by).alias("d"), []
    for depth in range(len(by), 0, -1):
        keys, right = by[:depth], f"m{depth}"
        level = medians.filter(F.col("depth") == depth).select(*keys, "median")
        fill = fill.join(level.alias(right), same_group("d", right, keys), "left")
        found.append(F.col(f"{right}.median"))
    overall = medians.filter("depth = 0").agg(F.max("median").alias("median"))
    fill = beside(fill, overall.alias("m0"))
    days = F.ceil(F.coalesce(*found, F.col("m0.median"))).cast("int")
    fill = fill.select(*[F.col(f"d.{k}").alias(k) for k in by], days.alias("_fill"))

    zero = F.col(col) == 0
    value = F.when(zero, F.col("_fill")).otherwise(F.col(col))
    return lookup_where(df, zero, fill, by, "_fill").select(*df.columns, value.alias("imputed_days"))


def margin_from_nearest(
    df: DataFrame, score: str = "calculated_margin", key: str = "quote_id"
) -> DataFrame:
    """Fill unknown margins with that of the sold quote of nearest score.

    Scores are any numbers; null and NaN borrow nothing. Of sold quotes with
    one score the first key lends; of two equally near scores the lower one
    does. The distinct scores are dealt to tasks by ranges of about equal size,
    and each range knows the lenders next to it.
    """
    em, s = F.col("expected_margin"), F.col(score)
    scored = s.isNotNull() & ~F.isnan(s.cast("double"))
    lender = F.when(em != 0, F.struct(F.col(key), em))
    # Stored, as the number of a range is that of the task which holds it.
    scores = stored(
        df.filter(scored)
        .groupBy(s.alias("score"))
        .agg(F.min(lender).alias("lender"))
        .repartitionByRange("score")
        .select(
            "score",
            F.spark_partition_id().alias("block"),
            F.when(
                F.col("lender").isNotNull(),
                F.struct("score", F.col("lender.expected_margin").alias("margin")),
            ).alias("donor"),
        )
    )
    # What follows is read backwards: a frame that ends with the last row is worked out anew for each row.
    ahead = Window.rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        scores.groupBy("block")
        .agg(F.min("donor").alias("first"), F.max("donor").alias("last"))
        .select(
            "block",
            F.last("last", ignorenulls=True).over(ahead.orderBy("block")).alias("before"),
            F.last("first", ignorenulls=True).over(ahead.orderBy(F.desc("block"))).alias("after"),
        )
    )
    inside = Window.partitionBy("block").rowsBetween(Window.unboundedPreceding, 0)
    below = F.last("donor", ignorenulls=True).over(inside.orderBy("score"))
    above = F.last("donor", ignorenulls=True).over(inside.orderBy(F.desc("score")))
    near = (
        scores.withColumn("below", below)
        .withColumn("above", above)
        .alias("s")
        # Null-safe, so that both sides share the shuffle of the scores.
        .join(blocks.alias("b"), same_group("s", "b", ["block"]))
        .select(
            "score",
            F.coalesce("below", "before").alias("lo"),
            F.coalesce("above", "after").alias("hi"),
        )
    )
    lower = F.col("hi").isNull() | (F.col("score") - F.col("lo.score") <= F.col("hi.score") - F.col("score"))
    table = near.select(
        F.col("score").alias(score),
        F.when(lower & F.col("lo").isNotNull(), F.col("lo.margin"))
        .otherwise(F.col("hi.margin"))
        .alias("_lent"),
    )
    out = lookup_where(df, ~F.coalesce(em != 0, F.lit(False)) & scored, table, [score], "_lent")
    filled = F.when(em != 0, em).otherwise(F.col("_lent")).alias("imputed_margin")
    return out.select(*df.columns, filled)

"""Cohort tables, the best cohort per place, price tests and outreach ranking."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forecourt.functions.columns import ratio


def _metrics() -> list[Column]:
    em = F.col("expected_margin")
    known = F.when(em != 0, em)
    return [
        F.count("*").alias("num_inquiries"),
        F.count(known).alias("num_sold"),
        ratio(F.count(known), F.count("*")).alias("conversion_rate"),
        F.avg(known).alias("avg_margin"),
        F.sum(known).alias("total_margin_earned"),
    ]


def cohort_table(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inquiries, sales, conversion and margin per cohort."""
    return df.groupBy(*keys).agg(*_metrics()).orderBy(*keys)


def cohort_rollup(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The cohort table with subtotals over the keys from the right; ``level`` counts open keys."""
    levels = [F.grouping(k).cast("int") for k in keys]
    depth = sum(levels[1:], levels[0])
    return df.rollup(*keys).agg(depth.alias("level"), *_metrics()).orderBy("level", *keys)


def best_in_cohort(
    df: DataFrame,
    within: str = "location_zip",
    by: Sequence[str] = ("make", "model"),
    metric: str = "avg_margin",
) -> DataFrame:
    """Per place, the group with the largest metric; ties go to the first group.

    A pair of plain aggregates, so no place is sorted in one task.
    """
    table = df.groupBy(within, *by).agg(*_metrics()).filter(F.col(metric).isNotNull())
    rank = F.struct((-F.col(metric)).alias("m"), *by)
    row = F.min_by(F.struct(*by, metric, "num_inquiries"), rank).alias("best")
    return table.groupBy(within).agg(row).select(within, "best.*").orderBy(within)


def price_test(
    df: DataFrame, arms: Sequence, zone: str = "location_zip"
) -> DataFrame:
    """Compare pricing models across zones.

    ``arms`` lists percent-to-market models; a zone belongs to arm zone mod
    number of arms. ``df`` needs total and expected margin.
    """
    arm = F.pmod(F.col(zone), F.lit(len(arms))).cast("int")
    pct = F.lit(Decimal(str(arms[-1])))
    for i, p in reversed(list(enumerate(arms[:-1]))):
        pct = F.when(F.col("arm") == i, F.lit(Decimal(str(p)))).otherwise(pct)
    estimate = (pct * F.col("total_margin")).cast("int")
    em = F.col("expected_margin")
    return (
        df.withColumn("arm", arm)
        .withColumn("estimate", estimate)
        .groupBy("arm")
        .agg(
            *_metrics(),
            F.sum(F.when(em == 0, F.col("estimate"))).alias("total_profit_lost"),
            F.avg("market_avg_days_to_sell").alias("avg_days_to_sell"),
        )
        .orderBy("arm")
    )


def outreach_rank(
    df: DataFrame, score: str, k: int, by: str | None = None, key: str = "quote_id"
) -> DataFrame:
    """The ``k`` sellers to contact first, overall or per level of ``by``.

    Per level, Spark cuts each map task to its best ``k`` before the shuffle,
    so a level with most rows costs no more than a small one.
    """
    if by is None:
        return df.orderBy(F.desc(score), key).limit(k)
    window = Window.partitionBy(by).orderBy(F.desc(score), F.col(key))
    return df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def market_price_gap(df: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Market price implied by list price and percent, the gap to it, and which side it is on."""
    market = F.try_divide(F.col("exact_list_price").cast("double"), F.col("percent_to_market"))
    gap = F.col("exact_list_price") - F.col("market_price")
    limit = F.lit(float(tolerance)) * F.col("market_price")
    return df.withColumn("market_price", market).withColumn("price_gap", gap).withColumn(
        "position",
        F.when(F.col("price_gap") < -limit, "under")
        .when(F.col("price_gap") > limit, "over")
        .when(F.col("price_gap").isNotNull(), "at"),
    )

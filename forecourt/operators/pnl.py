"""Profit and loss, margin ratios and the percent-to-market model."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt.functions.columns import ratio
from forecourt.functions.frames import beside
from forecourt.operators.cleaning import sold


def _profit() -> list[Column]:
    em = F.col("expected_margin")
    return [
        F.sum(F.when(em < 0, em)).alias("total_loss"),
        F.sum(F.when(em > 0, em)).alias("total_gain"),
        F.sum(em).alias("total_profit"),
        (F.sum("margin") - F.sum(em)).alias("total_profit_lost"),
        F.count_if(em != 0).alias("num_sellers"),
        F.count("*").alias("num_inquiries"),
    ]


def _earned() -> list[Column]:
    em = F.col("expected_margin")
    known, total = F.when(em != 0, em), F.when(em != 0, F.col("total_margin"))
    return [
        F.avg(known).cast("int").alias("average_em"),
        F.avg(total).cast("int").alias("average_tm"),
        F.sum(known).alias("sum_em"),
        F.sum(total).alias("sum_tm"),
        F.try_divide(F.avg(known), F.avg(total)).alias("em_div_tm"),
    ]


def _conversion() -> Column:
    return ratio(F.col("num_sellers"), F.col("num_inquiries")).alias("conversion_rate")


def pnl(df: DataFrame) -> DataFrame:
    """One row of profit and loss over cleaned quotes, from a single pass.

    A side without rows is null, not zero. ``total_profit_lost`` is the margin
    with estimates filled in, less the margin earned.
    """
    return df.agg(*_profit()).select("*", _conversion())


def margin_summary(df: DataFrame) -> DataFrame:
    """One row comparing earned and total margin over sold quotes."""
    return sold(df).agg(*_earned())


def summary_sheet(df: DataFrame) -> DataFrame:
    """``pnl`` and ``margin_summary`` side by side, as one aggregate."""
    return df.agg(*_profit(), *_earned()).select("*", _conversion())


def fit_pct_to_market(df: DataFrame, by: Sequence[str] = (), sums: bool = False) -> DataFrame:
    """Share of the total margin that sold quotes earned, overall or per group.

    ``sums`` adds the struct ``of`` with the sums and counts behind the share.
    """
    em, tm = F.col("expected_margin").cast("double"), F.col("total_margin").cast("double")
    parts = F.struct(
        F.sum(em).alias("em"), F.count(em).alias("em_n"), F.sum(tm).alias("tm"), F.count(tm).alias("tm_n")
    )
    fitted = sold(df).groupBy(*by).agg(F.count("*").alias("n_sold"), parts.alias("of"))
    of = [F.col("of")] if sums else []
    return fitted.select(*by, "n_sold", _share(*[F.col(f"of.{c}") for c in _PARTS]).alias("pct"), *of)


_PARTS = ("em", "em_n", "tm", "tm_n")


def _share(em: Column, em_n: Column, tm: Column, tm_n: Column) -> Column:
    return F.try_divide(F.try_divide(em, em_n), F.try_divide(tm, tm_n))


def apply_pct_to_market(df: DataFrame, fitted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add ``predicted_margin`` from learned shares.

    The overall share is one row. With ``by`` a group that never sold or has a
    null in its key falls back to it; it is added up from the sums of
    ``fitted``, or takes one more pass over ``df`` if these were left out. Pass
    a stored copy of ``fitted``: its size is known, so the planner broadcasts
    it only below its threshold.
    """
    estimate = (F.col("_pct") * F.col("total_margin")).cast("int").alias("predicted_margin")
    if not by:
        joined = beside(df, fitted.select(F.col("pct").alias("_pct")))
        return joined.select(*df.columns, estimate)
    if "of" in fitted.columns:
        overall = fitted.agg(_share(*[F.sum(f"of.{c}") for c in _PARTS]).alias("_overall"))
    else:
        overall = fit_pct_to_market(df).select(F.col("pct").alias("_overall"))
    joined = beside(df.join(fitted.select(*by, "pct"), list(by), "left"), overall)
    joined = joined.withColumn("_pct", F.coalesce("pct", "_overall"))
    return joined.select(*df.columns, estimate)


def cross_one_row(dfs: Sequence[DataFrame]) -> DataFrame:
    """Put one-row results side by side.

    Each input must be a global aggregate; one row is always small enough to
    broadcast.
    """
    return reduce(beside, dfs)


def rmse(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Root of the mean squared error, as one row with the row count."""
    err = F.col(actual).cast("double") - F.col(predicted).cast("double")
    return df.agg(F.count(err).alias("n"), F.sqrt(F.avg(err * err)).alias("rmse"))


def pmm_rmse(df: DataFrame) -> DataFrame:
    """Error of the percent-to-market model on sold quotes."""
    return rmse(sold(df), "expected_margin", "calculated_margin")

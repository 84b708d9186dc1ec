"""The named reports: each maps cleaned quotes to the few rows a chart shows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from forecourt.operators.aggregates import group_stat, histogram, share, top_k
from forecourt.operators.cleaning import sold
from forecourt.operators.quantiles import box_stats
from forecourt.operators.smoothing import loess, scatter_points

Report = Callable[[DataFrame], DataFrame]

# Widths of the buckets that keep line charts over mileage small.
MILEAGE_BUCKET = 5000


def _hist(col: str, only_sold: bool = False) -> Report:
    return lambda df: histogram(sold(df) if only_sold else df, col)


def _stat(by: str, values, stat: str = "avg", only_sold: bool = False, bucket=None) -> Report:
    return lambda df: group_stat(sold(df) if only_sold else df, by, values, stat, bucket)


def _box(by: str, value: str) -> Report:
    return lambda df: box_stats(df, by, value)


def _points(y: str, only_sold: bool = False) -> Report:
    return lambda df: scatter_points(sold(df) if only_sold else df, "percent_to_market", y, 0.01, 250)


def _loess(y: str, only_sold: bool = False) -> Report:
    return lambda df: loess(sold(df) if only_sold else df, "percent_to_market", y)


EM, CM, TM = "expected_margin", "calculated_margin", "total_margin"
DAYS, SIMILAR = "market_avg_days_to_sell", "n_similar_vehicles_listed"

CHARTS: dict[str, Report] = {
    "chart_expected_margin_histogram": _hist(EM, only_sold=True),
    "chart_calculated_margin_histogram": _hist(CM),
    "chart_margins_by_make": _stat("make", [EM, TM], only_sold=True),
    "chart_calculated_margin_by_make": _stat("make", CM),
    "chart_calculated_margin_box_by_make": _box("make", CM),
    "chart_total_margins_by_make": _stat("make", [EM, CM], "sum"),
    "chart_top_makes": lambda df: top_k(df, "make", CM, 3),
    "chart_percent_to_market_histogram": _hist("percent_to_market"),
    "chart_percent_calculated_points": _points(CM),
    "chart_percent_calculated_loess": _loess(CM),
    "chart_percent_expected_points": _points(EM, only_sold=True),
    "chart_percent_expected_loess": _loess(EM, only_sold=True),
    "chart_calculated_margin_by_region": _stat("region_short_code", CM),
    "chart_expected_margin_by_region": _stat("region_short_code", EM, only_sold=True),
    "chart_total_expected_margin_by_source": _stat("seller_source", EM, "sum", only_sold=True),
    "chart_expected_margin_by_source": _stat("seller_source", EM, only_sold=True),
    "chart_calculated_margin_box_by_region": _box("region_short_code", CM),
    "chart_days_to_sell_histogram": _hist(DAYS),
    "chart_expected_margin_by_days": _stat(DAYS, EM, only_sold=True),
    "chart_calculated_margin_by_days": _stat(DAYS, CM),
    "chart_mileage_histogram": _hist("mileage"),
    "chart_expected_margin_by_year": _stat("year", EM, only_sold=True),
    "chart_calculated_margin_by_year": _stat("year", CM),
    "chart_share_by_year": lambda df: share(df, "year"),
    "chart_expected_margin_by_mileage": _stat("mileage", EM, only_sold=True, bucket=MILEAGE_BUCKET),
    "chart_calculated_margin_by_mileage": _stat("mileage", CM, bucket=MILEAGE_BUCKET),
    "chart_expected_margin_by_similar": _stat(SIMILAR, EM, only_sold=True),
    "chart_calculated_margin_by_similar": _stat(SIMILAR, CM),
}

"""Column expressions shared by the operators. All stay inside generated JVM code."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_present(cols) -> Column:
    """True where every named column is not null. NaN counts as present."""
    return F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in cols))


def percent_of(amount: Column, pct) -> Column:
    """``pct`` of an integer amount, in decimal arithmetic, cut toward zero."""
    return (F.lit(Decimal(str(pct))) * amount).cast("int")


def log10_or_null(value: Column) -> Column:
    """Base-10 log; Spark's own gives null, not an error, for zero and below."""
    return F.log10(value)


def ratio(num: Column, den: Column) -> Column:
    """Quotient that is null, not an error, for a zero divisor."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson r; null where a side is constant (``corr`` itself raises in ANSI mode).

    Pairs with a null on either side are left out of every term.
    """
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


# Multipliers of a Lehmer generator modulo 2**31 - 1 (fixed values).
_LEHMER_MODULUS = 2147483647
_LEHMER_MULTIPLIERS = (48271, 69621, 39373)


def key_bucket(key: Column, n: int, stream: int = 0) -> Column:
    """Bucket 0..n-1 of an integer key.

    Plain integer arithmetic, so a row keeps its bucket whatever the
    partitioning, and another SQL engine computes the same. Different
    ``stream`` numbers give unrelated buckets.
    """
    m = F.lit(_LEHMER_MODULUS).cast("bigint")
    mixed = F.pmod(F.pmod(key.cast("bigint"), m) * F.lit(_LEHMER_MULTIPLIERS[stream]), m)
    return F.pmod(mixed, F.lit(n).cast("bigint")).cast("int")

"""Small helpers over whole frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt.sources.quotes import stored

_UNITS = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """``df`` with the columns of a one-row frame on every row.

    The second frame must be a global aggregate: that has exactly one row, so
    broadcasting it is safe and the row count of ``df`` stays. As a join it is
    planned with the rest of the query and shares its shuffles; a scalar
    subquery is planned apart and would compute its source again.
    """
    return df.crossJoin(F.broadcast(one_row))


def planned_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; for a file scan, the bytes of the files' used columns."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def broadcast_limit(df: DataFrame) -> int:
    """The session's broadcast threshold in bytes; negative means never."""
    text = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").lower().rstrip("b")
    unit = _UNITS.get(text[-1:], 1)
    return int(text[:-1] if text[-1:] in _UNITS else text) * unit


def broadcast_if_small(df: DataFrame, scan: DataFrame) -> DataFrame:
    """Hint ``df`` as broadcast if the file scan it is made from is below the session's threshold.

    For a frame with no more rows than ``scan``. The optimizer multiplies the
    sizes of joined sides and so overestimates a table joined to its lookups;
    the scan's own size is known. A larger scan gets no hint, and the planner
    shuffles both sides.
    """
    return F.broadcast(df) if planned_bytes(scan) <= broadcast_limit(scan) else df


#: Join lanes of rows that look nothing up.
LANES = 1024


def lookup_where(df: DataFrame, needed: Column, table: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``df`` with the column ``value`` of ``table`` on rows that meet ``needed``, null on all others.

    Rows that look nothing up join on lanes of their own, dealt by their values,
    so that a frequent key among them fills no single task. ``table`` must have
    one row per key; its stored copy has a known size, so the planner broadcasts
    it only below its threshold. Keys match null-safely.
    """
    lane = F.when(F.coalesce(needed, F.lit(False)), F.lit(0)).otherwise(F.pmod(F.hash(*df.columns), F.lit(LANES)) + 1)
    # The lane is stored, as a literal would be folded out of the join's keys.
    names = {k: f"_key_{i}" for i, k in enumerate(keys)}
    right = stored(table.select(*[F.col(k).alias(n) for k, n in names.items()], F.col(value), F.lit(0).alias("_lane_of")))
    same = F.col("_lane") == F.col("_lane_of")
    for k, n in names.items():
        same = same & F.col(k).eqNullSafe(F.col(n))
    return df.withColumn("_lane", lane).join(right, same, "left").select(*df.columns, value)

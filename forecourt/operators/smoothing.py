"""Scatter datasets: binned points and a local regression line."""

from __future__ import annotations

from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecourt.functions.frames import stored
from forecourt.operators.quantiles import values_at_ranks

# Distances are ranked in steps of the x range divided by this.
_DISTANCE_STEPS = 2**31 - 2


def scatter_points(
    df: DataFrame, x: str, y: str, x_step: float, y_step: float
) -> DataFrame:
    """All points of a scatter plot, counted in cells of x_step by y_step (lower corners)."""

    def corner(c: str, step: float):
        return F.floor(F.col(c).cast("double") / F.lit(float(step))).cast("bigint")

    return (
        df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(corner(x, x_step).alias("x_cell"), corner(y, y_step).alias("y_cell"))
        .agg(F.count("*").alias("n"))
        .select("x_cell", "y_cell", "n")
    )


#: Ranges of x with about equally many distinct values; the driver sees their sums.
BLOCKS = 256

#: Highest powers of the distance in the weighted sums: tricube times square, and times the distance for y.
_POWERS = 12


def loess(
    df: DataFrame, x: str, y: str, span: float = 0.3, grid: int = 50, x_step: float | None = None
) -> DataFrame:
    """Local linear regression of y on x at ``grid`` evenly spaced points.

    Each point uses the nearest ``span`` part of all rows, weighted by the
    tricube of their distance. Rows shrink to (x, count, sum of y), and those
    are cut into blocks of neighbours. On one side of a point the tricube is a
    polynomial, so a block that lies inside a point's reach contributes through
    its power sums; only the blocks that hold a point or an end of its reach
    are read again for it. The line falls back to the weighted mean where the
    neighbours share one x. No rows give no line.

    Neighbour distances are ranked in steps of 1/2**31 of the x range.
    ``x_step`` rounds x to the middles of steps of that width first.
    """
    spark = df.sparkSession
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    if x_step is not None:
        xs = (F.floor(xs / F.lit(float(x_step))) + F.lit(0.5)) * F.lit(float(x_step))
    points = df.filter(xs.isNotNull() & ys.isNotNull() & ~F.isnan(xs)).groupBy(xs.alias("x"))
    points = points.agg(F.count("*").alias("n"), F.sum(ys).alias("sy"))
    points = stored(points.repartitionByRange(BLOCKS, "x").withColumn("block", F.spark_partition_id()))
    ranges = points.groupBy("block").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.sum("n").alias("n"))
    schema = "i int, x double, smoothed double"
    ranges = ranges.orderBy("block").collect()
    if not ranges:
        return spark.createDataFrame([], schema)
    block = np.array([r.block for r in ranges])
    low, high, count = (np.array([r[c] for r in ranges], float) for c in ("low", "high", "n"))
    width = high[-1] - low[0]
    at = low[0] + np.arange(grid) * (width / max(grid - 1, 1))
    reach = _reach(points, at, block, low, high, count, span, width)

    def touches(i: int) -> np.ndarray:
        return (low < at[i] + reach[i]) & (high > at[i] - reach[i]) | (low <= at[i]) & (at[i] <= high)

    def inside(i: int) -> np.ndarray:
        far = np.maximum(np.abs(low - at[i]), np.abs(high - at[i]))
        return (far < reach[i]) & ((high < at[i]) | (low > at[i]))

    near = np.zeros((grid, 5))
    whole = [(i, inside(i)) for i in range(grid)]
    if any(mine.any() for _, mine in whole):
        centre, scale = (low + high) / 2, np.where(high > low, (high - low) / 2, 1.0)
        sums = _power_sums(points, block, centre, scale)
        for i, mine in whole:
            if mine.any():
                near[i] = _polynomial(sums[mine], centre[mine], scale[mine], at[i], reach[i])
    edges = [(int(b), i, float(at[i]), float(reach[i])) for i, mine in whole for b in block[touches(i) & ~mine]]
    rows = points.join(F.broadcast(spark.createDataFrame(edges, "block int, i int, g double, h double")), "block")
    u = F.col("x") - F.col("g")
    d = F.coalesce(F.try_divide(F.abs(u), F.col("h")), F.lit(0.0))
    cube = F.lit(1.0) - d * d * d
    rows = rows.select("i", "n", "sy", u.alias("u"), d.alias("d"), (cube * cube * cube).alias("w")).filter("d < 1")
    w, n, sy, u = F.col("w"), F.col("n"), F.col("sy"), F.col("u")
    exact = [w * n, w * n * u, w * n * u * u, w * sy, w * sy * u]
    for r in rows.groupBy("i").agg(*[F.sum(e).alias(f"e{k}") for k, e in enumerate(exact)]).collect():
        near[r.i] += r[1:]
    w0, w1, w2, y0, y1 = near.T
    det = w0 * w2 - w1 * w1
    flat = det <= 1e-9 * w0 * w2
    line = np.where(flat, y0 / w0, (w2 * y0 - w1 * y1) / np.where(flat, 1.0, det))
    return spark.createDataFrame([(i, float(g), float(v)) for i, (g, v) in enumerate(zip(at, line, strict=True))], schema)


def _reach(points: DataFrame, at: np.ndarray, block: np.ndarray, low: np.ndarray, high: np.ndarray, count: np.ndarray, span: float, width: float) -> np.ndarray:
    """Distance from each place that holds the nearest ``span`` of all rows.

    Blocks bound it from both sides; only those between the bounds are ranked.
    """
    spark, need = points.sparkSession, int(min(max(np.ceil(span * count.sum()), 1), count.sum()))
    asked, sure = [], []
    for i, g in enumerate(at):
        least = np.maximum(np.maximum(low - g, g - high), 0.0)
        most = np.maximum(np.abs(low - g), np.abs(high - g))
        near, far = np.argsort(least), np.argsort(most)
        lower = least[near][np.searchsorted(np.cumsum(count[near]), need)]
        upper = most[far][np.searchsorted(np.cumsum(count[far]), need)]
        between = (most >= lower) & (least <= upper)
        asked += [(int(b), i, float(g)) for b in block[between]]
        # Distances are ranked in whole steps; nearer blocks count as one value before all of them.
        sure.append((i, -1, int(count[~between & (most < lower)].sum())))
    places = F.broadcast(spark.createDataFrame(asked, "block int, i int, g double"))
    steps = F.coalesce(F.floor(F.try_divide(F.abs(F.col("x") - F.col("g")), F.lit(float(width))) * F.lit(_DISTANCE_STEPS)), F.lit(0))
    counts = points.join(places, "block").select("i", steps.cast("int").alias("value"), "n")
    counts = counts.union(spark.createDataFrame(sure, "i int, value int, n long").filter("n > 0"))
    counts = counts.groupBy("i", "value").agg(F.sum("n").alias("n"))
    found = {r.i: r.reach for r in values_at_ranks(counts, ["i"], {"reach": F.lit(need - 1)}).collect()}
    return (np.array([found[i] for i in range(len(at))], float) + 1) * (width / _DISTANCE_STEPS)


def _power_sums(points: DataFrame, block: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Per block the sums of n and of y times each power of x, scaled to its range."""
    middles = points.sparkSession.createDataFrame(
        [(int(b), float(c), float(s)) for b, c, s in zip(block, centre, scale, strict=True)], "block int, c double, s double"
    )
    rows = points.join(F.broadcast(middles), "block").withColumn("z", (F.col("x") - F.col("c")) / F.col("s"))
    power = [F.lit(1.0)]
    for _ in range(_POWERS - 1):
        power.append(power[-1] * F.col("z"))
    aggs = [F.sum(F.col(v) * p).alias(f"{v}{k}") for v in ("n", "sy") for k, p in enumerate(power)]
    found = {r.block: np.array(r[1:], float).reshape(2, _POWERS) for r in rows.groupBy("block").agg(*aggs).collect()}
    return np.array([found[b] for b in block])


def _polynomial(sums: np.ndarray, centre: np.ndarray, scale: np.ndarray, at: float, reach: float) -> np.ndarray:
    """Weighted sums of 1, u, u^2, y and y u over whole blocks beside a place, u the distance from it."""
    side = np.sign(centre - at)
    shift, size = (centre - at) / reach, scale / reach
    moved = np.zeros((2, _POWERS, len(centre)))  # sums of the powers of u over the reach
    for m in range(_POWERS):
        for k in range(m + 1):
            moved[:, m] += comb(m, k) * shift ** (m - k) * size**k * sums[:, :, k].T

    def weighted(v: int, power: int) -> float:
        return sum((c * side**m * moved[v, m + power]).sum() for m, c in ((0, 1), (3, -3), (6, 3), (9, -1)))

    return np.array([weighted(0, 0), weighted(0, 1) * reach, weighted(0, 2) * reach**2, weighted(1, 0), weighted(1, 1) * reach])


def line_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """The least-squares straight line of y on x, as one row."""
    return df.agg(
        F.count("*").alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
    )

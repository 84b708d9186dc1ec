"""Counts, means and cross-products of a design matrix, in one pass.

Dummy columns are never built. Rows are grouped by split, folds and levels;
inside such a cell every dummy is constant, so the means and covariances of
the numeric columns per cell carry everything the full matrix would. They come
from plain sums of values and products, which partial aggregation combines
before the shuffle. Values count from an origin inside the columns' ranges, the
means of a few rows, so that the sums keep their digits however large the values.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecourt.functions.columns import all_present

# Cells fetched to the driver, in total. Beyond it the matrix is too wide for
# a driver-side solve and callers switch to Spark ML's distributed solver.
MAX_CELLS = 500_000
MAX_COLUMNS = 4_000


class TooWide(ValueError):
    """The design matrix has more columns or cells than a driver-side solve should hold."""


@dataclass(frozen=True)
class Moments:
    """Row count, column means and cross-products around the means, of some rows."""

    n: float
    mean: np.ndarray
    cross: np.ndarray

    def __add__(self, other: "Moments") -> "Moments":
        n = self.n + other.n
        gap = other.mean - self.mean
        return Moments(
            n,
            self.mean + gap * (other.n / n),
            self.cross + other.cross + np.outer(gap, gap) * (self.n * other.n / n),
        )

    def scaled(self, centre: np.ndarray, factor: np.ndarray) -> "Moments":
        return Moments(self.n, (self.mean - centre) * factor, self.cross * np.outer(factor, factor))


def merged(parts: Sequence[Moments]) -> Moments:
    return reduce(lambda a, b: a + b, parts)


@dataclass(frozen=True)
class Design:
    """The columns behind a set of moments: numerics, then dummies, then the label."""

    numerics: tuple[str, ...]
    levels: dict[str, tuple]
    bases: dict[str, object]
    label: str

    @property
    def dummies(self) -> list[tuple[str, object]]:
        return [(c, v) for c, vs in self.levels.items() for v in vs if v != self.bases[c]]

    @property
    def names(self) -> list[str]:
        return [*self.numerics, *[f"{c}_{v}" for c, v in self.dummies]]


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows with all the named columns; logs of zero are null and drop out here."""
    return df.filter(all_present(cols))


#: Rows whose means serve as origin. Any value inside a column's range will do, so no more are read.
ORIGIN_ROWS = 100


def origin(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Mean of each column over a few rows as a double; 0 without rows or if it isn't finite."""
    few = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).limit(ORIGIN_ROWS)
    row = few.agg(*[F.avg(f"c{i}").alias(f"m{i}") for i in range(len(cols))]).first()
    return {c: float(m) if m is not None and np.isfinite(m) else 0.0 for c, m in zip(cols, row, strict=True)}


def moment_cells(
    df: DataFrame,
    numerics: Sequence[str],
    categoricals: Sequence[str],
    label: str,
    groups: Sequence[str] = (),
    origins: dict[str, float] | None = None,
) -> DataFrame:
    """Count, sums and sums of products of numerics and label per group and level cell.

    With three or more categorical columns the cells are the pairs of columns,
    which is all a cross-product needs, so their number stays below the square
    of the matrix width.
    """
    cols = [*numerics, label]
    df = complete_cases(df, [*cols, *categoricals])
    origins = origin(df, cols) if origins is None else origins
    centred = [f"CAST(`{c}` AS double) - {origins.get(c, 0.0)!r}D AS x{i}" for i, c in enumerate(cols)]
    aggs = [F.count("*").alias("n")]
    for i in range(len(cols)):
        aggs.append(F.sum(f"x{i}").alias(f"s{i}"))
        for j in range(i, len(cols)):
            aggs.append(F.expr(f"sum(x{i} * x{j})").alias(f"p{i}_{j}"))
    keys = [f"`{c}`" for c in [*groups, *categoricals]]
    df = df.selectExpr(*keys, *centred)
    if len(categoricals) <= 2:
        return df.groupBy(*groups, *categoricals).agg(*aggs)
    pairs = [[*groups, *pair] for pair in combinations(categoricals, 2)]
    return df.groupingSets(pairs, *groups, *categoricals).agg(*aggs)


def collect_moments(
    df: DataFrame,
    numerics: Sequence[str],
    categoricals: Sequence[str],
    label: str,
    groups: Sequence[str] = (),
    bases: dict[str, object] | None = None,
    origins: dict[str, float] | None = None,
) -> tuple[Design, dict[tuple, Moments]]:
    """Moments per group, with the design they belong to. A few rows give the origin, one pass the cells.

    The base level of a categorical column defaults to its rarest level.
    """
    numerics, categoricals = tuple(numerics), list(categoricals)
    if origins is None:
        origins = origin(complete_cases(df, [*numerics, label, *categoricals]), [*numerics, label])
    cells = moment_cells(df, numerics, categoricals, label, groups, origins)
    rows = cells.limit(MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS:
        raise TooWide(f"more than {MAX_CELLS} level combinations")
    design = _design(rows, numerics, categoricals, label, bases or {})
    if len(design.names) > MAX_COLUMNS:
        raise TooWide(f"{len(design.names)} columns")
    by_group: dict[tuple, list] = {}
    for r in rows:
        by_group.setdefault(tuple(r[g] for g in groups), []).append(r)
    zero = np.array([origins.get(c, 0.0) for c in (*numerics, label)])
    return design, {g: _assemble(rs, design, zero) for g, rs in sorted(by_group.items())}


def _pair_of(row, categoricals) -> tuple[str, ...]:
    return tuple(c for c in categoricals if row[c] is not None)


def _design(rows, numerics, categoricals, label, bases) -> Design:
    levels, chosen = {}, {}
    for c in categoricals:
        counts: dict = {}
        for r in rows:
            if r[c] is not None:
                counts[r[c]] = counts.get(r[c], 0) + r["n"]
        ranked = sorted(counts, key=lambda v: (-counts[v], v))
        base = bases.get(c, ranked[-1] if ranked else None)
        if ranked and base not in counts:
            raise ValueError(f"base level {base!r} is not among the levels of {c}")
        levels[c], chosen[c] = tuple(sorted(counts)), base
    return Design(numerics, levels, chosen, label)


def _assemble(rows, design: Design, origin: np.ndarray) -> Moments:
    """Full moments of one group from its cells."""
    nn = len(design.numerics)
    n_dummies = len(design.dummies)
    width = nn + n_dummies + 1
    slot = {d: nn + i for i, d in enumerate(design.dummies)}
    cats = list(design.levels)
    num = [*range(nn), width - 1]
    blocks: dict[tuple, list] = {}
    for r in rows:
        blocks.setdefault(_pair_of(r, cats), []).append(r)
    mean, cross, total = np.zeros(width), np.zeros((width, width)), 0.0
    for pair, part in blocks.items():
        own = [i for c, i in ((d[0], slot[d]) for d in design.dummies) if c in pair]
        at = [*num[:-1], *own, width - 1]
        pos = {i: k for k, i in enumerate(at)}
        n = np.array([float(r["n"]) for r in part])
        mu = np.zeros((len(part), len(at)))
        inner = np.zeros((len(at), len(at)))
        for k, r in enumerate(part):
            for a in range(nn + 1):
                pa = pos[num[a]]
                mu[k, pa] = r[f"s{a}"] / n[k]
                for b in range(a, nn + 1):
                    pb = pos[num[b]]
                    spread = r[f"p{a}_{b}"] - r[f"s{a}"] * (r[f"s{b}"] / n[k])
                    inner[pa, pb] += spread
                    if a != b:
                        inner[pb, pa] += spread
            for c in pair:
                i = slot.get((c, r[c]))
                if i is not None:
                    mu[k, pos[i]] = 1.0
        total = n.sum()
        centre = (n[:, None] * mu).sum(axis=0) / total
        gap = mu - centre
        mean[at] = centre
        mean[num] = centre[[pos[i] for i in num]] + origin
        cross[np.ix_(at, at)] = inner + (gap * n[:, None]).T @ gap
    return Moments(total, mean, cross)

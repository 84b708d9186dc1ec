"""Linear models fitted from moments: least squares, ridge, lasso and elastic net.

One Spark job turns any number of rows into moments per split and fold. All
fits, the whole of every grid search, nested cross-validation and hold-out
scores follow from those by small solves on the driver. Folds come from a hash
of the key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt.operators.features import fold, split_name
from forecourt.operators.moments import (
    Design,
    Moments,
    collect_moments,
    complete_cases,
    merged,
)

# Grids of the first searches (fixed values).
RIDGE_ALPHAS = (0.01, 0.03, 0.06, 0.1, 0.3, 0.6, 1, 3, 6, 10, 30, 60)
LASSO_ALPHAS = (0.0001, 0.0003, 0.0006, 0.001, 0.003, 0.006, 0.01, 0.03, 0.06, 0.1, 0.3, 0.6, 1)
NET_ALPHAS = (*LASSO_ALPHAS, 3, 6)
NET_RATIOS = (0.1, 0.3, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95, 1)

# Multiples of the winner tried in the second search (fixed values).
REFINE_ALPHA = (
    0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95,
    1, 1.05, 1.1, 1.15, 1.25, 1.3, 1.35, 1.4,
)
REFINE_RATIO = (0.85, 0.9, 0.95, 1, 1.05, 1.1, 1.15)


@dataclass(frozen=True)
class Penalty:
    """``l1`` and ``l2`` strengths on the scale of the mean squared error over two."""

    l1: float = 0.0
    l2: float = 0.0


@dataclass(frozen=True)
class Fit:
    weights: np.ndarray
    intercept: float

    def sse(self, m: Moments) -> float:
        """Squared error over the rows behind ``m``."""
        w = self.weights
        bias = m.mean[-1] - self.intercept - w @ m.mean[:-1]
        xx, xy, yy = m.cross[:-1, :-1], m.cross[:-1, -1], m.cross[-1, -1]
        return max(float(m.n * bias * bias + yy - 2 * (w @ xy) + w @ xx @ w), 0.0)

    def mse(self, m: Moments) -> float:
        return self.sse(m) / m.n

    def rmse(self, m: Moments) -> float:
        return float(np.sqrt(self.mse(m)))

    def r2(self, m: Moments) -> float | None:
        yy = float(m.cross[-1, -1])
        return 1 - self.sse(m) / yy if yy > 0 else None


def solve(m: Moments, penalty: Penalty = Penalty(), start: np.ndarray | None = None) -> Fit:
    """Least squares with an unpenalised intercept and the given penalties."""
    xx, xy = m.cross[:-1, :-1] / m.n, m.cross[:-1, -1] / m.n
    if penalty.l1 == 0:
        if penalty.l2 > 0:
            w = np.linalg.solve(xx + penalty.l2 * np.eye(len(xy)), xy)
        else:
            w = np.linalg.lstsq(xx, xy, rcond=None)[0]
    else:
        w = _descend(xx, xy, penalty, start)
    return Fit(w, float(m.mean[-1] - w @ m.mean[:-1]))


def _descend(xx, xy, penalty: Penalty, start, sweeps: int = 50_000, tol: float = 1e-13):
    """Coordinate descent on the normal equations.

    Once the signs of the weights settle, the weights solve a plain linear
    system; the descent stops as soon as that solution meets the optimality
    conditions.
    """
    w = np.zeros(len(xy)) if start is None else start.copy()
    curve = np.diag(xx) + penalty.l2
    for _ in range(sweeps):
        signs, moved = np.sign(w), 0.0
        for j in np.flatnonzero(curve > 0):
            pull = xy[j] - xx[j] @ w + xx[j, j] * w[j]
            new = np.sign(pull) * max(abs(pull) - penalty.l1, 0.0) / curve[j]
            moved = max(moved, abs(new - w[j]))
            w[j] = new
        if moved <= tol * max(1.0, float(np.abs(w).max(initial=0.0))):
            break
        if np.array_equal(signs, np.sign(w)):
            exact = _on_signs(xx, xy, penalty, signs)
            if exact is not None:
                return exact
    return w


def _on_signs(xx, xy, penalty: Penalty, signs: np.ndarray) -> np.ndarray | None:
    """The optimum if its weights have these signs, else None."""
    on = np.flatnonzero(signs)
    w = np.zeros(len(xy))
    if len(on):
        system = xx[np.ix_(on, on)] + penalty.l2 * np.eye(len(on))
        try:
            w[on] = np.linalg.solve(system, xy[on] - penalty.l1 * signs[on])
        except np.linalg.LinAlgError:
            return None
    slack = np.abs(xy - xx @ w)
    off = np.setdiff1d(np.arange(len(xy)), on)
    if not np.array_equal(np.sign(w), signs) or (slack[off] > penalty.l1 * (1 + 1e-9)).any():
        return None
    return w


def ridge_penalty(alpha: float, n: float) -> Penalty:
    """Sum of squares plus alpha times the squared weights."""
    return Penalty(l2=alpha / n)


def net_penalty(alpha: float, ratio: float) -> Penalty:
    """Half the mean square plus alpha times the mix of absolute and squared weights."""
    return Penalty(l1=alpha * ratio, l2=alpha * (1 - ratio))


@dataclass(frozen=True)
class LinearData:
    """Moments per (split, fold, inner fold), numerics scaled by the train rows."""

    design: Design
    centre: np.ndarray
    factor: np.ndarray
    parts: dict[tuple, Moments]
    folds: int
    frame: DataFrame

    def rows(self, split: str, keep: Callable[[int, int], bool] = lambda o, i: True) -> Moments | None:
        found = [m for (s, o, i), m in self.parts.items() if s == split and keep(o, i)]
        return merged(found) if found else None

    def fold_parts(self, split: str) -> list[Moments]:
        found = [self.rows(split, lambda o, i, f=f: o == f) for f in range(self.folds)]
        return [m for m in found if m is not None]

    def inner_parts(self, split: str, without: int) -> list[Moments]:
        found = [
            self.rows(split, lambda o, i, f=f: o != without and i == f) for f in range(self.folds)
        ]
        return [m for m in found if m is not None]


def linear_data(
    df: DataFrame,
    numerics: Sequence[str],
    categoricals: Sequence[str],
    label: str,
    key: str = "quote_id",
    train_pct: int = 70,
    folds: int = 3,
    bases: dict[str, object] | None = None,
) -> LinearData:
    """Split by key hash, gather moments in one job and scale numerics by the train rows."""
    outer, inner = fold(key, folds, 1), fold(key, folds, 2)
    split = split_name(key, train_pct)
    # One small number for split and folds keeps the grouping code short: past
    # 8000 bytes the JVM would no longer compile the whole stage.
    part = F.when(split == "train", 0).otherwise(folds * folds) + outer * folds + inner
    frame = df.withColumns({"_split": split, "_part": part})
    design, coded = collect_moments(frame, numerics, categoricals, label, ["_part"], bases)
    parts = {}
    for (code,), m in coded.items():
        at, rest = divmod(code, folds * folds)
        parts[(("train", "test")[at], *divmod(rest, folds))] = m
    train = merged([m for (s, _, _), m in parts.items() if s == "train"])
    width, nn = len(design.names) + 1, len(design.numerics)
    centre, factor = np.zeros(width), np.ones(width)
    std = np.sqrt(np.diag(train.cross)[:nn] / train.n)
    centre[:nn] = train.mean[:nn]
    # A constant column scales to zeros; rounding may leave it a trace of spread.
    varies = std > 1e-10 * np.abs(train.mean[:nn])
    factor[:nn] = np.divide(1.0, std, out=np.zeros(nn), where=varies)
    scaled = {g: m.scaled(centre, factor) for g, m in parts.items()}
    return LinearData(design, centre, factor, scaled, folds, frame)


def _leave_one_out(parts: Sequence[Moments]):
    """(train without fold, fold) pairs."""
    for i, held in enumerate(parts):
        rest = [m for j, m in enumerate(parts) if j != i]
        if rest:
            yield merged(rest), held


def grid_scores(
    parts: Sequence[Moments], candidates: Sequence, to_penalty: Callable, criterion: str = "mse"
) -> list[float]:
    """Mean held-out loss of each candidate over the folds (``mse``, or ``r2`` as 1 - R2)."""
    losses = np.zeros((len(candidates), 0))
    for train, held in _leave_one_out(parts):
        column, start = [], None
        for c in candidates:
            fit = solve(train, to_penalty(c, train.n), start)
            start = fit.weights
            r2 = fit.r2(held) if criterion == "r2" else None
            column.append(fit.mse(held) if criterion == "mse" else 1 - (r2 if r2 is not None else 0))
        losses = np.column_stack([losses, column])
    return list(losses.mean(axis=1))


def _best(candidates: Sequence, scores: Sequence[float]):
    return candidates[int(np.argmin(scores))]


@dataclass(frozen=True)
class LinearModel:
    """A fitted model with the scores the reports show."""

    name: str
    data: LinearData
    fit: Fit
    alpha: float | None
    ratio: float | None
    refit: Callable[[Sequence[Moments]], Fit]

    def train_rmse(self) -> float:
        return self.fit.rmse(self.data.rows("train"))

    def train_r2(self) -> float | None:
        return self.fit.r2(self.data.rows("train"))

    def holdout_rmse(self) -> float | None:
        test = self.data.rows("test")
        return self.fit.rmse(test) if test else None

    def holdout_r2(self) -> float | None:
        test = self.data.rows("test")
        return self.fit.r2(test) if test else None

    def cv_rmse(self, split: str = "train") -> float | None:
        """Mean of the per-fold errors; the search is repeated inside every fold.

        On the test split this refits within the test rows, so it is no
        hold-out score.
        """
        errors = []
        for f in range(self.data.folds):
            held = self.data.rows(split, lambda o, i, f=f: o == f)
            inner = self.data.inner_parts(split, f)
            if held is not None and inner:
                errors.append(self.refit(inner).rmse(held))
        return float(np.mean(errors)) if errors else None

    def report(self) -> dict:
        return {
            "model": self.name,
            "alpha": None if self.alpha is None else float(self.alpha),
            "l1_ratio": None if self.ratio is None else float(self.ratio),
            "train_rmse": self.train_rmse(),
            "train_r2": self.train_r2(),
            "cv_rmse_train": self.cv_rmse("train"),
            "cv_rmse_test": self.cv_rmse("test"),
            "holdout_rmse": self.holdout_rmse(),
            "holdout_r2": self.holdout_r2(),
        }

    def coefficients(self) -> DataFrame:
        """Feature and weight on the standardised scale, smallest first, with the intercept last."""
        spark = self.data.frame.sparkSession
        pairs = [(n, float(w)) for n, w in zip(self.data.design.names, self.fit.weights)]
        rows = [(i, n, w) for i, (n, w) in enumerate(sorted(pairs, key=lambda p: (p[1], p[0])))]
        rows.append((len(rows), "(intercept)", float(self.fit.intercept)))
        return spark.createDataFrame(rows, "position int, feature string, coefficient double")

    def prediction(self) -> Column:
        """The model as a column over the raw features."""
        design, nn = self.data.design, len(self.data.design.numerics)
        total = F.lit(float(self.fit.intercept))
        for i, c in enumerate(design.numerics):
            slope = float(self.fit.weights[i] * self.data.factor[i])
            total = total + (F.col(f"`{c}`").cast("double") - float(self.data.centre[i])) * slope
        weights: dict[str, dict] = {}
        for (c, v), w in zip(design.dummies, self.fit.weights[nn:]):
            weights.setdefault(c, {})[v] = float(w)
        for c, by_level in weights.items():
            table = F.create_map(*[F.lit(x) for pair in by_level.items() for x in pair])
            total = total + F.coalesce(F.try_element_at(table, F.col(f"`{c}`")), F.lit(0.0))
        return total

    def transform(self, df: DataFrame, col: str = "prediction") -> DataFrame:
        return df.withColumn(col, self.prediction())


def ols(data: LinearData) -> LinearModel:
    """Least squares without a penalty."""

    def refit(parts):
        return solve(merged(parts))

    return LinearModel("ols", data, solve(data.rows("train")), None, None, refit)


def loo_scores(data: LinearData, alphas: Sequence[float]) -> list[float]:
    """Mean squared leave-one-out error of ridge on the train rows, per alpha.

    Uses the closed form residual / (1 - leverage); every row is needed once.
    Tasks rotate their rows onto the eigenvectors of the train matrix and
    return one sum per alpha and batch.
    """
    design, train = data.design, data.rows("train")
    nn = len(design.numerics)
    eig, vec = np.linalg.eigh(train.cross[:-1, :-1])
    eig = np.maximum(eig, 0.0)
    rotated = vec.T @ train.cross[:-1, -1]
    strength = np.array(alphas, dtype=float)
    inverse = 1.0 / (eig[:, None] + strength[None, :])
    target = rotated[:, None] * inverse
    numerics, dummies, label = list(design.numerics), design.dummies, design.label
    cats = list(design.levels)
    centre, factor, mean, n = data.centre, data.factor, train.mean, train.n

    def partial(batches):
        for pdf in batches:
            x = np.zeros((len(pdf), len(mean) - 1))
            x[:, :nn] = (pdf[numerics].to_numpy(dtype=float) - centre[:nn]) * factor[:nn]
            for k, (c, v) in enumerate(dummies):
                x[:, nn + k] = (pdf[c] == v).to_numpy(dtype=float)
            z = (x - mean[:-1]) @ vec
            error = (pdf[label].to_numpy(dtype=float) - mean[-1])[:, None] - z @ target
            leverage = 1.0 / n + (z * z) @ inverse
            loss = ((error / (1.0 - leverage)) ** 2).sum(axis=0)
            yield pd.DataFrame({"i": np.arange(len(loss)), "loss": loss})

    rows = (
        complete_cases(data.frame.filter("_split = 'train'"), [*numerics, *cats, label])
        .select(*numerics, *cats, label)
        .mapInPandas(partial, "i int, loss double")
        .groupBy("i")
        .agg(F.sum("loss").alias("loss"))
        .collect()
    )
    by_alpha = {r["i"]: r["loss"] / n for r in rows}
    return [by_alpha[i] for i in range(len(alphas))]


def ridge_cv(
    data: LinearData, alphas: Sequence[float] = RIDGE_ALPHAS, first: str = "loo"
) -> LinearModel:
    """Ridge: a coarse search, then a fine one around its winner.

    The coarse search uses leave-one-out errors (``first="loo"``, one more
    pass) or the folds (``"folds"``); the fine one the mean R2 over the folds.
    """
    parts = data.fold_parts("train")
    if first == "loo":
        alpha = _best(alphas, loo_scores(data, alphas))
    else:
        alpha = _best(alphas, grid_scores(parts, alphas, ridge_penalty))
    fine = [alpha * m for m in REFINE_ALPHA]

    def search(ps):
        return _best(fine, grid_scores(ps, fine, ridge_penalty, "r2"))

    def refit(ps):
        rows = merged(ps)
        return solve(rows, ridge_penalty(search(ps), rows.n))

    alpha = search(parts)
    train = data.rows("train")
    return LinearModel("ridge", data, solve(train, ridge_penalty(alpha, train.n)), alpha, None, refit)


def lasso_cv(data: LinearData, alphas: Sequence[float] = LASSO_ALPHAS) -> LinearModel:
    """Lasso: a coarse search over the folds, then a fine one around its winner."""
    parts = data.fold_parts("train")

    def penalty(a, _n):
        return net_penalty(a, 1.0)

    alpha = _best(alphas, grid_scores(parts, alphas, penalty))
    fine = [alpha * m for m in REFINE_ALPHA]

    def search(ps):
        return _best(fine, grid_scores(ps, fine, penalty))

    def refit(ps):
        return solve(merged(ps), net_penalty(search(ps), 1.0))

    alpha = search(parts)
    return LinearModel("lasso", data, solve(data.rows("train"), net_penalty(alpha, 1.0)), alpha, 1.0, refit)


def elastic_net_cv(
    data: LinearData,
    ratios: Sequence[float] = NET_RATIOS,
    alphas: Sequence[float] = NET_ALPHAS,
) -> LinearModel:
    """Elastic net: search mix and strength, refine the mix, then the strength.

    Refined mixes above one are cut to one before they are fitted.
    """
    parts = data.fold_parts("train")

    def penalty(c, _n):
        return net_penalty(c[1], c[0])

    def best(ps, rs, als):
        grid = [(r, a) for r in rs for a in als]
        return _best(grid, grid_scores(ps, grid, penalty))

    ratio, _ = best(parts, ratios, alphas)
    near = sorted({min(ratio * m, 1.0) for m in REFINE_RATIO})
    ratio, alpha = best(parts, near, alphas)
    fine = [alpha * m for m in REFINE_ALPHA]

    def refit(ps):
        return solve(merged(ps), net_penalty(best(ps, [ratio], fine)[1], ratio))

    _, alpha = best(parts, [ratio], fine)
    fit = solve(data.rows("train"), net_penalty(alpha, ratio))
    return LinearModel("elastic_net", data, fit, alpha, ratio, refit)


REPORT_SCHEMA = (
    "model string, alpha double, l1_ratio double, train_rmse double, train_r2 double, "
    "cv_rmse_train double, cv_rmse_test double, holdout_rmse double, holdout_r2 double"
)


def report(models: Sequence[LinearModel]) -> DataFrame:
    """One row of scores per model."""
    spark = models[0].data.frame.sparkSession
    return spark.createDataFrame([tuple(m.report().values()) for m in models], REPORT_SCHEMA)

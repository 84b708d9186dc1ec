"""Penalised least squares over columns with any number of levels; the weights are a Spark table.

Rows shrink once to cells of equal levels, and those to sums per level and
counts per pair of levels that occur together: the normal equations in long
form, without a dummy column. A factor's dummies exclude each other, so, given
all else, each of their weights has a closed form but for one number they
share, their mean effect, which one aggregate finds. A sweep updates the
factors in turn, for all penalties and folds of a search at once. Only sums
per fit, and the weights of the few numeric columns, come to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecourt.functions.frames import stored
from forecourt.operators.features import fold, split_name
from forecourt.operators.linear import (
    LASSO_ALPHAS,
    NET_ALPHAS,
    NET_RATIOS,
    REFINE_ALPHA,
    REFINE_RATIO,
    RIDGE_ALPHAS,
    Penalty,
    net_penalty,
    ridge_penalty,
)
from forecourt.operators.moments import Moments, complete_cases, merged, origin

#: Sweeps at most, and the change of a fit's sums, relative to their size, that ends them.
SWEEPS, TOLERANCE = 200, 1e-9


@dataclass(frozen=True)
class Task:
    """A fit: the set of rows it sees and its penalty."""

    rows: str
    penalty: Penalty


@dataclass(frozen=True)
class WideData:
    """Sums by set of rows: of numerics on the driver, of levels and pairs of levels as tables.

    ``levels`` has (set, b, l, n, y, x0, x1, ...), centred on the set's means;
    ``pairs`` has (set, b, l, c, m, n) for levels of different factors, both ways.
    """

    numerics: tuple[str, ...]
    factors: tuple[str, ...]
    label: str
    bases: tuple[str | None, ...]
    centre: np.ndarray
    factor: np.ndarray
    sets: dict[str, Moments]
    levels: DataFrame
    pairs: DataFrame
    frame: DataFrame
    folds: int


def wide_data(
    df: DataFrame,
    numerics: Sequence[str],
    factors: Sequence[str],
    label: str,
    key: str = "quote_id",
    train_pct: int = 70,
    folds: int = 3,
    bases: dict[str, object] | None = None,
) -> WideData:
    """Split by key hash and gather the sums of every set of rows that a search needs.

    The sets are ``train``, ``test`` and, for each fold h of the train rows,
    ``h`` and all others, ``-h``. The base of a factor, which has no weight, is
    its rarest level.
    """
    numerics, factors, nn = tuple(numerics), tuple(factors), len(numerics)
    frame = df.withColumns({"_split": split_name(key, train_pct), "_fold": fold(key, folds, 1)})
    rows = complete_cases(frame, [*numerics, *factors, label])
    zero = origin(rows, [*numerics, label])
    values = [F.col(f"`{c}`").cast("double") - F.lit(zero[c]) for c in (*numerics, label)]
    part = F.when(F.col("_split") == "train", F.col("_fold")).otherwise(folds)
    rows = rows.select(
        part.alias("part"),
        *[F.col(f"`{c}`").cast("string").alias(f"f{b}") for b, c in enumerate(factors)],
        *[v.alias(f"x{k}") for k, v in enumerate(values)],
    )
    products = [(a, b) for a in range(nn + 1) for b in range(a, nn + 1)]
    cells = stored(
        rows.groupBy("part", *[f"f{b}" for b in range(len(factors))]).agg(
            F.count("*").alias("n"),
            *[F.sum(f"x{k}").alias(f"s{k}") for k in range(nn + 1)],
            *[F.sum(F.col(f"x{a}") * F.col(f"x{b}")).alias(f"p{a}_{b}") for a, b in products],
        )
    )

    # A row for each part, of which there are one more than folds.
    moments = {}
    totals = cells.groupBy("part").agg(*[F.sum(c).alias(c) for c in cells.columns if c == "n" or c[0] in "sp" and c != "part"])
    for r in totals.collect():
        total = np.array([r[f"s{k}"] for k in range(nn + 1)])
        cross = np.zeros((nn + 1, nn + 1))
        for a, b in products:
            cross[a, b] = cross[b, a] = r[f"p{a}_{b}"] - total[a] * total[b] / r.n
        moments[r.part] = Moments(r.n, total / r.n, cross)
    parts = {"train": range(folds), "test": [folds]}
    for h in range(folds):
        parts |= {str(h): [h], f"-{h}": [k for k in range(folds) if k != h]}
    parts = {s: [p for p in ps if p in moments] for s, ps in parts.items()}
    parts = {s: ps for s, ps in parts.items() if ps}
    sets = {s: merged([moments[p] for p in ps]) for s, ps in parts.items()}
    train = sets["train"]
    std = np.sqrt(np.diag(train.cross)[:nn] / train.n)
    centre, factor = np.zeros(nn + 1), np.ones(nn + 1)
    centre[:nn] = train.mean[:nn]
    size = np.abs(train.mean[:nn] + [zero[c] for c in numerics])
    factor[:nn] = np.divide(1.0, std, out=np.zeros(nn), where=std > 1e-10 * size)
    sets = {s: m.scaled(centre, factor) for s, m in sets.items()}

    of_factor = [F.struct(F.lit(b).alias("b"), F.col(f"f{b}").alias("l")) for b in range(len(factors))]
    levels = cells.select("part", "n", *[f"s{k}" for k in range(nn + 1)], F.inline(F.array(*of_factor)))
    levels = levels.groupBy("part", "b", "l").agg(*[F.sum(c).alias(c) for c in ("n", *[f"s{k}" for k in range(nn + 1)])])
    levels = stored(levels)
    bases = bases or {}
    rarest = levels.groupBy("b", "l").agg(F.sum("n").alias("n")).groupBy("b").agg(F.max(F.struct(-F.col("n"), "l")).alias("r"))
    rarest = {r.b: r.r.l for r in rarest.collect()}
    chosen = tuple(str(bases[c]) if c in bases else rarest.get(b) for b, c in enumerate(factors))
    spark = df.sparkSession
    ends = [(b, v) for b, v in enumerate(chosen) if v is not None]
    based = F.broadcast(spark.createDataFrame(ends, "b int, l string"))
    member = F.broadcast(spark.createDataFrame([(s, p) for s, ps in parts.items() for p in ps], "set string, part int"))
    means = F.broadcast(
        spark.createDataFrame(
            [(s, *map(float, merged([moments[p] for p in ps]).mean)) for s, ps in parts.items()],
            "set string, " + ", ".join(f"m{k} double" for k in range(nn + 1)),
        )
    )
    levels = levels.join(based, ["b", "l"], "left_anti").join(member, "part").groupBy("set", "b", "l")
    levels = levels.agg(*[F.sum(c).alias(c) for c in ("n", *[f"s{k}" for k in range(nn + 1)])]).join(means, "set")
    levels = stored(
        levels.select(
            "set",
            "b",
            "l",
            F.col("n").cast("double").alias("n"),
            (F.col(f"s{nn}") - F.col("n") * F.col(f"m{nn}")).alias("y"),
            *[((F.col(f"s{k}") - F.col("n") * F.col(f"m{k}")) * float(factor[k])).alias(f"x{k}") for k in range(nn)],
        )
    )
    couples = [(b, c) for b, c in combinations(range(len(factors)), 2)]
    if couples:
        both = [
            F.struct(F.lit(b).alias("b"), F.col(f"f{b}").alias("l"), F.lit(c).alias("c"), F.col(f"f{c}").alias("m"))
            for b, c in couples
        ]
        pairs = cells.select("part", "n", F.inline(F.array(*both))).groupBy("part", "b", "l", "c", "m").agg(F.sum("n").alias("n"))
        pairs = pairs.join(based, ["b", "l"], "left_anti").join(based.toDF("c", "m"), ["c", "m"], "left_anti")
        pairs = pairs.join(member, "part").groupBy("set", "b", "l", "c", "m").agg(F.sum("n").cast("double").alias("n"))
        turned = pairs.select("set", F.col("c").alias("b"), F.col("m").alias("l"), F.col("b").alias("c"), F.col("l").alias("m"), "n")
        pairs = stored(pairs.unionByName(turned))
    else:
        pairs = spark.createDataFrame([], "set string, b int, l string, c int, m string, n double")
    real = np.array([zero[c] for c in (*numerics, label)])
    # The label's origin goes into the intercept; that of a numeric column into its centre.
    centre = centre + real * (np.arange(nn + 1) < nn)
    sets = {s: Moments(m.n, m.mean + real * (np.arange(nn + 1) == nn), m.cross) for s, m in sets.items()}
    return WideData(numerics, factors, label, chosen, centre, factor, sets, levels, pairs, frame, folds)


@dataclass(frozen=True)
class Fits:
    """Fitted tasks: weights of levels (task, b, l, w; no row for zero), of numerics, and intercepts."""

    data: WideData
    tasks: list[Task]
    weights: DataFrame
    slopes: np.ndarray
    intercepts: np.ndarray


def _small_solve(xx: np.ndarray, pull: np.ndarray, penalty: Penalty, n: float, start: np.ndarray) -> np.ndarray:
    """Weights of the few numerics, given all else."""
    w = start.copy()
    for _ in range(10_000):
        before = w.copy()
        for k in np.flatnonzero(np.diag(xx) > 0):
            part = pull[k] - xx[k] @ w + xx[k, k] * w[k]
            w[k] = np.sign(part) * max(abs(part) - n * penalty.l1, 0.0) / (xx[k, k] + n * penalty.l2)
        if np.abs(w - before).max(initial=0.0) <= 1e-14 * np.abs(w).max(initial=1.0):
            break
    return w


def _sums(weights: DataFrame, levels: DataFrame, numerics: int, tasks: DataFrame) -> dict:
    """Sums over the weights of each task and factor: of n w, n w^2, y w and each numeric's x w, over the task's set."""
    rows = weights.join(tasks.select("task", "set"), "task").join(levels, ["set", "b", "l"])
    aggs = [F.sum(F.col("n") * F.col("w")), F.sum(F.col("n") * F.col("w") * F.col("w")), F.sum(F.col("y") * F.col("w"))]
    aggs += [F.sum(F.col(f"x{k}") * F.col("w")) for k in range(numerics)]
    named = [a.alias(f"a{i}") for i, a in enumerate(aggs)]
    return {(r[0], r[1]): np.array(r[2:], float) for r in rows.groupBy("task", "b").agg(*named).collect()}


def _update(data: WideData, b: int, weights: dict[int, DataFrame], state: DataFrame, couples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New weights of factor ``b`` for all tasks, and ``state`` with its new mean effect ``t``."""
    nn, others = len(data.numerics), [c for c in range(len(data.factors)) if c != b]
    pull = F.col("y") - sum((F.col(f"x{k}") * F.col(f"beta{k}") for k in range(nn)), F.lit(0.0))
    pull = pull + F.col("n") * sum((F.col(f"t{c}") for c in others), F.lit(0.0))
    rows = data.levels.filter(F.col("b") == b).join(F.broadcast(state), "set")
    if others:
        known = reduce(DataFrame.unionByName, [weights[c] for c in others])
        known = known.select("task", F.col("b").alias("c"), F.col("l").alias("m"), "w")
        shared = couples.filter(F.col("b") == b).join(known, ["task", "c", "m"])
        shared = shared.groupBy("task", "l").agg(F.sum(F.col("n") * F.col("w")).alias("q"))
        rows = rows.join(shared, ["task", "l"], "left")
        pull = pull - F.coalesce("q", F.lit(0.0))
    rows = rows.select("task", "l", "n", pull.alias("pull"), "l1", "l2", f"t{b}", "size")
    near = F.col("pull") + F.col("n") * F.col(f"t{b}")
    on = F.abs(near) > F.col("l1")
    own = F.col("n") / (F.col("n") + F.col("l2"))
    mean = rows.groupBy("task").agg(
        (
            F.coalesce(F.sum(F.when(on, own * (F.col("pull") - F.col("l1") * F.signum(near)))), F.lit(0.0))
            / (F.max("size") - F.coalesce(F.sum(F.when(on, own * F.col("n"))), F.lit(0.0)))
        ).alias("t")
    )
    rows = rows.drop(f"t{b}").join(F.broadcast(mean), "task")
    z = F.col("pull") + F.col("n") * F.col("t")
    w = F.signum(z) * F.greatest(F.abs(z) - F.col("l1"), F.lit(0.0)) / (F.col("n") + F.col("l2"))
    new = stored(rows.select("task", F.lit(b).alias("b"), "l", w.alias("w"), "t").filter("w <> 0"))
    # Without a weight the mean effect is zero; all rows of a task carry the same.
    mean = new.groupBy("task").agg(F.max("t").alias(f"t{b}"))
    state = state.drop(f"t{b}").join(mean, "task", "left").fillna(0.0, [f"t{b}"])
    return new.drop("t"), state


def fit(data: WideData, tasks: Sequence[Task]) -> Fits:
    """Fit every task; an intercept is not penalised."""
    tasks, nn, nb = list(tasks), len(data.numerics), len(data.factors)
    spark = data.frame.sparkSession
    moments = [data.sets[t.rows] for t in tasks]
    beta = np.zeros((len(tasks), nn))
    sums: dict = {}
    weights = {b: spark.createDataFrame([], "task int, b int, l string, w double") for b in range(nb)}
    schema = "task int, set string, l1 double, l2 double, size double"
    schema += "".join(f", beta{k} double" for k in range(nn)) + "".join(f", t{b} double" for b in range(nb))
    fixed = spark.createDataFrame([(i, t.rows) for i, t in enumerate(tasks)], "task int, set string")
    # Pairs of levels for each task: tasks of one set share its pairs.
    couples = data.pairs.join(F.broadcast(fixed), "set").drop("set")
    empty = np.zeros(3 + nn)
    for sweep in range(SWEEPS):
        before = np.concatenate([beta.ravel(), *[sums.get((i, b), empty) for i in range(len(tasks)) for b in range(nb)]])
        for i, (t, m) in enumerate(zip(tasks, moments, strict=True)):
            part = sum((sums.get((i, b), empty)[3:] for b in range(nb)), np.zeros(nn))
            beta[i] = _small_solve(m.cross[:-1, :-1], m.cross[:-1, -1] - part, t.penalty, m.n, beta[i])
        rows = [
            (i, t.rows, float(m.n * t.penalty.l1), float(m.n * t.penalty.l2), float(m.n), *map(float, beta[i]),
             *[float(sums.get((i, b), empty)[0] / m.n) for b in range(nb)])
            for i, (t, m) in enumerate(zip(tasks, moments, strict=True))
        ]
        state = spark.createDataFrame(rows, schema)
        for b in range(nb):
            weights[b], state = _update(data, b, weights, state, couples)
        if nb:
            sums = _sums(reduce(DataFrame.unionByName, weights.values()), data.levels, nn, fixed)
        now = np.concatenate([beta.ravel(), *[sums.get((i, b), empty) for i in range(len(tasks)) for b in range(nb)]])
        if not nb or sweep and np.all(np.abs(now - before) <= TOLERANCE * np.maximum(np.abs(now), 1.0)):
            break
    shift = np.array([sum(sums.get((i, b), empty)[0] for b in range(nb)) / m.n for i, m in enumerate(moments)])
    means = np.array([m.mean for m in moments])
    intercepts = means[:, -1] - (beta * means[:, :-1]).sum(axis=1) - shift
    table = reduce(DataFrame.unionByName, weights.values()) if nb else spark.createDataFrame([], "task int, b int, l string, w double")
    return Fits(data, tasks, stored(table), beta, intercepts)


def errors(fits: Fits, rows: Sequence[str]) -> list[tuple[float, float | None]]:
    """Mean squared error and R2 of each task over the set named for it."""
    data, nn, nb = fits.data, len(fits.data.numerics), len(fits.data.factors)
    spark = data.frame.sparkSession
    where = spark.createDataFrame(list(enumerate(rows)), "task int, set string")
    sums = _sums(fits.weights, data.levels, nn, where)
    w = fits.weights
    left, right = w.toDF("task", "b", "l", "w"), w.toDF("task", "c", "m", "v")
    pairs = data.pairs.filter("b < c").join(F.broadcast(where), "set").join(left, ["task", "b", "l"]).join(right, ["task", "c", "m"])
    pairs = {r.task: r.e for r in pairs.groupBy("task").agg(F.sum(F.col("n") * F.col("w") * F.col("v")).alias("e")).collect()}
    out = []
    for i, s in enumerate(rows):
        m, beta = data.sets[s], fits.slopes[i]
        own = [sums.get((i, b), np.zeros(3 + nn)) for b in range(nb)]
        total = sum(own, np.zeros(3 + nn))
        xx, xy, yy = m.cross[:-1, :-1], m.cross[:-1, -1], m.cross[-1, -1]
        spread = total[1] + 2 * pairs.get(i, 0.0) - total[0] ** 2 / m.n
        bias = m.mean[-1] - fits.intercepts[i] - beta @ m.mean[:-1] - total[0] / m.n
        sse = yy - 2 * beta @ xy - 2 * total[2] + beta @ xx @ beta + 2 * beta @ total[3:] + spread + m.n * bias**2
        sse = max(float(sse), 0.0)
        out.append((sse / m.n, 1 - sse / float(yy) if yy > 0 else None))
    return out


@dataclass(frozen=True)
class WideModel:
    """The winner of a search, fitted on the train rows."""

    name: str
    alpha: float
    ratio: float | None
    fits: Fits

    def coefficients(self) -> DataFrame:
        """Feature and weight on the standardised scale, of numerics, all levels but the bases, and the intercept."""
        data = self.fits.data
        spark = data.frame.sparkSession
        rows = [(c, float(v)) for c, v in zip(data.numerics, self.fits.slopes[0], strict=True)]
        rows.append(("(intercept)", float(self.fits.intercepts[0])))
        names = F.element_at(F.array(*map(F.lit, data.factors)), F.col("b") + 1)
        levels = data.levels.select("b", "l").distinct().join(self.fits.weights.select("b", "l", "w"), ["b", "l"], "left")
        levels = levels.select(F.concat(names, F.lit("_"), "l").alias("feature"), F.coalesce("w", F.lit(0.0)).alias("coefficient"))
        return spark.createDataFrame(rows, "feature string, coefficient double").union(levels)

    def transform(self, df: DataFrame, col: str = "prediction") -> DataFrame:
        """``df`` with predictions; levels that the train rows lack count as the base."""
        data, fits = self.fits.data, self.fits
        total = F.lit(float(fits.intercepts[0]))
        for k, c in enumerate(data.numerics):
            total = total + (F.col(f"`{c}`").cast("double") - float(data.centre[k])) * float(fits.slopes[0][k] * data.factor[k])
        out = df
        for b, c in enumerate(data.factors):
            level = fits.weights.filter(F.col("b") == b).select(F.col("l").alias(f"_l{b}"), F.col("w").alias(f"_w{b}"))
            out = out.join(level, F.col(f"`{c}`").cast("string") == F.col(f"_l{b}"), "left")
            total = total + F.coalesce(f"_w{b}", F.lit(0.0))
        return out.withColumn(col, total).select(*df.columns, col)

    def report(self) -> tuple:
        (train_mse, train_r2), test = errors(self.fits, ["train"])[0], (None, None)
        if "test" in self.fits.data.sets:
            test = errors(self.fits, ["test"])[0]
        used = self.fits.weights.count() + int(np.count_nonzero(self.fits.slopes[0]))
        rmse = None if test[0] is None else float(np.sqrt(test[0]))
        return (self.name, float(self.alpha), self.ratio, used, float(np.sqrt(train_mse)), train_r2, rmse, test[1])


def _search(data: WideData, grid: list, to_penalty, criterion: str = "mse"):
    """The candidate of ``grid`` with the least mean loss over the folds, the first without folds; all are fitted together."""
    folds = [h for h in range(data.folds) if str(h) in data.sets and f"-{h}" in data.sets]
    if not folds:
        return grid[0]
    tasks = [Task(f"-{h}", to_penalty(c, data.sets[f"-{h}"].n)) for c in grid for h in folds]
    found = errors(fit(data, tasks), [str(h) for _ in grid for h in folds])
    loss = [mse if criterion == "mse" else 1 - (r2 if r2 is not None else 0) for mse, r2 in found]
    return grid[int(np.argmin(np.array(loss).reshape(len(grid), -1).mean(axis=1)))]


def _winner(name: str, data: WideData, alpha: float, ratio: float | None, penalty: Penalty) -> WideModel:
    return WideModel(name, alpha, ratio, fit(data, [Task("train", penalty)]))


def ridge(data: WideData, alphas: Sequence[float] = RIDGE_ALPHAS) -> WideModel:
    """Ridge: a coarse search over the folds, then a fine one around its winner by R2."""
    alpha = _search(data, list(alphas), ridge_penalty)
    alpha = _search(data, [alpha * m for m in REFINE_ALPHA], ridge_penalty, "r2")
    return _winner("ridge", data, alpha, None, ridge_penalty(alpha, data.sets["train"].n))


def lasso(data: WideData, alphas: Sequence[float] = LASSO_ALPHAS) -> WideModel:
    """Lasso: a coarse search over the folds, then a fine one around its winner."""

    def penalty(a, _n):
        return net_penalty(a, 1.0)

    alpha = _search(data, list(alphas), penalty)
    alpha = _search(data, [alpha * m for m in REFINE_ALPHA], penalty)
    return _winner("lasso", data, alpha, 1.0, net_penalty(alpha, 1.0))


def elastic_net(data: WideData, ratios: Sequence[float] = NET_RATIOS, alphas: Sequence[float] = NET_ALPHAS) -> WideModel:
    """Elastic net: search mix and strength, refine the mix, then the strength."""

    def penalty(c, _n):
        return net_penalty(c[1], c[0])

    ratio, _ = _search(data, [(r, a) for r in ratios for a in alphas], penalty)
    near = sorted({min(ratio * m, 1.0) for m in REFINE_RATIO})
    ratio, alpha = _search(data, [(r, a) for r in near for a in alphas], penalty)
    ratio, alpha = _search(data, [(ratio, alpha * m) for m in REFINE_ALPHA], penalty)
    return _winner("elastic_net", data, alpha, float(ratio), net_penalty(alpha, ratio))


def report(models: Sequence[WideModel]) -> DataFrame:
    """One row of scores per model; ``n_weights`` counts the weights that are not zero."""
    spark = models[0].fits.data.frame.sparkSession
    return spark.createDataFrame(
        [m.report() for m in models],
        "model string, alpha double, l1_ratio double, n_weights long, train_rmse double, train_r2 double, holdout_rmse double, holdout_r2 double",
    )

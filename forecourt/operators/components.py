"""Principal components from moments, with projected rows, and clusters that prove to be settled."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt.functions.columns import correlation
from forecourt.functions.frames import beside
from forecourt.operators.moments import complete_cases


@dataclass(frozen=True)
class Components:
    """Directions of the standardised columns, by falling variance; the largest weight of each is positive."""

    columns: tuple[str, ...]
    mean: np.ndarray
    std: np.ndarray
    variance: np.ndarray
    directions: np.ndarray  # a row for each component

    def project(self, df: DataFrame, k: int | None = None, prefix: str = "pc") -> DataFrame:
        """``df`` with the first ``k`` components as columns; null where a column is. A constant column adds nothing."""
        parts = {}
        for i, direction in enumerate(self.directions[:k]):
            total = F.lit(0.0)
            for c, m, s, w in zip(self.columns, self.mean, self.std, direction, strict=True):
                total = total + (F.col(f"`{c}`").cast("double") - float(m)) * float(w / s if s > 0 else 0.0)
            parts[f"{prefix}{i + 1}"] = total
        return df.withColumns(parts)

    def shares(self, df: DataFrame) -> DataFrame:
        """(component, variance_share)."""
        total = self.variance.sum()
        rows = [(i + 1, float(v / total) if total > 0 else None) for i, v in enumerate(self.variance)]
        return df.sparkSession.createDataFrame(rows, "component int, variance_share double")


def principal_components(df: DataFrame, columns: Sequence[str]) -> Components:
    """Components of the correlation matrix of some columns, over the rows that have all of them; one aggregate."""
    columns = tuple(columns)
    rows = complete_cases(df, columns).select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    pairs = [(a, b) for a in range(len(columns)) for b in range(a)]
    found = rows.agg(
        *[F.avg(f"x{i}").alias(f"m{i}") for i in range(len(columns))],
        *[F.stddev_pop(f"x{i}").alias(f"s{i}") for i in range(len(columns))],
        *[correlation(F.col(f"x{a}"), F.col(f"x{b}")).alias(f"r{a}_{b}") for a, b in pairs],
    ).first()
    mean = np.array([found[f"m{i}"] or 0.0 for i in range(len(columns))])
    std = np.array([found[f"s{i}"] or 0.0 for i in range(len(columns))])
    matrix = np.diag((std > 0).astype(float))
    for a, b in pairs:
        matrix[a, b] = matrix[b, a] = found[f"r{a}_{b}"] or 0.0
    variance, vectors = np.linalg.eigh(matrix)
    order = np.argsort(-variance, kind="stable")
    directions = vectors.T[order]
    largest = np.abs(directions).argmax(axis=1)
    directions = directions * np.sign(directions[np.arange(len(order)), largest])[:, None]
    return Components(columns, mean, std, np.maximum(variance[order], 0.0), directions)


@dataclass(frozen=True)
class Clusters:
    """Centres of clusters of standardised columns."""

    columns: tuple[str, ...]
    mean: np.ndarray
    std: np.ndarray
    centres: np.ndarray

    def _scaled(self) -> list[Column]:
        return [
            (F.col(f"`{c}`").cast("double") - float(m)) / float(s if s > 0 else 1.0)
            for c, m, s in zip(self.columns, self.mean, self.std, strict=True)
        ]

    def distances(self) -> list[Column]:
        """Squared distance of a row to each centre."""
        scaled = self._scaled()
        return [sum(((x - float(v)) * (x - float(v)) for x, v in zip(scaled, centre, strict=True)), F.lit(0.0)) for centre in self.centres]

    def assign(self, df: DataFrame, col: str = "cluster") -> DataFrame:
        """``df`` with the number of the nearest centre, of equally near ones the first."""
        far = F.array(*self.distances())
        return df.withColumn(col, F.array_position(far, F.array_min(far)).cast("int") - 1)

    def settled(self, assigned: DataFrame, col: str = "cluster", within: float = 1e-6) -> DataFrame:
        """One row: rows, clusters, rows that another centre is nearer to, centres that aren't the mean of their rows."""
        far = F.array(*self.distances())
        own = F.element_at(far, F.col(col) + 1)
        rows = assigned.select(F.col(col).alias("k"), (own > F.array_min(far) + within).alias("astray"), *[x.alias(f"x{i}") for i, x in enumerate(self._scaled())])
        per = rows.groupBy("k").agg(
            F.count("*").alias("n"),
            F.sum(F.col("astray").cast("long")).alias("astray"),
            F.array(*[F.avg(f"x{i}") for i in range(len(self.columns))]).alias("mean"),
        )
        centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in self.centres])
        gap = F.zip_with(F.col("mean"), F.element_at(centres, F.col("k") + 1), lambda a, b: F.abs(a - b))
        return per.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
            F.count("*").alias("n_clusters"),
            F.coalesce(F.sum("astray"), F.lit(0)).alias("n_astray"),
            F.count(F.when(F.array_max(gap) > within, 1)).alias("n_off_centre"),
        )


def k_means(df: DataFrame, columns: Sequence[str], k: int = 4, seed: int = 1, steps: int = 500) -> Clusters:
    """Centres by Spark's k-means over the rows that have all columns, run until they stand still."""
    columns = tuple(columns)
    rows = complete_cases(df, columns)
    stats = rows.agg(
        *[F.avg(F.col(f"`{c}`").cast("double")).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(F.col(f"`{c}`").cast("double")).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    mean = np.array([stats[f"m{i}"] or 0.0 for i in range(len(columns))])
    std = np.array([stats[f"s{i}"] or 0.0 for i in range(len(columns))])
    start = Clusters(columns, mean, std, np.zeros((0, len(columns))))
    scaled = rows.select(*[x.alias(f"x{i}") for i, x in enumerate(start._scaled())])
    stages = [
        VectorAssembler(inputCols=scaled.columns, outputCol="features"),
        KMeans(k=k, seed=seed, maxIter=steps, tol=1e-10),
    ]
    centres = Pipeline(stages=stages).fit(scaled).stages[-1].clusterCenters()
    return Clusters(columns, mean, std, np.array(centres))

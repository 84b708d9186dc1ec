"""Spark ML estimators over quotes: feature stages, linear and tree models, tuning, clustering."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import (
    PCA,
    OneHotEncoder,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecourt.operators.features import fold
from forecourt.sources.quotes import stored

LABEL = "label"


def feature_stages(
    categoricals: Sequence[str], numerics: Sequence[str], unseen: str = "error"
) -> Pipeline:
    """Index and encode categoricals, scale numerics by sample deviation, join both as ``features``.

    Levels are indexed by frequency and the last slot is dropped. With
    ``unseen="error"`` that is the rarest level, and ``predict`` scores new
    levels; with ``"keep"`` it is an extra slot for levels the fit has not
    seen, which folds need that refit this pipeline.
    """
    index = [
        StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid=unseen) for c in categoricals
    ]
    encode = [OneHotEncoder(inputCol=f"{c}_index", outputCol=f"{c}_OHE") for c in categoricals]
    parts = []
    stages = [s for pair in zip(index, encode) for s in pair]
    if categoricals:
        stages.append(
            VectorAssembler(inputCols=[f"{c}_OHE" for c in categoricals], outputCol="cat_features")
        )
        parts.append("cat_features")
    stages += [
        VectorAssembler(inputCols=list(numerics), outputCol="num_unscaled"),
        StandardScaler(inputCol="num_unscaled", outputCol="num_scaled"),
    ]
    parts.append("num_scaled")
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    return Pipeline(stages=stages)


def index_table(model: PipelineModel, df: DataFrame, col: str) -> DataFrame:
    """Level, index and encoded slot (null for the dropped level) of a fitted categorical."""
    indexer = next(s for s in model.stages if s.hasParam("outputCol") and s.getOutputCol() == f"{col}_index")
    encoder = next(
        s
        for s in model.stages
        if type(s).__name__ == "OneHotEncoderModel" and s.getOutputCol() == f"{col}_OHE"
    )
    width = encoder.categorySizes[0] - 1
    rows = [(v, i, i if i < width else None) for i, v in enumerate(indexer.labels)]
    return df.sparkSession.createDataFrame(rows, "level string, idx int, slot int").orderBy("idx")


def scaler_table(model: PipelineModel, df: DataFrame, numerics: Sequence[str]) -> DataFrame:
    """Sample deviation the fitted scaler divides by, per numeric column."""
    scaler = next(s for s in model.stages if type(s).__name__ == "StandardScalerModel")
    rows = list(zip(numerics, (float(v) for v in scaler.std)))
    return df.sparkSession.createDataFrame(rows, "feature string, std double").orderBy("feature")


def lr_pipeline(
    categoricals: Sequence[str], numerics: Sequence[str], unseen: str = "error", **params
) -> Pipeline:
    """Feature stages and a linear regression as one estimator, so folds refit both."""
    return Pipeline(
        stages=[feature_stages(categoricals, numerics, unseen), LinearRegression(**params)]
    )


def gbt_pipeline(
    categoricals: Sequence[str],
    numerics: Sequence[str],
    unseen: str = "error",
    seed: int = 1,
    **params,
) -> Pipeline:
    """Feature stages and gradient-boosted trees."""
    return Pipeline(
        stages=[feature_stages(categoricals, numerics, unseen), GBTRegressor(seed=seed, **params)]
    )


def tree_pipeline(
    kind: str,
    categoricals: Sequence[str],
    numerics: Sequence[str],
    unseen: str = "error",
    seed: int = 1,
    **params,
) -> Pipeline:
    """Feature stages and a decision tree (``"tree"``) or a random forest (``"forest"``)."""
    cls = {"tree": DecisionTreeRegressor, "forest": RandomForestRegressor}[kind]
    return Pipeline(stages=[feature_stages(categoricals, numerics, unseen), cls(seed=seed, **params)])


def lr_grid(estimator: Pipeline, reg: Sequence[float] = (), mix: Sequence[float] = ()) -> list:
    """Parameter maps over the regression of ``lr_pipeline``; empty lists give one default fit."""
    lr = estimator.getStages()[-1]
    grid = ParamGridBuilder()
    if reg:
        grid = grid.addGrid(lr.regParam, list(reg))
    if mix:
        grid = grid.addGrid(lr.elasticNetParam, list(mix))
    return grid.build()


def cross_validate(
    estimator: Estimator,
    df: DataFrame,
    grid: Sequence | None = None,
    k: int = 3,
    key: str | None = "quote_id",
    parallelism: int = 1,
    seed: int = 1,
):
    """k-fold search. With a key the folds come from its hash; without, from Spark's sampler."""
    cv = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=list(grid) if grid else ParamGridBuilder().build(),
        evaluator=RegressionEvaluator(metricName="rmse"),
        numFolds=k,
        parallelism=parallelism,
        seed=seed,
    )
    if key is not None:
        cv = cv.setFoldCol("_fold")
        df = df.withColumn("_fold", fold(key, k))
    return cv.fit(df)


def wide_search(
    train: DataFrame,
    categoricals: Sequence[str],
    numerics: Sequence[str],
    kind: str,
    alphas: Sequence[float],
    ratios: Sequence[float] = (1.0,),
    key: str = "quote_id",
    k: int = 3,
) -> tuple[PipelineModel, float, float]:
    """Ridge (``"ridge"``), lasso or elastic net search for matrices too wide to solve on the driver.

    Features stay sparse vectors and Spark's distributed solver fits them; use
    it where ``linear.linear_data`` raises ``TooWide``. Returns the fitted
    pipeline with the winning strength and mix. Penalties mean the same as in
    ``linear``; folds share one feature fit, as they do there.
    """
    features = feature_stages(categoricals, numerics).fit(train)
    rows = stored(features.transform(train).select(key, LABEL, "features"))
    stats = rows.agg(F.count("*").alias("n"), F.stddev_samp(LABEL).alias("std")).first()
    lr = LinearRegression(solver="l-bfgs", standardization=False, tol=1e-9, maxIter=1000)

    def params(alpha: float, ratio: float, n: float) -> dict:
        if kind == "ridge":
            return {lr.regParam: alpha * stats["std"] / n, lr.elasticNetParam: 0.0}
        # Spark weighs the squared part by the label's deviation.
        strength = alpha * ratio + alpha * (1 - ratio) * stats["std"]
        return {lr.regParam: strength, lr.elasticNetParam: alpha * ratio / strength}

    candidates = [(a, r) for r in ratios for a in alphas]
    inside = stats["n"] * (k - 1) / k
    tuned = cross_validate(lr, rows, [params(a, r, inside) for a, r in candidates], k, key)
    scores = list(tuned.avgMetrics)
    alpha, ratio = candidates[scores.index(min(scores))]
    best = lr.fit(rows, params(alpha, ratio, stats["n"]))
    return PipelineModel(stages=[features, best]), alpha, ratio


def train_validation_split(
    estimator: Pipeline, df: DataFrame, grid: Sequence | None = None, ratio: float = 0.66, seed: int = 1
):
    """Search on a single seeded split."""
    return TrainValidationSplit(
        estimator=estimator,
        estimatorParamMaps=list(grid) if grid else ParamGridBuilder().build(),
        evaluator=RegressionEvaluator(metricName="rmse"),
        trainRatio=ratio,
        seed=seed,
    ).fit(df)


def final_stage(model: Model) -> Model:
    """The predictor at the end of a fitted, possibly nested or tuned, pipeline."""
    if hasattr(model, "bestModel"):
        model = model.bestModel
    while isinstance(model, PipelineModel):
        model = model.stages[-1]
    return model


def feature_names(df: DataFrame, col: str = "features") -> list[str]:
    """Names of the slots of an assembled vector, from its column metadata."""
    attrs = df.schema[col].metadata["ml_attr"]["attrs"]
    slots = sorted((a["idx"], a["name"]) for group in attrs.values() for a in group)
    return [name for _, name in slots]


def _scaled_names(model: Model, df: DataFrame, numerics: Sequence[str]) -> list[str]:
    names = feature_names(model.transform(df.limit(0)))
    return [*names[: len(names) - len(numerics)], *numerics]


def coefficients(model: Model, df: DataFrame, numerics: Sequence[str]) -> DataFrame:
    """Feature and coefficient of a fitted linear pipeline, smallest first, intercept last."""
    lr = final_stage(model)
    pairs = list(zip(_scaled_names(_pipeline(model), df, numerics), map(float, lr.coefficients)))
    rows = [(i, n, v) for i, (n, v) in enumerate(sorted(pairs, key=lambda p: (p[1], p[0])))]
    rows.append((len(rows), "(intercept)", float(lr.intercept)))
    return df.sparkSession.createDataFrame(rows, "position int, feature string, coefficient double")


def importances(model: Model, df: DataFrame, numerics: Sequence[str]) -> DataFrame:
    """Feature importances of a fitted tree pipeline, largest first."""
    trees = final_stage(model)
    names = _scaled_names(_pipeline(model), df, numerics)
    rows = list(zip(names, map(float, trees.featureImportances.toArray())))
    out = df.sparkSession.createDataFrame(rows, "feature string, importance double")
    return out.orderBy(F.desc("importance"), "feature")


def _pipeline(model: Model) -> Model:
    return model.bestModel if hasattr(model, "bestModel") else model


def training_summary(model: Model, df: DataFrame) -> DataFrame:
    """RMSE, R2, iterations and objective history of a fitted linear regression."""
    summary = final_stage(model).summary
    rows = [
        ("rmse", 0, float(summary.rootMeanSquaredError)),
        ("r2", 0, float(summary.r2)),
        ("iterations", 0, float(summary.totalIterations)),
        *[("objective", i, float(v)) for i, v in enumerate(summary.objectiveHistory)],
    ]
    return df.sparkSession.createDataFrame(rows, "metric string, step int, value double")


def predict(model: Model, df: DataFrame) -> DataFrame:
    """Apply a fitted pipeline; a level it has not seen counts as the rarest one it has.

    That is the level the encoder drops, so the row gets no dummy at all. Nulls
    count as unseen; ``unseen_levels`` reports how many rows this concerns.
    """
    pipeline = _pipeline(model)
    for stage in _flat(pipeline):
        if type(stage).__name__ == "StringIndexerModel" and stage.getHandleInvalid() == "error":
            c, labels = F.col(stage.getInputCol()), list(stage.labels)
            df = df.withColumn(stage.getInputCol(), F.when(c.cast("string").isin(labels), c.cast("string")).otherwise(labels[-1]))
    return pipeline.transform(df)


def unseen_levels(model: Model, df: DataFrame) -> DataFrame:
    """Rows per categorical whose level is null or unknown to the model: those that ``predict`` recodes."""
    indexers = [s for s in _flat(_pipeline(model)) if type(s).__name__ == "StringIndexerModel"]
    counts = []
    for stage in indexers:
        c = F.col(stage.getInputCol())
        unknown = c.isNotNull() & ~c.cast("string").isin(list(stage.labels))
        counts.append(
            F.struct(
                F.lit(stage.getInputCol()).alias("feature"),
                F.count_if(c.isNull()).alias("n_null"),
                F.count_if(unknown).alias("n_unseen"),
            )
        )
    return df.agg(F.array(*counts).alias("c")).select(F.inline("c")).orderBy("feature")


def _flat(model: Model) -> list:
    if isinstance(model, PipelineModel):
        return [s for stage in model.stages for s in _flat(stage)]
    return [model]


def score_unsold(model: Model, df: DataFrame) -> DataFrame:
    """Predicted margin of quotes that were not sold."""
    return predict(model, df.filter(F.col("expected_margin") == 0))


def pca(df: DataFrame, numerics: Sequence[str], k: int = 2) -> DataFrame:
    """Share of variance of the first ``k`` components of the standardised numerics."""
    model = Pipeline(
        stages=[
            VectorAssembler(inputCols=list(numerics), outputCol="raw"),
            StandardScaler(inputCol="raw", outputCol="scaled", withMean=True),
            PCA(k=k, inputCol="scaled", outputCol="components"),
        ]
    ).fit(df)
    shares = model.stages[-1].explainedVariance
    rows = [(i + 1, float(v)) for i, v in enumerate(shares)]
    return df.sparkSession.createDataFrame(rows, "component int, variance_share double")


def cluster(
    df: DataFrame, numerics: Sequence[str], k: int = 4, method: str = "kmeans", seed: int = 1
) -> DataFrame:
    """Rows with a cluster number, by k-means or a Gaussian mixture on standardised numerics."""
    cls = {"kmeans": KMeans, "gaussian": GaussianMixture}[method]
    stages = [
        VectorAssembler(inputCols=list(numerics), outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True),
        cls(k=k, seed=seed, featuresCol="scaled", predictionCol="cluster"),
    ]
    return Pipeline(stages=stages).fit(df).transform(df)


def cluster_profile(clustered: DataFrame, numerics: Sequence[str], label: str = LABEL) -> DataFrame:
    """Size, mean features and mean label per cluster."""
    return (
        clustered.groupBy("cluster")
        .agg(F.count("*").alias("n"), *[F.avg(c).alias(f"avg_{c}") for c in [*numerics, label]])
        .orderBy("cluster")
    )


def out_of_fold(
    estimators: dict[str, Pipeline], df: DataFrame, key: str = "quote_id", k: int = 3
) -> DataFrame:
    """Each row with one prediction per estimator, made by fits that did not see its fold."""
    df = df.withColumn("_fold", fold(key, k))
    held = []
    for f in range(k):
        rest, out = df.filter(F.col("_fold") != f), df.filter(F.col("_fold") == f)
        for name, est in estimators.items():
            out = _predictions(est.fit(rest), out, name, df.columns)
        held.append(out)
    return reduce(DataFrame.unionByName, held)


def _predictions(model: Model, df: DataFrame, name: str, keep: Sequence[str]) -> DataFrame:
    done = [c for c in df.columns if c not in keep]
    return predict(model, df).select(*keep, *done, F.col("prediction").alias(name))


class Stack:
    """Base models blended by a linear regression on their out-of-fold predictions."""

    def __init__(self, estimators: dict[str, Pipeline], key: str = "quote_id", k: int = 3):
        self.estimators, self.key, self.k = estimators, key, k

    def fit(self, df: DataFrame) -> "Stack":
        names = list(self.estimators)
        oof = out_of_fold(self.estimators, df, self.key, self.k)
        self.blend = Pipeline(
            stages=[
                VectorAssembler(inputCols=names, outputCol="features"),
                LinearRegression(),
            ]
        ).fit(oof)
        self.models = {n: e.fit(df) for n, e in self.estimators.items()}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds every base prediction, their ``average`` and the blended ``prediction``."""
        out, base = df, df.columns
        for name, model in self.models.items():
            out = _predictions(model, out, name, base)
        names = list(self.models)
        total = reduce(lambda a, b: a + b, [F.col(n) for n in names])
        out = out.withColumn("average", total / F.lit(float(len(names))))
        return self.blend.transform(out).drop("features")

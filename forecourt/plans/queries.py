"""Every operator as a named query over a folder of source tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forecourt.operators import aggregates as agg
from forecourt.operators import cleaning as cl
from forecourt.operators import cohorts as co
from forecourt.operators import components as pc
from forecourt.operators import evaluation as ev
from forecourt.operators import features as fe
from forecourt.operators import levels as lv
from forecourt.operators import linear as li
from forecourt.operators import ml
from forecourt.operators import pnl as pl
from forecourt.operators import quality as qu
from forecourt.operators import wide as wi
from forecourt.operators.quantiles import box_stats
from forecourt.plans.charts import CHARTS
from forecourt.schema import NUMERIC_FEATURES
from forecourt.sources import quotes as src
from forecourt.sources.star import quotes_from_star

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

# A make and model with many sold quotes, for the single-segment queries.
SEGMENT = ("Brand#8", "PROMO")
MAKES = tuple(f"Brand#{i}" for i in (1, 2, 3, 5, 8, 13, 21))
REGION_BASE = "us/mid"
ARMS = ("0.58", "0.62", "0.68")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double, so that engines that add in another order still agree."""
    doubles = [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({n: F.round(F.col(f"`{n}`"), places) for n in doubles}) if doubles else df


def _register(name: str, places: int | None):
    def wrap(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            out = fn(spark, folder)
            return out if places is None else rounded(out, places)

        QUERIES[name] = run
        return run

    return wrap


_FRAMES: dict[tuple[str, str], DataFrame] = {}


def raw(spark: SparkSession, folder: str) -> DataFrame:
    """The lazy quotes of a folder, planned once per session; no rows are kept."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _FRAMES:
        _FRAMES[key] = quotes_from_star(spark, folder)
    return _FRAMES[key]


def cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return cl.cleaned_quotes(raw(spark, folder))


def on_raw(name: str, places: int | None = 6):
    """Register a query over raw quotes."""

    def wrap(fn):
        return _register(name, places)(lambda spark, folder: fn(raw(spark, folder)))

    return wrap


def on_clean(name: str, places: int | None = 6):
    """Register a query over cleaned quotes with derived margins."""

    def wrap(fn):
        return _register(name, places)(lambda spark, folder: fn(cleaned(spark, folder)))

    return wrap


def on_sold(name: str, places: int | None = 6):
    """Register a query over cleaned, sold quotes."""
    return lambda fn: on_clean(name, places)(lambda df: fn(cl.sold(df)))


# Sources and sinks


on_raw("source_profile")(src.profile_source)
on_raw("source_partitions")(src.source_partitions)
on_raw("preview_quotes")(src.preview)


@on_raw("csv_quotes")
def _(df):
    path = src.store(df, fmt="csv")
    return src.read_quotes(df.sparkSession, path)


@on_raw("csv_quotes_inferred")
def _(df):
    path = src.store(df, fmt="csv")
    return src.profile_source(src.read_quotes(df.sparkSession, path, schema=None))


@on_clean("registered_view")
def _(df):
    src.register(df, "forecourt_cleaned_quotes")
    return df.sparkSession.sql(
        "SELECT make, count(*) AS n, sum(margin) AS margin "
        "FROM forecourt_cleaned_quotes GROUP BY make"
    )


@on_clean("materialized_pnl")
def _(df):
    folder = src.shared_folder(df.sparkSession)
    session = "".join(c if c.isalnum() else "_" for c in df.sparkSession.sparkContext.applicationId)
    return pl.pnl(src.materialize(df, f"forecourt_quotes_{session}", folder))


# Cleaning


on_raw("drop_incomplete")(cl.drop_incomplete)
on_raw("drop_missing_prices")(cl.drop_missing_prices)
on_raw("clip_margin")(cl.clip_margin)
on_raw("clip_percent_to_market")(cl.clip_percent_to_market)
on_raw("clip_days_to_sell")(cl.clip_days_to_sell)
on_raw("clean_quotes")(cl.clean)
on_raw("cleaning_funnel")(cl.cleaning_funnel)
on_raw("total_margin")(lambda df: cl.with_total_margin(df).select("quote_id", "total_margin"))


@on_raw("calculated_margin")
def _(df):
    return cl.with_calculated_margin(cl.with_total_margin(df)).select("quote_id", "calculated_margin")


on_raw("imputed_margin")(lambda df: cl.with_margins(df).select("quote_id", "margin"))
on_clean("sold_quotes")(cl.sold)
on_clean("segment_make_model")(lambda df: cl.segment(df, *SEGMENT))
on_clean("segment_make")(lambda df: cl.segment(df, make=SEGMENT[0]))
on_clean("segment_in_makes")(lambda df: cl.segment_in(df, MAKES))


@on_clean("drop_columns")
def _(df):
    return cl.drop_columns(df, "region_short_code", "seller_source", "location_zip")


# Profit and loss, ratios


on_clean("pnl")(pl.pnl)
on_clean("margin_summary")(pl.margin_summary)
on_clean("summary_sheet")(pl.summary_sheet)
on_clean("pct_to_market_fit")(pl.fit_pct_to_market)
on_clean("pct_to_market_fit_by_make")(lambda df: pl.fit_pct_to_market(df, ["make"]))


@on_clean("pct_to_market_fit_by_segment")
def _(df):
    return pl.fit_pct_to_market(df, ["make", "model", "year", "region_short_code"])


@on_clean("pct_to_market_applied", 4)
def _(df):
    scored = pl.apply_pct_to_market(df, pl.fit_pct_to_market(df))
    return pl.rmse(cl.sold(scored), "expected_margin", "predicted_margin")


@on_clean("pct_to_market_applied_by_make", 4)
def _(df):
    fitted = src.stored(pl.fit_pct_to_market(df, ["make"], sums=True))
    scored = pl.apply_pct_to_market(df, fitted, ["make"])
    return pl.rmse(cl.sold(scored), "expected_margin", "predicted_margin")


on_clean("pmm_rmse")(pl.pmm_rmse)


@on_clean("pmm_68_segment_rmse")
def _(df):
    return pl.pmm_rmse(cl.with_calculated_margin(cl.segment(df, *SEGMENT), "0.68"))


on_clean("pmm_score")(lambda df: df.select("quote_id", F.col("calculated_margin").alias("prediction")))


# Counts, skewness, correlation


on_clean("makes_without_sale")(agg.without_sale)


@on_clean("cohorts_without_sale")
def _(df):
    return agg.without_sale(df, ["make", "model", "location_zip"])


on_clean("count_by_make")(agg.count_by_make)
on_clean("count_by_make_model")(agg.count_by_make_model)


@on_sold("skewness")
def _(df):
    return agg.skewness_table(df, [*NUMERIC_FEATURES, "expected_margin"])


@on_sold("correlation_with_margin")
def _(df):
    wide = fe.one_hot(fe.feature_set(df, "segment"), "region_short_code", REGION_BASE, "region_")
    features = [c for c in wide.columns if c != "expected_margin"]
    return agg.correlation_with(wide, "expected_margin", features)


@on_sold("correlation_matrix")
def _(df):
    return lv.correlation_matrix(
        fe.feature_set(df, "segment"),
        NUMERIC_FEATURES,
        ["region_short_code"],
        "expected_margin",
        {"region_short_code": REGION_BASE},
    )


# Charts

for _name, _chart in CHARTS.items():
    on_clean(_name)(_chart)


@on_clean("sorted_margin_by_make")
def _(df):
    return agg.order_by(agg.group_stat(cl.sold(df), "make", "margin"), "avg_margin", "make")


@on_clean("percent_box_by_make")
def _(df):
    return box_stats(df, "make", "percent_to_market")


@on_clean("margin_box_by_make_sketched")
def _(df):
    """Whether sketched quartiles hold their ranks to one in a hundred, by make."""
    sketched = box_stats(df, "make", "calculated_margin", approx=100).alias("b")
    rows = df.filter("calculated_margin is not null").select("make", "calculated_margin").alias("r")
    v, errors = F.col("r.calculated_margin"), []
    for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        below, upto = (F.count(F.when(c, 1)) / F.count("*") for c in (v < F.col(f"b.{name}"), v <= F.col(f"b.{name}")))
        errors.append(F.greatest(below - p, p - upto))
    found = rows.join(sketched, F.col("r.make") == F.col("b.make")).groupBy("r.make", "b.n")
    return found.agg(F.greatest(*errors).alias("error")).select("make", "n", (F.col("error") <= 0.01).alias("within"))


@on_clean("profit_box_by_region")
def _(df):
    """Quartiles of a column too wide for 32 bits."""
    big = df.withColumn("big", F.col("total_margin").cast("bigint") * F.lit(10_000_000_000))
    return box_stats(big, "region_short_code", "big")


# Features


@on_sold("log10_features")
def _(df):
    return fe.log10_features(df).select("quote_id", "market_avg_days_to_sell", "n_similar_vehicles_listed")


@on_sold("auto_log")
def _(df):
    logged = fe.auto_log(df)
    return logged.select("quote_id", *[F.col(c).cast("double").alias(c) for c in NUMERIC_FEATURES])


on_sold("feature_set_make")(lambda df: fe.feature_set(df, "make", key="quote_id"))


@on_sold("feature_set_segment")
def _(df):
    return fe.feature_set(cl.segment(df, *SEGMENT), "segment", key="quote_id")


@on_sold("feature_set_make_raw")
def _(df):
    return fe.feature_set(df, "make", logs=False, label="label", key="quote_id")


@on_sold("feature_set_segment_raw")
def _(df):
    return fe.feature_set(cl.segment(df, *SEGMENT), "segment", logs=False, label="label", key="quote_id")


@on_sold("feature_set_wide")
def _(df):
    return fe.feature_set(df, "make_model_zip_source", key="quote_id")


@on_sold("one_hot_region")
def _(df):
    return fe.one_hot(df.select("quote_id", "region_short_code"), "region_short_code", REGION_BASE, "region_")


@on_sold("one_hot_make")
def _(df):
    return fe.one_hot(df.select("quote_id", "make"), "make", MAKES[0])


@on_sold("one_hot_zip_totals")
def _(df):
    """Rows of each dummy; there are as many as zip codes, less the rarest."""
    return lv.dummy_totals(df, "location_zip", "zip_")


@on_sold("one_hot_make_model_totals")
def _(df):
    return lv.dummy_totals(df.withColumn("make_model", agg.make_model_key()), "make_model")


@on_sold("correlation_with_margin_by_zip")
def _(df):
    return lv.correlation_with_levels(df, "expected_margin", "location_zip", "zip_")


@on_sold("correlation_with_margin_by_make_model")
def _(df):
    keyed = df.withColumn("make_model", agg.make_model_key())
    return lv.correlation_with_levels(keyed, "expected_margin", "make_model")


@on_sold("correlation_matrix_make")
def _(df):
    """Dummies of two columns beside the numerics."""
    return lv.correlation_matrix(
        fe.feature_set(df, "make"), NUMERIC_FEATURES, ["region_short_code", "make"], "expected_margin", {"region_short_code": REGION_BASE}
    )


@on_sold("one_hot_source")
def _(df):
    return fe.one_hot(df.select("quote_id", "seller_source"), "seller_source", "iOS", "seller_")


@on_sold("standardized")
def _(df):
    frame = fe.feature_set(df, "segment", key="quote_id")
    numerics = fe.numeric_columns(frame, exclude=["quote_id", "expected_margin"])
    train, _ = fe.hash_split(frame)
    frame = frame.withColumn("split", fe.split_name())
    return fe.standardize(frame, numerics, train).drop("region_short_code")


@on_sold("hash_split")
def _(df):
    return (
        df.groupBy(fe.split_name().alias("split"), fe.fold().alias("fold"))
        .agg(F.count("*").alias("n"), F.sum("expected_margin").alias("margin"))
        .orderBy("split", "fold")
    )


@on_sold("random_split")
def _(df):
    train, test = fe.random_split(src.stored(df.select("quote_id", "expected_margin")))
    parts = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return parts.groupBy("split").agg(F.count("*").alias("n"))


# Models fitted from moments


def _linear_data(df: DataFrame, extra: Sequence[str] = ()) -> li.LinearData:
    return li.linear_data(
        fe.feature_set(df, "segment", key="quote_id", extra=extra),
        NUMERIC_FEATURES,
        ["region_short_code"],
        "expected_margin",
        bases={"region_short_code": REGION_BASE},
    )


def _ridge_by_folds(data: li.LinearData) -> li.LinearModel:
    return li.ridge_cv(data, first="folds")


_FITS = {
    "ols": li.ols,
    "ridge": _ridge_by_folds,
    "lasso": li.lasso_cv,
    "elastic_net": li.elastic_net_cv,
}

for _name, _fit in _FITS.items():
    on_sold(f"{_name}_report", 4)(lambda df, fit=_fit: li.report([fit(_linear_data(df))]))
    on_sold(f"{_name}_coefficients", 4)(lambda df, fit=_fit: fit(_linear_data(df)).coefficients())


@on_sold("ols_segment_report", 4)
def _(df):
    """One make and model: so few rows that test folds may not determine a fit."""
    return li.report([li.ols(_linear_data(cl.segment(df, *SEGMENT)))])


@on_sold("ols_make_segment_report", 4)
def _(df):
    return li.report([li.ols(_linear_data(cl.segment(df, make=SEGMENT[0])))])


@on_sold("ridge_leave_one_out_report", 4)
def _(df):
    return li.report([li.ridge_cv(_linear_data(df))])


@on_sold("linear_models_make_report", 4)
def _(df):
    data = li.linear_data(
        fe.feature_set(df, "make", key="quote_id"),
        NUMERIC_FEATURES,
        ["region_short_code", "make"],
        "expected_margin",
    )
    return li.report([li.ols(data), _ridge_by_folds(data), li.lasso_cv(data)])


def _wide_data(df: DataFrame) -> wi.WideData:
    factors = ["region_short_code", "model", "location_zip"]
    frame = fe.log10_features(df).select("quote_id", *factors, *NUMERIC_FEATURES, "expected_margin")
    return wi.wide_data(frame, NUMERIC_FEATURES, factors, "expected_margin", bases={"region_short_code": REGION_BASE})


@on_sold("elastic_net_wide_coefficients", 4)
def _(df):
    """Region, model and zip code beside the numerics, with a penalty given beforehand."""
    data = _wide_data(df)
    fits = wi.fit(data, [wi.Task("train", li.net_penalty(0.5, 0.9))])
    return wi.WideModel("elastic_net", 0.5, 0.9, fits).coefficients()


@on_clean("margin_from_nearest_ols")
def _(df):
    """Scores are predictions: about as many values as quotes."""
    model = li.ols(_linear_data(cl.sold(df)))
    quotes = fe.feature_set(df, "segment", key="quote_id")
    scored = model.transform(quotes, "score").withColumn("score", F.round("score", 4))
    return qu.margin_from_nearest(scored, "score").select("quote_id", "imputed_margin")


def _predictions(df: DataFrame, fit: Callable[[li.LinearData], li.LinearModel]) -> DataFrame:
    data = _linear_data(df)
    return fit(data).transform(data.frame)


def _line(df: DataFrame, split: str) -> DataFrame:
    return ev.pred_vs_actual(df.filter(F.col("_split") == split), "expected_margin", "prediction")[1]


for _name, _fit in _FITS.items():

    @on_sold(f"{_name}_predictions", 4)
    def _(df, fit=_fit):
        return _predictions(df, fit).select("quote_id", "expected_margin", "prediction")

    @on_sold(f"{_name}_predicted_line", 4)
    def _(df, fit=_fit):
        return _line(_predictions(df, fit), "train")

    @on_sold(f"{_name}_predicted_line_test", 4)
    def _(df, fit=_fit):
        return _line(_predictions(df, fit), "test")


@on_clean("ols_unsold_scores", 4)
def _(df):
    model = li.ols(_linear_data(cl.sold(df)))
    unsold = fe.feature_set(cl.unsold(df), "segment", key="quote_id")
    return model.transform(unsold).agg(
        F.count("prediction").alias("n"), F.avg("prediction").alias("avg_prediction")
    )


# Models of Spark ML


def _ml_frame(df: DataFrame, name: str = "segment", segment: bool = False) -> DataFrame:
    frame = cl.segment(df, *SEGMENT) if segment else df
    return fe.feature_set(frame, name, logs=False, label="label", key="quote_id")


def _train_test(df: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    """Stored once: every fit below makes several passes over these rows."""
    return fe.hash_split(src.stored(_ml_frame(df, **kw)))


CATS = ["region_short_code"]
NUMS = list(NUMERIC_FEATURES)


@on_sold("string_index")
def _(df):
    train, _ = _train_test(df)
    return ml.index_table(ml.feature_stages(CATS, NUMS).fit(train), train, CATS[0])


@on_sold("scaler_deviation")
def _(df):
    train, _ = _train_test(df)
    return ml.scaler_table(ml.feature_stages(CATS, NUMS).fit(train), train, NUMS)


@on_sold("assembled_features")
def _(df):
    train, _ = _train_test(df)
    vectors = ml.feature_stages(CATS, NUMS).fit(train).transform(train)
    return (
        vectors.select(F.posexplode(vector_to_array("features")).alias("slot", "value"))
        .groupBy("slot")
        .agg(F.avg("value").alias("avg_value"), F.count("*").alias("n"))
        .orderBy("slot")
    )


def _scores(models: dict, train: DataFrame, test: DataFrame) -> DataFrame:
    return ev.compare_models(
        {
            f"{name}, {part}": (ml.predict(model, rows), "label", "prediction")
            for name, model in models.items()
            for part, rows in (("train", train), ("test", test))
        }
    )


@on_sold("linear_ml_scores", 4)
def _(df):
    train, test = _train_test(df)
    return _scores({"linear": ml.lr_pipeline(CATS, NUMS).fit(train)}, train, test)


@on_sold("linear_ml_summary", 4)
def _(df):
    train, _ = _train_test(df)
    return ml.training_summary(ml.lr_pipeline(CATS, NUMS).fit(train), train)


@on_sold("linear_ml_coefficients", 4)
def _(df):
    train, _ = _train_test(df)
    found = ml.coefficients(ml.lr_pipeline(CATS, NUMS).fit(train), train, NUMS)
    # The years are not centred, so the intercept is a small difference of large numbers: whole dollars.
    whole = F.when(F.col("feature") == "(intercept)", F.round("coefficient")).otherwise(F.col("coefficient"))
    return found.withColumn("coefficient", whole)


@on_sold("linear_ml_residuals", 4)
def _(df):
    train, _ = _train_test(df)
    scored = ml.lr_pipeline(CATS, NUMS).fit(train).transform(train)
    return ev.residual_summary(ev.residuals(scored))


@on_sold("linear_ml_make_scores", 4)
def _(df):
    train, test = _train_test(df, name="make")
    return _scores({"linear": ml.lr_pipeline([*CATS, "make"], NUMS).fit(train)}, train, test)


@on_sold("linear_ml_segment_scores", 4)
def _(df):
    """All cars of a make and model have as many similar ones: that column is constant.

    The one-pass solver cannot take it and stops early in its fallback, so the
    few rows of a segment go to the iterative one.
    """
    train, test = _train_test(df, segment=True)
    model = ml.lr_pipeline(CATS, NUMS, solver="l-bfgs", tol=1e-12).fit(train)
    return _scores({"linear": model}, train, test)


@on_sold("linear_ml_cross_validated", 4)
def _(df):
    train, test = _train_test(df)
    model = ml.cross_validate(ml.lr_pipeline(CATS, NUMS, "keep"), train)
    return _scores({"linear, cross-validated": model}, train, test)


@on_sold("linear_ml_train_validation", 4)
def _(df):
    train, test = _train_test(df)
    est = ml.lr_pipeline(CATS, NUMS, "keep")
    grid = ml.lr_grid(est, [0.0, 0.5, 1.0], [0.0, 0.5, 1.0])
    return _scores({"linear, one split": ml.train_validation_split(est, train, grid)}, train, test)


@on_sold("gbt_scores", 4)
def _(df):
    train, test = _train_test(df)
    return _scores({"boosted trees": ml.gbt_pipeline(CATS, NUMS).fit(train)}, train, test)


@on_sold("tree_scores", 4)
def _(df):
    train, test = _train_test(df)
    models = {
        "tree": ml.tree_pipeline("tree", CATS, NUMS).fit(train),
        "forest": ml.tree_pipeline("forest", CATS, NUMS).fit(train),
    }
    return _scores(models, train, test)


@on_sold("forest_importances", 4)
def _(df):
    train, _ = _train_test(df)
    return ml.importances(ml.tree_pipeline("forest", CATS, NUMS).fit(train), train, NUMS)


@on_sold("stacked_scores", 4)
def _(df):
    train, test = _train_test(df)
    bases = {
        "linear": ml.lr_pipeline(CATS, NUMS),
        "tree": ml.tree_pipeline("tree", CATS, NUMS),
    }
    scored = ml.Stack(bases).fit(train).transform(test)
    return ev.compare_models(
        {n: (scored, "label", c) for n, c in {"stack": "prediction", "average": "average"}.items()}
    )


@on_sold("unseen_levels")
def _(df):
    """Levels that a model fitted on a few makes has not seen."""
    rows = src.stored(_ml_frame(df, "make"))
    model = ml.lr_pipeline([*CATS, "make"], NUMS).fit(cl.segment_in(rows, MAKES))
    return ml.unseen_levels(model, rows)


@on_sold("forest_importance_total", 4)
def _(df):
    train, _ = _train_test(df)
    table = ml.importances(ml.tree_pipeline("forest", CATS, NUMS).fit(train), train, NUMS)
    return table.agg(F.count("*").alias("n_features"), F.sum("importance").alias("total"))


def _cluster_totals(df: DataFrame, k: int, method: str) -> DataFrame:
    """All rows and their mean label, put together from the clusters."""
    profile = ml.cluster_profile(ml.cluster(src.stored(_ml_frame(df)), NUMS, k, method), NUMS)
    n, label = F.col("n"), F.col("avg_label")
    return profile.agg(F.sum(n).alias("n"), (F.sum(label * n) / F.sum(n)).alias("avg_label"))


on_sold("kmeans_totals", 4)(lambda df: _cluster_totals(df, 4, "kmeans"))
on_sold("gaussian_mixture_totals", 4)(lambda df: _cluster_totals(df, 3, "gaussian"))
on_sold("pca_variance", 4)(lambda df: ml.pca(src.stored(_ml_frame(df)), NUMS, 4))


@on_sold("kmeans_profile", 4)
def _(df):
    return ml.cluster_profile(ml.cluster(src.stored(_ml_frame(df)), NUMS), NUMS)


@on_sold("gaussian_mixture_profile", 4)
def _(df):
    return ml.cluster_profile(ml.cluster(src.stored(_ml_frame(df)), NUMS, 3, "gaussian"), NUMS)


@on_sold("pca_projection", 4)
def _(df):
    """Power sums of the components' variances, taken from projected rows, and their largest covariance (power 0)."""
    rows = src.stored(_ml_frame(df))
    found = pc.principal_components(rows, NUMS).project(rows)
    names = [f"pc{i + 1}" for i in range(len(NUMS))]
    pairs = [F.abs(F.covar_pop(a, b)) for i, a in enumerate(names) for b in names[:i]]
    sums = [F.greatest(*pairs)] + [sum((F.var_pop(n) ** m for n in names), F.lit(0.0)) for m in range(1, len(names) + 1)]
    return found.agg(F.array(*sums).alias("s")).select(F.posexplode("s").alias("power", "total"))


@on_sold("kmeans_settled")
def _(df):
    """No row is nearer to another centre, and each centre is the mean of its rows."""
    rows = src.stored(_ml_frame(df))
    found = pc.k_means(rows, NUMS)
    return found.settled(found.assign(rows))


# Scores and diagnostics


def _pmm(df: DataFrame) -> DataFrame:
    return df.withColumn("label", F.col("expected_margin")).withColumn(
        "prediction", F.col("calculated_margin")
    )


on_sold("pmm_evaluation", 4)(lambda df: ev.evaluate(_pmm(df)))
on_sold("pmm_fold_rmse", 4)(lambda df: ev.cv_rmse(_pmm(df).withColumn("_fold", fe.fold())))
on_sold("pmm_residuals")(lambda df: ev.residuals(_pmm(df)).select("quote_id", "residual"))
on_sold("pmm_residual_summary", 4)(lambda df: ev.residual_summary(ev.residuals(_pmm(df))))
on_sold("pmm_actual_points")(lambda df: ev.pred_vs_actual(_pmm(df))[0])
on_sold("pmm_actual_line")(lambda df: ev.pred_vs_actual(_pmm(df))[1])


@on_sold("model_comparison", 4)
def _(df):
    data = _linear_data(df, ["calculated_margin"])
    scored = li.ols(data).transform(data.frame, "ols")
    return ev.compare_by(scored, "_split", "expected_margin", {"pmm": "calculated_margin", "ols": "ols"})


# Cohorts, price tests, ranking


@on_clean("cohort_table")
def _(df):
    return co.cohort_table(df, ["location_zip", "make", "model"])


@on_clean("cohort_rollup")
def _(df):
    return co.cohort_rollup(df, ["region_short_code", "make", "model"])


on_clean("best_margin_by_zip")(co.best_in_cohort)
on_clean("best_conversion_by_zip")(lambda df: co.best_in_cohort(df, metric="conversion_rate"))
on_clean("price_test")(lambda df: co.price_test(df, ARMS))


@on_clean("outreach_top")
def _(df):
    cols = ["quote_id", "region_short_code", "make", "model", "calculated_margin"]
    return co.outreach_rank(cl.unsold(df).select(cols), "calculated_margin", 100)


@on_clean("outreach_by_region")
def _(df):
    cols = ["quote_id", "region_short_code", "make", "model", "calculated_margin"]
    return co.outreach_rank(cl.unsold(df).select(cols), "calculated_margin", 20, "region_short_code")


@on_clean("market_price_gap")
def _(df):
    return co.market_price_gap(df, 0.1).select("quote_id", "market_price", "price_gap", "position")


# Data quality


on_raw("validation")(qu.validate)
on_raw("duplicate_quotes")(qu.duplicates)
on_raw("duplicate_cars")(lambda df: qu.duplicates(df, ["make", "model", "year", "location_zip"]))
on_raw("days_imputed")(lambda df: qu.impute_days(df).select("quote_id", "imputed_days"))


@on_clean("margin_inliers")
def _(df):
    return qu.outliers_iqr(cl.sold(df), "expected_margin", ["make"]).select("quote_id", "expected_margin")


@on_clean("margin_inliers_narrow")
def _(df):
    near = qu.outliers_iqr(cl.sold(df), "expected_margin", ["make"], reach=0.25)
    return near.select("quote_id", "expected_margin")


@on_raw("margin_outliers")
def _(df):
    known = df.filter("expected_margin != 0")
    return qu.outliers_iqr(known, "expected_margin", keep="outliers").select("quote_id", "expected_margin")


@on_clean("margin_from_nearest")
def _(df):
    return qu.margin_from_nearest(df).select("quote_id", "imputed_margin")

import numpy as np
import pytest
from pyspark.sql import functions as F

from forecourt.operators import cleaning as cl
from forecourt.operators import components as pc
from forecourt.operators import evaluation as ev
from forecourt.operators import features as fe
from forecourt.operators import linear as li
from forecourt.operators import ml
from forecourt.schema import NUMERIC_FEATURES
from forecourt.sources.quotes import stored

CATS, NUMS = ["region_short_code"], list(NUMERIC_FEATURES)


@pytest.fixture(scope="module")
def rows(star):
    df = cl.sold(cl.cleaned_quotes(star))
    return stored(fe.feature_set(df, "segment", logs=False, label="label", key="quote_id"))


@pytest.fixture(scope="module")
def split(rows):
    return fe.hash_split(rows)


def test_last_level_is_dropped_and_unscaled_means_kept(split):
    train, _ = split
    model = ml.feature_stages(CATS, NUMS).fit(train)
    levels = ml.index_table(model, train, CATS[0]).collect()
    assert levels[-1].slot is None and [r.slot for r in levels[:-1]] == [0, 1, 2, 3]
    out = model.transform(train)
    assert len(ml.feature_names(out)) == 8
    stds = {r.feature: r["std"] for r in ml.scaler_table(model, train, NUMS).collect()}
    want = train.agg(F.stddev_samp("mileage")).first()[0]
    assert stds["mileage"] == pytest.approx(want)


def test_linear_pipeline_equals_the_moment_fit(split, rows):
    train, test = split
    model = ml.lr_pipeline(CATS, NUMS).fit(train)
    data = li.linear_data(rows, NUMS, CATS, "label")
    want = li.ols(data)
    got = ev.evaluate(model.transform(train)).first()
    assert got.rmse == pytest.approx(want.train_rmse(), rel=1e-6)
    assert got.r2 == pytest.approx(want.train_r2(), rel=1e-6)
    held = ev.evaluate(model.transform(test)).first()
    assert held.rmse == pytest.approx(want.holdout_rmse(), rel=1e-6)
    table = {r.feature: r.coefficient for r in ml.coefficients(model, train, NUMS).collect()}
    assert set(NUMS) < set(table) and "(intercept)" in table
    summary = {(r.metric, r.step): r.value for r in ml.training_summary(model, train).collect()}
    assert summary["rmse", 0] == pytest.approx(got.rmse)


def test_unseen_level_fails_or_is_kept(split):
    train, _ = split
    new = train.limit(3).withColumn("region_short_code", F.lit("us/new"))
    with pytest.raises(Exception):
        ml.lr_pipeline(CATS, NUMS).fit(train).transform(new).collect()
    kept = ml.lr_pipeline(CATS, NUMS, "keep").fit(train).transform(new)
    assert kept.filter("prediction IS NOT NULL").count() == 3


def test_cross_validation_with_an_empty_grid_is_one_default_fit(split):
    train, _ = split
    model = ml.cross_validate(ml.lr_pipeline(CATS, NUMS, "keep"), train)
    assert len(model.avgMetrics) == 1


def test_cross_validation_agrees_with_moments(split, rows):
    train, _ = split
    model = ml.cross_validate(ml.lr_pipeline(CATS, NUMS, "keep"), train)
    data = li.linear_data(rows, NUMS, CATS, "label")
    assert model.avgMetrics[0] == pytest.approx(li.ols(data).cv_rmse("train"), rel=1e-4)


def test_grid_over_one_split(split):
    train, _ = split
    est = ml.lr_pipeline(CATS, NUMS, "keep")
    grid = ml.lr_grid(est, [0.0, 1.0], [0.5])
    assert len(ml.train_validation_split(est, train, grid).validationMetrics) == 2


@pytest.mark.parametrize("kind,alpha,ratio", [("ridge", 30.0, 1.0), ("lasso", 20.0, 1.0), ("net", 5.0, 0.4)])
def test_wide_search_equals_the_moment_solve(split, rows, kind, alpha, ratio):
    train, _ = split
    model, a, r = ml.wide_search(train, CATS, NUMS, kind, [alpha], [ratio])
    assert (a, r) == (alpha, ratio)
    data = li.linear_data(rows, NUMS, CATS, "label")
    m = data.rows("train")
    penalty = li.ridge_penalty(alpha, m.n) if kind == "ridge" else li.net_penalty(alpha, ratio)
    want = li.solve(m, penalty)
    got = ev.evaluate(model.transform(train)).first().rmse
    assert got == pytest.approx(want.rmse(m), rel=1e-4)
    table = {x.feature: x.coefficient for x in ml.coefficients(model, train, NUMS).collect()}
    year = want.weights[data.design.names.index("year")]
    assert table["year"] == pytest.approx(year, rel=0.01)


def test_trees_and_importances(split):
    train, _ = split
    model = ml.tree_pipeline("forest", CATS, NUMS, numTrees=5).fit(train)
    rows = ml.importances(model, train, NUMS).collect()
    assert sum(r.importance for r in rows) == pytest.approx(1.0)
    boosted = ml.gbt_pipeline(CATS, NUMS, maxIter=2).fit(train)
    assert ev.evaluate(boosted.transform(train)).first().r2 > 0


def test_out_of_fold_predicts_every_row_once(split):
    train, _ = split
    oof = ml.out_of_fold({"a": ml.lr_pipeline(CATS, NUMS, "keep")}, train)
    assert oof.count() == train.count() and oof.select("quote_id").distinct().count() == train.count()


def test_stack_adds_average_and_blend(split):
    train, test = split
    bases = {"a": ml.lr_pipeline(CATS, NUMS, "keep"), "b": ml.tree_pipeline("tree", CATS, NUMS, "keep")}
    row = ml.Stack(bases).fit(train).transform(test).first()
    assert row["average"] == pytest.approx((row["a"] + row["b"]) / 2)


def test_clusters_cover_all_rows(rows):
    profile = ml.cluster_profile(ml.cluster(rows, NUMS, 3), NUMS).collect()
    assert sum(r.n for r in profile) == rows.count()
    shares = [r.variance_share for r in ml.pca(rows, NUMS, 4).collect()]
    assert sum(shares) == pytest.approx(1.0)


def test_score_unsold(star):
    df = cl.cleaned_quotes(star)
    model = ml.lr_pipeline([], NUMS).fit(cl.sold(df).withColumn("label", F.col("expected_margin")))
    assert ml.score_unsold(model, df).count() == cl.unsold(df).count()


def test_fold_rmse_is_a_mean_of_roots(spark):
    df = spark.createDataFrame([(0, 0.0, 1.0), (0, 0.0, 1.0), (1, 0.0, 3.0)], "_fold int, label double, prediction double")
    assert ev.cv_rmse(df).first().cv_rmse == 2.0


def test_constant_label_has_no_r2(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "label double, prediction double")
    assert ev.evaluate(df).first().r2 is None


def test_unseen_levels_are_reported(split):
    train, _ = split
    model = ml.lr_pipeline(CATS, NUMS).fit(train)
    odd = train.limit(3).withColumn("region_short_code", F.lit("us/xxx"))
    none = train.limit(2).withColumn("region_short_code", F.lit(None).cast("string"))
    row = ml.unseen_levels(model, train.union(odd).union(none)).first()
    assert (row.feature, row.n_null, row.n_unseen) == ("region_short_code", 2, 3)
    assert ml.predict(model, odd.union(none)).filter("prediction is not null").count() == 5


def test_predictions_of_one_frame_are_compared_in_one_pass(spark):
    rows = [("a", 1.0, 1.0, 2.0), ("a", 3.0, 3.0, 2.0), ("b", 5.0, 4.0, 5.0)]
    df = spark.createDataFrame(rows, "part string, label double, p double, q double")
    got = {r.model: (r.n, r.rmse) for r in ev.compare_by(df, "part", "label", {"p": "p", "q": "q"}).collect()}
    assert got == {"p, a": (2, 0.0), "q, a": (2, 1.0), "p, b": (1, 1.0), "q, b": (1, 0.0)}


def test_components_are_orthogonal_and_project_the_variance(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(300, 3)) @ np.array([[2.0, 1.0, 0.0], [0.0, 1.0, 0.5], [0.0, 0.0, 0.1]])
    rows = [(*map(float, r), 5.0) for r in x] + [(None, 1.0, 1.0, 5.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    found = pc.principal_components(df, ["a", "b", "c", "d"])  # d is constant
    values = np.sort(np.linalg.eigvalsh(np.corrcoef(x.T)))[::-1]
    assert found.variance.tolist() == pytest.approx([*values, 0.0], abs=1e-9)
    assert np.allclose(found.directions @ found.directions.T, np.eye(4))
    projected = found.project(df, 2).select("pc1", "pc2").collect()
    assert projected[-1] == (None, None)
    assert np.var([r.pc1 for r in projected[:-1]]) == pytest.approx(values[0])
    assert sum(r.variance_share for r in found.shares(df).collect()) == pytest.approx(1.0)


def test_clusters_settle_and_a_wrong_assignment_shows(spark):
    draw = np.random.default_rng(4)
    points = np.concatenate([draw.normal(size=(60, 2)) + c for c in ((0, 0), (9, 0), (0, 9))])
    df = spark.createDataFrame([tuple(map(float, p)) for p in points], "x double, y double")
    found = pc.k_means(df, ["x", "y"], 3)
    assigned = found.assign(df)
    assert tuple(found.settled(assigned).first()) == (180, 3, 0, 0)
    wrong = assigned.withColumn("cluster", (F.col("cluster") + 1) % 3)
    assert found.settled(wrong).first().n_astray == 180
    dealt = assigned.withColumn("cluster", F.when(F.col("x") > 9, 0).otherwise(F.col("cluster")))
    assert found.settled(dealt).first().n_off_centre > 0

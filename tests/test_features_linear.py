import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from forecourt.operators import cleaning as cl
from forecourt.operators import features as fe
from forecourt.operators import levels as lv
from forecourt.operators import linear as li
from forecourt.operators import moments as mo
from forecourt.operators import pnl as pl
from forecourt.operators import wide as wi
from forecourt.schema import NUMERIC_FEATURES
from forecourt.sources.quotes import stored

CATS = ["region_short_code"]
LABEL = "expected_margin"


@pytest.fixture(scope="module")
def sold(spark, star):
    return stored(cl.sold(cl.cleaned_quotes(star)))


@pytest.fixture(scope="module")
def data(sold):
    return li.linear_data(fe.feature_set(sold, "segment", key="quote_id"), NUMERIC_FEATURES, CATS, LABEL)


def dense(data, split="train"):
    """Design matrix and label of a split, as the model scales them."""
    pdf = data.frame.filter(F.col("_split") == split).toPandas()
    x = pdf[list(data.design.numerics)].to_numpy(float)
    nn = x.shape[1]
    x = (x - data.centre[:nn]) * data.factor[:nn]
    dummies = [(pdf[c] == v).to_numpy(float) for c, v in data.design.dummies]
    return np.column_stack([x, *dummies]), pdf[LABEL].to_numpy(float), pdf


def test_log_of_zero_is_null(quotes):
    df = quotes({"n_similar_vehicles_listed": 0}, {"n_similar_vehicles_listed": 1}, {"n_similar_vehicles_listed": 100})
    got = [r[0] for r in fe.log10_features(df).select("n_similar_vehicles_listed").collect()]
    assert got == [None, 0.0, 2.0]


def test_auto_log_leaves_the_label_and_even_columns(spark):
    rows = [(float(i), float(2**i), float(2**i)) for i in range(12)]
    df = spark.createDataFrame(rows, "a double, b double, expected_margin double")
    row = fe.auto_log(df, ["a", "b", "expected_margin"]).orderBy("a").collect()[-1]
    assert row.a == 11 and row.b == pytest.approx(np.log10(2**11)) and row.expected_margin == 2**11


def test_dummies_and_base_sum_to_one(spark):
    df = spark.createDataFrame([("x",), ("x",), ("y",), ("z",), ("z",)], "g string")
    out = fe.one_hot(df, "g", keep=True)
    assert out.columns == ["g", "g_x", "g_z"]  # y is the rarest
    for r in out.collect():
        assert r.g_x + r.g_z + (r.g == "y") == 1
    with pytest.raises(ValueError):
        fe.one_hot(df, "g", base="w")


def test_unseen_level_gets_zeros(spark):
    df = spark.createDataFrame([("new",)], "g string")
    row = fe.one_hot(df, "g", "b", levels=["a", "b", "c"]).first()
    assert row.g_a == 0 and row.g_c == 0


def test_standardized_train_has_mean_zero_and_deviation_one(sold):
    cols = ["year", "mileage"]
    train, test = fe.hash_split(sold)
    out = fe.standardize(train, cols, train)
    row = out.agg(*[F.avg(c) for c in cols], *[F.stddev_pop(c) for c in cols]).first()
    assert list(row) == pytest.approx([0, 0, 1, 1], abs=1e-9)
    assert fe.standardize(test, cols, train).count() == test.count()


def test_constant_column_standardizes_to_null(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert [r.x for r in fe.standardize(df, ["x"]).collect()] == [None, None]


def test_hash_split_is_a_partition_whatever_the_layout(sold):
    a, b = fe.hash_split(sold)
    assert a.count() + b.count() == sold.count() and a.join(b, "quote_id").count() == 0
    c, _ = fe.hash_split(sold.repartition(7))
    assert a.select("quote_id").exceptAll(c.select("quote_id")).count() == 0
    share = a.count() / sold.count()
    assert 0.6 < share < 0.8


def test_feature_sets(sold):
    df = fe.feature_set(sold, "make_model_zip_source", key="quote_id")
    assert df.columns[:6] == ["quote_id", "region_short_code", "location_zip", "seller_source", "make", "make_model"]
    assert fe.numeric_columns(df, ["quote_id"])[0] == "location_zip"


def test_moments_equal_the_dense_matrix(data):
    x, y, _ = dense(data)
    full = np.column_stack([x, y])
    m = data.rows("train")
    assert m.n == len(y)
    assert np.allclose(m.mean, full.mean(axis=0), atol=1e-8)
    centred = full - full.mean(axis=0)
    assert np.allclose(m.cross, centred.T @ centred, rtol=1e-9, atol=1e-5)


def test_pairwise_cells_give_the_same_moments(sold):
    df = fe.feature_set(sold, "make_source", key="quote_id")
    cats = ["region_short_code", "seller_source", "make"]
    design, got = mo.collect_moments(df, NUMERIC_FEATURES, cats, LABEL)
    pdf = df.toPandas()
    cols = [pdf[list(NUMERIC_FEATURES)].to_numpy(float)]
    cols += [(pdf[c] == v).to_numpy(float)[:, None] for c, v in design.dummies]
    full = np.column_stack([*cols, pdf[LABEL].to_numpy(float)])
    centred = full - full.mean(axis=0)
    assert np.allclose(got[()].cross, centred.T @ centred, rtol=1e-8, atol=1e-3)


def test_too_many_columns_are_refused(sold, monkeypatch):
    monkeypatch.setattr(mo, "MAX_COLUMNS", 3)
    with pytest.raises(mo.TooWide):
        mo.collect_moments(fe.feature_set(sold, "segment"), NUMERIC_FEATURES, CATS, LABEL)


def test_ols_equals_spark_linear_regression(spark, data):
    x, y, _ = dense(data)
    names = [f"x{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], [*names, "label"])
    df = VectorAssembler(inputCols=names, outputCol="features").transform(df)
    lr = LinearRegression(solver="normal").fit(df)
    fit = li.ols(data).fit
    assert list(fit.weights) == pytest.approx(list(lr.coefficients), abs=1e-6)
    assert fit.intercept == pytest.approx(lr.intercept, abs=1e-6)


def test_ols_recovers_an_exact_line(spark):
    rows = [(i, float(i % 7), float(i % 5), 3 + 2.0 * (i % 7) - (i % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "quote_id long, x1 double, x2 double, y double")
    model = li.ols(li.linear_data(df, ["x1", "x2"], [], "y"))
    assert model.train_rmse() == pytest.approx(0, abs=1e-5)
    assert pl.rmse(model.transform(df), "y", "prediction").first().rmse == pytest.approx(0, abs=1e-9)


def test_scores_from_moments_equal_scores_from_rows(data):
    model = li.ridge_cv(data, first="folds")
    scored = model.transform(data.frame)
    for split, want in (("train", model.train_rmse()), ("test", model.holdout_rmse())):
        part = scored.filter(F.col("_split") == split)
        assert pl.rmse(part, LABEL, "prediction").first().rmse == pytest.approx(want, rel=1e-9)


def test_ols_residuals_sum_to_zero(data):
    scored = li.ols(data).transform(data.frame).filter("_split = 'train'")
    total = scored.agg(F.sum(F.col(LABEL) - F.col("prediction"))).first()[0]
    assert total == pytest.approx(0, abs=1e-5)


def test_leave_one_out_matches_refits(data):
    def brute(alpha, xs, ys):
        losses = []
        for i in range(len(ys)):
            keep = np.arange(len(ys)) != i
            xm, ym = xs[keep].mean(axis=0), ys[keep].mean()
            xc = xs[keep] - xm
            w = np.linalg.solve(xc.T @ xc + alpha * np.eye(xs.shape[1]), xc.T @ (ys[keep] - ym))
            losses.append((ys[i] - ym - (xs[i] - xm) @ w) ** 2)
        return np.mean(losses)

    full_x, full_y, _ = dense(data)
    got = li.loo_scores(data, [0.5, 30.0])
    assert got == pytest.approx([brute(a, full_x, full_y) for a in (0.5, 30.0)], rel=1e-8)


def test_lasso_meets_its_optimality_conditions(data):
    m = data.rows("train")
    for alpha in (0.5, 20.0, 200.0):
        fit = li.solve(m, li.net_penalty(alpha, 1.0))
        grad = (m.cross[:-1, -1] - m.cross[:-1, :-1] @ fit.weights) / m.n
        on = fit.weights != 0
        assert np.allclose(grad[on], alpha * np.sign(fit.weights[on]), atol=1e-6)
        assert (np.abs(grad[~on]) <= alpha + 1e-6).all()


def test_lasso_shrinks_with_alpha(data):
    sizes = [np.abs(li.solve(data.rows("train"), li.net_penalty(a, 1.0)).weights).sum() for a in (0.1, 10, 100, 1e6)]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == 0


def test_ridge_matches_its_closed_form(data):
    x, y, _ = dense(data)
    xc, yc = x - x.mean(axis=0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 7.0 * np.eye(x.shape[1]), xc.T @ yc)
    m = data.rows("train")
    assert np.allclose(li.solve(m, li.ridge_penalty(7.0, m.n)).weights, want, atol=1e-7)


def test_elastic_net_mix_stays_at_most_one(data):
    model = li.elastic_net_cv(data, ratios=(1,), alphas=(0.01, 1))
    assert model.ratio <= 1


def test_unseen_level_scores_as_the_base(spark, data):
    model = li.ols(data)
    row = data.frame.limit(1)
    base = data.design.bases["region_short_code"]
    a = model.transform(row.withColumn("region_short_code", F.lit("us/xyz"))).first().prediction
    b = model.transform(row.withColumn("region_short_code", F.lit(base))).first().prediction
    assert a == pytest.approx(b)


def test_coefficients_are_sorted_with_the_intercept_last(data):
    rows = li.ols(data).coefficients().orderBy("position").collect()
    values = [r.coefficient for r in rows[:-1]]
    assert values == sorted(values) and rows[-1].feature == "(intercept)"


def test_correlation_matrix_is_symmetric(sold):
    rows = lv.correlation_matrix(fe.feature_set(sold, "segment"), NUMERIC_FEATURES, CATS, LABEL).collect()
    r = {(x.i, x.j): x.r for x in rows}
    assert all(r[i, j] == pytest.approx(r[j, i]) for i, j in r)
    assert r["year", "year"] == pytest.approx(1.0)


def test_moments_keep_digits_of_large_values(spark):
    rows = [(k, float(k % 7), 3.0 + 4.0 * (k % 7) + (k % 3), "a" if k % 2 else "b") for k in range(400)]
    frame = spark.createDataFrame(rows, "id long, x double, y double, g string")
    near = mo.collect_moments(frame, ["x"], ["g"], "y")[1][()]
    far = mo.collect_moments(frame.withColumn("x", F.col("x") + 1e8), ["x"], ["g"], "y")[1][()]
    assert np.allclose(near.cross, far.cross, rtol=1e-6)


def test_correlation_matrix_is_pairwise(spark):
    from forecourt.operators.aggregates import correlation_with

    rows = [(1.0, None, 2.0), (2.0, 1.0, 1.0), (3.0, 5.0, 4.0), (4.0, None, 3.0), (5.0, 2.0, 9.0)]
    frame = spark.createDataFrame(rows, "a double, b double, y double")
    matrix = {(r.i, r.j): r.r for r in lv.correlation_matrix(frame, ["a", "b"], [], "y").collect()}
    with_y = {r.feature: r.r for r in correlation_with(frame, "y", ["a", "b"]).collect()}
    assert matrix["a", "y"] == pytest.approx(with_y["a"]) and matrix["b", "y"] == pytest.approx(with_y["b"])


def _wide_rows(spark, n):
    draw = np.random.default_rng(7)
    rows = []
    for k in range(n):
        a, b, x = int(draw.integers(0, 4)), int(draw.integers(0, 9)), float(draw.normal())
        rows.append((7_919_003 * k, f"a{a}", b, x, 3.0 * x + 2.0 * a + (b == 3) * 5.0 + float(draw.normal())))
    return spark.createDataFrame(rows, "quote_id long, a string, b int, x double, y double")


def test_wide_fits_equal_dense_ones(spark):
    frame, factors = _wide_rows(spark, 400), ["a", "b"]
    dense, wide = li.linear_data(frame, ["x"], factors, "y"), wi.wide_data(frame, ["x"], factors, "y")
    cases = [("train", li.net_penalty(0.05, 1.0), "test"), ("-1", li.net_penalty(0.1, 0.7), "1"), ("train", li.ridge_penalty(3, 280), "train")]
    fits = wi.fit(wide, [wi.Task(s, p) for s, p, _ in cases])
    found = wi.errors(fits, [e for _, _, e in cases])
    rows = {
        "train": dense.rows("train"), "test": dense.rows("test"),
        "-1": dense.rows("train", lambda o, i: o != 1), "1": dense.rows("train", lambda o, i: o == 1),
    }
    weights = {(r.task, r.b, r.l): r.w for r in fits.weights.collect()}
    for k, (s, p, e) in enumerate(cases):
        best = li.solve(rows[s], p)
        mine = [*fits.slopes[k], *[weights.get((k, factors.index(c), str(v)), 0.0) for c, v in dense.design.dummies]]
        assert mine == pytest.approx(best.weights.tolist(), abs=1e-6)
        assert fits.intercepts[k] == pytest.approx(best.intercept)
        assert found[k] == pytest.approx((best.mse(rows[e]), best.r2(rows[e])))
    model = wi.WideModel("lasso", 0.05, 1.0, wi.Fits(wide, fits.tasks[:1], fits.weights.filter("task = 0"), fits.slopes, fits.intercepts))
    scored = model.transform(frame.filter(fe.split_name() == "test"))
    assert scored.agg(F.avg((F.col("prediction") - F.col("y")) ** 2)).first()[0] == pytest.approx(found[0][0])
    assert model.coefficients().count() == 1 + 3 + 8 + 1


def test_wide_search_finds_the_dense_winner(spark):
    frame = _wide_rows(spark, 200)
    dense, wide = li.linear_data(frame, ["x"], ["a", "b"], "y"), wi.wide_data(frame, ["x"], ["a", "b"], "y")
    grid = [1.0, 0.1]

    def penalty(a, _n):
        return li.net_penalty(a, 1.0)

    losses = li.grid_scores(dense.fold_parts("train"), grid, penalty)
    alpha = wi._search(wide, grid, penalty)
    assert alpha == grid[int(np.argmin(losses))]
    report = wi.report([wi._winner("lasso", wide, alpha, 1.0, penalty(alpha, 0))]).first()
    best = li.solve(dense.rows("train"), penalty(alpha, 0))
    assert (report.train_rmse, report.holdout_rmse) == pytest.approx((best.rmse(dense.rows("train")), best.rmse(dense.rows("test"))))
    assert report.n_weights == np.count_nonzero(best.weights)

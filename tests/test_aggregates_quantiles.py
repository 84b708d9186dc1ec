import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from forecourt.operators import aggregates as ag
from forecourt.operators import quantiles as qn
from forecourt.operators import smoothing as sm


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 3, 4, 10)] + [(None,), (float("nan"),)], "x double")
    rows = ag.histogram(df, "x", bins=5).collect()
    assert [r.n for r in rows] == [2, 2, 1, 0, 1]
    assert rows[0].lo == 0 and rows[-1].hi == 10


def test_histogram_with_given_range_and_constant_column(spark):
    df = spark.createDataFrame([(x,) for x in (0, 5, 9, 50)], "x int")
    assert [r.n for r in ag.histogram(df, "x", 2, 0, 10).collect()] == [1, 2]
    same = spark.createDataFrame([(7,), (7,)], "x int")
    assert sum(r.n for r in ag.histogram(same, "x", 3).collect()) == 2


def test_shares_sum_to_one(star):
    rows = ag.share(star, "make").collect()
    assert sum(r.fraction for r in rows) == pytest.approx(1.0)
    assert [r.n for r in rows] == sorted((r.n for r in rows), reverse=True)


def test_groups_without_sale(quotes):
    df = quotes({"expected_margin": 5}, {}, {"make": "GMC"}, {"make": "Buick"})
    assert [r.make for r in ag.without_sale(df).collect()] == ["Buick", "GMC"]


def test_make_model_key_is_null_with_a_null_part(quotes):
    df = quotes({}, {"model": None}).select(ag.make_model_key().alias("k"))
    assert [r.k for r in df.collect()] == ["Honda_Civic", None]


def test_skewness_is_the_population_kind(spark):
    df = spark.createDataFrame([(float(x), 1.0) for x in (1, 2, 10, 11, 40)], "x double, c double")
    rows = {r.feature: r for r in ag.skewness_table(df, ["x", "c"]).collect()}
    assert rows["x"].skewness == pytest.approx(1.2034412295529684) and rows["x"].is_skewed
    assert rows["c"].skewness is None


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 1.0) for i in range(5)], "x double, y double, c double")
    rows = {r.feature: r.r for r in ag.correlation_with(df, "y", ["x", "c"]).collect()}
    assert rows["x"] == pytest.approx(1.0) and rows["c"] is None


def test_top_k(quotes):
    df = quotes({}, {}, {"make": "BMW"}, {"make": "Audi"})
    got = [r.make for r in ag.top_k(df, "make", "mileage", 2).collect()]
    assert got == ["Honda", "Audi"]


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one group; values span many blocks, with repeats and nulls."""
    rng = random.Random(3)
    rows = []
    for _ in range(3000):
        g = "hot" if rng.random() < 0.34 else rng.choice(["a", "b", None])
        v = rng.choice([None, rng.randint(-2_000_000_000, 2_000_000_000), rng.randint(-50, 50)])
        rows.append((g, v))
    rows.append(("one", 5))
    return spark.createDataFrame(rows, "g string, v int")


def test_quantiles_match_the_builtin(skewed):
    got = {r.g: r for r in qn.quantiles(skewed, ["g"], "v", {"a": 0.25, "b": 0.5, "c": 0.99}).collect()}
    want = skewed.groupBy("g").agg(F.percentile("v", [0.25, 0.5, 0.99]).alias("p"), F.count("v").alias("n"))
    for r in want.collect():
        assert [got[r.g].a, got[r.g].b, got[r.g].c] == pytest.approx(r.p)
        assert got[r.g].total == r.n


def test_ungrouped_quantile(skewed):
    want = skewed.agg(F.percentile("v", 0.5)).first()[0]
    assert qn.quantiles(skewed, [], "v", {"m": 0.5}).first().m == want


def test_quantiles_take_fractions(spark):
    df = spark.createDataFrame([(1.5,)], "v double")
    assert qn.quantiles(df, [], "v", {"m": 0.5}).first().m == 1.5


def test_box_stats(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 3, 4, 100)], "g string, v int")
    row = qn.box_stats(df, "g", "v").first()
    assert (row.q1, row.median, row.q3) == (2.0, 3.0, 4.0)
    assert (row.whisker_low, row.whisker_high, row.n_outliers, row.n) == (1, 4, 1, 5)
    rough = qn.box_stats(df.withColumn("v", F.col("v") / 2), "g", "v", approx=10000).first()
    assert rough.median == 1.5


def brute_loess(x, y, span, grid):
    at = np.linspace(x.min(), x.max(), grid)
    out = []
    for g in at:
        d = np.abs(x - g)
        h = np.sort(d)[int(np.ceil(span * len(x))) - 1]
        w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0.0)
        u = x - g
        w0, w1, w2 = w.sum(), (w * u).sum(), (w * u * u).sum()
        y0, y1 = (w * y).sum(), (w * u * y).sum()
        out.append((w2 * y0 - w1 * y1) / (w0 * w2 - w1 * w1))
    return out


def test_loess_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 10, 400)
    y = np.sin(x) * 100 + rng.normal(0, 5, 400)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = [r.smoothed for r in sm.loess(df, "x", "y", 0.3, 25).collect()]
    assert got == pytest.approx(brute_loess(x, y, 0.3, 25), abs=1e-4)


def test_scatter_points_keep_every_row(star):
    pts = sm.scatter_points(star, "percent_to_market", "expected_margin", 0.01, 500)
    assert pts.agg(F.sum("n")).first()[0] == 6000


@pytest.mark.parametrize("kind", ["double", "bigint"])
def test_wide_quartiles_match_brute_force(spark, kind):
    rng = random.Random(7)
    scale = {"double": 1e-3, "bigint": 10**12}[kind]
    values = [rng.choice([0, -1, 1]) * rng.randint(0, 10**6) * scale for _ in range(800)] + [1.5 * scale] * 5
    values = [int(v) for v in values] if kind == "bigint" else [float(v) for v in values]
    df = spark.createDataFrame([("a", v) for v in values] + [("a", None), ("b", values[0])], f"g string, v {kind}")
    got = {r.g: r for r in qn.quantiles(df, ["g"], "v", {"q1": 0.25, "q2": 0.5, "q3": 0.75}).collect()}
    want = np.quantile(np.array(values, dtype=float), [0.25, 0.5, 0.75])
    assert [got["a"].q1, got["a"].q2, got["a"].q3] == pytest.approx(want)
    assert got["a"].total == len(values) and got["b"].q2 == pytest.approx(float(values[0]))


def test_nan_is_no_value(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", float("nan")), ("a", float("inf"))], "g string, v double")
    row = qn.quantiles(df, ["g"], "v", {"low": 0.0, "mid": 0.5}).first()
    assert (row.total, row.low, row.mid) == (3, 1.0, 3.0)


@pytest.mark.parametrize("blocks", [1, 7, 256])
def test_loess_by_blocks_matches_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(sm, "BLOCKS", blocks)
    draw = np.random.default_rng(blocks)
    x = np.concatenate([draw.normal(size=1500) * 40, np.repeat([3.5, 90.25], 200)])
    y = np.sin(x / 20) * 100 + x + draw.normal(size=len(x))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    got = [r.smoothed for r in sm.loess(df, "x", "y", 0.3, 25).collect()]
    assert got == pytest.approx(brute_loess(x, y, 0.3, 25), abs=1e-4)


def test_loess_of_none_and_of_one_place(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 4.0)], "x double, y double")
    assert {r.smoothed for r in sm.loess(df, "x", "y", grid=3).collect()} == {2.5}
    assert sm.loess(df.limit(0), "x", "y").collect() == []


def test_loess_over_steps_equals_loess_over_their_middles(spark):
    rows = [(i / 97, float(i % 13)) for i in range(300)]
    df = spark.createDataFrame(rows, "x double, y double")
    middles = spark.createDataFrame([((int(x // 0.5) + 0.5) * 0.5, y) for x, y in rows], "x double, y double")
    got = [r.smoothed for r in sm.loess(df, "x", "y", grid=10, x_step=0.5).collect()]
    assert got == pytest.approx([r.smoothed for r in sm.loess(middles, "x", "y", grid=10).collect()])


def test_sketched_boxes_stay_near_the_exact_ones(spark):
    draw = random.Random(5)
    rows = [("a", draw.gauss(0, 1)) for _ in range(4000)] + [("b", 2.0), ("b", float("nan")), ("b", None), (None, 7.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    exact = {r.g: r for r in qn.box_stats(df, "g", "v").collect()}
    sketched = {r.g: r for r in qn.box_stats(df, "g", "v", approx=200).collect()}
    values = sorted(v for g, v in rows if g == "a")
    for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        assert abs(sum(v <= sketched["a"][name] for v in values) / 4000 - p) < 0.01
    assert sketched["a"].n == exact["a"].n == 4000 and sketched["b"] == exact["b"] and sketched[None] == exact[None]
    fences = [sketched["a"][q] for q in ("q1", "q3")]
    reach = 1.5 * (fences[1] - fences[0])
    inside = [v for v in values if fences[0] - reach <= v <= fences[1] + reach]
    assert (sketched["a"].whisker_low, sketched["a"].whisker_high, sketched["a"].n_outliers) == (inside[0], inside[-1], 4000 - len(inside))

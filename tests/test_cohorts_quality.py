import random
from bisect import bisect_left

import pytest
from pyspark.sql import functions as F

from forecourt.functions import frames
from forecourt.functions.frames import lookup_where
from forecourt.operators import cleaning as cl
from forecourt.operators import cohorts as co
from forecourt.operators import quality as qu


def test_rollup_totals_match(star):
    df = cl.cleaned_quotes(star)
    rows = co.cohort_rollup(df, ["region_short_code", "make"]).collect()
    top = [r for r in rows if r.level == 2]
    assert len(top) == 1 and top[0].num_inquiries == 3599
    assert sum(r.num_sold for r in rows if r.level == 0) == top[0].num_sold == 574


def test_best_in_cohort_breaks_ties_by_name(quotes):
    df = quotes(
        {"expected_margin": 100, "make": "B"},
        {"expected_margin": 100, "make": "A"},
        {"expected_margin": 50, "make": "C"},
        {"location_zip": 2, "make": "Z"},
    )
    rows = co.best_in_cohort(df).collect()
    assert [(r.location_zip, r.make, r.avg_margin) for r in rows] == [(94110, "A", 100.0)]


def test_price_test_uses_each_arm(quotes):
    df = cl.with_margins(quotes({"location_zip": 10}, {"location_zip": 11}, {"location_zip": 11}))
    rows = co.price_test(df, ["0.5", "0.6"]).collect()
    assert [(r.arm, r.total_profit_lost) for r in rows] == [(0, 1500), (1, 3600)]


def test_outreach_rank(star):
    df = cl.unsold(cl.cleaned_quotes(star))
    best = co.outreach_rank(df, "calculated_margin", 5).collect()
    top = df.orderBy(F.desc("calculated_margin"), "quote_id").limit(5).collect()
    assert [r.quote_id for r in best] == [r.quote_id for r in top]
    per = co.outreach_rank(df, "calculated_margin", 3, "region_short_code")
    assert per.groupBy("region_short_code").count().filter("count != 3").count() == 0
    assert "WindowGroupLimit" in per._jdf.queryExecution().executedPlan().toString()


def test_market_price_gap(quotes):
    row = co.market_price_gap(quotes({"percent_to_market": 0.8}, {"percent_to_market": 0.0}), 0.1).orderBy("quote_id").collect()
    assert row[0].market_price == 15000 and row[0].price_gap == -3000 and row[0].position == "under"
    assert row[1].market_price is None and row[1].position is None


def test_validation_counts(quotes):
    df = quotes({}, {"mileage": -1, "seller_source": "fax"}, {"make": " ", "region_short_code": None})
    got = {r.rule: r.violations for r in qu.validate(df).collect()}
    assert got["mileage"] == got["seller_source"] == got["make"] == got["region_short_code"] == 1
    assert got["year"] == 0


def test_duplicates(star):
    assert [r.n for r in qu.duplicates(star).collect()] == [2]


def test_outliers_split_the_rows(star):
    known = cl.sold(star)
    inside = qu.outliers_iqr(known, "expected_margin")
    outside = qu.outliers_iqr(known, "expected_margin", keep="outliers")
    assert inside.count() + outside.count() == known.count() and outside.count() == 6


def test_days_are_imputed_from_the_nearest_cohort(quotes):
    days = "market_avg_days_to_sell"
    df = quotes(
        {days: 0},
        {days: 10},
        {days: 13},
        {days: 0, "year": 1999},
        {days: 0, "model": "Fit"},
        {days: 0, "make": "Kia"},
        {days: 40, "make": "BMW"},
        {days: None},
    )
    got = {r.quote_id: r.imputed_days for r in qu.impute_days(df).collect()}
    assert got == {1: 12, 2: 10, 3: 13, 4: 12, 5: 12, 6: 13, 7: 40, 8: None}


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_margin_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        score = rng.choice([rng.randint(-300_000, 300_000), rng.randint(0, 40)])
        rows.append((i, score, rng.choice([0, 0, rng.randint(1, 9999)])))
    df = spark.createDataFrame(rows, "quote_id long, calculated_margin int, expected_margin int")
    donors = sorted((s, k, m) for k, s, m in rows if m)
    got = {r.quote_id: r.imputed_margin for r in qu.margin_from_nearest(df).collect()}
    assert len(got) == 400
    for k, s, m in rows:
        want = m or min(donors, key=lambda d: (abs(d[0] - s), d[0], d[1]))[2]
        assert got[k] == want


def test_nearest_margin_of_fractions(spark):
    rows = [(1, 0.25, 100), (2, 0.75, 0), (3, 0.9, 300), (4, 0.5, 0), (5, None, 0), (6, float("nan"), 0), (7, -1e300, 0), (8, 0.25, 70)]
    df = spark.createDataFrame(rows, "quote_id long, calculated_margin double, expected_margin int")
    got = {r.quote_id: r.imputed_margin for r in qu.margin_from_nearest(df).collect()}
    assert got == {1: 100, 2: 300, 3: 300, 4: 100, 5: None, 6: None, 7: 100, 8: 70}


def test_nearest_margin_of_many_scores_reads_no_range_anew(spark, monkeypatch):
    plans, store = [], frames.stored
    monkeypatch.setattr(frames, "stored", lambda df: plans.append(df._jdf.queryExecution().toString().lower()) or store(df))
    rng = random.Random(3)
    rows = [(i, rng.randrange(10**9) / 10**4, i if i % 50 == 0 else 0) for i in range(20_000)]
    df = spark.createDataFrame(rows, "quote_id long, calculated_margin double, expected_margin int")
    got = {r.quote_id: r.imputed_margin for r in qu.margin_from_nearest(df).collect()}
    lent = {}
    for k, s, m in rows:
        if m:
            lent.setdefault(s, m)
    scores = sorted(lent)
    for k, s, m in rows:
        at = bisect_left(scores, s)
        near = scores[max(at - 1, 0) : at + 1]
        assert got[k] == (m or lent[min(near, key=lambda d: (abs(d - s), d))])
    # Up to the last row, a frame is worked out for each row: time grows with the square of a range.
    assert "unboundedpreceding" in plans[0] and "unboundedfollowing" not in plans[0]


def test_nearest_margin_without_any_sale(spark):
    df = spark.createDataFrame([(1, 5, 0)], "quote_id long, calculated_margin int, expected_margin int")
    assert qu.margin_from_nearest(df).first().imputed_margin is None


def test_lookup_fills_only_where_needed(spark):
    df = spark.createDataFrame([(1, "a", True), (2, "a", False), (3, None, True), (4, "z", True), (5, "a", None)], "i int, k string, w boolean")
    table = spark.createDataFrame([("a", 10), (None, 20)], "k string, v int")
    got = {r.i: r.v for r in lookup_where(df, df.w, table, ["k"], "v").collect()}
    assert got == {1: 10, 2: None, 3: 20, 4: None, 5: None}

import os
import re
from pathlib import Path

import pytest

import __spark_entry__ as entry_module
import compare
from conftest import DATA
from forecourt.functions.frames import broadcast_if_small, broadcast_limit
from forecourt.operators import cleaning as cl
from forecourt.operators import pnl as pl
from forecourt.operators import quality as qu
from forecourt.operators import quantiles as qn
from forecourt.schema import QUOTE_SCHEMA
from forecourt.sources import quotes as src

ROOT = Path(__file__).resolve().parents[1]


def test_csv_round_trip(quotes):
    df = quotes({}, {"wholesale_price": None, "location_zip": 2134})
    path = src.store(df, fmt="csv")
    back = src.read_quotes(df.sparkSession, path)
    assert back.schema == QUOTE_SCHEMA
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_leading_zero_of_a_zip_is_lost(spark, tmp_path):
    header = ",".join(QUOTE_SCHEMA.names)
    (tmp_path / "q.csv").write_text(f"{header}\n7,2010,Honda,Civic,1,02134,0.9,3,4,us/bos,5,6,web,0\n")
    for schema in (QUOTE_SCHEMA, None):
        assert src.read_quotes(spark, str(tmp_path), schema).first().location_zip == 2134


def test_tables_are_replaced(quotes):
    df = quotes({}, {})
    assert src.materialize(df, "t_quotes").count() == 2
    assert src.materialize(df.limit(1), "t_quotes").count() == 1
    folder = src.shared_folder(df.sparkSession)
    assert src.materialize(df, "t_quotes_shared", folder).count() == 2
    assert src.load_table(df.sparkSession, "t_quotes").count() == 1


def test_shared_folder_comes_from_the_session(spark):
    assert src.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_profile_and_preview(star):
    row = src.profile_source(star).first()
    assert (row.n_rows, row.n_keys, row.n_columns) == (6000, 5999, 14)
    parts = src.source_partitions(star.repartition(3)).first()
    assert (parts.n_rows, parts.n_partitions) == (6000, 3) and 2000 <= parts.fullest < 6000
    keys = [r.quote_id for r in src.preview(star).collect()]
    assert keys == sorted(keys) and len(keys) == 5


def test_view_is_registered(quotes):
    df = src.register(quotes({}, {}), "t_view")
    assert df.sparkSession.sql("SELECT count(*) FROM t_view").first()[0] == 2


def test_broadcast_only_below_the_threshold(spark, quotes):
    df = quotes({})
    assert broadcast_limit(df) == 10 * 1024 * 1024
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert broadcast_if_small(df, df) is df
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_star_scans_once_and_pushes_filters(star):
    plan = final_plan(pl.pnl(cl.cleaned_quotes(star)))
    assert plan.count("FileScan parquet [l_") == 1
    assert "IsNotNull(l_orderkey)" in plan
    assert "l_tax" not in plan and "l_quantity" not in plan


def test_box_stats_scan_the_source_once(star):
    plan = final_plan(qn.box_stats(cl.cleaned_quotes(star), "make", "calculated_margin"))
    assert plan.count("FileScan parquet [l_") == 1 and "ReusedExchange" in plan


def test_days_are_imputed_in_one_join_of_the_rows(star):
    plan = final_plan(qu.impute_days(star))
    assert plan.count("FileScan parquet [l_") == 1 and "_lane" in plan


def test_one_scan_reports(star):
    cleaned = cl.cleaned_quotes(star)
    for df in (cl.cleaning_funnel(star), pl.summary_sheet(cleaned)):
        assert final_plan(df).count("FileScan parquet [l_") == 1


def test_without_broadcast_the_star_shuffles_and_agrees(spark, star):
    want = cl.cleaning_funnel(star).collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        from forecourt.sources.star import quotes_from_star

        df = cl.cleaning_funnel(quotes_from_star(spark, DATA))
        assert "SortMergeJoin" in final_plan(df)
        assert df.collect() == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_library_never_collects_rows_to_pandas():
    banned = re.compile(r"toPandas|localCheckpoint|\.rdd\.(map|collect)|\.foreach\(")
    for path in (ROOT / "forecourt").rglob("*.py"):
        assert not banned.search(path.read_text()), path


def test_every_oracle_has_its_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


SAMPLE = [
    "source_profile",
    "cleaning_funnel",
    "pnl",
    "summary_sheet",
    "pct_to_market_applied_by_make",
    "skewness",
    "correlation_matrix",
    "chart_mileage_histogram",
    "chart_calculated_margin_box_by_make",
    "chart_percent_calculated_loess",
    "standardized",
    "string_index",
    "ols_report",
    "ridge_report",
    "lasso_report",
    "elastic_net_report",
    "model_comparison",
    "cohort_rollup",
    "days_imputed",
    "margin_from_nearest",
]


@pytest.mark.parametrize(
    "name", sorted(entry_module.oracle_sql()) if os.environ.get("ALL_QUERIES") else SAMPLE
)
def test_query_equals_its_sql(spark, name):
    con = compare.connect(DATA)
    df = entry_module.queries()[name](spark, DATA)
    assert compare.differences(df, con, entry_module.oracle_sql()[name]) == []


def test_entry(spark):
    assert entry_module.entry(spark).count() == 1


def test_scoped_copies_are_removed(spark, tmp_path):
    with src.scoped_copies(spark):
        kept = src.store(spark.range(3), str(tmp_path))
        with src.scoped_copies(spark):
            inner = src.stored(spark.range(5), str(tmp_path))
            assert inner.count() == 5 and len(os.listdir(tmp_path)) == 2
        assert os.listdir(tmp_path) == [os.path.basename(kept)]
    assert os.listdir(tmp_path) == []

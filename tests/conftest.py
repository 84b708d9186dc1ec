import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from forecourt.schema import QUOTE_SCHEMA  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    scratch = tempfile.mkdtemp(prefix="forecourt-test-")
    session = (
        SparkSession.builder.master("local[8]")
        .appName("forecourt-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", f"{scratch}/shared")
        .config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("FATAL")
    yield session
    session.stop()


GOOD = {
    "quote_id": 1,
    "year": 2010,
    "make": "Honda",
    "model": "Civic",
    "mileage": 50000,
    "location_zip": 94110,
    "percent_to_market": 0.9,
    "market_avg_days_to_sell": 30,
    "n_similar_vehicles_listed": 10,
    "region_short_code": "us/sfo",
    "exact_list_price": 12000,
    "wholesale_price": 9000,
    "seller_source": "web",
    "expected_margin": 0,
}


@pytest.fixture(scope="session")
def quotes(spark):
    """Build quotes from changes to a good row; keys count up."""

    def build(*changes):
        rows = [{**GOOD, "quote_id": i + 1, **c} for i, c in enumerate(changes)]
        return spark.createDataFrame([tuple(r[f] for f in QUOTE_SCHEMA.names) for r in rows], QUOTE_SCHEMA)

    return build


@pytest.fixture(scope="session")
def star(spark):
    from forecourt.sources.star import quotes_from_star

    return quotes_from_star(spark, DATA)

"""The quote table: one row per seller inquiry."""

from __future__ import annotations

from pyspark.sql import types as T

QUOTE_SCHEMA = T.StructType(
    [
        T.StructField("quote_id", T.LongType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("make", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("mileage", T.IntegerType()),
        # An int, as an inferred schema would give: a leading zero is lost.
        T.StructField("location_zip", T.IntegerType()),
        T.StructField("percent_to_market", T.DoubleType()),
        T.StructField("market_avg_days_to_sell", T.IntegerType()),
        T.StructField("n_similar_vehicles_listed", T.IntegerType()),
        T.StructField("region_short_code", T.StringType()),
        T.StructField("exact_list_price", T.IntegerType()),
        T.StructField("wholesale_price", T.IntegerType()),
        T.StructField("seller_source", T.StringType()),
        T.StructField("expected_margin", T.IntegerType()),
    ]
)

QUOTE_COLUMNS = QUOTE_SCHEMA.fieldNames()

# Columns a usable quote must fill in. The key, the prices and the margin have
# rules of their own.
REQUIRED_COLUMNS = (
    "year",
    "make",
    "model",
    "mileage",
    "location_zip",
    "percent_to_market",
    "market_avg_days_to_sell",
    "n_similar_vehicles_listed",
    "region_short_code",
    "seller_source",
)

NUMERIC_FEATURES = ("year", "mileage", "market_avg_days_to_sell", "n_similar_vehicles_listed")
SKEWED_FEATURES = ("market_avg_days_to_sell", "n_similar_vehicles_listed")
LABEL = "expected_margin"

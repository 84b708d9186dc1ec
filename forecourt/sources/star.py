"""Quotes derived from an order-entry star schema (lineitem, orders, part, customer, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forecourt.functions.frames import broadcast_if_small
from forecourt.schema import QUOTE_COLUMNS


# The columns read, with their types: no footer is opened just to infer them.
STAR_COLUMNS = {
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "part": "p_partkey bigint, p_brand string, p_type string, p_size int",
    "customer": "c_custkey bigint, c_nationkey int",
    "nation": "n_nationkey int, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def quotes_from_star(spark: SparkSession, folder: str) -> DataFrame:
    """One quote per order line.

    A side is hinted as broadcast only if its file scan is below the session's
    threshold. Otherwise both sides shuffle on the key and AQE splits hot part
    or order keys. Lookups join their dimension first, so order lines move at
    most twice. Whatever depends on one table is worked out before its join:
    the rows that move are narrow, and the generated code of the joined stage
    stays small enough for the JIT compiler.
    """

    def table(name: str) -> DataFrame:
        return spark.read.schema(STAR_COLUMNS[name]).parquet(f"{folder}/{name}.parquet")

    lines, parts, orders = table("lineitem"), table("part"), table("orders")
    nations, customers = table("nation"), table("customer")
    place = nations.join(table("region"), F.col("n_regionkey") == F.col("r_regionkey")).selectExpr(
        "n_nationkey", "concat('us/', lower(substring(r_name, 1, 3))) AS region_short_code"
    )
    seller = customers.join(
        broadcast_if_small(place, nations), F.col("c_nationkey") == F.col("n_nationkey")
    ).select("c_custkey", "region_short_code")
    inquiry = _inquiries(orders).join(
        broadcast_if_small(seller, customers), F.col("o_custkey") == F.col("c_custkey")
    )
    joined = (
        _offers(lines)
        .join(broadcast_if_small(_cars(parts), parts), F.col("l_partkey") == F.col("p_partkey"))
        .join(broadcast_if_small(inquiry, orders), F.col("l_orderkey") == F.col("o_orderkey"))
    )
    return joined.selectExpr(
        "quote_id",
        "inquiry_year + car_year_offset AS year",
        "make",
        "model",
        "car_mileage + offer_mileage AS mileage",
        "location_zip",
        "percent_to_market",
        "pmod(abs(datediff(ship_date, order_date)), 520) AS market_avg_days_to_sell",
        "n_similar_vehicles_listed",
        "region_short_code",
        "exact_list_price",
        "car_price_factor * (exact_list_price - (car_total + inquiry_total)) AS wholesale_price",
        "seller_source",
        "returned * IF(far_off, 150000, "
        "CAST(floor((car_total + inquiry_total) * 58 / 100.0D) AS int) "
        "+ CAST((car_luck + offer_luck) % 4001 AS int) - 2000) AS expected_margin",
    ).select(*QUOTE_COLUMNS)


def _cars(parts: DataFrame) -> DataFrame:
    """What a quote takes from its part."""
    similar = parts.groupBy("p_brand", "p_type").agg(
        F.count("*").cast("int").alias("n_similar_vehicles_listed")
    )
    # Null-safe keys: a part without brand or type is similar to others like it.
    same = F.expr("p.p_brand <=> s.p_brand AND p.p_type <=> s.p_type")
    return (
        parts.alias("p")
        .join(broadcast_if_small(similar, parts).alias("s"), same)
        .selectExpr(
            "p_partkey",
            "p.p_brand AS make",
            "p.p_type AS model",
            "n_similar_vehicles_listed",
            "CAST(p_size * 2500 + p_partkey % 1000 AS int) AS car_mileage",
            "4000 - 40 * p_size AS car_total",
            "p_partkey * 37 AS car_luck",
            "IF(p_partkey % 97 = 0, NULL, 0) AS car_year_offset",
            "p_partkey % 499 = 0 AS far_off",
            "CASE WHEN p_partkey % 89 = 0 THEN NULL WHEN p_partkey % 83 = 0 THEN 0 ELSE 1 END "
            "AS car_price_factor",
        )
    )


def _inquiries(orders: DataFrame) -> DataFrame:
    """What a quote takes from its order."""
    return orders.selectExpr(
        "o_orderkey",
        "o_custkey",
        "to_date(o_orderdate) AS order_date",
        "year(o_orderdate) AS inquiry_year",
        "300 * (year(o_orderdate) - 1995) + 7 * CAST(o_orderkey % 100 AS int) AS inquiry_total",
        "CASE WHEN o_orderkey % 101 = 0 THEN NULL "
        "WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'iOS' ELSE 'web' END AS seller_source",
    )


def _offers(lines: DataFrame) -> DataFrame:
    """What a quote takes from its order line."""
    return lines.selectExpr(
        "l_orderkey",
        "l_partkey",
        "((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS quote_id",
        "l_linenumber * 137 AS offer_mileage",
        "CAST(10000 + l_suppkey AS int) AS location_zip",
        "CAST(100 - 3 * CAST(round(l_discount * 100) AS int) AS double) / 100.0D AS percent_to_market",
        "CAST(floor(l_extendedprice) AS int) + 10000 AS exact_list_price",
        "l_suppkey * 11 AS offer_luck",
        "to_date(l_shipdate) AS ship_date",
        "IF(l_returnflag = 'R' AND l_linestatus = 'F', 1, 0) AS returned",
    )

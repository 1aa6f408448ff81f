"""The test tables seen as the retail model: facts, dimensions, a change feed and clicks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.functions.columns import surrogate_key
from tidelake.session import read_table

STATUS = {"F": "Completed", "O": "pending"}
CLICKS = {"view": "page_view", "click": "add_to_cart", "purchase": "purchase"}


def _mapped(column: str, mapping: dict[str, str], other: str):
    out = F
    for k, v in mapping.items():
        out = out.when(F.col(column) == k, v)
    return out.otherwise(other)


def orders(spark: SparkSession, d: str) -> DataFrame:
    """One row per order."""
    return read_table(spark, d, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.to_date("o_orderdate").alias("order_date"),
        F.col("o_totalprice").alias("total_amount"),
        _mapped("o_orderstatus", STATUS, "cancelled").alias("status"),
        surrogate_key(["o_custkey"], "||").alias("customer_sk"),
    )


def order_lines(spark: SparkSession, d: str) -> DataFrame:
    """One row per line, with the order's date and status; the amount is the line's."""
    lines = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"), F.col("l_extendedprice").alias("total_amount"), surrogate_key(["l_partkey"], "||").alias("products_sk"))
    return lines.join(orders(spark, d).select("order_id", "order_date", "status"), "order_id")


def products(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_type").alias("category"), F.col("p_retailprice").alias("price"), surrogate_key(["p_partkey"], "||").alias("products_sk")
    )


def customers(spark: SparkSession, d: str) -> DataFrame:
    nation, region = read_table(spark, d, "nation"), read_table(spark, d, "region")
    place = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("region"))
    return (
        read_table(spark, d, "customer")
        .join(place, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("name"),
            F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@mail.test")).alias("email"),
            "region",
            surrogate_key(["c_custkey"], "||").alias("customer_sk"),
        )
    )


def feed(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots of customers: each order tells the priority that its customer has on its day; of several the latest order counts."""
    return read_table(spark, d, "orders").select(F.col("o_custkey").alias("customer_id"), F.to_date("o_orderdate").alias("modified_at"), F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("seen"))


def clicks(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").select(F.col("event_id"), F.col("user_id").alias("customer_id"), _mapped("event_type", CLICKS, "search").alias("event_type"), F.col("ts").alias("event_ts"), "props")

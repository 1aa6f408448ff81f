"""The aggregates: daily sales, customer value, product performance and hourly traffic."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelake.functions.columns import completed, exact_average, ltv_segment, rate


def daily_sales(orders: DataFrame, products: DataFrame) -> DataFrame:
    """Revenue of completed orders by day and category."""
    sold = orders.where(completed(F.col("status"))).join(products.select("products_sk", F.col("category").alias("product_category")), "products_sk")
    return sold.groupBy("order_date", "product_category").agg(
        F.count_distinct("order_id").alias("total_orders"),
        F.round(F.sum("total_amount"), 2).alias("total_revenue"),
        exact_average(F.col("total_amount")).alias("avg_revenue_per_order"),
    )


def customer_ltv(orders: DataFrame, customers: DataFrame, high: float = 1000, medium: float = 500, grain: str = "customer_sk") -> DataFrame:
    """Revenue per customer version (or another grain of the customers) and its segment."""
    who = [c for c in ("customer_sk", "customer_id", "name", "email", "region") if c in customers.columns]
    keys = list(dict.fromkeys([grain, *(who if grain == "customer_sk" else [grain])]))
    sold = orders.where(completed(F.col("status"))).drop("customer_id").join(customers.select(*who), "customer_sk")
    out = sold.groupBy(*keys).agg(
        F.count_distinct("order_id").alias("total_orders"),
        F.round(F.sum("total_amount"), 2).alias("total_revenue"),
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
    )
    return out.withColumn("ltv_segment", ltv_segment(F.col("total_revenue"), high, medium))


def product_sales(orders: DataFrame, products: DataFrame) -> DataFrame:
    keys = ["products_sk", "product_id", "product_name", "category"]
    sold = orders.where(completed(F.col("status"))).drop("product_id").join(products.select(*keys), "products_sk")
    return sold.groupBy(*keys).agg(F.count_distinct("order_id").alias("units_sold"), F.round(F.sum("total_amount"), 2).alias("total_revenue"))


#: Steps of the ranking's histogram for each doubling of the revenue.
STEPS = 64


def rank_in_category(sales: DataFrame) -> DataFrame:
    """Rank by revenue in the category; equals share a rank, and gaps follow. Products without revenue come last, as equals.

    No task sorts a whole category: products are counted by category and step of the revenue's logarithm, a window over these counts tells
    how many products stand in higher steps, and only the products of one step are ranked against each other.
    """
    r = F.col("total_revenue")
    step = F.when(r > 0, F.floor(F.log2(r.cast("double")) * STEPS) + (1 << 20)).when(r < 0, -(F.floor(F.log2(-r.cast("double")) * STEPS) + (1 << 20))).when(r == 0, 0).otherwise(-(1 << 40))
    stepped = sales.withColumn("_step", step.cast("long"))
    higher = Window.partitionBy("category").orderBy(F.col("_step").desc()).rowsBetween(Window.unboundedPreceding, -1)
    counts = stepped.groupBy("category", "_step").agg(F.count(F.lit(1)).alias("_n")).withColumn("_above", F.coalesce(F.sum("_n").over(higher), F.lit(0))).drop("_n")
    counts = counts.select(F.col("category").alias("_category"), F.col("_step").alias("_at"), "_above")
    placed = stepped.join(counts, F.col("category").eqNullSafe(F.col("_category")) & (F.col("_step") == F.col("_at")))
    among = F.rank().over(Window.partitionBy("category", "_step").orderBy(r.desc()))
    return placed.withColumn("category_rank", (F.col("_above") + among).cast("int")).select(*sales.columns, "category_rank")


def product_performance(orders: DataFrame, products: DataFrame) -> DataFrame:
    return rank_in_category(product_sales(orders, products))


def affected_categories(changed: DataFrame, products: DataFrame) -> DataFrame:
    """Categories whose ranks changed orders can move."""
    return products.join(changed.select("products_sk").distinct(), "products_sk", "left_semi").select("category").distinct()


def product_performance_incremental(target: DataFrame | None, orders: DataFrame, products: DataFrame, changed: DataFrame) -> DataFrame:
    """Two hops: products of changed orders give categories, and all products of these are ranked anew."""
    if target is None:
        return product_performance(orders, products)
    categories = affected_categories(changed, products)
    peers = products.join(categories, "category", "left_semi")
    fresh = product_performance(orders.join(peers.select("products_sk"), "products_sk", "left_semi"), peers)
    return target.join(categories, "category", "left_anti").unionByName(fresh.select(*target.columns))


def hourly_traffic(sessions: DataFrame) -> DataFrame:
    """Views, visitors, sessions, funnel rates and mean duration by the hour in which sessions start."""
    hour = sessions.withColumn("event_hour", F.date_trunc("hour", "first_event_ts"))
    counted = hour.groupBy("event_hour").agg(
        F.sum("page_view_count").alias("page_views"),
        F.count_distinct("customer_id").alias("unique_visitors"),
        F.count("session_id").alias("total_sessions"),
        F.count_if(F.col("add_to_cart_count") > 0).alias("_with_cart"),
        F.count_if("converted").alias("_with_purchase"),
        F.round(F.avg("session_duration_secs"), 1).alias("avg_session_duration_secs"),
    )
    shares = {"add_to_cart_rate": rate(F.col("_with_cart"), F.col("total_sessions")), "purchase_rate": rate(F.col("_with_purchase"), F.col("total_sessions"))}
    return counted.withColumns(shares).drop("_with_cart", "_with_purchase")

"""Dashboard reads over daily sales. Ranges are inclusive and end at as_of."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_range(days: str, low: date | str, high: date | str):
    return F.col(days).between(F.lit(low).cast("date"), F.lit(high).cast("date"))


def total(sales: DataFrame, column: str, low: date | str, high: date | str, name: str) -> DataFrame:
    """The sum of a column over a range of days; one row."""
    return sales.where(in_range("order_date", low, high)).agg(F.round(F.sum(column), 2).alias(name))


def category_ranking(sales: DataFrame, low: date | str, high: date | str) -> DataFrame:
    return sales.where(in_range("order_date", low, high)).groupBy("product_category").agg(F.round(F.sum("total_revenue"), 2).alias("revenue"))


def facets(sales: DataFrame, field: str, low: date | str, high: date | str) -> DataFrame:
    """For each value of a field, how many rows the range has."""
    return sales.groupBy(field).agg(F.count_if(in_range("order_date", low, high)).alias("n_rows"))


def timeseries(sales: DataFrame) -> DataFrame:
    return sales.select("order_date", "product_category", "total_revenue")


def top(sessions: DataFrame, n: int = 10) -> DataFrame:
    """The longest sessions: a sort with a limit, so a heap per task."""
    return sessions.orderBy(F.col("session_duration_secs").desc(), F.col("session_id")).limit(n)

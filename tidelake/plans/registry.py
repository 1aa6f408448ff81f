"""What runs: the control registry of bronze, silver and gold tables, as data."""

from __future__ import annotations

from dataclasses import dataclass, field

from tidelake.operators.checks import Check
from tidelake.operators.silver import DimensionJoin


@dataclass(frozen=True)
class BronzeTable:
    name: str
    path: str


@dataclass(frozen=True)
class SilverTable:
    """transform: scd1, scd2, fact or sessions."""

    name: str
    source: str
    transform: str
    order: int
    keys: tuple[str, ...]
    sk: str = ""
    date: str = ""
    compare: tuple[str, ...] = ()
    newest: tuple[str, ...] = ("source_file_modified_at", "ingestion_timestamp")
    mapping: dict = field(default_factory=dict)
    derived: dict = field(default_factory=dict)
    joins: tuple[DimensionJoin, ...] = ()
    checks: tuple[Check, ...] = ()
    depends: tuple[str, ...] = ()
    watermark: str = "ingestion_timestamp"
    pipeline: str = "batch"
    active: bool = True


@dataclass(frozen=True)
class GoldTable:
    """mode: incremental or full. affected: the columns by which it is kept up to date, and cut in buckets."""

    name: str
    sources: tuple[str, ...]
    order: int
    keys: tuple[str, ...]
    affected: tuple[str, ...]
    mode: str = "incremental"
    pipeline: str = "batch"
    depends: tuple[str, ...] = ()
    active: bool = True


BRONZE = (BronzeTable("customers_raw", "customers"), BronzeTable("products_raw", "products"), BronzeTable("orders_raw", "orders"))

SILVER = (
    SilverTable("dim_customers", "customers_raw", "scd2", 1, ("customer_id",), "customer_sk", "customer_modified_at", ("email", "region"), checks=(Check("customer_id", "not_null"),)),
    SilverTable("dim_products", "products_raw", "scd1", 2, ("product_id",), "products_sk", checks=(Check("product_id", "not_null"), Check("price", "positive"))),
    SilverTable(
        "orders_clean",
        "orders_raw",
        "fact",
        3,
        ("order_id",),
        joins=(
            DimensionJoin("dim_customers", "customer_id", "customer_id", "customer_sk", "order_date"),
            DimensionJoin("dim_products", "product_id", "product_id", "products_sk"),
        ),
        checks=(Check("order_id", "not_null"), Check("total_amount", "positive"), Check("status", "allowed", ("pending", "completed", "cancelled", "refunded"))),
        depends=("dim_customers", "dim_products"),
    ),
    SilverTable("clickstream_sessions", "clickstream_raw", "sessions", 4, ("session_id",), watermark="ingested_at", pipeline="streaming"),
)

GOLD = (
    GoldTable("daily_sales_summary", ("orders_clean", "dim_products"), 1, ("order_date", "product_category"), ("order_date",), depends=("orders_clean",)),
    GoldTable("customer_ltv", ("orders_clean", "dim_customers"), 2, ("customer_sk",), ("customer_sk",), depends=("orders_clean",)),
    GoldTable("product_performance", ("orders_clean", "dim_products"), 3, ("products_sk",), ("category",), depends=("orders_clean",)),
    GoldTable("hourly_traffic_metrics", ("clickstream_sessions",), 4, ("event_hour",), ("event_hour",), pipeline="streaming", depends=("clickstream_sessions",)),
)

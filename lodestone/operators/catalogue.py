"""Servers and their tools: a fixed catalogue, and look-ups in catalogues of that shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: name, tier, tags, capabilities, destructive, requests a minute, burst
SERVERS = (
    ("business-orders", 2, ("business", "orders", "ecommerce"), ("read", "write", "business"), False, 60, 10),
    ("business-inventory", 2, ("business", "inventory", "warehouse"), ("read", "write", "business"), False, 60, 10),
    ("business-payments", 3, ("business", "payments", "finance"), ("read", "write", "business", "payment"), True, 10, 3),
    ("business-crm", 2, ("business", "crm", "sales"), ("read", "write", "business"), False, 60, 10),
)
# fixed values: server, tool, tier, capabilities, destructive
TOOLS = (
    ("business-orders", "create_order", 2, ("write", "business"), False),
    ("business-orders", "get_order", 1, ("read", "business"), False),
    ("business-orders", "update_order_status", 2, ("write", "business"), False),
    ("business-orders", "list_orders", 1, ("read", "business"), False),
    ("business-inventory", "check_stock", 1, ("read", "business"), False),
    ("business-inventory", "reserve_stock", 2, ("write", "business"), False),
    ("business-inventory", "release_stock", 2, ("write", "business"), False),
    ("business-inventory", "get_product", 1, ("read", "business"), False),
    ("business-inventory", "list_low_stock", 1, ("read", "business"), False),
    ("business-payments", "process_payment", 3, ("write", "business", "payment"), True),
    ("business-payments", "refund_payment", 3, ("write", "business", "payment"), True),
    ("business-payments", "get_payment_status", 1, ("read", "business", "payment"), False),
    ("business-payments", "reconcile_payments", 2, ("read", "write", "business", "payment"), False),
    ("business-crm", "create_lead", 2, ("write", "business"), False),
    ("business-crm", "get_contact", 1, ("read", "business"), False),
    ("business-crm", "update_contact", 2, ("write", "business"), False),
    ("business-crm", "search_contacts", 1, ("read", "business"), False),
    ("business-crm", "log_activity", 2, ("write", "business"), False),
)


def servers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, t, list(g), list(c), d, r, b) for n, t, g, c, d, r, b in SERVERS], "name string, tier int, tags array<string>, capabilities array<string>, destructive boolean, per_minute int, burst int")


def tools(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, n, i, t, list(c), d) for i, (s, n, t, c, d) in enumerate(TOOLS)], "server string, tool string, ord int, tier int, capabilities array<string>, destructive boolean")


def register(registry: DataFrame, new: DataFrame) -> DataFrame:
    """``registry`` with ``new`` servers, which replace those of the same name."""
    return registry.join(new.select("name"), "name", "left_anti").unionByName(new)


def with_capability(registry: DataFrame, capability: str) -> DataFrame:
    return registry.where(F.array_contains("capabilities", capability))


def up_to_tier(registry: DataFrame, tier: int) -> DataFrame:
    return registry.where(F.col("tier") <= tier)


def words_of(tool: Column) -> Column:
    """The words of a tool's name."""
    return F.split(tool, "_")

"""The driver's tables bound as observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from numerale.sources.observations import as_series


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it is now: the schema is read from its files each time."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_series(load(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderdate", "o_totalprice")


def orders_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account balance of the ordering customer, per nation: has negative values.

    Customers grow with the data, so no side is forced to be broadcast: Spark
    does it below its size threshold, and otherwise splits a customer with
    very many orders through the adaptive skew join.
    """
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey)
    return as_series(joined, ["c_nationkey"], "o_orderdate", "c_acctbal")


def lineitem_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_series(load(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_shipdate", "l_extendedprice")

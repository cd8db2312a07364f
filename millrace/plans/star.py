"""Queries over the star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.exact import merge_parts, scaled, sum_parts, total
from ..operators.grouping import LEVEL, cube_totals, grouping_set_totals, rollup_totals
from ..operators.matching import having_match, lacking_match, with_match_totals
from ..operators.quantiles import quantiles
from ..operators.ranking import top_per_group
from ..operators.sets import bag_except, bag_intersect, set_except, set_intersect, set_union
from ..sources.tables import in_years, read_table

_NET_DIGITS = 4


def _net() -> Column:
    """Net price of a line in ten-thousandths: cents times whole percents."""
    return scaled("l_extendedprice") * (F.lit(100) - scaled("l_discount"))


def _year(column: str) -> Column:
    return F.year(column).cast("bigint")


def returned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines of more than 25 units shipped in 1997 to 1999, with net price."""
    lines = read_table(spark, sf_dir, "lineitem")
    lines = lines.where((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 25))
    return in_years(lines, "l_shipdate", 1997, 2000).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        (_net() / 10**_NET_DIGITS).alias("net_price"),
    )


def revenue_by_region_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines returned and their net revenue, by region and order year."""
    lines = read_table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    returned = with_match_totals(
        orders, lines, "o_orderkey", "l_orderkey",
        [F.count(F.lit(1)).alias("lines"), *sum_parts(_net(), "revenue")], how="inner",
    )
    places = (
        read_table(spark, sf_dir, "customer")
        .select("c_custkey", "c_nationkey")
        .join(read_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(read_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", "r_name")
    )
    return (
        returned.join(places, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("r_name", _year("o_orderdate").alias("order_year"))
        .agg(F.sum("lines").alias("n_lines"), *merge_parts("revenue"))
        .select("r_name", "order_year", "n_lines", total("revenue", _NET_DIGITS).alias("revenue"))
    )


def orders_by_line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many orders of each priority have how many lines, none included."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    counted = with_match_totals(
        orders, read_table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey",
        [F.count(F.lit(1)).alias("lines")],
    )
    return (
        counted.groupBy("o_orderpriority", F.coalesce("lines", F.lit(0)).alias("n_lines"))
        .agg(F.count(F.lit(1)).alias("n_orders"))
    )


def orders_with_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of which some line was returned, counted and valued by priority."""
    orders = read_table(spark, sf_dir, "orders")
    returned = read_table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
    return (
        having_match(orders, returned, "o_orderkey", "l_orderkey")
        .groupBy("o_orderpriority")
        .agg(F.count(F.lit(1)).alias("n_orders"), *sum_parts(scaled("o_totalprice"), "price"))
        .select("o_orderpriority", "n_orders", total("price").alias("total_price"))
    )


def orders_without_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that have no line at all."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lacking_match(orders, read_table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey")


def _line_totals() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(scaled("l_quantity", 0)).alias("quantity"),
        *sum_parts(_net(), "revenue"),
    ]


def _line_resums() -> list[Column]:
    return [
        F.sum("n_lines").alias("n_lines"),
        F.sum("quantity").alias("quantity"),
        *merge_parts("revenue"),
    ]


def _line_columns() -> list[Column]:
    return [
        F.col(LEVEL),
        F.col("n_lines"),
        F.col("quantity"),
        (F.col("quantity") / F.col("n_lines")).alias("mean_quantity"),
        total("revenue", _NET_DIGITS).alias("revenue"),
    ]


def revenue_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line totals by ship year, return flag and line status, with subtotals."""
    lines = read_table(spark, sf_dir, "lineitem").withColumn("ship_year", _year("l_shipdate"))
    keys = ["ship_year", "l_returnflag", "l_linestatus"]
    return rollup_totals(lines, keys, _line_totals(), _line_resums()).select(*keys, *_line_columns())


def revenue_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line totals for every combination of return flag, status and line number."""
    lines = read_table(spark, sf_dir, "lineitem")
    keys = ["l_returnflag", "l_linestatus", "l_linenumber"]
    return cube_totals(lines, keys, _line_totals(), _line_resums()).select(*keys, *_line_columns())


def revenue_by_part_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line totals by brand, by type and size, and overall.

    Lines are added up per part before the join, as in `with_match_totals`.
    """
    per_part = with_match_totals(
        read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size"),
        read_table(spark, sf_dir, "lineitem"), "p_partkey", "l_partkey", _line_totals(), how="inner",
    )
    keys = ["p_brand", "p_type", "p_size"]
    sets = [["p_brand"], ["p_type", "p_size"], []]
    return grouping_set_totals(per_part, keys, sets, _line_resums(), _line_resums()).select(
        *keys, *_line_columns()
    )


def top_orders_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's three largest orders."""
    orders = read_table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"
    )
    return top_per_group(
        orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3
    ).withColumn("rank", F.col("rank").cast("bigint"))


def _buyers(spark: SparkSession, sf_dir: str, year: int) -> DataFrame:
    """One row per order of the year: the buyer and the order's priority."""
    orders = in_years(read_table(spark, sf_dir, "orders"), "o_orderdate", year, year + 1)
    return orders.select("o_custkey", "o_orderpriority")


def buyers_either_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buyer and priority pairs with an order in 1996 or 1997."""
    return set_union(_buyers(spark, sf_dir, 1996), _buyers(spark, sf_dir, 1997))


def buyers_both_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buyer and priority pairs with an order in 1996 and in 1997."""
    return set_intersect(_buyers(spark, sf_dir, 1996), _buyers(spark, sf_dir, 1997))


def buyers_first_year_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buyer and priority pairs with an order in 1996 but none in 1997."""
    return set_except(_buyers(spark, sf_dir, 1996), _buyers(spark, sf_dir, 1997))


def repeated_buying(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buyer and priority pairs, as often as in the year that has fewer of them."""
    return bag_intersect(_buyers(spark, sf_dir, 1996), _buyers(spark, sf_dir, 1997))


def dropped_buying(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buyer and priority pairs, as often as 1996 has more of them than 1997."""
    return bag_except(_buyers(spark, sf_dir, 1996), _buyers(spark, sf_dir, 1997))


def order_price_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices at given ranks among the orders of each priority, exactly."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderpriority", scaled("o_totalprice").alias("cents"))
    found = quantiles(orders, ["o_orderpriority"], "cents", [0, 10, 250, 500, 750, 990, 1000])
    return found.withColumnRenamed("value", "cents")

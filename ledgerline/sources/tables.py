"""The driver's star tables and the ``sales`` view built from them.

``sales`` has the canonical sales-record shape:
date, product_id, product_name, category, region, store_id, customer_id,
quantity, unit_price, revenue, cost, profit.

Money stays ``decimal(18,2)`` so sums are exact; operators cast to double at the end.
Dimension joins are plain equi joins: Spark sizes each side (file statistics, then AQE
runtime statistics) and broadcasts a side only below the broadcast threshold. The
fact-to-fact join lineitem ⋈ orders is pinned to a sort-merge join on ``orderkey``, whose two
sides spill: without table statistics Spark multiplies size estimates across joins and would
otherwise broadcast lineitem itself at small scale factors, and at any scale both sides grow with
the data. ``orderkey`` has at most a few lines per order, so this join has no hot keys.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SALES_COLUMNS = [
    "date", "product_id", "product_name", "category", "region", "store_id", "customer_id",
    "quantity", "unit_price", "revenue", "cost", "profit",
]
# columns that need the part dimension / the customer->nation->region chain
_PART_COLS = {"product_name", "category"}
_REGION_COLS = {"region"}
_ORDER_COLS = {"date", "customer_id"} | _REGION_COLS

#: Foreign keys of the star: (table, column) -> (table, column) of its partner.
FOREIGN_KEYS = {
    ("lineitem", "l_orderkey"): ("orders", "o_orderkey"),
    ("lineitem", "l_partkey"): ("part", "p_partkey"),
    ("orders", "o_custkey"): ("customer", "c_custkey"),
    ("customer", "c_nationkey"): ("nation", "n_nationkey"),
    ("nation", "n_regionkey"): ("region", "r_regionkey"),
}
ALL_KEYS = frozenset(f"{t}.{c}" for t, c in FOREIGN_KEYS)
_CHAIN_KEYS = frozenset({"orders.o_custkey", "customer.c_nationkey", "nation.n_regionkey"})

# fixed value: invented cost ratio of the fixture mapping (cost = 60 % of list price)
COST_RATIO = "0.6"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sales(
    spark: SparkSession, sf_dir: str, columns: Optional[Iterable[str]] = None, assume_keys: bool = False,
    verified: frozenset[str] = frozenset(),
) -> DataFrame:
    """lineitem ⋈ orders ⋈ customer ⋈ nation ⋈ region ⋈ part as the ``sales`` view.

    ``columns`` names the output columns a query needs. Every query sees the same rows: lines
    whose order, customer, nation, region or part is missing are in none. ``verified`` names the
    foreign keys that are known to hold for these files (``star.verified``); joins that only they
    need and no column does are left out. ``assume_keys`` takes all keys for granted.
    """
    names = ("lineitem", "orders", "customer", "nation", "region", "part")
    keys = ALL_KEYS if assume_keys else verified
    return sales_of({t: table(spark, sf_dir, t) for t in names}, columns, keys)


def sales_of(
    tables: dict[str, DataFrame], columns: Optional[Iterable[str]] = None, keys: frozenset[str] = frozenset(),
    facts_first: bool = False,
) -> DataFrame:
    """The ``sales`` view of some star tables, whose foreign keys ``keys`` hold.

    A dimension chain is joined if a column needs it or one of its keys is not known to hold.
    ``facts_first`` joins lineitem and orders before the dimensions, for tables that are bucketed by order key.
    """
    want = list(columns) if columns is not None else list(SALES_COLUMNS)
    unknown = set(want) - set(SALES_COLUMNS)
    if unknown:
        raise ValueError(f"unknown sales columns: {sorted(unknown)}")
    need = set(want)
    with_region = bool(need & _REGION_COLS) or not _CHAIN_KEYS <= keys
    with_orders = with_region or bool(need & _ORDER_COLS) or "lineitem.l_orderkey" not in keys
    with_part = bool(need & _PART_COLS) or "lineitem.l_partkey" not in keys

    df = tables["lineitem"].select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount"
    )
    orders = tables["orders"].select("o_orderkey", "o_custkey", "o_orderdate")

    def located(rows: DataFrame) -> DataFrame:
        # customer first, then the fixed-size nation and region: joining the dimension chain first
        # would inflate its size estimate (Spark multiplies estimates across joins without
        # statistics) and make Spark broadcast orders instead.
        nation = tables["nation"].select("n_nationkey", "n_regionkey")
        region = tables["region"].select("r_regionkey", "r_name")
        customer = tables["customer"].select("c_custkey", "c_nationkey")
        return (
            rows.join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .drop("c_custkey", "c_nationkey", "n_nationkey", "n_regionkey", "r_regionkey")
        )

    if with_orders:
        if with_region and not facts_first:
            orders = located(orders)
        df = df.join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
        if with_region and facts_first:
            df = located(df)
    if with_part:
        part = tables["part"].select("p_partkey", "p_name", "p_type")
        df = df.join(part, F.col("l_partkey") == F.col("p_partkey"))

    price = F.col("l_extendedprice").cast("decimal(18,2)")
    revenue = F.round(price * (F.lit(1) - F.col("l_discount").cast("decimal(18,2)")), 2).cast("decimal(18,2)")
    cost = F.round(price * F.lit(COST_RATIO).cast("decimal(3,2)"), 2).cast("decimal(18,2)")
    exprs = {
        "date": F.col("o_orderdate").cast("date"),
        "product_id": F.col("l_partkey"),
        "product_name": F.col("p_name") if "product_name" in need else None,
        "category": F.col("p_type") if "category" in need else None,
        "region": F.col("r_name") if "region" in need else None,
        "store_id": F.col("l_suppkey"),
        "customer_id": F.col("o_custkey"),
        "quantity": F.col("l_quantity"),
        "unit_price": F.col("l_extendedprice") / F.col("l_quantity"),
        "revenue": revenue,
        "cost": cost,
        "profit": revenue - cost,
    }
    return df.select(*[exprs[c].alias(c) for c in want])


def sales_oracle_cte() -> str:
    """The same view as SQL text (used by the DuckDB oracle strings)."""
    return f"""sales AS (
  SELECT CAST(o.o_orderdate AS DATE) AS date,
         l.l_partkey AS product_id, p.p_name AS product_name, p.p_type AS category,
         r.r_name AS region, l.l_suppkey AS store_id, o.o_custkey AS customer_id,
         l.l_quantity AS quantity, l.l_extendedprice / l.l_quantity AS unit_price,
         CAST(ROUND(CAST(l.l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l.l_discount AS DECIMAL(18,2))), 2) AS DECIMAL(18,2)) AS revenue,
         CAST(ROUND(CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST({COST_RATIO} AS DECIMAL(3,2)), 2) AS DECIMAL(18,2)) AS cost,
         CAST(ROUND(CAST(l.l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l.l_discount AS DECIMAL(18,2))), 2) AS DECIMAL(18,2))
           - CAST(ROUND(CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST({COST_RATIO} AS DECIMAL(3,2)), 2) AS DECIMAL(18,2)) AS profit
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey)"""


def union_all(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def dirty_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sales extract with the defects cleaning must handle, derived from the star tables.

    Returned items (``l_returnflag = 'R'``) appear twice, as in a doubled export; quantity is
    missing on undiscounted lines and region on untaxed lines. Columns:
    date, product_id, category, region, customer_id, quantity, unit_price, revenue (double).
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    oc = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    df = (
        li.join(oc.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
    )
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    revenue = F.round(price * (F.lit(1) - F.col("l_discount").cast("decimal(18,2)")), 2).cast("decimal(18,2)")
    base = df.select(
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("l_partkey").alias("product_id"),
        F.col("p_type").alias("category"),
        F.when(F.col("l_tax") != 0, F.col("r_name")).alias("region"),
        F.col("o_custkey").alias("customer_id"),
        F.when(F.col("l_discount") != 0, F.col("l_quantity")).alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        revenue.cast("double").alias("revenue"),
        F.col("l_returnflag"),
    )
    # returned lines appear twice: one pass emits 1 or 2 copies per line (no union of two scans)
    copies = F.when(F.col("l_returnflag") == "R", 2).otherwise(1)
    return base.select("*", F.explode(F.array_repeat(F.lit(0), copies)).alias("_copy")).drop("_copy", "l_returnflag")


def dirty_sales_oracle_cte() -> str:
    return """dirty0 AS (
  SELECT CAST(o.o_orderdate AS DATE) AS date, l.l_partkey AS product_id, p.p_type AS category,
         CASE WHEN l.l_tax <> 0 THEN r.r_name END AS region, o.o_custkey AS customer_id,
         CASE WHEN l.l_discount <> 0 THEN l.l_quantity END AS quantity,
         l.l_extendedprice / l.l_quantity AS unit_price,
         CAST(CAST(ROUND(CAST(l.l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l.l_discount AS DECIMAL(18,2))), 2) AS DECIMAL(18,2)) AS DOUBLE) AS revenue,
         l.l_returnflag
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey),
dirty AS (SELECT * EXCLUDE (l_returnflag) FROM dirty0
          UNION ALL SELECT * EXCLUDE (l_returnflag) FROM dirty0 WHERE l_returnflag = 'R')"""

"""Dashboard KPIs and breakdowns.

``dashboard_bundle`` computes every breakdown in ONE scan with grouping sets; the single
breakdown functions are plain ``groupBy`` aggregations for callers that need only one.
All aggregations are partial (map-side) + final hash aggregates, so a hot key costs one
partial row per task, not a skewed shuffle.
"""

from __future__ import annotations

from dataclasses import replace
from typing import Iterable, Optional

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_label
from ..functions.numeric import round_to, safe_ratio
from ..functions.roles import Roles
from ..session import stored
from .series import as_date

# fixed value: profit share assumed when neither profit nor cost is present
FALLBACK_PROFIT_SHARE = 0.2


def _date(df: DataFrame, roles: Roles) -> Column:
    """The date role as DATE (strings by the layout found for the column; failures are NULL)."""
    return as_date(df, roles.date)


def _sum(c: Column) -> Column:
    return F.sum(c).cast("double")


def profit_expr(roles: Roles) -> Column:
    """Profit per row: profit column, else revenue - cost, else a fixed share of revenue (Q10)."""
    if roles.profit:
        return F.col(roles.profit)
    if roles.revenue and roles.cost:
        return F.col(roles.revenue) - F.col(roles.cost)
    return F.col(roles.revenue) * F.lit(FALLBACK_PROFIT_SHARE)


def kpi_totals(df: DataFrame, roles: Roles) -> DataFrame:
    """Revenue, profit, row count, average order value and margin."""
    agg = df.agg(
        F.coalesce(_sum(F.col(roles.revenue)), F.lit(0.0)).alias("rev"),
        F.coalesce(_sum(profit_expr(roles)), F.lit(0.0)).alias("prof"),
        F.count(F.lit(1)).alias("total_orders"),
    )
    return kpi_figures(agg)


def kpi_figures(agg: DataFrame) -> DataFrame:
    """The five key figures of a (rev, prof, total_orders) row."""
    return agg.select(
        round_to("rev", 2).alias("total_revenue"),
        round_to("prof", 2).alias("total_profit"),
        F.col("total_orders").cast("bigint").alias("total_orders"),
        round_to(safe_ratio("rev", "total_orders"), 2).alias("average_order_value"),
        round_to(safe_ratio(F.col("prof") * 100, "rev"), 2).alias("profit_margin"),
    )


def monthly_revenue(df: DataFrame, roles: Roles) -> DataFrame:
    """Revenue per calendar month with data, label yyyy-MM (D2, no gap fill)."""
    d = _date(df, roles)
    return (
        df.where(d.isNotNull())
        .groupBy(month_label(d).alias("month"))
        .agg(_sum(F.col(roles.revenue)).alias("revenue"))
        .orderBy("month")
    )


def yearly_revenue(df: DataFrame, roles: Roles) -> DataFrame:
    d = _date(df, roles)
    return (
        df.where(d.isNotNull())
        .groupBy(F.year(d).cast("bigint").alias("year"))
        .agg(_sum(F.col(roles.revenue)).alias("revenue"))
        .orderBy("year")
    )


def revenue_by(df: DataFrame, key: str, value: str, out_key: str) -> DataFrame:
    """Sum of ``value`` per non-null ``key``."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_k"))
        .agg(_sum(F.col(value)).alias("revenue"))
        .select(F.col("_k").alias(out_key), "revenue")
    )


def _ranked(df: DataFrame, key: str, ascending: bool, n: int) -> DataFrame:
    order = [F.col("revenue").asc() if ascending else F.col("revenue").desc(), F.col("_k").asc()]
    top = df.orderBy(*order).limit(n)  # TakeOrderedAndProject: n rows per task, merged
    w = Window.orderBy(*order)  # over at most n rows
    return top.select(
        F.col("_k").cast("string").alias(key),
        "revenue",
        F.row_number().over(w).cast("bigint").alias("rank"),
    )


def ranked_products(bundle: DataFrame, n: int, best: bool) -> DataFrame:
    """n best or weakest products from the bundle's product rows (key, revenue)."""
    return _ranked(bundle.select(F.col("key").alias("_k"), "revenue"), "product", not best, n)


def top_products(df: DataFrame, roles: Roles, n: int = 10) -> DataFrame:
    """n best products by revenue, ties by product key (F1)."""
    return _ranked(revenue_by(df, roles.product, roles.revenue, "_k"), "product", False, n)


def low_performers(df: DataFrame, roles: Roles, n: int = 5) -> DataFrame:
    """n weakest products by revenue, ties by product key (F2)."""
    return _ranked(revenue_by(df, roles.product, roles.revenue, "_k"), "product", True, n)


def regional_breakdown(df: DataFrame, roles: Roles) -> DataFrame:
    """Revenue by region, revenue descending."""
    r = revenue_by(df, roles.region, roles.revenue, "region")
    return r.select(F.col("region").cast("string").alias("region"), "revenue").orderBy(
        F.col("revenue").desc(), "region"
    )


def category_breakdown(df: DataFrame, roles: Roles) -> DataFrame:
    """Revenue by category, in key order."""
    r = revenue_by(df, roles.category, roles.revenue, "category")
    return r.select(F.col("category").cast("string").alias("category"), "revenue").orderBy("category")


def revenue_growth(df: DataFrame, roles: Roles) -> DataFrame:
    """Last month with data vs the month before, in % (E9); 0 when undefined.

    The monthly table is bounded by the calendar, so its global window is cheap; the final
    global aggregate always returns exactly one row, also for an empty input.
    """
    return growth_of_months(monthly_revenue(df, roles))


def growth_of_months(m: DataFrame) -> DataFrame:
    """Growth in % from (month, revenue) rows."""
    w = Window.orderBy("month")
    wd = Window.orderBy(F.col("month").desc())
    m2 = m.select(
        F.col("revenue").alias("curr"),
        F.lag("revenue", 1).over(w).alias("prev"),
        F.row_number().over(wd).alias("rn"),
    )
    agg = m2.agg(
        F.max(F.when(F.col("rn") == 1, F.col("curr"))).alias("curr"),
        F.max(F.when(F.col("rn") == 1, F.col("prev"))).alias("prev"),
        F.count(F.lit(1)).alias("n_months"),
    )
    g = F.when((F.col("n_months") >= 2) & (F.col("prev") != 0), (F.col("curr") - F.col("prev")) / F.col("prev") * 100)
    return agg.select(round_to(F.coalesce(g, F.lit(0.0)), 2).alias("revenue_growth"))


def last_n_months(df: DataFrame, roles: Roles, n: int = 12) -> DataFrame:
    """The final n months of D2, ascending."""
    return monthly_revenue(df, roles).orderBy(F.col("month").desc()).limit(n).orderBy("month")


# ---- one-pass bundle ----------------------------------------------------------------------

_DIMS = ["month", "year", "product", "region", "category"]


def dashboard_bundle(df: DataFrame, roles: Roles) -> DataFrame:
    """All breakdowns in one grouping-sets aggregation.

    Output: dim ('total','month','year','product','region','category'), key (string),
    revenue, profit (double), n_rows (bigint). The input is projected to the 7 needed
    columns first so the x6 grouping-set expansion stays narrow, and partial aggregation
    runs before the shuffle.
    """
    d = _date(df, roles)
    key_cols = {
        "month": month_label(d),
        "year": F.year(d).cast("string"),
        "product": F.col(roles.product).cast("string") if roles.product else None,
        "region": F.col(roles.region).cast("string") if roles.region else None,
        "category": F.col(roles.category).cast("string") if roles.category else None,
    }
    dims = [k for k in _DIMS if key_cols[k] is not None]
    proj = df.select(
        *[key_cols[k].alias(k) for k in dims],
        F.col(roles.revenue).alias("_rev"),
        profit_expr(roles).alias("_prof"),
    )
    sets = [[]] + [[k] for k in dims]
    agg = proj.groupingSets(sets, *dims).agg(
        _sum(F.col("_rev")).alias("revenue"),
        _sum(F.col("_prof")).alias("profit"),
        F.count(F.lit(1)).cast("bigint").alias("n_rows"),
        *[F.grouping(k).alias(f"_g_{k}") for k in dims],
    )
    dim = F.lit("total")
    key = F.lit(None).cast("string")
    for k in dims:
        dim = F.when(F.col(f"_g_{k}") == 0, F.lit(k)).otherwise(dim)
        key = F.when(F.col(f"_g_{k}") == 0, F.col(k)).otherwise(key)
    out = agg.select(dim.alias("dim"), key.alias("key"), "revenue", "profit", "n_rows")
    # a NULL key inside its own set is a row with a missing value: pandas drops those groups
    return out.where((F.col("dim") == "total") | F.col("key").isNotNull())


def filter_sales(
    df: DataFrame,
    roles: Roles,
    start: Optional[str] = None,
    end: Optional[str] = None,
    categories: Optional[Iterable[str]] = None,
    regions: Optional[Iterable[str]] = None,
    stores: Optional[Iterable] = None,
    products: Optional[Iterable] = None,
    store_col: str = "store_id",
) -> DataFrame:
    """Conjunctive optional filter (B9); Catalyst pushes it to the Parquet scan."""
    cond = F.lit(True)
    d = _date(df, roles)
    if start is not None:
        cond = cond & (d >= F.to_date(F.lit(start)))
    if end is not None:
        cond = cond & (d <= F.to_date(F.lit(end)))
    if categories is not None:
        cond = cond & F.col(roles.category).isin(list(categories))
    if regions is not None:
        cond = cond & F.col(roles.region).isin(list(regions))
    if stores is not None:
        cond = cond & F.col(store_col).isin(list(stores))
    if products is not None:
        cond = cond & F.col(roles.product).isin(list(products))
    return df.where(cond)


def report_rows(df: DataFrame, roles: Roles, top_n: int = 10) -> DataFrame:
    """KPI lines then the top products, as (line, label, value) rows."""
    labels = [
        ("Total Revenue", "total_revenue"),
        ("Total Profit", "total_profit"),
        ("Total Orders", "total_orders"),
        ("Average Order Value", "average_order_value"),
        ("Profit Margin %", "profit_margin"),
    ]
    stack = ", ".join(f"{i + 1}L, '{lab}', cast({col} as double)" for i, (lab, col) in enumerate(labels))
    # one aggregation for every line
    bundle = stored(dashboard_bundle(df, replace(roles, region=None, category=None)))
    total = bundle.where("dim = 'total'").select(
        F.coalesce("revenue", F.lit(0.0)).alias("rev"), F.coalesce("profit", F.lit(0.0)).alias("prof"), F.col("n_rows").alias("total_orders")
    )
    kpis = kpi_figures(total).selectExpr(f"stack({len(labels)}, {stack}) as (line, label, value)")
    growth = growth_of_months(bundle.where("dim = 'month'").select(F.col("key").alias("month"), "revenue")).select(
        F.lit(6).cast("bigint").alias("line"), F.lit("Revenue Growth %").alias("label"), F.col("revenue_growth").alias("value")
    )
    kpis = kpis.unionByName(growth).withColumn("section", F.lit("kpi"))
    prods = ranked_products(bundle.where("dim = 'product'"), top_n, best=True).select(
        F.lit("top_products").alias("section"),
        F.col("product").alias("label"),
        F.col("revenue").alias("value"),
        (F.col("rank") + 6).cast("bigint").alias("line"),
    )
    return kpis.unionByName(prods).select("line", "section", "label", "value").orderBy("line")

"""Inventory reorder recommendations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import round_to
from ..session import stored
from .series import as_date

# ---- fixed values: inventory policy of the original application ---------------------------------
WINDOW_DAYS = 90
SAFETY_DAYS = 7
SERVICE_Z = 1.65
LEAD_DAYS = 14
ORDER_DAYS = 30
SINGLE_ROW_STD_SHARE = 0.2
ALERT_REORDER, ALERT_LOW = "REORDER NOW", "LOW DEMAND"
# ----------------------------------------------------------------------------------------------------


def recent_window(df: DataFrame, date_col: str, days: int = WINDOW_DAYS) -> DataFrame:
    """Rows on or after max(date) - ``days`` (B8); the max is a scalar subquery."""
    dt = df.schema[date_col].dataType.simpleString()
    d = F.col(date_col) if dt.startswith("timestamp") else as_date(df, date_col)
    mx = df.select(F.max(d)).scalar()
    lower = mx - F.expr(f"INTERVAL {int(days)} DAYS") if dt.startswith("timestamp") else F.date_sub(mx, int(days))
    return df.where(d >= lower)


def recommendations(df: DataFrame, date_col: str, product_col: str, quantity_col: str) -> DataFrame:
    """Per product in the recent window: demand, safety stock, reorder point, order qty, alert."""
    day = F.col(date_col) if df.schema[date_col].dataType.simpleString().startswith("timestamp") else as_date(df, date_col)
    q = F.nanvl(F.col(quantity_col).cast("double"), F.lit(None).cast("double"))
    moments = stored(
        df.groupBy(F.col(product_col).alias("_p"), day.alias("_d"))
        .agg(F.sum(q).alias("_s"), F.sum(q * q).alias("_ss"), F.count(q).alias("_n"), F.count(F.lit(1)).alias("_rows"))
    )  # one pass over the rows; the window is applied to this small table
    recent = recent_window(moments, "_d").where(F.col("_p").isNotNull())
    g = recent.groupBy("_p").agg(
        F.coalesce(F.sum("_s"), F.lit(0.0)).alias("_qty"),
        F.sum("_rows").alias("_rows"),
        F.sqrt(F.greatest(F.lit(0.0), F.try_divide(
            F.sum("_ss") - F.sum("_s") * F.sum("_s") / F.sum("_n"), F.sum("_n") - 1
        ))).alias("_sd"),
    )
    daily = F.col("_qty") / WINDOW_DAYS
    std = F.when(F.col("_rows") > 1, F.col("_sd")).otherwise(daily * SINGLE_ROW_STD_SHARE)
    safety = daily * SAFETY_DAYS + SERVICE_Z * std * math.sqrt(SAFETY_DAYS)
    reorder = daily * LEAD_DAYS + safety
    order = daily * ORDER_DAYS
    alert = F.when((daily > 0) & (order > 0), ALERT_REORDER).otherwise(ALERT_LOW)
    return g.select(
        F.col("_p").alias("_key"),
        F.col("_p").cast("string").alias("product"),
        round_to(daily, 2).alias("daily_avg_demand"),
        round_to(safety, 0).alias("safety_stock"),
        round_to(reorder, 0).alias("reorder_point"),
        round_to(order, 0).alias("recommended_order_qty"),
        alert.alias("alert"),
    )


def top_recommendations(recs: DataFrame, n: int = 20) -> DataFrame:
    """The n products with the highest rounded daily demand, ties by product key."""
    order = [F.col("daily_avg_demand").desc(), F.col("_key").asc()]
    top = recs.orderBy(*order).limit(n)
    return top.select(F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("rank"), *[c for c in recs.columns if c != "_key"])


def alert_counts(top: DataFrame) -> DataFrame:
    """Products, reorder alerts and low-demand alerts over the shown list."""
    return top.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_products"),
        F.count_if(F.col("alert") == ALERT_REORDER).cast("bigint").alias("reorder_alerts"),
        F.count_if(F.col("alert") == ALERT_LOW).cast("bigint").alias("low_demand"),
    )

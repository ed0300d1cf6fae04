"""Seasonality profiles and peaks.

All profiles run on gap-filled rollups, which hold one row per period per series, so their
aggregations are small whatever the size of the sales table.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import day_abbr, day_name
from ..functions.numeric import round_to
from .series import rollup


def month_profile(df: DataFrame, date_col: str, target_col: str, series_cols: Sequence[str] = ()) -> DataFrame:
    """Mean of zero-filled month totals per month number."""
    m = rollup(df, date_col, target_col, "M", series_cols)
    return m.groupBy(*series_cols, F.month("ds").alias("month")).agg(F.avg("y").alias("avg_value"))


def weekday_profile(
    df: DataFrame, date_col: str, target_col: str, source: str = "daily", series_cols: Sequence[str] = ()
) -> DataFrame:
    """Mean per weekday, Mon..Sun.

    ``source="daily"`` averages daily totals; ``source="weekly"`` reproduces the original
    application, which averages weekly totals whose labels are all Sundays (Q1).
    """
    freq = {"daily": "D", "weekly": "W"}[source]
    ts = rollup(df, date_col, target_col, freq, series_cols)
    return ts.groupBy(*series_cols, F.weekday("ds").alias("dow"), day_abbr("ds").alias("day")).agg(
        F.avg("y").alias("avg_value")
    )


def weekday_name_means(df: DataFrame, date_col: str, target_col: str, series_cols: Sequence[str] = ()) -> DataFrame:
    """Daily mean per full weekday name."""
    ts = rollup(df, date_col, target_col, "D", series_cols)
    return ts.groupBy(*series_cols, day_name("ds").alias("day_name")).agg(F.avg("y").alias("avg_value"))


def arg_best(profile: DataFrame, key: str, value: str, series_cols: Sequence[str] = (), lowest: bool = False) -> DataFrame:
    """Key with the largest (or smallest) value per series; ties go to the smallest key."""
    order = F.col(value).asc() if lowest else F.col(value).desc()
    w = Window.partitionBy(*series_cols).orderBy(order, F.col(key).asc())
    return profile.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def peak_periods(df: DataFrame, date_col: str, target_col: str, source: str = "daily") -> DataFrame:
    """Peak month number and peak weekday of one series (F6), as one row."""
    pm = arg_best(month_profile(df, date_col, target_col), "month", "avg_value").select(
        F.col("month").alias("peak_month"), F.lit(None).cast("string").alias("peak_day")
    )
    pd_ = arg_best(weekday_profile(df, date_col, target_col, source), "dow", "avg_value").select(
        F.lit(None).cast("int").alias("peak_month"), F.col("day").alias("peak_day")
    )
    # two one-row results folded into one row (a global aggregate always yields one row)
    return pm.unionByName(pd_).agg(F.max("peak_month").alias("peak_month"), F.max("peak_day").alias("peak_day"))


def rounded(profile: DataFrame, value: str = "avg_value", digits: int = 2) -> DataFrame:
    return profile.withColumn(value, round_to(value, digits))


def as_map(profile: DataFrame, key: str, value: str, series_cols: Sequence[str] = ()) -> DataFrame:
    """Name -> value map per series (H19); profiles hold at most 12 or 7 keys per series."""
    return profile.groupBy(*series_cols).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key).cast("string"), F.col(value))))).alias("values")
    )

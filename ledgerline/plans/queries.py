"""Registered Spark queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the driver's whole tables (through the ``sales`` view or directly) and
returns flat columns whose names and types equal the oracle SQL in ``oracles.py``.
"""

from __future__ import annotations

import uuid as _uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import round_to
from ..operators import anomalies as anom
from ..operators import clean as cln
from ..operators import customers as cust
from ..operators import dashboard as dash
from ..operators import insights as ins
from ..operators import inventory as inv
from ..operators import profile as prof
from ..operators import seasonal as sea
from ..operators import series as ser
from ..operators.forecast import arima, boosting, gram, trend
from ..operators.forecast import compare as cmp
from ..operators.forecast import metrics as met
from ..operators.forecast import models as fc
from ..operators.forecast.core import with_future
from ..sources import registry as reg
from ..sources import star
from ..sources.csv import read_csv
from ..session import ensure_checkpoint_dir
from ..sources.tables import SALES_COLUMNS, dirty_sales, table
from .common import ROLES, S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


_DASH_COLS = ["date", "product_id", "region", "category", "revenue", "profit"]

# ---- star ---------------------------------------------------------------------------------


@register
def star_keys(spark, d):
    """Foreign keys of the star tables; those that hold are registered for these files."""
    return star.verify(spark, d)


@register
def bucketed_monthly_regions(spark, d):
    """Monthly revenue per region from an ingested, bucketed star."""
    s = star.ingest(spark, d, scratch_store(spark), 16).sales(["date", "region", "revenue"])
    month = F.date_format("date", "yyyy-MM")
    return s.groupBy(month.alias("month"), "region").agg(F.sum("revenue").cast("double").alias("revenue"))


# ---- dashboard ----------------------------------------------------------------------------


@register
def kpi_totals(spark, d):
    return dash.kpi_totals(S(spark, d, ["revenue", "profit"]), ROLES)


@register
def monthly_revenue(spark, d):
    return dash.monthly_revenue(S(spark, d, ["date", "revenue"]), ROLES)


@register
def yearly_revenue(spark, d):
    return dash.yearly_revenue(S(spark, d, ["date", "revenue"]), ROLES)


@register
def top_products(spark, d):
    return dash.top_products(S(spark, d, ["product_id", "revenue"]), ROLES, 10)


@register
def low_performers(spark, d):
    return dash.low_performers(S(spark, d, ["product_id", "revenue"]), ROLES, 5)


@register
def regional_breakdown(spark, d):
    return dash.regional_breakdown(S(spark, d, ["region", "revenue"]), ROLES)


@register
def category_breakdown(spark, d):
    return dash.category_breakdown(S(spark, d, ["category", "revenue"]), ROLES)


@register
def dashboard_bundle(spark, d):
    return dash.dashboard_bundle(S(spark, d, _DASH_COLS), ROLES)


@register
def sales_filter(spark, d):
    cols = ["date", "product_id", "category", "region", "customer_id", "quantity", "revenue"]
    f = dash.filter_sales(
        S(spark, d, cols), ROLES, start="1997-01-01", end="1998-12-31",
        regions=["ASIA", "EUROPE"], categories=["ECONOMY", "STANDARD", "SMALL"],
    )
    return f.select(*[F.col(c).cast("double").alias(c) if c == "revenue" else F.col(c) for c in cols])


@register
def last_12_months(spark, d):
    return dash.last_n_months(S(spark, d, ["date", "revenue"]), ROLES, 12)


@register
def revenue_growth(spark, d):
    return dash.revenue_growth(S(spark, d, ["date", "revenue"]), ROLES)


@register
def report_rows(spark, d):
    return dash.report_rows(S(spark, d, ["product_id", "date", "revenue", "profit"]), ROLES, 10)

# ---- series ---------------------------------------------------------------------------------



def daily(spark, d, series_cols=(), exact=False):
    cols = ["date", "revenue", *series_cols]
    return ser.rollup(S(spark, d, cols), "date", "revenue", "D", series_cols, keep_decimal=exact)


def _r(df, cols, digits):
    return df.select(*[round_to(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


@register
def daily_series(spark, d):
    return daily(spark, d)


@register
def daily_series_by_region(spark, d):
    return daily(spark, d, ["region"])


@register
def weekly_series(spark, d):
    return ser.rollup(S(spark, d, ["date", "revenue"]), "date", "revenue", "W")


@register
def monthly_series(spark, d):
    return ser.rollup(S(spark, d, ["date", "revenue"]), "date", "revenue", "M")


_TRIG = ["month_sin", "month_cos", "dow_sin", "dow_cos"]
_ROLL = [f"rolling_{k}_{n}" for n in (7, 14, 30) for k in ("mean", "std")]


@register
def calendar_features(spark, d):
    return _r(ser.with_calendar(daily(spark, d)), _TRIG, 6)


@register
def lag_features(spark, d):
    return _r(ser.with_lags(daily(spark, d, exact=True)), _ROLL, 2)


@register
def feature_table(spark, d):
    return _r(_r(ser.feature_table(daily(spark, d, exact=True)), _TRIG, 6), _ROLL, 2)


@register
def chrono_split(spark, d):
    return ser.chrono_split(daily(spark, d))


@register
def sequence_windows(spark, d):
    return ser.sequence_windows(daily(spark, d), (), 30)


@register
def scaled_series(spark, d):
    z = ser.zscore(daily(spark, d))
    return _r(z, ["y_mean", "y_std"], 2).withColumn("y_scaled", round_to("y_scaled", 6))


# ---- seasonality and insights ------------------------------------------------------------------


@register
def month_profile(spark, d):
    return sea.rounded(sea.month_profile(S(spark, d, ["date", "revenue"]), "date", "revenue"))


@register
def weekday_profile(spark, d):
    return sea.rounded(sea.weekday_profile(S(spark, d, ["date", "revenue"]), "date", "revenue", "daily"))


@register
def weekday_profile_weekly(spark, d):
    return sea.rounded(sea.weekday_profile(S(spark, d, ["date", "revenue"]), "date", "revenue", "weekly"))


@register
def weekday_names(spark, d):
    return sea.rounded(sea.weekday_name_means(S(spark, d, ["date", "revenue"]), "date", "revenue"))


@register
def peak_periods(spark, d):
    return sea.peak_periods(S(spark, d, ["date", "revenue"]), "date", "revenue")


def _naive_points(spark, d):
    return met.seasonal_naive_points(daily(spark, d), (), 7, 0.8)


def _sig(df, cols, digits=10):
    """Round to significant digits (exploding MAPE values are ~1e13)."""
    return df.select(*[F.format_string(f"%.{digits - 1}e", F.col(c)).cast("double").alias(c) if c in cols else F.col(c) for c in df.columns])


@register
def forecast_metrics(spark, d):
    return _sig(met.evaluate(_naive_points(spark, d)), ["mae", "rmse", "r2", "mape"])


@register
def insights(spark, d):
    ts = daily(spark, d)
    return ins.insights_from_daily(ts, met.evaluate(met.seasonal_naive_points(ts, (), 7, 0.8)))

# ---- customers and inventory ---------------------------------------------------------------------



def _rfm_base(spark, d):
    return cust.rfm_base(S(spark, d, ["date", "customer_id", "revenue"]), "date", ROLES.customer, ROLES.revenue)


@register
def rfm_base(spark, d):
    return _rfm_base(spark, d).withColumnRenamed("customer", "customer_id")


@register
def rfm_scores(spark, d):
    return cust.rfm_scores(_rfm_base(spark, d)).withColumnRenamed("customer", "customer_id")


@register
def rfm_segments(spark, d):
    return cust.segment_counts(cust.rfm_scores(_rfm_base(spark, d)))


@register
def rfm_summary(spark, d):
    return cust.rfm_summary(_rfm_base(spark, d))


@register
def rfm_share(spark, d):
    return cust.segment_share(cust.rfm_scores(_rfm_base(spark, d)))


def _recs(spark, d):
    return inv.recommendations(S(spark, d, ["date", "product_id", "quantity"]), "date", ROLES.product, ROLES.quantity)


@register
def inventory_recommendations(spark, d):
    return inv.top_recommendations(_recs(spark, d), 20)


@register
def inventory_all_products(spark, d):
    return _recs(spark, d).drop("_key")


@register
def inventory_alert_counts(spark, d):
    return inv.alert_counts(inv.top_recommendations(_recs(spark, d), 20))

# ---- dates, cleaning, profile ------------------------------------------------------------------------



def _order_dates(spark, d, raw: "F.Column"):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", raw.alias("raw"))


@register
def parse_dates(spark, d):
    df = _order_dates(spark, d, F.date_format("o_orderdate", "MM/dd/yyyy"))
    return cln.parse_dates(df, "raw", "parsed")


@register
def parse_dates_mixed(spark, d):
    od = F.col("o_orderdate")
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.date_format(od, "MMMM d, yyyy")).otherwise(F.date_format(od, "yyyy-MM-dd"))
    return cln.parse_dates(_order_dates(spark, d, raw), "raw", "parsed")


@register
def coerce_dates(spark, d):
    raw = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("n/a")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return cln.coerce_dates(_order_dates(spark, d, raw), "raw", "yyyy-M-d", "parsed")


_DIRTY_DOUBLES = ["product_id", "customer_id", "quantity", "unit_price", "revenue"]


@register
def dedupe(spark, d):
    return cln.dedupe(dirty_sales(spark, d))


@register
def impute_median(spark, d):
    return _r(cln.clean(dirty_sales(spark, d)).imputed, _DIRTY_DOUBLES, 6)


@register
def fill_unknown(spark, d):
    return _r(cln.clean(dirty_sales(spark, d)).filled, _DIRTY_DOUBLES, 6)


@register
def cap_outliers(spark, d):
    return _r(cln.clean(dirty_sales(spark, d)).cleaned, _DIRTY_DOUBLES, 6)


@register
def cleaning_report(spark, d):
    return cln.clean(dirty_sales(spark, d)).report


@register
def numeric_profile(spark, d):
    return _r(prof.numeric_profile(dirty_sales(spark, d)), ["mean", "median", "std", "min", "max"], 4)


@register
def categorical_top_values(spark, d):
    """Most frequent values of the text columns, found by sketches and counted exactly."""
    return prof.categorical_sketch(dirty_sales(spark, d)).drop("unique_count")


@register
def categorical_profile(spark, d):
    return prof.categorical_profile(dirty_sales(spark, d))


@register
def missing_counts(spark, d):
    return prof.missing_counts(dirty_sales(spark, d))


@register
def dataset_shape(spark, d):
    return prof.shape(dirty_sales(spark, d))


@register
def date_range(spark, d):
    return prof.date_range(S(spark, d, ["date"]), "date")


@register
def target_stats(spark, d):
    return _r(prof.target_stats(S(spark, d, ["revenue"]), "revenue"), ["total", "mean", "max", "min"], 2)

# ---- forecasting (rows-only checks: model fits have no SQL twin) ----------------------------------------



@register
def ridge_forecast(spark, d):
    return fc.ridge_forecast(daily(spark, d), (), 30).points


@register
def ridge_forecast_by_region(spark, d):
    return fc.ridge_forecast(daily(spark, d, ["region"]), ["region"], 30).points


@register
def ridge_metrics(spark, d):
    return fc.ridge_forecast(daily(spark, d), (), 30).metrics


@register
def ridge_importances(spark, d):
    return fc.ridge_forecast(daily(spark, d), (), 30).importances


@register
def feature_correlations(spark, d):
    """Correlations of all features and the target, from sums of products."""
    found = gram.correlations(gram.gram_sums(feature_table(spark, d)))
    return found.select("a", "b", round_to("correlation", 6).alias("correlation"))


@register
def ridge_coefficients_by_region(spark, d):
    """Ridge on the training days of each region, solved from sums of products."""
    ft = ser.chrono_split(ser.feature_table(daily(spark, d, ["region"]), ["region"]), ["region"])
    return gram.ridge_coefficients(ft.where("is_train"), ["region"])


@register
def trend_forecast(spark, d):
    return trend.trend_forecast(daily(spark, d), (), 30).points


@register
def sequence_forecast(spark, d):
    return fc.sequence_forecast(daily(spark, d), (), 30).points


@register
def arima_forecast(spark, d):
    return arima.arima_forecast(daily(spark, d), (), 30).points



@register
def gbt_forecast(spark, d):
    return boosting.boosted_forecast(daily(spark, d), (), 30).points


@register
def detect_anomalies(spark, d):
    return anom.detect_anomalies(daily(spark, d))


@register
def anomalies_only(spark, d):
    return anom.anomalies_only(anom.detect_anomalies(daily(spark, d)))


@register
def anomalous_lines_by_region(spark, d):
    """Order lines of unusual revenue per region: a forest over single lines, not daily totals."""
    found = anom.transaction_anomalies(S(spark, d, ["date", "region", "revenue"]), "date", "revenue", ["region"])
    return anom.anomaly_counts(found, ["region"])


@register
def anomalies_by_region(spark, d):
    return anom.anomaly_counts(anom.detect_anomalies(daily(spark, d, ["region"]), ["region"]), ["region"])



@register
def gbt_forecast_by_region(spark, d):
    return boosting.boosted_forecast(daily(spark, d, ["region"]), ["region"], 30).points


@register
def compare_models(spark, d):
    return cmp.compare_models(daily(spark, d), horizon=30)


# ---- sources and sinks -------------------------------------------------------------------------------------




def scratch_store(spark) -> str:
    """A fresh store for one query, in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/store-{_uuid.uuid4().hex[:12]}"


@register
def dataset_registry(spark, d):
    root = scratch_store(spark)
    row = reg.ingest(spark, S(spark, d, SALES_COLUMNS), "sales", "sales.parquet", root)
    return reg.list_datasets(spark, root).where(F.col("id") == row["id"]).select(
        "name", "row_count", "column_count", "date_start", "date_end")


@register
def csv_roundtrip(spark, d):
    path = f"{scratch_store(spark)}/csv"
    dirty_sales(spark, d).write.option("header", True).csv(path)
    return read_csv(spark, path)


@register
def forecast_store_roundtrip(spark, d):
    job = _uuid.uuid4().hex[:12]
    res = fc.ridge_forecast(daily(spark, d), (), 30)
    root = scratch_store(spark)
    reg.write_forecast(res.points, job, root)
    reg.record_run(spark, {"job_id": job, "model_type": "linear", "status": "completed", "horizon": 30}, root)
    return reg.read_forecast(spark, job, root).drop("job_id")


@register
def recent_sales(spark, d):
    cols = ["date", "product_id", "customer_id", "quantity", "revenue"]
    r = inv.recent_window(S(spark, d, cols), "date", 90)
    return r.select(*[F.col(c).cast("double").alias(c) if c == "revenue" else F.col(c) for c in cols])


# ---- dates with times, other layouts, missing numbers ------------------------------------------------------


@register
def parse_datetimes(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("t"))
    text = F.date_format(F.timestamp_seconds(F.unix_timestamp("t") + F.col("o_orderkey") % 86400), "yyyy-MM-dd HH:mm:ss")
    parsed = cln.parse_dates(o.select("o_orderkey", text.alias("at")), "at", keep_time=True)
    return parsed.select("o_orderkey", F.unix_timestamp("at").alias("seconds"))


@register
def coerce_dates_inferred(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "MMMM d, yyyy").alias("day"))
    return cln.coerce_dates(o.withColumn("day", F.when(F.col("o_orderkey") % 7 != 0, F.col("day")).otherwise("none")), "day")


@register
def summary_us_dates(spark, d):
    s = S(spark, d, ["date", "revenue"])
    return prof.date_range(s.withColumn("date", F.date_format("date", "MM/dd/yyyy")), "date")


@register
def clean_nan(spark, d):
    s = dirty_sales(spark, d)
    return cln.clean(s.withColumn("quantity", F.coalesce(F.col("quantity").cast("double"), F.lit(float("nan"))))).report


@register
def rfm_timestamps(spark, d):
    s = S(spark, d, ["date", "customer_id", "revenue"])
    at = F.timestamp_seconds(F.unix_timestamp(F.col("date").cast("timestamp")) + F.pmod("customer_id", F.lit(24)) * 3600)
    return cust.rfm_base(s.withColumn("date", at), "date", "customer_id", "revenue")


@register
def forecast_frame(spark, d):
    ts = with_future(daily(spark, d, ["region"]), ["region"], 30)
    days = ser.chrono_split(ts.where(~F.col("is_future")), ["region"]).select("region", "ds", "is_train")
    return ts.join(days, ["region", "ds"], "left").select("region", "ds", "y", "is_future", "is_train")


@register
def weekly_series_by_region(spark, d):
    return ser.rollup(S(spark, d, ["date", "region", "revenue"]), "date", "revenue", "W", ["region"])


@register
def monthly_series_by_region(spark, d):
    return ser.rollup(S(spark, d, ["date", "region", "revenue"]), "date", "revenue", "M", ["region"])

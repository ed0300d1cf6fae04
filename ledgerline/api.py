"""One call per analysis, on any sales table: roles are resolved from the schema.

These mirror the original application's per-dataset calls (columns, summary, dashboard,
inventory, customers, seasonal, anomalies, train, compare) and compose the operators; every
result is a DataFrame (or a dict of them) computed by Spark.
"""

from __future__ import annotations

from typing import Optional, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.numeric import round_to, safe_ratio
from .functions.roles import Roles, columns_by_role, default_date_col, default_target_col, detect_column_types, require_column
from .operators import anomalies as anom
from .operators import clean as cln
from .operators import customers as cust
from .operators import dashboard as dash
from .operators import inventory as inv
from .operators import profile as prof
from .operators import seasonal as sea
from .operators.forecast import compare as cmp
from .operators.forecast.grouped import ForecastResult
from .operators.forecast.metrics import evaluate
from .operators.insights import insights_from_daily
from .operators.series import rollup
from .session import stored


def columns(df: DataFrame) -> dict:
    """Role per column and the numeric / date / categorical lists."""
    roles = detect_column_types(df.schema)
    return {"roles": roles, **columns_by_role(roles)}


def _date(df: DataFrame, date_col: Optional[str]) -> str:
    return date_col or default_date_col(detect_column_types(df.schema))


def _dated(df: DataFrame, date_col: str, drop_invalid: bool) -> DataFrame:
    """String dates parsed with the layout found for the column (B5); times are kept."""
    return cln.parse_dates(df, date_col, drop_invalid=drop_invalid, keep_time=True)


def summary(df: DataFrame, date_col: Optional[str] = None, target_col: Optional[str] = None) -> dict:
    """Columns and types, shape, missing counts, numeric and categorical profiles, date range, target
    stats (D17-D21)."""
    roles = detect_column_types(df.schema)
    out = {
        "columns": df.columns,
        "dtypes": dict(prof.dtypes(df)),
        "shape": prof.shape(df),
        "missing_values": prof.missing_counts(df),
        "numeric_stats": prof.numeric_profile(df),
        "categorical_stats": prof.categorical_profile(df),
    }
    date_col = date_col or next((c for c, r in roles.items() if r == "date"), None)
    if date_col:
        out["date_range"] = prof.date_range(df, date_col)
    target_col = target_col or default_target_col(roles)
    if target_col and target_col in df.columns:
        out["target_stats"] = prof.target_stats(df, target_col)
    return out


def dashboard(df: DataFrame, date_col: Optional[str] = None, clean_first: bool = True) -> dict[str, DataFrame]:
    """KPIs, growth and every breakdown, from one grouping-sets aggregation.

    As in the original dashboard the table is cleaned first (``clean_first``); rows whose date
    does not parse count in the totals but in no month or year.
    """
    date_col = _date(df, date_col)
    base = cln.clean(df).cleaned if clean_first else df
    base = _dated(base, date_col, drop_invalid=False)
    roles = Roles.resolve(base.schema, date=date_col)
    if not roles.revenue:  # as in the original: every figure 0, every list empty
        return _empty_dashboard(base)
    bundle = stored(dash.dashboard_bundle(base, roles))  # one aggregation, sliced below
    part = {d: bundle.where(F.col("dim") == d) for d in ("month", "year", "product", "region", "category")}
    total = bundle.where(F.col("dim") == "total")
    months = part["month"].select(F.col("key").alias("month"), "revenue")
    rev, pro, n = F.col("revenue"), F.col("profit"), F.col("n_rows")
    out = {
        "kpis": total.select(
            round_to(rev, 2).alias("total_revenue"), round_to(pro, 2).alias("total_profit"),
            n.alias("total_orders"), round_to(safe_ratio(rev, n), 2).alias("average_order_value"),
            round_to(safe_ratio(pro * 100, rev), 2).alias("profit_margin"),
        ),
        "revenue_growth": dash.growth_of_months(months),
        "monthly_trends": months.orderBy("month"),
        "yearly_trends": part["year"].select(F.col("key").cast("bigint").alias("year"), "revenue").orderBy("year"),
    }
    if roles.product:
        out["top_products"] = dash.ranked_products(part["product"], 10, best=True)
        out["low_performers"] = dash.ranked_products(part["product"], 5, best=False)
    if roles.region:
        out["regional_breakdown"] = part["region"].select(F.col("key").alias("region"), "revenue").orderBy(F.col("revenue").desc(), "region")
    if roles.category:
        out["category_breakdown"] = part["category"].select(F.col("key").alias("category"), "revenue").orderBy("category")
    return out


def _empty_dashboard(df: DataFrame) -> dict[str, DataFrame]:
    spark = df.sparkSession
    money = ("total_revenue", "total_profit", "average_order_value", "profit_margin")
    kpis = df.agg(F.count(F.lit(1)).alias("total_orders")).select("total_orders", *[F.lit(0.0).alias(c) for c in money])
    out = {"kpis": kpis, "revenue_growth": spark.range(1).select(F.lit(0.0).alias("revenue_growth"))}
    lists = {"monthly_trends": "month string", "yearly_trends": "year bigint", "top_products": "rank bigint, product string",
             "low_performers": "rank bigint, product string", "regional_breakdown": "region string", "category_breakdown": "category string"}
    return {**out, **{k: spark.createDataFrame([], f"{v}, revenue double") for k, v in lists.items()}}


def inventory(df: DataFrame, date_col: Optional[str] = None) -> dict[str, DataFrame]:
    """Top-20 reorder recommendations and alert counts."""
    date_col = _date(df, date_col)
    base = _dated(df, date_col, drop_invalid=False)
    roles = Roles.resolve(base.schema, date=date_col)
    if not roles.product or not roles.quantity:
        return {}
    top = inv.top_recommendations(inv.recommendations(base, date_col, roles.product, roles.quantity), 20)
    return {"recommendations": top, "alerts": inv.alert_counts(top)}


def customers(df: DataFrame, date_col: Optional[str] = None) -> dict[str, DataFrame]:
    """RFM scores, segment counts and averages (D11-D13, E5, E6, H12); empty without roles."""
    date_col = _date(df, date_col)
    base = _dated(df, date_col, drop_invalid=False)
    roles = Roles.resolve(base.schema, date=date_col)
    if not roles.customer or not roles.revenue:
        return {}
    rfm = cust.rfm_base(base, date_col, roles.customer, roles.revenue)
    scores = cust.rfm_scores(rfm)
    return {"scores": scores, "segments": cust.segment_counts(scores), "summary": cust.rfm_summary(rfm)}


def seasonal(df: DataFrame, target_col: str, date_col: Optional[str] = None, source: str = "daily") -> dict[str, DataFrame]:
    """Month-of-year and weekday profiles and their peaks."""
    require_column(df.columns, target_col)
    date_col = _date(df, date_col)
    base = _dated(df, date_col, drop_invalid=True)
    return {
        "monthly_seasonality": sea.rounded(sea.month_profile(base, date_col, target_col)),
        "day_of_week_pattern": sea.rounded(sea.weekday_profile(base, date_col, target_col, source)),
        "peaks": sea.peak_periods(base, date_col, target_col, source),
    }


def anomalies(df: DataFrame, target_col: str, date_col: Optional[str] = None, series_cols: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Daily anomaly flags, scores and texts plus counts."""
    require_column(df.columns, target_col)
    date_col = _date(df, date_col)
    res = anom.detect_anomalies(rollup(_dated(df, date_col, True), date_col, target_col, "D", series_cols), series_cols)
    return {"anomalies": res, "counts": anom.anomaly_counts(res, series_cols)}


def train(df: DataFrame, model_type: str, target_col: str, date_col: Optional[str] = None,
          horizon: int = 30, series_cols: Sequence[str] = ()) -> tuple[ForecastResult, DataFrame]:
    """Fit one model on the gap-filled daily series; returns the result and its insights."""
    require_column(df.columns, target_col)
    date_col = _date(df, date_col)
    ts = rollup(_dated(df, date_col, True), date_col, target_col, "D", series_cols)
    res = cmp.train_model(ts, model_type, series_cols, horizon)
    notes = insights_from_daily(ts, evaluate(res.points.where(~F.col("is_future")))) if not series_cols else None
    return res, notes


def compare(df: DataFrame, target_col: str, models: Sequence[str] = cmp.DEFAULT_COMPARE, date_col: Optional[str] = None,
            horizon: int = 30, series_cols: Sequence[str] = ()) -> DataFrame:
    """Metrics of several models, failures as rows, best model per series."""
    require_column(df.columns, target_col)
    date_col = _date(df, date_col)
    ts = rollup(_dated(df, date_col, True), date_col, target_col, "D", series_cols)
    return cmp.compare_models(ts, models, series_cols, horizon)

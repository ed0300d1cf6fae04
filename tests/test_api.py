"""The per-dataset calls on a raw CSV upload (string dates, inferred types)."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from ledgerline import api
from ledgerline.sources.csv import read_csv
from ledgerline.sources.tables import dirty_sales


def test_calls_on_an_uploaded_csv(spark, tmp_path):
    path = str(tmp_path / "upload")
    dirty_sales(spark, SF_SMALL).write.option("header", True).csv(path)
    df = read_csv(spark, path)
    cols = api.columns(df)
    assert cols["roles"]["date"] == "date" and "revenue" in cols["numeric"]
    s = api.summary(df, target_col="revenue")
    assert s["shape"].first().rows == df.count() and s["date_range"].first().start is not None
    d = api.dashboard(df)
    k = d["kpis"].first()
    assert k.total_orders == df.dropDuplicates().count()
    assert abs(k.total_profit - 0.2 * k.total_revenue) < 0.02  # no profit/cost column: 20 % rule
    months = d["monthly_trends"].collect()
    assert abs(sum(r.revenue for r in months) - k.total_revenue) < 1.0
    assert d["top_products"].count() == 10
    inv = api.inventory(df)
    assert inv["alerts"].first().total_products == inv["recommendations"].count() <= 20
    c = api.customers(df)
    seg = c["segments"].first()
    assert seg.champions + seg.loyal_customers + seg.at_risk + seg.churned == seg.total_customers
    se = api.seasonal(df, "revenue")
    assert se["monthly_seasonality"].count() == 12 and se["peaks"].first().peak_day is not None
    a = api.anomalies(df, "revenue")["counts"].first()
    assert 0 < a.anomalies_detected < a.total_points
    res, notes = api.train(df, "linear", "revenue", horizon=7)
    assert res.points.where("is_future").count() == 7 and notes.count() >= 2
    cmp = api.compare(df, "revenue", ["arima", "ensemble"], horizon=7).collect()
    assert {r.status for r in cmp} == {"success", "failed"} and {r.best_model for r in cmp} == {"arima"}

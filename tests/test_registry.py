import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from ledgerline.operators.forecast.compare import compare_models, train_model
from ledgerline.operators.seasonal import as_map, month_profile
from ledgerline.plans import queries as Q
from ledgerline.sources import registry as reg
from ledgerline.sources.tables import sales


def test_dataset_lifecycle(spark, tmp_path):
    root = str(tmp_path / "store")
    df = sales(spark, SF_SMALL, ["date", "product_id", "region", "revenue"])
    a = reg.ingest(spark, df, "first", "a.csv", root)
    b = reg.ingest(spark, df.where("region = 'ASIA'"), "second", "b.csv", root)
    assert a["row_count"] == df.count() and a["columns_info"]["date"] == "date"
    assert [r.name for r in reg.list_datasets(spark, root).collect()] == ["second", "first"]  # newest first
    assert reg.load_dataset(spark, b["id"], root).count() == b["row_count"]
    reg.drop_dataset(spark, a["id"], root)
    assert [r.name for r in reg.list_datasets(spark, root).collect()] == ["second"]
    with pytest.raises(KeyError):
        reg.get_dataset(spark, a["id"], root)
    reg.record_run(spark, {"job_id": "j1", "dataset_id": b["id"], "status": "completed", "model_type": "linear"}, root)
    reg.record_run(spark, {"job_id": "j2", "dataset_id": b["id"], "status": "failed", "model_type": "arima"}, root)
    assert [r.job_id for r in reg.completed_runs(spark, root).collect()] == ["j1"]
    assert {r.dataset_name for r in reg.runs_with_dataset(spark, root).collect()} == {"second"}
    assert reg.recent_runs(spark, root).count() == 2


def test_forecast_sink_and_comparison(spark, tmp_path):
    root = str(tmp_path / "store")
    ts = Q.daily(spark, SF_SMALL)
    res = train_model(ts, "arima", (), 7)
    reg.write_forecast(res.points, "job-a", root)
    back = reg.read_forecast(spark, "job-a", root)
    assert back.count() == res.points.count() and back.where("is_future").count() == 7
    with pytest.raises(ValueError):
        train_model(ts, "ensemble")
    cmp = compare_models(ts, ["arima", "prophet"], (), 7)
    rows = cmp.collect()
    assert {r.model for r in rows} == {"arima", "prophet"} and len({r.best_model for r in rows}) == 1
    reg.record_comparison(cmp, "ds-1", root)
    assert reg.comparisons(spark, root).count() == 2


def test_profile_map(spark):
    prof = month_profile(sales(spark, SF_SMALL, ["date", "revenue"]), "date", "revenue")
    m = as_map(prof, "month", "avg_value").first()["values"]
    assert set(m) == {str(i) for i in range(1, 13)}


def test_report_csv(spark, tmp_path):
    from ledgerline.operators.dashboard import report_rows
    from ledgerline.plans.common import ROLES

    df = sales(spark, SF_SMALL, ["product_id", "date", "revenue", "profit"])
    p = str(tmp_path / "report")
    reg.write_report_csv(report_rows(df, ROLES), p)
    back = spark.read.option("header", True).csv(p)
    assert back.count() == 16 and back.where(F.col("label") == "Total Orders").count() == 1

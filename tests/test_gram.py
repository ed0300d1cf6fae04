"""Fits from sums of products, and the recurrent sequence model."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from ledgerline.functions.dates import FEATURES
from ledgerline.operators import series as ser
from ledgerline.operators.forecast import gram, models, views
from ledgerline.operators.forecast.core import Ridge
from ledgerline.plans import queries as Q


@pytest.fixture(scope="module")
def features(spark):
    ts = Q.daily(spark, SF_SMALL, ["region"])
    return ser.chrono_split(ser.feature_table(ts, ["region"]), ["region"]).where("is_train").cache()


def closed_form(rows):
    x, y = rows[FEATURES].to_numpy(dtype=float), rows["y"].to_numpy(dtype=float)
    m = Ridge(models.RIDGE_ALPHA).fit(x, y)
    return m.coef / m.sd, m.y0 - float((m.coef / m.sd) @ m.mu), x


def test_coefficients_from_sums_equal_the_closed_form(spark, features):
    rows, n = features.toPandas(), 0
    got = gram.ridge_coefficients(features, ["region"]).toPandas()
    for region, own in got.groupby("region"):
        coef, intercept, x = closed_form(rows[rows.region == region])
        found = own.set_index("feature").coefficient
        # a coefficient counts by what it moves a prediction
        spread = np.maximum(x.std(axis=0), 1e-9) / rows[rows.region == region]["y"].std()
        assert np.abs((found[FEATURES].to_numpy() - coef) * spread).max() < 1e-9
        fitted = x @ found[FEATURES].to_numpy() + found["intercept"]
        assert fitted == pytest.approx(x @ coef + intercept, rel=1e-8)
        n += 1
    assert n == 5


def test_new_days_are_added_to_stored_sums(spark, features):
    cut = features.agg(F.percentile_approx("ds", F.lit(0.6))).first()[0]
    old, new = (gram.gram_sums(features.where(c), ["region"]) for c in (F.col("ds") <= cut, F.col("ds") > cut))
    both = {r.region: r for r in gram.merged_sums(old, new, ["region"]).collect()}
    for r in gram.gram_sums(features, ["region"]).collect():
        assert both[r.region].rows == r.rows and both[r.region].sums == pytest.approx(r.sums, rel=1e-12, abs=1e-6)


def test_sums_need_one_combined_aggregate(spark, features):
    names = [*FEATURES, "y", "region"]
    table = spark.createDataFrame([], features.select(*names).schema)
    plan = gram.gram_sums(table, ["region"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and plan.count("Exchange") == 1 and "Python" not in plan


def test_saved_coefficients_are_scored(spark, features, tmp_path):
    gram.ridge_coefficients(features, ["region"]).write.parquet(str(tmp_path / "m"))
    scored = views.predict_linear(features, str(tmp_path / "m"), ["region"])
    assert scored.where("predicted IS NULL").count() == 0 and scored.count() == features.count()


def test_series_without_rows_have_no_sums(spark, features):
    assert gram.gram_sums(features.limit(0)).count() == 0 and gram.ridge_coefficients(features.limit(0), ["region"]).count() == 0


def nonlinear(n=900):
    """A noisy logistic map: the next value is a parabola of the last."""
    rng, z = np.random.default_rng(1), [0.4]
    for _ in range(n - 1):
        z.append(3.8 * z[-1] * (1 - z[-1]))
    return 100 + 50 * np.array(z) + rng.normal(0, 0.3, n)


def test_the_recurrent_state_learns_what_a_linear_read_out_cannot(spark):
    y = nonlinear()
    days = pd.date_range("2021-01-01", periods=len(y), freq="D").date
    got = models.sequence_forecast(spark.createDataFrame(pd.DataFrame({"ds": days, "y": y})), (), 2).metrics.first()
    z = (y - y.mean()) / y.std()
    windows, targets = np.lib.stride_tricks.sliding_window_view(z, 30)[:-1], z[30:]
    k = int(len(targets) * 0.8)
    linear = Ridge(1.0).fit(windows[:k], targets[:k]).predict(windows[k:])
    assert got.rmse < 0.6 * float(np.sqrt(np.mean(((linear - targets[k:]) * y.std()) ** 2)))


def test_the_recurrent_weights_come_from_the_seed():
    a, b, c = models.Reservoir(), models.Reservoir(), models.Reservoir(seed=7)
    assert np.array_equal(a.w, b.w) and np.array_equal(a.v, b.v) and not np.array_equal(a.w, c.w)
    assert np.abs(np.linalg.eigvals(a.w)).max() == pytest.approx(models.RESERVOIR_RADIUS)

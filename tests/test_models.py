"""Model kernels against ground truth and Spark-level forecast invariants."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from ledgerline.operators import anomalies
from ledgerline.operators.anomalies import avg_path, detect_anomalies
from ledgerline.operators.forecast.core import Recent, Ridge
from ledgerline.operators.forecast.gbt import early_stop_prefix
from ledgerline.operators.forecast import arima, boosting, trend
from ledgerline.operators.forecast.models import ridge_forecast
from ledgerline.operators.forecast.trend import trend_forecast
from ledgerline.plans import queries as Q


def test_ridge_matches_closed_form():
    rng = np.random.default_rng(0)
    X = rng.normal(size=(200, 5)) * [1, 10, 100, 0.1, 3] + 5
    y = X @ [1.0, -2.0, 0.5, 3.0, 0.0] + rng.normal(size=200)
    m = Ridge(1.0).fit(X, y)
    mu, sd = X.mean(0), X.std(0)
    Xs = (X - mu) / sd
    A = np.vstack([Xs - 0, np.sqrt(1.0) * np.eye(5)])
    b = np.concatenate([y - y.mean(), np.zeros(5)])
    w, *_ = np.linalg.lstsq(A, b, rcond=None)
    assert np.allclose(m.coef, w, atol=1e-9)
    assert np.allclose(m.predict(X), Xs @ w + y.mean())


def test_rollout_features_use_population_std_and_fallback():
    row = Recent([1.0, 2.0, 3.0]).features()
    assert row[0] == 3.0 and row[1] == pytest.approx(2.0)  # lag_1, lag_7 falls back to mean
    assert row[4] == pytest.approx(2.0) and row[5] == 0.0  # rolling_mean_7 / std_7 (short history)
    values = np.random.default_rng(4).normal(50, 9, 80)
    recent = Recent(values)
    want = [values[-k] for k in (1, 7, 14, 30)] + [f(values[-w:]) for w in (7, 14, 30) for f in (np.mean, np.std)]
    assert recent.features() == pytest.approx(want)
    low, high = recent.band()
    assert high == pytest.approx(values[-1] + 1.96 * np.std(values[-30:])) and low == pytest.approx(max(0, 2 * values[-1] - high))


def test_gbt_takes_many_series_and_reports_short_ones(spark):
    from ledgerline.operators.forecast.gbt import gbt_forecast

    days = list(pd.date_range("2021-01-01", periods=45, freq="D").date)
    rows = [(f"s{n:03d}", d, float(n + i % 7)) for n in range(200) for i, d in enumerate(days)]
    rows += [("short", d, 1.0) for d in days[:10]]
    res = gbt_forecast(spark.createDataFrame(rows, "store string, ds date, y double"), ["store"], 2, max_iter=5)
    fut = res.points.where("is_future")
    assert fut.count() == 400 and fut.select("store").distinct().count() == 200
    assert [r.store for r in res.errors.collect()] == ["short"]


def test_trees_predict_like_the_model(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    from ledgerline.operators.forecast.gbt import Trees

    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    df = spark.createDataFrame([(*map(float, r), float(r[0] * 3 + np.sin(r[1]))) for r in x], "a double, b double, c double, y double")
    rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    model = GBTRegressor(labelCol="y", maxIter=12, maxDepth=6, seed=1).fit(rows)
    want = [r.prediction for r in model.transform(rows).select("prediction").collect()]
    assert Trees(model).predict(x) == pytest.approx(want)


def test_metrics_use_raw_predictions(spark):
    days = list(pd.date_range("2021-01-01", periods=200, freq="D").date)
    df = spark.createDataFrame([(d, float(max(0, 150 - i))) for i, d in enumerate(days)], "ds date, y double")
    res = trend_forecast(df, (), 5)
    hist = res.records.where("record = 'point' AND NOT is_future").toPandas()
    assert (hist.predicted >= 0).all() and (hist.raw < 0).any()
    assert res.metrics.first().mae == pytest.approx(np.abs(hist.actual - hist.raw).mean(), abs=1e-3)


def test_linear_model_is_saved_and_reloaded(spark, tmp_path):
    from ledgerline.operators import series as ser
    from ledgerline.operators.forecast import views

    ts = Q.daily(spark, SF_SMALL)
    res = ridge_forecast(ts, (), 2)
    views.save_linear_model(res, str(tmp_path / "m"))
    got = views.predict_linear(ser.feature_table(ts), str(tmp_path / "m")).select(F.col("ds").alias("date"), F.col("predicted").alias("p"))
    both = res.records.where("record = 'point' AND NOT is_future").join(got, "date").toPandas()
    assert len(both) and both.p.to_numpy() == pytest.approx(both.raw.to_numpy(), rel=1e-6)


def test_early_stop_prefix():
    losses = [10, 8, 6, 5, 5.5] + [6] * 25
    assert early_stop_prefix(losses, 20) == 4
    assert early_stop_prefix([3, 2, 1], 20) == 3


def simulated(rng, n, phi, theta, burn=300):
    e, z = rng.normal(size=n + burn), np.zeros(n + burn)
    for t in range(2, n + burn):
        z[t] = phi[0] * z[t - 1] + phi[1] * z[t - 2] + e[t] + theta[0] * e[t - 1] + theta[1] * e[t - 2]
    return z[burn:]


def test_arima_likelihood_is_that_of_the_dense_covariance():
    rng = np.random.default_rng(1)
    for phi, theta in (((0.5, -0.3), (0.4, 0.3)), ((1.2, -0.5), (-0.3,)), ((0.9,), (0.2, 0.6))):
        phi, theta = np.array(phi), np.array(theta)
        z = rng.normal(size=60)
        T, R = arima._system(phi, theta)
        r = len(R)
        P = np.linalg.solve(np.eye(r * r) - np.kron(T, T), np.outer(R, R).ravel()).reshape(r, r)
        cov = [(np.linalg.matrix_power(T, k) @ P)[0, 0] for k in range(60)]
        S = np.array([[cov[abs(i - j)] for j in range(60)] for i in range(60)])
        s2 = z @ np.linalg.solve(S, z) / 60
        want = -0.5 * (60 * (np.log(2 * np.pi * s2) + 1) + np.linalg.slogdet(S)[1])
        assert arima.log_likelihood(z, phi, theta) == pytest.approx((want, s2), rel=1e-9)


def test_arima_recovers_coefficients_and_beats_its_start():
    rng = np.random.default_rng(1)
    for phi, theta in (((0.5, -0.3), (0.4, 0.3)), ((1.2, -0.5), (-0.3, 0.2))):
        m = arima.arma_fit(simulated(rng, 8000, phi, theta), 2, 2)
        assert m.phi == pytest.approx(phi, abs=0.05) and m.theta == pytest.approx(theta, abs=0.05)
        assert m.s2 == pytest.approx(1.0, abs=0.05)
        for _ in range(12):
            z = simulated(rng, 250, phi, theta)
            m = arima.arma_fit(z, 2, 2)
            start = arima.hannan_rissanen(z, 2, 2)
            outside = max(np.abs(np.roots([1, *-start[0]])).max(), np.abs(np.roots([1, *start[1]])).max()) >= 1
            assert outside or m.likelihood >= arima.log_likelihood(z, *start)[0] - 1e-6
            assert m.likelihood >= arima.log_likelihood(z, np.array(phi), np.array(theta))[0] - 1e-6


def test_arima_partial_autocorrelations_round_trip():
    partial = np.array([0.4, -0.7, 0.2])
    coef = arima.from_partial(partial)
    assert arima.to_partial(coef) == pytest.approx(partial)
    assert np.abs(np.roots([1, *-coef])).max() < 1


def test_arima_intervals_cover():
    rng, hit, n = np.random.default_rng(5), 0, 0
    for _ in range(150):
        y = 100 + np.cumsum(simulated(rng, 520, (0.5, -0.3), (0.4, 0.3)))
        m = arima.arima_fit(y[:500])
        level, se = y[499] + np.cumsum(m.ahead(np.diff(y[:500]), 20)), m.spread(20)
        assert np.all(np.diff(se) > 0)
        hit += int((np.abs(y[500:] - level) <= 1.96 * se).sum())
        n += 20
    assert 0.93 <= hit / n <= 0.97


def test_arima_of_a_constant_series_is_an_error_row(spark):
    days = list(pd.date_range("2021-01-01", periods=120, freq="D").date)
    res = arima.arima_forecast(spark.createDataFrame([(d, 5.0) for d in days], "ds date, y double"), (), 3)
    assert res.points.count() == 0 and "does not change" in res.errors.first().error


def planted(n=1200):
    rng, t = np.random.default_rng(0), np.arange(n)
    places = np.linspace(0, int(np.floor(n * 0.8)) - 1, 26).round().astype(int)[1:]
    y = 500 + 0.5 * t + 1.5 * np.maximum(0, t - places[7]) - 2.5 * np.maximum(0, t - places[17])
    return t + 18000.0, y + 60 * np.sin(2 * np.pi * t / 7) + rng.normal(0, 20, n)


def test_trend_finds_planted_changes_and_leaves_the_others_at_zero():
    days, y = planted()
    m = trend.fit_trend(days, y)
    change = m.delta * m.size / m.length
    assert change[6:9].sum() == pytest.approx(1.5, abs=0.15) and change[16:19].sum() == pytest.approx(-2.5, abs=0.15)
    others = [c for i, c in enumerate(change) if i not in (6, 7, 8, 16, 17, 18)]
    assert np.abs(others).max() < 0.05 and sum(c == 0 for c in change) >= 15
    assert m.slope * m.size / m.length == pytest.approx(0.5, abs=0.05) and m.noise * m.size == pytest.approx(20, abs=2)


def test_trend_is_the_most_probable():
    """No small move of any parameter has a higher posterior density."""
    days, y = planted(400)
    m = trend.fit_trend(days, y)

    def density(offset, slope, delta, season):
        t = m.scaled(days)
        z = y / m.size - offset - slope * t - np.maximum(0.0, t[:, None] - m.changepoints) @ delta - trend.seasonal_columns(days) @ season
        prior = (offset**2 + slope**2) / (2 * 25) + np.abs(delta).sum() / 0.05 + (season**2).sum() / 200
        return -(z @ z) / (2 * m.noise**2) - prior

    best = density(m.offset, m.slope, m.delta, m.season)
    for step in (1e-3, -1e-3):
        assert density(m.offset + step, m.slope, m.delta, m.season) <= best + 1e-3
        assert density(m.offset, m.slope + step, m.delta, m.season) <= best + 1e-3
        for j in range(len(m.delta)):
            assert density(m.offset, m.slope, m.delta + step * (np.arange(len(m.delta)) == j), m.season) <= best + 1e-3


def test_trend_interval_widens_with_the_horizon():
    days, y = planted()
    m = trend.fit_trend(days, y)
    ahead = days[-1] + np.arange(1, 301)
    low, high = m.interval(ahead)
    width = high - low
    assert width[0] == pytest.approx(2 * 1.96 * m.noise * m.size, rel=0.1)
    assert width[29] <= width[99] < width[199] < width[299] and width[299] > 1.5 * width[0]
    assert np.array_equal(low, m.interval(ahead)[0])  # the seed is fixed


def test_trend_recovers_sine_and_trend(spark):
    days = pd.date_range("2020-01-01", periods=730, freq="D")
    t = np.arange(730)
    y = 1000 + 2.0 * t + 200 * np.sin(2 * np.pi * t / 7)
    df = spark.createDataFrame(pd.DataFrame({"ds": days.date, "y": y}))
    res = trend_forecast(df, (), 14)
    fut = res.points.where("is_future").orderBy("date").toPandas()
    truth = 1000 + 2.0 * (730 + np.arange(14)) + 200 * np.sin(2 * np.pi * (730 + np.arange(14)) / 7)
    assert np.max(np.abs(fut["predicted"].to_numpy() - truth)) < 60
    assert (fut["lower_bound"] <= fut["predicted"]).all() and (fut["predicted"] <= fut["upper_bound"]).all()


def test_ridge_forecast_points(spark):
    res = ridge_forecast(Q.daily(spark, SF_SMALL), (), 30)
    pts = res.points.toPandas()
    fut = pts[pts.is_future]
    assert len(fut) == 30
    assert (fut.lower_bound <= fut.predicted + 1e-9).all() and (fut.predicted <= fut.upper_bound + 1e-9).all()
    assert (fut.predicted >= 0).all() and (fut.lower_bound >= 0).all()
    assert fut.date.min() == pts[~pts.is_future].date.max() + dt.timedelta(days=1)
    assert 0 < res.importances.count() <= 10
    m = res.metrics.first()
    assert m.rmse >= m.mae >= 0


def test_short_series_becomes_error_row(spark):
    days = pd.date_range("2021-01-01", periods=20, freq="D")
    df = spark.createDataFrame(pd.DataFrame({"ds": days.date, "y": np.arange(20.0)}))
    res = ridge_forecast(df, (), 5)  # no row survives the 30-day warm-up
    assert res.errors.count() == 1 and res.points.count() == 0
    assert trend_forecast(df, (), 5).points.where("is_future").count() == 5


def test_isolation_forest_finds_spikes(spark):
    rng = np.random.default_rng(7)
    y = rng.normal(1000, 20, 400)
    spikes = [50, 150, 250, 350]
    y[spikes] = [5000, 6000, 4000, 7000]
    days = pd.date_range("2022-01-01", periods=400, freq="D")
    df = spark.createDataFrame(pd.DataFrame({"ds": days.date, "y": y}))
    out = detect_anomalies(df).toPandas().sort_values("date").reset_index(drop=True)
    flagged = set(out.index[out.is_anomaly])
    assert set(spikes) <= flagged
    assert abs(out.is_anomaly.mean() - 0.05) < 0.01
    assert out.loc[spikes[0], "description"].startswith("Unusually high sales: 5000")
    assert avg_path(256) == pytest.approx(2 * (np.log(255) + 0.5772156649) - 2 * 255 / 256)


def test_report_views(spark):
    from ledgerline.operators.forecast import views

    res = ridge_forecast(Q.daily(spark, SF_SMALL), (), 10)
    sd = views.split_dates(res.points).first()
    assert sd.split_date == res.points.where("is_future").agg(F.min("date")).first()[0]
    ch = views.chart_points(res.points).where("is_future").first()
    assert ch.confidence == [ch.lower, ch.upper]
    rel = views.relative_importance(res.importances).collect()
    assert len(rel) == 8 and max(r.pct_of_max for r in rel) == 100.0
    assert views.r2_band(res.metrics).first().r2_band in {"good", "fair", "poor"}


def test_sequence_model_learns_a_weekly_pattern(spark):
    from ledgerline.operators.forecast.models import sequence_forecast

    days = pd.date_range("2021-01-01", periods=400, freq="D")
    t = np.arange(400)
    y = 500 + 100 * np.sin(2 * np.pi * t / 7)
    res = sequence_forecast(spark.createDataFrame(pd.DataFrame({"ds": days.date, "y": y})), (), 14)
    fut = res.points.where("is_future").orderBy("date").toPandas()
    truth = 500 + 100 * np.sin(2 * np.pi * (400 + np.arange(14)) / 7)
    assert np.max(np.abs(fut["predicted"].to_numpy() - truth)) < 10
    assert res.metrics.first().r2 > 0.99


def test_gbt_pipeline_small(spark):
    from ledgerline.operators.forecast.gbt import gbt_forecast

    days = pd.date_range("2021-01-01", periods=160, freq="D")
    t = np.arange(160)
    pdf = pd.DataFrame({"ds": list(days.date) * 2, "y": np.concatenate([300 + 50 * np.sin(2 * np.pi * t / 7), 80 + t * 0.5]),
                        "store": ["a"] * 160 + ["b"] * 160})
    res = gbt_forecast(spark.createDataFrame(pdf), ["store"], 3, max_iter=4)
    pts = res.points.toPandas()
    assert set(pts.store) == {"a", "b"}
    fut = pts[pts.is_future]
    assert len(fut) == 6 and (fut.predicted >= 0).all() and (fut.lower_bound <= fut.predicted).all()
    assert res.metrics.count() == 2 and res.importances.count() > 0 and res.model is not None


def test_boosting_grows_the_best_splits():
    """The first split of a tree on all rows and features is the best by direct search; leaves are shrunk means."""
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(60, 3)), rng.normal(size=60)
    g = -(y - y.mean())
    gain, splits = np.zeros(3), np.zeros(3)
    tree = boosting.grow(boosting.Binned(x), g, np.arange(60), np.arange(3), 1.0, gain, splits)
    score = lambda part: part.sum() ** 2 / (len(part) + 1.0)
    best = max((score(g[x[:, f] <= c]) + score(g[x[:, f] > c]), f) for f in range(3) for c in np.sort(x[:, f])[:-1])
    left = x[:, tree.feature[0]] <= tree.threshold[0]
    assert tree.feature[0] == best[1] and score(g[left]) + score(g[~left]) == pytest.approx(best[0])
    at = np.zeros(60, dtype=int)
    for _ in range(boosting.DEPTH):
        f = tree.feature[at]
        at = np.where(f < 0, at, 2 * at + 1 + (x[np.arange(60), np.maximum(f, 0)] > tree.threshold[at]))
    for slot in set(at):
        assert tree.value[slot] == pytest.approx(-g[at == slot].sum() / ((at == slot).sum() + 1.0))
    assert boosting.Boosted(0.0, [tree]).predict(x) == pytest.approx(tree.value[at])


def test_boosting_stops_by_patience_and_is_reproducible():
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(200, 4)), rng.normal(size=200)  # nothing to learn
    model, kept = boosting.boost(x[:150], y[:150], 300, 0.3, watch=(x[150:], y[150:]))
    assert len(model.trees) == kept + boosting.PATIENCE < 100
    again, _ = boosting.boost(x[:150], y[:150], 300, 0.3, watch=(x[150:], y[150:]))
    assert np.array_equal(model.predict(x), again.predict(x))


def test_boosting_is_as_good_as_the_pooled_model(spark):
    from ledgerline.operators.forecast.gbt import gbt_forecast

    rng, t = np.random.default_rng(2), np.arange(500)
    y = 400 + 80 * np.sin(2 * np.pi * t / 7) + 30 * np.sin(2 * np.pi * t / 30.4) + rng.normal(0, 15, 500)
    days = pd.date_range("2021-01-01", periods=500, freq="D").date
    df = spark.createDataFrame(pd.DataFrame({"ds": days, "y": y}))
    pooled = gbt_forecast(df, (), 2, max_iter=30, step_size=0.2).metrics.first().rmse
    assert boosting.boosted_forecast(df, (), 2, rounds=30, rate=0.2).metrics.first().rmse <= 1.05 * pooled


def test_boosted_models_are_saved_and_scored(spark, tmp_path):
    from ledgerline.operators import series as ser
    from ledgerline.operators.forecast import views

    days, t = list(pd.date_range("2021-01-01", periods=160, freq="D").date), np.arange(160)
    rows = [(s, d, float(v)) for s, y in (("a", 300 + 50 * np.sin(2 * np.pi * t / 7)), ("b", 80 + t * 0.5)) for d, v in zip(days, y)]
    rows += [("short", d, 1.0) for d in days[:20]]
    ts = spark.createDataFrame(rows, "store string, ds date, y double")
    res = boosting.boosted_forecast(ts, ["store"], 3, rounds=20)
    assert [r.store for r in res.errors.collect()] == ["short"]
    pts = res.points.toPandas()
    assert set(pts.store) == {"a", "b"} and pts.is_future.sum() == 6 and (pts[pts.is_future].lower_bound >= 0).all()
    assert res.metrics.count() == 2 and 0 < res.importances.count() <= 20
    views.save_trees(res, str(tmp_path / "trees"))
    scored = views.predict_trees(ser.feature_table(ts, ["store"]), str(tmp_path / "trees"), ["store"])
    scored = scored.select("store", F.col("ds").alias("date"), F.col("predicted").alias("p"))
    both = res.points.where("NOT is_future").join(scored, ["store", "date"]).toPandas()
    assert len(both) > 20 and both.p.to_numpy() == pytest.approx(both.predicted.to_numpy())
    one = ts.where("store = 'a'").drop("store")
    views.save_trees(boosting.boosted_forecast(one, (), 1, rounds=5), str(tmp_path / "one"))
    assert views.predict_trees(ser.feature_table(one), str(tmp_path / "one")).where("predicted IS NULL").count() == 0


def test_comparison_keeps_failed_models_and_runs_them_together(spark, monkeypatch):
    from ledgerline.operators.forecast import compare

    def broken(ts, series_cols, horizon):
        raise RuntimeError("no such luck")

    monkeypatch.setitem(compare.TRAINERS, "lstm", broken)
    days = list(pd.date_range("2021-01-01", periods=220, freq="D").date)
    rows = [("long", d, float(100 + i % 7 * 10)) for i, d in enumerate(days)] + [("short", d, 5.0) for d in days[:12]]
    ts = spark.createDataFrame(rows, "store string, ds date, y double")
    got = {(r.store, r.model): r for r in compare.compare_models(ts, ["linear", "lstm", "xgboost", "arima"], ["store"], 3).collect()}
    assert len(got) == 8 and [got["long", m].request_pos for m in ("linear", "lstm", "xgboost", "arima")] == [0, 1, 2, 3]
    assert got["long", "lstm"].status == "failed" and "no such luck" in got["long", "lstm"].error
    assert got["long", "linear"].status == "success" and got["short", "xgboost"].status == "failed"
    best = min((r.rmse, r.request_pos, m) for (s, m), r in got.items() if s == "long" and r.status == "success")[2]
    assert {r.best_model for (s, _), r in got.items() if s == "long"} == {best}


def old_paths(sample, values, rng):
    """Path lengths by walking the values down the tree as it grows."""
    limit, out = int(np.ceil(np.log2(max(len(sample), 2)))), np.zeros(len(values))

    def grow(s, idx, depth):
        if depth >= limit or len(s) <= 1 or s.min() == s.max():
            out[idx] = depth + avg_path(len(s))
            return
        cut = rng.uniform(s.min(), s.max())
        grow(s[s < cut], idx[values[idx] < cut], depth + 1)
        grow(s[s >= cut], idx[values[idx] >= cut], depth + 1)

    grow(sample, np.arange(len(values)), 0)
    return out


def test_forest_steps_equal_walking_the_trees():
    rng = np.random.default_rng(3)
    for pool in (rng.normal(size=400), rng.integers(0, 5, 300).astype(float), np.full(20, 3.0), np.array([1.0])):
        values = np.concatenate([pool, rng.normal(size=50) * 3, [-1e9, 1e9]])
        cuts, lengths = anomalies.forest_steps(pool, 20, 64, 42)
        want = np.zeros(len(values))
        for tree in range(20):
            own = np.random.default_rng([42, tree])
            want += old_paths(pool[own.choice(len(pool), min(64, len(pool)), replace=False)], values, own)
        assert lengths[np.searchsorted(cuts, values, side="right")] == pytest.approx(want / 20)


def test_streamed_scores_equal_broadcast_ones(spark):
    rng = np.random.default_rng(8)
    rows = [(k, dt.date(2022, 1, 1) + dt.timedelta(days=int(i)), float(v)) for k in ("a", "b", None) for i, v in enumerate(rng.normal(size=300))]
    ts = spark.createDataFrame(rows, "store string, ds date, y double").repartition(5)
    forest = anomalies.fit_forest(ts, ["store"], 10, 32, 42).cache()
    near, far = (
        sorted(map(repr, anomalies.score_rows(ts, forest, ["store"], limit).collect())) for limit in (10**9, 0)
    )
    assert len(near) == 900 and near == far


def test_forest_on_single_rows(spark):
    """More rows than the pool holds: spikes are found, 5 % are flagged."""
    rows = spark.range(60_000).select(
        F.date_add(F.lit("2022-01-01").cast("date"), (F.col("id") % 365).cast("int")).alias("day"),
        F.when(F.col("id") % 10_000 == 7, 9000.0).otherwise(100 + F.pmod(F.xxhash64("id"), F.lit(1000)) / 100).alias("amount"),
    )
    found = anomalies.transaction_anomalies(rows, "day", "amount").cache()
    assert found.count() == 60_000 and found.where("value = 9000 AND NOT is_anomaly").count() == 0
    assert 0.02 < found.agg(F.avg(F.col("is_anomaly").cast("int"))).first()[0] <= 0.0501
    found.unpersist()
    assert anomalies.detect_anomalies(rows.limit(0).select(F.col("day").alias("ds"), F.col("amount").alias("y"))).count() == 0

"""Invariants over the driver's tables and small fixtures."""

import datetime as dt

import pytest

from pyspark.sql import functions as F

from conftest import SF_ORACLE, SF_SMALL
from ledgerline.operators import clean as cln
from ledgerline.operators import customers as cust
from ledgerline.operators import series as ser
from ledgerline.plans import queries as Q
from ledgerline.sources.tables import dirty_sales, sales


def test_rollups_fill_gaps_and_keep_totals(spark):
    s = sales(spark, SF_SMALL, ["date", "revenue"])
    total = s.agg(F.sum("revenue").cast("double")).first()[0]
    for freq, step in (("D", 1), ("W", 7)):
        ts = ser.rollup(s, "date", "revenue", freq).orderBy("ds").collect()
        assert abs(sum(r.y for r in ts) - total) < 1e-3
        gaps = {(b.ds - a.ds).days for a, b in zip(ts, ts[1:])}
        assert gaps == {step}
    m = ser.rollup(s, "date", "revenue", "M").orderBy("ds").collect()
    assert all((r.ds + dt.timedelta(days=1)).day == 1 for r in m)  # month-end labels
    assert abs(sum(r.y for r in m) - total) < 1e-3
    w = ser.rollup(s, "date", "revenue", "W").collect()
    assert all(r.ds.weekday() == 6 for r in w)  # weeks end on Sunday


def test_rfm_segments_known_values(spark):
    seg = Q.QUERIES["rfm_segments"](spark, SF_ORACLE).first().asDict()
    assert seg == {"total_customers": 1500, "champions": 422, "loyal_customers": 505, "at_risk": 434, "churned": 139}


def test_global_index_is_dense_and_ordered(spark):
    from ledgerline.functions.ranking import global_index

    df = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 7919 % 5000).alias("v"))
    r = global_index(df, ["v"], "rn").orderBy("rn").collect()
    assert [x.rn for x in r] == list(range(1, 5001))
    assert [x.v for x in r] == sorted(x.v for x in r)


def test_exact_quantiles_match_numpy(spark):
    import numpy as np

    from ledgerline.functions import ranking

    vals = [float(x) for x in np.random.default_rng(1).integers(0, 40, 997)]  # many ties
    df = spark.createDataFrame([(v, v * 2.5 + i * 1e-3 if i % 3 else None) for i, v in enumerate(vals)], "a double, b double")
    b = [v * 2.5 + i * 1e-3 for i, v in enumerate(vals) if i % 3]
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = ranking.quantiles(df, ["a", "b"], probs)
    for c, data in (("a", vals), ("b", b)):
        assert got[c] == pytest.approx([float(np.quantile(data, p)) for p in probs], abs=1e-9), c


def test_cleaning_invariants(spark):
    c = cln.clean(dirty_sales(spark, SF_SMALL))
    assert c.deduped.count() == c.deduped.dropDuplicates().count()  # idempotent
    assert c.cleaned.where(F.col("quantity").isNull() | F.col("region").isNull()).count() == 0
    rep = {(r.issue, r.column): r.n for r in c.report.collect()}
    assert rep[("original_rows", "*")] - rep[("duplicates_removed", "*")] == rep[("final_rows", "*")]
    assert rep[("final_rows", "*")] == c.cleaned.count()


def test_split_partitions_rows(spark):
    s = Q.daily(spark, SF_SMALL)
    sp = ser.chrono_split(s)
    n = s.count()
    assert sp.where("is_train").count() == int(n * 0.8)
    assert sp.count() == n


def test_rfm_segments_add_up(spark):
    base = cust.rfm_base(sales(spark, SF_SMALL, ["date", "customer_id", "revenue"]), "date", "customer_id", "revenue")
    seg = cust.segment_counts(cust.rfm_scores(base)).first()
    assert seg.champions + seg.loyal_customers + seg.at_risk + seg.churned == seg.total_customers == base.count()


def test_quantiles_of_filled_columns_match_numpy(spark):
    """Quartiles of a median-filled column are read from the original values and the copies."""
    import numpy as np

    from ledgerline.functions import ranking

    df = dirty_sales(spark, SF_SMALL)
    cols = ["quantity", "unit_price", "revenue", "customer_id"]
    stats = ranking.column_stats(df, cols)
    med = ranking.quantiles(df, cols, [0.5], stats)
    fill = {c: (med[c][0], stats[c]["nulls"]) for c in cols if stats[c]["nulls"]}
    probs = [0.1, 0.25, 0.75, 0.9]
    got = ranking.quantiles(df, cols, probs, stats, fill)
    pdf = df.select(*cols).toPandas().astype(float)
    for c in cols:
        assert med[c][0] == pytest.approx(pdf[c].median(), rel=1e-12)
        assert got[c] == pytest.approx([float(np.quantile(pdf[c].fillna(pdf[c].median()), p)) for p in probs], rel=1e-12), c


def test_nan_is_missing_everywhere(spark):
    from ledgerline.operators import profile as prof

    nan = float("nan")
    df = spark.createDataFrame([(float(i), nan if i % 5 == 0 else float(i), i % 2 == 0) for i in range(1, 101)], "a double, b double, c boolean")
    c = cln.clean(df)
    assert dict(c.cleaned.dtypes)["c"] == "boolean"
    assert c.cleaned.where(F.isnan("b") | F.col("b").isNull()).count() == 0
    assert {(r.issue, r.column): r.n for r in c.report.collect()}[("missing_filled_median", "b")] == 20
    b = [float(i) for i in range(1, 101) if i % 5]
    row = prof.numeric_profile(df, ["b"]).first()
    assert row["mean"] == pytest.approx(sum(b) / len(b)) and row["max"] == 99.0 and row["median"] == 50.0
    assert {r.column: r.missing for r in prof.missing_counts(df).collect()} == {"a": 0, "b": 20, "c": 0}


def test_capping_respects_iqr_bounds(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    vals = list(rng.normal(100, 5, 400)) + [10_000.0, -9_000.0, None]
    df = spark.createDataFrame([(float(v) if v is not None else None,) for v in vals], "v double")
    c = cln.clean(df)
    imputed = np.array([r.v for r in c.imputed.collect()])
    q1, q3 = np.quantile(imputed, [0.25, 0.75])
    lo, hi = q1 - 3 * (q3 - q1), q3 + 3 * (q3 - q1)
    out = np.array([r.v for r in c.cleaned.collect()])
    assert out.min() == pytest.approx(lo) and out.max() == pytest.approx(hi)
    rep = {(r.issue, r.column): r.n for r in c.report.collect()}
    assert rep[("outliers_capped", "v")] == 2 and rep[("missing_filled_median", "v")] == 1

"""Exact ranks by sketches and counts against sorting."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from ledgerline.functions import ranking
from ledgerline.operators import clean as cln
from ledgerline.operators import customers as cust


@pytest.fixture
def few(monkeypatch):
    """Small limits, so that small tables take the passes of large ones."""
    monkeypatch.setattr(ranking, "FEW", 40)
    monkeypatch.setattr(ranking, "SKETCH_K", 64)


def columns(n=6000):
    rng = np.random.default_rng(3)
    return {
        "distinct": rng.permutation(n).astype(float) / 7,
        "ties": rng.integers(0, 3, n).astype(float),
        "heavy": np.where(rng.random(n) < 0.98, 5.0, rng.normal(size=n)),
        "two_heaps": np.where(rng.random(n) < 0.5, -1.0, np.where(rng.random(n) < 0.99, 1.0, rng.random(n))),
        "wide": rng.lognormal(0, 9, n),
        "endless": np.where(rng.random(n) < 0.3, math.inf, np.where(rng.random(n) < 0.3, -math.inf, rng.normal(size=n))),
        "one": np.full(n, 2.5),
    }


def frame(spark, data):
    names = list(data)
    rows = [tuple(float(v) for v in r) for r in zip(*data.values())]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(7)


@pytest.mark.parametrize("slack", [0.003, 0.0])
def test_order_statistics_equal_sorting(spark, few, monkeypatch, slack):
    monkeypatch.setattr(ranking, "SLACK", slack)  # with none, brackets miss their ranks
    data = columns()
    df = frame(spark, data)
    ranks = [0, 1, 17, 1499, 1500, 2999, 3000, 4499, 4500, 5998, 5999]
    got = ranking.order_statistics(df, {c: ranks for c in data}, {c: 6000 for c in data})
    for c, values in data.items():
        ordered = np.sort(values)
        assert [got[c, r] for r in ranks] == [ordered[r] for r in ranks], c


def test_quantiles_of_imputed_columns_equal_numpy(spark, few):
    rng = np.random.default_rng(5)
    data = columns(2000)
    del data["endless"]
    holes = {c: rng.random(2000) < share for c, share in zip(data, (0.0, 0.3, 0.7, 0.1, 0.55, 0.2))}
    rows = [tuple(None if holes[c][i] else float(data[c][i]) for c in data) for i in range(2000)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).repartition(3)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = ranking.quantiles(df, list(data), probs, impute=True)
    for c in data:
        held = data[c][~holes[c]]
        full = np.where(holes[c], np.median(held), data[c])
        assert got[c] == pytest.approx(list(np.quantile(full, probs)), rel=1e-12, abs=1e-12), c


def test_columns_without_values_have_no_quantiles(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    assert ranking.quantiles(df, ["a", "b"], [0.5], impute=True) == {"a": [None], "b": [1.0]}
    assert ranking.quantiles(df.limit(0), ["a", "b"], [0.5]) == {"a": [None], "b": [None]}


@pytest.mark.parametrize("kind", ["long", "int", "string", "decimal(20,0)"])
def test_places_among_ties_need_no_sort(spark, few, kind):
    rng = np.random.default_rng(9)
    n = 1500
    keys = rng.permutation(n) * (2**40 + 3 if kind in ("long", "decimal(20,0)") else 1) - 700
    rows = [(int(k), int(v)) for k, v in zip(keys, rng.integers(0, 3, n))]
    df = spark.createDataFrame(rows, "k long, v int").withColumn(
        "k", F.concat(F.lit("é" * 3), F.col("k").cast("string")) if kind == "string" else F.col("k").cast(kind)
    )
    ordered = [r["k"] for r in df.orderBy("v", "k").collect()]
    values = [r["v"] for r in df.orderBy("v", "k").collect()]
    ranks = [0, 374, 749, 1124, n - 1]
    cuts = ranking.first_of_ties(df, "v", "k", ranks, {r: values[r] for r in ranks})
    for r, cut in zip(ranks, cuts):
        assert {x["k"] for x in df.where(cut).collect()} == set(ordered[: r + 1]), r


def test_no_plan_sorts_or_shuffles_the_values(spark):
    """Only the few rows between found neighbours are shuffled; customers are not range-partitioned or numbered."""
    base = spark.range(200_000).select(
        F.col("id").alias("customer"), (F.col("id") % 91).alias("recency"), (F.col("id") % 5).alias("frequency"),
        (F.pmod(F.xxhash64("id"), F.lit(10**9)) / 7).alias("monetary"),
    )
    plan = cust.rfm_scores(base)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan
    spans = [ranking.Span("monetary", None, None, 0, 200_000, (100_000,))]
    left = ranking._narrowed(base, spans, {})
    assert sum(s.inside for s in left) <= 0.02 * 200_000


def test_empty_tables(spark):
    none = spark.createDataFrame([], "customer long, recency long, frequency long, monetary double")
    assert cust.rfm_scores(none).count() == 0
    clean = cln.clean(spark.read.parquet(f"{SF_SMALL}/orders.parquet").limit(0))
    assert clean.cleaned.count() == 0


def test_rows_outside_all_spans_go_before_the_functions_over_arrays(spark):
    df = spark.createDataFrame([(float(i), None if i % 3 else float(-i)) for i in range(100)], "a double, b double")
    spans = [ranking.Span("a", 10.0, 13.0, 11, 2, (11,)), ranking.Span("b", -4.0, None, 32, 2, (33,))]
    held = ranking._span_values(df, spans)
    assert sorted(map(tuple, held.collect())) == [(0, 11.0), (0, 12.0), (1, -3.0), (1, 0.0)]
    plan = held._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan.split("Generate")[1]

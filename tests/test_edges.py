"""Edge inputs: empty tables, null keys, ties, bad dates, ragged CSV, constant series."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerline.functions.roles import Roles
from ledgerline.operators import customers as cust
from ledgerline.operators import dashboard as dash
from ledgerline.operators import series as ser
from ledgerline.operators.clean import clean, parse_dates
from ledgerline.sources.csv import read_csv

SCHEMA = "date date, product string, region string, category string, revenue double, profit double, customer string"


def _roles(df):
    return Roles.resolve(df.schema)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    k = dash.kpi_totals(df, _roles(df)).first()
    assert k.total_revenue == 0.0 and k.total_orders == 0 and k.average_order_value == 0.0
    assert dash.revenue_growth(df, _roles(df)).first().revenue_growth == 0.0
    assert ser.rollup(df, "date", "revenue").count() == 0


def test_null_keys_are_dropped_from_groups(spark):
    rows = [(dt.date(2024, 1, 1), None, "A", "c", 10.0, 1.0, "x"), (dt.date(2024, 1, 2), "p", None, "c", 5.0, 1.0, "y"),
            (None, "p", "A", None, 7.0, 1.0, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    r = _roles(df)
    b = {(x.dim, x.key): x.revenue for x in dash.dashboard_bundle(df, r).collect()}
    assert b[("total", None)] == 22.0
    assert ("product", None) not in b and ("region", None) not in b and ("month", None) not in b
    assert b[("product", "p")] == 12.0
    assert {x.month for x in dash.monthly_revenue(df, r).collect()} == {"2024-01"}


def test_single_row_and_growth(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), "p", "A", "c", 10.0, 2.0, "x")], SCHEMA)
    assert dash.revenue_growth(df, _roles(df)).first().revenue_growth == 0.0
    df2 = df.unionByName(spark.createDataFrame([(dt.date(2024, 2, 1), "p", "A", "c", 15.0, 2.0, "x")], SCHEMA))
    assert dash.revenue_growth(df2, _roles(df2)).first().revenue_growth == 50.0


def test_tied_quartiles_do_not_fail(spark):
    rows = [(dt.date(2024, 1, 1), "p", "A", "c", 10.0, 1.0, f"c{i}") for i in range(8)]
    df = spark.createDataFrame(rows, SCHEMA)
    base = cust.rfm_base(df, "date", "customer", "revenue")
    sc = cust.rfm_scores(base).collect()
    assert {r.r_score for r in sc} == {4} and {r.m_score for r in sc} == {1}
    assert sorted(r.f_score for r in sc) == [1, 1, 2, 2, 3, 3, 4, 4]  # rank(method="first") by customer


def test_parse_dates_formats_and_bad_values(spark):
    df = spark.createDataFrame([("03/14/2024",), ("12/01/2024",), ("1/2/2024",), (None,)], "d string")
    got = {r.d for r in parse_dates(df, "d").collect()}
    assert got == {dt.date(2024, 3, 14), dt.date(2024, 12, 1), dt.date(2024, 1, 2)}  # M/d/yyyy chosen
    df = spark.createDataFrame([("March 5, 2024",), ("Apr 6, 2024",), ("junk",)], "d string")
    assert parse_dates(df, "d").count() == 1  # most-parsing layout, failures dropped
    df = spark.createDataFrame([("2024-3-5",), ("2024-12-31",)], "d string")
    assert {r.d for r in parse_dates(df, "d").collect()} == {dt.date(2024, 3, 5), dt.date(2024, 12, 31)}


def test_ragged_csv(spark, tmp_path):
    p = tmp_path / "ragged.csv"
    p.write_text('date,product,qty,price\n2024-01-01,"a, b",1,2.5\n2024-01-02,c,2\n2024-01-03,d,3,4.0,EXTRA\n2024-01-04,NA,,1e2\n')
    df = read_csv(spark, str(p))
    rows = df.orderBy("date").collect()
    assert [r.date for r in rows] == ["2024-01-01", "2024-01-02", "2024-01-04"]  # long row skipped
    assert rows[0].product == "a, b" and rows[1].price is None  # quoted comma; short row padded
    assert rows[2].product is None and rows[2].qty is None  # NA spellings
    assert dict(df.dtypes) == {"date": "string", "product": "string", "qty": "bigint", "price": "double"}


def test_constant_series_and_cleaning(spark):
    days = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), 5.0) for i in range(60)]
    ts = spark.createDataFrame(days, "ds date, y double")
    z = ser.zscore(ts).collect()
    assert all(r.y_scaled == 0.0 for r in z)
    ft = ser.feature_table(ts)
    assert ft.count() == 30 and ft.agg(F.max("rolling_std_7")).first()[0] == 0.0
    c = clean(spark.createDataFrame([(1.0, "a"), (1.0, "a"), (None, None), (3.0, "b")], "v double, s string"))
    assert sorted((r.v, r.s) for r in c.cleaned.collect()) == [(1.0, "a"), (2.0, "Unknown"), (3.0, "b")]


def test_rfm_recency_on_timestamps_floors_days(spark):
    rows = [(dt.datetime(2024, 1, 10, 12, 0), "a", 5.0), (dt.datetime(2024, 1, 9, 18, 0), "b", 3.0),
            (dt.datetime(2024, 1, 1, 13, 0), "b", 2.0), (dt.datetime(2024, 1, 10, 11, 59), "c", 1.0)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, customer string, revenue double")
    base = {r.customer: r for r in cust.rfm_base(df, "ts", "customer", "revenue").collect()}
    # (max - own max) in whole days, floored: 18h -> 0, 1 minute -> 0
    assert base["a"].recency == 0 and base["b"].recency == 0 and base["c"].recency == 0
    assert base["b"].frequency == 2 and base["b"].monetary == 5.0
    rows.append((dt.datetime(2024, 1, 12, 11, 0), "d", 1.0))
    df = spark.createDataFrame(rows, "ts timestamp_ntz, customer string, revenue double")
    base = {r.customer: r.recency for r in cust.rfm_base(df, "ts", "customer", "revenue").collect()}
    assert base == {"a": 1, "b": 2, "c": 1, "d": 0}


def test_recent_window_on_timestamps_is_exact_90_days(spark):
    from ledgerline.operators.inventory import recent_window

    end = dt.datetime(2024, 6, 30, 15, 0)
    rows = [(end,), (end - dt.timedelta(days=90),), (end - dt.timedelta(days=90, seconds=1),)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    assert recent_window(df, "ts").count() == 2
    d = spark.createDataFrame([(end.date(),), ((end - dt.timedelta(days=90)).date(),), ((end - dt.timedelta(days=91)).date(),)], "d date")
    assert recent_window(d, "d").count() == 2  # inclusive: 91 calendar days


def test_parse_dates_first_value_rule(spark):
    rows = [(1, "25/12/2023"), (2, "2024-01-05"), (3, "2024-01-06"), (4, "2024-01-07")]
    df = spark.createDataFrame(rows, "i int, d string")
    by_order = {r.i: r.d for r in parse_dates(df, "d", order_col="i").collect()}
    assert by_order == {1: dt.date(2023, 12, 25)}  # layout of the first value; others fail
    by_count = {r.i for r in parse_dates(df, "d").collect()}
    assert by_count == {2, 3, 4}  # without an order: the layout parsing most values

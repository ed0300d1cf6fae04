"""Verified keys, joins left out, and bucketed storage."""

import shutil

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF_SMALL
from ledgerline.sources import star
from ledgerline.sources.tables import sales


@pytest.fixture
def tables(tmp_path):
    """A copy of the small star, whose files no other test has verified."""
    for t in star.TABLES:
        shutil.copy(f"{SF_SMALL}/{t}.parquet", tmp_path / f"{t}.parquet")
    return tmp_path


def plan_of(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


KEYS = {"lineitem": "l_discount", "orders": "o_orderkey", "customer": "c_custkey", "nation": "n_nationkey", "region": "r_regionkey", "part": "p_partkey"}


def scanned(df):
    """Tables whose columns the plan reads (long paths are cut in a plan's text)."""
    plan = plan_of(df)
    return {t for t, c in KEYS.items() if f"{c}#" in plan}


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def replaced(spark, folder, name, rows):
    """Another version of a table, in place of the old one."""
    rows.coalesce(1).write.parquet(f"{folder}/new")
    (folder / f"{name}.parquet").unlink()
    shutil.copytree(folder / "new", folder / f"{name}.parquet")


def test_verified_keys_leave_joins_out_and_change_no_row(spark, tables):
    q, d = entry.queries(), str(tables)
    names = ["kpi_totals", "top_products", "monthly_revenue", "category_breakdown", "regional_breakdown", "rfm_base"]
    before = {n: rows_of(q[n](spark, d)) for n in names}
    assert scanned(q["kpi_totals"](spark, d)) == set(KEYS) and not star.verified(spark, d)
    report = {r.foreign_key: r for r in q["star_keys"](spark, d).collect()}
    assert set(report) == star.verified(spark, d) and all(r.missing == r.repeated == 0 for r in report.values())
    assert {n: rows_of(q[n](spark, d)) for n in names} == before
    assert scanned(q["kpi_totals"](spark, d)) == {"lineitem"}
    assert scanned(q["monthly_revenue"](spark, d)) == {"lineitem", "orders"}
    assert scanned(q["regional_breakdown"](spark, d)) == set(KEYS) - {"part"}


def test_changed_files_are_not_verified(spark, tables):
    d = str(tables)
    star.verify(spark, d)
    assert len(star.verified(spark, d)) == 5
    part = spark.read.parquet(f"{SF_SMALL}/part.parquet")
    replaced(spark, tables, "part", part.where("p_partkey % 10 <> 0"))
    assert star.verified(spark, d) == frozenset()
    kept = sales(spark, d, ["revenue"], verified=star.verified(spark, d))
    assert kept.count() == sales(spark, SF_SMALL, ["revenue", "product_id"]).where("product_id % 10 <> 0").count()
    missing = {r.foreign_key: r.missing for r in star.verify(spark, d).collect()}
    assert missing["lineitem.l_partkey"] > 0 and star.verified(spark, d) == {
        "lineitem.l_orderkey", "orders.o_custkey", "customer.c_nationkey", "nation.n_regionkey"
    }
    assert scanned(entry.queries()["kpi_totals"](spark, d)) == {"lineitem", "part"}


def test_repeated_and_missing_keys_are_told_apart(spark, tables):
    d = str(tables)
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    odd = orders.limit(3).unionByName(orders.limit(2).withColumn("o_custkey", F.lit(None).cast("bigint")))
    replaced(spark, tables, "orders", orders.unionByName(odd))
    report = {r.foreign_key: (r.missing, r.repeated) for r in star.verify(spark, d).collect()}
    assert report["lineitem.l_orderkey"] == (0, 5) and report["orders.o_custkey"] == (2, 0)
    assert not {"lineitem.l_orderkey", "orders.o_custkey"} & star.verified(spark, d)


def test_a_registered_result_is_found_without_this_session_s_memory(spark, tables, tmp_path):
    d, root = str(tables), str(tmp_path / "stores")
    star.verify(spark, d, root)
    star._known(spark).clear()
    assert len(star.verified(spark, d, root)) == 5
    assert star.verified(spark, d, str(tmp_path / "elsewhere")) == frozenset()


def test_bucketed_facts_join_without_a_shuffle(spark, tables, tmp_path):
    d, root = str(tables), str(tmp_path / "stores")
    stored = star.ingest(spark, d, root, 4)
    assert len(stored.keys) == 5
    columns = ["date", "customer_id", "region", "category", "revenue", "product_id"]
    assert rows_of(stored.sales(columns)) == rows_of(sales(spark, d, columns))
    joined = stored.sales(["date", "customer_id", "revenue"])
    plan = plan_of(joined)
    assert "SortMergeJoin" in plan and "Exchange" not in plan and plan.count("Bucketed: true") == 2
    assert "Exchange" in plan_of(sales(spark, d, ["date", "customer_id", "revenue"]))
    # another session has no catalog entry
    for name in ("lineitem", "orders"):
        spark.sql(f"DROP TABLE {star._name(stored.id, name)}")
    again = star.attach(spark, stored.id, root)
    assert again.keys == stored.keys and "Exchange" not in plan_of(again.sales(["date", "customer_id", "revenue"]))
    assert rows_of(again.sales(columns)) == rows_of(sales(spark, d, columns))
    star.drop(spark, stored.id, root)
    with pytest.raises(KeyError):
        star.attach(spark, stored.id, root)
    assert spark.read.parquet(f"{d}/lineitem.parquet").count() > 0

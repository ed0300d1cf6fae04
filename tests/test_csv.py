"""CSV files are split unless a quoted field may hold a line break."""

import pytest
from pyspark.sql import functions as F

from ledgerline.sources.csv import as_double, as_long, files_with_broken_lines, infer_column_types, read_csv, refused_types


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a b.csv").write_text('id,name,amount\n1,plain,2.5\n2,"with, comma",3\n3,"say ""hi""",4\n4,too,many,fields\n5,short\n')
    (tmp_path / "broken.csv").write_text('id,name,amount\n6,"two\nlines",1\n7,"a ""b""\n\n,c",2\n8,NA,\n')
    return tmp_path


def test_only_files_with_broken_lines_are_read_whole(spark, folder):
    files, broken = files_with_broken_lines(spark, str(folder))
    assert [f.rsplit("/", 1)[1] for f in files] == ["a b.csv", "broken.csv"]
    assert [f.rsplit("/", 1)[1] for f in broken] == ["broken.csv"]
    got = read_csv(spark, str(folder))
    assert got.dtypes == [("id", "bigint"), ("name", "string"), ("amount", "double")]
    want = [
        (1, "plain", 2.5), (2, "with, comma", 3.0), (3, 'say "hi"', 4.0), (5, "short", None), (6, "two\nlines", 1.0),
        (7, 'a "b"\n\n,c', 2.0), (8, None, None),
    ]
    assert rows_of(got) == sorted(want, key=repr) == rows_of(read_csv(spark, str(folder), multi_line=True))


def test_one_large_file_is_many_tasks(spark, tmp_path):
    spark.range(20_000).selectExpr("id", "concat('name ', id) AS name").coalesce(1).write.option("header", True).csv(str(tmp_path / "big"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        assert read_csv(spark, str(tmp_path / "big")).rdd.getNumPartitions() > 4
        assert read_csv(spark, str(tmp_path / "big"), multi_line=True).rdd.getNumPartitions() == 1
        assert read_csv(spark, str(tmp_path / "big")).count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_files_with_another_header_are_an_error(spark, folder):
    (folder / "other.csv").write_text("id,amount,name\n1,2,x\n")
    with pytest.raises(Exception):
        read_csv(spark, str(folder), infer_types=False).collect()


def test_numbers_are_told_by_their_form_as_by_the_casts(spark):
    odd = [
        "1", " 12 ", "-3", "+4", "1.5", ".5", "5.", "1e5", "1E-5", "1d", "2F", "0x1.8p1", "0X1P-2d", "NaN", "-NaN", "nan", "inf", "+Infinity",
        "-iNf", "\t7\n", "9223372036854775808", "", " ", ".", "1.2.3", "e5", "1995-01-01", "1_0", "1,5", "north", "infinite", "0x10", "١",
        "\x7f12", "1 2", "--1", "1e", "true", "False", "d", "nanny", "\u00a01", "1\x00", "\n", "+", "1e400", "1L", None,
    ]
    df = spark.createDataFrame([(v,) for v in odd], "v string")
    assert df.select(as_double(F.col("v")).alias("d"), F.col("v").try_cast("double").alias("e")).where("not (d <=> e)").count() == 0
    assert df.select(as_long(F.col("v")).alias("d"), F.col("v").try_cast("bigint").alias("e")).where("not (d <=> e)").count() == 0


def test_types_of_all_columns_are_found_at_once(spark):
    rows = spark.createDataFrame([("1", "2", "true", "x", None, "5"), (None, "2.5", "False", "3", None, "nan")], "a string, b string, c string, d string, e string, f string")
    assert infer_column_types(rows).dtypes == [("a", "bigint"), ("b", "double"), ("c", "boolean"), ("d", "string"), ("e", "double"), ("f", "double")]
    assert dict(refused_types(rows).collect()) == {0: 4, 1: 5, 2: 3, 3: 7, 5: 5}
    assert infer_column_types(rows.limit(0)).dtypes == [(c, "double") for c in "abcdef"]

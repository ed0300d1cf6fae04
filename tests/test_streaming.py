from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ledgerline.streaming.ingest import ingest_available


def test_file_drop_ingest_is_incremental(spark, tmp_path):
    src, store, ck = tmp_path / "in", tmp_path / "store", tmp_path / "ck"
    src.mkdir()
    schema = StructType([StructField("date", StringType()), StructField("product", StringType()), StructField("revenue", DoubleType())])
    (src / "a.csv").write_text("date,product,revenue\n2024-01-01,a,1.5\n2024-01-02,NA,2\n2024-01-03,b,3,EXTRA\n")
    ingest_available(spark, str(src), schema, str(store), str(ck))
    assert spark.read.parquet(str(store)).count() == 2
    (src / "b.csv").write_text("date,product,revenue\n2024-01-04,c,4\n")
    ingest_available(spark, str(src), schema, str(store), str(ck))  # only the new file
    df = spark.read.parquet(str(store))
    assert df.count() == 3
    assert df.where("product IS NULL").count() == 1

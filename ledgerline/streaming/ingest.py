"""Incremental file-drop ingest (the upload path, A1/A3, as a stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..sources.csv import NA_VALUES


def csv_drop_stream(spark: SparkSession, src_dir: str, schema: StructType, max_files_per_trigger: int = 100) -> DataFrame:
    """A streaming DataFrame over CSV files dropped into ``src_dir`` (header row, typed schema).

    Rows with more fields than the schema are dropped and NA spellings become NULL, as in the
    batch reader."""
    cols = [f.name for f in schema.fields]
    raw_schema = StructType(schema.fields + [StructField("_corrupt_record", StringType())])
    raw = (
        spark.readStream.option("header", True).option("mode", "PERMISSIVE").option("escape", '"')
        .option("columnNameOfCorruptRecord", "_corrupt_record").option("maxFilesPerTrigger", max_files_per_trigger)
        .schema(raw_schema).csv(src_dir)
    )
    n_fields = F.size(F.split(F.regexp_replace(F.col("_corrupt_record"), '"([^"]|"")*"', ""), ",", -1))
    kept = raw.where(F.col("_corrupt_record").isNull() | (n_fields <= len(cols))).drop("_corrupt_record")
    def na_to_null(c: str):
        if schema[c].dataType.simpleString() != "string":
            return F.col(c)  # typed columns: unparseable text is already NULL
        return F.when(F.col(c).isin(NA_VALUES), F.lit(None).cast("string")).otherwise(F.col(c)).alias(c)

    return kept.select(*[na_to_null(c) for c in cols], F.current_timestamp().alias("ingested_at"))


def ingest_available(spark: SparkSession, src_dir: str, schema: StructType, store_path: str, checkpoint: str,
                     partition_cols: tuple[str, ...] = ()) -> None:
    """Process every file present now (``availableNow``), append to ``store_path``, stop.

    The checkpoint (in a shared folder) records which files were committed, so a rerun after a
    failure neither loses nor duplicates rows."""
    stream = csv_drop_stream(spark, src_dir, schema)
    writer = (
        stream.writeStream.format("parquet").option("path", store_path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True)
    )
    if partition_cols:
        writer = writer.partitionBy(*partition_cols)
    q = writer.start()
    q.awaitTermination()

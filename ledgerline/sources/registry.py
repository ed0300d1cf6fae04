"""Dataset registry and result stores (A3-A12) as Parquet tables in a shared folder.

Tables are append-only: a dataset drop appends a tombstone, readers take the latest state per
id, so no reader ever sees a half-rewritten table. The store's folder is given by the caller or by
``spark.ledgerline.store.root``, so that it outlives the session.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from typing import Optional

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, TimestampNTZType, TimestampType

from ..functions.roles import detect_column_types
from ..operators.series import as_date

RECENT_RUNS = 50  # fixed value: the run list shows the newest 50


def store_root(spark: SparkSession, root: Optional[str] = None) -> str:
    """The stores' folder: ``root``, else the session's ``spark.ledgerline.store.root``. It outlives
    sessions, so it is never made up."""
    root = root or spark.conf.get("spark.ledgerline.store.root", None)
    if not root:
        raise ValueError("give the stores' folder as root or in spark.ledgerline.store.root")
    return root.rstrip("/")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _now() -> _dt.datetime:
    return _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)


def ingest(spark: SparkSession, df: DataFrame, name: str, filename: str = "", root: Optional[str] = None) -> dict:
    """Store a table as Parquet and register it (A3): counts and date range are observed while
    writing, so the table is read once."""
    roles = detect_column_types(df.schema)
    date_col = next((c for c, r in roles.items() if r == "date"), None)
    ds_id = uuid.uuid4().hex[:12]
    path = f"{store_root(spark, root)}/datasets/{ds_id}"
    if date_col is not None and isinstance(df.schema[date_col].dataType, (StringType, DateType, TimestampType, TimestampNTZType)):
        df = df.withColumn("__day", as_date(df, date_col))
    else:  # a table without dates, or a date-like name on another kind of column: no date range
        df = df.withColumn("__day", F.lit(None).cast("date"))
    d = F.col("__day")
    obs = Observation(f"ingest_{ds_id}")
    df.observe(obs, F.count(F.lit(1)).alias("rows"), F.min(d).alias("start"), F.max(d).alias("end")).drop("__day").write.mode("error").parquet(path)
    m = obs.get
    row = {
        "id": ds_id, "name": name, "filename": filename, "path": path, "row_count": int(m["rows"]),
        "column_count": len(df.columns) - 1, "date_start": m["start"], "date_end": m["end"],
        "columns_info": roles, "column_order": df.columns[:-1], "created_at": _now(), "deleted": False,
    }
    _append(spark, "datasets", [row], root)
    return row


_DATASET_SCHEMA = (
    "id string, name string, filename string, path string, row_count bigint, column_count bigint, "
    "date_start date, date_end date, columns_info map<string,string>, column_order array<string>, "
    "created_at timestamp_ntz, deleted boolean"
)
_RUN_SCHEMA = (
    "job_id string, dataset_id string, model_type string, status string, date_column string, "
    "target_column string, horizon int, metrics map<string,double>, feature_importance map<string,double>, "
    "error_message string, created_at timestamp_ntz, completed_at timestamp_ntz"
)
_COMPARISON_SCHEMA = (
    "comparison_id string, dataset_id string, model string, status string, mae double, rmse double, "
    "r2 double, mape double, error string, best_model string, created_at timestamp_ntz"
)
_STAR_SCHEMA = (
    "id string, fingerprint string, path string, keys array<string>, buckets int, created_at timestamp_ntz, deleted boolean"
)
_SCHEMAS = {"datasets": _DATASET_SCHEMA, "runs": _RUN_SCHEMA, "comparisons": _COMPARISON_SCHEMA, "stars": _STAR_SCHEMA}


def _append(spark: SparkSession, table: str, rows: list[dict], root: Optional[str]) -> None:
    """Append registry rows (metadata only: a handful of rows per call)."""
    df = spark.createDataFrame(rows, _SCHEMAS[table])
    df.write.mode("append").parquet(f"{store_root(spark, root)}/{table}")


def _table(spark: SparkSession, table: str, root: Optional[str]) -> DataFrame:
    path = f"{store_root(spark, root)}/{table}"
    if not _exists(spark, path):
        return spark.createDataFrame([], _SCHEMAS[table])
    return spark.read.schema(_SCHEMAS[table]).parquet(path)


def list_datasets(spark: SparkSession, root: Optional[str] = None) -> DataFrame:
    """Live datasets, newest first (A4): latest state per id, tombstones removed."""
    t = _table(spark, "datasets", root)
    w = Window.partitionBy("id").orderBy(F.col("created_at").desc(), F.col("deleted").desc())
    latest = t.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return latest.where(~F.col("deleted")).orderBy(F.col("created_at").desc())


def get_dataset(spark: SparkSession, ds_id: str, root: Optional[str] = None) -> dict:
    """Point lookup (A5); a missing id raises ``KeyError``."""
    rows = list_datasets(spark, root).where(F.col("id") == ds_id).limit(1).collect()
    if not rows:
        raise KeyError(f"Dataset not found: {ds_id}")
    return rows[0].asDict()


def load_dataset(spark: SparkSession, ds_id: str, root: Optional[str] = None) -> DataFrame:
    return spark.read.parquet(get_dataset(spark, ds_id, root)["path"])


def drop_dataset(spark: SparkSession, ds_id: str, root: Optional[str] = None) -> None:
    """Delete the stored copy we wrote and tombstone the registry row.
    The user's original source file is never touched."""
    row = get_dataset(spark, ds_id, root)
    if _exists(spark, row["path"]):
        _delete(spark, row["path"])
    row.update(deleted=True, created_at=_now())
    _append(spark, "datasets", [row], root)


# ---- forecast runs and results --------------------------------------------------------------------


def write_forecast(points: DataFrame, job_id: str, root: Optional[str] = None) -> None:
    """Append historical + future points of one run, partitioned by job."""
    spark = points.sparkSession
    points.withColumn("job_id", F.lit(job_id)).write.mode("append").partitionBy("job_id").parquet(
        f"{store_root(spark, root)}/forecast_results"
    )


def read_forecast(spark: SparkSession, job_id: str, root: Optional[str] = None) -> DataFrame:
    """Points of one run by date (A8); the job filter prunes partitions."""
    path = f"{store_root(spark, root)}/forecast_results"
    df = spark.read.parquet(path).where(F.col("job_id") == job_id)
    return df.withColumn("is_future", F.col("is_future").cast("boolean")).orderBy("date")


def record_run(spark: SparkSession, run: dict, root: Optional[str] = None) -> None:
    base = {k: None for k in [f.split()[0] for f in _RUN_SCHEMA.split(", ")]}
    base.update(run)
    _append(spark, "runs", [base], root)


def recent_runs(spark: SparkSession, root: Optional[str] = None, n: int = RECENT_RUNS) -> DataFrame:
    """Newest runs first."""
    return _table(spark, "runs", root).orderBy(F.col("created_at").desc(), F.col("job_id")).limit(n)


def completed_runs(spark: SparkSession, root: Optional[str] = None) -> DataFrame:
    """Runs with status 'completed' (B17)."""
    return _table(spark, "runs", root).where(F.col("status") == "completed")


def runs_with_dataset(spark: SparkSession, root: Optional[str] = None) -> DataFrame:
    """Runs joined to their dataset row (C3): an equi join on the dataset id."""
    ds = list_datasets(spark, root).select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name"))
    return _table(spark, "runs", root).join(ds, "dataset_id", "left")


def record_comparison(comparison: DataFrame, dataset_id: str, root: Optional[str] = None) -> str:
    """Append the per-model rows of ``compare_models`` with their best model (A10).

    Written straight from the DataFrame (series x models rows), never through the driver."""
    spark = comparison.sparkSession
    cid = uuid.uuid4().hex[:12]
    cols = [f.split()[0] for f in _COMPARISON_SCHEMA.split(", ")]
    out = comparison.select(
        F.lit(cid).alias("comparison_id"), F.lit(dataset_id).alias("dataset_id"),
        *[F.col(c) for c in ("model", "status", "mae", "rmse", "r2", "mape", "error", "best_model")],
        F.lit(_now()).cast("timestamp_ntz").alias("created_at"),
    ).select(*cols)
    out.write.mode("append").parquet(f"{store_root(spark, root)}/comparisons")
    return cid


def comparisons(spark: SparkSession, root: Optional[str] = None) -> DataFrame:
    return _table(spark, "comparisons", root)


def write_report_csv(report: DataFrame, path: str) -> None:
    """Report rows as one CSV file with a header (A11); the report is a few dozen rows."""
    report.orderBy("line").coalesce(1).write.mode("overwrite").option("header", True).csv(path)

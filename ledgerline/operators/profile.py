"""Dataset profile (D17-D21, F11): one aggregation per concern, whatever the column count."""

from __future__ import annotations

from typing import Optional, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import quantiles
from ..functions.numeric import without_nan
from ..session import stored
from .clean import numeric_columns, string_columns
from .series import as_date


#: Counters of a heavy-hitter sketch, and the relative standard deviation of a distinct count.
TRACKED, DISTINCT_ERROR = 10_000, 0.02


def _long(df: DataFrame, cols: Sequence[str], cast: str) -> DataFrame:
    body = ", ".join(f"'{c}', cast(`{c}` as {cast})" for c in cols)
    return df.selectExpr(f"stack({len(cols)}, {body}) as (column, v)")


def numeric_profile(df: DataFrame, cols: Optional[Sequence[str]] = None) -> DataFrame:
    """column, mean, median, std (sample), min, max per numeric column.

    The columns are written once, NaN as NULL; one wide aggregate over them gives the moments and
    counts (no unpivot, no shuffle), and the medians are exact order statistics
    (``functions.ranking``). The result holds one row per column.
    """
    cols = list(cols) if cols is not None else numeric_columns(df)
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "column string, mean double, median double, std double, min double, max double")
    df = stored(without_nan(df.select(*[F.col(c).cast("double").alias(c) for c in cols])))
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(cols):
        v = F.col(c).cast("double")
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"a{i}"),
                 F.stddev_samp(v).alias(f"s{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    r = df.agg(*aggs).collect()[0]
    stats = {c: {"n": int(r[f"n{i}"]), "nulls": int(r["__rows"]) - int(r[f"n{i}"])} for i, c in enumerate(cols)}
    med = quantiles(df, cols, [0.5], stats)
    rows = [(c, r[f"a{i}"], med[c][0], r[f"s{i}"], r[f"lo{i}"], r[f"hi{i}"]) for i, c in enumerate(cols)]
    return spark.createDataFrame(rows, "column string, mean double, median double, std double, min double, max double")


def categorical_profile(df: DataFrame, cols: Optional[Sequence[str]] = None, k: int = 5) -> DataFrame:
    """column, unique_count, rank, value, n: distinct count and the k most frequent values.

    Ties are broken by value. The top-k runs in two steps so that no column's values meet in
    one task: top-k inside hash buckets of the value, then top-k over at most k x buckets rows.
    """
    cols = list(cols) if cols is not None else string_columns(df)
    counts = _long(df, cols, "string").where(F.col("v").isNotNull()).groupBy("column", "v").agg(
        F.count(F.lit(1)).cast("bigint").alias("n")
    )
    uniq = counts.groupBy("column").agg(F.count(F.lit(1)).cast("bigint").alias("unique_count"))
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("n").desc(), F.col("v").asc()]
    local = counts.withColumn("_b", F.pmod(F.xxhash64("v"), F.lit(buckets)))
    local = local.withColumn("_r", F.row_number().over(Window.partitionBy("column", "_b").orderBy(*order))).where(F.col("_r") <= k)
    top = local.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(*order)).cast("bigint")).where(F.col("rank") <= k)
    return top.join(uniq, "column").select("column", "unique_count", "rank", F.col("v").alias("value"), "n")


def categorical_sketch(
    df: DataFrame, cols: Optional[Sequence[str]] = None, k: int = 5, tracked: int = TRACKED, rsd: float = DISTINCT_ERROR,
) -> DataFrame:
    """``categorical_profile`` from sketches: column, unique_count, rank, value, n, for columns of very many values.

    One pass merges a HyperLogLog++ sketch (``unique_count``: relative standard deviation ``rsd``) and a
    heavy-hitter sketch of ``tracked`` counters per column; a second pass counts the values that the sketches
    hold, at most 4 k or 20 per column, so every n is exact. A value is among them for sure if it makes up more
    than 4 in ``tracked`` of its column's rows. Nothing grows with the number of different values.
    """
    cols = list(cols) if cols is not None else string_columns(df)
    names = df.select(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(cols)])
    held = max(20, 4 * k)
    found = names.agg(*[
        x for i in range(len(cols))
        for x in (F.approx_count_distinct(f"c{i}", rsd).alias(f"u{i}"), F.expr(f"approx_top_k(c{i}, {held}, {max(tracked, held)})").alias(f"t{i}"))
    ]).first()
    spark = df.sparkSession
    values = [(i, x["item"]) for i in range(len(cols)) for x in found[f"t{i}"] or [] if x["item"] is not None]
    wanted = spark.createDataFrame(values, "at int, v string")  # a few values per column
    each = F.array(*[F.struct(F.lit(i).alias("at"), F.col(f"c{i}").alias("v")) for i in range(len(cols))])
    rows = names.select(F.inline(each)).join(F.broadcast(wanted), ["at", "v"])
    counts = rows.groupBy("at", "v").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    order = Window.partitionBy("at").orderBy(F.col("n").desc(), F.col("v").asc())
    top = counts.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)
    known = spark.createDataFrame([(i, c, int(found[f"u{i}"])) for i, c in enumerate(cols)], "at int, column string, unique_count long")
    return top.join(F.broadcast(known), "at").select("column", "unique_count", "rank", F.col("v").alias("value"), "n")


def missing_counts(df: DataFrame) -> DataFrame:
    """column, missing: count of NULL and NaN in every column."""
    df = without_nan(df)
    cols = df.columns
    agg = df.agg(*[(F.count(F.lit(1)) - F.count(F.col(c))).cast("bigint").alias(c) for c in cols])
    body = ", ".join(f"'{c}', `{c}`" for c in cols)
    return agg.selectExpr(f"stack({len(cols)}, {body}) as (column, missing)")


def shape(df: DataFrame) -> DataFrame:
    """rows and columns of a table."""
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("rows")).withColumn("columns", F.lit(len(df.columns)).cast("bigint"))


def dtypes(df: DataFrame) -> list[tuple[str, str]]:
    """Column types, from the schema (no job)."""
    return list(df.dtypes)


def date_range(df: DataFrame, date_col: str) -> DataFrame:
    """start, end of the date column."""
    d = as_date(df, date_col)
    return df.agg(F.min(d).alias("start"), F.max(d).alias("end"))


def target_stats(df: DataFrame, target_col: str) -> DataFrame:
    """total, mean, max, min of the target."""
    t = F.nanvl(F.col(target_col).cast("double"), F.lit(None).cast("double"))
    return df.agg(F.coalesce(F.sum(t), F.lit(0.0)).alias("total"), F.avg(t).alias("mean"), F.max(t).alias("max"), F.min(t).alias("min"))

"""Isolation-forest anomaly detection on the values of a series.

1. Sample: the rows of a series with the smallest hashes, trees x sample of them, chosen before they are shuffled; each
   tree draws its days from them (a series with fewer rows gives all).
2. Forest: a tree on one value cuts the line into intervals, so the sum of all path lengths is a step function
   of the value. One grouped map per series builds it from the pool: at most trees x sample steps.
3. Scores: the step functions are broadcast if they are small enough, and rows are scored where they lie; else
   rows and steps are sorted together by series, a series spread over salts, and scored as they stream by.
4. Threshold: a score is one of as many values as there are steps, so the exact contamination quantile, the
   mean and the spread are partial aggregates.

No task holds the rows of a series, so tables of single transactions can be searched as well as daily totals.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..session import ship_package, stored
from .series import as_date, rollup

# ---- fixed values: isolation-forest settings of the original detector and its texts ------------
N_TREES, SAMPLE_SIZE, CONTAMINATION, SEED = 100, 256, 0.05, 42
HIGH_TEXT = "Unusually high sales: %s (avg: %s)"
LOW_TEXT = "Unusually low sales: %s (avg: %s)"
HIGH_SIGMAS = 2.0
# ---------------------------------------------------------------------------------------------------
EULER = 0.5772156649
#: Steps (16 bytes each) of all series that are broadcast at most.
BROADCAST_STEPS = 4_000_000


def avg_path(n: float) -> float:
    """Average unsuccessful-search path length c(n) of a binary search tree (Liu et al. 2008)."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def _steps(sample: np.ndarray, rng: np.random.Generator) -> tuple[list[float], list[float]]:
    """Cuts of one isolation tree on ``sample`` in order, and the path length before, between and after them."""
    limit = int(math.ceil(math.log2(max(len(sample), 2))))
    cuts: list[float] = []
    lengths: list[float] = []

    def grow(s: np.ndarray, depth: int) -> None:
        if depth >= limit or len(s) <= 1 or s.min() == s.max():
            lengths.append(depth + avg_path(len(s)))
            return
        cut = rng.uniform(s.min(), s.max())
        # the left part draws its cuts first, and cuts and lengths come out in order of the value
        grow(s[s < cut], depth + 1)
        cuts.append(cut)
        grow(s[s >= cut], depth + 1)

    grow(sample, 0)
    return cuts, lengths


def forest_steps(pool: np.ndarray, n_trees: int, sample_size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Cuts of all trees in order, and the mean path length before, between and after them."""
    trees = []
    for tree in range(n_trees):
        rng = np.random.default_rng([seed, tree])
        trees.append(_steps(pool[rng.choice(len(pool), min(sample_size, len(pool)), replace=False)], rng))
    cuts = np.unique(np.concatenate([np.asarray(c, dtype=float) for c, _ in trees]))
    at = np.concatenate([[-np.inf], cuts])
    total = sum(np.asarray(lengths)[np.searchsorted(c, at, side="right")] for c, lengths in trees)
    return cuts, total / n_trees


def fit_forest(ts: DataFrame, series_cols: Sequence[str], n_trees: int, sample_size: int, seed: int) -> DataFrame:
    """key columns, cuts, lengths, psi (rows of a sample): one row per series; ``series_cols`` must not be empty."""
    s = list(series_cols)
    size = n_trees * sample_size
    # hashes as numbers from 0 to 1; those beyond twice the wanted share go before anything is shuffled
    spread = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *ts.columns), 11) / F.lit(float(1 << 53))
    share = ts.groupBy(*s).agg((F.lit(2.0 * size) / F.count(F.lit(1))).alias("_share"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in s]
    near = ts.withColumn("_hash", spread).alias("r").join(share.alias("t"), same).where("_hash < _share").select("r.*")
    first = F.row_number().over(Window.partitionBy(*s).orderBy("_hash", "ds", "y"))
    pool = near.withColumn("_place", first).where(F.col("_place") <= size)
    schema = StructType([ts.schema[c] for c in s] + [
        StructField("cuts", ArrayType(DoubleType())), StructField("lengths", ArrayType(DoubleType())), StructField("psi", LongType()),
    ])

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values(["ds", "y"])["y"].to_numpy(dtype=float)
        cuts, lengths = forest_steps(values, n_trees, sample_size, seed)
        row = {c: [pdf[c].iloc[0]] for c in s}
        return pd.DataFrame({**row, "cuts": [cuts], "lengths": [lengths], "psi": [min(sample_size, len(values))]})

    return pool.select(*s, "ds", "y").groupBy(*s).applyInPandas(build, schema)


def score_rows(ts: DataFrame, forest: DataFrame, series_cols: Sequence[str], broadcast_steps: int = BROADCAST_STEPS) -> DataFrame:
    """``ts`` with each row's mean path length (_eh) and its series' sample size (_psi)."""
    s = list(series_cols)
    schema = StructType([*ts.schema.fields, StructField("_eh", DoubleType()), StructField("_psi", LongType())])
    columns = ts.columns

    def scored(rows: pd.DataFrame, cuts, lengths, psi) -> pd.DataFrame:
        at = np.searchsorted(np.asarray(cuts), rows["y"].to_numpy(dtype=float), side="right")
        return rows[columns].assign(_eh=np.asarray(lengths)[at], _psi=psi)

    if (forest.agg(F.sum(F.size("lengths"))).first()[0] or 0) <= broadcast_steps:
        known = {tuple(r[c] for c in s): (np.array(r["cuts"]), np.array(r["lengths"]), r["psi"]) for r in forest.collect()}
        sent = ts.sparkSession.sparkContext.broadcast(known)

        def where_they_lie(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                keys = batch[s].astype(object).where(batch[s].notna(), None)
                for key, at in batch.groupby([keys[c] for c in s], dropna=False, sort=False).indices.items():
                    key = key if isinstance(key, tuple) else (key,)
                    key = tuple(None if pd.isna(k) else k for k in key)
                    yield scored(batch.iloc[at], *sent.value[key])

        return ts.mapInPandas(where_they_lie, schema)

    salts = max(1, int(ts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    empty = [F.lit(None).cast(forest.schema[c].dataType).alias(c) for c in ("cuts", "lengths", "psi")]
    rows = ts.select("*", *empty, F.pmod(F.xxhash64("ds", "y"), F.lit(salts)).cast("int").alias("_salt"))
    steps = forest.select(
        *[F.col(c) if c in s else F.lit(None).cast(ts.schema[c].dataType).alias(c) for c in columns], "cuts", "lengths", "psi",
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"),
    )
    both = rows.unionByName(steps).repartition(*s, "_salt").sortWithinPartitions(*s, "_salt", F.col("cuts").isNull())

    def as_they_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for batch in batches:
            heads = np.flatnonzero(batch["cuts"].notna().to_numpy())
            for begin, end in zip([0, *heads], [*heads, len(batch)]):
                part = batch.iloc[begin:end]
                if len(part) and part["cuts"].iloc[0] is not None:
                    now, part = part.iloc[0], part.iloc[1:]
                if len(part):
                    yield scored(part, now["cuts"], now["lengths"], now["psi"])

    return both.mapInPandas(as_they_pass, schema)


def detect_anomalies(
    ts: DataFrame, series_cols: Sequence[str] = (), n_trees: int = N_TREES,
    sample_size: int = SAMPLE_SIZE, contamination: float = CONTAMINATION, seed: int = SEED,
) -> DataFrame:
    """series..., date, value, is_anomaly, anomaly_score, description for every row of (series..., ds, y).

    Rows without a value have no score and are left out.
    """
    s = list(series_cols)
    ship_package(ts.sparkSession)
    rows = ts.select(*s, "ds", F.col("y").cast("double").alias("y")).where(F.col("y").isNotNull() & ~F.isnan("y"))
    rows = stored(rows if s else rows.withColumn("_series", F.lit(0)))
    keys = s or ["_series"]
    agg = stored(score_rows(rows, stored(fit_forest(rows, keys, n_trees, sample_size, seed)), keys))
    n = F.col("_psi").cast("double")
    c_psi = F.when(n <= 1, 0.0).when(n == 2, 1.0).otherwise(2.0 * (F.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n)
    score = F.pow(F.lit(2.0), -F.col("_eh") / c_psi)
    res = agg.select(*keys, "ds", "y", (-score).alias("_ss"))
    # offset = contamination quantile of the score samples, per series: as many values as steps at most
    stats = res.groupBy(*keys).agg(
        F.percentile("_ss", F.lit(contamination)).alias("_off"), F.avg("y").alias("_mean"), F.stddev_pop("y").alias("_std"),
    )
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in keys]
    res = res.alias("r").join(stats.alias("t"), same).select("r.*", "_off", "_mean", "_std")
    decision = F.col("_ss") - F.col("_off")
    is_anom = decision < 0
    fmt0 = lambda c: F.format_string("%.0f", F.round(c.try_cast("decimal(38,10)"), 0).cast("double"))
    desc = F.when(
        is_anom,
        F.when(F.col("y") > F.col("_mean") + HIGH_SIGMAS * F.col("_std"), F.format_string(HIGH_TEXT, fmt0(F.col("y")), fmt0(F.col("_mean"))))
        .otherwise(F.format_string(LOW_TEXT, fmt0(F.col("y")), fmt0(F.col("_mean")))),
    )
    return res.select(
        *s, F.col("ds").alias("date"), F.col("y").alias("value"), is_anom.alias("is_anomaly"),
        F.abs(decision).alias("anomaly_score"), desc.alias("description"),
    )


def transaction_anomalies(df: DataFrame, date_col: str, target_col: str, series_cols: Sequence[str] = ()) -> DataFrame:
    """Anomalies among single rows instead of daily totals."""
    rows = df.select(*series_cols, as_date(df, date_col).alias("ds"), F.col(target_col).cast("double").alias("y"))
    return detect_anomalies(rows, series_cols)


def anomalies_only(result: DataFrame) -> DataFrame:
    """Rows flagged as anomalies."""
    return result.where(F.col("is_anomaly"))


def anomaly_counts(result: DataFrame, series_cols: Sequence[str] = ()) -> DataFrame:
    """Total days and detected anomalies per series."""
    return result.groupBy(*series_cols).agg(
        F.count(F.lit(1)).cast("bigint").alias("total_points"),
        F.count_if(F.col("is_anomaly")).cast("bigint").alias("anomalies_detected"),
    )


def daily_anomalies(df: DataFrame, date_col: str, target_col: str, series_cols: Sequence[str] = ()) -> DataFrame:
    return detect_anomalies(rollup(df, date_col, target_col, "D", series_cols), series_cols)

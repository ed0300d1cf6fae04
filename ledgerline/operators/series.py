"""Gap-filled series, calendar/lag/rolling features, splits and windows
(C1, D8-D10, E1-E4, E7, E8, H7, M1, M9).

A series table is ``(series_cols..., ds date, y double)``. ``series_cols=[]`` is one global
series (the original application's case); any key list gives many series at once. Windows
are partitioned by the series key, so work spreads over series; the global case orders
only the rolled-up calendar (one row per day), never raw rows.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import (
    CALENDAR_FEATURES, FEATURES, LAGS, ROLLING_WINDOWS, calendar_columns, resolved_timestamp, week_ending_sunday,
)

_STEP = {"D": "interval 1 day", "W": "interval 7 days", "M": "interval 1 month"}
_DAYS = {"D": 1, "W": 7}


def as_date(df: DataFrame, col: str) -> Column:
    """A date/timestamp/string column as DATE; strings by the layout found for the column."""
    dt = df.schema[col].dataType.simpleString()
    c = F.col(col)
    if dt == "date":
        return c
    if dt.startswith("timestamp"):
        return c.cast("date")
    return F.to_date(resolved_timestamp(df, col))


def _bucket(d: Column, freq: str) -> Column:
    if freq == "D":
        return d
    if freq == "W":
        return week_ending_sunday(d)  # weeks end on Sunday and carry its date
    if freq == "M":
        return F.trunc(d, "MM")  # shown as month end below
    raise ValueError(f"freq must be D, W or M, not {freq!r}")


def rollup(
    df: DataFrame, date_col: str, value_col: str, freq: str = "D", series_cols: Sequence[str] = (),
    keep_decimal: bool = False,
) -> DataFrame:
    """Sum of ``value_col`` per period with missing periods filled with 0 (D8-D10 + C1).

    Plan: partial+final aggregate to one row per (series, period), then each row emits itself and
    the empty periods up to the next one (``lead``), in the same partitioning: one scan of the
    input, no join. A row emits as many periods as its gap has, bounded by the calendar.

    ``keep_decimal`` keeps an exact decimal ``y`` for decimal money columns, so later window
    sums are exact; otherwise ``y`` is double.
    """
    s = list(series_cols)
    d = as_date(df, date_col)
    keep = d.isNotNull()
    for c in s:
        keep = keep & F.col(c).isNotNull()  # groupby drops null keys
    agg = (
        df.where(keep)
        .groupBy(*[F.col(c) for c in s], _bucket(d, freq).alias("_k"))
        .agg(F.sum(F.col(value_col)).alias("y"))
    )
    following = F.lead("_k").over(Window.partitionBy(*s).orderBy("_k"))
    until = F.add_months(following, -1) if freq == "M" else F.date_sub(following, _DAYS[freq])
    periods = F.sequence(F.col("_k"), F.coalesce(F.col("_until"), F.col("_k")), F.expr(_STEP[freq]))
    out = agg.withColumn("_until", until).select(*s, "y", F.posexplode(periods).alias("_pos", "_p"))
    ds = F.last_day("_p") if freq == "M" else F.col("_p")
    kind = agg.schema["y"].dataType
    zero = F.lit(0).cast(kind)
    y = F.when(F.col("_pos") == 0, F.coalesce(F.col("y"), zero)).otherwise(zero)
    is_dec = kind.simpleString().startswith("decimal")
    return out.select(*s, ds.alias("ds"), (y if (keep_decimal and is_dec) else y.cast("double")).alias("y"))


def _w(series_cols: Sequence[str]) -> Window:
    return Window.partitionBy(*series_cols).orderBy("ds")


def with_calendar(ts: DataFrame, ds: str = "ds") -> DataFrame:
    """Append the 15 calendar features (H7)."""
    return ts.select("*", *calendar_columns(ds))


def with_lags(ts: DataFrame, series_cols: Sequence[str] = (), y: str = "y") -> DataFrame:
    """Lags 1/7/14/30 and rolling mean / sample std over the previous 7/14/30 rows.

    A rolling value exists only once its window is full, as with a fixed-size rolling window.
    A decimal ``y`` gives exact window sums (the mean is sum / n); output columns are double.
    """
    w = _w(series_cols)
    cols = [F.lag(y, k).over(w).cast("double").alias(f"lag_{k}") for k in LAGS]
    for n in ROLLING_WINDOWS:
        frame = w.rowsBetween(-n, -1)
        full = F.count(y).over(frame) == n
        mean = F.sum(y).over(frame).cast("double") / F.lit(float(n))
        cols.append(F.when(full, mean).alias(f"rolling_mean_{n}"))
        cols.append(F.when(full, F.stddev_samp(F.col(y).cast("double")).over(frame)).alias(f"rolling_std_{n}"))
    others = [F.col(c).cast("double").alias(c) if c == y else F.col(c) for c in ts.columns]
    return ts.select(*others, *cols)


def feature_table(ts: DataFrame, series_cols: Sequence[str] = ()) -> DataFrame:
    """Calendar + lag/rolling features without the warm-up rows (M1 = H7 + E1-E4)."""
    ft = with_lags(with_calendar(ts), series_cols)
    cond = F.lit(True)
    for f in FEATURES:
        cond = cond & F.col(f).isNotNull()
    return ft.where(cond).select(*series_cols, "ds", "y", *FEATURES)


def chrono_split(ts: DataFrame, series_cols: Sequence[str] = (), train_frac: float = 0.8) -> DataFrame:
    """Flag the first ``floor(train_frac * n)`` rows of each series as training rows."""
    w = _w(series_cols)
    n = F.count(F.lit(1)).over(Window.partitionBy(*series_cols))
    return ts.select(
        "*", (F.row_number().over(w) <= F.floor(F.lit(float(train_frac)) * n)).alias("is_train")
    )


def sequence_windows(ts: DataFrame, series_cols: Sequence[str] = (), length: int = 30) -> DataFrame:
    """For each row with ``length`` earlier values: one output row per earlier value.

    Flat form: (series..., ds, label, pos, value), pos 1 = oldest, ``length`` = previous day.
    """
    w = _w(series_cols).rowsBetween(-length, -1)
    hist = ts.select(*series_cols, "ds", F.col("y").alias("label"), F.collect_list("y").over(w).alias("_h"))
    return hist.where(F.size("_h") == length).select(
        *series_cols, "ds", "label", F.posexplode("_h").alias("pos", "value")
    ).withColumn("pos", (F.col("pos") + 1).cast("int"))


def zscore(ts: DataFrame, series_cols: Sequence[str] = (), y: str = "y") -> DataFrame:
    """(y - mean) / population std per series (M9); std 0 scales to 0."""
    w = Window.partitionBy(*series_cols)
    mu = F.avg(y).over(w)
    sd = F.stddev_pop(y).over(w)
    return ts.select(
        "*", mu.alias("y_mean"), sd.alias("y_std"),
        F.when(sd > 0, (F.col(y) - mu) / sd).otherwise(F.lit(0.0)).alias("y_scaled"),
    )


__all__ = [
    "rollup", "with_calendar", "with_lags", "feature_table", "chrono_split", "sequence_windows",
    "zscore", "as_date", "CALENDAR_FEATURES", "FEATURES",
]

"""Typing, date parsing and cleaning.

Cleaning is one selection of order statistics whatever the number of columns: medians, and
the quartiles of the imputed columns, come from the same passes. NaN counts as missing. The de-duplicated table is written once, its input rows are counted
on the way, and later steps read the columns they need from it.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Optional, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, NumericType, StringType

from ..functions.dates import DATE_PATTERNS, resolved_timestamp
from ..functions.numeric import without_nan
from ..functions.ranking import column_stats, quantiles
from ..session import stored

# fixed values of the original cleaning rules
UNKNOWN = "Unknown"
IQR_FACTOR = 3.0


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (NumericType, DecimalType))]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


# ---- dates --------------------------------------------------------------------------------------


def parse_dates(df: DataFrame, col: str, out: Optional[str] = None, patterns: Sequence[str] = DATE_PATTERNS,
                order_col: Optional[str] = None, drop_invalid: bool = True, keep_time: bool = False) -> DataFrame:
    """Parse a date column with the layout found for it; unparseable values become NULL and,
    with ``drop_invalid``, their rows are dropped (B5, B7). Dates and timestamps are taken as they
    are. The result is a DATE, or with ``keep_time`` a TIMESTAMP unless the column holds dates."""
    out = out or col
    kind = df.schema[col].dataType
    if isinstance(kind, StringType):
        parsed = resolved_timestamp(df, col, patterns, order_col)
    else:
        parsed = F.col(col).cast("timestamp" if kind.simpleString().startswith("timestamp") else "date")
    res = df.withColumn(out, parsed if keep_time else F.to_date(parsed))
    return res.where(F.col(out).isNotNull()) if drop_invalid else res


def coerce_dates(df: DataFrame, col: str, pattern: Optional[str] = None, out: Optional[str] = None) -> DataFrame:
    """Parse with one layout, or the one found for the column; values that fail become NULL."""
    if pattern:
        parsed = F.try_to_timestamp(F.col(col).cast("string"), F.lit(pattern))
    elif isinstance(df.schema[col].dataType, StringType):
        parsed = resolved_timestamp(df, col)
    else:
        parsed = F.col(col)
    return df.withColumn(out or col, F.to_date(parsed))


# ---- cleaning -------------------------------------------------------------------------------------


def dedupe(df: DataFrame) -> DataFrame:
    """Exact duplicate rows removed; NULLs compare equal."""
    return df.dropDuplicates()


@dataclass
class Cleaned:
    deduped: DataFrame
    imputed: DataFrame
    filled: DataFrame
    cleaned: DataFrame
    report: DataFrame


def clean(df: DataFrame) -> Cleaned:
    """Dedupe, median-fill numbers, 'Unknown'-fill strings, cap at Q1-3·IQR / Q3+3·IQR.

    Numeric columns come out as double; booleans are neither numbers nor strings and stay as they
    are. The report has rows (issue, column, n).
    """
    num = numeric_columns(df)
    txt = string_columns(df)
    counted = Observation()
    deduped = stored(dedupe(without_nan(df).observe(counted, F.count(F.lit(1)).alias("rows"))))
    raw_rows = int(counted.get["rows"])
    stats = column_stats(deduped, num)
    # the median of the values, and the quartiles of the imputed column, from one selection
    found = {c: q for c, q in quantiles(deduped, num, [0.25, 0.5, 0.75], stats, impute=True).items()}
    med = {c: q[1] for c, q in found.items()}

    def fill_num(c: str) -> Column:
        m = med[c]
        v = F.col(c).cast("double")
        return (F.coalesce(v, F.lit(float(m))) if m is not None else v).alias(c)

    def fill_txt(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(UNKNOWN)).alias(c)

    imputed = deduped.select(*[fill_num(c) if c in num else F.col(c) for c in deduped.columns])
    filled = imputed.select(*[fill_txt(c) if c in txt else F.col(c) for c in imputed.columns])
    bounds = {}
    for c in num:
        q1, _, q3 = found[c]
        if q1 is None:
            continue
        iqr = q3 - q1
        bounds[c] = (q1 - IQR_FACTOR * iqr, q3 + IQR_FACTOR * iqr)

    def cap(c: str) -> Column:
        if c not in bounds:
            return F.col(c)
        lo, hi = bounds[c]
        return F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi)).alias(c)

    cleaned = filled.select(*[cap(c) if c in num else F.col(c) for c in filled.columns])
    report = _report(raw_rows, deduped, imputed, num, txt, bounds)
    return Cleaned(deduped, imputed, filled, cleaned, report)


def _stack(df: DataFrame, issue: str, cols: list[str]) -> DataFrame:
    """One-row aggregate with a column per input column -> rows (issue, column, n)."""
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "issue string, column string, n bigint")
    body = ", ".join(f"'{c}', cast(`{c}` as bigint)" for c in cols)
    return df.selectExpr(f"stack({len(cols)}, {body}) as (column, n)").select(F.lit(issue).alias("issue"), "column", "n")


def _report(raw_rows: int, deduped: DataFrame, imputed: DataFrame, num: list[str], txt: list[str], bounds: dict) -> DataFrame:
    miss = deduped.agg(
        F.count(F.lit(1)).cast("bigint").alias("__rows"),
        *[(F.count(F.lit(1)) - F.count(F.col(c))).cast("bigint").alias(c) for c in num + txt],
    )
    capped = [c for c in num if c in bounds]
    outl = imputed.agg(*[F.count_if((F.col(c) < bounds[c][0]) | (F.col(c) > bounds[c][1])).alias(c) for c in capped]) if capped else None
    rows = miss.selectExpr("'original_rows' as issue", "'*' as column", f"{raw_rows}L as n")
    rows = rows.unionByName(miss.selectExpr("'final_rows' as issue", "'*' as column", "__rows as n"))
    rows = rows.unionByName(miss.selectExpr("'duplicates_removed' as issue", "'*' as column", f"{raw_rows}L - __rows as n"))
    rows = rows.unionByName(_stack(miss, "missing_filled_median", num)).unionByName(_stack(miss, "missing_filled_unknown", txt))
    if outl is not None:
        rows = rows.unionByName(_stack(outl, "outliers_capped", capped))
    # issues are reported only when something was fixed; row counts always
    return rows.where(F.col("issue").isin("original_rows", "final_rows") | (F.col("n") > 0))

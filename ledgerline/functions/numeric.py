"""Rounding, safe ratios and clamps as Column expressions.

Doubles are rounded through ``decimal(38,10)``: the cast takes the shortest decimal form of
the double, which is what a person reads, and rounds half up from there. Rounding the binary
value directly differs between engines on ties (e.g. 1033.3278125 to 6 places).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_to(x, digits: int = 2) -> Column:
    """Half-up rounding of a double to ``digits`` places, returned as double."""
    return F.round(_c(x).try_cast("decimal(38,10)"), digits).cast("double")


def money_sum(x) -> Column:
    """Exact sum of a decimal money column, then one cast to double."""
    return F.coalesce(F.sum(_c(x)), F.lit(0).cast("decimal(28,2)")).cast("double")


def safe_ratio(num, den, default: float = 0.0) -> Column:
    """``num / den``, or ``default`` when the denominator is 0 or NULL."""
    return F.coalesce(F.try_divide(_c(num), _c(den)), F.lit(default).cast("double"))


def clamp_min(x, lo: float = 0.0) -> Column:
    return F.greatest(F.lit(lo).cast("double"), _c(x).cast("double"))


def without_nan(df: DataFrame) -> DataFrame:
    """NaN as NULL in every float and double column: both mean a missing number."""
    floats = {c for c, kind in df.dtypes if kind in ("float", "double")}
    if not floats:
        return df
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns])

"""Date parsing and calendar expressions."""

from __future__ import annotations

import math
from typing import Optional, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: the seven accepted date layouts, in the order they are tried ----------
# (Python strptime spellings: %Y-%m-%d, %d/%m/%Y, %m/%d/%Y, %Y/%m/%d, %d-%m-%Y, %B %d, %Y, %b %d, %Y)
DATE_PATTERNS = ["yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "yyyy/M/d", "d-M-yyyy", "MMMM d, yyyy", "MMM d, yyyy"]
# time parts that may follow a layout, and two-digit-year layouts, tried when no layout fits alone
TIME_SUFFIXES = [" H:m:s[.SSSSSS]", "'T'H:m:s[.SSSSSS]", " H:m", " h:m:s a", " h:m a"]
SHORT_YEARS = ["d/M/yy", "M/d/yy", "d-M-yy", "yy-M-d", "yy/M/d"]
# weekday names, Monday first
DAY_ABBR = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
# ------------------------------------------------------------------------------------------

TWO_PI = 2 * math.pi


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_with(x, pattern: str) -> Column:
    """Parse a string with one layout; failures become NULL (never an error)."""
    return F.try_to_timestamp(_c(x), F.lit(pattern))


def _layouts(patterns: Sequence[str]) -> list[str]:
    """The layouts in the order of preference: alone, with a time part, with two-digit years.

    The empty layout is Spark's own timestamp format (ISO, also with a zone)."""
    return [*patterns, "", *[p + t for p in patterns for t in TIME_SUFFIXES], *SHORT_YEARS]


def _parsed(c: Column, layout: str) -> Column:
    return parse_with(c, layout) if layout else F.try_to_timestamp(c)


def date_layout(df: DataFrame, col: str, patterns: Sequence[str] = DATE_PATTERNS, order_col: Optional[str] = None) -> Optional[str]:
    """The layout of a string date column (B5); None for a column without values.

    The first layout that parses every value; else the layout of the first value by
    ``order_col`` when given, else the one that parses the most values. A column with values none
    of which any layout parses is an error, never an empty result. Counts come from the distinct
    values, one aggregation for the plain layouts and, only if none fits all, one for the others.
    """
    c = F.col(col)
    given = df.where(c.isNotNull())
    values = given.groupBy(c.alias("v")).agg(F.count(F.lit(1)).alias("n"))

    def parsed_rows(layouts: list[str]) -> tuple[int, dict[str, int]]:
        fits = [F.sum(F.when(_parsed(F.col("v"), p).isNotNull(), F.col("n"))).alias(f"s{i}") for i, p in enumerate(layouts)]
        row = values.agg(F.sum("n").alias("all"), *fits).first()
        return row["all"] or 0, {p: row[f"s{i}"] or 0 for i, p in enumerate(layouts)}

    layouts = _layouts(patterns)
    plain = layouts[: len(patterns) + 1]
    total, parsed = parsed_rows(plain)
    if not total:
        return None
    if total not in parsed.values():
        parsed |= parsed_rows(layouts[len(plain) :])[1]
    whole = next((p for p in layouts if parsed.get(p) == total), None)
    if whole is not None:
        return whole
    if not max(parsed.values()):
        raise ValueError(f"no date layout parses any value of column {col!r}")
    if order_col is not None:
        first = given.agg(F.min_by(c, F.col(order_col)).alias("v"))
        row = first.select(*[_parsed(F.col("v"), p).isNotNull().alias(f"f{i}") for i, p in enumerate(layouts)]).first()
        own = next((p for i, p in enumerate(layouts) if row[f"f{i}"]), None)
        if own is not None:
            return own
    return max(layouts, key=lambda p: parsed[p])


def resolved_timestamp(df: DataFrame, col: str, patterns: Sequence[str] = DATE_PATTERNS, order_col: Optional[str] = None) -> Column:
    """A string date column as TIMESTAMP by its layout; values that the layout does not parse are NULL."""
    layout = date_layout(df, col, patterns, order_col)
    return F.lit(None).cast("timestamp") if layout is None else _parsed(F.col(col), layout)


def weekday(d) -> Column:
    """Monday = 0 (H1)."""
    return F.weekday(_c(d))


def week_ending_sunday(d) -> Column:
    """Label of the Sunday-ending week a day belongs to (weekly bins)."""
    return F.date_add(_c(d), 6 - F.weekday(_c(d)))


def day_abbr(d) -> Column:
    return F.date_format(_c(d), "E")


def day_name(d) -> Column:
    return F.date_format(_c(d), "EEEE")


def month_label(d) -> Column:
    return F.date_format(_c(d), "yyyy-MM")


def calendar_columns(d) -> list[Column]:
    """The 15 calendar features (H7) of a date column, in the original order."""
    d = _c(d)
    dow = F.weekday(d)
    month = F.month(d)
    return [
        dow.cast("int").alias("day_of_week"),
        F.dayofmonth(d).alias("day_of_month"),
        F.weekofyear(d).alias("week_of_year"),
        month.alias("month"),
        F.quarter(d).alias("quarter"),
        F.year(d).alias("year"),
        (dow >= 5).cast("int").alias("is_weekend"),
        (F.dayofmonth(d) == 1).cast("int").alias("is_month_start"),
        (d == F.last_day(d)).cast("int").alias("is_month_end"),
        (d == F.trunc(d, "quarter")).cast("int").alias("is_quarter_start"),
        F.dayofyear(d).alias("day_of_year"),
        F.sin(F.lit(TWO_PI) * month / F.lit(12)).alias("month_sin"),
        F.cos(F.lit(TWO_PI) * month / F.lit(12)).alias("month_cos"),
        F.sin(F.lit(TWO_PI) * dow / F.lit(7)).alias("dow_sin"),
        F.cos(F.lit(TWO_PI) * dow / F.lit(7)).alias("dow_cos"),
    ]


CALENDAR_FEATURES = [
    "day_of_week", "day_of_month", "week_of_year", "month", "quarter", "year", "is_weekend",
    "is_month_start", "is_month_end", "is_quarter_start", "day_of_year", "month_sin", "month_cos",
    "dow_sin", "dow_cos",
]
LAGS = [1, 7, 14, 30]
ROLLING_WINDOWS = [7, 14, 30]
LAG_FEATURES = [f"lag_{k}" for k in LAGS] + [
    f for w in ROLLING_WINDOWS for f in (f"rolling_mean_{w}", f"rolling_std_{w}")
]
FEATURES = CALENDAR_FEATURES + LAG_FEATURES

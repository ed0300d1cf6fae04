"""Rule-based insights (M12) as a Spark job.

Each rule is a one-row aggregate over a rolled-up series (bounded by the calendar); the
rule texts are produced by ``format_string`` inside a ``CASE`` and exploded to ordered rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import day_name
from .seasonal import arg_best
from .series import rollup

# ---- fixed values: insight rule texts and thresholds of the original application ----------
GROWTH_UP = "Strong month-over-month growth of %s%% — consider scaling inventory."
GROWTH_DOWN = "Revenue declined %s%% MoM — review pricing and promotions."
BEST_DAY = "%s is your highest-performing day — optimize staffing and stock accordingly."
WORST_DAY = "%s shows lowest sales — consider targeted promotions on this day."
Q4_SEASONAL = "Q4 shows strong seasonality — prepare 10-15% extra inventory for year-end."
HIGH_R2 = "High forecast accuracy (R²>%s) — rely on these predictions for procurement decisions."
LOW_R2 = "Forecast accuracy is moderate — consider collecting more feature-rich data for improvement."
LOW_MAPE = "MAPE under 10% indicates excellent forecast reliability for operational planning."
GROWTH_LIMIT = 10.0
Q4_FACTOR = 1.1
R2_HIGH, R2_LOW, MAPE_GOOD = 0.85, 0.5, 10.0
GROWTH_EPS = 1e-8
# --------------------------------------------------------------------------------------------


def _fmt(x: Column, digits: int) -> Column:
    """Fixed-point text of an already rounded decimal (no binary tie issues)."""
    return F.format_string(f"%.{digits}f", F.round(x.try_cast("decimal(38,10)"), digits).cast("double"))


def monthly_facts(daily: DataFrame) -> DataFrame:
    """One row: month-over-month growth (zero-filled months) and the Q4/Q3 position means.

    Month totals are re-aggregated from the gap-filled daily series, so the source table is
    rolled up once for all rules."""
    m = rollup(daily, "ds", "y", "M")
    w = Window.orderBy("ds")  # one row per month
    m = m.select("y", F.row_number().over(w).alias("i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    return m.agg(
        F.max("n").alias("n_months"),
        F.max(F.when(F.col("i") == F.col("n"), F.col("y"))).alias("last"),
        F.max(F.when(F.col("i") == F.col("n") - 1, F.col("y"))).alias("prev"),
        F.avg(F.when(F.col("i") > F.col("n") - 3, F.col("y"))).alias("q4"),
        F.avg(F.when(F.col("i").between(7, 9), F.col("y"))).alias("q3"),
    )


def day_facts(daily: DataFrame) -> DataFrame:
    """One row: best and worst weekday by daily mean (ties alphabetical, F7)."""
    prof = daily.groupBy(day_name("ds").alias("day_name")).agg(F.avg("y").alias("avg_value"))
    best = arg_best(prof, "day_name", "avg_value").select(F.col("day_name").alias("best_day"), F.lit(None).cast("string").alias("worst_day"))
    worst = arg_best(prof, "day_name", "avg_value", lowest=True).select(F.lit(None).cast("string").alias("best_day"), F.col("day_name").alias("worst_day"))
    return best.unionByName(worst).agg(F.max("best_day").alias("best_day"), F.max("worst_day").alias("worst_day"))


def insights(df: DataFrame, date_col: str, target_col: str, metrics: DataFrame) -> DataFrame:
    """Ordered insight texts (ordinal, insight) from a sales table."""
    return insights_from_daily(rollup(df, date_col, target_col, "D"), metrics)


def insights_from_daily(daily: DataFrame, metrics: DataFrame) -> DataFrame:
    """Ordered insight texts (ordinal, insight) from a gap-filled daily series (ds, y).

    ``metrics`` is a one-row DataFrame with ``r2`` and ``mape`` (e.g. from ``metrics.evaluate``).
    """
    parts = [
        monthly_facts(daily),
        day_facts(daily),
        metrics.select("r2", "mape"),
    ]  # each holds exactly one row; fold them into one row without a join
    u = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    facts = u.agg(*[F.max(c).alias(c) for c in u.columns])
    growth = (F.col("last") - F.col("prev")) / (F.col("prev") + F.lit(GROWTH_EPS)) * 100
    has_growth = F.col("n_months") >= 2
    r2 = F.coalesce(F.col("r2"), F.lit(0.0))
    mape = F.coalesce(F.col("mape"), F.lit(100.0))
    rules = [
        F.when(has_growth & (growth > GROWTH_LIMIT), F.format_string(GROWTH_UP, _fmt(growth, 1)))
        .when(has_growth & (growth < -GROWTH_LIMIT), F.format_string(GROWTH_DOWN, _fmt(F.abs(growth), 1))),
        F.when(F.col("best_day").isNotNull(), F.format_string(BEST_DAY, F.col("best_day"))),
        F.when(F.col("worst_day").isNotNull(), F.format_string(WORST_DAY, F.col("worst_day"))),
        F.when((F.col("n_months") >= 12) & (F.col("q4") > F.col("q3") * F.lit(Q4_FACTOR)), F.lit(Q4_SEASONAL)),
        F.when(r2 > R2_HIGH, F.format_string(HIGH_R2, _fmt(r2, 2))).when(r2 < R2_LOW, F.lit(LOW_R2)),
        F.when(mape < MAPE_GOOD, F.lit(LOW_MAPE)),
    ]
    arr = F.array(*[F.struct(F.lit(i + 1).alias("rule"), r.alias("text")) for i, r in enumerate(rules)])
    out = facts.select(F.explode(arr).alias("x")).select("x.rule", "x.text").where(F.col("text").isNotNull())
    w = Window.orderBy("rule")  # at most six rows
    return out.select(F.row_number().over(w).cast("bigint").alias("ordinal"), F.col("text").alias("insight"))

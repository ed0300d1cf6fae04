"""RFM customer segmentation.

Per-customer aggregation is a partial+final hash aggregate; the snapshot date is a scalar
subquery; quartile edges and the places that cut the frequency ranks are selected by sketches and
counts (``functions.ranking``): customers are scanned, never sorted or numbered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_to
from ..functions.ranking import column_stats, first_of_ties, quantiles_and_ranks
from ..session import stored
from .series import as_date

# ---- fixed values: segment thresholds and names -----------------------------------------------
CHAMPION_MIN, LOYAL_MIN, AT_RISK_MIN = 10, 7, 4
SEGMENTS = ["Champions", "Loyal Customers", "At Risk", "Churned"]
# -------------------------------------------------------------------------------------------------
QUARTILES = [0.25, 0.5, 0.75]


def rfm_base(df: DataFrame, date_col: str, customer_col: str, revenue_col: str) -> DataFrame:
    """customer, recency (days since the table's last date), frequency, monetary."""
    dt = df.schema[date_col].dataType.simpleString()
    d = as_date(df, date_col) if not dt.startswith("timestamp") else F.col(date_col)
    base = (
        df.where(F.col(customer_col).isNotNull())
        .groupBy(F.col(customer_col).alias("customer"))
        .agg(
            F.max(d).alias("_last"),
            F.count(d).cast("bigint").alias("frequency"),
            F.coalesce(F.sum(F.col(revenue_col)).cast("double"), F.lit(0.0)).alias("monetary"),
        )
    )
    snap = base.select(F.max("_last")).scalar()  # = max over all dated rows
    if dt.startswith("timestamp"):
        rec = F.floor((F.unix_micros(snap.cast("timestamp")) - F.unix_micros(F.col("_last").cast("timestamp"))) / 86_400_000_000)
    else:
        rec = F.datediff(snap, F.col("_last"))
    return base.select("customer", rec.cast("bigint").alias("recency"), "frequency", "monetary")


def _score(v: Column, edges: list[Column], ascending: bool) -> Column:
    """Quartile bin (right-closed, lowest included) of ``v``; NULL stays NULL (E5)."""
    labels = [1, 2, 3, 4] if ascending else [4, 3, 2, 1]
    return (
        F.when(v.isNull(), F.lit(None))
        .when(v <= edges[0], labels[0])
        .when(v <= edges[1], labels[1])
        .when(v <= edges[2], labels[2])
        .otherwise(labels[3])
        .cast("int")
    )


def rfm_scores(base: DataFrame) -> DataFrame:
    """R, F, M quartile scores, total and segment per customer."""
    base = stored(base)  # read once; every later step reads the columns it needs
    stats = column_stats(base, ["recency", "monetary", "frequency"])
    n = stats["frequency"]["n"]  # never NULL
    # F: quartiles of rank(method="first"), the place by (frequency, customer); a place is at most the k-th
    # edge 1 + (n - 1) * k / 4 if it is at most that of the last row there (0-based: floor of the edge, less 1)
    last = [math.floor((n - 1) * k / 4) for k in (1, 2, 3)] if n else []
    # quartile edges and the frequencies at those places, all from one selection
    q, at = quantiles_and_ranks(base, ["recency", "monetary"], QUARTILES, stats, {"frequency": last}, {"frequency": n})
    cuts = first_of_ties(base, "frequency", "customer", last, {r: at["frequency", r] for r in last}) if n else [F.lit(False)] * 3
    r = _score(F.col("recency"), [F.lit(v) for v in q["recency"]], ascending=False)
    f = F.when(cuts[0], 1).when(cuts[1], 2).when(cuts[2], 3).otherwise(4).cast("int")
    m = _score(F.col("monetary"), [F.lit(v) for v in q["monetary"]], ascending=True)
    scored = base.select("customer", "recency", "frequency", "monetary", r.alias("r_score"), f.alias("f_score"), m.alias("m_score"))
    total = F.coalesce("r_score", F.lit(0)) + F.coalesce("f_score", F.lit(0)) + F.coalesce("m_score", F.lit(0))
    seg = (
        F.when(total >= CHAMPION_MIN, SEGMENTS[0])
        .when(total >= LOYAL_MIN, SEGMENTS[1])
        .when(total >= AT_RISK_MIN, SEGMENTS[2])
        .otherwise(SEGMENTS[3])
    )
    return scored.select("*", total.cast("int").alias("rfm_score"), seg.alias("segment"))


def segment_counts(scores: DataFrame) -> DataFrame:
    """Customers per segment as one row."""
    s = F.col("segment")
    return scores.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_customers"),
        F.count_if(s == SEGMENTS[0]).cast("bigint").alias("champions"),
        F.count_if(s == SEGMENTS[1]).cast("bigint").alias("loyal_customers"),
        F.count_if(s == SEGMENTS[2]).cast("bigint").alias("at_risk"),
        F.count_if(s == SEGMENTS[3]).cast("bigint").alias("churned"),
    )


def rfm_summary(base: DataFrame) -> DataFrame:
    """Average monetary, frequency (2 dp) and recency (1 dp)."""
    return base.agg(
        round_to(F.avg("monetary"), 2).alias("avg_clv"),
        round_to(F.avg("frequency"), 2).alias("avg_purchase_frequency"),
        round_to(F.avg("recency"), 1).alias("avg_recency_days"),
    )


def segment_share(scores: DataFrame) -> DataFrame:
    """Segment size as % of all customers, whole percent."""
    n = scores.select(F.count(F.lit(1))).scalar()
    g = scores.groupBy("segment").agg(F.count(F.lit(1)).cast("bigint").alias("customers"))
    return g.select("segment", "customers", round_to(F.col("customers") / n * 100, 0).alias("share_pct"))

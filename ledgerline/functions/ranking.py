"""Distributed global ranks and exact quantiles.

``order_statistics`` finds exact values at given ranks of several columns by sketches and counts, without
shuffling the values; ``quantiles`` are made of them. ``weighted_prefix`` computes running totals over
a global order without pulling rows into one task: range-partition, a reliable checkpoint (fixes the
partition assignment), running sums inside each partition, one total per partition, offsets added per
row. ``global_index`` is its unit-weight case (exact ranks with ties broken by a key).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, LongType, NumericType

from ..session import cut_lineage


def weighted_prefix(df: DataFrame, order_cols: Sequence[Column | str], weight: str, name: str = "_before") -> DataFrame:
    """Exclusive running total of ``weight`` over a global order, without gathering rows.

    Plan: range-partition (sampled bounds) -> reliable checkpoint, which fixes each row's
    partition -> running sums inside each partition (a window keyed by the partition id) ->
    one total per partition (collected: bounded by the partition count) -> offsets joined by
    broadcast. No task ever sees more than one range partition.
    """
    spark = df.sparkSession
    cols = df.columns
    # no fixed partition count: AQE may merge adjacent range partitions (ranges stay
    # contiguous), and the partition id is taken in the same stage, before the checkpoint
    tagged = cut_lineage(df.repartitionByRange(*order_cols).withColumn("_pid", F.spark_partition_id()))
    w_in = Window.partitionBy("_pid").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = tagged.select("*", (F.sum(weight).over(w_in) - F.col(weight)).alias("_in"))
    totals = sorted((r["_pid"], int(r["t"])) for r in tagged.groupBy("_pid").agg(F.sum(weight).alias("t")).collect())
    rows, acc = [], 0
    for pid, t in totals:
        rows.append((pid, acc))
        acc += t
    # one row per partition: bounded by the partition count, safe to broadcast
    offsets = spark.createDataFrame(rows or [(0, 0)], "_pid int, _off long")
    return within.join(F.broadcast(offsets), "_pid").select(*cols, (F.col("_off") + F.col("_in")).alias(name))


def global_index(df: DataFrame, order_cols: Sequence[Column | str], name: str = "rn") -> DataFrame:
    """Append a 1-based row number over ``order_cols`` (which should form a total order)."""
    cols = df.columns
    pref = weighted_prefix(df.withColumn("_one", F.lit(1).cast("long")), order_cols, "_one", "_b")
    return pref.select(*cols, (F.col("_b") + 1).alias(name))


def column_stats(df: DataFrame, cols: Sequence[str]) -> dict[str, dict[str, int]]:
    """Non-null count and NULL count per column, one pass."""
    if not cols:
        return {}
    r = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(F.col(c)).alias(f"n{i}") for i, c in enumerate(cols)]).collect()[0]
    return {c: {"n": int(r[f"n{i}"]), "nulls": int(r["__rows"]) - int(r[f"n{i}"])} for i, c in enumerate(cols)}


#: Values kept per level of a quantile sketch, and the share of ranks by which a bracket reaches around a
#: wanted rank (the sketch's error is about half of it). A bracket that misses its rank costs a pass, no more.
SKETCH_K, SLACK = 4096, 0.003
#: Distinct values between two found neighbours that are sorted, on an executor, at most.
FEW = 1 << 16


@dataclass(frozen=True)
class Span:
    """Ranks of a column whose values are known to lie strictly between ``lo`` and ``hi`` (None: no limit)."""

    col: str
    lo: float | None
    hi: float | None
    below: int
    inside: int
    ranks: tuple[int, ...]

    def holds(self) -> Column:
        v = F.col(f"`{self.col}`").cast("double")
        held = v.isNotNull()
        held = held if self.lo is None else held & (v > self.lo)
        return held if self.hi is None else held & (v < self.hi)

    def value(self) -> Column:
        return F.when(self.holds(), F.col(f"`{self.col}`").cast("double"))


def _brackets(df: DataFrame, spans: Sequence[Span]) -> list[tuple[Span, float, float, list[int]]]:
    """(span, low value, high value, ranks that should lie between), from one sketch of each span's values.

    Sketches are built per task and merged; ranks whose brackets overlap share one.
    """
    sketches = df.agg(*[F.kll_sketch_agg_double(s.value(), F.lit(SKETCH_K)).alias(f"s{i}") for i, s in enumerate(spans)])

    def shares(s: Span) -> list[float]:
        at = [(r - s.below + 0.5) / s.inside for r in s.ranks]
        return [min(1.0, max(0.0, x + d)) for x in at for d in (-SLACK, SLACK)]

    row = sketches.select(*[
        F.kll_sketch_get_quantile_double(f"s{i}", F.array(*map(F.lit, shares(s)))).alias(f"q{i}") for i, s in enumerate(spans)
    ]).first()
    out = []
    for i, s in enumerate(spans):
        ends = row[f"q{i}"]
        own: list[tuple[Span, float, float, list[int]]] = []
        for rank, lo, hi in zip(s.ranks, ends[::2], ends[1::2]):
            if own and lo <= own[-1][2]:
                own[-1] = (s, own[-1][1], max(hi, own[-1][2]), own[-1][3] + [rank])
            else:
                own.append((s, lo, hi, [rank]))
        out += own
    return out


def _narrowed(df: DataFrame, spans: Sequence[Span], found: dict[tuple[str, int], float]) -> list[Span]:
    """Two aggregates: brackets from sketches, then counts around them. Values at a bracket's ends are found;
    the other ranks lie in what is between, below or above, each smaller than before."""
    brackets = _brackets(df, spans)
    counts = []
    for i, (s, lo, hi, _) in enumerate(brackets):
        v = s.value()
        counts += [
            F.count_if(v < lo).alias(f"below{i}"), F.count_if(v == lo).alias(f"lo{i}"),
            F.count_if((v > lo) & (v < hi)).alias(f"in{i}"), F.count_if((v == hi) & (v > lo)).alias(f"hi{i}"),
        ]
    row = df.agg(*counts).first()
    left: dict[tuple, list[int]] = {}
    for i, (s, lo, hi, ranks) in enumerate(brackets):
        below, at_lo, between, at_hi = (int(row[f"{x}{i}"]) for x in ("below", "lo", "in", "hi"))
        from_lo = s.below + below
        past_lo, past_in = from_lo + at_lo, from_lo + at_lo + between
        past_hi = past_in + at_hi
        for r in ranks:
            if r < from_lo:
                key = (s.col, s.lo, lo, s.below, below)
            elif r < past_lo or past_in <= r < past_hi:
                found[s.col, r] = lo if r < past_lo else hi
                continue
            elif r < past_in:
                key = (s.col, lo, hi, past_lo, between)
            else:
                key = (s.col, hi, s.hi, past_hi, s.below + s.inside - past_hi)
            left.setdefault(key, []).append(r)
    return [Span(*key, tuple(sorted(ranks))) for key, ranks in left.items()]


def _span_values(df: DataFrame, spans: Sequence[Span]) -> DataFrame:
    """(span, v): the values that lie in the spans."""
    # most rows are in no span: they go before the functions over arrays, which Spark does not compile
    df = df.where(reduce(or_, [s.holds() for s in spans]))
    each = F.array(*[F.struct(F.lit(i).alias("span"), s.value().alias("v")) for i, s in enumerate(spans)])
    return df.select(F.inline(F.filter(each, lambda x: x["v"].isNotNull())))


def _sorted_spans(df: DataFrame, spans: Sequence[Span], found: dict[tuple[str, int], float]) -> None:
    """Values of spans with few rows: counted per value and summed up in order, one task per span."""
    held = _span_values(df, spans)
    upto = F.sum("n").over(Window.partitionBy("span").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = held.groupBy("span", "v").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", upto)
    wanted = [(i, r - s.below) for i, s in enumerate(spans) for r in s.ranks]
    hit = reduce(or_, [(F.col("span") == i) & (F.col("upto") > r) & (F.col("upto") - F.col("n") <= r) for i, r in wanted])
    for row in counted.where(hit).collect():  # at most one row per wanted rank
        s = spans[row["span"]]
        for r in s.ranks:
            if row["upto"] - row["n"] <= r - s.below < row["upto"]:
                found[s.col, r] = row["v"]


def order_statistics(df: DataFrame, targets: dict[str, list[int]], ns: dict[str, int]) -> dict[tuple[str, int], float]:
    """Exact values at 0-based ranks among the non-null values of each column; ``ns`` has their numbers.

    Selection in brackets: while more than ``FEW`` values lie where a wanted one can be, mergeable sketches
    of them give a bracket around each wanted rank, and a counting pass says where the rank is. What is left
    is sorted. Each pass is one scan with partial aggregates: no value is shuffled before the few that are
    sorted, and the steps are the same at every size (a billion values take two passes, then the sort).
    """
    found: dict[tuple[str, int], float] = {}
    spans = [Span(c, None, None, 0, ns[c], tuple(sorted(set(ranks)))) for c, ranks in targets.items() if ranks]
    while large := [s for s in spans if s.inside > FEW]:
        spans = [s for s in spans if s.inside <= FEW] + _narrowed(df, large, found)
    if spans:
        _sorted_spans(df, spans, found)
    return found


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], stats: dict | None = None,
              impute: bool = False) -> dict[str, list[float | None]]:
    """The quantiles of ``quantiles_and_ranks``."""
    return quantiles_and_ranks(df, cols, probs, stats, impute=impute)[0]


def quantiles_and_ranks(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], stats: dict | None = None, ranks: dict[str, list[int]] | None = None,
    ns: dict[str, int] | None = None, impute: bool = False,
) -> tuple[dict[str, list[float | None]], dict[tuple[str, int], float]]:
    """Exact linear-interpolated quantiles per column (dict), numpy ``linear`` definition, and the values at
    the ``ranks`` of other columns, whose numbers of values are ``ns``.

    Every quantile is two order statistics (``order_statistics``), all of one selection. With ``impute``, a
    column's NULLs count as copies of its median: the sorted column then has the values below the median, the
    median with the copies, the values above it, moved by their number k; so rank r holds the value of rank r if
    that is below the median, that of rank r - k if that is above it, else the median.
    """
    stats = stats if stats is not None else column_stats(df, cols)
    n = {c: stats[c]["n"] for c in cols}
    copies = {c: stats[c]["nulls"] if impute else 0 for c in cols}

    def around(total: int, p: float) -> tuple[int, int, float]:
        at = (total - 1) * float(p)
        return math.floor(at), min(math.floor(at) + 1, total - 1), at - math.floor(at)

    targets = dict(ranks or {})
    for c in cols:
        if n[c]:
            own = {r for p in probs for q in around(n[c] + copies[c], p)[:2] for r in (q, q - copies[c])}
            own |= set(around(n[c], 0.5)[:2]) if copies[c] else set()
            targets[c] = [r for r in own if 0 <= r < n[c]]
    values = order_statistics(df, targets, {**n, **(ns or {})})
    out: dict[str, list[float | None]] = {}
    for c in cols:
        if not n[c]:
            out[c] = [None] * len(probs)
            continue
        k = copies[c]
        if k:
            lo, hi, part = around(n[c], 0.5)
            median = values[c, lo] + (values[c, hi] - values[c, lo]) * part

        def at(r: int) -> float:
            if not k:
                return values[c, r]
            if r < n[c] and values[c, r] < median:
                return values[c, r]
            return values[c, r - k] if r >= k and values[c, r - k] > median else median

        ends = [around(n[c] + k, p) for p in probs]
        out[c] = [at(lo) + (at(hi) - at(lo)) * part for lo, hi, part in ends]
    return out, values


def _chunks(df: DataFrame, col: str) -> list[Column]:
    """A column as numbers that a double holds exactly; compared one after the other they have the column's order.

    Long whole numbers give two halves; strings six bytes at a time, then their length.
    """
    c, kind = F.col(f"`{col}`"), df.schema[col].dataType
    if isinstance(kind, (LongType, DecimalType)):
        high = F.floor(c / F.lit(1 << 30).cast("decimal(38,0)")).cast("double")
        low = F.pmod(c.cast("decimal(38,0)"), F.lit(1 << 30).cast("decimal(38,0)")).cast("double")
        return [high, low]
    if isinstance(kind, NumericType):
        return [c.cast("double")]

    def piece(k: int) -> Column:
        part = F.substring(c.cast("string").cast("binary"), 6 * k + 1, 6)
        return F.conv(F.rpad(F.hex(part), 12, "0"), 16, 10).cast("double")

    longest = df.agg(F.max(F.octet_length(c.cast("string")))).first()[0] or 0
    return [*[piece(k) for k in range(-(-longest // 6))], F.octet_length(c.cast("string")).cast("double")]


def first_of_ties(df: DataFrame, value: str, tie: str, ranks: Sequence[int], found: dict[int, float]) -> list[Column]:
    """For each 0-based rank of a total order by ``value``, then ``tie`` (unique): whether a row's place is at
    most that rank. ``found`` has the value at each rank.

    Rows below the value are in, rows above out; among the rows that tie, the wanted one is selected by
    ``order_statistics`` of its tie key, without sorting or numbering rows.
    """
    v = F.col(f"`{value}`")
    values = sorted(set(found.values()))
    if not values:
        return [F.lit(False) for _ in ranks]
    below = df.agg(*[F.count_if(v < x).alias(f"n{i}") for i, x in enumerate(values)]).first()
    before = {x: int(below[f"n{i}"]) for i, x in enumerate(values)}
    # per rank: the rows that tie so far, the wanted one's number among them, and what is in for sure
    same = {r: v == F.lit(found[r]) for r in ranks}
    number = {r: r - before[found[r]] for r in ranks}
    within = {r: v < F.lit(found[r]) for r in ranks}
    for chunk in _chunks(df, tie):
        table = df.select(*[F.when(same[r], chunk).alias(f"r{r}") for r in ranks])
        ns = table.agg(*[F.count(f"r{r}").alias(f"r{r}") for r in ranks]).first()
        got = order_statistics(table, {f"r{r}": [number[r]] for r in ranks}, {f"r{r}": int(ns[f"r{r}"]) for r in ranks})
        at = {r: F.lit(got[f"r{r}", number[r]]) for r in ranks}
        less = table.agg(*[F.count_if(F.col(f"r{r}") < at[r]).alias(f"r{r}") for r in ranks]).first()
        for r in ranks:
            within[r] = within[r] | (same[r] & (chunk < at[r]))
            same[r] = same[r] & (chunk == at[r])
            number[r] -= int(less[f"r{r}"])
    return [within[r] | same[r] for r in ranks]

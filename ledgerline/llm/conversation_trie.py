"""Prefix trie of conversations, its subtree totals by parallel tree contraction.

A node is a distinct sequence of first turns. Its key is made of running sums of hashes of (place, role,
text), so that a conversation of any length is keyed by a scan over range-partitioned rows: sums inside each
range, then one offset per conversation and range.

Subtree totals: nodes keep what they have gathered, and the edge above a node keeps what nodes that were
taken out of it had gathered. Rounds alternate until no node is left, each written to the shared folder:

* Rake: nodes without children have their totals, which are added to their parents; they go.
* Compress: a node with one child is taken out of its chain if its coin says 1 and its child's says 0, so that
  no two neighbours go at once. What it gathered moves to the edge above the child; the child, and the
  difference between both totals, are noted. Coins are bits of the depth, which halve a chain each round,
  then hashes.

Then the rounds are expanded backwards: a contracted node has its child's total and the noted difference. The
number of rounds grows with the logarithm of the nodes, and their tables shrink geometrically.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import python_ready, shared_table


def running(rows: DataFrame, key: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Rows with running sums within ``key``, in the order of ``order`` (which begins with ``key``), the row included.

    The rows of a long group lie in many ranges; each range is summed on its own.
    """
    tagged = shared_table(rows.select("*", *[c.alias(n) for n, c in sums.items()]).repartitionByRange(*order).withColumn(
        "range", F.spark_partition_id()
    ))
    inside = Window.partitionBy("range", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = tagged.groupBy(key, "range").agg(*[F.sum(n).alias(n) for n in sums])
    zero = F.lit(0).cast("decimal(38,0)")
    totals = totals.select(key, "range", *[F.coalesce(F.sum(n).over(before).cast("decimal(38,0)"), zero).alias(f"{n}_before") for n in sums])
    own = tagged.withColumns({n: F.sum(n).over(inside).cast("decimal(38,0)") for n in sums})
    return own.join(totals, [key, "range"]).withColumns({n: F.col(n) + F.col(f"{n}_before") for n in sums}).drop(
        "range", *[f"{n}_before" for n in sums]
    )


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv, place, h1, h2, size): turns by turn (null first), then role and text, from place 1; two hashes of
    role and text (null: empty), and the text's code points. Rows without a conv_id belong to no conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
    )
    one = {"place": F.lit(1).cast("long")}
    return running(turns, "conv", ["conv", "turn", "role", "text"], one).select(
        "conv", F.col("place").cast("long").alias("place"), F.xxhash64("role", "text").alias("h1"),
        F.xxhash64(F.lit(7), F.col("role"), F.col("text")).alias("h2"), F.length("text").cast("long").alias("size"),
    )


def rebuilt(turns: DataFrame, group: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Numbered turns of all conversations c after their first h = crc32(decimal c) % ``heads`` turns are replaced
    by those of conversation c - c % ``group`` (as many as it has); and all conversations (conv)."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    convs = turns.select("conv").distinct().select("conv", (F.col("conv") - F.col("conv") % group).alias("base"), h.alias("h"))
    first = turns.filter((F.col("place") < heads) & (F.col("conv") % group == 0)).withColumnRenamed("conv", "base")
    long = first.groupBy("base").agg(F.count("*").alias("there"))
    convs = shared_table(convs.join(long, "base", "left").withColumn("used", F.least("h", F.coalesce("there", F.lit(0)))).drop("there"))
    taken = convs.join(first, "base").filter("place <= h").select(*turns.columns)
    own = turns.join(convs, "conv").filter("place > h").withColumn("place", F.col("used") + F.col("place") - F.col("h"))
    return taken.unionByName(own.select(*turns.columns)), convs.select("conv")


def _key(depth: Column, a: Column, b: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth, a, b)))


def memberships(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, depth, node, parent, size): every node that a conversation starts with, from the root (depth 0)."""
    wide = "decimal(38,0)"
    # a turn's hashes with its place, as decimals: their sums cannot overflow
    hashed = turns.select(
        "conv", "place", "size", F.xxhash64("place", "h1", "h2").cast(wide).alias("a"), F.xxhash64("h2", "place", "h1").cast(wide).alias("b")
    )
    sums = running(hashed, "conv", ["conv", "place"], {"sa": F.col("a"), "sb": F.col("b")})
    place, sa, sb = F.col("place"), F.col("sa"), F.col("sb")
    nodes = sums.select(
        "conv", place.alias("depth"), _key(place, sa, sb).alias("node"),
        _key(place - 1, sa - F.col("a"), sb - F.col("b")).alias("parent"), "size",
    )
    none = F.lit(0).cast("long")
    return nodes.unionByName(
        convs.select("conv", none.alias("depth"), _key(none, none, none).alias("node"), F.lit(None).cast("binary").alias("parent"), none.alias("size"))
    )


def subtree_totals(nodes: DataFrame, weights: list[str]) -> DataFrame:
    """(node, *weights): sums over each node's subtree, of (node, parent, depth, *weights) of a tree whose root has
    no parent."""
    up = [f"up_{w}" for w in weights]
    state = shared_table(nodes.select("node", "parent", "depth", *weights, *[F.lit(0).cast("long").alias(u) for u in up]))
    bits = max(1, (nodes.agg(F.max("depth")).first()[0] or 0).bit_length())
    left, turn = state.count(), 0
    rounds: list[tuple[DataFrame, DataFrame]] = []
    while left:
        # rake
        kids = state.filter("parent IS NOT NULL").select(F.col("parent").alias("node")).distinct().withColumn("inner", F.lit(True))
        state = shared_table(state.join(kids, "node", "left"))
        leaves = state.filter("inner IS NULL")
        gifts = leaves.groupBy(F.col("parent").alias("node")).agg(*[F.sum(F.col(w) + F.col(u)).alias(f"add_{w}") for w, u in zip(weights, up)])
        rest = state.filter("inner IS NOT NULL").drop("inner").join(gifts, "node", "left")
        rest = shared_table(rest.withColumns({w: F.col(w) + F.coalesce(f"add_{w}", F.lit(0)) for w in weights}).select("node", "parent", "depth", *weights, *up))
        # compress
        kid = F.struct("node", "depth", *up)
        kids = rest.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n"), F.min(kid).alias("kid")).filter("n = 1")

        def coin(node: Column, depth: Column, turn=turn) -> Column:
            if turn < bits:
                return F.shiftright(depth, turn).bitwiseAND(F.lit(1)) == 1
            return F.xxhash64(node, F.lit(turn)).bitwiseAND(F.lit(1)) == 1

        inner = F.col("parent").isNotNull() & F.col("n").isNotNull()
        coins = coin(F.col("node"), F.col("depth")) & ~coin(F.col("kid.node"), F.col("kid.depth"))
        unary = shared_table(rest.join(kids, "node", "left").withColumn("goes", F.coalesce(inner & coins, F.lit(False))))
        gone = unary.filter("goes")
        moved = gone.select(
            F.col("kid.node").alias("node"), F.col("parent").alias("over"), *[(F.col(w) + F.col(u)).alias(f"add_{w}") for w, u in zip(weights, up)]
        )
        spliced = gone.select("node", F.col("kid.node").alias("child"), *[(F.col(w) + F.col(f"kid.{u}")).alias(w) for w, u in zip(weights, up)])
        rest = unary.filter("NOT goes").drop("n", "kid", "goes").join(moved, "node", "left")
        rest = rest.withColumns({u: F.col(u) + F.coalesce(f"add_{w}", F.lit(0)) for w, u in zip(weights, up)})
        state = shared_table(rest.withColumn("parent", F.coalesce("over", "parent")).select("node", "parent", "depth", *weights, *up))
        rounds.append((leaves.select("node", *weights), spliced))
        left, turn = state.count(), turn + 1
    totals = nodes.select("node", *weights).limit(0)
    for raked, spliced in reversed(rounds):
        known = totals.select(F.col("node").alias("child"), *[F.col(w).alias(f"child_{w}") for w in weights])
        back = spliced.join(known, "child").select("node", *[(F.col(w) + F.col(f"child_{w}")).alias(w) for w in weights])
        totals = shared_table(totals.unionByName(back).unionByName(raked))
    return totals


def _ends(members: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes at which conversations end: their ids ascending, hashed as they stream by."""
    last = members.groupBy("conv").agg(F.max_by("node", "depth").alias("node"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state = None, hashlib.sha256()
        for batch in batches:
            done = []
            for now, conv in zip(batch["node"], batch["conv"]):
                if now != node:
                    if node is not None:
                        done.append((node, state.hexdigest()))
                    node, state = now, hashlib.sha256(str(conv).encode())
                else:
                    state.update(f",{conv}".encode())
            yield pd.DataFrame(done, columns=["node", "ends_sha256"])
        if node is not None:
            yield pd.DataFrame([(node, state.hexdigest())], columns=["node", "ends_sha256"])

    dealt = last.select("node", "conv").repartition("node").sortWithinPartitions("node", "conv")
    return dealt.mapInPandas(hashed, "node binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per node of the trie of all conversations ``convs`` (conv), whose numbered turns are ``turns``: node and
    parent (128-bit keys), conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (the subtree's (n_convs - 1) times code points of the last text), ends_sha256.

    Without conversations there is no node.
    """
    python_ready(turns.sparkSession)
    members = shared_table(memberships(turns, convs))
    nodes = members.groupBy("node").agg(
        F.min("conv").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"),
        F.count("*").alias("n_convs"), F.first("size").alias("size"),
    )
    nodes = shared_table(nodes)
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = shared_table(nodes.join(children, "node", "left").fillna(0, ["n_children"]))
    weighed = nodes.select(
        "node", "parent", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"),
    )
    totals = subtree_totals(weighed, ["n_leaves", "saved_tokens"])
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(totals, "node").join(above, "parent", "left").join(_ends(members), "node", "left")
    return out.select(
        "node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def rebuilt_trie(conversations: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """``prefix_trie`` of the ``rebuilt`` conversations of a table (conv_id, turn, role, text).

    Turns are ordered by turn (null first), ties by role and text; null roles and texts are empty; repeated rows are
    turns like any other; rows without a conv_id belong to no conversation. An empty table gives no rows.
    """
    return prefix_trie(*rebuilt(shared_table(numbered(conversations)), group, heads))


#: DuckDB SQL for the rows of ``rebuilt_trie`` without node keys. CRC-32 is computed bit by bit.
ORACLE = """
WITH RECURSIVE t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c, c::VARCHAR AS s FROM t),
crc AS (
  SELECT c, s, 0 AS k, 4294967295::BIGINT AS v FROM ids
  UNION ALL
  SELECT c, s, k + 1, CASE WHEN k % 9 = 0 THEN xor(v, ascii(substr(s, k // 9 + 1, 1))::BIGINT)
    ELSE xor(v >> 1, 3988292384 * (v & 1)) END
  FROM crc WHERE k < 9 * length(s)),
convs AS (SELECT c, c - c % 100 AS base, xor(v, 4294967295) % 6 AS h FROM crc WHERE k = 9 * length(s)),
b AS (SELECT convs.c, convs.h, count(t.pos) AS used FROM convs LEFT JOIN t ON t.c = convs.base AND t.pos <= convs.h GROUP BY ALL),
rb AS (
  SELECT convs.c, t.pos AS i, r, x FROM convs JOIN t ON t.c = convs.base AND t.pos <= convs.h
  UNION ALL SELECT b.c, b.used + t.pos - b.h, r, x FROM b JOIN t ON t.c = b.c AND t.pos > b.h),
p AS (
  SELECT c, i AS depth, length(x) AS size, list(struct_pack(r := r, x := x)) OVER (PARTITION BY c ORDER BY i) AS seq FROM rb
  UNION ALL SELECT c, 0, 0, [] FROM convs),
node AS (SELECT depth, seq, min(c) AS conv_id, count(*) AS n_convs, max(size) AS size FROM p GROUP BY depth, seq),
m AS (SELECT p.c, p.depth, node.conv_id FROM p JOIN node USING (depth, seq)),
ends AS (
  SELECT m.depth, m.conv_id, sha256(string_agg(m.c::VARCHAR, ',' ORDER BY m.c)) AS h
  FROM m JOIN (SELECT c, max(depth) AS depth FROM p GROUP BY c) USING (c, depth) GROUP BY ALL),
up AS (SELECT node.depth, node.conv_id, m.conv_id AS parent FROM node LEFT JOIN m ON m.c = node.conv_id AND m.depth = node.depth - 1),
kids AS (SELECT depth - 1 AS depth, parent AS conv_id, count(*) AS n FROM up WHERE parent IS NOT NULL GROUP BY ALL),
own AS (
  SELECT node.depth, node.conv_id, n_convs, size, coalesce(kids.n, 0) AS n_children
  FROM node LEFT JOIN kids ON kids.depth = node.depth AND kids.conv_id = node.conv_id),
sub AS (
  SELECT m.depth, m.conv_id, sum((n_convs - 1) * size) AS saved, count(*) FILTER (n_children = 0) AS leaves
  FROM own JOIN m ON m.c = own.conv_id AND m.depth <= own.depth GROUP BY ALL)
SELECT own.conv_id, own.depth, up.parent AS parent_conv_id, n_convs, n_children, leaves AS n_leaves,
  saved::BIGINT AS saved_tokens, coalesce(ends.h, sha256('')) AS ends_sha256
FROM own JOIN up USING (depth, conv_id) JOIN sub USING (depth, conv_id) LEFT JOIN ends USING (depth, conv_id)
"""

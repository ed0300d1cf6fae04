"""SimHash near-duplicates with pivot distance tables.

Fingerprints are 64-bit SimHashes of word shingles. The join over all distinct fingerprints within
``max_bits`` works on distances to reference fingerprints (pivots):

* The 64 bits are split into ``max_bits + 2`` blocks, and each fingerprint gets its Hamming distance to
  every pivot, block by block. Fingerprints within ``max_bits`` agree in at least two whole blocks, so all
  their distances there are equal: they meet under the hash of those two rows of the distance
  table. No linked pair is lost and no pair is formed outside such a group.
* Inside a group, a pair is discarded when its distances to some pivot differ by more than ``max_bits``
  (the triangle inequality); the rest is verified bit by bit.
* A group gives links that span its linked members, not all pairs. Groups over ``BLOCK`` members are
  dealt out as pairs of blocks, so none is held by one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import python_ready, row_key, shared_table, with_rest
from .components import connected_components

PIVOTS = 16
BLOCK = 2048
#: Shingles whose bits are counted at a time.
STRIDE = 1 << 16


def fingerprint(text: str, shingle: int = 3) -> int:
    """Signed 64-bit SimHash: bit set if set in over half the XXH64 (seed 42) of the shingles."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(b" ".join(words), 42)]
    else:
        join = b" ".join
        hashes = [xxh64_intdigest(join(s), 42) for s in zip(*(words[n:] for n in range(shingle)))]
    ones = np.zeros(64, dtype=np.int64)
    for n in range(0, len(hashes), STRIDE):
        some = np.array(hashes[n : n + STRIDE], dtype="<u8")
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def pivots(n: int = PIVOTS, seed: int = 42) -> np.ndarray:
    """The reference fingerprints: fixed random 64-bit numbers."""
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64)


def block_masks(max_bits: int) -> list[int]:
    """The 64 bits as max_bits + 2 blocks of nearly equal width."""
    edges = [64 * n // (max_bits + 2) for n in range(max_bits + 3)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivot_keys(fp: Column, max_bits: int) -> Column:
    """One key per two blocks: a hash of their rows of the distance table."""
    refs = [_signed(int(r)) for r in pivots()]
    rows = [
        F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(r)).bitwiseAND(F.lit(_signed(mask)))) for r in refs])
        for mask in block_masks(max_bits)
    ]
    row_hash = F.array(*[F.xxhash64(F.lit(n), row) for n, row in enumerate(rows)])
    return F.transform(
        F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in combinations(range(len(rows)), 2)]),
        lambda ab: F.xxhash64(F.get(row_hash, ab[0]), F.get(row_hash, ab[1])),
    )


def linked(fps: np.ndarray, max_bits: int, refs: np.ndarray) -> list[tuple[int, int]]:
    """Positions of pairs that span the fingerprints linked within ``max_bits``."""
    table = np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    parent, out = list(range(len(fps))), []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    reach = np.searchsorted(table[:, 0], table[:, 0] + max_bits, side="right")
    for i in range(len(fps) - 1):
        near = slice(i + 1, reach[i])
        close = np.nonzero(np.abs(table[near] - table[i]).max(axis=1, initial=0) <= max_bits)[0] + i + 1
        for j in close[np.bitwise_count(fps[close] ^ fps[i]) <= max_bits].tolist():
            a, b = find(i), find(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(order[i]), int(order[j])))
    return out


def links(distinct: DataFrame, max_bits: int, block: int = BLOCK) -> DataFrame:
    """(u, v): links that span the groups of distinct fingerprints ``fp`` within ``max_bits``."""
    rows = distinct.select("fp", F.explode(pivot_keys(F.col("fp"), max_bits)).alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    dealt = (
        rows.join(sizes, "key").select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
        .select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")
    )
    refs = pivots()

    def span(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found(rows: pd.DataFrame) -> pd.DataFrame:
            fp = rows["fp"].to_numpy().view(np.uint64)
            group = rows[["key", "a", "b"]].to_numpy()
            starts = np.append(np.nonzero(np.append(True, (group[1:] != group[:-1]).any(axis=1)))[0], len(fp))
            length = np.diff(starts)
            two = starts[:-1][length == 2]  # most groups: all at once
            x, y = fp[two], fp[two + 1]
            apart = np.bitwise_count(x[:, None] ^ refs).astype(np.int8) - np.bitwise_count(y[:, None] ^ refs).astype(np.int8)
            keep = np.abs(apart).max(axis=1, initial=0) <= max_bits
            keep[keep] = np.bitwise_count(x[keep] ^ y[keep]) <= max_bits
            u, v = [x[keep]], [y[keep]]
            for s, n in zip(starts[:-1][length > 2], length[length > 2]):
                at = np.array(linked(fp[s : s + n], max_bits, refs), dtype=np.int64).reshape(-1, 2) + s
                u.append(fp[at[:, 0]])
                v.append(fp[at[:, 1]])
            return pd.DataFrame({"u": np.concatenate(u).view(np.int64), "v": np.concatenate(v).view(np.int64)})

        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            last = batch.iloc[-1]
            open_ = ((batch["key"] == last["key"]) & (batch["a"] == last["a"]) & (batch["b"] == last["b"])).to_numpy()
            rest, whole = batch[open_], batch[~open_]
            if len(whole):
                yield found(whole.reset_index(drop=True))
        if rest is not None and len(rest) > 1:
            yield found(rest.reset_index(drop=True))

    return (
        dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInPandas(span, "u long, v long")
    )


def near_duplicates(
    docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, rk (row key), fingerprint (16 hex digits), component_id, root (the
    component's smallest fingerprint as a number).

    component_id is the smallest doc_id reachable over fingerprints that differ in at most
    ``max_bits`` bits. A text without words has fingerprint zero and links like any other. Rows with a
    null id take part; they never name a component unless all its ids are null. Empty tables give no rows.
    """
    python_ready(docs.sparkSession)

    @F.pandas_udf("long")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    rows = shared_table(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("rk"),
        hashed(F.coalesce(F.col(text_col), F.lit(""))).alias("fp")
    ))
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    edges = links(distinct.select("fp"), max_bits)
    roots = connected_components(edges)
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(ids, "root").select("fp", "component_id", "root")
    return rows.join(classes, "fp").select(
        "doc_id", "rk", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root"
    )


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest id, with all its columns."""
    found = near_duplicates(docs, shingle, max_bits, id_col, text_col)
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(
        F.min(F.struct(F.coalesce("doc_id", F.lit(0)).alias("rid"), "rk")).alias("x")
    )
    rows, name = with_rest(docs, kept.select("x.rid", "x.rk"), id_col, text_col, "left_semi")
    return rows.dropDuplicates([name("rid"), name("rk")]).select(*docs.columns)

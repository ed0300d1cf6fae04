"""Exact token counts of whole texts, huge documents included.

Ordinary texts are counted part by part with a memo (the tokenizer drops blanks, so what stands
between two blanks is tokenised on its own). Huge documents are cut into chunks that overlap, the
chunks are dealt over the cluster and encoded with offsets, and neighbouring chunks are spliced at
a proven stable boundary: a place after a blank where both encodings start a token. No match of the
tokenizer's pattern, no merge and no normalisation crosses it. Where two chunks share no such
place, chunk and overlap are doubled for that document until they do or one chunk holds it all.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, python_ready, shared_table
from .units import Memo

#: Characters from which a document is huge, of a chunk, and of the overlap to begin with.
HUGE_CHARS = 32_768
CHUNK_CHARS = 8_192
OVERLAP_CHARS = 256


def part_counter(tokenizer_path: str):
    """texts -> their numbers of tokens, by the memoised counts of their parts between blanks."""
    import numpy as np
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)

    def encode(parts: list[str]) -> list[int]:
        """The parts in one text; a token belongs to the part that its offset lies in."""
        got = tokenizer.encode(" ".join(parts), add_special_tokens=False).offsets
        starts = np.fromiter((a for a, _ in got), dtype=np.int64, count=len(got))
        stops = np.cumsum([len(p) + 1 for p in parts])
        upto = np.searchsorted(starts, stops, side="left")
        return np.diff(upto, prepend=0).tolist()

    memo = Memo(encode)

    def count(texts: list[str]) -> list[int]:
        parts = [t.replace("\n", " ").split(" ") for t in texts]
        memo.learn(parts)
        return [sum([memo[p] for p in own]) for own in parts]

    return count


def _chunk_edges(texts: DataFrame, tokenizer_path: str, chunk: int, overlap: int) -> DataFrame:
    """A row per chunk: its tokens, and the stable token starts (with the number of tokens before
    them) in the overlaps that it shares with the chunks before and after."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rid, rk, text in zip(batch["rid"], batch["rk"], batch["text"]):
                starts = list(range(0, len(text), chunk))
                for n in range(0, len(starts), 64):
                    some = starts[n : n + 64]
                    yield pd.DataFrame({
                        "rid": rid, "rk": rk, "k": [s // chunk for s in some], "start": some,
                        "part": [text[s : s + chunk + overlap] for s in some],
                    })

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        for batch in batches:
            rows = []
            for rid, rk, k, start, part in zip(*(batch[c] for c in ("rid", "rk", "k", "start", "part"))):
                offsets = tokenizer.encode(part, add_special_tokens=False).offsets
                stable = [
                    (start + a, n) for n, (a, _) in enumerate(offsets)
                    if a and part[a - 1] in " \n" and (n == 0 or offsets[n - 1][0] < a)
                ]
                first = [x for x in stable if x[0] <= start + overlap]
                last = [x for x in stable if x[0] > start + chunk]
                rows.append((
                    rid, rk, k, len(offsets),
                    [p for p, _ in first], [n for _, n in first], [p for p, _ in last], [n for _, n in last],
                ))
            yield pd.DataFrame(rows, columns=["rid", "rk", "k", "n", "first", "first_n", "last", "last_n"])

    chunks = texts.mapInPandas(cut, "rid long, rk long, k long, start long, part string")
    return chunks.repartition("rid", "rk", "k").mapInPandas(
        edges,
        "rid long, rk long, k long, n long, first array<long>, first_n array<long>, last array<long>, last_n array<long>",
    )


def _spliced(edges: DataFrame) -> DataFrame:
    """(rid, rk, n_tokens); null where some neighbours share no stable boundary."""
    order = Window.partitionBy("rid", "rk").orderBy("k")
    joint = F.array_min(F.array_intersect("last", F.lead("first").over(order)))
    at = edges.withColumn("joint", joint).withColumn("is_last", F.lead("k").over(order).isNull())
    at = at.withColumn("joint_before", F.lag("joint").over(order))

    def index(places: str, counts: str, place: str):
        return F.try_element_at(F.col(counts), F.array_position(places, F.col(place)).cast("int"))

    end = F.when(F.col("is_last"), F.col("n")).otherwise(index("last", "last_n", "joint"))
    begin = F.when(F.col("k") == 0, F.lit(0)).otherwise(index("first", "first_n", "joint_before"))
    own = at.select("rid", "rk", (end - begin).alias("own"))
    return own.groupBy("rid", "rk").agg(
        F.when(F.count("own") == F.count("*"), F.sum("own")).alias("n_tokens")
    )


def huge_counts(texts: DataFrame, tokenizer_path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(rid, rk, n_tokens) of the huge documents (rid, rk, text), by overlapping chunks."""
    done, left = None, texts
    while True:
        found = shared_table(_spliced(_chunk_edges(left, tokenizer_path, chunk, overlap)))
        whole = found.filter("n_tokens is not null")
        done = whole if done is None else done.unionByName(whole)
        failed = found.filter("n_tokens is null").select("rid", "rk")
        if failed.isEmpty():
            return done
        left, chunk, overlap = texts.join(failed, ["rid", "rk"], "left_semi"), 2 * chunk, 2 * overlap


def count_tokens(
    docs: DataFrame, tokenizer_path: str, limit: int = 2048, huge_chars: int = HUGE_CHARS,
    chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    The tokenizer must drop blanks (as lower-casing word BPE files do). A null or empty text has
    no token. Repeated rows are counted once and returned as often as they occur.
    """
    python_ready(docs.sparkSession)

    @F.pandas_udf("long")
    def ordinary(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = part_counter(tokenizer_path)
        for texts in batches:
            yield pd.Series(count(texts.tolist()), dtype="int64")

    rows = keyed(docs, id_col, text_col, [id_col])
    is_huge = F.length("text") > huge_chars
    huge = huge_counts(
        rows.filter(is_huge).select("rid", "rk", "text").dropDuplicates(["rid", "rk"]), tokenizer_path, chunk, overlap
    ).withColumnRenamed("n_tokens", "huge_tokens")
    counted = rows.select(
        F.col(id_col).cast("long").alias("doc_id"), "rid", "rk", F.octet_length("text").cast("long").alias("n_bytes"),
        ordinary(F.when(is_huge, F.lit("")).otherwise(F.col("text"))).alias("own_tokens"),
    )
    n = F.coalesce("huge_tokens", "own_tokens")
    return counted.join(huge, ["rid", "rk"], "left").select(
        "doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit")
    )

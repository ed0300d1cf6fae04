"""Best-fit packing of tokenised documents by linear grouping.

Every document is tokenised once on the executors and cut into pieces of at most ``cap`` tokens.
All packing decisions depend only on how many pieces there are of each length, a table of at most
``cap`` rows whatever the input, so the plan is made on that histogram:

1. large lengths are sorted and dealt into groups of equal cardinality, each rounded up to its
   longest member (linear grouping);
2. configurations of the few rounded sizes are chosen, fullest first, each used as often as the
   remaining groups allow;
3. the places of a configuration are given to the actual lengths of its groups, in order;
4. small lengths, longest first, go to the sequences with the least room that still fits them.

More groups waste less by rounding, fewer leave configurations that repeat; several numbers are tried on the
histogram, up to best fit alone, and the plan with the fewest sequences is taken.

The plan says "the pieces of length L with ranks a to b go to sequences s to s + b - a at offset
o". Its size depends on ``cap`` and the number of groups only, so it is broadcast. Pieces get their
rank within their length in hash buckets, so that a very common length is no single task.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, python_ready, shared_table
from .units import Memo, is_plain, spaced_parts, word_parts

#: Numbers of rounded sizes of large pieces that are tried, with the share of ``cap`` up to which a length is
#: small (with all lengths small, the plan is best fit decreasing); and pieces that share one (length, bucket) rank window.
GROUPS = ((256, 1 / 8), (1024, 1 / 8), (4096, 1 / 8), (4096, 1 / 4), (1, 1))
BUCKET_ROWS = 20_000
#: Parts that are tokenised as one text; the tokenizer takes longer for each in longer texts.
JOINED = 128


def document_ids(tokenizer_path: str):
    """texts -> their ids as little-endian unsigned 32-bit bytes, for a byte-level BPE file."""
    import os

    import numpy as np
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has its core, no more
    tokenizer = Tokenizer.from_file(tokenizer_path)
    # a byte-level token has one character per byte, so token lengths add up to places in the bytes
    n_bytes = np.zeros(tokenizer.get_vocab_size(), dtype=np.int64)
    for token, i in tokenizer.get_vocab().items():
        n_bytes[i] = len(token)

    def alone(part: str) -> bytes:
        return np.asarray(tokenizer.encode(part, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(parts: list[str]) -> list[bytes | None]:
        """Plain parts in texts of ``JOINED``, in which each stands on its own; None for the others."""
        found: dict[str, bytes | None] = {}
        joined = []
        for p in parts:
            if not is_plain(p):
                found[p] = None
            elif p[0] == " ":
                found[p] = alone(p[1:])
            else:
                joined.append(p)
        groups = [joined[n : n + JOINED] for n in range(0, len(joined), JOINED)]
        spelt = [[p if p[0] == "\n" else " " + p for p in group] for group in groups]
        texts = ["x" + "".join(text) for text in spelt]
        for group, text, got in zip(groups, spelt, tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            own = np.asarray(got.ids, dtype="<u4")
            stops = np.searchsorted(
                np.cumsum(n_bytes[own]), 1 + np.cumsum([len(p.encode()) for p in text], dtype=np.int64), side="right"
            )
            start, data = 4, own.tobytes()
            for p, stop in zip(group, (4 * stops).tolist()):
                found[p] = data[start:stop]
                start = stop
        return [found[p] for p in parts]

    memo = Memo(encode)

    def ids(texts: list[str]) -> list[bytes]:
        out = []
        for text, found in zip(texts, memo.values([word_parts(t) for t in texts])):
            if None in found:  # a part that is not plain: cut the text with care
                out.append(b"".join([alone(p) for p in spaced_parts(text)]))
            else:
                out.append(b"".join(found))
        return out

    return ids


def pieces(docs: DataFrame, tokenizer_path: str, cap: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents with ``end_id`` appended; those over
    ``cap`` tokens are cut so that only the first piece may be shorter than ``cap``."""
    python_ready(docs.sparkSession)
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = document_ids(tokenizer_path)
        for batch in batches:
            rows = []
            for doc_id, data in zip(batch["doc_id"], ids(batch["text"].tolist())):
                data += end
                total, start, number = len(data) // 4, 0, 0
                stop = total % cap or min(total, cap)
                while start < total:
                    rows.append((doc_id, number, start, stop - start, zlib.crc32(data[4 * start : 4 * stop])))
                    start, stop, number = stop, stop + cap, number + 1
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    return texts.mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(sizes: list[int], left: list[int], first: int, cap: int) -> dict[int, int]:
    """Size index -> copies: the fullest configuration that holds size ``first``.

    Subset sums as the bits of an integer: ``after[k]`` has bit s set if sizes up to the k-th one
    considered can sum to s.
    """
    room = cap - sizes[first]
    considered, after, reach, mask = [], [], 1, (1 << (room + 1)) - 1
    for j in range(first, len(sizes)):
        copies = min(left[j] - (j == first), room // sizes[j])
        if copies <= 0:
            continue
        before = reach
        for _ in range(copies):
            reach |= (reach << sizes[j]) & mask
        if reach != before:
            considered.append((j, copies))
            after.append(before)
            if reach >> room & 1:
                break
    total, used = reach.bit_length() - 1, {first: 1}
    for (j, copies), before in zip(reversed(considered), reversed(after)):
        n = 0
        while not before >> total & 1:
            total, n = total - sizes[j], n + 1
            assert n <= copies
        if n:
            used[j] = used.get(j, 0) + n
    return used


def packing_plan(counts: dict[int, int], cap: int, groups: Sequence[tuple[int, float]] = GROUPS) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, pieces, first sequence, offset) rows that place all of ``counts``: of the plans for
    these (rounded sizes, share of ``cap`` that is small), one with the fewest sequences, the first of them."""
    least = -(-sum(length * n for length, n in counts.items()) // cap)
    best: list[tuple[int, int, int, int, int]] = []
    fewest = None
    for n_groups, share in groups:
        rows = plan_by_groups(counts, cap, n_groups, int(share * cap))
        used = max((first + n for _, _, n, first, _ in rows), default=0)
        if fewest is None or used < fewest:
            best, fewest = rows, used
        if fewest <= least:
            break
    return best


def plan_by_groups(counts: dict[int, int], cap: int, groups: int, small: int) -> list[tuple[int, int, int, int, int]]:
    """The plan with so many groups of the lengths above ``small``."""
    rows: list[tuple[int, int, int, int, int]] = []
    next_rank: dict[int, int] = defaultdict(int)
    open_by_room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (sequences, first sequence)
    n_sequences = 0

    def place(length: int, pieces_: int, sequence: int, offset: int) -> None:
        rows.append((length, next_rank[length], pieces_, sequence, offset))
        next_rank[length] += pieces_

    large = sorted((x for x in counts if x > small and counts[x]), reverse=True)
    # 1. groups of equal cardinality, each a list of [length, pieces], named by its longest length
    per_group = max(1, -(-sum(counts[x] for x in large) // groups))
    grouped: dict[int, list[list[int]]] = {}
    room_in_group, top = 0, 0
    for length in large:
        left = counts[length]
        while left:
            if not room_in_group:
                room_in_group, top = per_group, length
            take = min(left, room_in_group)
            grouped.setdefault(top, []).append([length, take])
            left, room_in_group = left - take, room_in_group - take
    sizes = sorted(grouped, reverse=True)
    left_of = [sum(n for _, n in grouped[s]) for s in sizes]
    # 2. configurations, 3. actual lengths
    first = 0
    while first < len(sizes):
        if not left_of[first]:
            first += 1
            continue
        used = fullest(sizes, left_of, first, cap)
        times = min(left_of[j] // n for j, n in used.items())
        slots = [j for j, n in sorted(used.items()) for _ in range(n)]
        runs = []
        for j in slots:
            need, run = times, []
            while need:
                length, n = grouped[sizes[j]][0]
                take = min(n, need)
                run.append([length, take])
                need -= take
                grouped[sizes[j]][0][1] -= take
                if take == n:
                    grouped[sizes[j]].pop(0)
            runs.append(run)
            left_of[j] -= times
        done = 0
        while done < times:
            same = min(run[0][1] for run in runs)
            offset = 0
            for run in runs:
                place(run[0][0], same, n_sequences, offset)
                offset += run[0][0]
                run[0][1] -= same
                if not run[0][1]:
                    run.pop(0)
            open_by_room[cap - offset].append((same, n_sequences))
            n_sequences += same
            done += same
    # 4. small lengths, best fit
    for length in sorted((x for x in counts if x <= small and counts[x]), reverse=True):
        left, room = counts[length], length
        while left:
            while room <= cap and not open_by_room.get(room):
                room += 1
            if room > cap:
                new = -(-left // (cap // length))
                open_by_room[cap].append((new, n_sequences))
                n_sequences, room = n_sequences + new, cap
            same, sequence = open_by_room[room].pop()
            take = min(left, same)
            place(length, take, sequence, cap - room)
            open_by_room[room - length].append((take, sequence))
            if same > take:
                open_by_room[room].append((same - take, sequence + take))
            left -= take
            room = min(room, max(length, room - length))
    return rows


def pack(
    docs: DataFrame, tokenizer_path: str, cap: int = 2048, end_id: int = 0,
    id_col: str = "doc_id", text_col: str = "text", groups: Sequence[tuple[int, float]] = GROUPS,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is an empty one, which holds ``end_id`` alone; repeated rows are packed as often as
    they occur; an empty table gives no rows. Offsets in a sequence are gapless from 0.
    """
    spark = docs.sparkSession
    found = shared_table(pieces(docs, tokenizer_path, cap, end_id, id_col, text_col))
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    buckets = max(1, sum(counts.values()) // BUCKET_ROWS)
    plan = spark.createDataFrame(
        packing_plan(counts, cap, groups) or [(0, 0, 0, 0, 0)],
        "length long, first_rank long, n long, first_sequence long, offset long",
    )
    placed = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = (
        placed.groupBy("length", "bucket").agg(F.count("*").alias("m"))
        .select(
            "length", "bucket",
            (F.sum("m").over(Window.partitionBy("length").orderBy("bucket")) - F.col("m")).alias("before"),
        )
    )
    in_bucket = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        placed.withColumn("in_bucket", F.row_number().over(in_bucket) - 1)
        .join(before, ["length", "bucket"])
        .withColumn("rank", F.col("in_bucket") + F.col("before"))
    )
    p = F.broadcast(plan.withColumnRenamed("length", "plan_length"))
    fits = (
        (F.col("length") == F.col("plan_length"))
        & (F.col("rank") >= F.col("first_rank"))
        & (F.col("rank") < F.col("first_rank") + F.col("n"))
    )
    return ranked.join(p, fits).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset",
    )

"""Removal of repeated byte strings, found by suffix arrays of shards.

A window is ``window`` bytes of one document. A document's windows are taken in runs: consecutive windows
whose least hashed ``gram``-byte string is the same. A run is known by the name (128-bit hash) of its bytes.

1. Runs whose gram occurs once only have no repeated window and stay at home: two equal windows have the same
   least gram.
2. Equal runs are combined, with how often they occur; one of each travels, as its bytes, to the shard of
   its gram, so that equal windows meet. Runs of a gram with more bytes than half a shard are cut by more
   context, up to ``LEVELS`` times: parts whose context occurs once go, the others are keyed by it. What is still
   too large gets several shards.
3. A shard puts its strings in a row and sorts their suffixes (Larsson-Sadakane refinement in numpy). By
   Kasai's common prefixes, neighbours that share a window's length are occurrences of the same window.
4. Shards of one gram are merged: each gives the sorted names of its different windows, these are dealt by
   ranges of names, and in a range sorted runs of two shards at a time are merged by binary search.
5. The repeated windows go back to all documents that hold their run, where the bytes they cover go.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, python_ready, shared_table
from .suffix_arrays import window_classes

WINDOW, GRAM = 400, 64
#: Bytes of a shard, about; a suffix array takes some 60 times as much memory for a moment.
SHARD_BYTES = 1 << 20
#: Times that runs of a frequent gram are keyed by more context (half of what is missing to a window each time).
LEVELS = 3
#: Bytes whose grams are hashed at a time, and windows of a run at most (longer runs are cut, no window is lost).
STRIDE, RUN = 1 << 20, 4096


def least_grams(data: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of ``data`` (uint8) the hash of its gram, and for each window the least hash in it."""
    from xxhash import xxh64_intdigest

    code = np.fromiter((xxh64_intdigest(bytes([b])) for b in range(256)), dtype=np.uint64, count=256)

    def grams(width: int) -> np.ndarray:
        """Hashes of all strings of so many bytes, from those of their halves."""
        if width == 1:
            return code[data]
        half = grams(width // 2)
        count = len(data) - width + 1
        both = half[:count] * np.uint64(0x9E3779B97F4A7C15) + half[width - width // 2 :][:count]
        return (both ^ (both >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (code[data[width // 2 :][:count]] if width % 2 else np.uint64(0))

    own = least = grams(gram)
    width, span = 1, window - gram + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    count = len(data) - window + 1
    return own, np.minimum(least[:count], least[span - width : span - width + count])


def runs_of(least: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first window, windows) of the runs of valid windows with one least gram, ``RUN`` windows at most."""
    breaks = np.ones(len(least), dtype=bool)
    breaks[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
    start = np.flatnonzero(breaks & valid)
    stop = np.flatnonzero(valid & np.append(breaks[1:] | ~valid[1:], True)) + 1
    parts = -(-(stop - start) // RUN)
    part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    first = np.repeat(start, parts) + part * RUN
    return first, np.minimum(first + RUN, np.repeat(stop, parts)) - first


def _runs(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """A row per run of windows: document, first window, windows, the least gram's hash and how often it
    occurs there, name."""

    def of_texts(some: list[tuple[int, int, int, bytes]]) -> pd.DataFrame:
        from xxhash import xxh128_digest

        row = b"".join(text for *_, text in some)
        sizes = np.array([len(text) for *_, text in some])
        begin = np.cumsum(sizes) - sizes
        grams, least = least_grams(np.frombuffer(row, dtype=np.uint8), window, gram)
        left = np.repeat(begin + sizes, sizes)[: len(least)] - np.arange(len(least))
        first, n = runs_of(least, left >= window)
        own = np.searchsorted(begin, first, side="right") - 1
        names = [xxh128_digest(row[a:b]) for a, b in zip(first.tolist(), (first + n + window - 1).tolist())]
        # a run may hold its least gram, and so equal windows, more than once
        occurs = [np.count_nonzero(grams[a : a + m + window - gram] == least[a]) for a, m in zip(first.tolist(), n.tolist())]
        rid, rk, at = (np.array([x[c] for x in some])[own] for c in range(3))
        return pd.DataFrame(
            {"rid": rid, "rk": rk, "start": first - begin[own] + at, "n": n, "gram": least[first].view(np.int64), "occurs": occurs, "name": names}
        )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            some, size = [], 0
            for rid, rk, text in zip(batch["rid"], batch["rk"], batch["bytes"]):
                for at in range(0, len(text) - window + 1, STRIDE):
                    some.append((rid, rk, at, bytes(text[at : at + STRIDE + window - 1])))
                    size += len(some[-1][-1])
                    if size >= STRIDE:
                        yield of_texts(some)
                        some, size = [], 0
            if some:
                yield of_texts(some)

    return docs.mapInPandas(cut, "rid long, rk long, start int, n int, gram long, occurs int, name binary")


def _strings(docs: DataFrame, chosen: DataFrame, window: int) -> DataFrame:
    """The bytes of one run of each name."""

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (x["gram"], x["name"], x["times"], text[x["start"] : x["start"] + x["n"] + window - 1], None, None)
                for text, places in zip(batch["bytes"], batch["places"]) for x in places
            ]
            yield pd.DataFrame(rows, columns=["gram", "name", "times", "string", "a", "b"], dtype=object)

    wanted = chosen.groupBy("rid", "rk").agg(F.collect_list(F.struct("start", "n", "gram", "name", "times")).alias("places"))
    # repeated rows hold the same bytes: one of them gives the strings
    one = docs.join(wanted, ["rid", "rk"]).dropDuplicates(["rid", "rk"])
    return one.select("bytes", "places").mapInPandas(take, "gram long, name binary, times long, string binary, a int, b int")


def narrowed(string: bytes, key: int, a, b, window: int, gram: int) -> Iterator[tuple[int, int, int, int, int]]:
    """The parts (first window, windows, a, b, hash of the bytes from a to b) of a run, by more context.

    All windows of a run hold the bytes from a to b, at first the gram (of a window that holds it again, its first
    place). Those that begin close before them also hold as many bytes after them as fill half of the window's
    rest, the others as many before them. Equal windows get equal contexts.
    """
    from xxhash import xxh64_intdigest

    last = len(string) - window
    if a is None or a != a:
        found = np.flatnonzero(least_grams(np.frombuffer(string, dtype=np.uint8), window, gram)[0].view(np.int64) == key).tolist()
        contexts = [(max(0, before + 1), p, p + gram) for before, p in zip([-1, *found], found)]
    else:
        contexts = [(0, int(a), int(b))]
    for low, p, q in contexts:
        half = (window - (q - p)) // 2
        low, high, middle = max(low, q - window), min(p, last), p - half
        if max(low, middle) <= high:
            end = q + (window - (q - p)) - half
            yield max(low, middle), high - max(low, middle) + 1, p, end, xxh64_intdigest(string[p:end], 1)
        if low < middle and low <= high:
            begin = middle - 1
            yield low, min(high, middle - 1) - low + 1, begin, q, xxh64_intdigest(string[begin:q], 2)


def _narrowed(strings: DataFrame, window: int, gram: int) -> DataFrame:
    """The parts of all these runs: gram (hash of the larger context), name, string, a, b, and the run they are of
    (owner, place in it, how often it occurs)."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh128_digest

        for batch in batches:
            rows = []
            for key, name, times, string, a, b in zip(*(batch[c] for c in ("gram", "name", "times", "string", "a", "b"))):
                for first, n, p, q, context in narrowed(string, key, a, b, window, gram):
                    part = string[first : first + n + window - 1]
                    context -= (context >= 1 << 63) << 64
                    rows.append((context, xxh128_digest(part), part, p - first, q - first, name, first, times))
            yield pd.DataFrame(rows, columns=["gram", "name", "string", "a", "b", "owner", "at", "times"])

    schema = "gram long, name binary, string binary, a int, b int, owner binary, at int, times long"
    return strings.mapInPandas(cut, schema)


def in_shard(shard: pd.DataFrame, window: int) -> pd.DataFrame:
    """Of one shard: runs (name, first, last) of windows that repeat in it, and, if its gram has other shards,
    the different windows: name and place of those that occur once here, only the window of the others."""
    from xxhash import xxh128_digest

    strings, names, times = [bytes(s) for s in shard["string"]], shard["name"].tolist(), shard["times"].to_numpy()
    own, place, number = window_classes(strings, window)
    first = np.flatnonzero(np.diff(number, prepend=-1))  # classes lie together, in suffix order
    number = np.repeat(np.arange(len(first)), np.diff(first, append=len(number)))
    again = (np.bincount(number, weights=times[own]) > 1)[number] if len(own) else np.zeros(0, dtype=bool)
    by = np.lexsort((place[again], own[again]))
    held, at = own[again][by], place[again][by]
    begin = np.flatnonzero((np.diff(held, prepend=-1) != 0) | (np.diff(at, prepend=-2) != 1))
    stop = at[np.append(begin[1:], len(at)) - 1] if len(at) else at
    rows = []
    holders = np.append(np.flatnonzero(np.diff(held[begin], prepend=-1)), len(begin)).tolist()
    for a, b in zip(holders, holders[1:]):
        rows.append((names[held[begin[a]]], at[begin[a:b]].tolist(), stop[a:b].tolist(), None, None, None, None, None))
    parts = int(shard["parts"].iloc[0])
    if parts > 1:
        gram, part = int(shard["gram"].iloc[0]), int(shard["part"].iloc[0])
        for string, start, known in zip(own[first].tolist(), place[first].tolist(), again[first].tolist()):
            digest = xxh128_digest(strings[string][start : start + window])
            rows.append((None if known else names[string], None, None, start, digest, gram, part, digest[0] * 256 + digest[1]))
    # as objects: numbers beside nulls would become floating point, and lose digits
    return pd.DataFrame(rows, columns=["name", "first", "last", "place", "digest", "gram", "part", "range"], dtype=object)


def merged_runs(runs: list[np.ndarray]) -> np.ndarray:
    """The values that stand in two or more of these sorted arrays of different values, in order.

    Two arrays at a time are merged: binary search finds the place of each value of the one in the other.
    """
    twice = [np.zeros(0, dtype=runs[0].dtype)] if runs else []
    while len(runs) > 1:
        up = []
        for a, b in zip(runs[::2], runs[1::2]):
            at = np.searchsorted(a, b)
            same = a[np.minimum(at, len(a) - 1)] == b if len(a) else np.zeros(len(b), dtype=bool)
            twice.append(b[same])
            up.append(np.insert(a, at[~same], b[~same]))
        runs = up + runs[len(runs) - len(runs) % 2 :]
    return np.unique(np.concatenate(twice)) if twice else np.zeros(0)


def across_shards(dealt: pd.DataFrame) -> pd.DataFrame:
    """Name and place of the windows of a range that stand in two or more shards of their gram."""
    digests = np.array([bytes(x) + b"." for x in dealt["digest"]])  # numpy drops zeros at the end of a string
    found = merged_runs([np.unique(digests[at]) for at in dealt.groupby("part").indices.values()])
    at = np.searchsorted(found, digests)
    again = found[np.minimum(at, len(found) - 1)] == digests if len(found) else np.zeros(len(digests), dtype=bool)
    return dealt.loc[again & dealt["name"].notna().to_numpy(), ["name", "place"]]


def repeated_in(strings: DataFrame, window: int, gram: int, shard_bytes: int, levels: int = LEVELS) -> DataFrame:
    """(name, first, last): the windows that repeat in different runs (gram, name, times, string, a, b)."""
    strings = shared_table(strings)
    weight = shared_table(strings.groupBy("gram").agg(F.sum(F.length("string")).alias("size")))
    total, hot = weight.agg(F.sum("size"), F.count_if(F.col("size") > shard_bytes // 2)).first()
    shards = max(1, math.ceil((total or 0) / shard_bytes))
    parts = F.when(F.col("size") > shard_bytes // 2, F.ceil(F.col("size") / (shard_bytes // 2)).cast("int")).otherwise(1)
    strings = strings.join(weight.select("gram", parts.alias("parts")), "gram")
    many, few = strings.filter("parts > 1"), strings.filter("parts = 1")
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("name"), "parts")).otherwise(0).cast("int").alias("part")
    shard = F.when(F.col("parts") > 1, F.col("gram")).otherwise(F.pmod(F.xxhash64("gram"), F.lit(shards))).alias("shard")
    alone = (F.col("parts") == 1).alias("alone")
    schema = "name binary, first array<int>, last array<int>, place int, digest binary, gram long, part int, range int"
    dealt = (strings if hot and not levels else few).select(shard, part, alone, "parts", "gram", "name", "times", "string")
    found = dealt.groupBy("shard", "part", "alone").applyInPandas(lambda rows: in_shard(rows, window), schema)
    if not hot:
        return found.select("name", "first", "last")
    if levels:
        cut = shared_table(_narrowed(many.drop("parts"), window, gram))
        again = shared_table(cut.groupBy("gram").agg(F.sum("times").alias("n")).filter("n > 1").select("gram"))
        met = shared_table(cut.join(again, "gram", "left_semi"))
        runs = met.groupBy("gram", "name").agg(F.sum("times").alias("times"), F.max(F.struct("string", "a", "b")).alias("x"))
        inner = shared_table(repeated_in(runs.select("gram", "name", "times", "x.*"), window, gram, shard_bytes, levels - 1))
        back = met.select("owner", "at", "name").join(inner, "name")
        moved = [F.transform(c, lambda x: x + F.col("at")).alias(c) for c in ("first", "last")]
        return found.select("name", "first", "last").unionByName(back.select(F.col("owner").alias("name"), *moved))
    found = shared_table(found)
    split = found.filter("digest IS NOT NULL").join(many.select("gram", "parts").distinct(), "gram")
    split = split.withColumn("range", F.col("range") % F.col("parts")).select("gram", "range", "part", "name", "place", "digest")
    far = split.groupBy("gram", "range").applyInPandas(across_shards, "name binary, place int")
    far = far.groupBy("name").agg(F.sort_array(F.collect_set("place")).alias("first"))
    ends = found.filter("digest IS NULL").select("name", "first", "last")
    return ends.unionByName(far.select("name", "first", F.col("first").alias("last")))


def repeated_windows(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, levels: int = LEVELS
) -> DataFrame:
    """(rid, rk, first, last): per document (rid, rk, bytes), runs of windows that also start anywhere else."""
    runs = shared_table(_runs(docs, window, gram))
    # written, so that both sides of the join are shuffled for it and a frequent gram can be split
    met = shared_table(runs.groupBy("gram").agg(F.sum("occurs").alias("times")).filter("times > 1").select("gram"))
    met = shared_table(runs.join(met, "gram", "left_semi"))
    chosen = met.groupBy("gram", "name").agg(F.count("*").alias("times"), F.min(F.struct("rid", "rk", "start", "n")).alias("at"))
    strings = _strings(docs, chosen.select("gram", "name", "times", "at.*"), window)
    ends = shared_table(repeated_in(strings, window, gram, shard_bytes, levels))
    at = met.select("rid", "rk", "start", "name").join(ends, "name")

    def moved(c: str):
        return F.transform(c, lambda x: x + F.col("start"))

    spans = at.select("rid", "rk", F.struct(moved("first").alias("first"), moved("last").alias("last")).alias("run"))
    spans = spans.groupBy("rid", "rk").agg(F.collect_set("run").alias("runs"))
    return spans.select("rid", "rk", F.flatten("runs.first").alias("first"), F.flatten("runs.last").alias("last"))


def removed_spans(first, last, window: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes (start, end) that the windows first..last of each run cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(map(int, first), map(int, last))):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b + window))
        else:
            out.append((a, b + window))
    return out


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, levels: int = LEVELS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end of each maximal
    removed run of bytes) and kept (the remaining bytes; a cut may fall inside a character).

    Every byte covered by a ``window``-byte string that also starts anywhere else, the same document
    included, is removed; strings are judged on the input. Repeated rows are occurrences like any other.
    A null text is an empty one, whose hash is that of no bytes; null ids stay null; an empty table gives no rows.
    """
    python_ready(docs.sparkSession)
    rows = keyed(docs, id_col, text_col, [id_col]).toDF("rid", "rk", "text", "own_id")
    rows = rows.select("rid", "rk", F.col("text").cast("binary").alias("bytes"), F.col("own_id").cast("long").alias("doc_id"))
    spans = repeated_windows(rows.select("rid", "rk", "bytes"), window, gram, shard_bytes, levels)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, first, last in zip(*(batch[c] for c in ("doc_id", "bytes", "first", "last"))):
                gone = [] if first is None else removed_spans(first, last, window)
                edges = [0, *(x for span in gone for x in span), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((
                    doc_id, len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(),
                    [{"start": a, "end": b} for a, b in gone], kept,
                ))
            frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    schema = (
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
        "spans array<struct<start: long, end: long>>, kept binary"
    )
    return rows.join(spans, ["rid", "rk"], "left").select("doc_id", "bytes", "first", "last").mapInPandas(finish, schema)

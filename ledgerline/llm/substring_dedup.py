"""Removal of repeated word windows, counted exactly in super-k-mer buckets.

A window is ``k`` consecutive words. Its minimiser is the least hash of its ``m``-word grams (the first
one on ties); consecutive windows with the same minimiser form one super-k-mer.

1. Minimisers are counted; a window that repeats has a minimiser that repeats, so super-k-mers whose
   minimiser occurs once stay at home.
2. The others travel as one packed string each to the bucket of their minimiser, equal strings
   combined first. There the windows of all strings are sorted, and equal neighbours are counted.
3. A bucket of more than ``HOT`` different strings gives its windows on instead, which are counted by
   their own 128-bit hashes, spread over the cluster.
4. The repeated windows go back to their documents, where the words they cover are removed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, python_ready, shared_table, with_rest

K, M = 35, 8
HOT = 256
#: Windows taken at a time; places of grams must fit PLACE_BITS.
STRIDE, PLACE_BITS = 1 << 19, 20


class WordHashes(dict):
    """word -> 64-bit hash, remembered; emptied when large."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > 400_000:
            self.clear()
        self[word] = found = xxh64_intdigest(word)
        return found


def super_kmers(hashes: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, minimiser) of every run of windows that share a minimiser."""
    n_windows = len(hashes) - k + 1
    empty = np.empty(0, dtype=np.int64)
    found = [(empty, empty, empty)]
    for at in range(0, max(0, n_windows), STRIDE):
        own = hashes[at : at + min(STRIDE, n_windows - at) + k - 1]
        n_grams = len(own) - m + 1
        gram = np.zeros(n_grams, dtype=np.uint64)
        for j in range(m):
            gram = gram * np.uint64(0x9E3779B97F4A7C15) + own[j : n_grams + j]
        gram = (gram ^ (gram >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        gram ^= gram >> np.uint64(29)
        places = np.arange(n_grams, dtype=np.uint64)
        least = (gram >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | places
        width, span = 1, k - m + 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        count = n_grams - span + 1
        least = np.minimum(least[:count], least[span - width : span - width + count])
        start = np.append(0, np.nonzero(least[1:] != least[:-1])[0] + 1)
        place = (least[start] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        found.append((start + at, np.diff(start, append=count), gram[place].view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found))


def _text_minimisers(docs: DataFrame, k: int, m: int) -> DataFrame:
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = WordHashes()
        for batch in batches:
            parts = []
            for rid, rk, text in zip(batch["rid"], batch["rk"], batch["text"]):
                words = text.encode("utf-8", "replace").split()
                if len(words) >= k:
                    hashes = np.fromiter((memo[w] for w in words), dtype=np.uint64, count=len(words))
                    start, n, mini = super_kmers(hashes, k, m)
                    parts.append((np.full(len(start), rid), np.full(len(start), rk), start, n, mini))
            if parts:
                yield pd.DataFrame(dict(zip(("rid", "rk", "start", "n", "mini"), map(np.concatenate, zip(*parts)))))

    return docs.mapInPandas(cut, "rid long, rk long, start int, n int, mini long")


def _packed(docs: DataFrame, k: int) -> DataFrame:
    """A row per super-k-mer that travels: where it is, its minimiser and its words."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh128_digest

        for batch in batches:
            rows = []
            for rid, rk, text, starts, ns, minis in zip(*(batch[c] for c in ("rid", "rk", "text", "starts", "ns", "minis"))):
                words = text.encode("utf-8", "replace").split()
                for start, n, mini in zip(starts, ns, minis):
                    string = b" ".join(words[start : start + n + k - 1])
                    rows.append((rid, rk, start, mini, xxh128_digest(string), string))
            yield pd.DataFrame(rows, columns=["rid", "rk", "start", "mini", "name", "string"])

    return docs.mapInPandas(pack, "rid long, rk long, start int, mini long, name binary, string binary")


def windows_of(string: bytes, k: int) -> list[bytes]:
    ends = [x.end() for x in re.finditer(rb"[^ ]+", string)]
    starts = [0] + [e + 1 for e in ends[:-1]]
    return [string[a:b] for a, b in zip(starts, ends[k - 1 :])]


def ranges(places: list[int]) -> tuple[list[int], list[int]]:
    """Sorted places as runs: their first and last places."""
    first = [p for n, p in enumerate(places) if n == 0 or places[n - 1] != p - 1]
    last = [p for n, p in enumerate(places) if n + 1 == len(places) or places[n + 1] != p + 1]
    return first, last


def repeated_in_bucket(strings: list[tuple[bytes, int]], k: int) -> list[list[int]]:
    """For (packed string, how often) of one bucket: the windows of each that occur twice or more."""
    found = sorted(
        (window, own, place) for own, (string, _) in enumerate(strings) for place, window in enumerate(windows_of(string, k))
    )
    out: list[list[int]] = [[] for _ in strings]
    n = 0
    while n < len(found):
        stop, total = n, 0
        while stop < len(found) and found[stop][0] == found[n][0]:
            total += strings[found[stop][1]][1]
            stop += 1
        if total > 1:
            for _, own, place in found[n:stop]:
                out[own].append(place)
        n = stop
    return [sorted(x) for x in out]


def _bucketed(strings: DataFrame, k: int, hot: int) -> DataFrame:
    """Repeated windows (name, first, last), and the windows of hot buckets (name, place, window, times)."""
    columns = ["name", "first", "last", "place", "window", "times"]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh128_digest

        rows, own, mini, is_hot = [], [], None, False

        def settle() -> None:
            if is_hot or not own or len(own) == 1 and own[0][1] == 1:
                return
            for (string, _), places in zip(own, repeated_in_bucket(own, k)):
                if places:
                    rows.append((xxh128_digest(string), *ranges(places), None, None, None))

        def pass_on(some: list[tuple[bytes, int]]) -> None:
            for string, times in some:
                name = xxh128_digest(string)
                rows.extend((name, None, None, n, xxh128_digest(w), times) for n, w in enumerate(windows_of(string, k)))

        for batch in batches:
            for now, string, times in zip(batch["mini"], batch["string"], batch["times"]):
                if now != mini:
                    settle()
                    own, mini, is_hot = [], now, False
                own.append((bytes(string), times))
                if len(own) > hot or is_hot:
                    pass_on(own)
                    own, is_hot = [], True
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
        settle()
        yield pd.DataFrame(rows, columns=columns)

    schema = "name binary, first array<int>, last array<int>, place int, window binary, times long"
    dealt = strings.groupBy("mini", "string").agg(F.count("*").alias("times")).repartition("mini").sortWithinPartitions("mini")
    return dealt.mapInPandas(count, schema)


def repeated_windows(docs: DataFrame, k: int = K, m: int = M, hot: int = HOT) -> DataFrame:
    """(rid, rk, first, last): per keyed document, runs of windows that also start anywhere else."""
    minimisers = shared_table(_text_minimisers(docs, k, m))
    # written, so that both sides of the join are shuffled for it and a hot minimiser can be split
    again = shared_table(minimisers.groupBy("mini").agg(F.count("*").alias("times")).filter("times > 1").select("mini"))
    travel = minimisers.join(again, "mini").groupBy("rid", "rk").agg(F.collect_set(F.struct("start", "n", "mini")).alias("s"))
    travel = travel.select("rid", "rk", F.col("s.start").alias("starts"), F.col("s.n").alias("ns"), F.col("s.mini").alias("minis"))
    packed = shared_table(_packed(docs.join(travel, ["rid", "rk"]), k))
    found = shared_table(_bucketed(packed.select("mini", "string"), k, hot))
    in_hot = found.filter("window is not null").select("name", "place", "window", "times")
    again = in_hot.groupBy("window").agg(F.sum("times").alias("total")).filter("total > 1").select("window")
    hot_runs = in_hot.join(again, "window", "left_semi").groupBy("name").agg(F.collect_list("place").alias("first"))
    runs = found.filter("window is null").select("name", "first", "last").unionByName(
        hot_runs.select("name", "first", F.col("first").alias("last"))
    )
    at = packed.select("rid", "rk", "start", "name").join(runs, "name")

    def moved(c: str):
        return F.transform(c, lambda x: x + F.col("start"))

    spans = at.select("rid", "rk", F.struct(moved("first").alias("first"), moved("last").alias("last")).alias("run"))
    spans = spans.groupBy("rid", "rk").agg(F.collect_set("run").alias("runs"))
    return spans.select("rid", "rk", F.flatten("runs.first").alias("first"), F.flatten("runs.last").alias("last"))


def removal_mask(n_words: int, first, last, k: int) -> np.ndarray:
    """Words covered by the windows first..last of each run."""
    edge = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(edge, np.asarray(first, dtype=np.int64), 1)
    np.add.at(edge, np.asarray(last, dtype=np.int64) + k, -1)
    return np.cumsum(edge[:-1]) > 0


def without(text: str, mask: np.ndarray) -> str:
    """The text without the masked words and the blanks that follow them."""
    at = [x.start() for x in re.finditer(r"[^\x20\x09-\x0D]+", text)] + [len(text)]
    out, n = [text[: at[0]]], 0
    while n < len(mask):
        stop = n
        while stop < len(mask) and mask[stop] == mask[n]:
            stop += 1
        if not mask[n]:
            out.append(text[at[n] : at[stop]])
        n = stop
    return "".join(out)


def remove_repeats(
    docs: DataFrame, k: int = K, m: int = M, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False
) -> DataFrame:
    """One row per document: doc_id, rk (row key), n_words, n_removed, kept_sha256, and with
    ``with_text`` the text without the removed words.

    Every word covered by a window whose words also start anywhere else, the same document included,
    is removed; windows are judged on the input. Repeated rows are occurrences like any other. A
    null text is an empty one, whose hash is that of no bytes; an empty table gives no rows.
    """
    python_ready(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    spans = repeated_windows(rows, k, m, hot)
    ids = keyed(docs, id_col, text_col, [id_col]).toDF("rid", "rk", "text", "own_id")
    joined = ids.join(spans, ["rid", "rk"], "left").select(F.col("own_id").cast("long").alias("doc_id"), "rk", "text", "first", "last")

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, rk, text, first, last in zip(*(batch[c] for c in ("doc_id", "rk", "text", "first", "last"))):
                words = text.encode("utf-8", "replace").split()
                kept, rest = words, text
                if first is not None:
                    mask = removal_mask(len(words), first, last, k)
                    kept = [w for w, gone in zip(words, mask.tolist()) if not gone]
                    rest = without(text, mask) if with_text else None
                out.append((doc_id, rk, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), rest))
            frame = pd.DataFrame(out, columns=["doc_id", "rk", "n_words", "n_removed", "kept_sha256", "text"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame if with_text else frame.drop(columns="text")

    schema = "doc_id long, rk long, n_words long, n_removed long, kept_sha256 string"
    return joined.mapInPandas(finish, schema + ", text string" * with_text)


def without_repeats(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns and rows; their texts without repeated windows."""
    texts = remove_repeats(docs, k, id_col=id_col, text_col=text_col, with_text=True)
    texts = texts.select(F.coalesce("doc_id", F.lit(0)).alias("rid"), "rk", F.col("text").alias("rest")).dropDuplicates(["rid", "rk"])
    rows, name = with_rest(docs, texts, id_col, text_col, "inner")
    return rows.withColumn(text_col, F.col(name("rest"))).select(*docs.columns)

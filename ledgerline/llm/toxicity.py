"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum of w over a text's terms + sum of <v_i, v_j> over its pairs of terms): the
pairs let terms weigh more together than their sum. Terms are lower-cased words without outer
punctuation and their prefixes, hashed into ``BUCKETS`` buckets. The machine is fitted on every bucket of
a bounded, documented sample (``SAMPLE_PER_CLASS`` rows of each label) and broadcast, at most ``BUCKETS`` x
(1 + ``RANK``) numbers. All labelled texts are counted (distributed) for the buckets' priors: weights are
free as far as a bucket's rates differ between the labels, factors as far as it is frequent. A prior
slows a bucket, none is left out, so pairs of terms that tell nothing alone are learned. Scoring reads
every whole text.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_ready

BUCKETS = 1 << 18
RANK = 8
SAMPLE_PER_CLASS = 6000
#: Labels that are broadcast at most (12 bytes each); beyond, labelled texts are joined by shuffling.
BROADCAST_LABELS = 1_000_000
#: A weight is half free where a term's rates in the two labels differ by so many standard errors, and
#: never less free than ``FLOOR``; factors are half free where so many labelled texts have the term.
HALF_Z, FLOOR, HALF_TEXTS = 4.0, 0.02, 30
#: Terms of a text with value 1 each; longer texts are scaled to the norm of one with so many.
FULL_TERMS = 64
STEPS, RATE, BATCH, L2_W, L2_V = 300, 0.05, 1024, 1e-4, 3e-3
#: Prefix lengths that are terms too: inflected words of one stem share them.
PREFIXES = (4, 5, 6)


class Buckets(dict):
    """word -> buckets of the word and of its prefixes, remembered; emptied when large."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 300_000:
            self.clear()
        term = word.lower().strip(string.punctuation)
        terms = [term] * bool(term) + [term[:n] + "*" for n in PREFIXES if len(term) >= n]
        self[word] = found = tuple(zlib.crc32(t.encode()) % BUCKETS for t in terms)
        return found

    def of(self, text: str | None) -> set[int]:
        return {b for w in set((text or "").split()) for b in self[w]}


@dataclass
class Rows:
    """Sparse rows: the places of row n are ``places[ends[n - 1]:ends[n]]``, each with the value ``scale[n]``."""

    places: np.ndarray
    ends: np.ndarray
    scale: np.ndarray

    @staticmethod
    def dense(x: np.ndarray) -> Rows:
        return Rows(np.nonzero(x)[1].astype(np.int32), np.cumsum((x != 0).sum(1)), np.ones(len(x)))

    def take(self, some: np.ndarray) -> Rows:
        starts = self.ends - np.diff(self.ends, prepend=0)
        parts = [self.places[starts[n] : self.ends[n]] for n in some]
        return Rows(np.concatenate(parts), np.cumsum([len(p) for p in parts]), self.scale[some])

    def sums(self, a: np.ndarray) -> np.ndarray:
        """Per row, the sum of ``a`` over its places, without the scale."""
        out = np.empty((len(self.ends), *a.shape[1:]))
        begin = 0
        for n, end in enumerate(self.ends):
            out[n] = a[self.places[begin:end]].sum(axis=0, dtype=np.float64)
            begin = end
        return out

    def spread(self, a: np.ndarray, size: int) -> np.ndarray:
        """Per place, the sum of ``a`` (one value per row) over the rows that have it."""
        return np.bincount(self.places, np.repeat(a, np.diff(self.ends, prepend=0)), size)


@dataclass
class Machine:
    """w0, the buckets in use, their weights and their factors (buckets x RANK)."""

    w0: float
    buckets: np.ndarray
    w: np.ndarray
    v: np.ndarray

    @cached_property
    def place(self) -> np.ndarray:
        place = np.full(BUCKETS, -1, dtype=np.int32)
        place[self.buckets] = np.arange(len(self.buckets), dtype=np.int32)
        return place

    def scores(self, texts: list[set[int]]) -> np.ndarray:
        out = np.empty(len(texts))
        for n, found in enumerate(texts):
            own = self.place[np.fromiter(sorted(found), dtype=np.int64, count=len(found))]
            own = own[own >= 0]
            v, c = self.v[own].astype(np.float64), float(row_scale(len(own)))
            s = v.sum(axis=0)
            z = self.w0 + c * self.w[own].sum(dtype=np.float64) + 0.5 * c * c * float((s * s).sum() - (v * v).sum())
            out[n] = 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))
        return out


def row_scale(size: np.ndarray | int) -> np.ndarray:
    """Value of each term of a text with ``size`` terms."""
    return np.sqrt(np.minimum(1.0, FULL_TERMS / np.maximum(size, 1)))


def fit_machine(
    x: np.ndarray | Rows, y: np.ndarray, weight: np.ndarray, rank: int = RANK, seed: int = 7,
    free_w: np.ndarray | None = None, free_v: np.ndarray | None = None,
):
    """(w0, w, v) that minimise the weighted logistic loss of ``x`` (0/1 array, or rows over the places of
    ``free_w``), by Adam steps on at most ``BATCH`` rows each, all in turn.

    ``free_w`` and ``free_v`` are the standard deviations of the places' priors, 1 by default.
    """
    rng = np.random.default_rng(seed)
    size = x.shape[1] if free_w is None else len(free_w)
    x = Rows.dense(x) if isinstance(x, np.ndarray) else x
    free_w = (np.ones(size) if free_w is None else free_w).astype(np.float32)
    free_v = (np.ones(size) if free_v is None else free_v).astype(np.float32)[:, None]
    p = float((weight * y).sum() / weight.sum())
    params = [np.array(np.log((p + 1e-6) / (1 - p + 1e-6))), np.zeros(size, dtype=np.float32), rng.normal(0, 0.01, (size, rank)).astype(np.float32)]
    m, u = [np.zeros_like(a) for a in params], [np.zeros_like(a) for a in params]
    batches: list[np.ndarray] = []
    for step in range(1, STEPS + 1):
        batches = batches or np.array_split(rng.permutation(len(y)), -(-len(y) // BATCH))
        some = batches.pop()
        b, c = x.take(some), x.scale[some]
        share = weight[some] / weight[some].sum()
        v = free_v * params[2]
        s = c[:, None] * b.sums(v)
        z = params[0] + c * b.sums(free_w * params[1]) + 0.5 * ((s * s).sum(1) - c * c * b.sums((v * v).sum(1)))
        g = share * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[some])
        pairs = -b.spread(g * c * c, size).astype(np.float32)[:, None] * v
        for k in range(rank):
            pairs[:, k] += b.spread(g * c * s[:, k], size)
        grads = [np.array(g.sum()), free_w * b.spread(g * c, size).astype(np.float32) + np.float32(L2_W) * params[1]]
        grads.append(free_v * pairs + np.float32(L2_V) * params[2])
        for n, grad in enumerate(grads):
            m[n] *= 0.9
            m[n] += 0.1 * grad
            u[n] *= 0.999
            u[n] += 0.001 * grad * grad
            params[n] -= RATE / (1 - 0.9**step) * m[n] / (np.sqrt(u[n] / (1 - 0.999**step)) + 1e-8)
    return float(params[0]), free_w * params[1], free_v * params[2]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """Fit on the documents that ``labels`` (id, 0/1) marks.

    Null labels and null ids are left out; a document with several labels counts as toxic if one says
    so. Without labelled documents the machine scores every text with a low prior.
    """
    python_ready(docs.sparkSession)
    marks = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("mark_id")).agg((F.max(label_col) >= 1).cast("int").alias("y"))
    )
    texts = docs.select(F.col(id_col).cast("long").alias("own_id"), F.col(text_col).alias("text"))
    joined = F.broadcast(marks) if marks.count() <= BROADCAST_LABELS else marks
    marked = texts.join(joined, F.col("own_id") == F.col("mark_id")).select("y", "own_id", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets, counts, rows = Buckets(), np.zeros((2, BUCKETS), dtype=np.int64), np.zeros(2, dtype=np.int64)
        for batch in batches:
            for y, text in zip(batch["y"], batch["text"]):
                counts[y, list(buckets.of(text))] += 1
                rows[y] += 1
        used = np.nonzero(counts.any(axis=0))[0]
        yield pd.DataFrame({
            "bucket": np.append(used, -1), "clean": np.append(counts[0, used], rows[0]),
            "toxic": np.append(counts[1, used], rows[1]),
        })

    counts = marked.mapInPandas(count, "bucket long, clean long, toxic long").groupBy("bucket").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    ).toPandas()  # at most BUCKETS + 1 rows
    total = counts[counts["bucket"] == -1][["clean", "toxic"]].sum()
    n0, n1 = float(total["clean"]), float(total["toxic"])
    prior = (n1 + 1) / (n0 + n1 + 3)
    nothing = Machine(float(np.log(prior / (1 - prior))), np.empty(0, dtype=np.int64), np.empty(0), np.empty((0, RANK)))
    if not n0 or not n1:
        return nothing

    def present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets = Buckets()
        for batch in batches:
            found = [np.array(sorted(buckets.of(t)), dtype=np.int32).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"y": batch["y"], "found": found})

    by_hash = [F.xxhash64("mark_id"), F.col("mark_id")]
    some = marks.filter("y = 1").orderBy(*by_hash).limit(SAMPLE_PER_CLASS).unionByName(
        marks.filter("y = 0").orderBy(*by_hash).limit(SAMPLE_PER_CLASS)
    )
    sample = (
        texts.join(F.broadcast(some), texts["own_id"] == some["mark_id"]).select("y", "text")
        .mapInPandas(present, "y int, found binary").toPandas()
    )
    y = sample["y"].to_numpy(dtype=np.float64)
    if not 0 < y.sum() < len(y):
        return nothing
    sizes = sample["found"].map(len).to_numpy() // 4
    found = np.frombuffer(b"".join(sample["found"]), dtype=np.int32)
    del sample
    place = np.zeros(BUCKETS, dtype=np.int32)
    place[found] = 1
    used = np.nonzero(place)[0]
    place[used] = np.arange(len(used), dtype=np.int32)
    if not len(used):
        return nothing
    terms = counts.set_index("bucket").loc[used]
    p0, p1 = terms["clean"].to_numpy() / n0, terms["toxic"].to_numpy() / n1
    n = (terms["clean"] + terms["toxic"]).to_numpy()
    p = n / (n0 + n1)
    z = (p1 - p0) / np.sqrt(p * (1 - p) * (1 / n0 + 1 / n1) + 1e-12)
    free_w, free_v = np.maximum(z**4 / (z**4 + HALF_Z**4), FLOOR), n / (n + HALF_TEXTS)
    weight = np.where(y == 1, n1 / y.sum(), n0 / (len(y) - y.sum()))
    rows = Rows(place[found], np.cumsum(sizes), row_scale(sizes))
    w0, w, v = fit_machine(rows, y, weight, free_w=free_w, free_v=free_v)
    return Machine(w0, used, w.astype(np.float32), v.astype(np.float32))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; a null text scores as an empty one."""
    python_ready(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        buckets = Buckets()
        for texts in batches:
            yield pd.Series(machine.scores([buckets.of(t) for t in texts]), dtype="float64")

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), scored(F.col(text_col)).alias("score"))


def held_out(id_col: str = "doc_id"):
    """Rows whose crc32 of the id's text is a multiple of 5 are never trained on."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted for every document; learns from rows not held out."""
    machine = train(docs, labels.filter(~held_out(id_col)), id_col, text_col, label_col)
    return score(docs, machine, id_col, text_col).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )

"""Phrases of two and three words that stand together, by best-first branch-and-bound growth.

A phrase grows to the right from its prefix. Its score is that of its weakest cut, a * a / (l * r) with the
counts of the phrase and of both parts; as no phrase is more frequent than its parts, a prefix of two words
with count f and first word of count f1 bounds the score of all its extensions:

    score <= a / f1 <= min(f, most frequent pair that begins with the prefix's last word) / f1

1. One pass counts words and pairs. Every pair of ``least`` occurrences is a candidate and a prefix.
2. Each round takes, per language, the prefixes with the highest bounds (of their own score, and of their
   extensions') and counts the triples that begin or end with one of them in one pass over the texts. That
   settles the pair (whether a longer candidate absorbs it) and all its extensions.
3. A language is settled when no prefix left has a bound that reaches its ``top``-th surviving score.

A pass tells its tasks the round's prefixes, ``ROUND_PAIRS`` of all languages at most; everything else is
counted, joined and ranked where it lies.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import python_ready, shared_table

#: Prefixes that a round takes at most, over all languages; a task holds them as word pairs (about 60 MB).
ROUND_PAIRS = 200_000
#: A task numbers the words it meets in so many bits, counts so many tokens at a time, and holds so many
#: different phrases (16 bytes each) before it hands its counts on.
BITS, SLICE, HELD = 21, 1 << 20, 1 << 22
#: Hash buckets in which phrases are ranked before they are ranked together.
BUCKETS = 64
#: Rows handed on at a time.
ROWS = 1 << 16

_BREAK = re.compile(rb"[.,;:!?\x0A-\x0D]+")
_TAB = bytes.maketrans(b"\t", b" ")
_STOP = b"\n"


def tokens(texts: list[bytes]) -> list[bytes]:
    """The words of some texts, A-Z lower-cased, with a line feed wherever a piece ends."""
    row = _BREAK.sub(b" \n ", _STOP.join(texts).lower())
    return list(filter(None, row.translate(_TAB).split(b" ")))


class Words(dict):
    """word -> its number in this task, from 1; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({_STOP: 0})
        self.names = [None]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.names)
        self.names.append(word)
        return n


class Counts:
    """Phrases of up to three numbered words, packed into one number each, and how often they occur, per language."""

    def __init__(self, words: int, chosen: dict[str, list[tuple[bytes, bytes]]] | None):
        self.words, self.chosen = words, chosen
        self.clear()

    def clear(self) -> None:
        self.vocabulary, self.held, self.size = Words(), {}, 0
        number = self.vocabulary.__getitem__
        self.pairs = {
            lang: np.sort(np.array([number(a) << BITS | number(b) for a, b in pairs], dtype=np.int64)) for lang, pairs in (self.chosen or {}).items()
        }

    def phrases(self, lang: str, ids: np.ndarray, starts: int) -> np.ndarray:
        """The phrases that begin at the first ``starts`` places."""
        two = (ids[:-1] << BITS | ids[1:])[: starts + 1]
        inner = (ids[:-1] != 0) & (ids[1:] != 0)
        if self.chosen is None:
            return np.concatenate([ids[:starts][ids[:starts] != 0], two[:starts][inner[:starts]]])
        pairs = self.pairs.get(lang, np.zeros(0, dtype=np.int64))
        if not len(pairs) or len(ids) < 3:
            return np.zeros(0, dtype=np.int64)
        hit = pairs[np.minimum(np.searchsorted(pairs, two), len(pairs) - 1)] == two
        n = min(starts, len(ids) - 2)
        wanted = (hit[:n] | hit[1 : n + 1]) & inner[:n] & inner[1 : n + 1]
        return (two[:n] << BITS | ids[2 : n + 2])[wanted]

    def add(self, lang: str, found: list[bytes]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(found), SLICE):
            part = found[at : at + SLICE + 2]  # phrases that begin in the slice may end behind it
            ids = np.fromiter(map(self.vocabulary.__getitem__, part), dtype=np.int64, count=len(part))
            keys, n = np.unique(self.phrases(lang, ids, min(SLICE, len(part))), return_counts=True)
            self.held.setdefault(lang, []).append((keys, n))
            self.size += len(keys)
            if self.size > HELD:
                self.held = {lang: [self.summed(parts)] for lang, parts in self.held.items()}
                self.size = sum(len(parts[0][0]) for parts in self.held.values())
            if self.size > HELD // 2 or len(self.vocabulary) > SLICE // 2:
                yield from self.hand_on()

    def summed(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        return keys[first], np.add.reduceat(n, first) if len(first) else n

    def hand_on(self) -> Iterator[pa.RecordBatch]:
        names = pa.array(self.vocabulary.names, type=pa.binary()).cast(pa.string())
        mask = (1 << BITS) - 1
        for lang, parts in self.held.items():
            keys, n = self.summed(parts)
            for at in range(0, len(keys), ROWS):
                some = keys[at : at + ROWS]
                ids = [some >> (BITS * k) & mask for k in reversed(range(self.words))]
                if self.words == 2:  # a single word is packed behind a 0
                    ids = [np.where(ids[0] == 0, ids[1], ids[0]), np.where(ids[0] == 0, 0, ids[1])]
                columns = [pa.array([lang] * len(some), type=pa.string()), *(names.take(pa.array(x)) for x in ids), pa.array(n[at : at + ROWS])]
                yield pa.RecordBatch.from_arrays(columns, ["lang", *(f"w{k + 1}" for k in range(self.words)), "n"])
        self.clear()


def _counted(texts: DataFrame, words: int, chosen: Broadcast | None = None) -> DataFrame:
    """(lang, w1, .., n): occurrences of words and pairs (``words`` 2, a word's w2 is null) or of the triples that
    begin or end with a chosen pair (3)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(words, chosen.value if chosen else None)
        for batch in batches:
            by_lang = defaultdict(list)
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                by_lang[lang].append(text)
            for lang, some in by_lang.items():
                yield from counts.add(lang, tokens(some))
        yield from counts.hand_on()

    names = [f"w{k + 1}" for k in range(words)]
    schema = ", ".join(f"{c} string" for c in ("lang", *names)) + ", n long"
    # a task's phrases are summed already: they are dealt out at once, not hashed once more before
    return texts.mapInArrow(run, schema).repartition("lang", *names).groupBy("lang", *names).agg(F.sum("n").alias("n"))


def cut_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact for counts up to 10**15."""
    a, left, right = (c.cast("decimal(18,0)") for c in (a, left, right))
    return F.call_function("div", a * a * F.lit(1_000_000).cast("decimal(7,0)"), left * right)


def _pairs(grams: DataFrame, least: int) -> DataFrame:
    """Candidate pairs with the counts of their words, their score and their bound."""
    single = grams.filter("w2 IS NULL AND n >= " + str(least))
    pairs = shared_table(grams.filter("w2 IS NOT NULL").withColumnRenamed("n", "a"))
    goes_on = pairs.groupBy("lang", F.col("w1").alias("w2")).agg(F.max("a").alias("most"))
    pairs = pairs.join(single.select("lang", "w1", F.col("n").alias("l")), ["lang", "w1"])
    pairs = pairs.join(single.select("lang", F.col("w1").alias("w2"), F.col("n").alias("r")), ["lang", "w2"])
    pairs = pairs.join(goes_on, ["lang", "w2"], "left")
    grown = F.least("a", F.coalesce("most", F.lit(0)))
    bound = F.floor(grown.cast("decimal(18,0)") * F.lit(1_000_000).cast("decimal(7,0)") / F.col("l")).cast("long") + 1
    pairs = pairs.withColumn("score", cut_score(F.col("a"), F.col("l"), F.col("r")))
    pairs = pairs.withColumn("bound", F.greatest("score", F.when(grown >= least, bound).otherwise(0)))
    return pairs.select("lang", "w1", "w2", "a", "l", "r", "score", "bound")


def _scored_triples(counted: DataFrame, pairs: DataFrame, least: int) -> DataFrame:
    """Candidate triples: a, and l, r and score of their weakest cut (the first on ties)."""
    counted = counted.filter(F.col("n") >= least).withColumnRenamed("n", "a")
    front = pairs.select("lang", "w1", "w2", F.col("a").alias("f12"), F.col("l").alias("f1"))
    back = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23"), F.col("r").alias("f3"))
    both = counted.join(front, ["lang", "w1", "w2"]).join(back, ["lang", "w2", "w3"])
    both = both.withColumn("s1", cut_score(F.col("a"), F.col("f1"), F.col("f23"))).withColumn("s2", cut_score(F.col("a"), F.col("f12"), F.col("f3")))
    first = F.col("s1") <= F.col("s2")
    return both.select(
        "lang", "w1", "w2", "w3", "a", F.when(first, F.col("f1")).otherwise(F.col("f12")).alias("l"),
        F.when(first, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"),
    )


def _best(rows: DataFrame, top: int) -> DataFrame:
    # first in buckets, so that no task sorts all phrases of a language
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    near = rows.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS)))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).filter(F.col("rank") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return near.drop("bucket").withColumn("rank", rank).filter(F.col("rank") <= top)


def collocations(
    docs: DataFrame, least: int = 10, absorb: int = 50, top: int = 2000, round_pairs: int = ROUND_PAIRS, text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank (from 1), phrase, a, l, r, n, score.

    Texts are split at ``.,;:!?`` and line ends, A-Z are lower-cased. A candidate has two or three words and
    ``least`` occurrences; it is dropped if a longer candidate that holds its words has ``absorb`` percent of its
    occurrences. Ties go to larger a, then to the phrase that is less in bytes. Null texts are empty, null
    languages ``und``; repeated rows count like any other. A language without a phrase gives no rows.
    """
    python_ready(docs.sparkSession)
    texts = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
    )
    grams = shared_table(_counted(texts, 2).filter(f"w2 IS NULL OR n >= {least}"))
    sizes = grams.filter("w2 IS NULL").groupBy("lang").agg(F.sum("n").alias("n"))
    left = shared_table(_pairs(grams, least))
    pairs, settled = left, None
    share = 2 * top
    while True:
        langs = [r["lang"] for r in left.select("lang").distinct().collect()]
        if not langs:
            break
        share = max(1, min(share, round_pairs // len(langs)))
        # the highest bounds of each hash bucket: any order settles the same phrases, and no task sorts a language
        buckets = min(BUCKETS, share)
        order = Window.partitionBy("lang", "bucket").orderBy(F.desc("bound"), "w1", "w2")
        now = left.withColumn("bucket", F.pmod(F.xxhash64("w1", "w2"), F.lit(buckets))).withColumn("place", F.row_number().over(order))
        now = shared_table(now.filter(F.col("place") <= share // buckets).drop("place", "bucket"))
        chosen = defaultdict(list)
        for r in now.select("lang", "w1", "w2").toLocalIterator():
            chosen[r["lang"]].append((r["w1"].encode(), r["w2"].encode()))
        sent = docs.sparkSession.sparkContext.broadcast(dict(chosen))
        open_texts = texts.filter(F.col("lang").isin(langs)) if len(langs) < 100 else texts
        found = shared_table(_scored_triples(_counted(open_texts, 3, sent), pairs, least))
        # pairs that a triple absorbs, as its beginning or its end
        held = found.select("lang", "w1", "w2", "a").unionByName(found.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
        held = held.groupBy("lang", "w1", "w2").agg(F.max("a").alias("longest"))
        alive = now.join(held, ["lang", "w1", "w2"], "left").filter(
            f"longest IS NULL OR 100 * cast(longest AS decimal(20,0)) < {absorb} * cast(a AS decimal(20,0))"
        )
        alive = alive.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", "score")
        grown = found.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "l", "r", "score")
        new = alive.unionByName(grown)
        settled = shared_table(_best((new if settled is None else settled.drop("rank").unionByName(new)).distinct(), top))
        # the top-th score of languages that have so many; all prefixes that reach it stay open
        reached = settled.filter(F.col("rank") == top).select("lang", F.col("score").alias("floor"))
        left = left.join(now.select("lang", "w1", "w2"), ["lang", "w1", "w2"], "left_anti").join(F.broadcast(reached), "lang", "left")
        left = shared_table(left.filter("floor IS NULL OR bound >= floor").drop("floor"))
        share *= 4
    if settled is None:
        settled = _best(left.select("lang", F.col("w1").alias("phrase"), "a", "l", "r", "score"), top)
    return settled.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: DuckDB SQL for the rows of ``collocations`` by a full count.
ORACLE = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, [x for x in regexp_split_to_array(piece, '[\\x20\\x09]+') if x <> ''] AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, k, unnest([array_to_string(w[i : i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS phrase
  FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (
  SELECT lang, k, phrase, a, cut, array_to_string(w[1 : cut], ' ') AS x, array_to_string(w[cut + 1 : k], ' ') AS y
  FROM cand, (SELECT unnest([1, 2]) AS cut) WHERE cut < k),
scored AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, a, l.f AS l, r.f AS r, cut,
    (1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = x JOIN f r ON r.lang = cuts.lang AND r.phrase = y),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, array_to_string(w[s : s + 1], ' ') AS phrase, max(a) AS longest
  FROM cand, (SELECT unnest([1, 2]) AS s) WHERE k = 3 GROUP BY ALL),
alive AS (
  SELECT weakest.* FROM weakest LEFT JOIN inside ON k = 2 AND inside.lang = weakest.lang AND inside.phrase = weakest.phrase
  WHERE longest IS NULL OR 100 * longest < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM alive JOIN sizes USING (lang) QUALIFY rank <= 2000
"""

"""Quality rules: text statistics and cross-document line frequency, in SQL functions only.

Lines are normalised (lower case, blanks collapsed) and hashed. A line is boilerplate on its host
when more than ``MAX_DOCS`` of the host's distinct documents hold it, whatever the host's size, or more than
``MAX_DOCS_PCT`` per cent of them and more than ``MIN_DOCS``; documents with the same lines count once, so copies of a good document do not make its
lines boilerplate. A document is depleted, and rejected, when boilerplate lines hold more than
``MAX_REMOVED_PCT`` per cent of the characters of its lines. ``quality_rules`` numbers the boilerplate
lines, ``keep_good`` returns the texts of the kept documents without them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import normal_text, row_key, shared_table, with_rest, words

MIN_WORDS = 20
MAX_REPEAT_PCT = 30
WINDOW = 8
MIN_DOCS = 10
MAX_DOCS_PCT = 10
MAX_DOCS = 100
MAX_REMOVED_PCT = 50
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def window_hashes(w: str, size: int = WINDOW) -> str:
    """SQL for the hash of every window of ``size`` words of the array column ``w``."""
    parts = ", ".join(f"get({w}, i + {n})" for n in range(size))
    return (
        f"CASE WHEN size({w}) >= {size} THEN transform(sequence(0, size({w}) - {size}), i -> xxhash64({parts})) "
        "ELSE cast(array() AS array<bigint>) END"
    )


def covered_words(h: str, size: int = WINDOW) -> str:
    """SQL for the words that lie in windows whose hash occurs twice or more in the array column ``h``.

    Hashes are sorted with their places; places whose neighbour has the same hash are repeated; in
    order, each covers the words up to the next one, ``size`` at most.
    """
    places = (
        f"transform(array(sort_array(transform({h}, (x, i) -> struct(x AS x, i AS i)))), s -> "
        "sort_array(transform(filter(sequence(0, size(s) - 1), "
        "j -> coalesce(get(s, j - 1).x = get(s, j).x, false) OR coalesce(get(s, j + 1).x = get(s, j).x, false)), "
        "j -> get(s, j).i)))[0]"
    )
    return (
        f"CASE WHEN size(array_distinct({h})) = size({h}) THEN 0 ELSE "
        f"transform(array({places}), p -> aggregate(sequence(0, size(p) - 1), 0, "
        f"(acc, j) -> acc + least({size}, coalesce(get(p, j + 1) - get(p, j), {size}))))[0] END"
    )


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    min_words: int = MIN_WORDS, max_repeat_pct: int = MAX_REPEAT_PCT, min_docs: int = MIN_DOCS,
    max_docs_pct: int = MAX_DOCS_PCT, max_removed_pct: int = MAX_REMOVED_PCT, max_docs: int = MAX_DOCS,
) -> DataFrame:
    """One row per document: doc_id, rk (row key), n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_line_chars, n_removed_chars, removed_lines (numbers, from 0, of the boilerplate lines
    among those that line feeds separate), base_failed, kept.

    A null or empty text has no words and fails the base rules. A null host is a host of its own. Rows
    that repeat an id and its text get the same verdict; an empty table gives no rows.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("rk"),
        F.xxhash64(F.col(host_col), F.col(host_col).isNull()).alias("host"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    rows = rows.select("*", words(F.col("text")).alias("w"), F.split("text", "\n").alias("raw"))
    rows = rows.select(
        "*", F.filter("raw", lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"), F.expr(window_hashes("w")).alias("h")
    )
    normal = F.transform(F.split(normal_text(F.col("text")), "\n"), F.trim)
    rows = rows.select("*", normal.alias("placed"), F.array_remove(normal, "").alias("normal"))
    stats = shared_table(rows.select(
        "doc_id", "rk", "host", F.xxhash64("normal").alias("content"),
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(covered_words("h")).cast("long").alias("n_repeat_words"),
        F.filter(
            F.transform("placed", lambda x, i: F.struct(F.xxhash64(x).alias("h"), F.length(x).alias("n"), i.alias("place"))),
            lambda x: x["n"] > 0,
        ).alias("lines"),
        F.aggregate("normal", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("n_line_chars"),
    ))
    line_rows = stats.select("doc_id", "rk", "host", "content", F.explode("lines").alias("line"))
    line_rows = line_rows.select(
        "doc_id", "rk", "host", "content", "line.place", F.xxhash64("host", "line.h").alias("line"), F.col("line.n").alias("n")
    )
    documents = stats.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("of_host"))
    frequent = (
        line_rows.select("line", "host", "content").distinct().groupBy("line", "host").agg(F.count("*").alias("n_docs"))
        .filter(F.col("n_docs") > min(min_docs, max_docs)).join(documents, "host")
        .filter(
            (F.col("n_docs") > max_docs)
            | (F.col("n_docs") > min_docs) & (F.col("n_docs") * 100 > F.col("of_host") * max_docs_pct)
        ).select("line")
    )
    removed = (
        line_rows.select("rk", "place", "line", "n").join(frequent, "line", "left_semi")
        .select("rk", "place", "n").distinct().groupBy("rk")
        .agg(F.sum("n").alias("n_removed_chars"), F.array_sort(F.collect_list("place")).alias("removed_lines"))
    )
    out = stats.drop("lines", "host", "content").join(removed, "rk", "left").withColumns({
        "n_removed_chars": F.coalesce("n_removed_chars", F.lit(0).cast("long")),
        "removed_lines": F.coalesce("removed_lines", F.array().cast("array<int>")),
    })
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    depleted = F.col("n_removed_chars") * 100 > F.col("n_line_chars") * max_removed_pct
    return out.select("*", base_failed.alias("base_failed"), (~base_failed & ~depleted).alias("kept"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The documents that the rules keep, with all their columns and rows, without boilerplate lines."""
    kept = quality_rules(docs, id_col, text_col, host_col).filter("kept").select(F.coalesce("doc_id", F.lit(0)).alias("rid"), "rk", "removed_lines")
    kept = kept.groupBy("rid", "rk").agg(F.flatten(F.collect_set("removed_lines")).alias("gone"))
    rows, name = with_rest(docs, kept, id_col, text_col, "inner")
    gone = F.col(name("gone"))
    rest = F.array_join(F.filter(F.split(text_col, "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")
    return rows.withColumn(text_col, F.when(F.size(gone) == 0, F.col(text_col)).otherwise(rest)).select(*docs.columns)

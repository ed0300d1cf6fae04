"""URL verdicts: host and path rules first, else logistic regression on hashed character n-grams.

The regression is trained on a small labelled URL table (at most ``SAMPLE`` distinct rows, taken by
hash) and scores every other URL. The labels come from rules, most of which name a domain: it would tell the
label of every training URL, and of the undecided ones only that they are elsewhere. So the model reads URLs
without the domain (the last ``DOMAIN_LABELS`` labels of the host), in training and after. Both labels weigh
the same. All of it runs in the JVM: SQL functions cut the n-grams, Spark ML hashes them, fits and scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000
FEATURES = 1 << 14
GRAMS = (3, 4, 5)
PENALTY, DOMAIN_LABELS = 0.001, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.translate(F.coalesce(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule ``host/path`` that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: len(r[0])):  # a longer rule is asked first
        own_host, slash, own_path = text.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + own_path)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def model_text(host: Column, path: Column, labels: int = DOMAIN_LABELS) -> Column:
    """What the model reads of a URL: the host without its last labels, and the path."""
    parts = F.split(host, r"\.")
    own = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - labels, F.lit(0))), ".")
    return F.concat(own, path)


def char_grams(text: Column, sizes: Sequence[int] = GRAMS) -> Column:
    """All character n-grams of the text between two markers."""
    marked = F.concat(F.lit("^"), text, F.lit("$"))

    def of_size(n: int) -> Column:
        last = F.length(marked) - n + 1
        # (a lambda of two arguments would get the place as the second one)
        grams = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(marked, i, F.lit(n)))
        return F.when(last >= 1, grams).otherwise(F.array().cast("array<string>"))

    return F.concat(*map(of_size, sizes))


def hashed(urls: DataFrame) -> DataFrame:
    """``urls`` (text) with the hashed n-grams as ``features``."""
    return HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES).transform(urls.withColumn("grams", char_grams(F.col("text"))))


def train(labelled: DataFrame, sample: int = SAMPLE):
    """Fit on (host, path, text, label 0/1: 1 blocks), text being what the model reads; both labels weigh the
    same in sum. Returns a fitted model, or the only label, or 0."""
    few = (
        labelled.filter("label is not null").groupBy("host", "path", "text").agg(F.max("label").cast("double").alias("label"))
        .orderBy(F.xxhash64("host", "path"), "host", "path").limit(sample)
    )
    seen = {r["label"]: r["n"] for r in few.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(seen) < 2:
        return next(iter(seen), 0.0)
    weight = F.when(F.col("label") == 1, sum(seen.values()) / (2 * seen[1.0])).otherwise(sum(seen.values()) / (2 * seen[0.0]))
    rows = hashed(few).withColumn("weight", weight)
    return LogisticRegression(maxIter=40, regParam=PENALTY, weightCol="weight").fit(rows.select("features", "label", "weight"))


def score_text(urls: DataFrame, model) -> DataFrame:
    """``urls`` with ``score``, the model's probability of block for ``text``."""
    if isinstance(model, float):
        return urls.withColumn("score", F.lit(model))
    return model.transform(hashed(urls)).withColumn("score", vector_to_array("probability")[1]).select(*urls.columns, "score")


def held_out(labelled: DataFrame, folds: int = 5, sample: int = SAMPLE) -> DataFrame:
    """label, urls, right, mean_score of hosts that the model was not trained on: every ``folds``-th host, by hash, of
    (host, path, text, label)."""
    other = F.pmod(F.xxhash64("host"), F.lit(folds)) == 0
    model = train(labelled.filter(~other), sample)
    scored = score_text(labelled.filter(other & F.col("label").isNotNull()), model)
    right = (F.col("score") >= 0.5).cast("int") == F.col("label")
    return scored.groupBy("label").agg(
        F.count("*").alias("urls"), F.avg(right.cast("int")).alias("right"), F.avg("score").alias("mean_score")
    )


def labelled_urls(urls: DataFrame, rules: Sequence[tuple[str, str]], url_col: str = "url") -> DataFrame:
    """(host, path, rule, by_rule, text, label): every row with what the rules say, and what the model reads of it."""
    u = F.col(url_col)
    rows = urls.select(url_host(u).alias("host"), url_path(u).alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    return rows.select("*", rule.alias("rule"), verdict.alias("by_rule")).select(
        "*", model_text(F.col("host"), F.col("path")).alias("text"), (F.col("by_rule") == "block").cast("int").alias("label"),
    )


def judge(urls: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", sample: int = SAMPLE) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict (allow or block), score.

    The labelled URL table is made of the URLs that a rule decides. ``score`` is the model's probability of block,
    from what it reads of every URL (``model_text``). A null URL, or one without ``://``, has an empty host and path and is judged by
    the model like any other. Without URLs that a rule decides, all are allowed.
    """
    u = F.col(url_col)
    rows = urls.select(F.col(id_col).alias("page_id"), url_host(u).alias("host"), url_path(u).alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("by_rule"))
    model = train(labelled_urls(urls, rules, url_col).filter("rule is not null"), sample)
    scored = score_text(rows.withColumn("text", model_text(F.col("host"), F.col("path"))), model)
    by_model = F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_model).alias("verdict"), "score")

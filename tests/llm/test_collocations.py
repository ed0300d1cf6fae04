"""Phrases by branch and bound against a full count."""

import collections
import random
import re

import duckdb
import pytest

from ledgerline.llm import collocations

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least, absorb, top):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = []
    longest = collections.Counter()
    for (lang, w), a in cand.items():
        if len(w) == 3:
            for part in (w[:2], w[1:]):
                longest[lang, part] = max(longest[lang, part], a)
    for (lang, w), a in cand.items():
        if len(w) == 2 and 100 * longest[lang, w] >= absorb * a and longest[lang, w]:
            continue
        cuts = [(10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        s, k = min(cuts)
        out.append((lang, -s, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    got, rank = [], collections.Counter()
    for lang, s, a, phrase, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            got.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -s))
    return sorted(got)


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


@pytest.mark.parametrize("top,round_pairs", [(5, 20), (40, 30), (10_000, 200_000)])
def test_phrases_equal_a_full_count(spark, top, round_pairs):
    rng = random.Random(top)
    vocabulary = [f"W{i}" for i in range(25)] + ["é", "日本", "　x", "a\x1cb", "\x00"]
    rows = []
    for i in range(150):
        w = [rng.choice(vocabulary[: rng.choice((4, 12, 30))]) for _ in range(rng.randint(0, 40))]
        w = [x + rng.choice([".", ",", "\x0b"]) if rng.random() < 0.1 else x for x in w]
        rows.append((rng.choice(["en", "de", None]), rng.choice([" ", "  ", "\t"]).join(w)))
    rows += [("en", "new York CITY. New york city") for _ in range(20)] + [("xx", None), ("yy", ""), (None, "und lang"), ("und", "und lang")]
    docs = spark.createDataFrame([(*r, 1, "n") for r in rows], "lang string, text string, w1 int, n string")
    assert rows_of(collocations.collocations(docs, 3, 50, top, round_pairs)) == brute(rows, 3, 50, top)


def test_empty_tables_and_tables_without_phrases(spark):
    docs = spark.createDataFrame([("en", "a b c"), (None, None)], "lang string, text string")
    assert collocations.collocations(docs).count() == 0
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_query_equals_its_sql(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    sql = sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({collocations.ORACLE})").fetchall())
    rows = [(r.lang, r.text) for r in spark.read.parquet(path).collect()]
    assert rows_of(collocations.collocations(spark.read.parquet(path))) == sql == brute(rows, 10, 50, 2000)


def test_slices_and_hand_overs_lose_no_phrase(monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 8)
    monkeypatch.setattr(collocations, "HELD", 12)
    monkeypatch.setattr(collocations, "ROWS", 3)
    rng = random.Random(3)
    found = [rng.choice([b"\n", b"a", b"b", b"c", b"d", b"\xc3\xa9"]) for _ in range(200)]
    pairs = [(b"a", b"b"), (b"c", b"a"), (b"zz", b"a")]
    for words, chosen in ((2, None), (3, {"en": pairs})):
        counts, got = collocations.Counts(words, chosen), collections.Counter()
        for batch in [*counts.add("en", found), *counts.add("de", found[:9]), *counts.hand_on()]:
            for row in batch.to_pylist():
                got[(row["lang"], *(row[f"w{k + 1}"] for k in range(words)))] += row["n"]
        want = collections.Counter()
        for lang, some in (("en", found), ("de", found[:9])):
            t = [x.decode() for x in some]
            for i in range(len(t)):
                if words == 2:
                    want[lang, t[i], None] += t[i] != "\n"
                    want[(lang, *t[i : i + 2])] += len(t[i : i + 2]) == 2 and "\n" not in t[i : i + 2]
                elif lang == "en" and len(t[i : i + 3]) == 3 and "\n" not in t[i : i + 3]:
                    spelt = [(a.decode(), b.decode()) for a, b in pairs]
                    want[(lang, *t[i : i + 3])] += tuple(t[i : i + 2]) in spelt or tuple(t[i + 1 : i + 3]) in spelt
        assert got == +want

"""Repeated byte strings by suffix arrays against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest

from ledgerline.llm import suffix_arrays, suffix_dedup

SCHEMA = "doc_id long, text string, rk string, gram int, name string"


def brute(rows, window):
    texts = [(t or "").encode() for _, t in rows]
    times = collections.Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = collections.Counter()
    for (i, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, dtype=bool)
        for p in range(len(t) - window + 1):
            if times[t[p : p + window]] > 1:
                gone[p : p + window] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(t) else 0
        out[i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def rows_of(got):
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return collections.Counter(tuple(r) for r in got.select(*columns).collect())


def some_rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 9)))
    common = " ".join(word() for _ in range(12))
    rows = [(n, " ".join(word() for _ in range(20)) + common[: rng.randint(10, 60)] + word()) for n in range(60)]
    rows += [(100 + n, rows[n][1]) for n in range(0, 60, 7)]  # copies
    rows += [(200 + n, rows[5][1][:n] + "#" + rows[5][1][n:]) for n in range(0, 40, 3)]  # near copies
    rows += [(300, None), (301, ""), (None, rows[3][1]), (None, None), (302, "x" * 700), (302, "x" * 700), (303, "ab" * 300)]
    return rows + [(304, "x" * 39), (305, "\x00" * 90 + "é" * 50)]


@pytest.mark.parametrize("shard_bytes,levels", [(1 << 20, 3), (600, 0), (600, 2), (300, 3)])
def test_repeated_bytes_equal_brute_force(spark, shard_bytes, levels):
    rows = some_rows()
    docs = spark.createDataFrame([(i, t, "x", 1, None) for i, t in rows], SCHEMA)
    got = suffix_dedup.remove_repeats(docs, window=40, gram=8, shard_bytes=shard_bytes, levels=levels).cache()
    assert rows_of(got) == brute(rows, 40)
    for r in got.collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
    got.unpersist()


def test_query_equals_brute_force_on_the_fixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows_of(suffix_dedup.remove_repeats(docs)) == brute(rows, 400)
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_texts_longer_than_a_stride_and_low_entropy_runs(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STRIDE", 100)
    monkeypatch.setattr(suffix_dedup, "RUN", 16)
    rows = some_rows()
    some = [(i or 0, 1, 0, (t or "").encode()) for i, t in rows]
    for _, _, _, text in some:
        if len(text) >= 40:
            _, least = suffix_dedup.least_grams(np.frombuffer(text, dtype=np.uint8), 40, 8)
            first, n = suffix_dedup.runs_of(least, np.ones(len(least), dtype=bool))
            assert n.max() <= 16 and [w for a, b in zip(first, n) for w in range(a, a + b)] == list(range(len(least)))
            assert all(len(set(least[a : a + b])) == 1 for a, b in zip(first, n))


@pytest.mark.parametrize("letters", [b"ab", b"\x00a", b"\x00", b"abc\xff\x00", bytes(range(256))])
def test_suffix_arrays_equal_sorting(letters):
    rng = random.Random(len(letters))
    for trial in range(80):
        text = bytes(rng.choice(letters) for _ in range(rng.randint(1, 60))) * (1 + trial % 3)
        data = np.frombuffer(text, dtype=np.uint8)
        order = suffix_arrays.suffix_array(data)
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert order.tolist() == want
        shared = [0]
        for a, b in zip(want, want[1:]):
            x, y = text[a:], text[b:]
            shared.append(next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y))))
        assert suffix_arrays.common_prefixes(data, order).tolist() == shared


def test_merging_sorted_runs_finds_what_two_hold():
    rng = random.Random(2)
    for _ in range(50):
        runs = [np.unique(np.array([rng.randint(0, 30) for _ in range(rng.randint(0, 12))], dtype=int)) for _ in range(rng.randint(1, 7))]
        times = collections.Counter(v for r in runs for v in r.tolist())
        assert suffix_dedup.merged_runs(runs).tolist() == sorted(v for v, n in times.items() if n > 1)


def test_narrowed_parts_hold_every_window_once_and_equal_windows_meet():
    rng = random.Random(8)
    for trial in range(60):
        text = bytes(rng.choice(b"ab" if trial % 2 else bytes(range(97, 123))) for _ in range(rng.randint(40, 90)))
        text += text[: rng.randint(0, 30)]
        grams, least = suffix_dedup.least_grams(np.frombuffer(text, dtype=np.uint8), 40, 8)
        keys = collections.defaultdict(set)
        for start, n in zip(*(x.tolist() for x in suffix_dedup.runs_of(least, np.ones(len(least), dtype=bool)))):
            todo = [(start, text[start : start + n + 39], int(least.view(np.int64)[start]), None, None)]
            for level in range(4):
                down, seen = [], []
                for at, string, key, a, b in todo:
                    for first, m, p, q, context in suffix_dedup.narrowed(string, key, a, b, 40, 8):
                        seen += range(at + first, at + first + m)
                        part = string[first : first + m + 39]
                        down.append((at + first, part, context, p - first, q - first))
                        for w in range(m):
                            keys[part[w : w + 40], level].add(context)
                assert sorted(seen) == list(range(start, start + n))
                todo = down
        assert all(len(x) == 1 for x in keys.values())

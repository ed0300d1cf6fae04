"""Most frequent values by sketches: exact counts, stated error of the distinct count."""

import collections
import random

from ledgerline.operators import profile as prof


def test_counts_are_exact_and_the_distinct_count_is_close(spark):
    rng = random.Random(4)
    zipf = [f"v{min(int(1 / (rng.random() + 1e-6)), 30_000)}" for _ in range(60_000)]
    many = [f"only {i}" if i % 4 else "often" for i in range(60_000)]
    rows = [(z, m, None if i % 3 else "some", None) for i, (z, m) in enumerate(zip(zipf, many))]
    df = spark.createDataFrame(rows, "zipf string, many string, gaps string, none string").repartition(6)
    got = collections.defaultdict(list)
    for r in prof.categorical_sketch(df, k=5, tracked=500).orderBy("column", "rank").collect():
        got[r.column].append((r.value, r.n, r.unique_count))
    for c, values in (("zipf", zipf), ("many", many), ("gaps", [r[2] for r in rows])):
        count = collections.Counter(v for v in values if v is not None)
        exact = sorted(count.items(), key=lambda t: (-t[1], t[0]))[:5]
        sure = [x for x in exact if x[1] > 4 * sum(count.values()) / 500]
        assert [x[:2] for x in got[c]][: len(sure)] == sure, c
        assert all(count[v] == n for v, n, _ in got[c])
        assert all(abs(u - len(count)) <= 4 * prof.DISTINCT_ERROR * len(count) + 1 for *_, u in got[c])
    assert "none" not in got


def test_empty_tables_have_no_values(spark):
    df = spark.createDataFrame([], "a string, b long")
    assert prof.categorical_sketch(df).count() == 0

"""The trie of rebuilt conversations against a direct count, and against its SQL."""

import collections
import hashlib
import random
import zlib

import duckdb

from ledgerline.llm import conversation_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members = collections.defaultdict(list)
    ends = collections.defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        seq = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    kids = collections.Counter(s[:-1] for s in members if s)
    leaves, saved = collections.Counter(), collections.Counter()
    for s, m in members.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] += kids[s] == 0
            saved[s[:d]] += (len(m) - 1) * (len(s[-1][1]) if s else 0)
    return collections.Counter(
        (m[0], len(s), members[s[:-1]][0] if s else None, len(m), kids[s], leaves[s], saved[s],
         hashlib.sha256(",".join(map(str, ends[s])).encode()).hexdigest())
        for s, m in members.items()
    )


def rows_of(df):
    return collections.Counter(tuple(r) for r in df.select(*COLUMNS).collect())


def test_trie_equals_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for c in [*range(0, 130), 250, 399, 500, -3, -100, -250, 2**40]:
        for turn in range(rng.choice((1, 2, 2, 3, 5, 9))):
            rows.append((c, turn, rng.choice(("user", "a", None)), rng.choice(("x", "yé", "", None))))
    rows += [(7, None, "user", "first"), (7, None, "user", "first"), (9, 1, "user", "tie"), (None, 0, "user", "nowhere"), (700, 0, "user", "x")]
    rows += [(600, t, "user", "same") for t in range(150)]  # a long chain
    rows += [(c, t, "user", "same") for c in (601, 602, 603) for t in range(150 - c % 3)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, "n", 1) for r in rows], "conv_id long, turn long, role string, text string, node string, depth int")
    assert rows_of(conversation_trie.rebuilt_trie(docs)) == brute(rows)
    assert conversation_trie.rebuilt_trie(docs.limit(0)).count() == 0


def test_contraction_needs_few_rounds_for_any_tree(spark):
    """Random trees, and a chain whose depths skip, so that depth bits alone would not do."""
    rng = random.Random(6)
    for parents, depth in [
        ([None] + [rng.randint(max(0, n - 3), n - 1) for n in range(1, 200)], None),
        ([None, *range(80)], [0] + sorted(rng.sample(range(1, 4000), 80))),
    ]:
        depths = depth or [0] * len(parents)
        for n, p in enumerate(parents):
            depths[n] = depths[n] if depth else (0 if p is None else depths[p] + 1)
        total = [n + 1 for n in range(len(parents))]
        for n in range(len(parents) - 1, 0, -1):
            total[parents[n]] += total[n]
        rows = [(str(n), None if p is None else str(p), depths[n], n + 1) for n, p in enumerate(parents)]
        got = conversation_trie.subtree_totals(spark.createDataFrame(rows, "node string, parent string, depth long, w long"), ["w"])
        assert {int(r.node): r.w for r in got.collect()} == dict(enumerate(total))


def test_query_equals_its_sql_and_brute_force(spark):
    path = "/root/testdata/sf0.01/conversations.parquet"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
    sql = con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({conversation_trie.ORACLE})").fetchall()
    got = rows_of(conversation_trie.rebuilt_trie(spark.read.parquet(path)))
    assert got == collections.Counter(sql) == brute([tuple(r) for r in spark.read.parquet(path).select("conv_id", "turn", "role", "text").collect()])

"""Line deduplication by a segment-partition edit join, in SQL functions only.

Lines are compared in lower case with blanks collapsed. Equal lines form a class. Classes are linked if
they are within ``edits`` character edits of each other, and if they are within so many word edits (a
word replaced, added or left out) as ``WORD_BANDS`` allows the line with fewer words. Both are found alike:

* Index: each line of length L is cut into ``edits + 1`` segments, one of which must occur unchanged in any
  line within ``edits`` edits. Keys are hashes of (L, number of the segment, segment).
* Probe: for each length L not above its own, a line looks up the substrings that can be a segment of
  such a line, at the places that the numbers of edits to the left and right allow.
* Lines that share one of fewer, coarser keys (``_common_keys``) with another line are found on hashes, without
  forming pairs. Only their texts are fetched, and get the keys above. Under a key they stand in order, and are
  compared with the first ones, those that find no link with the next ones, in growing steps; pairs are kept if
  their characters' counts differ in parity for at most ``2 * edits`` codes (an edit changes two counts at most), and
  verified: characters by Spark's bounded ``levenshtein``, words by what is left without common ends: with up to two
  edits by equal slices, with more by a banded bit-parallel edit automaton: one bit per diagonal of the band, one
  vector per number of edits, all in one long.

For word edits, a line is the array of its words: segments and probes are slices of it, the tau of a
segment is that of the band its line is in, and the parities are those of hashed words.

A line goes if its text occurs in a document with a smaller id or earlier in the same document, or if a
linked class precedes its class (by smallest document id, then by hash). Lines under ``min_chars``
characters are not linked; with ``short_lines`` they still form classes of equal lines, else they take no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, normal_text, shared_table, with_rest

EDITS = 2
MIN_CHARS = 20
#: (words, word edits): lines of so many words or more, up to the next band, may differ in so many words.
WORD_BANDS = ((8, 1), (32, 2), (128, 3))
#: Words from which on lines are found by segments of words alone, for character edits as well.
LONG = 16
#: Lines of a key that are compared with all others of it at first, and how many times as many after that.
FIRST, TIMES = 4, 16
#: Keys or classes that are broadcast at most (8 bytes each); beyond, they are joined by shuffling.
BROADCAST_CLASSES = 1_000_000
#: Probes, and segments, under a key that are compared in one task at most; beyond, both are dealt to more.
BLOCK = 512


def _lines(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(rid, rk, line, n): numbered lines of at least so many characters, as they are compared."""
    rows = keyed(docs, id_col, text_col)
    rows = rows.select("rid", "rk", F.posexplode(F.split(normal_text(F.col("text")), "\n")).alias("line", "n"))
    return rows.select("rid", "rk", "line", F.trim("n").alias("n")).filter(F.length("n") >= least)


def _h1(n: Column) -> Column:
    return F.xxhash64(n)


def _h2(n: Column) -> Column:
    return F.xxhash64(F.lit(7), n)


def _segment(edits: int | str, length: str, number: str, move: str, part: str = "substring") -> tuple[str, str]:
    """SQL for whether ``n`` has a substring that lies ``move`` characters right of segment ``number`` (from 0) of a
    line of this length, and for its hash. The last segments are longer. With ``part`` slice, ``n`` is an array of words."""
    segments = f"({edits} + 1)"
    first_long = f"({segments} - ({length}) % {segments})"
    short = f"int(({length}) div {segments})"
    start = f"(1 + {number} * {short} + greatest(0, {number} - {first_long}) + {move})"
    size = f"({short} + int({number} >= {first_long}))"
    return f"{start} >= 1 AND {start} + {size} - 1 <= len", f"xxhash64({length}, {number}, {part}(n, {start}, {size}))"


def _segment_hash(edits: int, length: str, number: str, move: str, part: str = "substring") -> str:
    """SQL hash of ``_segment``, null where it would leave the line."""
    there, key = _segment(edits, length, number, move, part)
    return f"CASE WHEN {there} THEN {key} END"


def _places(edits: int) -> list[tuple[int, int, int]]:
    """The places a line looks at: (characters shorter, segment, move)."""
    return [
        (shorter, i, move) for shorter in range(edits + 1) for i in range(edits + 1)
        for move in range(max(-i, shorter - (edits - i)), min(i, shorter + (edits - i)) + 1)
    ]


def index_keys(edits: int, part: str = "substring") -> str:
    """SQL array of a line's index keys; ``n`` and ``len`` are its text and length."""
    return f"transform(sequence(0, {edits}), i -> {_segment_hash(edits, 'len', 'i', '0', part)})"


def probe_keys(edits: int, part: str = "substring") -> str:
    """SQL array of (key, same): a line's probes for lines as long or up to ``edits`` shorter.

    One expression over the places to look at: (characters shorter, segment, move). Written out, they
    would make a method too large for the JVM to compile.
    """
    places = [f"struct({shorter} AS shorter, {i} AS i, {move} AS move)" for shorter, i, move in _places(edits)]
    return (
        f"transform(array({', '.join(places)}), p -> struct("
        f"{_segment_hash(edits, 'len - p.shorter', 'p.i', 'p.move', part)} AS key, p.shorter = 0 AS same))"
    )


def _banded(bands: tuple[tuple[int, int], ...]) -> list[tuple[int, int | None, int]]:
    """(least words, least words of the next band, word edits) of each band."""
    ends = [least for least, _ in bands[1:]] + [None]
    return [(least, end, edits) for (least, edits), end in zip(bands, ends)]


def word_edits(size: str, bands: tuple[tuple[int, int], ...] = WORD_BANDS) -> str:
    """SQL for the word edits that a line of so many words may have."""
    cases = " ".join(f"WHEN {size} >= {least} THEN {edits}" for least, edits in reversed(bands))
    return f"CASE {cases} ELSE 0 END"


def word_index_keys(bands: tuple[tuple[int, int], ...] = WORD_BANDS) -> str:
    """SQL array of index keys of a line whose words are the array ``n`` of size ``len``."""
    cases = " ".join(f"WHEN len >= {least} THEN {index_keys(edits, 'slice')}" for least, edits in reversed(bands))
    return f"CASE {cases} ELSE cast(array() AS array<bigint>) END"


def word_probe_keys(bands: tuple[tuple[int, int], ...] = WORD_BANDS) -> str:
    """SQL array of (key, same): probes for lines of as many words or fewer, each by the rule of its band."""
    parts = []
    for least, end, edits in _banded(bands):
        there = f"len >= {least}" + (f" AND len < {end + edits}" if end else "")
        places = [f"struct({shorter} AS shorter, {i} AS i, {move} AS move)" for shorter, i, move in _places(edits)]
        inside = f"len - p.shorter >= {least}" + (f" AND len - p.shorter < {end}" if end else "")
        key = f"CASE WHEN {inside} THEN {_segment_hash(edits, 'len - p.shorter', 'p.i', 'p.move', 'slice')} END"
        parts.append(
            f"CASE WHEN {there} THEN transform(array({', '.join(places)}), p -> struct({key} AS key, p.shorter = 0 AS same)) "
            "ELSE cast(array() AS array<struct<key: bigint, same: boolean>>) END"
        )
    return f"concat({', '.join(parts)})"


def word_parities(words: str = "n") -> str:
    """SQL long: bit h % 64 is set if words of hash h occur an odd number of times in this array."""
    return f"aggregate({words}, 0L, (bits, c) -> bits ^ shiftleft(1L, int(xxhash64(c) & 63L)))"


def _without_start(pair: str) -> str:
    """SQL: of a struct of different arrays a and b, b as long or longer, both from where they differ first on, and the size."""
    differ = "greatest(1, int(array_position(zip_with(t.a, t.b, (x, y) -> x <=> y), false)))"
    left = ", ".join(f"slice(t.{c}, p, size(t.{c}) - p + 1) AS {c}" for c in "ab")
    return f"transform(array({pair}), t -> transform(array({differ}), p -> struct(t.size AS size, {left}))[0])[0]"


def _middle_within(edits: int) -> str:
    """SQL for "the arrays t.a and t.b are within the edits"; both ends differ, b is as long or longer.

    Their first and last step is then an edit: with two edits, all between these is alike. For more, ``within_edits``.
    """
    if edits == 1:
        return "size(t.b) <= 1"
    if edits > 2:
        return within_edits("t.a", "t.b", edits)
    # (skipped at the start of a, of b, at the end of a, of b), by how much longer b is
    steps = {0: [(1, 1, 1, 1), (0, 1, 1, 0), (1, 0, 0, 1)], 1: [(0, 1, 1, 1), (1, 1, 0, 1)], 2: [(0, 1, 0, 1)]}
    cases = " ".join(
        f"WHEN {more} THEN " + " OR ".join(f"slice(t.a, {1 + i}, size(t.a) - {i + k}) = slice(t.b, {1 + j}, size(t.b) - {j + m})" for i, j, k, m in ways)
        for more, ways in steps.items()
    )
    return f"(size(t.b) <= 2 OR CASE size(t.b) - size(t.a) {cases} ELSE false END)"


def within_word_edits(a: str, b: str, bands: tuple[tuple[int, int], ...] = WORD_BANDS) -> str:
    """SQL for "a and b differ in as many words as a's band allows"; b has as many words as a or more. Both are arrays,
    and differ. What they begin and end with alike does not count, and is left out first."""
    middle = _without_start(f"struct(size({a}) AS size, {a} AS a, {b} AS b)")
    middle = _without_start(f"transform(array({middle}), t -> struct(t.size AS size, reverse(t.a) AS a, reverse(t.b) AS b))[0]")
    cases = " ".join(f"WHEN t.size >= {least} THEN {_middle_within(edits)}" for least, edits in reversed(bands))
    return f"transform(array({middle}), t -> CASE {cases} ELSE false END)[0]"


def letter_parities() -> str:
    """SQL long: bit c % 64 is set if characters of that code occur an odd number of times in ``n``."""
    return "aggregate(split(n, ''), 0L, (bits, c) -> bits ^ shiftleft(1L, ascii(c) % 64))"


def within_edits(a: str, b: str, edits: int) -> str:
    """SQL for "the edit distance of the arrays a and b is at most ``edits``"; b is as long or up to ``edits`` longer.

    After j characters of b, bit k of vector d tells that the first j + k - edits characters of a match
    with at most d edits. A character of b keeps the diagonals where it matches (mask), and with one more
    edit any diagonal (substitution) or the one below (insertion); a deletion moves one up.
    """
    band, full = 2 * edits + 1, (1 << (2 * edits + 1)) - 1
    compared = " | ".join(
        f"shiftleft(bigint(coalesce(get(s.a, j + {k - edits}) = get(s.b, j), false)), {k})" for k in range(band)
    )

    def old(d: int) -> str:
        return f"(shiftright(v, {d * band}) & {full}L)"

    new = f"({old(0)} & m)"
    vectors = [new]
    for d in range(1, edits + 1):
        new = f"(({old(d)} & m) | {old(d - 1)} | shiftright({old(d - 1)}, 1) | (shiftleft({new}, 1) & {full}L))"
        vectors.append(new)
    step = " | ".join(f"shiftleft({x}, {d * band})" for d, x in enumerate(vectors))
    begin = sum(((1 << (d + 1)) - 1) << (edits + d * band) for d in range(edits + 1))
    masks = f"transform(sequence(0, size(s.b) - 1), j -> {compared})"
    end = f"aggregate({masks}, {begin}L, (v, m) -> {step})"
    return (
        f"transform(array(struct({a} AS a, {b} AS b)), s -> "
        f"(shiftright({end}, {edits * band} + {edits} - (size(s.b) - size(s.a))) & 1L) = 1L)[0]"
    )


def _keyed(classes: DataFrame, edits: int | None) -> DataFrame:
    """Classes with ``len``, their keys as arrays (``probes`` of key and same, ``segments``), their parities (``odd``)
    and how many of these a pair with an index row may differ in (``most``).

    ``edits`` null stands for word edits: the text ``n`` is then an array of words.
    """
    if edits is None:
        classes = classes.withColumn("n", F.split("n", " ")).withColumn("len", F.size("n"))
        exprs = {"probes": word_probe_keys(), "segments": word_index_keys(), "odd": word_parities(), "most": f"2 * ({word_edits('len')})"}
    else:
        classes = classes.withColumn("len", F.length("n"))
        exprs = {"probes": probe_keys(edits), "segments": index_keys(edits), "odd": letter_parities(), "most": str(2 * edits)}
    return classes.withColumns({name: F.expr(sql) for name, sql in exprs.items()})


def _texts_with_parities(texts: DataFrame, edits: int | None) -> DataFrame:
    """The texts (n, h, doc) that are long enough to have keys, with ``len``, ``odd`` and ``most`` as of ``_keyed`` and with
    ``words``, their array of words (null for character edits), written once."""
    words = F.split("n", " ") if edits is None else F.lit(None).cast("array<string>")
    texts = texts.withColumn("words", words).withColumn("len", F.length("n") if edits is not None else F.size("words"))
    odd, most = (word_parities("words"), f"2 * ({word_edits('len')})") if edits is None else (letter_parities(), str(2 * edits))
    texts = texts.filter(F.col("len") >= (WORD_BANDS[0][0] if edits is None else edits + 1))
    return shared_table(texts.withColumn("odd", F.expr(odd)).withColumn("most", F.expr(most)))


def _key_rows(lines: DataFrame, edits: int | None, probing: bool, more: tuple[str, ...] = ()) -> DataFrame:
    """(key, h, *more): the probes, or the index keys, of ``_keyed`` as rows, for lines (n, h, *more).

    A row per place, from a constant list, then its key: Spark compiles this, but not functions over arrays, which
    take some ten times as long a key.
    """
    bands = [(0, None, edits)] if edits is not None else _banded(WORD_BANDS)

    def listed(least: int, end: int | None, own: int) -> list[str]:
        places = _places(own) if probing else [(0, i, 0) for i in range(own + 1)]
        return [
            f"struct({own} AS edits, {least} AS least, {end or (1 << 31) - 1} AS end, {shorter} AS shorter, {i} AS i, {move} AS move)"
            for shorter, i, move in places
        ]

    if edits is None:
        part, lines = "slice", lines.select(F.split("n", " ").alias("n"), F.struct("h", *more).alias("of")).withColumn("len", F.size("n"))
        # the places of all bands that a line of so many words takes part in
        marks = sorted({m for least, end, own in bands for m in (least, *([end + own] if end else []))}, reverse=True)
        cases = []
        for mark in marks:
            held = [x for band in bands if band[0] <= mark and (band[1] is None or mark < band[1] + band[2]) for x in listed(*band)]
            cases.append(f"WHEN size(n) >= {mark} THEN array({', '.join(held)})")
        places = f"CASE {' '.join(cases)} END"
    else:
        part, lines = "substring", lines.select("n", F.struct("h", *more).alias("of"), F.length("n").alias("len"))
        places = f"array({', '.join(listed(*bands[0]))})"
    there, key = _segment("p.edits", "len - p.shorter", "p.i", "p.move", part)
    rows = lines.select("n", "of", "len", F.explode(F.expr(places)).alias("p"))
    rows = rows.filter(f"len - p.shorter >= p.least AND len - p.shorter < p.end AND {there}")
    return rows.select(F.expr(key).alias("key"), "of.*")


def _base(size: str) -> str:
    """SQL for a size with all binary digits after the first three as 0: by it lines of about one size are cut alike."""
    low = f"greatest(0, length(bin({size})) - 3)"
    return f"shiftleft(shiftright({size}, {low}), {low})"


def _common_keys(lines: DataFrame, edits: int | None, words: bool) -> DataFrame:
    """(key, h): few keys of each line (n, h), of which lines within the character edits (unless null), and with
    ``words`` those within the word edits of their bands, have one in common.

    ``tau + 1`` segments are cut from the ``_base`` of the shorter line's size, those of the first half at its
    start and the others at its end. One of them is unchanged with just as many edits before it as there are
    segments, so it moved by no more than those before it, seen from the start, or after it, seen from the end. The first
    and the last segment are thus one key each, which serves the shorter line and the longer one, of any length.

    Lines of ``LONG`` words or more have segments of words for both kinds of edits: one character edit changes two
    neighbouring words at most (a space that goes joins them) and their number by one. With a word left out
    between segments, it thus changes one segment.
    """
    if words:
        own = word_edits
        if edits is not None:
            own = lambda size: f"CASE WHEN {size} >= {LONG} THEN greatest({word_edits(size)}, {edits}) ELSE {word_edits(size)} END"
        kinds = sorted({e for _, e in WORD_BANDS} | ({max(e, edits) for _, e in WORD_BANDS} if edits is not None else set()))
        split = lines.select(F.split("n", " ").alias("n"), "h").withColumn("len", F.size("n"))
        found = _segments_of(split, own, WORD_BANDS[0][0], kinds, "slice", "int(e > 1)")
        if edits is None:
            return found
        few = F.expr(f"octet_length(substring_index(n, ' ', {LONG - 1 + edits})) = octet_length(n)")
        return found.unionByName(_common_keys(lines.filter(few), edits, False))
    return _segments_of(lines.select("n", "h", F.length("n").alias("len")), lambda size: str(edits), edits + 1, [edits], "substring", "0")


def _segments_of(lines: DataFrame, own: Callable[[str], str], least: int, kinds: list[int], part: str, gap: str) -> DataFrame:
    """(key, h): the segments of ``_common_keys`` of lines (n, h, len) of this size or more; ``own`` is the SQL for a
    size's edits, which are among ``kinds``, ``gap`` what is left out between segments."""

    def places(edits: int) -> str:
        found = []
        for i in range(edits + 1):
            before = min(i, edits - i)  # segments before it, seen from the nearer end
            found += [f"struct({i} AS i, {before} AS before, {move} AS move)" for move in range(-before, before + 1)]
        return f"array({', '.join(found)})"

    shorter = F.explode(F.array(*[F.lit(d) for d in range(max(kinds) + 1)]))
    rows = lines.select("n", "h", "len", shorter.alias("d")).filter(f"len - d >= {least}")
    e, base, e1, base1 = (f("(len - d)") if k < 2 else f("(len - d + 1)") for k, f in enumerate((own, _base, own, _base)))
    rows = rows.withColumns({"e": F.expr(e), "base": F.expr(base), "new": F.expr(f"d = 0 OR {e} != {e1} OR {base} != {base1}")}).filter("d <= e AND new")
    cases = " ".join(f"WHEN {edits} THEN {places(edits)}" for edits in kinds)
    size = f"int(greatest(0, base - e * {gap}) div (e + 1))"
    rows = rows.select("n", "h", "len", "e", "base", F.expr(size).alias("size"), F.explode(F.expr(f"CASE e {cases} END")).alias("p"))
    start = f"CASE WHEN 2 * p.i <= e THEN p.before * (size + {gap}) + p.move ELSE len - p.before * (size + {gap}) - size - p.move END"
    rows = rows.withColumn("start", F.expr(f"greatest(1, int(1 + {start}))"))
    return rows.select(F.expr(f"xxhash64('{part}', e, base, p.i, {part}(n, start, size))").alias("key"), "h")


def _meeting(lines: DataFrame, edits: int | None, words: bool, broadcast_classes: int = BROADCAST_CLASSES) -> DataFrame:
    """(n, h, doc): the different texts of lines (n, doc) with their smallest document, as far as they share a key of
    ``_common_keys`` with another text. They are found on hashes, without forming pairs; few are."""
    lines = lines if "h" in lines.columns else lines.withColumn("h", _h1(F.col("n")))
    own = Window.partitionBy("key")
    rows = _common_keys(lines, edits, words).select("h", (F.min("h").over(own) != F.max("h").over(own)).alias("several"))
    involved = shared_table(rows.filter("several").select("h").distinct())
    involved = F.broadcast(involved) if involved.count() <= broadcast_classes else involved
    texts = lines.select("n", "h", "doc").join(involved, "h", "left_semi")
    return shared_table(texts.groupBy("h", "n").agg(F.min("doc").alias("doc")).select("n", "h", "doc"))


def earliest_links(
    lines: DataFrame, edits: int | None = EDITS, without: DataFrame | None = None, broadcast_classes: int = BROADCAST_CLASSES,
    first: int = FIRST, times: int = TIMES, met: bool = False,
) -> DataFrame:
    """(h1, h2, near_doc, near): for each different line text ``n`` of ``lines`` (rid, n; or different texts: n, doc) that has one, the earliest
    other text before it (by smallest document, then by hash) within ``edits`` edits, or within the word edits of
    their bands if ``edits`` is null. With ``met``, ``lines`` are what ``_meeting`` found. Texts whose hashes are in ``without`` (h) look for none, but may be found.

    The lines under a key stand in order. They are compared with its first ``first`` lines; those that found one
    leave the key, the others are compared with the next lines, ``times`` as many as were passed, and so on. So
    a group of near-copies costs a few comparisons for each, and yet every line is compared with all lines before
    it under its keys, up to the earliest that it is within the edits of.
    """
    lines = lines if "doc" in lines.columns else lines.select("n", F.col("rid").alias("doc"))
    texts = _texts_with_parities(lines if met else _meeting(lines, edits, edits is None, broadcast_classes), edits)
    probe = _key_rows(texts, edits, True, ("doc", "odd")).withColumns({"index": F.lit(False), "most": F.lit(0)})
    index = _key_rows(texts, edits, False, ("doc", "odd", "most")).withColumn("index", F.lit(True))
    # a line may stand under a key twice, by probe and by segment: it has one place there
    order = Window.partitionBy("key").orderBy("doc", "h")
    rows = probe.unionByName(index).distinct().withColumn("place", F.dense_rank().over(order))
    rows = shared_table(rows)
    most_places = rows.agg(F.max("place")).first()[0] or 0
    asking = rows if without is None else rows.join(without, "h", "left_anti")
    asking = asking.filter("place > 1")
    done, found = 0, None
    line = "words" if edits is None else "n"
    while done < most_places - 1:
        upto = max(first, done * times)
        there = rows.filter((F.col("place") > done) & (F.col("place") <= upto))
        q, c = asking.alias("q"), there.alias("c")
        meet = (F.col("q.key") == F.col("c.key")) & (F.col("q.index") != F.col("c.index")) & (F.col("q.place") > F.col("c.place"))
        close = F.bit_count(F.col("q.odd").bitwiseXOR(F.col("c.odd"))) <= F.greatest("q.most", "c.most")
        pairs = shared_table(q.join(c, meet & close).select("q.key", F.col("q.h").alias("h"), F.col("c.h").alias("ch")).distinct())
        both = pairs.select("h", "ch").distinct()
        both = both.join(texts.select("h", F.col(line).alias("x"), F.col("len").alias("x_len")), "h")
        both = both.join(texts.select(F.col("h").alias("ch"), F.col(line).alias("y"), F.col("len").alias("y_len"), F.col("doc").alias("c_doc")), "ch")
        # b is the longer one
        a, b = F.when(F.col("x_len") <= F.col("y_len"), F.col("x")).otherwise(F.col("y")), F.when(F.col("x_len") <= F.col("y_len"), F.col("y")).otherwise(F.col("x"))
        both = both.select("h", "ch", "c_doc", a.alias("a"), b.alias("b"))
        same = within_word_edits("a", "b") if edits is None else f"levenshtein(a, b, {edits}) >= 0"
        linked = shared_table(both.filter(F.expr(same)).select("h", "ch", "c_doc"))
        found = linked if found is None else found.unionByName(linked)
        done = upto
        if done < most_places - 1:
            answered = pairs.join(linked, ["h", "ch"]).select("key", "h").distinct()
            asking = shared_table(asking.filter(F.col("place") > done + 1).join(answered, ["key", "h"], "left_anti"))
    if found is None:
        return lines.limit(0).select(_h1(F.col("n")).alias("h1"), _h1(F.col("n")).alias("h2"), F.col("doc").alias("near_doc"), _h1(F.col("n")).alias("near"))
    near = found.groupBy("h").agg(F.min(F.struct(F.col("c_doc").alias("near_doc"), F.col("ch").alias("near"))).alias("x"))
    return near.join(texts.select("h", "n"), "h").select(F.col("h").alias("h1"), _h2(F.col("n")).alias("h2"), "x.near_doc", "x.near")


def all_links(
    lines: DataFrame, edits: int | None = EDITS, broadcast_classes: int = BROADCAST_CLASSES, block: int = BLOCK,
    met: bool = False,
) -> DataFrame:
    """(h1, h2, doc, near, near_doc): every pair of different line texts ``n`` of ``lines`` (rid, n; or different texts: n, doc) within ``edits``
    edits, or within the word edits of their bands if ``edits`` is null, in both directions: hashes and smallest
    document of the one, hash and smallest document of the other.

    With ``met``, ``lines`` are what ``_meeting`` found. Lines that share a key are all compared. A key with many lines is dealt in blocks of its probes and its
    segments, each two of which meet once.
    """
    lines = lines if "doc" in lines.columns else lines.select("n", F.col("rid").alias("doc"))
    texts = _texts_with_parities(lines if met else _meeting(lines, edits, edits is None, broadcast_classes), edits)
    probe = shared_table(_key_rows(texts, edits, True, ("len", "odd")).distinct())
    index = shared_table(_key_rows(texts, edits, False, ("len", "odd", "most")).toDF("key", "ih", "ilen", "iodd", "most"))
    sizes = probe.groupBy("key").agg(F.count("*").alias("n")).join(index.groupBy("key").agg(F.count("*").alias("m")), "key")
    blocks = [F.ceil(F.col(c) / block).cast("int").alias(out) for c, out in (("n", "ps"), ("m", "qs"))]
    large = shared_table(sizes.filter((F.col("n") > block) | (F.col("m") > block)).select("key", *blocks))

    def dealt(rows: DataFrame, h: str, own: str, own_parts: str, other: str, other_parts: str) -> DataFrame:
        parts = {c: F.coalesce(c, F.lit(1)) for c in (own_parts, other_parts)}
        rows = rows.join(large, "key", "left").withColumn(own, F.pmod(F.xxhash64(F.lit(3), h), parts[own_parts]).cast("int"))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), parts[other_parts] - 1))).drop("ps", "qs")

    close = F.bit_count(F.col("odd").bitwiseXOR(F.col("iodd"))) <= F.col("most")
    once = F.when(F.col("len") == F.col("ilen"), F.col("h") > F.col("ih")).otherwise(F.col("h") != F.col("ih"))
    met = dealt(probe, "h", "p", "ps", "q", "qs").join(dealt(index, "ih", "q", "qs", "p", "ps"), ["key", "p", "q"])
    pairs = met.filter(close & once).select("h", "ih").distinct()
    line = "words" if edits is None else "n"
    x, y = (texts.select(F.col("h").alias(h), F.col(line).alias(c), F.struct(F.col("h").alias("h1"), _h2(F.col("n")).alias("h2"), "doc").alias(of))
            for h, c, of in (("h", "b", "of_b"), ("ih", "a", "of_a")))
    # b, the line that probes, is as long or longer
    same = within_word_edits("a", "b") if edits is None else f"levenshtein(a, b, {edits}) >= 0"
    both = shared_table(pairs.join(x, "h").join(y, "ih").filter(F.expr(same)).select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))
    ways = [both.select(f"{c}.*", F.col(f"{d}.h1").alias("near"), F.col(f"{d}.doc").alias("near_doc")) for c, d in ("ab", "ba")]
    return ways[0].unionByName(ways[1])


def _all_near(linkable: DataFrame, edits: int) -> DataFrame:
    """(h1, h2, near_doc, near, n_links): for each line text that has links, what ``earliest_links`` finds, by word
    edits first (null if all are later), and the number of other texts that it is within the edits of."""
    met = _meeting(linkable, edits, True)
    links = all_links(met, None, met=True).withColumn("by_word", F.lit(True)).unionByName(all_links(met, edits, met=True).withColumn("by_word", F.lit(False)))
    links = links.groupBy("h1", "h2", "doc", "near", "near_doc").agg(F.bool_or("by_word").alias("w"), F.bool_or(~F.col("by_word")).alias("c"))
    other = F.struct("near_doc", "near")
    earlier = other < F.struct(F.col("doc").alias("near_doc"), F.col("h1").alias("near"))
    found = links.groupBy("h1", "h2").agg(
        F.count("*").alias("n_links"), F.min(F.when(earlier & F.col("w"), other)).alias("by_word"), F.min(F.when(earlier & F.col("c"), other)).alias("by_char")
    )
    return found.withColumn("x", F.coalesce("by_word", "by_char")).select("h1", "h2", "x.near_doc", "x.near", "n_links")


def _earliest_near(linkable: DataFrame, edits: int) -> DataFrame:
    """(h1, h2, near_doc, near) as of ``_all_near``, without looking for the other links."""
    met = _meeting(linkable, edits, True)
    near = shared_table(earliest_links(met, None, met=True))
    return near.unionByName(earliest_links(met, edits, near.select(F.col("h1").alias("h")).distinct(), met=True))


def line_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS,
    short_lines: bool = False, links: bool = True,
) -> DataFrame:
    """A row per document and line text in it: doc_id, rk (row key), lines (its line numbers, from 0), line (hash of
    the text as it is compared), first_doc_id (smallest document with this text), near and near_doc_id (hash and
    smallest document of the text that represents it: the earliest one before it, by smallest document, then by
    hash, within the word edits of their bands, else within ``edits`` character edits; null if there is none),
    removed_lines (those of its lines that go) and, with ``links``, n_links (how many other texts, earlier or later,
    are within its word edits or character edits).

    Null ids count as 0, null texts as empty, which have no line. Rows that share an id count as one document;
    repeated rows give one result. An empty table gives no rows.
    """
    lines = _lines(docs, id_col, text_col, 1 if short_lines else min_chars)
    n = F.col("n")
    found = shared_table(lines.select("rid", "rk", "line", "n", _h1(n).alias("h1"), _h2(n).alias("h2")))
    classes = found.groupBy("h1", "h2").agg(F.min("rid").alias("first_doc_id"))
    linkable = found.filter(F.length("n") >= min_chars).select("n", F.col("h1").alias("h"), F.col("rid").alias("doc"))
    near = shared_table(_all_near(linkable, edits) if links else _earliest_near(linkable, edits))
    classes = classes.join(near, ["h1", "h2"], "left")
    counted = [F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")] if links else []
    own = found.groupBy("rid", "rk", "h1", "h2").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    late = F.col("near").isNotNull() | (F.col("rid") > F.col("first_doc_id"))
    gone = F.when(late, F.col("lines")).otherwise(F.slice("lines", 2, F.size("lines")))
    return own.join(classes, ["h1", "h2"]).select(
        F.col("rid").alias("doc_id"), "rk", "lines", F.col("h1").alias("line"), "first_doc_id", "near", F.col("near_doc").alias("near_doc_id"),
        gone.alias("removed_lines"), *counted,
    )


def remove_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS,
    short_lines: bool = False,
) -> DataFrame:
    """The documents with all their columns and rows, without the lines that ``line_classes`` removes."""
    classes = line_classes(docs, id_col, text_col, edits, min_chars, short_lines, False).filter(F.size("removed_lines") > 0)
    classes = classes.select(F.col("doc_id").alias("rid"), "rk", "removed_lines")
    rows, name = with_rest(docs, classes.groupBy("rid", "rk").agg(F.flatten(F.collect_set("removed_lines")).alias("gone")), id_col, text_col, "left")
    gone = F.col(name("gone"))
    kept = F.array_join(F.filter(F.split(text_col, "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")
    return rows.withColumn(text_col, F.when(gone.isNull(), F.col(text_col)).otherwise(kept)).select(*docs.columns)

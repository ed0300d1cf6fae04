"""SentencePiece encoding and decoding, with a max-plus scan for giant documents.

The model is a BPE one: its segmentation of a text is the only path through the lattice of pieces in
which every two neighbours are compatible, that is, in which encoding the two together gives the two.
(If a merge crossed the border of two neighbours in the text, the same merge would cross it in the
pair alone, and the other way round.) So a path's weight is the sum of its pieces' scores, with minus
infinity for incompatible neighbours, and encoding is a max-plus product along the text:

* a giant document is cut into chunks at fixed places; a boundary state is a piece that crosses, or ends
  at, the boundary;
* each chunk yields the sparse matrix of best weights from the states at its start to those at its end
  (missing entries are minus infinity), all chunks independently;
* matrices are combined associatively, ``FAN`` neighbours in a round until a document has one, and the states at all
  boundaries are read off from the last round back to the first;
* each chunk is traced back on its own between its two states.

No piece holds the start of a word after its first character, so all states at a word start are one;
inside a chunk only the parts before the first and after the last word start need the lattice. Words in
between, and ordinary documents, are encoded by the library, each different word once per worker.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, python_ready, shared_table
from .units import Memo

GIANT_CHARS = 32_768
CHUNK_CHARS = 8_192
#: Matrices that are combined into one in a round.
FAN = 16
SPACE = "▁"
_WORD_START = re.compile(f"(?<=[^{SPACE}])(?={SPACE})")

State = tuple[int, int]
Matrix = dict[State, dict[State, float]]


class Pieces:
    """The vocabulary of a SentencePiece BPE model file with byte fallback."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = self.model.get_piece_size()
        self.bytes_of = []
        self.ids, self.byte_ids = {}, {}
        for i in range(n):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif self.model.is_control(i) or self.model.is_unknown(i):
                self.bytes_of.append(b"" if self.model.is_control(i) else " ⁇ ".encode())
            else:
                self.ids[piece] = i
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
        if any(_WORD_START.search(p) for p in self.ids):
            raise ValueError("pieces of this model cross word starts")
        self.score = {p: self.model.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self._pairs: dict[tuple[str, str], bool] = {}
        self._whole: dict[str, bool] = {}
        self.memo = Memo(self._encode_words)

    def _encode_words(self, words: list[str]) -> list[bytes]:
        texts = [w[1:].replace(SPACE, " ") for w in words]  # the library puts the first space itself
        found = []
        for w, t, ids in zip(words, texts, self.model.encode(texts, num_threads=1)):
            ids = ids if t else [self.ids[SPACE]]
            found.append(np.asarray(ids, dtype="<i4").tobytes())
        return found

    def merged(self, text: str) -> list[str]:
        """BPE of a short text: the best-scored neighbours that make a piece are joined, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for n in range(len(parts) - 1):
                s = self.score.get(parts[n] + parts[n + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, n
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def whole(self, piece: str) -> bool:
        """Whether the piece comes out of encoding itself; unknown characters stand alone."""
        found = self._whole.get(piece)
        if found is None:
            found = self._whole[piece] = len(piece) == 1 or piece in self.ids and self.merged(piece) == [piece]
        return found

    def compatible(self, a: str, b: str) -> bool:
        found = self._pairs.get((a, b))
        if found is None:
            if len(self._pairs) > 300_000:
                self._pairs.clear()
            found = self._pairs[a, b] = self.merged(a + b) == [a, b]
        return found

    def piece_ids(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        return [i] if i is not None else [self.byte_ids[b] for b in piece.encode()]

    def encode(self, normals: list[str]) -> list[bytes]:
        """Ids (little-endian 32-bit) of normalised texts that start at a word start."""
        words = [
            _WORD_START.split(t) if SPACE * 2 in t else [SPACE + w for w in t[1:].split(SPACE)] if t else []
            for t in normals
        ]
        self.memo.learn(words)
        return [b"".join([self.memo[w] for w in own]) for own in words]

    def decode(self, ids) -> str:
        text = b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def normalised(text: str) -> str:
    """Spaces as the word-start mark, one more in front; empty stays empty."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def sweep(pieces: Pieces, part: str, base: int, begin: list[State | None], start: int, stop: int):
    """Best paths of pieces from each state of ``begin`` until pieces reach ``stop``.

    ``part`` is the text from place ``base`` on. A state (s, e) is the last piece; None stands for a word
    start at ``start``. Returns {(s, e): {begin state: (weight, state before)}} of all states on the way.
    """
    at: dict[int, dict[State | None, dict]] = {}
    for state in begin:
        at.setdefault(start if state is None else state[1], {})[state] = {state: (0.0, None)}
    seen: dict[State | None, dict] = {}
    text_end = base + len(part)
    place = min(at, default=stop)
    while place < stop:
        for state, weights in at.pop(place, {}).items():
            seen[state] = weights
            before = None if state is None else part[state[0] - base : state[1] - base]
            for end in range(place + 1, min(text_end, place + pieces.longest) + 1):
                piece = part[place - base : end - base]
                if not pieces.whole(piece) or before is not None and not pieces.compatible(before, piece):
                    continue
                score = pieces.score.get(piece, 0.0)
                into = at.setdefault(end, {}).setdefault((place, end), {})
                for origin, (weight, _) in weights.items():
                    if origin not in into or weight + score > into[origin][0]:
                        into[origin] = (weight + score, state)
        place += 1
    for states in at.values():
        seen.update(states)
    return seen


def word_starts(part: str, base: int, start: int, stop: int) -> tuple[int, int] | None:
    """First and last word start in start..stop-1 of the text at ``base``; None if there is none."""
    found = [m.start() + base for m in _WORD_START.finditer(part) if start <= m.start() + base < stop]
    if base == 0 and start == 0:
        found = [0, *found]
    return (found[0], found[-1]) if found else None


def entry_states(pieces: Pieces, part: str, base: int, place: int) -> list[State]:
    """All pieces that could cross, or end at, ``place``."""
    return [
        (s, e)
        for s in range(max(base, place - pieces.longest), place)
        for e in range(place, min(base + len(part), s + pieces.longest) + 1)
        if pieces.whole(part[s - base : e - base])
    ]


def chunk_matrix(pieces: Pieces, part: str, base: int, start: int, stop: int) -> Matrix:
    """Best weights between the states at start and stop (without the words in between, which all share)."""
    entries: list[State | None] = [(0, 0)] if start == 0 else entry_states(pieces, part, base, start)
    cuts = word_starts(part, base, start, stop)
    if cuts is None:
        seen = sweep(pieces, part, base, entries, start, stop)
        exits = {s: w for s, w in seen.items() if s is not None and s[0] < stop <= s[1]}
        out: Matrix = {}
        for state, weights in exits.items():
            for origin, (weight, _) in weights.items():
                out.setdefault(origin, {})[state] = weight
        return out
    first, last = cuts
    reach: dict[State, float] = {}
    if start == 0:
        reach[(0, 0)] = 0.0
    else:
        for state, weights in sweep(pieces, part, base, entries, start, first).items():
            if state[1] == first:
                for origin, (weight, _) in weights.items():
                    reach[origin] = max(weight, reach.get(origin, weight))
    seen = sweep(pieces, part, base, [None], last, stop)
    exits = {s: w[None][0] for s, w in seen.items() if s is not None and s[0] < stop <= s[1]}
    return {origin: {s: weight + w for s, w in exits.items()} for origin, weight in reach.items()}


def chunk_ids(pieces: Pieces, part: str, base: int, start: int, stop: int, entry: State, exit_: State) -> list[int]:
    """Ids of the pieces that begin in the chunk, on the best path between two boundary states."""

    def back(seen, origin, state) -> list[int]:
        found = []
        while state != origin:
            found.append(pieces.piece_ids(part[state[0] - base : state[1] - base]))
            state = seen[state][origin][1]
        return [i for ids in reversed(found) for i in ids]

    cuts = word_starts(part, base, start, stop)
    if cuts is None:
        return back(sweep(pieces, part, base, [entry], start, stop), entry, exit_)
    first, last = cuts
    ids = []
    if start:
        seen = sweep(pieces, part, base, [entry], start, first)
        ends = {s: w[entry][0] for s, w in seen.items() if s[1] == first and entry in w}
        ids += back(seen, entry, max(ends, key=ends.get))
    ids += np.frombuffer(pieces.encode([part[first - base : last - base]])[0], dtype="<i4").tolist()
    return ids + back(sweep(pieces, part, base, [None], last, stop), None, exit_)


def combined(a: Matrix, b: Matrix) -> Matrix:
    """Max-plus product."""
    out: Matrix = {}
    for entry, row in a.items():
        best: dict[State, float] = {}
        for middle, weight in row.items():
            for exit_, more in b.get(middle, {}).items():
                if exit_ not in best or weight + more > best[exit_]:
                    best[exit_] = weight + more
        if best:
            out[entry] = best
    return out


def boundary_states(matrices: list[Matrix], entry: State = (0, 0), exit_: State | None = None) -> list[State]:
    """The states of the best path at all boundaries, start and end included, from ``entry`` to ``exit_`` (the best
    one, if none is given)."""
    levels = [matrices]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([combined(*low[n : n + 2]) if n + 1 < len(low) else low[n] for n in range(0, len(low), 2)])
    row = levels[-1][0][entry]
    states = [entry, max(row, key=lambda s: (row[s], s)) if exit_ is None else exit_]
    for low in reversed(levels[:-1]):
        finer = []
        for n in range(len(states) - 1):
            finer.append(states[n])
            if 2 * n + 1 < len(low):
                left, right = low[2 * n][states[n]], low[2 * n + 1]
                ways = {m: w + right[m][states[n + 1]] for m, w in left.items() if states[n + 1] in right.get(m, {})}
                finer.append(max(ways, key=lambda s: (ways[s], s)))
        states = [*finer, states[-1]]
    return states


def _unflat(states, weights) -> Matrix:
    matrix: Matrix = {}
    for (a, b, c, d), w in zip(states, weights):
        matrix.setdefault((int(a), int(b)), {})[int(c), int(d)] = w
    return matrix


def _flat(matrix: Matrix) -> tuple[list[list[int]], list[float]]:
    flat = [(*a, *b, w) for a, row in matrix.items() for b, w in row.items()]
    return [list(x[:4]) for x in flat], [x[4] for x in flat]


MATRIX = "rid long, rk long, k long, states array<array<long>>, weights array<double>"
BOUNDS = "rid long, rk long, k long, entry_from long, entry_to long, exit_from long, exit_to long"


def scanned(matrices: DataFrame, fan: int = FAN) -> DataFrame:
    """Entry and exit state of every chunk on the best path, from the chunks' matrices (rid, rk, k, states, weights).

    Up: ``fan`` neighbours are combined into one matrix, in rounds, until a document has one. Down: the entry and
    exit of a combined matrix give those of the matrices it was made of. No task holds more than ``fan`` of them.
    """

    def up(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k")
        product = reduce(combined, [_unflat(*x) for x in zip(rows["states"], rows["weights"])])
        states, weights = _flat(product)
        return pd.DataFrame({
            "rid": rows["rid"].iloc[:1], "rk": rows["rk"].iloc[:1], "k": rows["k"].iloc[:1] // fan, "states": [states], "weights": [weights],
        })

    def down(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k")
        first = rows.iloc[0]
        end = None if pd.isna(first["exit_from"]) else (int(first["exit_from"]), int(first["exit_to"]))
        some = [_unflat(*x) for x in zip(rows["states"], rows["weights"])]
        found = boundary_states(some, (int(first["entry_from"]), int(first["entry_to"])), end)
        return pd.DataFrame({
            **{c: rows[c].to_numpy() for c in ("rid", "rk", "k")},
            "entry_from": [s[0] for s in found[:-1]], "entry_to": [s[1] for s in found[:-1]],
            "exit_from": [s[0] for s in found[1:]], "exit_to": [s[1] for s in found[1:]],
        })

    above = F.expr(f"k div {fan}").alias("above")
    levels = [shared_table(matrices)]
    last = levels[0].agg(F.max("k")).first()[0] or 0
    while last:
        levels.append(shared_table(levels[-1].groupBy("rid", "rk", above).applyInPandas(up, MATRIX)))
        last //= fan
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    ends = [zero.alias("entry_from"), zero.alias("entry_to"), none.alias("exit_from"), none.alias("exit_to")]
    bounds = levels[-1].select("rid", "rk", zero.alias("above"), *ends)
    for level in reversed(levels):
        rows = level.withColumn("above", above).join(bounds, ["rid", "rk", "above"])
        bounds = shared_table(rows.groupBy("rid", "rk", "above").applyInPandas(down, BOUNDS)).withColumnRenamed("k", "above")
    return bounds.withColumnRenamed("above", "k")


def giant_ids(texts: DataFrame, model_path: str, chunk: int = CHUNK_CHARS) -> DataFrame:
    """(rid, rk, ids) of giant documents (rid, rk, text), by the scan over chunks."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        around = Pieces(model_path).longest + 1
        for batch in batches:
            for rid, rk, text in zip(batch["rid"], batch["rk"], batch["text"]):
                normal = normalised(text)
                starts = list(range(0, len(normal), chunk))
                for n in range(0, len(starts), 64):
                    some = starts[n : n + 64]
                    yield pd.DataFrame({
                        "rid": rid, "rk": rk, "k": [s // chunk for s in some],
                        "base": [max(0, s - around) for s in some], "start": some,
                        "stop": [min(len(normal), s + chunk) for s in some],
                        "part": [normal[max(0, s - around) : s + chunk + around] for s in some],
                    })

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = Pieces(model_path)
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                matrix = chunk_matrix(pieces, r.part, r.base, r.start, r.stop)
                rows.append((r.rid, r.rk, r.k, *_flat(matrix)))
            yield pd.DataFrame(rows, columns=["rid", "rk", "k", "states", "weights"])

    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = Pieces(model_path)
        for batch in batches:
            yield pd.DataFrame([
                (r.rid, r.rk, r.k, chunk_ids(
                    pieces, r.part, r.base, r.start, r.stop, (r.entry_from, r.entry_to), (r.exit_from, r.exit_to)
                ))
                for r in batch.itertuples(index=False)
            ], columns=["rid", "rk", "k", "ids"])

    chunks = texts.mapInPandas(cut, "rid long, rk long, k long, base long, start long, stop long, part string")
    chunks = shared_table(chunks.repartition("rid", "rk", "k"))
    states = scanned(chunks.mapInPandas(weigh, MATRIX))
    traced = chunks.join(states, ["rid", "rk", "k"]).mapInPandas(trace, "rid long, rk long, k long, ids array<int>")
    return traced.groupBy("rid", "rk").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids")
    )


def encode(
    docs: DataFrame, model_path: str, giant_chars: int = GIANT_CHARS, chunk: int = CHUNK_CHARS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, text, ids) of every row. A null text has the ids of an empty one: none.

    The mark that stands for spaces, where a text has it, is encoded as a space. Repeated rows are encoded
    alike; an empty table gives no rows.
    """
    python_ready(docs.sparkSession)
    rows = keyed(docs, id_col, text_col, [id_col]).toDF("rid", "rk", "text", "doc_id")
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    is_giant = F.length("text") > giant_chars

    @F.pandas_udf("array<int>")
    def ordinary(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = Pieces(model_path)
        for texts in batches:
            yield pd.Series([np.frombuffer(ids, dtype="<i4") for ids in pieces.encode([normalised(t) for t in texts])])

    short = rows.filter(~is_giant).select("doc_id", "text", ordinary("text").alias("ids"))
    giant = rows.filter(is_giant)
    found = giant_ids(giant.dropDuplicates(["rid", "rk"]).select("rid", "rk", "text"), model_path, chunk)
    return short.unionByName(giant.join(found, ["rid", "rk"]).select("doc_id", "text", "ids"))


def decode(tokens: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """``tokens`` with ``decoded`` (the text of its ids; null ids give an empty one) and ``ids_crc32``
    (of the ids as little-endian unsigned 32-bit numbers)."""
    python_ready(tokens.sparkSession)

    @F.pandas_udf("decoded string, ids_crc32 long")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pieces = Pieces(model_path)
        for some in batches:
            arrays = [np.asarray([] if x is None else x, dtype="<i4") for x in some]
            yield pd.DataFrame({
                "decoded": [pieces.decode(a.tolist()) for a in arrays],
                "ids_crc32": [zlib.crc32(a.tobytes()) for a in arrays],
            })

    return tokens.withColumn("__read", read(ids_col)).select(*tokens.columns, "__read.decoded", "__read.ids_crc32")

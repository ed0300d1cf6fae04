"""Memoised tokenising of the parts of a text that a tokenizer provably treats on their own.

Texts repeat most of their space-separated words, so a tokenizer is asked only for parts that a
worker has not met, all new parts of a batch in one call. The memo is emptied when full, which
never changes a result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from typing import Any

#: Entries of one worker's memo (about 200 MB at most).
MEMO_ENTRIES = 1_000_000

_SPACED = re.compile(r"(?<=\S)(?=[ \n]\S)")


class Memo(dict):
    """part -> value; ``learn`` gets the missing parts of many texts in one call."""

    def __init__(self, encode: Callable[[list[str]], Sequence[Any]]):
        super().__init__()
        self.encode = encode

    def learn(self, texts: Iterable[Sequence[str]]) -> None:
        if len(self) > MEMO_ENTRIES:
            self.clear()
        # (a set's difference with a dict would walk through the whole dict)
        missing = [p for p in set().union(*texts) if p not in self]
        if missing:
            self.update(zip(missing, self.encode(missing)))

    def values(self, texts: Sequence[Sequence[str]]) -> list[list[Any]]:
        """The values of every text's parts; only texts with an unknown part (or one whose value is None) are
        looked at twice."""
        if len(self) > MEMO_ENTRIES:
            self.clear()
        out = [list(map(self.get, parts)) for parts in texts]
        gaps = [(parts, found, [n for n, v in enumerate(found) if v is None]) for parts, found in zip(texts, out) if None in found]
        missing = [p for p in {parts[n] for parts, _, places in gaps for n in places} if p not in self]
        if missing:
            self.update(zip(missing, self.encode(missing)))
            for parts, found, places in gaps:
                for n in places:
                    found[n] = self[parts[n]]
        return out


def word_parts(text: str) -> list[str]:
    """The first word as " word", those after a space as "word", those after a line feed as "\\nword"."""
    parts = text.replace("\n", " \n").split(" ")
    parts[0] = " " + parts[0]
    return parts


def is_plain(part: str) -> bool:
    """Whether a part of ``word_parts`` starts and ends with a non-blank character after its mark."""
    word = part[1:] if part[:1] in (" ", "\n") else part
    return word != "" and not word[0].isspace() and not word[-1].isspace()


def spaced_parts(text: str) -> list[str]:
    """The text cut before every single space or line feed between two non-blank characters.

    A byte-level pattern ends every match at such a place: its word classes exclude blanks, and a
    blank takes part in a match only with what follows it.
    """
    return _SPACED.split(text) if text else []

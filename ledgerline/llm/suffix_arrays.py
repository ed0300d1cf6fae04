"""Suffix arrays in numpy: Larsson-Sadakane refinement, Kasai's common prefixes, classes of equal windows.

One array covers one shard, whose size its caller bounds.
"""

from __future__ import annotations

import numpy as np

#: Bytes that the first sort compares.
FIRST = 8


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one big-endian number; zeros follow the end."""
    key = np.zeros(len(data) + FIRST, dtype=np.uint64)
    key[: len(data)] = data
    for width in (1, 2, 4):
        key[:-width] = (key[:-width] << np.uint64(8 * width)) | key[width:]
    return key[: len(data)]


def _begins(key: np.ndarray) -> np.ndarray:
    """Whether each number of a sorted array is the first of its value."""
    return np.append(np.ones(min(1, len(key)), dtype=bool), key[1:] != key[:-1])


def _tied(begins: np.ndarray) -> np.ndarray:
    return ~(begins & np.append(begins[1:], True))


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Places of ``data`` (uint8) in the order of the suffixes that start there; a prefix comes first.

    The suffixes are sorted by 8 bytes. Then, as Larsson and Sadakane refine, only groups that are still
    tied are sorted by the group of the place ``h`` further on, and h doubles, until no tie is left.
    """
    n = len(data)
    # zeros at the end would look like missing bytes: begin with single bytes then
    h = 1 if n and data[-1] == 0 else FIRST
    key = data.astype(np.uint64) if h == 1 else eights(data)
    order = np.argsort(key)
    begins = _begins(key[order])
    # rank: the first slot of a group, from 1; past the end of the data it is 0, before all others
    rank = np.zeros(n + 1, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(begins, np.arange(1, n + 1), 0))
    slots = np.flatnonzero(_tied(begins))
    while len(slots):
        places = order[slots]
        # group numbers and ranks are below 2**31: one number to sort by
        key = (rank[places] << 32) | rank[np.minimum(places + h, n)]
        by = np.argsort(key)
        places, begins = places[by], _begins(key[by])
        order[slots] = places
        rank[places] = np.maximum.accumulate(np.where(begins, slots + 1, 0))
        slots = slots[_tied(begins)]
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many bytes each suffix shares with the one before it in ``order`` (the first: 0).

    Kasai's rule says that a place whose suffix and the suffix before it are preceded by the same byte
    shares one byte less than the place to its left. Only the other places are compared, eight bytes at
    a time; the rule, as a running maximum of place + length, gives the rest.
    """
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.int64)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    start = np.flatnonzero(before >= 0)
    other = before[start]
    own = (start == 0) | (other == 0) | (data[start - 1] != data[other - 1])
    start, other = start[own], other[own]
    key = np.append(eights(data), np.zeros(FIRST, dtype=np.uint64))
    reach = np.full(n, -1, dtype=np.int64)  # place + length
    length = np.zeros(len(start), dtype=np.int64)
    active = np.arange(len(start))
    at, to = start, other
    while len(active):
        differ = key[at] ^ key[to]
        room = n - np.maximum(at, to)  # bytes up to the end of the data
        same = np.zeros(len(active), dtype=np.int64)
        for b in range(1, FIRST + 1):
            same += differ >> np.uint64(8 * (FIRST - b)) == 0
        same = np.minimum(same, room)
        length[active] += same
        on = (same == FIRST) & (room > FIRST)
        active, at, to = active[on], at[on] + FIRST, to[on] + FIRST
    reach[start] = start + length
    reach[order[0]] = max(reach[order[0]], order[0])
    shared = np.maximum.accumulate(reach) - np.arange(n)
    shared[order[0]] = 0
    return np.maximum(shared, 0)[order]


def window_classes(strings: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, place, class) of every window of these strings, in suffix order; equal windows have one class.

    The strings are put in a row; a window is a place with ``window`` bytes of its own string behind it,
    so what follows a string never decides.
    """
    data = np.frombuffer(b"".join(strings), dtype=np.uint8)
    sizes = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
    ends = np.cumsum(sizes)
    order = suffix_array(data)
    shared = common_prefixes(data, order)
    left = np.repeat(ends, sizes) - np.arange(len(data))
    number = np.cumsum(shared < window)  # suffixes between two equal windows share them too
    full = left[order] >= window
    places, number = order[full], number[full]
    own = np.repeat(np.arange(len(strings)), sizes)[places]
    return own, places - (ends - sizes)[own], number

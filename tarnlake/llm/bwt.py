"""The Burrows-Wheeler transform of a collection of strings, column by column, with common prefixes.

Every round inserts one symbol of each string, from its end: the suffix that starts there takes its
place among all suffixes met so far. The place follows from the transform alone (the rank of the
symbol at the place of the string's previous suffix), and so do the common prefixes with both
neighbours (one more than the least value between the neighbours' predecessors). Transform, common
prefixes and suffix numbers are sequences that each round reads and writes once, in order.
"""

from __future__ import annotations

import numpy as np

#: Common prefixes are counted up to this many symbols.
CAP = 250


class RangeMin:
    """Least values of ranges of a sequence of bytes: least of all runs of 1, 2, 4 ... values."""

    def __init__(self, values: np.ndarray, longest: int):
        self.levels = [values]
        width = 1
        while 2 * width <= longest:
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def least(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of values[begin:end], none empty."""
        level = np.frexp(end - begin)[1] - 1
        out = np.empty(len(begin), np.uint8)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            row = self.levels[k]
            out[at] = np.minimum(row[begin[at]], row[end[at] - (1 << int(k))])
        return out


def collection_bwt(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Transform, common prefix with the suffix before (at most CAP), string and start of every suffix, in order.

    Strings hold no zero byte; zero is the end mark, smaller than all, and ends are ordered by string.
    The first len(strings) suffixes are the empty ones.
    """
    m = len(strings)
    lengths = np.fromiter(map(len, strings), np.int64, m)
    if not m:
        return np.empty(0, np.uint8), np.empty(0, np.uint8), np.empty(0, np.int32), np.empty(0, np.int64)
    text = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    padded = np.concatenate(([np.uint8(0)], text))

    def symbol(strings_: np.ndarray, inserted: int) -> np.ndarray:
        """What stands before the suffix of that many symbols; zero before a whole string."""
        left = lengths[strings_] - inserted
        return np.where(left > 0, padded[np.maximum(begins[strings_] + left, 0)], 0).astype(np.uint8)

    every = np.arange(m)
    # a suffix is numbered by its string and length
    width = int(lengths.max()) + 1
    bwt, lcp, suffix = symbol(every, 0), np.zeros(m, np.uint8), every * width
    if m * width < 1 << 31:
        suffix = suffix.astype(np.int32)
    active, place = every, every.copy()
    for inserted in range(1, width):
        going = lengths[active] >= inserted
        active, place = active[going], place[going]
        order = np.argsort(bwt, kind="stable")
        rank = np.empty(len(bwt), np.int64)
        rank[order] = np.arange(len(bwt))
        whole = int(np.count_nonzero(bwt == 0))
        at = rank[place]
        new = at - whole + m
        mine = bwt[place]
        # the neighbours that start with the same symbol
        before = order[np.maximum(at - 1, 0)]
        has_before = (at > 0) & (bwt[before] == mine)
        after = order[np.minimum(at + 1, len(order) - 1)]
        has_after = (at + 1 < len(order)) & (bwt[after] == mine)
        spans = np.concatenate(((place - before)[has_before], (after - place)[has_after]))
        ranges = RangeMin(lcp, int(spans.max(initial=1)))
        with_before = np.zeros(len(active), np.uint8)
        with_before[has_before] = np.minimum(ranges.least(before[has_before] + 1, place[has_before] + 1), CAP - 1) + 1
        with_after = np.minimum(ranges.least(place[has_after] + 1, after[has_after] + 1), CAP - 1) + 1
        old = np.ones(len(bwt) + len(active), bool)
        old[new] = False

        def merged(values: np.ndarray, added: np.ndarray) -> np.ndarray:
            out = np.empty(len(old), values.dtype)
            out[old] = values
            out[new] = added
            return out

        lcp = merged(lcp, with_before)
        lcp[new[has_after] + 1] = with_after
        bwt = merged(bwt, symbol(active, inserted))
        suffix = merged(suffix, active * width + inserted)
        place = new
    owner = suffix // width
    return bwt, lcp, owner, lengths[owner] - suffix % width

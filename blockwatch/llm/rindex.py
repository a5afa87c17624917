"""A run-length index of a set of short strings: run-compressed BWT with sampled run ends."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from blockwatch.llm.common import NULL_ID

#: Bits of a position for which three of them fit one sorting key.
_BITS = 21


def _ranked(high: np.ndarray, low: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the pairs (ties by place) and their dense ranks."""
    n = len(high)
    if n <= 1 << _BITS and bits + _BITS <= 64:
        key = (((high << bits // 2) | low) << _BITS) | np.arange(n)
        key.sort()
        order = key & ((1 << _BITS) - 1)
        key >>= _BITS
        new = key[1:] != key[:-1]
    else:
        order = np.lexsort((low, high))
        new = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(new)])
    return order, rank


@dataclass
class RunIndex:
    """Runs of the transform (their first rows and where these map to), the sampled text positions
    of run ends, and for rows grouped by their first ``length`` bytes the smallest document."""

    run_start: np.ndarray
    run_next: np.ndarray
    run_end_at: np.ndarray
    group_start: np.ndarray
    group_first: np.ndarray
    length: int

    @staticmethod
    def of(text: np.ndarray, size: np.ndarray, doc: np.ndarray, length: int) -> RunIndex:
        """Index of strings laid back to back (``size`` bytes each, of the smallest document ``doc``).

        Suffixes are sorted by doubling, each up to the end of its string; equal ones by place, so
        the mapping from a row to the row of the suffix one byte longer keeps order.
        """
        n = len(text) + len(size)
        end = np.cumsum(size + 1) - 1                      # places of the terminators, which sort first
        symbol = np.zeros(n, np.int64)
        inner = np.ones(n, bool)
        inner[end] = False
        symbol[inner] = text.astype(np.int64) + 1
        string = np.repeat(np.arange(len(size)), size + 1)
        stop = end[string]
        place = np.arange(n)

        def ahead(values: np.ndarray, by: int) -> np.ndarray:
            return values[np.minimum(place + by, stop)]    # past its end a string goes on as terminators

        order, rank = _ranked((symbol << 9) | ahead(symbol, 1), (ahead(symbol, 2) << 9) | ahead(symbol, 3), 36)
        step, ranks = 4, {4: rank}
        while step <= int(size.max(initial=0)):
            order, rank = _ranked(rank, ahead(rank, step), 2 * _BITS)
            step *= 2
            ranks[step] = rank
        # Runs of the transform: the byte before each suffix, in order.
        before = symbol[order - 1]                         # of the first place: the last terminator
        head = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        run = np.diff(np.append(head, n))
        by_byte = np.argsort(before[head], kind="stable")
        to = np.empty(len(head), np.int64)
        to[by_byte] = np.cumsum(run[by_byte]) - run[by_byte]
        # Rows that agree in their first ``length`` bytes.
        apart, at = np.zeros(n - 1, bool), 0
        for m in sorted(ranks, reverse=True):
            while at + m <= length:
                r = ahead(ranks[m], at)[order]
                apart |= r[1:] != r[:-1]
                at += m
        if at < length:
            r = ahead(ranks[4], length - 4)[order]
            apart |= r[1:] != r[:-1]
        groups = np.flatnonzero(np.concatenate([[True], apart]))
        whole = (stop[order] - order) >= length
        first = np.minimum.reduceat(np.where(whole, doc[string[order]], NULL_ID), groups)
        return RunIndex(head, to, order[head + run - 1], groups, first, length)

    def matches(self, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Streams the indexed strings from their ends through the runs. For every place at which
        ``length`` bytes are left: the smallest document that has these bytes. Back to back, with
        the offset of each string."""
        count = np.maximum(size - self.length + 1, 0)
        offset = np.concatenate([[0], np.cumsum(count)])
        out = np.full(offset[-1], NULL_ID)
        # Rank directories: the run, and the group, of each row.
        rows = np.arange(int(size.sum()) + len(size))
        run_of = np.searchsorted(self.run_start, rows, side="right").astype(np.int32) - 1
        first_of = self.group_first[np.searchsorted(self.group_start, rows, side="right") - 1]
        shift = self.run_next - self.run_start
        longest = np.argsort(-size, kind="stable")
        row = longest.copy()                               # a terminator's row is its string's number
        sizes = size[longest]
        for t in range(1, int(size.max(initial=0)) + 1):
            alive = int(np.searchsorted(-sizes, -t, side="right"))
            row = row[:alive]
            row = row + shift[run_of[row]]
            if t >= self.length:
                own = longest[:alive]
                out[offset[own] + size[own] - t] = first_of[row]
        return out, offset

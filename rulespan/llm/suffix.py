"""Suffix arrays with common-prefix values by external induced sorting.

A suffix is S-type if it is smaller than the next one, else L-type; S* suffixes are
S-type ones after an L-type. Sorting the S* suffixes (by recursion on the names of
the stretches between them) induces the order of all others: a suffix is decided by
the tuple (symbols and types up to the next S* suffix, that suffix's rank). Tuples are
carried by priority queues that keep a bounded buffer and spill sorted runs to disk,
so a text needs a few integers of address space a symbol (disk-backed arrays) and
only the buffers in memory.

Common prefixes of suffixes that differ within a stretch are counted there; those that
agree to the next S* add the least of the S* suffixes' common prefixes between their
ranks, which the recursion carries up.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

#: Tuples that a queue holds in memory before it writes a sorted run.
BUFFER = 4_000_000


class TupleQueue:
    """A disk-backed priority queue of (key, place) tuples, filled and then emptied."""

    def __init__(self, folder: str, buffer: int = BUFFER):
        self.folder, self.buffer = folder, buffer
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0
        self.runs: list[tuple[str, int]] = []

    def push(self, key: np.ndarray, place: np.ndarray) -> None:
        self.held.append((key, place))
        self.size += len(key)
        if self.size >= self.buffer:
            self._spill()

    def _sorted(self) -> tuple[np.ndarray, np.ndarray]:
        key = np.concatenate([k for k, _ in self.held]) if self.held else np.zeros(0, np.int64)
        place = np.concatenate([p for _, p in self.held]) if self.held else np.zeros(0, np.int64)
        self.held, self.size = [], 0
        order = np.argsort(key)
        return key[order], place[order]

    def _spill(self) -> None:
        key, place = self._sorted()
        fd, path = tempfile.mkstemp(dir=self.folder, suffix=".run")
        os.close(fd)
        np.stack([key, place]).tofile(path)
        self.runs.append((path, len(key)))

    def pop_all(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of tuples in the order of their keys. Equal keys may span blocks."""
        if not self.runs:
            yield self._sorted()
            return
        if self.size:
            self._spill()
        maps = [np.memmap(p, np.int64, "r", shape=(2, n)) for p, n in self.runs]
        at = [0] * len(maps)
        step = max(1024, self.buffer // (2 * len(maps)))
        while True:
            live = [i for i, m in enumerate(maps) if at[i] < m.shape[1]]
            if not live:
                break
            # All tuples up to the least of the blocks' last keys are safe to take.
            edge = min(int(maps[i][0, min(at[i] + step, maps[i].shape[1]) - 1]) for i in live)
            keys, places = [], []
            for i in live:
                stop = at[i] + int(np.searchsorted(maps[i][0, at[i] : at[i] + step], edge, "right"))
                keys.append(np.array(maps[i][0, at[i] : stop]))
                places.append(np.array(maps[i][1, at[i] : stop]))
                at[i] = stop
            key, place = np.concatenate(keys), np.concatenate(places)
            order = np.argsort(key)
            yield key[order], place[order]
        del maps
        for path, _ in self.runs:
            os.unlink(path)


class External:
    """Arrays and queues of one sort: in memory up to the buffer's size, else on disk."""

    def __init__(self, folder: str, buffer: int = BUFFER):
        self.folder, self.buffer = folder, buffer

    def array(self, n: int, dtype=np.int32) -> np.ndarray:
        if n <= self.buffer:
            return np.zeros(n, dtype)
        fd, path = tempfile.mkstemp(dir=self.folder, suffix=".array")
        os.close(fd)
        out = np.memmap(path, dtype, "w+", shape=(n,))
        os.unlink(path)
        return out

    def pieces(self, n: int) -> Iterator[slice]:
        step = max(1, self.buffer // 2)
        return (slice(a, min(a + step, n)) for a in range(0, n, step))

    def queue(self) -> TupleQueue:
        return TupleQueue(self.folder, self.buffer)

    def rank(self, tuples: Iterator[tuple[np.ndarray, np.ndarray]], out: np.ndarray, base: np.ndarray | None = None) -> int:
        """Write each place's rank by key into ``out``: how many tuples have a lesser key,
        or, where ``base`` has a value for each place and the keys begin with it, base plus
        how many of the same base have a lesser key. Returns the number of distinct keys."""
        q = self.queue()
        for key, place in tuples:
            q.push(key, place)
        seen, distinct, last, start, group, group_start = 0, 0, None, 0, None, 0
        for key, place in q.pop_all():
            if not len(key):
                continue
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            new[0] = last is None or key[0] != last
            at = seen + np.arange(len(key))
            first = np.maximum.accumulate(np.where(new, at, -1))
            first[first < 0] = start
            if base is None:
                out[place] = first
            else:
                own = base[place]
                opens = np.ones(len(own), bool)
                opens[1:] = own[1:] != own[:-1]
                opens[0] = group is None or own[0] != group
                head = np.maximum.accumulate(np.where(opens, at, -1))
                head[head < 0] = group_start
                out[place] = own + first - head
                group, group_start = own[-1], int(head[-1])
            last, start = key[-1], int(first[-1])
            seen, distinct = seen + len(key), distinct + int(new.sum())
        return distinct


def _last_before(mark: np.ndarray, fill: int) -> np.ndarray:
    """For each position the next marked position at or after it, or ``fill``."""
    n = len(mark)
    at = np.where(mark, np.arange(n, dtype=np.int64), fill)
    return np.minimum.accumulate(at[::-1])[::-1]


class Minima:
    """Least value of any stretch of an array, by a table over powers of two."""

    def __init__(self, values: np.ndarray):
        self.rows = [np.asarray(values)]
        while 2 << (len(self.rows) - 1) <= len(values):
            prev, h = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(prev[:-h], prev[h:]))

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of the values from ``first`` to ``last``, both included, first <= last."""
        out = np.zeros(len(first), np.int64)
        level = np.frexp((last - first + 1).astype(float))[1] - 1
        for k in np.unique(level):
            pick = level == k
            row = self.rows[k]
            out[pick] = np.minimum(row[first[pick]], row[last[pick] - (1 << int(k)) + 1])
        return out


def sort_suffixes(text: np.ndarray, ext: External, depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(order, common) of a text whose last symbol is 0 and nowhere else.

    ``order`` is the suffix array; ``common[i]`` the symbols that the suffixes order[i]
    and order[i - 1] share at their start."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    # Types: a run of equal symbols has the type that its end has.
    differs = np.ones(n, bool)
    differs[:-1] = text[1:] != text[:-1]
    run_end = _last_before(differs, n - 1)
    small = np.zeros(n, bool)
    small[:-1] = text[np.minimum(run_end[:-1] + 1, n - 1)] > text[run_end[:-1]]
    small[-1] = True
    star = np.zeros(n, bool)
    star[1:] = small[1:] & ~small[:-1]
    star_at = np.flatnonzero(star)
    m = len(star_at)
    # The next S* position after each one; the last symbol is S*, as nothing is smaller.
    after = ext.array(n + 1, np.int64)
    after[:-1] = _last_before(star, n - 1)
    after[-1] = n - 1
    nxt = after[1:]
    nxt[n - 1] = n - 1
    index = np.cumsum(star) - 1
    code = 2 * text.astype(np.int64) + small + 1
    # A name is the rank of a stretch's first symbols: as many as one key can hold, then twice
    # as many, until stretches are whole. No stretch begins another, so ends need no mark.
    # Places n and beyond stand for the S* suffixes as ends of stretches: one symbol.
    size = n + m
    bits = max(1, int(code.max()).bit_length())
    width = max(1, 62 // bits)
    whole = ext.array(size, np.int64)

    def first():
        for p in ext.pieces(size):
            place = np.arange(p.start, p.stop)
            at = np.where(place < n, place, star_at[np.maximum(place - n, 0) % m])
            end = np.where(place < n, nxt[np.minimum(place, n - 1)], at)
            key = np.zeros(len(place), np.int64)
            for t in range(width):
                key = (key << bits) | np.where(at + t <= end, code[np.minimum(at + t, n - 1)], 0)
            yield key, place

    ext.rank(first(), whole)
    longest, k = int((nxt - np.arange(n)).max()) + 1, width
    while k < longest:

        def pairs(k=k):
            for p in ext.pieces(n):
                place = p.start + np.flatnonzero(nxt[p] - np.arange(p.start, p.stop) >= k)
                far = np.where(place + k == nxt[place], n + index[nxt[place]], place + k)
                yield whole[place] * (size + 1) + whole[far], place

        # New names are written once all pairs are in the queue.
        ext.rank(pairs(), whole, whole)
        k *= 2

    def differing(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common symbols of suffixes whose stretches differ."""
        out = np.zeros(len(i), np.int64)
        live, a, b, off = np.arange(len(i)), i, j, 0
        while len(live):
            match = code[a] == code[b]
            # Same symbol, other type: the shorter of the two runs is still shared.
            x, y = a[~match], b[~match]
            out[live[~match]] = off + np.where(text[x] == text[y], np.minimum(run_end[x] - x, run_end[y] - y) + 1, 0)
            live, a, b, off = live[match], a[match] + 1, b[match] + 1, off + 1
        return out

    # S* suffixes: by the names of their stretches, by recursion where names repeat.
    star_name = ext.array(m, np.int64)
    distinct = ext.rank(((whole[star_at[p]], np.arange(p.start, p.stop)) for p in ext.pieces(m)), star_name)
    if distinct == m:
        star_order = np.empty(m, np.int64)
        star_order[star_name] = np.arange(m)
        agree = np.zeros(m, np.int64)
    else:
        # The last S* suffix is the last symbol alone, the least name and seen once.
        star_order, agree = sort_suffixes(np.asarray(star_name), ext, depth + 1)
    star_rank = np.empty(m, np.int64)
    star_rank[star_order] = np.arange(m)
    star_common = np.zeros(m, np.int64)
    if m > 1:
        x, y = star_order[1:], star_order[:-1]
        skip = agree[1:]
        a, b = star_at[np.minimum(x + skip, m - 1)], star_at[np.minimum(y + skip, m - 1)]
        star_common[1:] = a - star_at[x] + differing(a, b)
    least = Minima(star_common)
    # Induce: the tuple (stretch, rank of the S* suffix at its end) decides.
    q = ext.queue()
    for p in ext.pieces(n):
        q.push(whole[p] * (m + 1) + star_rank[index[nxt[p]]], np.arange(p.start, p.stop))
    order, common = ext.array(n, np.int64), ext.array(n, np.int64)
    at, last = 0, None
    for key, place in q.pop_all():
        if not len(key):
            continue
        order[at : at + len(place)] = place
        prev = np.concatenate([[place[0] if last is None else last], place[:-1]])
        known = np.ones(len(place), bool)
        known[0] = last is not None
        same = (whole[place] == whole[prev]) & known
        value = np.zeros(len(place), np.int64)
        i, j = place[same], prev[same]
        if len(i):
            high, low = star_rank[index[nxt[i]]], star_rank[index[nxt[j]]]
            end = (i == n - 1) | (j == n - 1)
            value[same] = np.where(end, 0, nxt[i] - i + least(np.minimum(low + 1, high), high))
        other = ~same & known
        value[other] = differing(place[other], prev[other])
        common[at : at + len(place)] = value
        at, last = at + len(place), place[-1]
    return order, common

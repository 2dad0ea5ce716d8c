"""Elias-Fano sequences: monotone integers in about 2 + log2(universe / n) bits each.

Low bits are packed; high bits are a unary bit vector with a running count of ones for
each 64-bit word. Access and successor search work on whole arrays of queries, on
memory-mapped parts.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Ranks that are selected at a time.
SELECTED = 1 << 16
#: Integers that are coded at a time.
BUILT = 1 << 18
#: Every second bit, two bits of four, and four of eight; the lowest and the highest bit of each byte.
EACH = U(0x5555555555555555), U(0x3333333333333333), U(0x0F0F0F0F0F0F0F0F)
ONES, TOPS = U(0x0101010101010101), U(0x8080808080808080)
_POP8 = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: The place of the k-th one of a byte.
_SELECT8 = np.array([[([j for j in range(8) if i >> j & 1] + [0] * 8)[k] for k in range(8)] for i in range(256)], np.uint8)


def _select(words: np.ndarray, before: np.ndarray, rank: np.ndarray, zeros: bool = False) -> np.ndarray:
    """Places of the ones (or zeros) of the given ranks. ``before``: how many come before each word."""
    if len(rank) > SELECTED:
        return np.concatenate([_select(words, before, rank[i : i + SELECTED], zeros) for i in range(0, len(rank), SELECTED)])
    word = np.searchsorted(before, rank, "right") - 1
    own = ~words[word] if zeros else words[word]
    left = (rank - before[word]).astype(U)
    # Ones of each byte, then of all bytes up to it, eight sums in a word.
    sums = own - ((own >> U(1)) & EACH[0])
    sums = (sums & EACH[1]) + ((sums >> U(2)) & EACH[1])
    sums = ((sums + (sums >> U(4))) & EACH[2]) * ONES
    # The byte is the number of bytes whose sum does not exceed the rank.
    shift = np.bitwise_count(((left * ONES) | TOPS) - sums & TOPS).astype(U) << U(3)
    left -= ((sums << U(8)) >> shift) & U(255)
    octet = (own >> shift) & U(255)
    return word * 64 + shift.astype(np.int64) + _SELECT8.ravel()[((octet << U(3)) | left).astype(np.int64)]


def _window(words: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The 64 bits from each place on."""
    word, shift = place >> 6, (place & 63).astype(U)
    out = words[word] >> shift
    cut = np.flatnonzero(shift)
    out[cut] |= words[np.minimum(word[cut] + 1, len(words) - 1)] << (U(64) - shift[cut])
    return out


def _trailing(bits: np.ndarray) -> np.ndarray:
    """How many zeros come before the first one of each word, 64 if there is none."""
    return np.bitwise_count(~bits & (bits - U(1))).astype(np.int64)


class EliasFano:
    """``n`` non-decreasing integers below ``universe``."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.n, self.low_bits = n, low_bits
        self.low, self.high, self.ones, self.zeros = low, high, ones, zeros

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        bits = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        low = np.zeros((n * bits + 63) // 64 + 2, U)
        size = ((int(universe) >> bits) + n) // 64 + 2
        high = np.zeros(size, U)
        for start in range(0, n, BUILT):
            v = values[start : start + BUILT].astype(U)
            i = np.arange(start, start + len(v), dtype=np.int64)
            if bits:
                part = v & U((1 << bits) - 1)
                at = i * bits
                word, shift = at >> 6, (at & 63).astype(U)
                # Values share no bits, and sums are faster here than "or".
                np.add.at(low, word, part << shift)
                spill = (at & 63) + bits > 64
                np.add.at(low, word[spill] + 1, part[spill] >> (U(64) - shift[spill]))
            place = (v >> U(bits)).astype(np.int64) + i
            np.add.at(high, place >> 6, U(1) << (place & 63).astype(U))
        count = _POP8[high.view(np.uint8)].reshape(-1, 8).sum(axis=1)
        ones = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.uint32)
        return cls(n, bits, low, high, ones, (np.arange(size) * 64 - ones).astype(np.uint32))

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], np.int64), self.low, self.high, self.ones, self.zeros]

    @classmethod
    def of(cls, parts: list[np.ndarray]) -> EliasFano:
        return cls(int(parts[0][0]), int(parts[0][1]), *parts[1:])

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), U)
        at = i.astype(np.int64) * self.low_bits
        word, shift = at >> 6, (at & 63).astype(U)
        value = self.low[word] >> shift
        over = (at & 63) > 64 - self.low_bits
        value[over] |= self.low[word[over] + 1] << (U(64) - shift[over])
        return value & U((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at the given places."""
        if not len(i):
            return np.zeros(0, U)
        i = i.astype(np.int64)
        return ((_select(self.high, self.ones, i) - i).astype(U) << U(self.low_bits)) | self._low(i)

    def access_two(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values at the given places and at those after them."""
        if not len(i):
            return np.zeros(0, U), np.zeros(0, U)
        i = i.astype(np.int64)
        place = _select(self.high, self.ones, i)
        step = _trailing(_window(self.high, place + 1))
        after = place + 1 + step
        far = np.flatnonzero(step == 64)
        if len(far):
            after[far] = _select(self.high, self.ones, i[far] + 1)
        low = U(self.low_bits)
        return ((place - i).astype(U) << low) | self._low(i), ((after - i - 1).astype(U) << low) | self._low(i + 1)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The place of the first value >= x, n if there is none."""
        if not len(x) or not self.n:
            return np.zeros(len(x), np.int64)
        x = x.astype(U)
        h = (x >> U(self.low_bits)).astype(np.int64)
        first, stop = self._bucket(h)
        low = x & U((1 << self.low_bits) - 1)
        return self._first_at_least(first, stop, low)

    def _bucket(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the values whose high bits are ``h``: from after the h-th zero to the next."""
        most = len(self.high) * 64 - self.n - 1
        capped = np.minimum(h, most)
        # Where the bucket's bits begin: after the zero before it.
        place = np.zeros(len(h), np.int64)
        some = np.flatnonzero(h > 0)
        place[some] = _select(self.high, self.zeros, capped[some] - 1, True) + 1
        first = place - capped
        run = _trailing(~_window(self.high, place))
        stop = first + run
        long = np.flatnonzero(run == 64)
        if len(long):
            stop[long] = _select(self.high, self.zeros, capped[long], True) - capped[long]
        return np.minimum(first, self.n), np.minimum(stop, self.n)

    def _first_at_least(self, first: np.ndarray, stop: np.ndarray, low: np.ndarray) -> np.ndarray:
        """In each bucket the first place whose low bits reach ``low``, else its end."""
        lo, hi = first.copy(), stop.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self._low(mid) < low[live]
            lo[live[less]] = mid[less] + 1
            hi[live[~less]] = mid[~less]
            live = live[lo[live] < hi[live]]
        return lo

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of a value equal to x (of several the last in their bucket), -1 if there is none."""
        if not len(x) or not self.n:
            return np.full(len(x), -1, np.int64)
        x = x.astype(U)
        low = x & U((1 << self.low_bits) - 1)
        lo, stop = self._bucket((x >> U(self.low_bits)).astype(np.int64))
        # The last place whose low bits don't exceed those of x, or the bucket's first; a place alone needs no search.
        hi = stop.copy()
        live = np.flatnonzero(hi - lo > 1)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            more = self._low(mid) > low[live]
            hi[live[more]] = mid[more]
            lo[live[~more]] = mid[~more]
            live = live[hi[live] - lo[live] > 1]
        hit = lo < stop
        hit[hit] = self._low(lo[hit]) == low[hit]
        return np.where(hit, lo, -1)

"""Vectorised text primitives over Arrow batches: words, rolling hashes, minimizers.

Hashes are the same in every process and on every run: their tables come from a
fixed seed. A word or byte sequence hashes to sum(h[i] * M**i) mod 2**64 with
random 64-bit symbols ``h``, so any window of a long text costs two lookups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20240229)
#: Random symbols for a byte at an offset within its word.
SYMBOL = _rng.integers(0, 2**64, size=64 * 256, dtype=U)
MULT = int(_rng.integers(2**62, 2**63)) * 2 + 1
INVERSE = pow(MULT, -1, 2**64)
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = np.ones(1, U), np.ones(1, U)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """M**i and M**-i for i below n, kept for the next call."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << int(n).bit_length()
        up, down = np.full(size, U(MULT)), np.full(size, U(INVERSE))
        up[0] = down[0] = 1
        _powers = np.cumprod(up), np.cumprod(down)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose outputs look random."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def slices(column: pa.Array, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of runs of rows of at most ``limit`` bytes,
    one row at least. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        last = min(last, len(column))
        yield row, last, data[offs[row] : offs[last]], offs[row : last + 1] - offs[row]
        row = last


class Words:
    """Words of a run of texts: starts, ends, the text each lies in, and their hashes."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool = False):
        self.data = data = LOWER[data] if lower else data
        self.offs = offs
        inside = ~SEPARATOR[data]
        first = np.zeros(len(data) + 1, bool)
        first[offs] = True
        start = inside.copy()
        start[1:] &= ~inside[:-1] | first[1:-1]
        end = inside.copy()
        end[:-1] &= ~inside[1:] | first[1:-1]
        self.start = np.flatnonzero(start)
        self.end = np.flatnonzero(end) + 1
        self.doc = np.searchsorted(offs, self.start, "right") - 1
        #: The words of text i are those from bound[i] to bound[i + 1].
        self.bound = np.searchsorted(self.start, offs)
        if not len(self.start):
            self.hash = np.zeros(0, U)
            return
        size = self.end - self.start
        at = np.flatnonzero(inside)
        off = at - np.repeat(self.start, size)
        value = SYMBOL[((off & 63) << 8) + data[at]]
        if size.max() > 64:
            value = value * (U(2) * (off >> 6).astype(U) + U(1))
        head = np.zeros(len(size), np.int64)
        np.cumsum(size[:-1], out=head[1:])
        self.hash = np.add.reduceat(value, head)

    def texts(self) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.start.tolist(), self.end.tolist())]


class Rolling:
    """Hashes of any stretch of a sequence of 64-bit symbols."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        up, self.down = powers(self.n + 1)
        self.total = np.zeros(self.n + 1, U)
        np.cumsum(symbols * up[: self.n], out=self.total[1:])

    def windows(self, k: int) -> np.ndarray:
        """The hash of each k symbols in a row."""
        m = self.n - k + 1
        if m <= 0:
            return np.zeros(0, U)
        return mix((self.total[k:] - self.total[:m]) * self.down[:m])

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.total[stop] - self.total[start]) * self.down[start])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w values in a row, in three passes whatever w is."""
    m = len(x) - w + 1
    if m <= 0:
        return x[:0]
    padded = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    block = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:m], ahead[w - 1 : w - 1 + m])


def anchor_runs(roll: Rolling, bound: np.ndarray, window: int, gram: int, grams: np.ndarray | None = None):
    """Cut the windows of each text into runs that share their least gram.

    Equal windows have equal least grams, so windows of different runs can only be
    equal if the runs have the same anchor. Returns (text, first window, number of
    windows, anchor, hash of the symbols that the run's windows cover)."""
    least = sliding_min(roll.windows(gram) if grams is None else grams, window - gram + 1)
    empty = np.zeros(0, np.int64)
    if not len(least):
        return empty, empty, empty, np.zeros(0, U), np.zeros(0, U)
    sizes = np.diff(bound)
    whole = np.zeros(roll.n + 1, np.int32)
    long = sizes >= window
    whole[bound[:-1][long]] += 1
    np.add.at(whole, bound[1:][long] - window + 1, -1)
    valid = np.cumsum(whole)[: len(least)] > 0
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    edge = bound[:-1]
    edge = edge[edge < len(least)]
    first[edge] = valid[edge]
    start = np.flatnonzero(first)
    if not len(start):
        return empty, empty, empty, np.zeros(0, U), np.zeros(0, U)
    count = np.add.reduceat(valid, start, dtype=np.int64)
    text = np.searchsorted(bound, start, "right") - 1
    return text, start, count, least[start], roll.spans(start, start + count - 1 + window)


def i64(x: np.ndarray) -> np.ndarray:
    return x.astype(U).view(np.int64)


def cover(n: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Which of n positions lie in any of the spans."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, start, 1)
    np.add.at(d, stop, -1)
    return np.cumsum(d)[:n] > 0

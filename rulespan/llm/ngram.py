"""Language-model scoring with an Elias-Fano n-gram trie.

The model interpolates orders by absolute discounting: p(w|h) = q(hw) + b(h) p(w|h'), where
q is (c - D) / c(h) for a kept n-gram hw of count c and 0 for others, and b(h) is what the
kept ones of the context leave, so that probabilities of a context sum to one. The
lowest order is the add-0.1 unigram. N-grams are kept from ``least`` occurrences on (by
default all are), and from order 3 only if the (n-1)-grams they consist of are kept.

A level is a table of shards, each a file of the shared folder with monotone pointers to
the children of each context number, the children's word ids and the running sum of their
counts, all Elias-Fano coded; ids are stored relative to their context (a stride after the
context's before it), which makes one monotone sequence of them and the search for a
child a successor search within the context's bounds. The smoothed parts q and
b are quantised to 16 bits of their logarithms, downwards, so a context's probabilities
never sum to more than one. Shards are memory-mapped, a bounded number at a time, so a
model larger than memory is paged in; they grow with the corpus in number, not in size.

N-grams are counted in blocks, packed and dealt by ranges of equal numbers of
occurrences; a common context's children may lie in several ranges. A range is sorted by
a queue that goes to disk, and read off into shards of bounded size.

Words are numbered by their hashes' order in the first level, which is sharded by the
hashes' first bits.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulespan.llm.common import giving_back, materialize, new_path, release
from rulespan.llm.elias_fano import EliasFano
from rulespan.llm.suffix import TupleQueue
from rulespan.llm.textkit import Words, i64, mix, slices

U = np.uint64
#: The end of a text, as a word, and the context of its first word.
END = int(mix(np.array([0x656E64], U))[0])
ORDER = 3
LEAST = 1
DISCOUNT = 0.75
#: Words, and n-grams, of a shard, at most about.
SHARD = 1_500_000
#: Occurrences of n-grams that one task sorts, about, and those it holds in memory.
DEALT = 3_000_000
#: Occurrences for which a further task and shard are worth their while, and tasks in any case.
WORTH = 1_000_000
TASKS = 12
SORTED = 1_000_000
#: Tokens that are counted and looked up at a time; one text at least.
COUNTED = 2_000_000
TOKENS = 1_000_000
SLICE = 1 << 18
#: Bytes of text whose words are looked up at a time.
NUMBERED = 1 << 21
#: Shards that a process maps at a time.
MAPPED = 256
#: Quantised log10 values lie between this and 0.
FLOOR = -9.0
STEPS = 65535


def quantise(x: np.ndarray) -> np.ndarray:
    """Values in (0, 1] as 16 bits of their log10, rounded down."""
    return np.clip(np.ceil(np.log10(x) / FLOOR * STEPS - 1e-9), 0, STEPS).astype(np.uint16)


VALUES = 10 ** (np.arange(STEPS + 1) * (FLOOR / STEPS))


def value_of(q: np.ndarray) -> np.ndarray:
    return VALUES[q]


def by_context(context: np.ndarray, word: np.ndarray, words: int) -> np.ndarray:
    """The order of n-grams by context and word."""
    bits = max(1, (words - 1).bit_length())
    if not len(context) or int(context.max()) >> (63 - bits) == 0:
        return np.argsort((context << bits) | word)
    return np.lexsort((word, context))


def save(uri: str, arrays: dict[str, np.ndarray]) -> str:
    """Write arrays to a new file under ``uri`` as (header length, header, data); its name."""
    store, base = pafs.FileSystem.from_uri(uri)
    store.create_dir(base, recursive=True)
    head, at = [], 0
    for name, a in arrays.items():
        head.append((name, a.dtype.str, len(a), at))
        at += (a.nbytes + 63) & ~63
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    file = uuid.uuid4().hex
    with store.open_output_stream(f"{base}/_{file}") as f:
        f.write(len(text).to_bytes(8, "little") + text)
        for a in arrays.values():
            f.write(a.tobytes() + bytes(-a.nbytes % 64))
    store.move(f"{base}/_{file}", f"{base}/{file}")
    return file


_maps: OrderedDict[str, dict[str, np.ndarray]] = OrderedDict()


def load(uri: str, file: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped; the last ``MAPPED`` are kept for the process's
    next calls. A store that isn't a local path is copied to a file that is unlinked once
    it is mapped."""
    key = f"{uri}/{file}"
    if key in _maps:
        _maps.move_to_end(key)
        return _maps[key]
    store, base = pafs.FileSystem.from_uri(key)
    if isinstance(store, pafs.LocalFileSystem):
        raw = np.memmap(base, np.uint8, "r").view(np.ndarray)
    else:
        fd, path = tempfile.mkstemp()
        with os.fdopen(fd, "wb") as out, store.open_input_stream(base) as f:
            while part := f.read(1 << 22):
                out.write(part)
        raw = np.memmap(path, np.uint8, "r").view(np.ndarray)
        os.unlink(path)
    size = int.from_bytes(bytes(raw[:8]), "little")
    head = json.loads(bytes(raw[8 : 8 + size]))
    start = 8 + size
    _maps[key] = {name: raw[start + at : start + at + n * np.dtype(kind).itemsize].view(kind) for name, kind, n, at in head}
    while len(_maps) > MAPPED:
        _maps.popitem(last=False)
    return _maps[key]


def _packed(name: str, ef: EliasFano) -> dict[str, np.ndarray]:
    return {f"{name}{i}": a for i, a in enumerate(ef.parts())}


def _unpacked(name: str, arrays: dict[str, np.ndarray]) -> EliasFano:
    return EliasFano.of([arrays[f"{name}{i}"] for i in range(5)])


def _running(c: np.ndarray) -> dict[str, np.ndarray]:
    """Counts as their running sum, from 0."""
    total = np.concatenate([[0], np.cumsum(c)])
    return _packed("sum", EliasFano.build(total, int(total[-1]) + 1))


def by_shard(which: np.ndarray) -> Iterator[tuple[int, slice | np.ndarray]]:
    """Each shard and its places, found in one pass: slices where places are in the order of shards, as most are."""
    if not len(which):
        return
    order = None
    step = np.diff(which)
    if (step < 0).any():
        order = np.argsort(which, kind="stable")
        which = which[order]
        step = np.diff(which)
    edge = [0, *(np.flatnonzero(step) + 1).tolist(), len(which)]
    for a, b in zip(edge[:-1], edge[1:]):
        yield int(which[a]), slice(a, b) if order is None else order[a:b]


class Counts:
    """Counts of numbered items that lie in files one after the other: how often an item
    occurs, and how often all before it."""

    def __init__(self, uri: str, sizes: list[int], occurrences: list[int], files: list[str]):
        self.uri, self.files = uri, files
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(occurrences)]).astype(np.int64)
        self.size, self.total = int(self.base[-1]), int(self.before[-1])

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, occurrences of lesser numbers) of each number."""
        count, before = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
        which = np.searchsorted(self.base, numbers, "right") - 1
        for s, mine in by_shard(which):
            sums = _unpacked("sum", load(self.uri, self.files[s]))
            local = numbers[mine] - self.base[s]
            first, after = (x.astype(np.int64) for x in sums.access_two(local))
            count[mine] = after - first
            before[mine] = first + self.before[s]
        return count, before


class Vocabulary:
    """First level: word hashes in order, their counts, and numbers."""

    def __init__(self, uri: str, shards: list[tuple[int, int, int, str]], bits: int):
        #: (first bits of the hashes, words, occurrences, file), in order
        shards = sorted(shards)
        self.uri, self.bits = uri, bits
        self.shard = np.array([s[0] for s in shards], np.int64)
        self.counts = Counts(uri, [s[1] for s in shards], [s[2] for s in shards], [s[3] for s in shards])
        self.size, self.total = self.counts.size, self.counts.total

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word hash, or -1."""
        number = np.full(len(hashes), -1, np.int64)
        which = (hashes >> U(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)
        for k, mine in by_shard(which):
            s = int(np.searchsorted(self.shard, k))
            if s == len(self.shard) or self.shard[s] != k:
                continue
            x = hashes[mine] & U((1 << (64 - self.bits)) - 1) if self.bits else hashes[mine]
            at = _unpacked("hash", load(self.uri, self.counts.files[s])).find(x)
            number[mine] = np.where(at >= 0, self.counts.base[s] + at, -1)
        return number

    def of(self, numbers: np.ndarray) -> np.ndarray:
        """Counts of numbers, 0 for -1."""
        out = np.zeros(len(numbers), np.int64)
        known = np.flatnonzero(numbers >= 0)
        out[known] = self.counts.of(numbers[known])[0]
        return out

    def base_log(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.1) / (self.total + 0.1 * (self.size + 1)))


class Level:
    """N-grams of one order, by context number and word number."""

    def __init__(self, uri: str, shards: list[dict], totals: Counts):
        shards = sorted(shards, key=lambda s: (s["first"], s["word"]))
        self.uri, self.files = uri, [s["file"] for s in shards]
        self.first, self.word, self.last = (np.array([s[k] for s in shards], np.int64) for k in ("first", "word", "last"))
        self.counts = Counts(uri, [s["n"] for s in shards], [s["occurrences"] for s in shards], self.files)
        self.base, self.size = self.counts.base, self.counts.size
        # What contexts leave that lie in several shards: a context at a shard's edge each.
        parts: dict[int, list[float]] = {}
        for s in shards:
            parts.setdefault(s["first"], []).append(s["head"])
            if s["last"] != s["first"]:
                parts.setdefault(s["last"], []).append(s["tail"])
        split = sorted(c for c, x in parts.items() if len(x) > 1)
        self.split = np.array(split, np.int64)
        total = totals.of(self.split)[0] if split else np.zeros(0)
        self.left = np.array([_left(sum(parts[c]), t) for c, t in zip(split, total.tolist())])

    def _shard(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The shard that would hold each n-gram, in the order of contexts; -1 before the first."""
        opens, shuts = (np.searchsorted(context, self.first, side) for side in ("left", "right"))
        which = np.repeat(np.arange(-1, len(self.first)), np.diff(opens, prepend=0, append=len(context)))
        for c in np.unique(self.first[opens < shuts]).tolist():
            lo, hi = (int(np.searchsorted(self.first, c, side)) for side in ("left", "right"))
            mine = slice(opens[lo], shuts[lo])
            at = lo + np.searchsorted(self.word[lo:hi], word[mine], "right") - 1
            # Words before the context's first shard lie in it too, unless the one before ends with the context.
            which[mine] = at if lo and self.last[lo - 1] == c else np.maximum(at, lo)
        return which

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number or -1, discounted probability or 0, what the context leaves) of n-grams in
        the order of their contexts. A context that the level doesn't have leaves all."""
        n = len(context)
        number, q, left = np.full(n, -1, np.int64), np.zeros(n), np.ones(n)
        if not self.files:
            return number, q, left
        which = self._shard(context, word)
        for s, mine in by_shard(which):
            # Contexts after the shard's last have no n-grams.
            have = int(np.searchsorted(context[mine], self.last[s], "right")) if s >= 0 else 0
            if not have:
                continue
            mine = np.arange(mine.start, mine.start + have) if isinstance(mine, slice) else mine[:have]
            arrays = load(self.uri, self.files[s])
            pointer, child = (_unpacked(k, arrays) for k in ("pointer", "child"))
            # Bounds are looked up once for each context.
            at = context[mine] - self.first[s]
            opens = np.flatnonzero(np.diff(at, prepend=-1))
            size = np.diff(np.append(opens, len(mine)))
            first, stop = (np.repeat(x.astype(np.int64), size) for x in pointer.access_two(at[opens]))
            left[mine] = value_of(arrays["left"][at])
            # A successor search for the id relative to its context, where the context may have it.
            stride, top = int(arrays["stride"][0]), word[mine]
            found = child.find((at * stride + top).astype(U))
            ok = np.flatnonzero((found >= first) & (found < stop) & (top < stride))
            number[mine[ok]] = self.base[s] + found[ok]
            q[mine[ok]] = value_of(arrays["q"][found[ok]])
        if len(self.split):
            at = np.minimum(np.searchsorted(self.split, context), len(self.split) - 1)
            left = np.where(self.split[at] == context, self.left[at], left)
        return number, q, left


def _left(kept: float, total: float) -> float:
    """What a context leaves, as it is stored."""
    return float(value_of(quantise(np.array([max(1 - kept / total, 1e-9)])))[0])


def build_vocabulary(counts: DataFrame, uri: str) -> Vocabulary:
    """``counts(hash, count)``, a row per training word."""
    n = counts.count()
    bits = max(0, int(n // SHARD).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)] for batch in batches if batch.num_rows]
        out = []
        if parts:
            shard = int(parts[0][0][0])
            h = np.concatenate([x[1] for x in parts]).view(U)
            c = np.concatenate([x[2] for x in parts])
            order = np.argsort(h)
            h, c = h[order], c[order]
            if bits:
                h = h & U((1 << (64 - bits)) - 1)
            out = [(shard, len(h), int(c.sum()), save(uri, _packed("hash", EliasFano.build(h, 1 << (64 - bits))) | _running(c)))]
        cols = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cols[:3]), pa.array(cols[3], pa.string())], names=["shard", "n", "occurrences", "file"])

    shard = F.shiftrightunsigned("hash", 64 - bits) if bits else F.lit(0).cast("long")
    rows = counts.select(shard.alias("shard"), "hash", "count").repartitionById(1 << bits, F.col("shard").cast("int"))
    shards = [tuple(r) for r in rows.mapInArrow(run, "shard long, n long, occurrences long, file string").collect()]
    return Vocabulary(uri, shards, bits)


def distinct_grams(a: np.ndarray, w: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (context, word) in order, and how often each occurs."""
    bits = max(1, (words - 1).bit_length())
    if not len(a) or int(a.max()) >> (63 - bits) == 0:
        key, c = np.unique((a << bits) | w, return_counts=True)
        return key >> bits, key & ((1 << bits) - 1), c
    order = np.lexsort((w, a))
    a, w = a[order], w[order]
    opens = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (w[1:] != w[:-1])))
    return a[opens], w[opens], np.diff(np.append(opens, len(a)))


def pack_grams(a: np.ndarray, w: np.ndarray, c: np.ndarray) -> bytes:
    """N-grams in order with their counts, as one compressed string."""
    planes = [x.astype(np.int64).view(np.uint8).reshape(-1, 8).T for x in (np.diff(a, prepend=0), w, c)]
    return len(a).to_bytes(4, "little") + zstandard.compress(b"".join(np.ascontiguousarray(x).tobytes() for x in planes), 1)


def unpack_grams(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    raw = np.frombuffer(zstandard.decompress(blob[4:]), np.uint8)
    a, w, c = (np.ascontiguousarray(raw[8 * n * i : 8 * n * (i + 1)].reshape(8, -1).T).view(np.int64).ravel() for i in range(3))
    return np.cumsum(a), w, c


def _merged(queue: TupleQueue) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of a queue in order, each once, with the sum of their values."""
    last_k, last_c = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for k, c in queue.pop_all():
        if not len(k):
            continue
        k, c = np.concatenate([last_k, k]), np.concatenate([last_c, c])
        opens = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        k, c = k[opens], np.add.reduceat(c, opens)
        last_k, last_c = k[-1:], c[-1:]
        yield k[:-1], c[:-1]
    yield last_k, last_c


def build_level(blocks: DataFrame, parts: int, words: int, least: int, uri: str, totals: Counts, last: bool) -> Level:
    """``blocks(part, block)``: n-grams by context and word number with counts to be summed,
    dealt by ranges. ``totals`` has the contexts' counts. The ``last`` level's own counts
    aren't kept."""
    room = max(1, (words - 1).bit_length())

    def shard(a, w, c) -> dict:
        rows = len(a)
        opens = np.flatnonzero(np.diff(a, prepend=-1))
        ctx = a[opens]
        total = totals.of(ctx)[0].astype(float)
        size = np.diff(np.append(opens, rows))
        kept = np.add.reduceat(c, opens) - DISCOUNT * size
        # A pointer for each context number of the shard, and children relative to their context:
        # each context's begin a stride after the one's before it.
        own = ctx - ctx[0]
        many = np.zeros(int(own[-1]) + 1, np.int64)
        many[own] = size
        pointers = np.concatenate([[0], np.cumsum(many)])
        stride = int(w.max()) + 1
        child = (a - ctx[0]) * stride + w
        left = np.zeros(len(many), np.uint16)
        left[own] = quantise(np.maximum(1 - kept / total, 1e-9))
        arrays = _packed("pointer", EliasFano.build(pointers, rows + 1)) | _packed("child", EliasFano.build(child, int(child[-1]) + 1))
        arrays |= {"q": quantise((c - DISCOUNT) / np.repeat(total, size)), "left": left, "stride": np.array([stride], np.int64)}
        if not last:
            arrays |= _running(c)
        return {"first": int(ctx[0]), "word": int(w[0]), "last": int(ctx[-1]), "n": rows, "occurrences": int(c.sum()), "head": float(kept[0]), "tail": float(kept[-1]), "file": save(uri, arrays)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []
        base, rows = None, 0

        def close():
            key, c = (np.concatenate([h[i] for h in held]) for i in range(2))
            held.clear()
            if len(key):
                out.append(shard((key >> room) + base, key & ((1 << room) - 1), c))

        with tempfile.TemporaryDirectory() as folder:
            queue = TupleQueue(folder, SORTED)
            for batch in batches:
                for blob in batch.column(0):
                    a, w, c = unpack_grams(blob.as_py())
                    # Keys are relative to a context of the range, so they fit whatever the numbers.
                    base = int(a[0]) if base is None else base
                    queue.push(((a - base) << room) | w, c)
            for key, c in _merged(queue):
                if least > 1:
                    key, c = key[c >= least], c[c >= least]
                for at in range(0, len(key), SHARD):
                    held.append((key[at : at + SHARD], c[at : at + SHARD]))
                    rows += len(held[-1][0])
                    if rows >= SHARD:
                        close()
                        rows = 0
            if held:
                close()
        yield pa.RecordBatch.from_pylist(out, pa.schema([("first", pa.int64()), ("word", pa.int64()), ("last", pa.int64()), ("n", pa.int64()), ("occurrences", pa.int64()), ("head", pa.float64()), ("tail", pa.float64()), ("file", pa.string())]))

    rows = blocks.repartitionById(parts, F.col("part")).select("block")
    # Written rather than collected: the plan of the last job, and so its shuffle files, would be held.
    files = materialize(rows.mapInArrow(giving_back(run), "first long, word long, last long, n long, occurrences long, head double, tail double, file string"), "lm-files")
    level = Level(uri, [r.asDict() for r in files.collect()], totals)
    release(blocks.sparkSession, files)
    return level


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush():
        h, c = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, U), np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(i64(h)), pa.array(c.astype(np.int64))], names=["hash", "count"])

    for batch in batches:
        for a, b, data, offs in slices(batch.column(0), SLICE):
            held += [Words(data, offs, lower=True).hash, np.full(b - a, END, U)]
            size += len(held[-2]) + b - a
            if size >= COUNTED:
                yield flush()
                held, size = [], 0
    yield flush()


def _numbers(vocabulary: Vocabulary, kind: str):
    """(doc_id, held_out, text) -> word numbers (-1: unknown) and the base score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end_count = vocabulary.of(vocabulary.find(np.array([END], U)))
        for batch in batches:
            for a, b, data, offs in slices(batch.column(2), NUMBERED):
                w = Words(data, offs, lower=True)
                distinct, back = np.unique(w.hash, return_inverse=True)
                number = vocabulary.find(distinct)
                count = vocabulary.of(number)
                logs = vocabulary.base_log(count)
                known = np.concatenate([[0], np.cumsum(count[back] > 0)])
                n = np.diff(w.bound) + 1
                # Sums of one text are taken over its own words, so equal texts score alike.
                base = np.array([logs[back[x:y]].sum() for x, y in zip(w.bound[:-1].tolist(), w.bound[1:].tolist())])
                lists = pa.ListArray.from_arrays(pa.array(w.bound.astype(np.int32)), pa.array(number[back]).cast(kind))
                cols = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n), pa.array(np.diff(known[w.bound]) + int(end_count[0] > 0)), pa.array(base + vocabulary.base_log(end_count)[0]), lists]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "words"])

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of at most ``TOKENS`` words of the last column, one row at least."""
    for batch in batches:
        edge = batch.column(batch.num_columns - 1).offsets.to_numpy()
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(edge, edge[at] + TOKENS, "right")) - 1)
            yield batch.slice(at, min(stop, batch.num_rows) - at)
            at = stop


def _sequences(column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers with the end before and after each text, place of each text's first end).
    Two texts share no end."""
    edge = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[edge[0] : edge[-1]]
    n = np.diff(edge)
    out = np.full(len(values) + 2 * len(n), end, np.int64)
    start = np.concatenate([[0], np.cumsum(n + 2)])
    keep = np.ones(len(out), bool)
    keep[start[:-1]] = False
    keep[start[1:] - 1] = False
    out[keep] = values
    return out, start


def _pairs(level: Level, seq: np.ndarray, start: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number or -1, discounted probability, what the context leaves) of the pair that ends
    at each place. A text's first end ends none, and unknown words are in none."""
    number, q, left = np.full(len(seq), -1, np.int64), np.zeros(len(seq)), np.ones(len(seq))
    inner = seq >= 0
    inner[start[:-1]] = False
    inner[1:] &= seq[:-1] >= 0
    place = np.flatnonzero(inner)
    context, word = seq[place - 1], seq[place]
    order = by_context(context, word, words)
    context, word, place = context[order], word[order], place[order]
    # Each pair is looked up once.
    opens = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (word[1:] != word[:-1]))) if len(place) else place
    size = np.diff(np.append(opens, len(place)))
    for out, x in zip((number, q, left), level.find(context[opens], word[opens])):
        out[place] = np.repeat(x, size)
    # An unknown word after a known context has what the context leaves.
    after = np.flatnonzero((seq < 0) & np.append(False, seq[:-1] >= 0))
    if len(after):
        context, back = np.unique(seq[after - 1], return_inverse=True)
        left[after] = level.find(context, np.zeros(len(context), np.int64))[2][back]
    return number, q, left


def _count_grams(vocabulary: Vocabulary, levels: list[Level], parts: int):
    """Counts of (context number, word number) of one order, within each batch of tokens,
    dealt by equal shares of occurrences: (part, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = int(vocabulary.find(np.array([END], U))[0])
        totals = levels[-1].counts if levels else vocabulary.counts
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            a, w, c = distinct_grams(*(np.concatenate([h[i] for h in held]) for i in range(2)), vocabulary.size)
            held.clear()
            opens = np.flatnonzero(np.diff(a, prepend=-1))
            count, before = (np.repeat(x, np.diff(np.append(opens, len(a)))) for x in totals.of(a[opens]))
            # A place among all occurrences, in the order of n-grams: a common context spans several parts.
            place = before + count * (w / vocabulary.size)
            part = np.minimum((place * (parts / max(1, totals.total))).astype(np.int64), parts - 1)
            cut = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
            blocks = [pack_grams(a[x:y], w[x:y], c[x:y]) for x, y in zip(cut, [*cut[1:], len(a)])]
            return pa.RecordBatch.from_arrays([pa.array(part[cut].astype(np.int32)), pa.array(blocks, pa.binary())], names=["part", "block"])

        for piece in _pieces(batches):
            seq, start = _sequences(piece.column(0), end)
            if levels:
                number, _, _ = _pairs(levels[0], seq, start, vocabulary.size)
                place = 1 + np.flatnonzero((number[:-1] >= 0) & (number[1:] >= 0))
                held.append((number[place - 1], seq[place]))
            else:
                inner = seq >= 0
                inner[start[:-1]] = False
                inner[1:] &= seq[:-1] >= 0
                place = np.flatnonzero(inner)
                held.append((seq[place - 1], seq[place]))
            size += len(place)
            if size >= COUNTED:
                yield flush()
                size = 0
        if held:
            yield flush()

    return run


def _score(vocabulary: Vocabulary, levels: list[Level]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = int(vocabulary.find(np.array([END], U))[0])
        for piece in _pieces(batches):
            seq, start = _sequences(piece.column(piece.num_columns - 1), end)
            distinct, back = np.unique(seq, return_inverse=True)
            p = 10 ** vocabulary.base_log(vocabulary.of(distinct))[back]
            if levels:
                number, q, left = _pairs(levels[0], seq, start, vocabulary.size)
                p = q + left * p
            if len(levels) > 1:
                at = 1 + np.flatnonzero(number[:-1] >= 0)
                known = seq[at] >= 0
                context, word = number[at - 1], np.maximum(seq[at], 0)
                order = by_context(context, word, vocabulary.size)
                _, q, left = levels[1].find(context[order], word[order])
                at = at[order]
                p[at] = np.where(known[order], q, 0.0) + left * p[at]
            logs = np.log10(p)
            score = np.array([logs[x + 1 : y].sum() for x, y in zip(start[:-1].tolist(), start[1:].tolist())])
            yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(score)], names=[*piece.schema.names[:-1], "score"])

    return run


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of training."""
    return F.crc32(doc_id.cast("string")) % 10 == 0


def train_and_score(docs: DataFrame, order: int = ORDER, least: int = LEAST) -> DataFrame:
    """Score every text of ``docs(doc_id, text)`` with a model of those not held out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score. Null
    and empty texts are their end alone; rows that repeat are counted and scored each; an
    empty table gives no rows; without training documents every word is unknown; other
    columns are ignored. ``least`` occurrences keep an n-gram (1: all, which is exact);
    ``order`` is 1, 2 or 3. The model lies in the shared folder."""
    if order not in (1, 2, 3):
        raise ValueError("order must be 1, 2 or 3")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    uri = new_path(spark, "lm")
    counts = rows.where("not held_out").select("text").mapInArrow(_count_words, "hash long, count long").groupBy("hash").agg(F.sum("count").alias("count"))
    counts = materialize(counts, "lm-words")
    vocabulary = build_vocabulary(counts, uri)
    release(spark, counts)
    # Numbers have 32 bits while they can.
    kind = ("int", pa.int32()) if vocabulary.size < 2**31 else ("long", pa.int64())
    numbered = materialize(rows.mapInArrow(_numbers(vocabulary, kind[1]), f"doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, words array<{kind[0]}>"), "lm-numbers", "zstd")
    levels: list[Level] = []
    for n in range(2, order + 1):
        totals = levels[-1].counts if levels else vocabulary.counts
        # Each batch of tokens asks each shard, so small corpora aren't cut into as many shards as a shuffle has partitions.
        parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(TASKS, -(-totals.total // WORTH)))
        parts = max(parts, -(-totals.total // DEALT))
        blocks = numbered.where("not held_out").select("words").mapInArrow(giving_back(_count_grams(vocabulary, levels, parts)), "part int, block binary")
        levels.append(build_level(blocks, parts, max(1, vocabulary.size), least, uri, totals, n == order))
    scored = numbered.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(vocabulary.total).cast("long").alias("train_tokens"), "base_score", "words")
    return scored.mapInArrow(giving_back(_score(vocabulary, levels)), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

"""N-gram Jaccard join by universe partition and pigeonhole.

Sets of word shingles link when their Jaccard similarity reaches a threshold. Sizes
fall into bands whose bounds grow by the factor 1 / threshold, so sets that link lie
in the same band or in neighbouring ones. For each band j, sets of bands j and j + 1
meet in one index: it divides the universe of shingles, by hash, into segments, and
two sets that link differ in at most H shingles, H following from the band's upper
bound. Each segment i is given an allowance b(i) of 0 or 1 differences with
sum(b(i) + 1) = H + 1: by the pigeonhole principle some segment of two linking sets
differs in at most b(i). A set is indexed by its subset of each segment and, where
b(i) = 1, also by the subset's one-deletion neighbours: subsets that differ by one
shingle share the smaller one. Larger allowances make fewer and longer, hence more
selective segments and more keys. The allocation is chosen by cost for each band: keys
written plus unrelated sets expected to share a subset, from the band's number of sets.

Most keys are those of one set and only serve to find that out, so keys are dealt once
and packed: a block of some sets' keys is sorted, cut by key range and coded as
differences. Keys are shortened to some ten bits more than it takes to tell all of them
apart, which may make sets meet that share no key but loses no meeting.

Candidates are verified exactly on the whole sets. Documents of equal sets are one
class and links are sought between classes; large groups go through
:func:`rulespan.llm.graph.link_buckets` and are never expanded into all pairs.
"""

from __future__ import annotations

import hashlib
import math
import tempfile
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespan.llm.common import giving_back, materialize, release
from rulespan.llm.graph import link_buckets
from rulespan.llm.suffix import TupleQueue
from rulespan.llm.textkit import Rolling, Words, i64, mix, slices

U = np.uint64
#: Bytes of text that are hashed at a time.
SLICE = 1 << 18
#: Keys that are packed at a time, sets at most, keys that one task unpacks, about, and
#: those that it sorts in memory.
BLOCK = 1 << 19
SETS = 1 << 16
DEALT = 1 << 21
SORTED = 1 << 20
#: Words of 64 cells of a set's short code, which rules out unrelated sets of up to some 2,000 shingles.
CODE = 16
PARITIES = [f"p{i}" for i in range(CODE)]
#: Members of a block of a large bucket, about, and rows that are compared at a time.
BLOCKED = 512
COMPARED_ROWS = 8192
#: Pairs whose ends' list is broadcast (two rows of 8 bytes each), at most.
LISTED = 100_000
#: Chance that an unrelated set has a given shingle, in the cost of an allocation.
SHARED = 0.1


def shingle_sets(column: pa.Array, words: int, lower: bool = True) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row) for runs of rows."""
    for a, b, data, offs in slices(column, SLICE):
        w = Words(data, offs, lower)
        roll = Rolling(w.hash)
        all_grams = roll.windows(words)
        sets = []
        for x, y in zip(w.bound[:-1].tolist(), w.bound[1:].tolist()):
            if y - x >= words:
                sets.append(np.unique(all_grams[x : y - words + 1]))
            elif y > x:
                # A shorter text is one shingle; its number of words keeps it from equalling a longer one.
                sets.append(mix(roll.spans(np.array([x]), np.array([y])) + U(y - x)))
            else:
                sets.append(np.zeros(0, U))
        yield a, sets


def digest(s: np.ndarray) -> tuple[int, int]:
    raw = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


class Bands:
    """Size bands and the allocation of each one's index, for percent / 100 similarity."""

    def __init__(self, percent: int, sets: dict[int, int] | None = None):
        self.percent = percent
        self.step = math.log(100 / percent)
        self.sets = sets or {}
        self.chosen: dict[int, tuple[int, int]] = {}

    def band(self, size: int) -> int:
        return int(math.log(size) / self.step + 1e-9)

    def differences(self, band: int) -> int:
        """The most shingles in which two linking sets of this index differ."""
        top = math.floor(math.exp((band + 1) * self.step) + 1e-6) + 1
        other = top * 100 // self.percent + 1
        return (top + other) * (100 - self.percent) // (100 + self.percent)

    def allocation(self, band: int) -> tuple[int, int]:
        """(segments, how many of them allow one difference) of least cost."""
        if band not in self.chosen:
            h = self.differences(band)
            size = math.exp((band + 0.5) * self.step)
            n = self.sets.get(band, 0) + self.sets.get(band + 1, 0)

            def cost(ones: int) -> float:
                m = h + 1 - ones
                part = size / m
                return m + ones * part + n * ((m - ones) * SHARED**part + ones * (part + 1) * SHARED ** max(0.0, part - 1))

            ones = min(range((h + 1) // 2 + 1), key=lambda x: (cost(x), x))
            self.chosen[band] = (h + 1 - ones, ones)
        return self.chosen[band]

    def expected(self) -> int:
        """Keys of all sets, about."""
        total = 0.0
        for band, n in self.sets.items():
            size = math.exp((band + 0.5) * self.step)
            for index in (band, band - 1):
                if index >= 0:
                    m, ones = self.allocation(index)
                    total += n * (m + ones / m * size)
        return int(total)

    def keys(self, s: np.ndarray) -> np.ndarray:
        """Index keys of a set: subsets of segments, for its own band and the one below."""
        out = []
        own = self.band(len(s))
        value = mix(s + U(0x5851F42D4C957F2D))
        for band in (own, own - 1):
            if band < 0:
                continue
            m, ones = self.allocation(band)
            segment = (mix(s ^ U(band * 0x9E3779B97F4A7C15 & (2**64 - 1))) % U(m)).astype(np.int64)
            total = np.zeros(m, U)
            np.add.at(total, segment, value)
            size = np.bincount(segment, minlength=m).astype(U)
            place = (np.arange(m).astype(U) << U(32)) + U(band * 2**16 + 1)
            out.append(mix(mix(total + size) ^ mix(place)))
            if ones:
                one = segment < ones
                out.append(mix(mix(total[segment[one]] - value[one] + size[segment[one]] - U(1)) ^ mix(place[segment[one]])))
        return np.unique(np.concatenate(out)) if out else np.zeros(0, U)


def _classes(words: int, lower: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, sets in shingle_sets(batch.column(1), words, lower):
                both = [digest(s) if len(s) else (None, None) for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in both], pa.int64()), pa.array([y for _, y in both], pa.int64())], names=["doc_id", "n_shingles", "c", "c2"])

    return run


def pack_keys(k: np.ndarray, owner: np.ndarray, classes: np.ndarray) -> bytes:
    """Sorted keys and their owners' places among ``classes``, as one compressed string."""
    here = np.zeros(len(classes), bool)
    here[owner] = True
    used = classes[here]
    place = (np.cumsum(here) - 1)[owner].astype(np.uint16)
    planes = [np.diff(x.astype(np.int64), prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T for x in (k, used)]
    raw = b"".join(np.ascontiguousarray(x).tobytes() for x in (*planes, place.view(np.uint8).reshape(-1, 2).T))
    return len(k).to_bytes(4, "little") + len(used).to_bytes(4, "little") + zstandard.compress(raw, 1)


def unpack_keys(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(keys, classes) of a packed string."""
    n, m = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:8], "little")
    raw = np.frombuffer(zstandard.decompress(blob[8:]), np.uint8)
    k, used = (np.cumsum(np.ascontiguousarray(x.reshape(8, -1).T).view(np.int64).ravel()) for x in (raw[: 8 * n], raw[8 * n : 8 * (n + m)]))
    place = np.ascontiguousarray(raw[8 * (n + m) :].reshape(2, -1).T).view(np.uint16).ravel()
    return k, used[place]


def _key_blocks(words: int, lower: bool, bands: Bands, parts: int, bits: int):
    """Packed keys of the texts' sets, by range: (part, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        owners: list[int] = []

        def flush():
            classes = np.array(owners, np.int64)
            k = np.concatenate(held) >> U(64 - bits)
            # Classes in order, so that their differences are small.
            rank = np.empty(len(classes), np.uint16)
            order = np.argsort(classes, kind="stable")
            rank[order] = np.arange(len(classes))
            owner = np.repeat(rank, [len(x) for x in held])
            at = np.argsort(k, kind="stable")
            k, owner, classes = k[at], owner[at], classes[order]
            part = ((k >> U(bits - 32)) * U(parts)) >> U(32)
            cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist()
            blocks = [pack_keys(k[x:y], owner[x:y], classes) for x, y in zip(cut, [*cut[1:], len(k)])]
            held.clear()
            owners.clear()
            return pa.RecordBatch.from_arrays([pa.array(part[cut].astype(np.int32)), pa.array(blocks, pa.binary())], names=["part", "block"])

        size = 0
        for batch in batches:
            cls = batch.column(0).to_pylist()
            for a, sets in shingle_sets(batch.column(1), words, lower):
                for c, s in zip(cls[a : a + len(sets)], sets):
                    if len(s):
                        held.append(bands.keys(s))
                        owners.append(c)
                        size += len(held[-1])
                    if size >= BLOCK or len(owners) == SETS:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed strings of a range -> the keys that several rows have: (k, c). Keys are sorted
    by a queue that goes to disk beyond its buffer, so a key of very many sets is no larger
    in memory than others."""
    with tempfile.TemporaryDirectory() as folder:
        queue = TupleQueue(folder, SORTED)
        for batch in batches:
            for blob in batch.column(0):
                queue.push(*unpack_keys(blob.as_py()))
        yield from _shared(pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], names=["k", "c"]) for k, c in queue.pop_all())


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of k: those whose k another row has. Of a long run one row is held."""
    last_k, last_c, told = np.zeros(0, np.int64), np.zeros(0, np.int64), False
    for batch in batches:
        if not batch.num_rows:
            continue
        k, c = (np.concatenate([x, batch.column(i).to_numpy(zero_copy_only=False)]) for i, x in enumerate((last_k, last_c)))
        same = k[1:] == k[:-1]
        keep = np.append(same, False) | np.append(False, same)
        last_k, last_c, next_told = k[-1:], c[-1:], bool(keep[-1])
        if told:
            keep[0] = False
        told = next_told or (told and len(k) == 1)
        yield pa.RecordBatch.from_arrays([pa.array(k[keep]), pa.array(c[keep])], names=["k", "c"])


def _sets(words: int, lower: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, sets in shingle_sets(batch.column(1), words, lower):
                codes = [parities(s) for s in sets]
                codes = np.array(codes, np.int64).reshape(len(sets), CODE)
                code = pa.StructArray.from_arrays([pa.array([len(s) for s in sets], pa.int64()), *(pa.array(codes[:, i]) for i in range(CODE))], names=["n", *PARITIES])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(sets)), code, pa.array([long_parities(s) for s in sets], pa.binary())], names=["c", "code", "parity"])

    return run


def _items(words: int, lower: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, sets in shingle_sets(batch.column(1), words, lower):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["item", "items"])

    return run


def parities(s: np.ndarray) -> list[int]:
    """Whether each of 64 * ``CODE`` cells that shingles are hashed into holds an odd number of
    the set's. Two sets differ in at least as many shingles as cells of other parity."""
    odd = np.bincount(((mix(s + U(0xA5A5A5A5)) >> U(32)) * U(64 * CODE) >> U(32)).astype(np.int64), minlength=64 * CODE) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def long_parities(s: np.ndarray) -> bytes:
    """Parities as above of two cells or more for each shingle, a power of two: they tell
    large sets apart too. Each two neighbouring cells make one of half as many."""
    bits = max(8, (2 * len(s) - 1).bit_length())
    odd = np.bincount((mix(s + U(0xC3C3C3C3)) >> U(64 - bits)).astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def odd_cells(x: bytes, y: bytes) -> int:
    """Cells of other parity, counted with the fewer cells of the two."""
    one, two = (np.unpackbits(np.frombuffer(v, np.uint8)) for v in sorted((x, y), key=len))
    if len(two) > len(one):
        two = np.bitwise_xor.reduce(two.reshape(len(one), -1), axis=1)
    return int((one != two).sum())


def _rule_out(percent: int):
    """(a, b, sizes and long parities of both) -> the pairs that these allow to link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(2, 6)]
            may = [odd_cells(x, y) * (100 + percent) <= (n + m) * (100 - percent) for n, x, m, y in zip(*cols)]
            yield batch.select([0, 1]).filter(pa.array(may, pa.bool_()))

    return run


def _few_odd(i: np.ndarray, j: np.ndarray, raw: np.ndarray, at: np.ndarray, size: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which of the pairs of long parities, of ``size`` bytes from ``at``, differ in at most
    ``most`` cells, counted with the fewer cells of the two."""
    out = np.zeros(len(i), bool)
    i, j = np.where(size[i] <= size[j], i, j), np.where(size[i] <= size[j], j, i)
    for n, m in {(a, b) for a, b in zip(size[i].tolist(), size[j].tolist())}:
        of = np.flatnonzero((size[i] == n) & (size[j] == m))
        step = max(1, (1 << 22) // m)
        for part in (of[k : k + step] for k in range(0, len(of), step)):
            x = raw[at[i[part]][:, None] + np.arange(n)]
            y = raw[at[j[part]][:, None] + np.arange(m)]
            if m > n:
                y = np.packbits(np.bitwise_xor.reduce(np.unpackbits(y, axis=1).reshape(len(part), n * 8, -1), axis=2), axis=1)
            out[part] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= most[part]
    return out


def _close(percent: int):
    """Rows (k, x, y, own, c, label, n, parities, long parity) in the order of (k, x, y): pairs of a
    bucket's blocks x and y that have different labels and that sizes and parities allow to link."""

    def compared(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        k, x, y, own, c, label, n, *code = (t.column(i).to_numpy() for i in range(7 + CODE))
        code = np.stack(code, axis=1).view(U)
        binary = t.column(7 + CODE).chunk(0)
        raw = np.frombuffer(binary.buffers()[2], np.uint8)
        edge = np.frombuffer(binary.buffers()[1], np.int32)[binary.offset : binary.offset + len(binary) + 1].astype(np.int64)
        size = np.diff(edge)
        group = np.cumsum(np.append(True, (k[1:] != k[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
        got = []
        for d in range(1, len(k)):
            i = np.flatnonzero(group[:-d] == group[d:])
            if not len(i):
                break
            j = i + d
            ok = (label[i] != label[j]) & ((x[i] == y[i]) | (own[i] != own[j])) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            i, j = i[ok], j[ok]
            most = (n[i] + n[j]) * (100 - percent) // (100 + percent)
            ok = np.bitwise_count(code[i] ^ code[j]).sum(axis=1, dtype=np.int64) <= most
            i, j, most = i[ok], j[ok], most[ok]
            if len(i):
                ok = _few_odd(i, j, raw, edge[:-1], size, most)
                got.append((np.minimum(c[i], c[j])[ok], np.maximum(c[i], c[j])[ok]))
        a, b = (np.concatenate([g[z] for g in got]) if got else np.zeros(0, np.int64) for z in range(2))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < COMPARED_ROWS:
                continue
            # All but the last group, which may go on.
            t = pa.Table.from_batches(held)
            key = [t.column(i).to_numpy() for i in range(3)]
            other = np.flatnonzero((key[0] != key[0][-1]) | (key[1] != key[1][-1]) | (key[2] != key[2][-1]))
            if len(other):
                stop = int(other[-1]) + 1
                yield compared(t.slice(0, stop).to_batches())
                held = t.slice(stop).to_batches()
                rows -= stop
        if held:
            yield compared(held)

    return run


def close_pairs(sets: DataFrame, percent: int):
    """A function of buckets' rows (k, c, label) that finds the pairs of different labels which
    sizes and parities allow to link. Parities travel with a bucket's rows, not with pairs; a large
    bucket is dealt into blocks, each two of which are compared in a place of their own."""

    def compare(rows: DataFrame) -> DataFrame:
        blocks = rows.groupBy(F.col("k").alias("of")).agg(F.ceil(F.count("*") / BLOCKED).cast("int").alias("blocks"))
        rows = rows.join(blocks, F.col("k") == F.col("of")).withColumn("own", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
        rows = rows.join(sets.select("c", "code", "parity"), "c")
        with_all = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("own", j).alias("x"), F.greatest("own", j).alias("y")))
        rows = rows.withColumn("at", F.explode(with_all)).select("k", "at.x", "at.y", "own", "c", "label", *[f"code.{f}" for f in ("n", *PARITIES)], "parity")
        rows = rows.repartition("k", "x", "y").sortWithinPartitions("k", "x", "y")
        return rows.mapInArrow(giving_back(_close(percent)), "a long, b long").distinct()

    return compare


def may_link(percent: int):
    """Whether two codes allow their sets to link: by sizes, and by parities."""

    def near(x, y):
        odd = reduce(add, (F.bit_count(x[p].bitwiseXOR(y[p])) for p in PARITIES))
        return (odd * (100 + percent) <= (x["n"] + y["n"]) * (100 - percent)) & (100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"]))

    return near


def similar(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity; sizes alone may rule it out."""
    lo, hi = sorted((len(s), len(t)))
    if 100 * lo < percent * hi:
        return False
    at = np.searchsorted(t, s)
    at[at == len(t)] = 0
    both = int((t[at] == s).sum())
    return 100 * both >= percent * (len(s) + len(t) - both)


def _verify(percent: int):
    """Rows in the order (centre, salt, centre first): which others reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, mine = None, []
        for batch in batches:
            a, b = [], []
            for x, salt, other, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
                s = np.frombuffer(raw, U)
                if other is None:
                    # Several only where doc_ids repeat.
                    mine = [*mine, s] if centre == (x, salt) else [s]
                    centre = (x, salt)
                elif any(similar(s, m, percent) for m in mine):
                    a.append(x)
                    b.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def verifier(docs: DataFrame, sets: DataFrame, percent: int, words: int, lower: bool, partners: int = 64):
    """A function of pairs (a, b) that keeps those whose sets link. Long parities, a thirtieth
    of the sets, rule out most pairs; only for the others are sets made from their texts
    again. A centre's set goes once to each group of some ``partners`` partners, so a large
    group is many tasks."""

    def verify(pairs: DataFrame) -> DataFrame:
        for end in ("a", "b"):
            pairs = pairs.join(sets.select(F.col("c").alias(end), F.col("code.n").alias(f"n_{end}"), F.col("parity").alias(f"parity_{end}")), end)
        pairs = pairs.select("a", "b", "n_a", "parity_a", "n_b", "parity_b").mapInArrow(_rule_out(percent), "a long, b long")
        pairs = materialize(pairs, "jac-near")
        asked = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
        # A short list of texts goes to the table, so that the others aren't shuffled.
        texts = docs.join(F.broadcast(asked) if pairs.count() <= LISTED else asked, "doc_id").select("doc_id", "text")
        items = texts.mapInArrow(giving_back(_items(words, lower)), "item long, items binary")
        groups = pairs.groupBy(F.col("a").alias("of")).agg(F.ceil(F.count("*") / partners).cast("long").alias("groups"))
        pairs = pairs.join(groups, F.col("a") == F.col("of")).select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("salt"))
        heads = pairs.select(F.col("a").alias("item"), "a", "salt", F.lit(None).cast("long").alias("b")).distinct()
        rows = heads.unionByName(pairs.select(F.col("b").alias("item"), "a", "salt", "b")).join(items, "item").select("a", "salt", "b", "items")
        rows = rows.repartition(F.col("a"), F.col("salt")).sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
        return rows.mapInArrow(giving_back(_verify(percent)), "a long, b long")

    return verify


def join_components(docs: DataFrame, percent: int = 90, words: int = 3, lower: bool = True) -> DataFrame:
    """Components of documents linked by the Jaccard similarity of their shingle sets.

    ``docs(doc_id, text)``; returns doc_id, n_shingles (set size), class_id (least doc_id
    of an equal set) and component_id (least doc_id reachable by links). Two documents
    link when 100 * intersection >= percent * union. Texts with fewer words than a
    shingle are one shingle; null texts and texts without words link with nothing. Rows
    that repeat, and different texts of one doc_id, are one node, which links with
    whatever one of its texts links with. An empty table gives no rows; other columns are
    ignored."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = materialize(docs.mapInArrow(_classes(words, lower), "doc_id long, n_shingles long, c long, c2 long"), "jac-classes")
    classes = base.where("c is not null").groupBy("c", "c2").agg(F.min("doc_id").alias("class_id"), F.first("n_shingles").alias("size"))
    classes = materialize(classes, "jac-class")
    # One row per band of sizes: some 22 bands for each factor of ten.
    step = math.log(100 / percent)
    histogram = classes.groupBy(F.floor(F.log(F.col("size").cast("double")) / step + 1e-9).alias("band")).count().collect()
    bands = Bands(percent, {r["band"]: r["count"] for r in histogram})
    expected = bands.expected()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-expected // DEALT))
    bits = min(64, max(32, expected.bit_length() + 10))
    # A class is known by its least doc_id, whose row's text stands for all.
    first = docs.join(classes.select(F.col("class_id").alias("doc_id")).distinct(), "doc_id").select("doc_id", "text")
    blocks = first.mapInArrow(giving_back(_key_blocks(words, lower, bands, parts, bits)), "part int, block binary")
    members = blocks.repartitionById(parts, F.col("part")).select("block").mapInArrow(giving_back(_unpacked), "k long, c long")
    members = materialize(members, "jac-shared")
    release(spark)
    active = members.select(F.col("c").alias("doc_id")).distinct()
    texts = docs.join(active, "doc_id").select(F.col("doc_id").alias("c"), "text")
    sets = materialize(texts.mapInArrow(giving_back(_sets(words, lower)), f"c long, code struct<n:long,{','.join(p + ':long' for p in PARITIES)}>, parity binary"), "jac-sets")
    release(spark)
    labels = link_buckets(members, verifier(docs, sets, percent, words, lower), sets.select("c", "code"), may_link(percent), compare=close_pairs(sets, percent))
    release(spark, sets)
    named = classes.select("c", "c2", "class_id").join(labels.withColumnRenamed("node", "class_id"), "class_id", "left")
    named = materialize(named.select("c", "c2", "class_id", F.coalesce("label", "class_id").alias("component_id")), "jac-named")
    release(spark, classes)
    out = base.join(named, ["c", "c2"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))

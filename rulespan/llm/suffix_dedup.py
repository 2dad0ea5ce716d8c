"""Suffix-array dedup: removal of every byte under a long string that starts earlier.

All positions of the corpus that can begin a repeated string of ``length`` bytes are
brought together in shards, and each shard's suffixes are sorted by external induced
sorting (:mod:`rulespan.llm.suffix`); strings are equal where the common prefixes in
suffix order are long enough. What brings them together:

1. Scan: each text's windows of ``length`` bytes fall into runs with one anchor, their
   least hashed gram. Equal windows have equal anchors, so a shard holds whole anchors.
   Anchors seen once are dropped.
2. Runs with the same anchor and the same bytes are all copies of the earliest; only
   that one goes on, so thousands of copies are one run in a shard.
3. In a shard, a run is trimmed to the bytes around its anchor that some other run of
   that anchor shares on the left and on the right. What is left is sorted.

Runs are compared by anchor and hash together, 128 bits.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespan.llm import suffix
from rulespan.llm.common import giving_back, materialize, release, told_apart
from rulespan.llm.textkit import SYMBOL, Rolling, anchor_runs, cover, i64, slices

#: Repeated strings of this many bytes go.
LENGTH = 100
#: Bytes of an anchor.
GRAM = 24
#: Bytes of text that are hashed at a time.
SLICE = 1 << 17
#: Symbols that one suffix sort takes in memory (some 200 bytes each); larger ones use the disk.
SHARD = 1_000_000
#: Runs that are trimmed at a time, at least; an anchor's runs stay together.
TRIM = 20_000


def _scan(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, data, offs in slices(batch.column(1), SLICE):
                roll = Rolling(SYMBOL[:256][data])
                grams = roll.windows(gram)
                text, start, count, anchor, covered = anchor_runs(roll, offs, length, gram, grams)
                twice = _twice(grams, anchor, start, start + count - 1 + length - gram)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (i64(anchor), i64(covered), ids[a + text], (start - offs[text]).astype(np.int32), count.astype(np.int32), twice)], names=["anchor", "covered", "doc_id", "at", "n", "twice"])

    return run


def _twice(grams: np.ndarray, anchor: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether each run's anchor occurs twice from its first to its last place, so that
    windows of the run may be equal to one another."""
    if not len(anchor):
        return np.zeros(0, bool)
    values, own = np.unique(anchor, return_inverse=True)
    place = np.flatnonzero(grams <= values[-1])
    which = np.searchsorted(values, grams[place])
    hit = values[which] == grams[place]
    key = np.sort((which[hit] << 40) | place[hit])
    return np.searchsorted(key, (own << 40) | last, "right") - np.searchsorted(key, (own << 40) | first) > 1


def _segments(length: int):
    """(doc_id, text, runs) -> the bytes under each run named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(2)
            edge = lists.offsets.to_numpy()
            anchor, at, n = (lists.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            for a, b, data, offs in slices(batch.column(1), 1 << 20):
                pick = slice(edge[a], edge[b])
                doc = np.repeat(np.arange(b - a), np.diff(edge[a : b + 1]))
                first = (offs[doc] + at[pick]).tolist()
                last = (offs[doc] + at[pick] + n[pick] - 1 + length).tolist()
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(anchor[pick]), pa.array(ids[a + doc]), pa.array(at[pick]), pa.array([raw[x:y] for x, y in zip(first, last)], pa.binary())], names=["anchor", "doc_id", "at", "bytes"])

    return run


def _shared(key: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """For rows of bytes, how many leading bytes each shares with any other row of its key."""
    order = np.lexsort((np.ascontiguousarray(sides).view(f"V{sides.shape[1]}").ravel().view(f"S{sides.shape[1]}"), key))
    k, s = key[order], sides[order]
    same = s[1:] == s[:-1]
    agree = np.where(same.all(axis=1), sides.shape[1], same.argmin(axis=1)) * (k[1:] == k[:-1])
    out = np.zeros(len(key), np.int64)
    both = np.zeros(len(key), np.int64)
    both[1:] = agree
    both[:-1] = np.maximum(both[:-1], agree)
    out[order] = both
    return out


def trim(anchor: np.ndarray, segments: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, stop) of the bytes of each segment that may hold a window shared with
    another segment of its anchor; first == stop where there is none.

    A window equal to another has every occurrence of the anchor in it at the same
    place as the other, and shares all bytes to its left and right. For each occurrence
    the longest shared stretches bound the windows; their union is kept."""
    size = np.array([len(s) for s in segments], np.int64)
    offs = np.concatenate([[0], np.cumsum(size)])
    data = np.frombuffer(b"".join(segments), np.uint8)
    found = Rolling(SYMBOL[:256][data]).windows(gram).view(np.int64)
    owner = np.repeat(np.arange(len(size)), size)[: len(found)]
    place = np.flatnonzero(found == anchor[owner])
    place = place[place + gram <= offs[owner[place] + 1]]
    row = owner[place]
    reach = length - gram
    step = np.arange(reach)
    # Beyond a segment the bytes are 0 on one row and, on others, may not be: shared stretches end there.
    right = place[:, None] + gram + step
    inside = right < offs[row + 1][:, None]
    after = np.where(inside, data[np.minimum(right, len(data) - 1)], 0)
    right_free = offs[row + 1] - place - gram
    left = place[:, None] - 1 - step
    inside = left >= offs[row][:, None]
    before = np.where(inside, data[np.maximum(left, 0)], 0)
    left_free = place - offs[row]
    lo = place - np.minimum(_shared(anchor[row], before), left_free)
    hi = place + gram + np.minimum(_shared(anchor[row], after), right_free)
    wide = hi - lo >= length
    first, stop = offs[1:].copy(), offs[:-1].copy()
    np.minimum.at(first, row[wide], lo[wide])
    np.maximum.at(stop, row[wide], hi[wide])
    none = first >= stop
    first[none] = stop[none] = offs[:-1][none]
    return first - offs[:-1], stop - offs[:-1]


def repeated(segments: list[bytes], order_key: np.ndarray, length: int, ext: suffix.External) -> list[np.ndarray]:
    """Windows (by start) of each segment whose bytes also start a window of lesser key,
    or an earlier one of the same segment. ``order_key`` ranks the segments' starts as
    (document, place), with room for the windows of a segment in between."""
    size = np.array([len(s) for s in segments], np.int64)
    total = int(size.sum()) + len(size) + 1
    text = ext.array(total, np.int32)
    start = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    for x, s in zip(start.tolist(), segments):
        text[x : x + len(s)] = np.frombuffer(s, np.uint8)
        text[x : x + len(s)] += 2
        text[x + len(s)] = 1
    text[-1] = 0
    order, common = suffix.sort_suffixes(text, ext)
    count = np.maximum(size - length + 1, 0)
    owner = np.repeat(np.arange(len(size)), count)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    slot = np.full(total, -1, np.int64)
    slot[start[owner] + step] = np.arange(len(owner))
    group = np.cumsum(common < length)
    mine = slot[order]
    is_window = mine >= 0
    group, mine = group[is_window], mine[is_window]
    # Windows of a group are neighbours: the least (document, place) of each is the original.
    # Equal ones are one place, of rows that repeat.
    rank = np.unique(order_key[owner] + step, return_inverse=True)[1]
    cut = np.flatnonzero(np.diff(group, prepend=-1))
    copied = np.zeros(len(owner), bool)
    if len(mine):
        least = np.minimum.reduceat(rank[mine], cut)
        sizes = np.diff(np.append(cut, len(mine)))
        copied[mine] = rank[mine] != np.repeat(least, sizes)
    return np.split(copied, np.cumsum(count)[:-1]) if len(count) else []


def _sort(length: int, gram: int, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        pending: list[tuple[np.ndarray, np.ndarray, np.ndarray, list]] = []
        rows = 0
        with tempfile.TemporaryDirectory() as folder:
            ext = suffix.External(folder, shard)

            def trimmed(a, d, p, s) -> None:
                first, stop = trim(a, s, length, gram)
                for i in np.flatnonzero(stop > first).tolist():
                    held.append((int(d[i]), int(p[i] + first[i]), s[i][first[i] : stop[i]]))

            def joined():
                return (np.concatenate([x[i] for x in pending]) for i in range(3)), [s for x in pending for s in x[3]]

            def sort_held() -> pa.RecordBatch:
                doc = np.array([h[0] for h in held], np.int64)
                at = np.array([h[1] for h in held], np.int64)
                # (document, place) in one integer: documents by rank, places below the largest.
                room = int(at.max(initial=0)) + max((len(h[2]) for h in held), default=0) + 1
                key = np.unique(doc, return_inverse=True)[1].astype(np.int64) * room + at
                out_doc, out_at, out_n = [], [], []
                for i, copied in enumerate(repeated([h[2] for h in held], key, length, ext)):
                    if copied.any():
                        d = np.diff(copied.astype(np.int8), prepend=0, append=0)
                        first, last = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
                        out_doc += [int(doc[i])] * len(first)
                        out_at += (at[i] + first).tolist()
                        out_n += (last - first).tolist()
                held.clear()
                return pa.RecordBatch.from_arrays([pa.array(out_doc, pa.int64()), pa.array(out_at, pa.int32()), pa.array(out_n, pa.int32())], names=["doc_id", "at", "n"])

            # Rows come in the order of their anchors; work goes on at an anchor's end.
            for batch in batches:
                a = batch.column(0).to_numpy(zero_copy_only=False)
                if not len(a):
                    continue
                pending.append((a, batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_pylist()))
                rows += len(a)
                if rows < TRIM or pending[0][0][0] == a[-1]:
                    continue
                (an, d, p), s = joined()
                end = int(np.flatnonzero(an != an[-1])[-1]) + 1
                trimmed(an[:end], d[:end], p[:end], s[:end])
                pending = [(an[end:], d[end:], p[end:], s[end:])]
                rows = len(an) - end
                if sum(len(h[2]) for h in held) >= shard // 2:
                    yield sort_held()
            if rows:
                (an, d, p), s = joined()
                trimmed(an, d, p, s)
            if held:
                yield sort_held()

    return run


def _remove(length: int, texts: bool, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            lists = batch.column(2)
            edge = lists.offsets.to_numpy()
            at, n = (lists.values.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            for a, b, data, offs in slices(batch.column(1), 1 << 20):
                pick = slice(edge[a], edge[b])
                doc = np.repeat(np.arange(b - a), np.diff(edge[a : b + 1]))
                first = offs[doc] + at[pick]
                gone = cover(len(data), first, first + n[pick] - 1 + length)
                opens = gone.copy()
                opens[1:] &= ~gone[:-1]
                inner = offs[1:-1][offs[1:-1] < len(data)]
                opens[inner] = gone[inner]
                lost = np.concatenate([[0], np.cumsum(gone)])[offs]
                spans = np.concatenate([[0], np.cumsum(opens)])[offs]
                raw, kept_at = data[~gone].tobytes(), offs - lost
                kept = [raw[x:y] for x, y in zip(kept_at[:-1].tolist(), kept_at[1:].tolist())]
                cols = [ids.slice(a, b - a), pa.array(np.diff(offs)), pa.array(np.diff(lost)), pa.array(np.diff(spans)), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if texts:
                    cols.append(pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()))
                    names.append("text")
                cols += [batch.column(3 + k).slice(a, b - a) for k in range(len(carry))]
                names += carry
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def dedup_suffixes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD, texts: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove bytes covered by a ``length``-byte string that also starts earlier, in a
    document of smaller doc_id or earlier in the same one.

    ``docs(doc_id, text)``, texts as UTF-8; rows that repeat id and text are one document,
    which loses nothing to itself, and different texts of one id count as documents in
    the order of their hashes. Matches lie within one
    document; overlaps count; strings are judged on the input. Returns doc_id, n_bytes,
    n_removed, n_spans (maximal removed runs), kept_sha256 and, if ``texts``, the bytes
    that stay as text (a character that was cut is left out), with the columns ``carry``
    unchanged. Null and empty texts have
    no bytes; an empty table gives no rows; other columns are left out. Of equal strings
    the first stays."""
    spark = docs.sparkSession
    whole, shift = told_apart(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry))
    docs = whole.select("doc_id", "text")
    runs = materialize(docs.mapInArrow(giving_back(_scan(length, gram)), "anchor long, covered long, doc_id long, at int, n int, twice boolean"), "sa-runs")
    shared = runs.groupBy("anchor").agg(F.count("*").alias("c"), (F.min("covered") < F.max("covered")).alias("mixed")).where("c > 1").select("anchor", "mixed")
    # A run that holds its anchor twice may repeat itself: it is sorted even if alone.
    block = materialize(runs.join(shared, "anchor", "left").where("mixed is not null or twice"), "sa-block")
    release(spark, runs)
    first = block.groupBy("anchor", "covered").agg(F.min(F.struct("doc_id", "at")).alias("first"))
    block2 = materialize(block.join(first, ["anchor", "covered"]).withColumn("original", F.struct("doc_id", "at") == F.col("first")).drop("first"), "sa-long")
    release(spark, block)
    long = block2.where("not original").select("doc_id", "at", "n")
    border = block2.where("original and (mixed or twice)").groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "at", "n")).alias("runs"))
    asked = docs.join(border, "doc_id").select("doc_id", "text", "runs")
    segments = materialize(asked.mapInArrow(giving_back(_segments(length)), "anchor long, doc_id long, at int, bytes binary"), "sa-segments")
    total = segments.agg(F.coalesce(F.sum(F.length("bytes")), F.lit(0))).first()[0]
    parts = max(8, -(-total // shard))
    rows = segments.repartition(int(parts), "anchor").sortWithinPartitions("anchor")
    short = rows.mapInArrow(giving_back(_sort(length, gram, shard)), "doc_id long, at int, n int")
    found = materialize(long.unionByName(short).groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias("copied")), "sa-spans")
    release(spark, segments, block2)
    empty = F.expr("cast(array() as array<struct<at:int,n:int>>)")
    out = whole.join(found, "doc_id", "left").select("doc_id", "text", F.coalesce("copied", empty).alias("copied"), *carry)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", text string" if texts else "")
    schema += "".join(f", {c} {whole.schema[c].dataType.simpleString()}" for c in carry)
    out = out.mapInArrow(giving_back(_remove(length, texts, list(carry))), schema)
    return out.withColumn("doc_id", F.shiftright("doc_id", shift)) if shift else out

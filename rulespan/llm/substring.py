"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

A document is parsed into factors copied from earlier documents (smaller doc_id). The
reference is every earlier text of the corpus, cut into blocks by anchor: the least
hashed gram of a window of words. Equal windows have equal anchors, so a window can
only be copied from its anchor's block, and parsing against the blocks of a document's
own anchors is parsing against all of them.

1. Scan: each text's windows fall into runs of one anchor; a run is sent to its block
   as (anchor, hash of the words under the run, document, place). Anchors of a single
   document are dropped at once.
2. Long factors: a run whose words occur under the same anchor in an earlier document
   is one factor, however often it occurs (a grouped minimum, combined before the
   shuffle).
3. Factor boundaries: of the runs first seen in a block that holds other runs, single
   windows are looked up in the block's index of windows, as a copy may begin or end
   within the run.
4. Factors of a document that touch and point to the same reference are joined, and
   the words under factors go.

Windows are compared by anchor and hash together, 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespan.llm.common import materialize, release, told_apart
from rulespan.llm.textkit import Rolling, Words, anchor_runs, cover, i64, slices

#: A duplicate span is at least this many words long.
WINDOW = 50
#: Words of an anchor.
GRAM = 12
#: Bytes of text that are hashed at a time.
SLICE = 1 << 18


def _runs(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, data, offs in slices(batch.column(1), SLICE):
                w = Words(data, offs)
                text, start, count, anchor, covered = anchor_runs(Rolling(w.hash), w.bound, window, gram)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (i64(anchor), i64(covered), ids[a + text], (start - w.bound[text]).astype(np.int32), count.astype(np.int32))], names=["anchor", "covered", "doc_id", "at", "n"])

    return run


def _windows(window: int):
    """(doc_id, text, runs) -> a row per window of the runs named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(2)
            edge = lists.offsets.to_numpy()
            anchor, at, n = (lists.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            for a, b, data, offs in slices(batch.column(1), SLICE):
                w = Words(data, offs)
                hashed = Rolling(w.hash).windows(window)
                pick = slice(edge[a], edge[b])
                count = n[pick].astype(np.int64)
                doc = np.repeat(np.arange(b - a), np.diff(edge[a : b + 1]))
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                place = np.repeat(at[pick], count) + step
                owner = np.repeat(doc, count)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.repeat(anchor[pick], count), i64(hashed[w.bound[owner] + place]), ids[a + owner], place.astype(np.int32))], names=["anchor", "hash", "doc_id", "at"])

    return run


def join_factors(at: np.ndarray, n: np.ndarray, ref: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """Factors (first word, words, reference document) of one document from its copied
    runs of windows: greedily, a factor goes on while the next run starts where it
    would, from the same reference."""
    out: list[list[int]] = []
    for i in np.lexsort((n, at)):
        if out and out[-1][2] == ref[i] and at[i] <= out[-1][0] + out[-1][1] - window + 1:
            out[-1][1] = max(out[-1][1], int(at[i] + n[i] - 1 + window) - out[-1][0])
        else:
            out.append([int(at[i]), int(n[i]) - 1 + window, int(ref[i])])
    return [tuple(x) for x in out]


def _remove(window: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            lists = batch.column(2)
            edge = lists.offsets.to_numpy()
            at, n, ref = (lists.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            for a, b, data, offs in slices(batch.column(1), SLICE):
                w = Words(data, offs)
                factors, first, last = [], [], []
                for i in range(a, b):
                    mine = slice(edge[i], edge[i + 1])
                    found = join_factors(at[mine], n[mine], ref[mine], window) if edge[i + 1] > edge[i] else []
                    factors.append(found)
                    first += [w.bound[i - a] + f[0] for f in found]
                    last += [w.bound[i - a] + f[0] + f[1] for f in found]
                gone = cover(len(w.start), np.array(first, np.int64), np.array(last, np.int64))
                keep = np.flatnonzero(~gone)
                # Kept words, each but a text's last with one space after it.
                inner = np.flatnonzero(w.doc[keep[1:]] == w.doc[keep[:-1]])
                mask = cover(len(data), w.start[keep], w.end[keep])
                spaced = data.copy()
                mask[w.end[keep[inner]]] = True
                spaced[w.end[keep[inner]]] = 32
                size = np.zeros(len(data) + 1, np.int64)
                np.cumsum(mask, out=size[1:])
                raw, cut = spaced[mask].tobytes(), size[offs]
                kept = [raw[x:y] for x, y in zip(cut[:-1], cut[1:])]
                words = np.diff(w.bound)
                lost = np.add.reduceat(np.append(gone, False), np.minimum(w.bound[:-1], len(gone)), dtype=np.int64) * (words > 0)
                cols = [ids.slice(a, b - a), pa.array(words, pa.int64()), pa.array(lost, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array([[{"start": f[0], "length": f[1], "reference": f[2]} for f in x] for x in factors], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("reference", pa.int64())])))]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256", "factors"]
                if texts:
                    cols.append(pa.array([x.decode("utf-8", "replace") for x in kept]))
                    names.append("text")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, texts: bool = False) -> DataFrame:
    """Remove words covered by a window that also starts in an earlier document.

    ``docs(doc_id, text)``; rows that repeat id and text are one document, which loses
    nothing to itself, and different texts of one id count as documents in the order of
    their hashes. Returns doc_id, n_words, n_removed,
    kept_sha256, factors (the copied spans with a reference document each) and, if
    ``texts``, the kept words as text. Null and empty texts have no words; a table
    without rows gives none; other columns are ignored. Of exact copies the one of
    least doc_id stays. Windows are judged on the input."""
    spark = docs.sparkSession
    docs, shift = told_apart(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    schema = "anchor long, covered long, doc_id long, at int, n int"
    runs = materialize(docs.mapInArrow(_runs(window, gram), schema), "rlz-runs")
    shared = runs.groupBy("anchor").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"), (F.min("covered") < F.max("covered")).alias("mixed")).where("d0 < d1").select("anchor", "mixed")
    block = materialize(runs.join(shared, "anchor"), "rlz-block")
    release(spark, runs)
    first = block.groupBy("anchor", "covered").agg(F.min("doc_id").alias("ref"))
    block2 = materialize(block.join(first, ["anchor", "covered"]), "rlz-long")
    release(spark, block)
    long = block2.where("doc_id > ref").select("doc_id", "at", "n", "ref")
    border = block2.where("doc_id = ref and mixed").groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "at", "n")).alias("runs"))
    asked = docs.join(border, "doc_id").select("doc_id", "text", "runs")
    windows = materialize(asked.mapInArrow(_windows(window), "anchor long, hash long, doc_id long, at int"), "rlz-windows")
    index = windows.groupBy("anchor", "hash").agg(F.min("doc_id").alias("ref"), F.max("doc_id").alias("d1")).where("ref < d1").drop("d1")
    short = windows.join(index, ["anchor", "hash"]).where("doc_id > ref").select("doc_id", "at", F.lit(1).alias("n"), "ref")
    found = long.unionByName(short).groupBy("doc_id").agg(F.collect_list(F.struct("at", "n", "ref")).alias("copied"))
    found = materialize(found, "rlz-factors")
    release(spark, windows, block2)
    empty = F.expr("cast(array() as array<struct<at:int,n:int,ref:bigint>>)")
    out = docs.join(found, "doc_id", "left").select("doc_id", "text", F.coalesce("copied", empty).alias("copied"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, factors array<struct<start:long,length:long,reference:long>>"
    out = out.mapInArrow(_remove(window, texts), schema + (", text string" if texts else ""))
    return out.withColumn("doc_id", F.shiftright("doc_id", shift)) if shift else out

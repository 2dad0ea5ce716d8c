"""Media columns: lossless payload images in archives, read by a custom data source.

``write_archives`` turns payloads into 8-bit greyscale PNG images and appends them to
archive files, one set per Spark partition, each with an index of fixed-width entries
(id, offset, length) in the order of offsets. File names follow from the partition and
are moved into place whole, so a task that runs again replaces its own files.

``ArchiveSource`` reads them back: the planner lists the archive directory and cuts
each file into byte ranges (file sizes are all it looks at); a range's task takes the
members whose first byte lies in it, finds them by bisecting the index, and streams
their bytes as Arrow batches of bounded size. A member that can't be read, or whose
checksum is wrong, is read again by its own offset, independent of the others.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rulespan.llm.common import new_path

#: Bytes of an archive after which the next one begins.
ARCHIVE = 64 << 20
#: Bytes of an archive that one task reads.
RANGE = 8 << 20
#: Bytes of members in one Arrow batch, about.
BATCH = 4 << 20
#: Index entry: id, bytes of the text, offset, length, crc32.
ENTRY = "<qqqqI"
ENTRY_SIZE = struct.calcsize(ENTRY)
RETRIES = 4
SAMPLES = 64
PNG = b"\x89PNG\r\n\x1a\n"


def payload_of(text: bytes) -> bytes:
    """The text's bytes and zeros up to a positive multiple of 64."""
    return text + bytes((-len(text) % SAMPLES) if text else SAMPLES)


def encode_png(payload: bytes) -> bytes:
    """An 8-bit greyscale image of 64 rows whose samples are the payload's bytes."""
    width = len(payload) // SAMPLES
    rows = np.zeros((SAMPLES, width + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(SAMPLES, width)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, SAMPLES, 8, 0, 0, 0, 0)
    return PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> bytes:
    """The samples of an image that :func:`encode_png` wrote; chunk checksums are checked."""
    if data[:8] != PNG:
        raise ValueError("not a PNG image")
    at, body, width, height = 8, [], 0, 0
    while at < len(data):
        (size,) = struct.unpack_from(">I", data, at)
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + part) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            width, height = struct.unpack_from(">II", part)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Mean, deviation and a 16-bin histogram of the samples, and which half of each
    pair of sixteenths is brighter."""
    x = np.frombuffer(samples, np.uint8)
    bins = np.bincount(x >> 4, minlength=16)
    parts = np.add.reduceat(x, np.arange(16) * len(x) // 16, dtype=np.int64)
    bits = "".join("1" if a > b else "0" for a, b in zip(parts[:-1], parts[1:]))
    return f"{x.mean():.4f}|{x.std():.4f}|{','.join(map(str, bins))}|{bits}"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_archives(docs: DataFrame, path: str, archive: int = ARCHIVE) -> DataFrame:
    """Store the texts of ``docs(doc_id, text)`` in archives under ``path``; null is empty.
    Returns (file, members, bytes) of each archive once an action runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, out = TaskContext.get().partitionId(), 0, None
        store, base = _open(path)
        entries: list[bytes] = []
        at, temp, done = 0, "", []

        def close() -> None:
            nonlocal out, made, at, entries
            out.close()
            name = f"{base}/part-{part:06d}-{made:04d}"
            with store.open_output_stream(temp + ".index") as f:
                f.write(b"".join(entries))
            store.move(temp + ".index", name + ".index")
            store.move(temp, name + ".archive")
            done.append((name.rsplit("/", 1)[1], len(entries), at))
            out, made, at, entries = None, made + 1, 0, []

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if out is None:
                    temp = f"{base}/_{uuid.uuid4().hex}"
                    out = store.open_output_stream(temp)
                raw = (text.as_py() or "").encode()
                media = encode_png(payload_of(raw))
                out.write(media)
                entries.append(struct.pack(ENTRY, doc, len(raw), at, len(media), zlib.crc32(media)))
                at += len(media)
                if at >= archive:
                    close()
        if out is not None:
            close()
        cols = list(zip(*done)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["file", "members", "bytes"])

    store, base = _open(path)
    store.create_dir(base, recursive=True)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "file string, members long, bytes long")


class Span(InputPartition):
    """Members of an archive that begin in [start, stop)."""

    def __init__(self, uri: str, file: str, start: int, stop: int):
        self.uri, self.file, self.start, self.stop = uri, file, start, stop


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.uri = options["path"]
        self.range = int(options.get("range", RANGE))

    def partitions(self) -> list[Span]:
        store, base = _open(self.uri)
        files = store.get_file_info(pafs.FileSelector(base, recursive=True))
        spans = []
        for f in sorted(files, key=lambda f: f.path):
            if f.path.endswith(".archive"):
                spans += [Span(self.uri, f.path[: -len(".archive")], a, min(a + self.range, f.size)) for a in range(0, f.size, self.range)]
        return spans or [Span(self.uri, "", 0, 0)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "media", "error"]

        def batch(rows):
            cols = list(zip(*rows)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        if not span.file:
            yield batch([])
            return
        store, _ = _open(span.uri)
        rows, held = [], 0
        with store.open_input_file(span.file + ".index") as index, store.open_input_file(span.file + ".archive") as data:
            count = index.size() // ENTRY_SIZE

            def entry(i: int):
                return struct.unpack(ENTRY, index.read_at(ENTRY_SIZE, i * ENTRY_SIZE))

            lo, hi = 0, count
            while lo < hi:
                mid = (lo + hi) // 2
                if entry(mid)[2] < span.start:
                    lo = mid + 1
                else:
                    hi = mid
            while lo < count:
                step = min(4096, count - lo)
                raw = index.read_at(ENTRY_SIZE * step, lo * ENTRY_SIZE)
                for doc, n_bytes, at, size, crc in struct.iter_unpack(ENTRY, raw):
                    if at >= span.stop:
                        lo = count
                        break
                    media, error = self.member(data, store, span.file, at, size, crc)
                    rows.append((doc, n_bytes, media, error))
                    held += size
                    if held >= BATCH:
                        yield batch(rows)
                        rows, held = [], 0
                lo += step
        yield batch(rows)

    @staticmethod
    def member(data, store, file: str, at: int, size: int, crc: int) -> tuple[bytes | None, str | None]:
        """A member's bytes, read again by its offset while they fail; else what failed."""
        error = ""
        for attempt in range(RETRIES):
            try:
                if attempt:
                    time.sleep(0.05 * 2**attempt)
                    with store.open_input_file(file + ".archive") as again:
                        media = again.read_at(size, at)
                else:
                    media = data.read_at(size, at)
                if len(media) == size and zlib.crc32(media) == crc:
                    return media, None
                error = "checksum"
            except OSError as e:
                error = str(e)
        return None, error


class ArchiveSource(DataSource):
    """``spark.read.format("member_archive").option("path", uri)``: doc_id, n_bytes, media, error."""

    @classmethod
    def name(cls) -> str:
        return "member_archive"

    def schema(self) -> str:
        return "doc_id long, n_bytes long, media binary, error string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, path: str, span: int = RANGE) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("member_archive").option("path", path).option("range", span).load()


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for *doc, media, error in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if media is None:
                rows.append((*doc, None, None, None, None, None, None, error))
                continue
            payload = decode_png(media)
            rows.append((*doc, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-SAMPLES:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload), None))
        cols = list(zip(*rows)) or [()] * 9
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def media_table(docs: DataFrame) -> DataFrame:
    """Store every text as an image, read the archives back and compute features.

    A row per document: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature, error; equal texts have equal values. Null and
    empty texts are 64 zero bytes. A member that can't be read after its retries has nulls
    and what failed as its error, which is null for all others. An empty table gives no rows; repeated rows and ids are members of their own; other
    columns are ignored. Archives go to the shared folder."""
    spark = docs.sparkSession
    path = new_path(spark, "archives")
    write_archives(docs, path).agg(F.sum("members")).collect()
    out = read_archives(spark, path).select("doc_id", "n_bytes", "media", "error").mapInArrow(_features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")
    return out

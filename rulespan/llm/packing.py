"""Sum-of-squares online packing of tokenised documents into sequences.

Documents are cut freely: whole windows of 1024 tokens make sequences of their own,
and each document's remainder is placed online. With N(h) the number of open windows
filled to level h, an item of size s goes to the level h that minimises the sum of
N(h)**2 afterwards, where a window that becomes full leaves the count: moving a window
from h to h + s changes the sum by 2 * (N(h+s) - N(h) + 1), opening one by
2 * N(s) + 1. The counts are one array over the 1024 levels.

Each Spark partition packs its own documents: a hot source or a group of copies only
makes more windows. At a partition's end the windows still open are merged, cutting
pieces where they cross a border, so that one sequence per partition is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sequences of this many tokens.
LENGTH = 1024
#: Chunks whose ids a worker remembers.
CACHE = 400_000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def plain_byte_level(model: dict) -> bool:
    """Whether a vocabulary file splits by the byte-level pattern, changes no text before that, and
    merges in the order of its tokens' ids."""
    before, bpe = model.get("pre_tokenizer") or {}, model["model"]
    if bpe.get("type") != "BPE" or model.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return False
    if any(bpe.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return False
    made = [bpe["vocab"].get("".join(m) if isinstance(m, list) else m.replace(" ", "", 1), -1) for m in bpe["merges"]]
    return all(a < b for a, b in zip([-1, *made], made))


class ChunkTokenizer:
    """Token ids of a byte-level BPE vocabulary file, with a cache of text chunks.

    The vocabulary's pattern never joins text across a single space that follows a
    character that isn't white space, so such a text may be cut before each space and
    the chunks looked up. Texts with other runs of white space are encoded whole. This
    holds for plain byte-level files whose merges come in the order of their tokens; a
    file of another kind is left to the library that it is written for."""

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.exact = None
        if not plain_byte_level(model):
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_file(path)
            return
        # Byte-level vocabularies spell the 256 bytes with printable characters.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spelled = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        ranks = {bytes(spelled[c] for c in word): i for word, i in model["model"]["vocab"].items() if word not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.special = [s for s in special]
        self.whole = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.known: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, allowed_special="all", disallowed_special=()), np.uint32).tobytes()

    def __call__(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.exact is not None:
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()
        if any(s in text for s in self.special):
            return self._encode(text)
        head, *rest = text.split(" ")
        known, out = self.known, [self._encode(head) if head else b""]
        if head and head[-1].isspace() or not head and rest and (not rest[0] or rest[0][:1].isspace()):
            return self._encode(text)
        for chunk in rest:
            ids = known.get(chunk)
            if ids is None:
                if not chunk or chunk[0].isspace() or chunk[-1].isspace():
                    return self._encode(text)
                ids = self._encode(" " + chunk)
                if len(known) >= CACHE:
                    known.clear()
                known[chunk] = ids
            out.append(ids)
        return b"".join(out)


class Packer:
    """Places pieces online; ``emit(piece, sequence, offset)`` is called when known."""

    def __init__(self, length: int = LENGTH):
        self.length = length
        self.count = np.zeros(length + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(length + 1)]
        self.sequences = 0
        self.out: list[tuple] = []

    def whole(self, piece) -> None:
        self.out.append((piece, self.sequences, 0))
        self.sequences += 1

    def place(self, piece, size: int) -> None:
        length, n = self.length, self.count
        best, at = 2 * int(n[size]) + 1, 0
        # Level h must hold a window and leave room; the window that becomes full drops out of the sum.
        have = np.flatnonzero(n[1 : length - size + 1]) + 1
        if len(have):
            change = 2 * (n[have + size] - n[have] + 1)
            change[have + size == length] = 1 - 2 * n[have[have + size == length]]
            i = int(change.argmin())
            if change[i] <= best:
                at = int(have[i])
        if at:
            pieces = self.open[at].pop()
            n[at] -= 1
        else:
            pieces = []
        pieces.append((piece, size))
        level = at + size
        if level == length:
            self.close(pieces)
        else:
            self.open[level].append(pieces)
            n[level] += 1

    def close(self, pieces) -> None:
        offset = 0
        for piece, size in pieces:
            self.out.append((piece, self.sequences, offset))
            offset += size
        self.sequences += 1

    def finish(self, cut: Callable) -> None:
        """Merge the windows still open, cutting pieces at sequence borders."""
        fill = 0
        for level in range(self.length, 0, -1):
            for pieces in self.open[level]:
                for piece, size in pieces:
                    while size:
                        take = min(size, self.length - fill)
                        part, piece = cut(piece, take, size)
                        self.out.append((part, self.sequences, fill))
                        fill, size = fill + take, size - take
                        if fill == self.length:
                            fill, self.sequences = 0, self.sequences + 1
            self.open[level] = []
        if fill:
            self.sequences += 1
        self.count[:] = 0


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = 0) -> DataFrame:
    """Pack the texts of ``docs(doc_id, text)``.

    Each document's ids are its tokens and then ``end_id``; each id lies in exactly
    one piece. Returns a row per piece: doc_id, start (the document's ids before it),
    length, ids_crc32 (of the ids as little-endian unsigned 32-bit integers),
    doc_tokens, sequence_id and offset there. Null and empty texts are the end id
    alone; rows that repeat an id are packed as documents of their own; an empty
    table gives no pieces. Other columns are ignored. ``vocabulary`` is a byte-level
    BPE file that every executor can open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, packer = ChunkTokenizer(vocabulary), Packer(length)
        part = TaskContext.get().partitionId()
        last = np.array([end_id], np.uint32).tobytes()

        def flush() -> pa.RecordBatch:
            rows, packer.out = packer.out, []
            cols = list(zip(*((d, s, len(raw) // 4, zlib.crc32(raw), total, (part << 40) + q, o) for (d, s, raw, total), q, o in rows))) or [()] * 7
            names = [x.split()[0] for x in PIECE.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = encode(text.as_py() or "") + last
                total, at = len(raw) // 4, 0
                while total - at >= length:
                    packer.whole((doc, at, raw[4 * at : 4 * (at + length)], total))
                    at += length
                if at < total:
                    packer.place((doc, at, raw[4 * at :], total), total - at)
                if len(packer.out) >= 20_000:
                    yield flush()

        def cut(piece, take, size):
            doc, start, raw, total = piece
            return (doc, start, raw[: 4 * take], total), (doc, start + take, raw[4 * take :], total)

        packer.finish(cut)
        yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE)

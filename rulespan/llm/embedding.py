"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables.

Iterative quantisation learns binary codes from a bounded sample: vectors are centred
and projected on their principal directions, then a rotation is learned that brings
them close to the corners of the cube, alternating between codes (signs) and the
orthogonal matrix that fits them best (from a singular value decomposition). Rotations learned from different
starts give several codes of a vector.

Codes are cut into substrings of about log2(rows) bits, each the key of a Hamming
table, so tables hold a few rows a bucket at any size. A vector is entered under its
substring and the substrings one bit away: codes within two bits of one another in any
substring meet. Longer substrings meet less often, and a code has fewer of them, so
rotations are added until pairs placed at the threshold around the sampled vectors meet
often enough. Candidates whose whole codes are far apart are dropped; the others are
reranked with the original vectors, in double precision, and nothing below the
threshold links. Equal vectors are one class with a weight. Large groups go through
:func:`rulespan.llm.graph.link_buckets`; links within a component are then counted
block by block on the original vectors, so a component's counts are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespan.llm.common import materialize, release
from rulespan.llm.graph import link_buckets

#: Vectors that the codes are learned from, at most: those of the least hashes.
SAMPLE = 20_000
#: Rounds of the learning.
ROUNDS = 30
#: Codes of a vector, at least.
CODES = 2
#: The share of pairs at the threshold that are to meet.
RECALL = 0.95
#: Vectors that pairs are placed around, at most.
PLACED = 2_000
#: Vectors of a block in which links are counted.
BLOCK = 512


def learn(sample: np.ndarray, bits: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) whose signs are the code: principal directions, then the
    rotation that iterative quantisation finds."""
    mean = sample.mean(axis=0)
    x = sample - mean
    _, vectors = np.linalg.eigh(x.T @ x)
    project = vectors[:, ::-1][:, :bits]
    v = x @ project
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(ROUNDS):
        codes = np.where(v @ r >= 0, 1.0, -1.0)
        a, _, b = np.linalg.svd(codes.T @ v)
        r = (a @ b).T
    return mean, project @ r


def _pack(x: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The codes of vectors, the first bit lowest."""
    mean, project = model
    sign = ((x - mean) @ project >= 0).astype(np.uint64)
    return (sign << np.arange(sign.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def placed_pairs(sample: np.ndarray, threshold: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the sample, and vectors whose cosine with them is ``threshold``: away in
    any direction, and towards other vectors of the sample."""
    rng = np.random.default_rng(seed)
    one = sample[rng.permutation(len(sample))[:PLACED]]
    one = np.concatenate([one, one])
    half = len(one) // 2
    away = np.concatenate([rng.normal(size=(half, one.shape[1])), sample[rng.integers(0, len(sample), half)]])
    away -= (away * one).sum(axis=1, keepdims=True) * one
    size = np.linalg.norm(away, axis=1, keepdims=True)
    ok = size[:, 0] > 1e-6
    one, away = one[ok], away[ok] / size[ok]
    return one, threshold * one + np.sqrt(max(0.0, 1 - threshold**2)) * away


def meeting(differ: np.ndarray, bits: int, width: int) -> np.ndarray:
    """Which pairs meet in a table of a code, by the bits in which their codes differ."""
    out = np.zeros(len(differ), bool)
    for low in range(0, bits - width + 1, width):
        out |= np.bitwise_count((differ >> np.uint64(low)) & np.uint64((1 << width) - 1)) <= 2
    return out


def learn_enough(sample: np.ndarray, bits: int, width: int, most: int, threshold: float, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Models of as many codes as let ``RECALL`` of the pairs at the threshold meet that are
    within ``most`` bits by their first codes."""
    one, two = placed_pairs(sample, threshold, seed)
    models: list[tuple[np.ndarray, np.ndarray]] = []
    met = near = np.zeros(len(one), bool)
    # A table's number has 16 bits, 6 of them for the substring.
    while len(models) < CODES or len(models) < 1023 and (met & near).sum() < RECALL * near.sum():
        models.append(learn(sample, bits, seed + len(models)))
        differ = _pack(one, models[-1]) ^ _pack(two, models[-1])
        if len(models) == 1:
            near = np.bitwise_count(differ) <= most
        met = met | meeting(differ, bits, width)
    return models


def _codes(models, width: int):
    """(c, vector) -> a row per table and variant of the substring."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(c):
                continue
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float64).reshape(len(c), -1)
            keys, code, owner = [], [], []
            first = None
            for which, model in enumerate(models):
                bits = model[1].shape[1]
                packed = _pack(x, model)
                first = packed if first is None else first
                for t, low in enumerate(range(0, bits - width + 1, width)):
                    part = (packed >> np.uint64(low)) & np.uint64((1 << width) - 1)
                    table = np.uint64((which * 64 + t + 1) << 48)
                    for flip in [0, *(1 << i for i in range(width))]:
                        keys.append(table | (part ^ np.uint64(flip)))
                        code.append(first)
                        owner.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owner)), pa.array(np.concatenate(code).view(np.int64))], names=["k", "c", "code"])

    return run


def _cosines(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.float64).reshape(n, -1) for i in (2, 3))
            keep = pa.array((x * y).sum(axis=1) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in range(2)], names=["a", "b"])

    return run


def _block_counts(threshold: float):
    """Rows in the order (component, i, j): links of each vector of block i in block j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def done():
            blk = np.array([h[0] for h in held])
            c = np.array([h[1] for h in held], np.int64)
            w = np.array([h[2] for h in held], np.int64)
            x = np.frombuffer(b"".join(h[3] for h in held), np.float64).reshape(len(held), -1)
            one, two = np.flatnonzero(blk == group[1]), np.flatnonzero(blk == group[2])
            near = (x[one] @ x[two].T) >= threshold
            near &= c[one][:, None] != c[two][None, :]
            return c[one], near @ w[two]

        out: list[tuple] = []
        for batch in batches:
            for comp, i, j, blk, c, w, raw in zip(*(batch.column(k).to_pylist() for k in range(7))):
                if group != (comp, i, j):
                    if held:
                        out.append(done())
                    group, held = (comp, i, j), []
                held.append((blk, c, w, raw))
            yield flush(out)
        if held:
            out.append(done())
        yield flush(out)

    def flush(out):
        c = np.concatenate([x for x, _ in out]) if out else np.zeros(0, np.int64)
        n = np.concatenate([y for _, y in out]) if out else np.zeros(0, np.int64)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c), pa.array(n.astype(np.int64))], names=["c", "links"])

    return run


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors as bytes of doubles; null where a vector links with nothing."""
    for batch in batches:
        lists = batch.column(1)
        edge = lists.offsets.to_numpy().astype(np.int64)
        # Null components become NaN.
        flat = lists.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
        size = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(edge), 0)
        out: list[bytes | None] = [None] * len(lists)
        for n in np.unique(size[size > 0]).tolist():
            of = np.flatnonzero(size == n)
            x = flat[edge[of][:, None] + np.arange(n)]
            # By the largest component first, so that no finite vector is too long or too short to have a length.
            most = np.abs(x).max(axis=1)
            ok = np.isfinite(x).all(axis=1) & (most > 0)
            x = x[ok] / most[ok][:, None]
            x /= np.linalg.norm(x, axis=1)[:, None]
            for i, v in zip(of[ok].tolist(), x):
                out[i] = v.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "unit"])


def near_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 11) -> DataFrame:
    """Links of cosine >= threshold among all vectors, and their components.

    Returns vec_id, n_links (other vectors linked directly), component_id (least vec_id
    reachable by links) and kept (whether it is its component's least). Null vectors,
    vectors of only zeros or with null or non-finite components link with nothing. An
    empty table gives no rows. Vectors of other lengths than the most common one are
    compared among their own length. Other columns are ignored. Candidate search is by
    codes, so a link can be missed with small probability, which tests measure."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    base = materialize(rows.mapInArrow(_unit, "vec_id long, unit binary"), "emb-unit")
    classes = base.where("unit is not null").groupBy("unit").agg(F.min("vec_id").alias("c"), F.count("*").alias("weight"))
    classes = materialize(classes, "emb-class")
    parts = []
    for length in [r[0] for r in classes.groupBy(F.length("unit").alias("l")).count().orderBy("l").collect()]:
        parts.append(_one_length(classes.where(F.length("unit") == length), length // 8, threshold, seed))
    found = parts[0] if parts else spark.createDataFrame([], "c long, label long, links long")
    for p in parts[1:]:
        found = found.unionByName(p)
    named = materialize(classes.join(found, "c", "left").select("unit", F.coalesce("label", "c").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "emb-named")
    out = base.join(named, "unit", "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), (own == F.col("vec_id")).alias("kept"))


def _one_length(classes: DataFrame, dims: int, threshold: float, seed: int) -> DataFrame:
    spark = classes.sparkSession
    count = classes.count()
    drawn = classes.select("unit").orderBy(F.xxhash64("unit")).limit(SAMPLE).toPandas()["unit"]
    sample = np.frombuffer(b"".join(bytes(x) for x in drawn), np.float64).reshape(len(drawn), dims)
    bits = min(64, dims)
    width = int(min(bits, 40, max(8, round(np.log2(max(count, 2))))))
    if bits < width:
        width = bits
    # Codes of vectors at the threshold differ in about angle / pi of the bits; allow four deviations more.
    p = float(np.arccos(np.clip(threshold, -1, 1)) / np.pi)
    most = int(np.ceil(bits * p + 4 * np.sqrt(bits * p * (1 - p))))
    models = learn_enough(sample, bits, width, most, threshold, seed)
    members = materialize(classes.select("c", "unit").mapInArrow(_codes(models, width), "k long, c long, code long"), "emb-keys")

    def verify(pairs: DataFrame) -> DataFrame:
        a = classes.select(F.col("c").alias("a"), F.col("unit").alias("unit_a"))
        b = classes.select(F.col("c").alias("b"), F.col("unit").alias("unit_b"))
        both = pairs.join(a, "a").join(b, "b").select("a", "b", "unit_a", "unit_b")
        return both.mapInArrow(_cosines(threshold), "a long, b long")

    labels = link_buckets(members.select("k", "c"), verify, members.select("c", "code").distinct(), lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= most, rounds=1)
    labels = materialize(labels, "emb-labels")
    item = labels.withColumnRenamed("node", "c").join(classes, "c")
    sizes = labels.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    item = item.join(sizes, "label").withColumn("blk", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    # A vector goes to the pairs (i, j) of blocks with its own block first or second.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j")
    one = item.select("label", F.col("blk").alias("i"), other, "blk", "c", "weight", "unit")
    two = item.select("label", other.alias("i"), F.col("blk").alias("j"), "blk", "c", "weight", "unit").where("i <> j")
    rows = one.unionByName(two.select(*one.columns)).repartition("label", "i", "j").sortWithinPartitions("label", "i", "j")
    links = rows.mapInArrow(_block_counts(threshold), "c long, links long").groupBy("c").agg(F.sum("links").alias("links"))
    out = materialize(labels.select(F.col("node").alias("c"), "label").join(links, "c", "left"), "emb-links")
    # Components are named by their least class, which is its least vec_id.
    return out

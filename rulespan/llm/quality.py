"""Quality classifier with hierarchical empirical Bayes site posteriors.

Two faults are judged, junk (quality 0) and toxicity. A document's evidence for each
is the sum of log likelihood ratios of what is in it: distinct words that are telling
enough, and the binned shares of words with odd shapes. Ratios are learned from at
most ``SAMPLE`` labelled documents, equal texts counted once, as document frequencies
in a table of fixed size.

Sites come in two levels, host (source) and path (source and language). The fault rate
of a host is a beta posterior: the faults expected from its documents' evidence, shrunk
towards the corpus rate by a prior strength that the spread between hosts gives by the
method of moments; a path's rate is shrunk towards its host's in the same way. Sparse
sites thus have their parent's rate. The path's log odds replace the corpus's in a
document's posterior; a document is rejected where a posterior reaches one half.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespan.llm.common import materialize
from rulespan.llm.textkit import Words, slices

U = np.uint64
#: Labelled documents that the ratios are learned from, at most: those of the least hashes.
SAMPLE = 20_000
#: Hashed word features, and the bins of each shape's share.
WORDS = 1 << 18
BINS = np.array([0.0, 0.01, 0.03, 0.1, 0.25, 0.5])
SHAPES = 7
FEATURES = WORDS + SHAPES * (len(BINS) + 1)
#: A feature is telling if this share of a fault's documents have it, and at least so many...
SHARE, LEAST = 0.08, 8
#: ... and it is exp(RATIO) times as frequent there.
RATIO = 3.0
#: Site rates may move a document's log odds by this much at most.
SWAY = 2.0
#: Scores count up to this in the fit.
CAP = 20.0
SLICE = 1 << 18
FAULTS = ("junk", "toxic")


def features(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """Feature numbers of each text of a run: its distinct words, and its shapes' bins."""
    w = Words(data, offs, lower=True)
    raw = data
    bucket = (w.hash >> U(64 - 18)).astype(np.int64)
    n = len(w.start)
    # Shapes: no letter or digit; two equal marks at the end; capitals only; with a digit;
    # longer than 24 bytes; the word before again. Last, words beyond twice the distinct ones.
    kind = np.zeros(256, np.int64)
    kind[48:58] = 1
    kind[65:91] = 2
    kind[97:123] = 4
    kind[128:] = 8
    seen = np.bitwise_or.reduceat(kind[raw], w.start) if n else np.zeros(0, np.int64)
    # Bytes between words are separators, whose kind is 0.
    size = w.end - w.start
    last = raw[w.end - 1] if n else raw[:0]
    before = raw[np.maximum(w.end - 2, 0)] if n else raw[:0]
    marks = (last == before) & (kind[last] == 0) & (size > 1)
    again = np.zeros(n, bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    flags = np.stack([seen == 0, marks, ((seen & 6) == 2) & (size > 1), (seen & 1) > 0, size > 24, again]) if n else np.zeros((SHAPES - 1, 0), bool)
    out = []
    for a, b in zip(w.bound[:-1].tolist(), w.bound[1:].tolist()):
        distinct = np.unique(bucket[a:b])
        # Short texts say little by shares: each share is drawn to 0 by three words.
        share = np.append(flags[:, a:b].sum(axis=1), max(0, b - a - 2 * len(distinct))) / (b - a + 3)
        bins = WORDS + np.arange(SHAPES) * (len(BINS) + 1) + np.searchsorted(BINS, share, "left")
        out.append(np.concatenate([distinct, bins]))
    return out


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(junk, toxic, text) -> documents by feature, of all, of junk and of toxic ones."""
    count = np.zeros((FEATURES + 1, 3), np.int64)
    for batch in batches:
        junk, toxic = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
        for a, b, data, offs in slices(batch.column(2), SLICE):
            for i, f in enumerate(features(data, offs), a):
                count[f] += (1, junk[i], toxic[i])
                count[FEATURES] += (1, junk[i], toxic[i])
    used = np.flatnonzero(count[:, 0])
    yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(count[used, k]) for k in range(3))], names=["f", "n", "junk", "toxic"])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(weights[feature, fault], (intercept, slope)[fault]). Rows of ``labels`` with a null
    flag count as free of that fault; labels without a document, and the reverse, are
    not used; without any labels nothing is evidence and faults are rare."""
    drawn = labels.where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    drawn = drawn.select(F.col("doc_id").cast("long"), (F.coalesce("quality", F.lit(1)) == 0).alias("junk"), (F.coalesce("toxic", F.lit(0)) == 1).alias("toxic"))
    # The drawn labels are at most ``sample`` rows of a number and two flags, so no text is shuffled to meet them.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")
    # Equal texts count once, with any fault that one of them is labelled with.
    rows = rows.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).agg(F.max("junk").alias("junk"), F.max("toxic").alias("toxic"), F.first("text").alias("text"))
    rows = materialize(rows, "labelled")
    found = rows.select("junk", "toxic", "text").mapInArrow(_frequencies, "f long, n long, junk long, toxic long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("junk").alias("junk"), F.sum("toxic").alias("toxic"))
    # At most FEATURES + 1 rows, whatever the corpus.
    got = found.toPandas()
    count = np.zeros((FEATURES + 1, 3))
    count[got["f"]] = got[["n", "junk", "toxic"]]
    total = count[FEATURES]
    weights = np.zeros((FEATURES, 2))
    for k in range(2):
        own, rest = total[k + 1], total[0] - total[k + 1]
        with_own, with_rest = count[:FEATURES, k + 1], count[:FEATURES, 0] - count[:FEATURES, k + 1]
        if not own or not rest:
            continue
        ratio = np.log((with_own + 0.5) / (own + 1)) - np.log((with_rest + 0.5) / (rest + 1))
        telling = (with_own >= max(LEAST, SHARE * own)) & (ratio >= RATIO)
        weights[:, k] = np.where(telling, ratio, 0)
    # The sums are turned into log odds by a logistic fit on the same bounded sample.
    scored = rows.select("text", "junk", "toxic").mapInArrow(_evidence(weights), "junk boolean, toxic boolean, junk_evidence double, toxic_evidence double").toPandas()
    fits = np.array([calibrate(scored[f"{f}_evidence"].to_numpy(float), scored[f].to_numpy(float)) for f in FAULTS])
    return weights, fits


def calibrate(score: np.ndarray, fault: np.ndarray) -> tuple[float, float]:
    """(intercept, slope) of a ridge logistic fit of faults on capped scores, by Newton steps."""
    x = np.stack([np.ones(len(score)), np.minimum(score, CAP) / CAP], axis=1)
    start = np.array([-4.0, 0.0])

    def loss(beta: np.ndarray) -> float:
        z = x @ beta
        return float((np.logaddexp(0, z) - fault * z).sum() + 5e-4 * ((beta - start) ** 2).sum())

    beta = start
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (fault - p) - 1e-3 * (beta - start))
        # Steps are halved until they help.
        while np.abs(step).max() > 1e-9 and loss(beta + step) > loss(beta):
            step = step / 2
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(max(beta[1], 0.0) / CAP)


def _evidence(weights: np.ndarray):
    used = np.flatnonzero(np.abs(weights).sum(axis=1))
    kept = weights[used]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((FEATURES, 2))
        table[used] = kept
        for batch in batches:
            for a, b, data, offs in slices(batch.column(0), SLICE):
                got = features(data, offs)
                value = np.array([table[f].sum(axis=0) for f in got])
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[1:]), pa.array(value[:, 0]), pa.array(value[:, 1])], names=[*batch.schema.names[1:], "junk_evidence", "toxic_evidence"])

    return run


def site_rates(scored: DataFrame, fault: str) -> tuple[DataFrame, float]:
    """((host, path, rate), corpus rate): posterior fault rate of each path, from grouped sums only."""
    p = 1.0 / (1.0 + F.exp(-F.col(f"{fault}_evidence")))
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))

    def strength(rows: DataFrame, n: str, rate, mean) -> float:
        """Beta prior strength by moments: how much rates differ beyond binomial noise.
        One row of sums reaches the driver."""
        r = rows.agg(F.count("*").alias("k"), F.sum(F.col(n) * F.pow(rate - mean, 2)).alias("ss"), F.sum(n).alias("n"), F.sum(F.pow(F.col(n), 2)).alias("n2"), F.avg(mean * (1 - mean)).alias("v")).first()
        if not r["k"] or r["k"] < 2 or not r["v"]:
            return 10.0
        between = (r["ss"] - (r["k"] - 1) * r["v"]) / max(r["n"] - r["n2"] / r["n"], 1e-9)
        return float(np.clip(r["v"] / max(between, 1e-9) - 1, 10.0, 1e4))

    whole = hosts.agg(F.sum("host_s").alias("s"), F.sum("host_n").alias("n")).first()
    rate = ((whole["s"] or 0.0) + 0.01) / ((whole["n"] or 0) + 1.0)
    m = strength(hosts, "host_n", F.col("host_s") / F.col("host_n"), F.lit(rate))
    hosts = hosts.withColumn("host_rate", (F.col("host_s") + m * rate) / (F.col("host_n") + m))
    both = paths.join(hosts.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of"))).drop("of")
    m2 = strength(both, "n", F.col("s") / F.col("n"), F.col("host_rate"))
    return both.select("host", "path", ((F.col("s") + m2 * F.col("host_rate")) / (F.col("n") + m2)).alias(f"{fault}_site_rate")), rate


def classify(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """Posteriors of both faults for every row of ``docs(doc_id, text, host, path)``.

    Returns doc_id, host, path, for each fault its evidence, site rate and posterior,
    and keep. Null and empty texts have no words and are judged by shapes and site; null
    hosts and paths are sites of their own; repeated rows are judged each; an empty
    table gives no rows; other columns are ignored."""
    weights, fits = learn(docs, labels, sample)
    rows = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"))
    scored = rows.mapInArrow(_evidence(weights), "doc_id long, host string, path string, junk_evidence double, toxic_evidence double")
    for (a, b), fault in zip(fits, FAULTS):
        scored = scored.withColumn(f"{fault}_evidence", F.lit(float(a)) + F.lit(float(b)) * F.least(f"{fault}_evidence", F.lit(CAP)))
    scored = materialize(scored, "evidence")
    out = scored
    for fault in FAULTS:
        rates, rate = site_rates(scored, fault)
        rates = rates.withColumnsRenamed({"host": "of_host", "path": "of_path"})
        out = out.join(rates, F.col("host").eqNullSafe(F.col("of_host")) & F.col("path").eqNullSafe(F.col("of_path"))).drop("of_host", "of_path")
        site = F.log(F.col(f"{fault}_site_rate") / (1 - F.col(f"{fault}_site_rate"))) - F.lit(float(np.log(rate / (1 - rate))))
        site = F.greatest(F.lit(-SWAY), F.least(F.lit(SWAY), site))
        out = out.withColumn(f"{fault}_posterior", 1.0 / (1.0 + F.exp(-(F.col(f"{fault}_evidence") + site))))
    return out.withColumn("keep", (F.col("junk_posterior") < 0.5) & (F.col("toxic_posterior") < 0.5))

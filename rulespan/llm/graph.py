"""Connected components and exact linking of large buckets, without all pairs.

Both work on tables only: no link, label or component reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulespan.llm.common import materialize, release


#: Links that one task joins (16 bytes each), at most; more go by rounds over tables.
FEW = 1_000_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lo, hi) of all links -> (node, label): each node takes its neighbours' least label, and
    its label's label, until nothing changes."""
    parts = [[b.column(i).to_numpy(zero_copy_only=False) for i in range(2)] for b in batches if b.num_rows]
    if not parts:
        return
    lo, hi = (np.concatenate([p[i] for p in parts]) for i in range(2))
    nodes, at = np.unique(np.concatenate([lo, hi]), return_inverse=True)
    lo, hi = at[: len(lo)], at[len(lo) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        least = np.minimum(label[lo], label[hi])
        # The ends' labels are joined as well, not only the ends.
        for end in (lo, hi, before[lo], before[hi]):
            np.minimum.at(label, end, least)
        label = label[label]
        if (label == before).all():
            break
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "label"])


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(node, label)``: each node's smallest reachable node.

    Alternates two steps that keep the components: every node's larger neighbours
    are linked to its smallest neighbour, then every node's neighbours to its
    smallest. Both are one grouped minimum (combined before the shuffle) and one
    join, and the number of rounds grows with the logarithm of a component's
    diameter. Up to ``FEW`` links are joined by one task instead. Empty input gives an
    empty result; loops and repeats are allowed."""
    spark = edges.sparkSession
    links = materialize(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo <> hi").distinct(), "cc")
    if links.count() <= FEW:
        return links.select("lo", "hi").repartition(1).mapInArrow(_joined, "node long, label long")
    while not _is_forest_of_stars(links):
        both = links.select(F.col("hi").alias("n"), F.col("lo").alias("m")).unionByName(links.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        least = both.groupBy("n").agg(F.min("m").alias("least")).withColumn("least", F.least("least", "n"))
        large = both.where("m > n").join(least, "n").select(F.col("m").alias("hi"), F.col("least").alias("lo")).where("hi <> lo")
        large = materialize(large.distinct(), "cc-large")
        root = large.groupBy("hi").agg(F.min("lo").alias("least"))
        small = large.join(root, "hi").select(F.col("lo").alias("hi"), F.col("least").alias("lo")).where("hi <> lo")
        small = materialize(small.unionByName(root.select("hi", F.col("least").alias("lo"))).distinct(), "cc-small")
        release(spark, large, links)
        links = small
    nodes = links.select(F.col("hi").alias("node"), F.col("lo").alias("label"))
    return nodes.unionByName(links.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct())


def _is_forest_of_stars(links: DataFrame) -> bool:
    """Whether every larger end has one link, to a node that is no larger end itself."""
    ends = links.select(F.col("hi").alias("n"), F.lit(1).alias("up")).unionByName(links.select(F.col("lo").alias("n"), F.lit(0).alias("up")).distinct())
    return ends.groupBy("n").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 or (ups = 1 and least = 0)").isEmpty()


#: Comparisons per row of the buckets left, up to which they are compared pair by pair.
COMPARED = 128


def link_buckets(members: DataFrame, verify: Callable[[DataFrame], DataFrame], codes: DataFrame | None = None, near: Callable[[Column, Column], Column] | None = None, rounds: int = 3, compare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Components of the verified links between members of the same bucket.

    ``members(k, c)``: item c is in bucket k; a table already written is deleted when it is spent. ``verify(pairs(a, b))`` returns the pairs
    that really are links. ``codes(c, code)`` and ``near(code, code)`` may rule pairs out
    before that, as a condition of the joins that make them; ``compare(rows(k, c, label))``
    may do so for all pairs of a bucket whose labels differ, without making the others.

    A bucket of n items is not expanded into n**2 pairs: each round compares a
    bucket's items with one centre (its least item), joins what links, and goes on
    with the buckets that still hold items of different components, without the
    centre, which has been compared with all. What is left after ``rounds``, or after the
    first if that is at most ``COMPARED`` comparisons a row, is compared pair by pair, again
    between different components only, so that no connection is missed. Returns
    ``(node, label)`` for linked items."""
    spark = members.sparkSession
    left = members if hasattr(members, "_written_to") else materialize(members.select("k", "c"), "members")
    labels: DataFrame | None = None

    def coded(rows: DataFrame, c: str, code: str) -> DataFrame:
        return rows.join(codes.select(F.col("c").alias(c), F.col("code").alias(code)), c)

    for turn in range(rounds + 1):
        last = turn == rounds
        if labels is not None:
            item = left.join(labels.withColumnRenamed("node", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))
        else:
            item = left.withColumn("label", F.col("c"))
        first = F.min(F.struct("c", "label")).alias("first")
        mixed = item.groupBy("k").agg(first, F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("k", "first")
        kept = materialize(item.join(mixed, "k"), "mixed")
        release(spark, left)
        if kept.isEmpty():
            release(spark, kept)
            break
        # The first round joins most copies, and what is left is much less.
        if compare is not None and 0 < turn < rounds:
            sizes = kept.groupBy("k").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2).alias("pairs"), F.sum("count").alias("rows")).first()
            last = sizes["pairs"] <= COMPARED * sizes["rows"]
        if last and compare is not None:
            pairs = compare(kept.select("k", "c", "label"))
        elif last:
            one = kept.select("k", F.col("c").alias("a"), "label")
            two = kept.select("k", F.col("c").alias("b"), F.col("label").alias("other"))
            on = (one["k"] == two["k"]) & (F.col("a") < F.col("b")) & (F.col("label") != F.col("other"))
            if near is not None:
                one, two = coded(one, "a", "code_a"), coded(two, "b", "code_b")
                on = (one["k"] == two["k"]) & (F.col("a") < F.col("b")) & (F.col("label") != F.col("other")) & near(F.col("code_a"), F.col("code_b"))
            pairs = one.join(two, on).select("a", "b").distinct()
        else:
            pairs = kept.where("c <> first.c and label <> first.label").select(F.col("first.c").alias("a"), F.col("c").alias("b")).distinct()
            if near is not None:
                pairs = coded(coded(pairs, "a", "code_a"), "b", "code_b").where(near(F.col("code_a"), F.col("code_b"))).select("a", "b")
        pairs = materialize(pairs, "pairs")
        # Each item's pair with its least partner first: most others then lie in one
        # component and need no verification.
        least = pairs.groupBy(F.col("b").alias("of")).agg(F.min("a").alias("least"))
        for wanted in (F.col("a") == F.col("least"), F.col("a") != F.col("least")):
            tried = pairs.join(least, F.col("b") == F.col("of")).where(wanted).select("a", "b")
            if labels is not None:
                for end in ("a", "b"):
                    own = labels.select(F.col("node").alias("node"), F.col("label").alias(f"label_{end}"))
                    tried = tried.join(own, F.col(end) == F.col("node"), "left").drop("node").withColumn(f"label_{end}", F.coalesce(f"label_{end}", end))
                tried = tried.where("label_a <> label_b").select("a", "b")
            found = materialize(verify(tried), "links")
            if not found.isEmpty():
                # Earlier components count as links to their least items.
                edges = found if labels is None else found.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))
                labels = materialize(components(edges), "labels")
            release(spark)
        left = materialize(kept.where("c <> first.c").select("k", "c"), "members")
        release(spark, kept, pairs)
        if last:
            break
    if labels is None:
        return spark.createDataFrame([], "node long, label long")
    return labels

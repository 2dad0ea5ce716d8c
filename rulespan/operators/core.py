"""Closure, selection, overlay and rebuild operators: DataFrames in, a DataFrame out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rulespan.plans.steps import cut


#: Levels that a round of a closure goes down.
HOPS = 5


#: Edges that every task may hold to walk its own roots; larger hierarchies are walked by joins.
HELD = 2_000_000
#: Pairs of root and node that one walk holds before its roots are divided.
WALKED = 4_000_000


def closure(edges: DataFrame, roots: DataFrame, up: bool = False) -> DataFrame:
    """``edges(child, parent)``, ``roots(root)`` -> ``(root, node)``: each root, and all it
    reaches downwards (or upwards). A set: diamonds give one row, cycles end; null ends
    and roots give none.

    A hierarchy of at most ``HELD`` edges goes to every task, which walks its roots level by
    level: one pass, whatever the depth. A larger one is walked by joins, in rounds."""
    step = edges.select(F.col("child" if up else "parent").alias("node"), F.col("parent" if up else "child").alias("next"))
    step = step.where("node is not null and next is not null and node <> next")
    held = step.limit(HELD + 1).toArrow()
    if held.num_rows > HELD:
        return _closure_by_joins(step, roots)
    kind = edges.schema["child"].dataType.simpleString()
    graph = edges.sparkSession.sparkContext.broadcast(_Graph(held.column("node"), held.column("next")))
    wanted = roots.select(F.col("root").cast(kind).alias("root")).where("root is not null").distinct()
    # Roots are few and what they reach is not, so they are dealt over all tasks.
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return wanted.repartition(parts).mapInArrow(_walk(graph), f"root {kind}, node {kind}")


class _Graph:
    """Children of numbered nodes, one list after the other."""

    def __init__(self, node: pa.ChunkedArray, after: pa.ChunkedArray):
        self.nodes = pa.chunked_array([*node.chunks, *after.chunks], node.type).unique()
        a, b = (pc.index_in(x, self.nodes).to_numpy(zero_copy_only=False).astype(np.int64) if len(x) else np.zeros(0, np.int64) for x in (node.combine_chunks(), after.combine_chunks()))
        order = np.argsort(a, kind="stable")
        self.after = b[order]
        self.first = np.searchsorted(a[order], np.arange(len(self.nodes) + 1))

    def walk(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(place in ``start``, node) of all that is reached, None if that is too much at once."""
        size = max(1, len(self.nodes))
        seen = level = np.arange(len(start)) * size + start
        while len(level):
            node = level % size
            many = self.first[node + 1] - self.first[node]
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            reached = np.unique(np.repeat(level - node, many) + self.after[np.repeat(self.first[node], many) + step])
            level = np.setdiff1d(reached, seen, assume_unique=True)
            seen = np.union1d(seen, level)
            if len(seen) > WALKED and len(start) > 1:
                return None
        return seen // size, seen % size


def _walk(graph):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = graph.value
        for batch in batches:
            roots = batch.column(0)
            at = pc.index_in(roots, g.nodes)
            # Roots that no edge names reach themselves.
            alone = roots.filter(at.is_null())
            yield pa.RecordBatch.from_arrays([alone, alone], names=["root", "node"])
            known, at = roots.filter(at.is_valid()), at.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
            todo = [(0, len(at))]
            while todo:
                a, b = todo.pop()
                if a == b:
                    continue
                found = g.walk(at[a:b])
                if found is None:
                    todo += [(a, (a + b) // 2), ((a + b) // 2, b)]
                    continue
                yield pa.RecordBatch.from_arrays([known.take(pa.array(found[0] + a)), g.nodes.take(pa.array(found[1])).cast(known.type)], names=["root", "node"])

    return run


def _closure_by_joins(step: DataFrame, roots: DataFrame) -> DataFrame:
    """A closure in rounds: each goes ``HOPS`` levels on from what the one before found first at
    its last level, and ends the walk if it finds nothing there."""
    level = roots.select("root").where("root is not null").distinct().withColumn("node", F.col("root"))
    known: DataFrame | None = None
    while True:
        found = level.withColumn("hop", F.lit(0))
        for hop in range(1, HOPS + 1):
            level = level.join(step, "node").select("root", F.col("next").alias("node"))
            # Diamonds are taken together every other level, before they multiply.
            level = level.distinct() if hop % 2 == 0 else level
            found = found.unionByName(level.withColumn("hop", F.lit(hop)))
        found = found.groupBy("root", "node").agg(F.min("hop").alias("hop"))
        found = cut(found if known is None else found.join(known, ["root", "node"], "left_anti"))
        known = found.select("root", "node") if known is None else known.unionByName(found.select("root", "node"))
        level = found.where(F.col("hop") == HOPS).select("root", "node")
        if level.isEmpty():
            return known


def lists(df: DataFrame, keys: list[str], values: list[str], name: str, tile: int) -> DataFrame:
    """The rows of each key in lists of about ``tile``, the same rows in the same list whenever a task is run again."""
    size = df.groupBy(*keys).agg(F.count("*").alias("n"))
    dealt = df.join(size, keys).withColumn(f"{name}_deal", F.pmod(F.xxhash64(*values), F.ceil(F.col("n") / tile)))
    return dealt.groupBy(*keys, f"{name}_deal").agg(F.sort_array(F.collect_list(F.struct(*values))).alias(name))


def pick_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def live(log: DataFrame) -> DataFrame:
    """Rows of an append-only log that nothing supersedes."""
    return log.where(F.col("superseded_by").isNull())


def supersede(log: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """Point each row at the next of its natural key."""
    return log.withColumn("superseded_by", F.lead(id_col).over(W.partitionBy(*keys).orderBy(id_col)))


def overlay_violations(log: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """Broken rules of an overlay, which must be none: (kind, id). A row may only point to
    a later row of its own key; a key has one live row at most; keys are not null."""
    later = log.select(F.col(id_col).alias("_to"), *[F.col(k).alias(f"_{k}") for k in keys])
    joined = log.where("superseded_by is not null").join(later, F.col("superseded_by") == F.col("_to"), "left")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    wrong = joined.where(F.col("_to").isNull() | ~same).select(F.lit("wrong target").alias("kind"), F.col(id_col).cast("long").alias("id"))
    early = joined.where(F.col("superseded_by") <= F.col(id_col)).select(F.lit("not later").alias("kind"), F.col(id_col).cast("long").alias("id"))
    many = live(log).groupBy(*keys).agg(F.count("*").alias("n"), F.max(id_col).alias("id")).where("n > 1").select(F.lit("many live").alias("kind"), F.col("id").cast("long"))
    null = log.where(F.expr(" or ".join(f"{k} is null" for k in keys))).select(F.lit("null key").alias("kind"), F.col(id_col).cast("long").alias("id"))
    return wrong.unionByName(early).unionByName(many).unionByName(null)


def rebuild(existing: DataFrame, new: DataFrame, source: str, **only) -> DataFrame:
    """A projection after one source (or a part of it, by ``only``) is derived anew."""
    gone = F.col("source") == source
    for k, v in only.items():
        gone = gone & (F.col(k) == v)
    return existing.where(~F.coalesce(gone, F.lit(False))).unionByName(new.select(*existing.columns))


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows whose key isn't there yet, one for each key (the least row)."""
    first = pick_first(new, keys, *[F.col(c).asc_nulls_last() for c in new.columns])
    return first.join(existing.select(*keys).distinct(), keys, "left_anti")


def upsert_first_seen(old: DataFrame, new: DataFrame, key: str, first: str = "first_run") -> DataFrame:
    """Latest attributes win; the first run is written once. Adds ``is_new``."""
    attrs = [c for c in old.columns if c not in (key, first)]
    n = new.select(key, *[F.col(c).alias(f"_{c}") for c in (*attrs, first)], F.lit(True).alias("_here"))
    out = old.withColumn("_old", F.lit(True)).join(n, key, "full_outer")
    return out.select(key, *[F.when(F.col("_here"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in attrs], F.coalesce(first, f"_{first}").alias(first), F.col("_old").isNull().alias("is_new"))


def withdraw(live_rows: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """Withdrawals of ``asked`` keys: a decision to be written where something is live, else refused."""
    here = live_rows.select(*keys).distinct().withColumn("_live", F.lit(True))
    outcome = F.when(F.col("_live"), "written").otherwise("refused")
    return asked.distinct().join(here, keys, "left").select(*keys, F.lit("withdrawn").alias("decision"), outcome.alias("outcome"))


def incomplete_runs(runs: DataFrame) -> DataFrame:
    """Runs that began and never finished."""
    return runs.where("finished is null").select("run_id", "source", "writer", "started")


def loaded_releases(runs: DataFrame) -> DataFrame:
    """The last finished run of each source and writer."""
    last = pick_first(runs.where("finished is not null"), ["source", "writer"], F.desc("finished"), F.desc("run_id"))
    return last.select("source", "writer", "run_id")


def shrink_guard(new_rows: int, stored_rows: int, least: float = 0.5, allowed: bool = False) -> None:
    """Refuses an input that has lost more than its share of the stored rows, unless that is allowed."""
    if not allowed and stored_rows and new_rows < least * stored_rows:
        raise ValueError(f"{new_rows} rows would replace {stored_rows}: allow the loss if it is meant")

"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

DataFrame functions only. A document of weight w draws the key -ln(u) / w with u
uniform: ordered by key, documents come as if drawn without replacement with
probabilities in proportion to their weights. u is a hash of the document's id, so
reruns agree. A source takes complete epochs of its documents first, and then the
documents of least key until their sizes, summed in key order, fill its budget; the
document on the border gives only the words still wanted.

The running sum of a source is taken in two steps, so that a source with a third of
all rows is no single task: sizes are summed by (source, key bucket), the few bucket
sums run on, and rows are ordered only within the one bucket where the budget ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rulespan.llm.common import materialize

#: Rows that a key bucket holds on average.
BUCKET_ROWS = 2000


def word_count(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; 0 for null."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda x: x != "")).cast("long")


def unit(seed: int, *keys) -> Column:
    """A uniform number in (0, 1) from the keys' hash."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) + F.lit(0.5)) / F.lit(float(2**53))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Words wanted of each source.

    ``sizes(source, source_size)``, a row per source. Sources ordered by code point,
    null last, weigh ``weights`` over and over; together they get ``share`` of all
    words, none more than ``most`` times its own, the excess going to the others by
    weight until none is above. In closed form: a source is at its cap iff the level
    (words per weight) left by the sources that reach their caps earlier is no lower
    than its own cap per weight. One row per source passes through one task."""
    order = W.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    every = W.partitionBy(F.lit(0))
    out = sizes.withColumn("weight", w).withColumn("cap", most * F.col("source_size"))
    out = out.withColumn("level", F.col("cap") / F.col("weight")).withColumn("budget", share * F.sum("source_size").over(every))
    earlier = W.partitionBy(F.lit(0)).orderBy("level").rangeBetween(W.unboundedPreceding, W.currentRow)
    # Sums over the sources of a lower level: the running sums without those of the same level.
    same = W.partitionBy("level")
    out = out.withColumn("cap_before", F.sum("cap").over(earlier) - F.sum("cap").over(same))
    out = out.withColumn("weight_left", F.sum("weight").over(every) - F.sum("weight").over(earlier) + F.sum("weight").over(same))
    out = out.withColumn("capped", F.col("level") * F.col("weight_left") <= F.col("budget") - F.col("cap_before"))
    full = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(every)
    rest = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(every)
    out = out.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise((F.col("budget") - full) / rest * F.col("weight")))
    return out.select("source", "source_size", "target", *[c for c in sizes.columns if c not in ("source", "source_size")])


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", quality: Column | None = None, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """How many words the mix takes of each document.

    Returns (id, size, source, source_size, target, taken, epochs): ``taken`` is
    ``epochs`` times the size, plus the size of a document in the fractional epoch, or
    the part of it that still fits. ``quality`` is a positive weight; null, zero or
    negative count as the least weight, 1e-6. A null source is a source of its own,
    last in order. Empty and null texts have size 0 and are taken 0 times. Rows that
    repeat an id are told apart by their size only and then share a key; ties are
    ordered by id. An empty table gives an empty result. Other columns are ignored."""
    size = word_count(F.col(text_col))
    if quality is None:
        # Prose has words of some five letters; tables, shouting and symbol noise depart from it.
        quality = 1.0 / (1.0 + F.abs(F.length(F.coalesce(text_col, F.lit(""))) / (size + 1.0) - 6.0))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), F.greatest(F.coalesce(quality.cast("double"), F.lit(0.0)), F.lit(1e-6)).alias("q"))
    base = materialize(base, "mix-sizes")
    by_source = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"), F.avg("q").alias("avg_q"))
    plan = targets(by_source, weights, share, most)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("want", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    plan = plan.withColumn("buckets", F.ceil(F.col("rows") / BUCKET_ROWS))
    # A row per source: joined by null-safe equality, broadcast by Spark where it is small.
    key = -F.log(unit(seed, "doc_id")) / F.col("q")
    row = base.join(plan.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    row = row.withColumn("key", key).withColumn("bucket", F.floor((1.0 - F.exp(-F.col("key") * F.col("avg_q"))) * F.col("buckets")))
    sums = row.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"), F.first("want").alias("want"))
    before = F.sum("bucket_size").over(W.partitionBy("source").orderBy("bucket")) - F.col("bucket_size")
    sums = sums.withColumn("before", before).withColumn("border", (F.col("before") < F.col("want")) & (F.col("before") + F.col("bucket_size") > F.col("want")))
    # Of a source, all buckets before the border are taken whole, none after it.
    edge = sums.groupBy("source").agg(F.max(F.when(F.col("border"), F.col("bucket"))).alias("edge"), F.max(F.when(F.col("border"), F.col("before"))).alias("edge_before"), F.max(F.when(F.col("before") + F.col("bucket_size") <= F.col("want"), F.col("bucket"))).alias("last_whole"))
    row = row.join(edge.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    at_edge = F.col("bucket") == F.coalesce("edge", F.lit(-1).cast("long"))
    inside = row.where(at_edge)
    run = F.sum("size").over(W.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size") + F.col("edge_before")
    inside = inside.withColumn("part", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("want") - run)))
    outside = row.where(~at_edge).withColumn("part", F.when(F.col("bucket") <= F.coalesce("last_whole", F.lit(-1).cast("long")), F.col("size")).otherwise(F.lit(0).cast("long")))
    out = inside.unionByName(outside)
    return out.select("doc_id", "size", "source", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"), "epochs", "part")

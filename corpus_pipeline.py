"""A corpus pipeline of five of the operators, each stage over all its predecessor kept.

quality -> near duplicates -> repeated passages -> mix of sources -> packed sequences.
Each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespan.llm.common import materialize, read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    from rulespan.llm.quality import classify

    kept = classify(docs, read(spark, sf_dir, "labels")).where("keep").select(F.col("doc_id").alias("kept_id"))
    return docs.join(kept, F.col("doc_id") == F.col("kept_id"), "left_semi").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group linked by five-word shingles at 0.8 or more."""
    from rulespan.llm.jaccard import join_components

    kept = join_components(docs, percent=80, words=5).where("doc_id = component_id").select(F.col("doc_id").alias("kept_id"))
    return docs.join(kept, F.col("doc_id") == F.col("kept_id"), "left_semi").select(*COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that start earlier in the corpus."""
    from rulespan.llm.suffix_dedup import dedup_suffixes

    out = dedup_suffixes(docs, texts=True, carry=("lang", "source"))
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: once for each complete epoch, and once
    more if half of their words or more are in the fractional one."""
    from rulespan.llm.mixing import mix

    taken = mix(docs)
    copies = (F.col("epochs") + F.when((F.col("part") > 0) & (2 * F.col("part") >= F.col("size")), 1).otherwise(0)).cast("int")
    taken = taken.select(F.col("doc_id").alias("taken_id"), copies.alias("copies")).where("copies > 0")
    rows = docs.join(taken, F.col("doc_id") == F.col("taken_id"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    import public_tokenizers

    from rulespan.llm.packing import pack

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("passages", passages), ("mixture", mixture), ("packing", packing)]

#: No stage but the mix's sums can be put in SQL: tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs

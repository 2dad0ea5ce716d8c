"""Resolution of identifiers and names to registered entities: tables in, all claimants out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulespan.operators.core import pick_first


def live_claims(claims: DataFrame, scheme: str) -> DataFrame:
    """(value, entity) that nothing superseded."""
    return claims.where((F.col("scheme") == scheme) & F.col("superseded_by").isNull()).select("value", "entity").distinct()


def many_valued(rows: DataFrame, key: str, claims: DataFrame, scheme: str) -> DataFrame:
    """Rows with every entity that claims their key; the fan-out is intended."""
    return rows.join(live_claims(claims, scheme).withColumnRenamed("value", key), key)


def by_tier(rows: DataFrame, keys: list[tuple[str, str]], claims: DataFrame) -> DataFrame:
    """Every claimant of each row by the first of ``keys`` (column, scheme) that has any:
    the columns of ``rows`` with entity and method. A later key is only asked where no earlier one
    resolved; rows without a claimant give none."""
    out = None
    left = rows
    for column, scheme in keys:
        of = live_claims(claims, scheme).withColumnRenamed("value", column)
        found = left.join(of, column).withColumn("method", F.lit(scheme)).select(*rows.columns, "entity", "method").distinct()
        out = found if out is None else out.unionByName(found)
        left = left.join(of, column, "left_anti").select(*rows.columns)
    return out


def first_by_tier(rows: DataFrame, key: str, keys: list[tuple[str, str]], claims: DataFrame) -> DataFrame:
    """One claimant of each row, the least by value and entity of its first tier, or none:
    an answer of null says that the object is no registered entity."""
    tiers = {s: i for i, (_, s) in enumerate(keys)}
    tier = F.coalesce(*[F.when(F.col("method") == s, i) for s, i in tiers.items()])
    value = F.coalesce(*[F.when(F.col("method") == s, F.col(c)) for c, s in keys])
    best = pick_first(by_tier(rows, keys, claims), [key], tier, value, F.col("entity")).select(key, "entity", "method")
    return rows.select(key).join(best, key, "left")


def by_name(names: DataFrame, name: str, claimed: DataFrame, fallback: Column, methods: tuple[str, str] = ("exact", "salt_stripped")) -> DataFrame:
    """Every claimant of a name, or else of its ``fallback`` form: with entity and method.
    ``claimed(name, entity)``; the exact name is tried first, and a null fallback isn't tried."""
    known = claimed.select(F.col("name").alias("_name"), "entity").distinct()
    exact = names.join(known, F.col(name) == F.col("_name")).withColumn("method", F.lit(methods[0]))
    rest = names.join(known, F.col(name) == F.col("_name"), "left_anti")
    other = rest.withColumn("_fallback", fallback).join(known, F.col("_fallback") == F.col("_name")).withColumn("method", F.lit(methods[1]))
    return exact.select(*names.columns, "entity", "method").unionByName(other.select(*names.columns, "entity", "method"))


def unique_or_unresolved(claimed: DataFrame, by: list[str]) -> DataFrame:
    """The only claimant of each folded key, null where there are several."""
    n = claimed.groupBy(*by).agg(F.countDistinct("entity").alias("claimants"), F.min("entity").alias("entity"))
    return n.withColumn("entity", F.when(F.col("claimants") == 1, F.col("entity")))


def bucketed(rows: DataFrame, key: str, claimed: DataFrame, named: DataFrame) -> DataFrame:
    """What is known of each record: an exact claim, an ambiguous one, else a unique or an
    ambiguous name, else nothing: (key, bucket, matches). ``claimed(key, entity)`` and
    ``named(key, entity)`` hold a record's matches of either kind."""
    out = rows.select(key).distinct()
    for label, found in (("claims", claimed), ("names", named)):
        out = out.join(found.groupBy(key).agg(F.countDistinct("entity").alias(label)), key, "left").na.fill(0, [label])
    bucket = (
        F.when(F.col("claims") == 1, "resolved_exact_claim").when(F.col("claims") > 1, "ambiguous_identity")
        .when(F.col("names") == 1, "candidate_unique_name").when(F.col("names") > 1, "ambiguous_name").otherwise("unresolved")
    )
    return out.select(key, bucket.alias("bucket"), F.when(F.col("claims") > 0, F.col("claims")).otherwise(F.col("names")).alias("matches"))


def with_forms(subjects: DataFrame, compositions: DataFrame) -> DataFrame:
    """Each subject and the composites that have it as an active component:
    ``subjects(subject)``, ``compositions(composite, component, is_active)`` -> (subject, form)."""
    active = compositions.where("is_active is true").select(F.col("component").alias("subject"), F.col("composite").alias("form"))
    own = subjects.select("subject", F.col("subject").alias("form"))
    return own.unionByName(active.join(subjects.select("subject").distinct(), "subject", "left_semi")).distinct()

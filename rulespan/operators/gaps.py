"""Gaps: what the registry can't answer yet, one operator per kind, and their register.

Each operator returns a row per gap; :func:`register` turns all of them into questions
with ids that depend on kind and key only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulespan.functions.text import uuid5
from rulespan.operators.core import pick_first
from rulespan.operators.rules import binding, contributors, promoted

LIVE = "superseded_by is null"


def _released(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows whose run is known, with its release."""
    return rows.join(runs.select(F.col("run_id").alias("run"), "release"), "run")


def unclassified(entities: DataFrame, membership: DataFrame, axis: str) -> DataFrame:
    """Entities that belong to nothing by the given axis."""
    return entities.join(membership.where(F.col("axis") == axis), "entity", "left_anti").select("entity", "name")


def _by_concept(reach: DataFrame, concepts: DataFrame, runs: DataFrame, *more: Column) -> DataFrame:
    rows = _released(reach, runs).join(concepts.select(F.col("concept").alias("object"), "name", "concept_type"), "object")
    return rows.groupBy(F.col("object").alias("concept"), "name", "concept_type").agg(F.count("*").alias("rules"), *more, F.max("release").alias("release"))


def unpopulated(reach: DataFrame, concepts: DataFrame, runs: DataFrame) -> DataFrame:
    """Concepts of rules that no policy could make yield a pair: ``reach`` (with run) counts
    no partner over the whole subtree."""
    return _by_concept(reach.where("subtree_partner_count = 0"), concepts, runs)


def dead_by_policy(reach: DataFrame, axis: DataFrame, policy: DataFrame, concepts: DataFrame, runs: DataFrame) -> DataFrame:
    """Concepts whose rules would reach partners below, but a live denial leaves direct ones
    only and there are none."""
    denied = binding(policy).where("decision = 'deny'").select(F.col("concept").alias("object"))
    rows = reach.join(F.broadcast(axis.where("expands").select("rel")), "rel").join(denied, "object", "left_semi")
    rows = rows.where("direct_partner_count = 0 and subtree_partner_count > 0")
    return _by_concept(rows, concepts, runs, F.max("subtree_partner_count").alias("subtree_partners"))


def unreviewed_roots(rules: DataFrame, class_rules: DataFrame, axis: DataFrame, subtree: DataFrame, policy: DataFrame, concepts: DataFrame, runs: DataFrame, more_than: int = 20) -> DataFrame:
    """Concepts that rules of an expanding axis name, with many descendants and no decision.
    ``subtree`` holds the roots of both grains; a class rule counts once for a class that is both of its ends."""
    ends = F.explode(F.array_distinct(F.array("subject_class", "object_class"))).alias("concept")
    naming = rules.select(F.col("object").alias("concept"), "rel", "run").unionByName(class_rules.select(ends, "rel", "run"))
    sized = subtree.groupBy(F.col("root").alias("concept")).agg((F.count("*") - 1).alias("descendants")).where(F.col("descendants") > more_than)
    rows = naming.join(F.broadcast(axis.where("expands").select("rel")), "rel").join(sized, "concept")
    rows = _released(rows, runs).join(binding(policy), "concept", "left_anti").join(concepts.select("concept", "name", "concept_type"), "concept")
    return rows.groupBy("concept", "name", "concept_type", "descendants").agg(F.count("*").alias("rules"), F.max("release").alias("release"))


def unmatched_names(unmatched: DataFrame, claims: DataFrame, runs: DataFrame, scheme: str = "RXNORM_IN") -> DataFrame:
    """Identifiers that releases name and no live claim has: the newest run's row, named ones first."""
    claimed = claims.where((F.col("scheme") == scheme) & F.col("superseded_by").isNull()).select(F.col("value").alias("rxcui"))
    rows = _released(unmatched, runs).join(claimed, "rxcui", "left_anti")
    order = (F.desc("run"), F.col("name").isNull(), F.col("reason").asc_nulls_last(), F.col("name"))
    return pick_first(rows, ["rxcui"], *order).select("rxcui", "name", "release")


def unresolved_objects(unresolved: DataFrame, runs: DataFrame) -> DataFrame:
    """Objects of rules that no source resolved, by upper-cased source and code."""
    rows = _released(unresolved, runs).groupBy(F.upper("source").alias("source"), "code")
    rels = F.array_join(F.array_sort(F.collect_set("rel")), ", ").alias("rels")
    return rows.agg(F.max("name").alias("name"), rels, F.max("kind").alias("kind"), F.sum("assertions").alias("rules"), F.max("release").alias("release"))


def conditions_without_indication(conditions: DataFrame, trees: DataFrame, reach: DataFrame, letters: tuple[str, ...] = ("C", "F"), scr_class: str = "3") -> DataFrame:
    """Conditions that no indication reaches, of a disease tree, or without trees and of the
    supplementary class of diseases. ``reach`` as :func:`rulespan.operators.conditions.indication_reach`."""
    here = trees.where(F.substring("tree", 1, 1).isin(*letters)).select("condition").distinct().withColumn("disease", F.lit(True))
    placed = trees.select("condition").distinct().withColumn("placed", F.lit(True))
    rows = conditions.join(reach.where("direct_rules + generalised_rules = 0").select("condition"), "condition", "left_semi")
    rows = rows.join(here, "condition", "left").join(placed, "condition", "left")
    rows = rows.where(F.col("disease") | (F.col("placed").isNull() & (F.col("scr_class") == scr_class)))
    return rows.select("condition", "name", "kind")


def uncurated_effects(concepts: DataFrame, runs: DataFrame, rules: DataFrame, effects: DataFrame, subtree: DataFrame, membership: DataFrame, kind: str = "PE", members: int = 10) -> DataFrame:
    """Concepts of a kind without a live effect that some rule names, or that enough distinct
    entities belong to over the subtree. A concept outside of ``subtree`` counts none."""
    open_ = _released(concepts.where(F.col("concept_type") == kind), runs).join(effects.where(LIVE).select(F.col("effect").alias("concept")), "concept", "left_anti")
    named = rules.groupBy(F.col("object").alias("concept")).agg(F.count("*").alias("rules"))
    held = membership.select(F.col("concept").alias("node"), "entity")
    reach = subtree.join(open_.select(F.col("concept").alias("root")), "root", "left_semi").join(held, "node").select("root", "entity").distinct()
    reach = reach.groupBy(F.col("root").alias("concept")).agg(F.count("*").alias("members"))
    rows = open_.join(named, "concept", "left").join(reach, "concept", "left").na.fill(0, ["rules", "members"])
    return rows.where((F.col("rules") >= 1) | (F.col("members") >= members)).select("concept", "name", "rules", "members", "release")


def uncurated_thresholds(effects: DataFrame, grades: DataFrame, subtree: DataFrame, membership: DataFrame, runs: DataFrame) -> DataFrame:
    """Live accumulating effects without a major threshold whose ungraded members alone reach
    the total. A member is graded if any live grade of the effect, of whatever magnitude, touches it."""
    members = contributors(effects, grades, None, membership, subtree).select("effect", "entity")
    touched = promoted(grades, subtree, membership).join(members, ["effect", "entity"], "left_semi")
    graded = touched.groupBy("effect").agg(F.countDistinct("id").alias("graded"), F.countDistinct("entity").alias("graded_members"))
    total = members.groupBy("effect").agg(F.count("*").alias("members"))
    rows = _released(effects.where(f"{LIVE} and accumulates and t_major = 0"), runs)
    rows = rows.join(graded, "effect", "left").join(total, "effect", "left").na.fill(0, ["graded", "graded_members", "members"])
    rows = rows.withColumn("ungraded", F.col("members") - F.col("graded_members")).where("ungraded >= t_total")
    return rows.select("effect", "t_major", "t_total", "graded", "ungraded", "release")


def ungraded_contributions(effects: DataFrame, grades: DataFrame, subtree: DataFrame, membership: DataFrame, runs: DataFrame) -> DataFrame:
    """Populated concepts under each live accumulating effect that no live grade of it names:
    (effect, contributor, members, release)."""
    held = membership.select(F.col("concept").alias("node"), "entity").distinct().groupBy("node").agg(F.count("*").alias("members"))
    rows = _released(effects.where(f"{LIVE} and accumulates"), runs).join(subtree, F.col("effect") == F.col("root")).join(held, "node")
    rows = rows.select("effect", F.col("node").alias("contributor"), "members", "release")
    return rows.join(grades.where(LIVE).select("effect", "contributor"), ["effect", "contributor"], "left_anti")


def ineffective_contributions(grades: DataFrame, subtree: DataFrame, membership: DataFrame, runs: DataFrame) -> DataFrame:
    """Live grades whose contributor shares no member with the effect: (effect, contributor, magnitude, release)."""
    live = grades.where(LIVE)
    held = membership.select(F.col("concept").alias("node"), "entity")
    reach = subtree.join(live.select(F.col("effect").alias("root")).union(live.select("contributor")).distinct(), "root", "left_semi")
    reach = reach.join(held, "node").select("root", "entity").distinct()
    bites = live.select("id", "effect", "contributor").join(reach.withColumnRenamed("root", "contributor"), "contributor")
    bites = bites.join(reach.withColumnRenamed("root", "effect"), ["effect", "entity"]).select("id").distinct()
    return _released(live.join(bites, "id", "left_anti"), runs).select("effect", "contributor", "magnitude", "release")


def unruled_compositions(compositions: DataFrame) -> DataFrame:
    """Composites of which it is not known for any component whether it is active."""
    rows = compositions.groupBy("composite").agg(F.count("*").alias("components"), F.count("is_active").alias("known"))
    return rows.where("known = 0").select("composite", "components")


def uncurated_contradictions(cond_rules: DataFrame, indications: DataFrame, cond_rulings: DataFrame, entities: DataFrame, conditions: DataFrame) -> DataFrame:
    """(subject, condition) both indicated and contraindicated, without a live ruling."""
    keys = ["subject", "condition"]
    rows = cond_rules.select(*keys).distinct().join(indications.select(*keys, "rel").distinct(), keys)
    rows = rows.join(cond_rulings.where(LIVE).select(*keys), keys, "left_anti")
    rows = rows.join(entities.select(F.col("entity").alias("subject"), "name"), "subject")
    rows = rows.join(conditions.select("condition", F.col("name").alias("condition_name")), "condition")
    return rows.groupBy(*keys, "name", "condition_name").agg(F.countDistinct("rel").alias("predicates"))


def uncurated_rules(pairs: DataFrame, rulings: DataFrame, entities: DataFrame, concepts: DataFrame) -> DataFrame:
    """Rules that pair with someone and have no live judgement: (subject, object, rel) with
    names and the number of distinct partners. Two sources of a rule reach the same partners."""
    keys = ["subject", "object", "rel"]
    open_ = pairs.join(rulings.where(LIVE).select(*keys), keys, "left_anti")
    return uncurated_counts(open_.groupBy(*keys).agg(F.countDistinct("partner").alias("pairs")), rulings, entities, concepts)


def uncurated_counts(counts: DataFrame, rulings: DataFrame, entities: DataFrame, concepts: DataFrame) -> DataFrame:
    """:func:`uncurated_rules` of counts (subject, object, rel, pairs), as :func:`rulespan.operators.rules.rule_pairs` has them."""
    keys = ["subject", "object", "rel"]
    rows = counts.join(rulings.where(LIVE).select(*keys), keys, "left_anti")
    rows = rows.join(entities.select(F.col("entity").alias("subject"), F.col("name").alias("subject_name")), "subject")
    return rows.join(concepts.select(F.col("concept").alias("object"), F.col("name").alias("object_name")), "object")


def unresolved_endpoints(unresolved: DataFrame, runs: DataFrame) -> DataFrame:
    """Ends of list entries that no identifier resolved, by entry and role."""
    rows = _released(unresolved, runs).groupBy("source", "entry", "role")
    return rows.agg(*[F.max(c).alias(c) for c in ("scheme", "value", "name", "release")])


def uncurated_class_rules(reach: DataFrame, class_rulings: DataFrame) -> DataFrame:
    """Class rules that make a pair and have no live judgement. ``reach`` as class_pair_reach."""
    keys = ["subject_class", "object_class", "rel"]
    rows = reach.join(class_rulings.where(LIVE).select(*keys), keys, "left_anti").groupBy(*keys)
    rows = rows.agg(*[F.max(c).alias(c) for c in ("subject_effective", "object_effective", "max_pair_count")])
    return rows.where("max_pair_count > 0")


def unadjudicated_cells(cells: DataFrame, runs: DataFrame) -> DataFrame:
    """Table cells that became no membership, at two grains: withheld ones by substance,
    heading and pathway, the others by substance and disposition."""
    rows = _released(cells, runs).withColumn("substance", F.coalesce("substance", "raw_substance"))
    most = [F.max(c).alias(c) for c in ("raw_substance", "markers", "release")]
    held = rows.where("disposition = 'withheld_qualified'").groupBy("source", "substance", "heading", "pathway", "disposition").agg(*most)
    rest = rows.where("disposition not in ('member', 'withheld_qualified')").groupBy("source", "substance", "disposition").agg(*most)
    none = F.lit(None).cast("string")
    rest = rest.withColumns({"heading": none, "pathway": none, "markers": none})
    return held.unionByName(rest)


def keyed(kind: str, rows: DataFrame, key: Column, text: Column) -> DataFrame:
    """Gaps of one kind as (kind, gap_key, text)."""
    return rows.select(F.lit(kind).alias("kind"), key.alias("gap_key"), text.alias("text")).distinct()


def questions(gaps: list[DataFrame]) -> DataFrame:
    """All kinds' gaps with the id of their question, which depends on kind and key only."""
    return reduce(DataFrame.unionByName, gaps).withColumn("question", uuid5(F.concat("kind", F.lit(":"), "gap_key")))


def register(registry: DataFrame, live: DataFrame, worked_on: DataFrame, run: int) -> DataFrame:
    """The register after a run. ``registry`` (question, kind, gap_key, text, first_run,
    last_run, is_current), ``live`` as :func:`questions`, ``worked_on`` (question) with what
    curators left anything on.

    A live gap is current, with the new text and its first run as it was; a closed one
    goes, unless it was worked on: then it stays under its id and is not current."""
    old = registry.select("question", *[F.col(c).alias(f"_{c}") for c in registry.columns if c != "question"], F.lit(True).alias("_known"))
    rows = live.select("question", "kind", "gap_key", "text", F.lit(True).alias("_live")).join(old, "question", "full_outer")
    kept = worked_on.select("question").distinct().withColumn("_kept", F.lit(True))
    rows = rows.join(kept, "question", "left").where("_live or _kept")
    now = F.coalesce("_live", F.lit(False))
    return rows.select(
        "question", F.coalesce("kind", "_kind").alias("kind"), F.coalesce("gap_key", "_gap_key").alias("gap_key"),
        F.when(now, F.col("text")).otherwise(F.col("_text")).alias("text"),
        F.coalesce("_first_run", F.lit(run)).cast("long").alias("first_run"),
        F.when(now, F.lit(run)).otherwise(F.col("_last_run")).cast("long").alias("last_run"), now.alias("is_current"),
    )

"""Reads of the review service: lookup, queue, metadata, history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespan.operators.core import pick_first
from rulespan.operators.rules import binding

LIVE = "superseded_by is null"


def lookup(effective: DataFrame, asked: DataFrame, entities: DataFrame) -> DataFrame:
    """Grades between each of ``asked(a, b)``, in both directions, the most severe first by rank.

    Unknown entities and an entity against itself are answered as such, and a pair without a
    grade as ``no_rule``: an absent rule is no finding of safety. Returns (a, b, answer,
    direction, severity, evidence, effective_rank)."""
    known = entities.select(F.col("entity").alias("_e"), F.lit(True).alias("_k")).distinct()
    rows = asked.distinct()
    for end in ("a", "b"):
        rows = rows.join(known.select(F.col("_e").alias(end), F.col("_k").alias(f"known_{end}")), end, "left")
    problem = F.when(F.col("known_a").isNull() | F.col("known_b").isNull(), "unknown_entity").when(F.col("a") == F.col("b"), "same_entity")
    rows = rows.select("a", "b", problem.alias("problem"))
    both = rows.where("problem is null").select("a", "b", F.explode(F.array(
        F.struct(F.col("a").alias("subject"), F.col("b").alias("partner"), F.lit("forward").alias("direction")),
        F.struct(F.col("b").alias("subject"), F.col("a").alias("partner"), F.lit("backward").alias("direction")),
    )).alias("way")).select("a", "b", "way.*")
    found = both.join(effective, ["subject", "partner"]).select("a", "b", F.lit("graded").alias("answer"), "direction", "rel", "severity", "evidence", "effective_rank")
    none = rows.join(found, ["a", "b"], "left_anti").select("a", "b", F.coalesce("problem", F.lit("no_rule")).alias("answer"))
    for c in ("direction", "rel", "severity", "evidence"):
        none = none.withColumn(c, F.lit(None).cast("string"))
    return found.unionByName(none.withColumn("effective_rank", F.lit(None).cast("int")))


def effective_reach(reach: DataFrame, axis: DataFrame, policy: DataFrame) -> DataFrame:
    """Rules' reach with the partners that the axis and a live decision leave, as ``impact``."""
    rows = reach.join(F.broadcast(axis.select("rel", "expands")), "rel").join(binding(policy).withColumnRenamed("concept", "object"), "object", "left")
    deep = F.col("expands") & (F.coalesce("decision", F.lit("allow")) != "deny")
    return rows.withColumn("impact", F.when(deep, F.col("subtree_partner_count")).otherwise(F.col("direct_partner_count")))


def _collected(name: str) -> F.Column:
    return F.array_join(F.array_sort(F.collect_set(name)), ",").alias(f"{name}s")


def review_queue(reach, axis, policy, rulings, entities, concepts, runs, contradictions, cond_rules, indications) -> DataFrame:
    """What awaits review: unjudged rules that pair with someone, by their reach (no pair is
    made), and unjudged contradictions: (kind, subject, object, names, rels, sources, releases, impact)."""
    released = runs.select(F.col("run_id").alias("run"), "release")
    keys = ["subject", "object", "rel"]
    rows = effective_reach(reach, axis, policy).join(rulings.where(LIVE).select(*keys), keys, "left_anti").join(released, "run")
    rows = rows.join(entities.select(F.col("entity").alias("subject"), F.col("name").alias("subject_name")), "subject")
    rows = rows.join(concepts.select(F.col("concept").alias("object"), F.col("name").alias("object_name")), "object")
    rows = rows.groupBy(*keys, "subject_name", "object_name").agg(_collected("source"), _collected("release"), F.max("impact").alias("impact")).where("impact > 0")
    one = rows.select(F.lit("interaction_rule").alias("kind"), F.col("subject").cast("string"), F.col("object").cast("string"), "subject_name", "object_name", F.col("rel").alias("rels"), "sources", "releases", "impact")
    of = cond_rules.select("subject", "condition", "rel", "source", "run").unionByName(indications.select("subject", "condition", "rel", "source", "run")).join(released, "run")
    rows = contradictions.join(of, ["subject", "condition"]).groupBy("subject", "condition", "name", "condition_name").agg(_collected("rel"), _collected("source"), _collected("release"))
    two = rows.select(F.lit("condition_contradiction").alias("kind"), F.col("subject").cast("string"), F.col("condition").alias("object"), F.col("name").alias("subject_name"), F.col("condition_name").alias("object_name"), "rels", "sources", "releases", F.lit(1).cast("long").alias("impact"))
    return one.unionByName(two)


def filtered(queue: DataFrame, kind: str | None = None, source: str | None = None, rel: str | None = None, search: str | None = None) -> DataFrame:
    """The queue's rows that all given filters let through; blank filters are none."""
    kind, source, rel, search = ((x or "").strip() or None for x in (kind, source, rel, search))
    if kind:
        queue = queue.where(F.col("kind") == kind)
    for name, value in (("sources", source), ("rels", rel)):
        if value:
            queue = queue.where(F.array_contains(F.split(name, ","), value))
    if search:
        text = F.lower(F.concat_ws(" ", "subject_name", "object_name", F.translate("rels", ",", " ")))
        queue = queue.where(F.instr(text, search.lower()) > 0)
    return queue


def page(queue: DataFrame, number: int = 1, size: int = 25) -> DataFrame:
    """One page of the queue: the highest impact first, then names, ids and relations."""
    if number < 1 or size < 1:
        raise ValueError("pages and their sizes count from 1")
    order = [F.desc("impact"), F.lower("subject_name"), F.lower("object_name"), "subject", "object", "rels"]
    return queue.orderBy(*order).offset((number - 1) * size).limit(size)


def metadata(queue: DataFrame, shown: DataFrame, reviewed: DataFrame) -> DataFrame:
    """One row about a queue and its filtered part: counts by kind, the distinct kinds, sources and
    relations, and the pairs that live judgements cover (``reviewed(pairs)``)."""
    n = lambda k: F.count_if(F.col("kind") == k)
    of = lambda c: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split(c, ","))))), ",")
    kinds = F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds")
    out = queue.agg(n("interaction_rule").alias("interaction_rules"), n("condition_contradiction").alias("condition_contradictions"), kinds, of("sources").alias("all_sources"), of("rels").alias("all_rels"))
    total = shown.agg(F.count("*").alias("total_items"))
    covered = reviewed.agg(F.coalesce(F.sum("pairs"), F.lit(0)).cast("long").alias("reviewed_pairs"))
    return out.crossJoin(total).crossJoin(covered)


def with_metadata(meta: DataFrame, rows: DataFrame) -> DataFrame:
    """The page's rows, each with the metadata; a row of metadata alone where the page is empty."""
    return meta.join(rows, F.lit(True), "left")


def reviewed_pairs(reach, axis, policy, rulings, class_reach, class_rulings) -> DataFrame:
    """Pairs that live applying judgements cover, by grain, counted from reach."""
    keys = ["subject", "object", "rel"]
    one = effective_reach(reach, axis, policy).join(rulings.where(f"{LIVE} and applies").select(*keys), keys)
    keys = ["subject_class", "object_class", "rel"]
    two = class_reach.join(class_rulings.where(f"{LIVE} and applies").select(*keys), keys)
    return one.agg(F.sum("impact").alias("pairs")).unionByName(two.agg(F.sum("max_pair_count").alias("pairs")))


def reviewed_against(rules: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct releases behind each target as one string, sorted."""
    rows = rules.join(runs.select(F.col("run_id").alias("run"), "release"), "run")
    return rows.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("release")), ", ").alias("releases"))


def history(log: DataFrame, status: DataFrame, keys: list[str]) -> DataFrame:
    """Every decision on each target, the oldest first (``turn``), with its signature status."""
    from pyspark.sql import Window as W

    rows = log.join(status.select(F.col("target").alias("id"), "status"), "id", "left").withColumn("status", F.coalesce("status", F.lit("unsigned")))
    return rows.withColumn("turn", F.row_number().over(W.partitionBy(*keys).orderBy("reviewed_at", "id")).cast("long"))


def write_decision(log: DataFrame, decision: DataFrame, keys: list[str]) -> DataFrame:
    """Decisions checked against the live row that their author saw (``expected``, null for
    none): (keys, outcome) with ``written``, ``conflict`` or ``unchanged`` where the graded columns agree."""
    graded = [c for c in decision.columns if c not in (*keys, "expected")]
    live = log.where(LIVE).select(*keys, F.col("id").alias("_live"), *[F.col(c).alias(f"_{c}") for c in graded])
    rows = decision.join(live, keys, "left")
    same = F.col("_live").isNotNull()
    for c in graded:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    outcome = F.when(~F.col("expected").eqNullSafe(F.col("_live")), "conflict").when(same, "unchanged").otherwise("written")
    return rows.select(*keys, outcome.alias("outcome"))


def worklist(questions: DataFrame, states: DataFrame, tiers: DataFrame, checks: DataFrame) -> DataFrame:
    """Current questions that aren't withdrawn, with their state (open by default) and the
    cheapest tier that nobody has checked for them, null if all are. ``tiers(source, rank)`` is a short closed list."""
    state = pick_first(states, ["question"], F.desc("id")).select("question", "state")
    rows = questions.where("is_current").select("question", "kind").join(state, "question", "left")
    rows = rows.withColumn("state", F.coalesce("state", F.lit("open"))).where("state <> 'withdrawn'")
    # Checked sources are gathered per question (as many as there are tiers at most).
    done = checks.join(F.broadcast(tiers), "source").groupBy("question").agg(F.collect_set("source").alias("done"))
    all_tiers = tiers.agg(F.array_sort(F.collect_list(F.struct("rank", "source"))).alias("tiers"))
    rows = rows.join(done, "question", "left").crossJoin(F.broadcast(all_tiers))
    open_ = F.filter("tiers", lambda t: ~F.coalesce(F.array_contains("done", t["source"]), F.lit(False)))
    return rows.select("question", "kind", "state", F.try_element_at(F.transform(open_, lambda t: t["rank"]), F.lit(1)).alias("rank"))


def record(target: DataFrame, questions: DataFrame, annotations: DataFrame, references: DataFrame, profiles: DataFrame) -> DataFrame:
    """What reviewers left on the current question of each ``target(kind, gap_key)``: annotations
    and references with their author's live name, the oldest first (``turn``). A target without a current question is not there."""
    from pyspark.sql import Window as W

    live = profiles.where(LIVE).select("reviewer", F.col("name").alias("author"))
    asked = target.distinct().join(questions.where("is_current").select("kind", "gap_key", "question"), ["kind", "gap_key"])
    one = annotations.select("question", "id", "reviewer", "at", F.lit("annotation").alias("item"), F.col("text").alias("content"), F.lit(None).cast("string").alias("scheme"))
    two = references.select("question", "id", "reviewer", "at", F.lit("reference").alias("item"), F.col("value").alias("content"), "scheme")
    rows = asked.join(one.unionByName(two), "question").join(live, "reviewer", "left")
    turn = F.row_number().over(W.partitionBy("question", "item").orderBy("at", "id")).cast("long").alias("turn")
    return rows.select("kind", "gap_key", "item", "id", "author", "scheme", "content", turn)

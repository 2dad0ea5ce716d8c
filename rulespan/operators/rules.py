"""Rule expansion, reach, curated grains and their precedence."""

from __future__ import annotations

from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rulespan.operators.core import closure, lists
from rulespan.plans.steps import cut


def binding(policy: DataFrame) -> DataFrame:
    """Live expansion decisions that were not withdrawn: (concept, decision)."""
    return policy.where("superseded_by is null and decision <> 'withdrawn'").select("concept", "decision")


def expanded_members(named, axis, subtree, membership, policy) -> DataFrame:
    """``named(concept, rel)`` -> the entities each may reach, through its axis' own
    membership only: (concept, rel, entity, member_class, is_direct). One row per entity:
    a direct membership first, then the least concept below; descendants only if the axis
    expands and no live decision denies it."""
    row = named.distinct().join(F.broadcast(axis), "rel").join(binding(policy), "concept", "left")
    row = row.withColumn("deep", F.col("expands") & (F.coalesce("decision", F.lit("allow")) != "deny"))
    row = row.join(subtree.withColumnRenamed("root", "concept"), "concept").where(F.col("deep") | (F.col("node") == F.col("concept")))
    member = membership.select("entity", F.col("concept").alias("node"), F.col("axis").alias("membership_axis"))
    row = row.join(member, ["node", "membership_axis"])
    # The winner is a minimum, which is combined before the shuffle.
    best = F.min(F.struct((F.col("node") != F.col("concept")).alias("deep"), F.col("node").alias("member_class"))).alias("best")
    row = row.groupBy("concept", "rel", "entity").agg(best)
    return row.select("concept", "rel", "entity", F.col("best.member_class").alias("member_class"), (~F.col("best.deep")).alias("is_direct"))


def candidate_pairs(rules, axis, edges, membership, policy, subtree=None) -> DataFrame:
    """One row per (subject, object, rel, source, partner): direct first, then least class.

    What a concept reaches depends on (object, rel) alone, so members are reduced to one
    row per entity before rules meet them: pairs are made once and never grouped."""
    if subtree is None:
        subtree = closure(edges, rules.select(F.col("object").alias("root")))
    side = expanded_members(rules.select(F.col("object").alias("concept"), "rel"), axis, subtree, membership, policy)
    side = side.select(F.col("concept").alias("object"), "rel", F.col("entity").alias("partner"), "member_class", "is_direct")
    out = rules.select("subject", "object", "rel", "source").distinct().join(side, ["object", "rel"]).where("partner <> subject")
    return out.select("subject", "object", "rel", "source", "partner", "member_class", "is_direct")


def rule_reach(rules, axis, edges, membership, subtree=None) -> DataFrame:
    """Distinct partners of each rule over the subtree and directly, without the subject,
    counted without making pairs: members of a class once, less one where the subject is one.
    Members are found and moved once, marked where they are a subject, so they are counted in one pass."""
    if subtree is None:
        subtree = closure(edges, rules.select(F.col("object").alias("root")))
    wanted = rules.join(axis, "rel").select("object", "membership_axis").distinct()
    nodes = wanted.join(subtree.withColumnRenamed("root", "object"), "object")
    member = membership.select("entity", F.col("concept").alias("node"), F.col("axis").alias("membership_axis"))
    keys = ["object", "membership_axis"]
    reached = nodes.join(member, ["node", "membership_axis"]).select(*keys, "entity", (F.col("node") == F.col("object")).cast("int").alias("direct"), F.lit(False).alias("asked"))
    marks = rules.where("subject is not null").join(axis, "rel").select(*keys, F.col("subject").alias("entity"), F.lit(None).cast("int").alias("direct"), F.lit(True).alias("asked"))
    reached = reached.unionByName(marks).groupBy(*keys, "entity").agg(F.max("direct").alias("direct"), F.max("asked").alias("asked"))
    counts = [F.count("direct").alias("n"), F.sum("direct").alias("d")]
    counted = cut(reached.groupBy(*keys, F.when(F.col("asked"), F.col("entity")).alias("subject")).agg(*counts))
    total = counted.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    itself = counted.where("subject is not null").select(*keys, "subject", F.col("n").alias("self_n"), F.col("d").alias("self_d"))
    row = rules.join(axis, "rel").join(total, keys, "left").join(itself, [*keys, "subject"], "left")
    run = [c for c in ("run",) if c in rules.columns]
    return row.select("subject", "object", "rel", "source", *run, (F.coalesce("n", F.lit(0)) - F.coalesce("self_n", F.lit(0))).cast("long").alias("subtree_partner_count"), (F.coalesce("d", F.lit(0)) - F.coalesce("self_d", F.lit(0))).cast("long").alias("direct_partner_count"))


def rule_pairs(rules, axis, edges, membership, policy, reach=None) -> DataFrame:
    """How many partners :func:`candidate_pairs` has for each (subject, object, rel) that has any, as
    ``pairs``, without making them: of what :func:`rule_reach` counts (``reach``, if that is there already), partners
    over the subtree if the axis expands and no live decision denies it, else direct ones."""
    if reach is None:
        reach = rule_reach(rules, axis, edges, membership)
    decided = binding(policy).groupBy(F.col("concept").alias("object")).agg(F.bool_and(F.col("decision") == "deny").alias("denied"))
    rows = reach.select("subject", "object", "rel", "subtree_partner_count", "direct_partner_count").distinct()
    rows = rows.join(F.broadcast(axis.select("rel", "expands")), "rel").join(decided, "object", "left")
    deep = F.col("expands") & ~F.coalesce("denied", F.lit(False))
    pairs = F.when(deep, F.col("subtree_partner_count")).otherwise(F.col("direct_partner_count")).alias("pairs")
    return rows.select("subject", "object", "rel", pairs).where("pairs > 0")


def class_pair_reach(class_rules, axis, edges, membership, policy, subtree=None) -> DataFrame:
    """Per class rule: distinct members of both sides over the subtree and directly, those
    that the axis and live decisions leave, and ordered pairs without self pairs, |S|*|O|
    less the members that both sides share. Members are found once: direct ones, and with them
    those below where the axis and decisions let them count."""
    if subtree is None:
        subtree = closure(edges, class_rules.select(F.col("subject_class").alias("root")).union(class_rules.select("object_class")))
    named = class_rules.select(F.col("subject_class").alias("concept"), "rel").union(class_rules.select("object_class", "rel")).distinct()
    decided = binding(policy).groupBy("concept").agg(F.bool_and(F.col("decision") == "deny").alias("denied"))
    named = named.join(F.broadcast(axis), "rel").join(decided, "concept", "left")
    named = named.withColumn("deep", F.col("expands") & ~F.coalesce("denied", F.lit(False))).select("concept", "rel", "membership_axis", "deep")
    reach = named.join(subtree.withColumnRenamed("root", "concept"), "concept")
    member = membership.select("entity", F.col("concept").alias("node"), F.col("axis").alias("membership_axis"))
    reach = reach.join(member, ["node", "membership_axis"]).groupBy("concept", "rel", "entity", "deep")
    reach = cut(reach.agg(F.max((F.col("node") == F.col("concept")).cast("int")).alias("direct")))
    effective = F.col("deep") | (F.col("direct") == 1)
    total = reach.groupBy("concept", "rel").agg(F.count("*").alias("subtree"), F.sum("direct").alias("direct"), F.count_if(effective).alias("effective"))
    side = reach.where(effective)
    rules = class_rules.select("subject_class", "object_class", "rel", "source").distinct()
    ends = rules.select("subject_class", "object_class", "rel").distinct()
    both = ends.join(side.select(F.col("concept").alias("subject_class"), "rel", "entity"), ["subject_class", "rel"])
    both = both.join(side.select(F.col("concept").alias("object_class"), "rel", "entity"), ["object_class", "rel", "entity"])
    both = both.groupBy("subject_class", "object_class", "rel").agg(F.count("*").alias("shared_members"))
    out = rules.join(F.broadcast(axis.select("rel")), "rel")
    for end in ("subject", "object"):
        of = {c: F.col(c).alias(f"{end}_{c}") for c in ("subtree", "direct", "effective")}
        out = out.join(total.select(F.col("concept").alias(f"{end}_class"), "rel", *of.values()), [f"{end}_class", "rel"], "left")
    out = out.join(both, ["subject_class", "object_class", "rel"], "left").na.fill(0)
    pairs = (F.col("subject_effective") * F.col("object_effective") - F.col("shared_members")).alias("max_pair_count")
    counts = [f"{end}_{c}" for end in ("subject", "object") for c in ("subtree", "direct", "effective")]
    return out.select("subject_class", "object_class", "rel", "source", *counts, "shared_members", pairs)


def curated_pairs(pairs, rulings, class_rules, class_rulings, severity, axis, edges, membership, policy, subtree=None) -> DataFrame:
    """Graded pairs of both grains. Only live judgements that apply count. A severity without
    a rank has effective rank 0, which sorts above the most severe."""
    graded = ("severity", "evidence", "reviewed_at", "reviewed_by")
    judged = rulings.where("superseded_by is null and applies").select("subject", "object", "rel", *graded)
    one = pairs.join(judged, ["subject", "object", "rel"])
    one = one.select(
        "subject", "partner", "rel", F.col("source").alias("candidate_source"), F.lit(None).cast("long").alias("via_subject_class"),
        F.col("object").alias("via_class"), "member_class", *graded, F.lit("entity_rule").alias("grain"),
    )
    judged = class_rulings.where("superseded_by is null and applies").select("subject_class", "object_class", "rel", *graded)
    judged = class_rules.select("subject_class", "object_class", "rel", "source").distinct().join(judged, ["subject_class", "object_class", "rel"])
    if subtree is None:
        subtree = closure(edges, judged.select(F.col("subject_class").alias("root")).union(judged.select("object_class")))
    named = judged.select(F.col("subject_class").alias("concept"), "rel").union(judged.select("object_class", "rel"))
    side = expanded_members(named, axis, subtree, membership, policy)
    s = side.select(F.col("concept").alias("subject_class"), "rel", F.col("entity").alias("subject"))
    o = side.select(F.col("concept").alias("object_class"), "rel", F.col("entity").alias("partner"), "member_class")
    two = judged.join(s, ["subject_class", "rel"]).join(o, ["object_class", "rel"]).where("subject <> partner")
    two = two.select(
        "subject", "partner", "rel", F.col("source").alias("candidate_source"), F.col("subject_class").alias("via_subject_class"),
        F.col("object_class").alias("via_class"), "member_class", *graded, F.lit("class_rule").alias("grain"),
    )
    ranked = one.unionByName(two).join(F.broadcast(severity.select("severity", "rank")), "severity", "left")
    return ranked.withColumn("effective_rank", F.coalesce("rank", F.lit(0))).drop("rank")


def curated_grades(rules, rulings, class_rules, class_rulings, severity, axis, edges, membership, policy) -> DataFrame:
    """The rows of ``curated_pairs(candidate_pairs(...), ...)``, made once and never moved.

    Rules are judged before they meet members, so only graded pairs are made, and each carries what its rule
    has. Few classes make most pairs, so both sides of a class rule are cut into lists, and each list of
    subjects meets each of partners in some task, where rows are made: nothing but lists is copied."""
    graded = ["severity", "evidence", "reviewed_at", "reviewed_by"]
    live = "superseded_by is null and applies"
    parts = int(axis.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = ["subject", "via_subject_class", "via_class", "rel", F.col("source").alias("candidate_source"), *graded]
    keys = ["subject", "object", "rel"]
    one = rules.select(*keys, "source").distinct().join(rulings.where(live).select(*keys, *graded), keys)
    one = one.withColumns({"via_subject_class": F.lit(None).cast("long"), "via_class": F.col("object")}).select(*named, F.lit("entity_rule").alias("grain"))
    keys = ["subject_class", "object_class", "rel"]
    two = class_rules.select(*keys, "source").distinct().join(class_rulings.where(live).select(*keys, *graded), keys)
    two = two.withColumns({"subject": F.lit(None).cast("long"), "via_subject_class": F.col("subject_class"), "via_class": F.col("object_class")}).select(*named, F.lit("class_rule").alias("grain"))
    judged = one.unionByName(two).join(F.broadcast(severity.select("severity", "rank")), "severity", "left")
    judged = cut(judged.withColumn("effective_rank", F.coalesce("rank", F.lit(0))).drop("rank"))
    one, two = judged.where("grain = 'entity_rule'"), judged.where("grain = 'class_rule'")
    ends = judged.select(F.col("via_class").alias("concept"), "rel").union(two.select("via_subject_class", "rel")).distinct()
    side = cut(expanded_members(ends, axis, closure(edges, ends.select(F.col("concept").alias("root"))), membership, policy))
    columns = ["subject", "partner", "rel", "candidate_source", "via_subject_class", "via_class", "member_class", *graded, "grain", "effective_rank"]
    partners = side.select(F.col("concept").alias("via_class"), "rel", F.col("entity").alias("partner"), "member_class")
    # Numbers of partitions are named, as what goes in is small and would be put together in few tasks.
    on = ["via_class", "rel"]
    ones = one.repartition(parts, *on).join(partners.repartition(parts, *on), on)
    subjects = side.select(F.col("concept").alias("via_subject_class"), "rel", F.col("entity").alias("subject")).join(two.select("via_subject_class", "rel").distinct(), ["via_subject_class", "rel"], "left_semi")
    partners = partners.join(two.select(*on).distinct(), on, "left_semi")
    tiles = two.drop("subject").join(lists(subjects, ["via_subject_class", "rel"], ["subject"], "subjects", TILE // 4), ["via_subject_class", "rel"])
    tiles = tiles.join(lists(partners, on, ["partner", "member_class"], "partners", TILE), on)
    tiles = tiles.repartition(parts, "via_subject_class", "candidate_source", *on, "subjects_deal", "partners_deal")
    twos = tiles.withColumn("subject", F.explode("subjects.subject")).select("*", F.explode("partners").alias("with"))
    twos = twos.withColumns({"partner": F.col("with.partner"), "member_class": F.col("with.member_class")})
    return ones.select(*columns).unionByName(twos.select(*columns)).where("subject <> partner")


#: Subjects, and partners, of one tile of effective grades; and the entries of lists that a tile hands over at once.
TILE, ENTRIES = 4096, 262_144


def _winners(dealt: pa.Table, side: pa.Table) -> pa.Table:
    """``dealt(subject, number, via_class, ...)`` and ``side(via_class, partner, member_class)`` of one tile ->
    ``dealt`` without the subject, for each number that wins any pair, with lists of its subjects, and of its
    partners with their member classes: those that no lower number of the same subjects reaches.

    Subjects of the same numbers have the same lists, which are made once. A subject isn't taken from its partners."""
    number, subject, of = (dealt.column(c).to_numpy() for c in ("number", "subject", "via_class"))
    via, member = side.column("via_class").to_numpy(), side.column("member_class").to_numpy()
    partners, place = np.unique(side.column("partner").to_numpy(), return_inverse=True)
    order = np.lexsort((place, via))
    place, member = place[order], member[order]
    classes, first = np.unique(via[order], return_index=True)
    reached = {c: slice(a, b) for c, a, b in zip(classes.tolist(), first.tolist(), [*first[1:].tolist(), len(order)])}
    order = np.lexsort((number, subject))
    ends = [*(np.flatnonzero(np.diff(subject[order])) + 1).tolist(), len(order)]
    alike: dict[bytes, list[np.ndarray]] = {}
    for a, b in zip([0, *ends], ends):
        alike.setdefault(number[order[a:b]].tobytes(), []).append(order[a:b])
    schema = dealt.schema.remove(dealt.schema.get_field_index("subject"))
    for name, kind in (("subjects", dealt.schema.field("subject").type), ("partners", side.schema.field("partner").type), ("member_classes", side.schema.field("member_class").type)):
        schema = schema.append(pa.field(name, pa.list_(kind)))
    batches, held, entries = [], [], 0

    def hand_over():
        rows = dealt.take(pa.array([at for at, *_ in held], pa.int64())).drop_columns(["subject"]).combine_chunks()
        lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate(x), field.type.value_type)) for x, field in zip(list(zip(*held))[1:], list(schema)[-3:])]
        columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in rows.columns]
        batches.append(pa.RecordBatch.from_arrays([*columns, *lists], schema=schema))
        held.clear()

    for found in alike.values():
        subjects = subject[[x[0] for x in found]]
        free = np.ones(len(partners), bool)
        for at in found[0].tolist():
            here = reached.get(of[at])
            if here is None:
                continue
            new = free[place[here]]
            mine = place[here][new]
            if len(mine):
                free[mine] = False
                held.append((at, subjects, partners[mine], member[here][new]))
                entries += len(subjects) + len(mine)
        if entries > ENTRIES:
            hand_over()
            entries = 0
    if held:
        hand_over()
    return pa.Table.from_batches(batches, schema)


def _by_tiles(judged: DataFrame, both: DataFrame, side: DataFrame, grain) -> DataFrame:
    """``both(subject, via_class, rel, number)`` and ``side(via_class, rel, partner, member_class)`` -> the winner
    of each pair with the columns of ``judged``. What goes into tiles are rows of the two, copied where a
    tile has a subject and a partner of a class, and pairs are only made as they are returned."""
    both, side = both.where("subject is not null"), side.where("partner is not null")
    both = both.join(judged.drop("subject", "via_class"), ["rel", "number"])
    both = cut(both.withColumn("grain", grain).drop("grain_order", "rank"))
    parts = int(judged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = both.select("subject").union(side.select("partner")).distinct().count()
    across = max(ceil(many / TILE), ceil(parts**0.5))
    # Tiles are hashed to partitions, so there are more of these than tasks at once.
    parts = max(parts, min(4 * across * across, 4096))
    deal = lambda name: F.pmod(F.hash(name), F.lit(across))
    both, side = both.withColumn("i", deal("subject")), side.withColumn("j", deal("partner"))
    tile = (F.col("i") * across + F.col("j")).alias("tile")
    on = ["via_class", "rel"]
    left = both.join(side.select(*on, "j").distinct(), on).select("*", tile).drop("i", "j")
    right = side.join(both.select(*on, "i").distinct(), on).select(*on, "partner", "member_class", tile)
    to = lambda rows: rows.repartition(parts, "tile", "rel").groupBy("tile", "rel")
    kind = lambda rows, name: rows.schema[name].dataType.simpleString()
    schema = ", ".join([*(f"`{c}` {kind(left, c)}" for c in left.columns if c != "subject"), f"subjects array<{kind(left, 'subject')}>", f"partners array<{kind(right, 'partner')}>", f"member_classes array<{kind(right, 'member_class')}>"])
    lists = to(left).cogroup(to(right)).applyInArrow(_winners, schema)
    rows = lists.withColumn("subject", F.explode("subjects")).select("*", F.posexplode("partners").alias("at", "partner"))
    return rows.where("subject <> partner").withColumn("member_class", F.col("member_classes")[F.col("at")])


def _nulls_last(name: str):
    return F.struct(F.col(name).isNull().alias("none"), F.col(name).alias("value")).alias(name)


def effective_pairs(curated: DataFrame) -> DataFrame:
    """The most severe grade of each (subject, partner, rel); ties go to the entity grain, then
    by the rest. A grouped minimum of the whole row in that order, combined before the
    shuffle, so no partition of pairs is sorted."""
    keys = ["subject", "partner", "rel"]
    order = ["effective_rank", "grain_order", "candidate_source", "via_subject_class", "via_class", "member_class", "reviewed_at", "reviewed_by"]
    rest = [c for c in curated.columns if c not in (*keys, *order)]
    row = curated.withColumn("grain_order", (F.col("grain") != "entity_rule").cast("int"))
    best = row.groupBy(*keys).agg(F.min(F.struct(*[_nulls_last(c) for c in (*order, *rest)])).alias("best"))
    return best.select(*keys, *[F.col(f"best.{c}.value").alias(c) for c in curated.columns if c not in keys])


def effective_grades(rules, rulings, class_rules, class_rulings, severity, axis, edges, membership, policy, asked=None) -> DataFrame:
    """The rows of ``effective_pairs(curated_pairs(...))``, by a minimum of numbers; of subjects,
    or pairs, in ``asked(subject[, partner])`` only, if that is given: no others are made.

    Which grade wins depends on the judged rules alone: the partner's member class is the same
    for all rows of a rule and a pair. So the judged rules, few beside their pairs, are
    numbered in the order of precedence. Subjects and partners are dealt to tiles, each of which
    finds what every number wins as lists, so pairs are made once and never moved. Of asked ones,
    pairs carry numbers only, their least is a hash aggregate, and what the number stands for is
    joined to the winners."""
    graded = ["severity", "evidence", "reviewed_at", "reviewed_by"]
    one = rules.select("subject", "object", "rel", "source").distinct().join(rulings.where("superseded_by is null and applies").select("subject", "object", "rel", *graded), ["subject", "object", "rel"])
    none = F.lit(None).cast("long")
    one = one.select(F.lit(0).alias("grain_order"), "subject", none.alias("via_subject_class"), F.col("object").alias("via_class"), "rel", F.col("source").alias("candidate_source"), *graded)
    two = class_rules.select("subject_class", "object_class", "rel", "source").distinct()
    two = two.join(class_rulings.where("superseded_by is null and applies").select("subject_class", "object_class", "rel", *graded), ["subject_class", "object_class", "rel"])
    two = two.select(F.lit(1).alias("grain_order"), none.alias("subject"), F.col("subject_class").alias("via_subject_class"), F.col("object_class").alias("via_class"), "rel", F.col("source").alias("candidate_source"), *graded)
    judged = one.unionByName(two).join(F.broadcast(severity.select("severity", "rank")), "severity", "left")
    judged = judged.withColumn("effective_rank", F.coalesce("rank", F.lit(0))).drop("rank")
    last = lambda c: F.struct(F.col(c).isNull(), F.col(c))
    order = ["effective_rank", "grain_order", *map(last, ("candidate_source", "via_subject_class", "via_class", "reviewed_at", "reviewed_by", "evidence"))]
    # Numbers within a relation, as a pair's rows have one: each relation is a window of its rules.
    judged = cut(judged.withColumn("number", F.row_number().over(W.partitionBy("rel").orderBy(*order, "subject"))))
    ends = judged.select(F.col("via_class").alias("concept"), "rel").union(judged.where("grain_order = 1").select("via_subject_class", "rel")).distinct()
    subtree = closure(edges, ends.select(F.col("concept").alias("root")))
    side = cut(expanded_members(ends, axis, subtree, membership, policy))
    of = lambda end, name: side.select(F.col("concept").alias(end), "rel", F.col("entity").alias(name))
    first = judged.where("grain_order = 0").select("subject", "via_class", "rel", "number").groupBy("subject", "via_class", "rel").agg(F.min("number").alias("number"))
    # A subject in several subject classes of one object class is one row, of the least number.
    second = judged.where("grain_order = 1").select("number", "via_subject_class", "via_class", "rel").join(of("via_subject_class", "subject"), ["via_subject_class", "rel"])
    second = second.groupBy("subject", "via_class", "rel").agg(F.min("number").alias("number"))
    # Of both grains a subject keeps its least number for an object class: the partners are the same.
    both = first.unionByName(second).groupBy("subject", "via_class", "rel").agg(F.min("number").alias("number"))
    grain = F.when(F.col("grain_order") == 0, "entity_rule").otherwise("class_rule").alias("grain")
    columns = ["subject", "partner", "rel", "candidate_source", "via_subject_class", "via_class", "member_class", *graded, "grain", "effective_rank"]
    partners = side.select(F.col("concept").alias("via_class"), "rel", F.col("entity").alias("partner"), "member_class")
    if asked is None:
        return _by_tiles(judged, both, partners, grain).select(*columns)
    both = both.join(asked.distinct(), "subject")
    pairs = both.join(of("via_class", "partner"), ["via_class", "rel", *[c for c in asked.columns if c != "subject"]]).where("subject <> partner")
    best = pairs.groupBy("subject", "partner", "rel").agg(F.min("number").alias("number"))
    rows = best.join(judged.drop("subject"), ["rel", "number"])
    rows = rows.join(partners, ["via_class", "rel", "partner"])
    return rows.withColumn("grain", grain).select(*columns)


def disagreements(curated: DataFrame) -> DataFrame:
    """Pairs, in either order, that the two grains grade differently, by both rules and grades."""
    unordered = (F.least("subject", "partner").alias("lo"), F.greatest("subject", "partner").alias("hi"), "rel")
    a = curated.where("grain = 'entity_rule'").select(
        *unordered, F.col("subject").alias("rule_subject"), "partner", F.col("via_class").alias("rule_object"),
        F.col("severity").alias("entity_severity"), F.col("evidence").alias("entity_evidence"),
    )
    b = curated.where("grain = 'class_rule'").select(
        *unordered, F.col("via_subject_class").alias("class_subject"), F.col("via_class").alias("class_object"),
        F.col("severity").alias("class_severity"), F.col("evidence").alias("class_evidence"),
    )
    differ = "not (entity_severity <=> class_severity and entity_evidence <=> class_evidence)"
    both = a.distinct().join(b.distinct(), ["lo", "hi", "rel"]).where(differ)
    by = ["rule_subject", "rule_object", "rel", "class_subject", "class_object", "entity_severity", "class_severity", "entity_evidence", "class_evidence"]
    return both.groupBy(*by).agg(F.countDistinct("partner").alias("partners"))


def disagreement_counts(rules, rulings, class_rules, class_rulings, axis, edges, membership, policy) -> DataFrame:
    """The rows of ``disagreements(curated_pairs(...))``, counted without making pairs.

    A rule's pairs are its subject with what its object reaches, and a class rule's pairs in either
    order are those of its sides. Where the subject is on one side, partners that both grade are what the
    object and the other side share; on both sides, what the object shares with either; less the
    subject itself. These numbers depend on the object and the sides alone."""
    graded = ["severity", "evidence"]
    live = "superseded_by is null and applies"
    grades = lambda r, *keys: r.where(live).select(*keys, *graded)
    one = rules.select("subject", "object", "rel").distinct().join(grades(rulings, "subject", "object", "rel"), ["subject", "object", "rel"])
    one = cut(one.select(F.col("subject").alias("rule_subject"), F.col("object").alias("rule_object"), "rel", *[F.col(c).alias(f"entity_{c}") for c in graded]).distinct())
    keys = ["subject_class", "object_class", "rel"]
    two = class_rules.select(*keys).distinct().join(grades(class_rulings, *keys), keys)
    two = cut(two.select(F.col("subject_class").alias("class_subject"), F.col("object_class").alias("class_object"), "rel", *[F.col(c).alias(f"class_{c}") for c in graded]).distinct())
    ends = one.select(F.col("rule_object").alias("concept"), "rel").union(two.select("class_subject", "rel")).union(two.select("class_object", "rel")).distinct()
    side = cut(expanded_members(ends, axis, closure(edges, ends.select(F.col("concept").alias("root"))), membership, policy).select("concept", "rel", "entity"))
    # Each entity of a class rule, and on which of its sides it is.
    classes = two.select("class_subject", "class_object", "rel").distinct()
    on = lambda end: classes.join(side.select(F.col("concept").alias(end), "rel", "entity"), [end, "rel"]).select("class_subject", "class_object", "rel", "entity", F.lit(end == "class_subject").alias("s"), F.lit(end == "class_object").alias("o"))
    sides = cut(on("class_subject").unionByName(on("class_object")).groupBy("class_subject", "class_object", "rel", "entity").agg(F.max("s").alias("s"), F.max("o").alias("o")))
    reached = one.select(F.col("rule_object"), "rel").distinct().join(side.withColumnRenamed("concept", "rule_object"), ["rule_object", "rel"])
    shared = reached.join(sides, ["rel", "entity"]).groupBy("rule_object", "class_subject", "class_object", "rel")
    shared = shared.agg(F.count("*").alias("either"), F.count_if("s").alias("on_s"), F.count_if("o").alias("on_o"))
    itself = side.select(F.col("concept").alias("rule_object"), "rel", F.col("entity").alias("rule_subject"), F.lit(1).alias("itself"))
    rows = one.join(itself, ["rule_object", "rel", "rule_subject"], "left").join(sides.withColumnRenamed("entity", "rule_subject"), ["rel", "rule_subject"])
    rows = rows.join(shared, ["rule_object", "class_subject", "class_object", "rel"]).join(F.broadcast(two), ["class_subject", "class_object", "rel"])
    rows = rows.where("not (entity_severity <=> class_severity and entity_evidence <=> class_evidence)")
    # The subject is among what it is counted with if the object reaches it and it is on the side that is counted.
    counted = F.when(F.col("s") & F.col("o"), F.col("either") - F.coalesce("itself", F.lit(0))).when(F.col("s"), F.col("on_o")).otherwise(F.col("on_s"))
    by = ["rule_subject", "rule_object", "rel", "class_subject", "class_object", "entity_severity", "class_severity", "entity_evidence", "class_evidence"]
    return rows.select(*by, counted.alias("partners")).where("partners > 0")


def unrankable(rulings, class_rulings, severity) -> DataFrame:
    """Live judgements that apply and whose severity has no rank: (target, id, severity, reviewed_by)."""
    rows = [r.where("superseded_by is null and applies").select(F.lit(t).alias("target"), "id", "severity", "reviewed_by") for t, r in (("ruling", rulings), ("class_ruling", class_rulings))]
    ranked = F.broadcast(severity.where("rank is not null").select("severity"))
    return rows[0].unionByName(rows[1]).join(ranked, "severity", "left_anti").select("target", "id", "severity", "reviewed_by")


def unresolved_targets(rulings, rules, class_rulings, class_rules, cond_rulings, cond_rules, indications) -> DataFrame:
    """Live judgements that no rule matches any more, of three kinds, as strings:
    (target, subject, object, rel)."""
    live = "superseded_by is null"
    one = rulings.where(live).join(rules, ["subject", "object", "rel"], "left_anti").select(F.lit("ruling").alias("target"), "subject", "object", "rel")
    two = cond_rulings.where(live)
    for known in (cond_rules, indications):
        two = two.join(known, ["subject", "condition"], "left_anti")
    two = two.select(F.lit("cond_ruling").alias("target"), "subject", F.col("condition").alias("object"), F.lit(None).cast("string").alias("rel"))
    keys = ["subject_class", "object_class", "rel"]
    three = class_rulings.where(live).join(class_rules, keys, "left_anti")
    three = three.select(F.lit("class_ruling").alias("target"), F.col("subject_class").alias("subject"), F.col("object_class").alias("object"), "rel")
    return reduce(DataFrame.unionByName, [t.select("target", F.col("subject").cast("string"), F.col("object").cast("string"), "rel") for t in (one, two, three)])


def promoted(grades, subtree, membership) -> DataFrame:
    """Members (by any axis) under the contributors of live grades: (id, effect, entity, magnitude)."""
    live = grades.where("superseded_by is null").select("id", "effect", "contributor", "magnitude")
    member = membership.select(F.col("concept").alias("node"), "entity")
    rows = live.join(subtree, F.col("contributor") == F.col("root")).join(member, "node")
    return rows.select("id", "effect", "entity", "magnitude").distinct()


def effect_roots(effects, grades) -> DataFrame:
    return effects.select(F.col("effect").alias("root")).union(grades.select("contributor")).distinct()


def contributors(effects, grades, edges, membership, subtree=None) -> DataFrame:
    """Members (by any axis) of live accumulating effects; major if any live grade of theirs is."""
    if subtree is None:
        subtree = closure(edges, effect_roots(effects, grades))
    live = effects.where("superseded_by is null and accumulates").select("effect").distinct()
    member = membership.select(F.col("concept").alias("node"), "entity")
    base = live.join(subtree, F.col("effect") == F.col("root")).join(member, "node").select("effect", "entity").distinct()
    major = promoted(grades.where("magnitude = 'major'"), subtree, membership).select("effect", "entity").distinct()
    out = base.join(major.withColumn("major", F.lit(True)), ["effect", "entity"], "left")
    return out.select("effect", "entity", F.when(F.col("major"), "major").otherwise("minor").alias("magnitude"))


def group_members(members, edges, membership) -> DataFrame:
    """Entities under each live group member that satisfies its role: (grp, role, entity, via).
    Deliberately a row for each concept that reaches an entity."""
    live = members.where("superseded_by is null and satisfies").select("grp", "role", F.col("concept").alias("via")).distinct()
    subtree = closure(edges, live.select(F.col("via").alias("root")))
    member = membership.select(F.col("concept").alias("node"), "entity").distinct()
    return live.join(subtree, F.col("via") == F.col("root")).join(member, "node").select("grp", "role", "entity", "via").distinct()


def effect_counts(contributions, regimen) -> DataFrame:
    """``regimen(regimen, entity)``: per effect and regimen, majors and contributors in it."""
    rows = contributions.join(regimen.distinct(), "entity")
    majors = F.sum(F.when(F.col("magnitude") == "major", 1).otherwise(0)).alias("majors")
    return rows.groupBy("effect", "regimen").agg(majors, F.count("*").alias("total"))


def fires(majors, total, t_major, t_total):
    """Whether a regimen reaches both thresholds; impossible counts raise."""
    bad = (majors < 0) | (total < majors)
    return F.when(bad, F.raise_error(F.lit("impossible counts"))).otherwise((majors >= t_major) & (total >= t_total))


def group_fires(required, covered):
    """Whether there are required roles and all are covered."""
    return (F.size(required) > 0) & (F.size(F.array_except(required, covered)) == 0)


def class_grain_status(reach, class_rulings) -> DataFrame:
    """One row about class rules: how many, how many make no pair, and how many make one and
    have no live judgement. ``reach`` as :func:`class_pair_reach`; sources of a rule count once."""
    keys = ["subject_class", "object_class", "rel"]
    rows = reach.groupBy(*keys).agg(F.max("max_pair_count").alias("pairs"))
    live = class_rulings.where("superseded_by is null").select(*keys).distinct().withColumn("judged", F.lit(True))
    rows = rows.join(live, keys, "left")
    ungraded = F.count_if((F.col("pairs") > 0) & F.col("judged").isNull())
    return rows.agg(F.count("*").alias("rules"), F.count_if(F.col("pairs") == 0).alias("dead"), ungraded.alias("ungraded"))


def live_judgements(rulings) -> DataFrame:
    """The graded columns of live judgements by their natural key."""
    return rulings.where("superseded_by is null").select("subject", "object", "rel", "applies", "severity", "evidence")

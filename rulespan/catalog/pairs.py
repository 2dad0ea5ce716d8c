"""Closures of the concept hierarchy, candidate and curated pairs, reach, accumulation."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulespan.catalog.base import BINDING, CLASS_ROOTS, RULE_ROOTS, query, rel, walk
from rulespan.operators import core, review, rules

ALL_ROOTS = "select p_partkey as root from {part}"


def _roots(df, *columns):
    out = df.select(F.col(columns[0]).alias("root"))
    for c in columns[1:]:
        out = out.union(df.select(c))
    return out


@query("closure_down", f"with recursive {walk(RULE_ROOTS)} select root, node from tree")
def _(spark, d):
    edge, rule = rel(spark, d, "edge", "rule")
    return core.closure(edge, _roots(rule, "object"))


@query("closure_pair_roots", f"with recursive {walk(CLASS_ROOTS)} select root, node from tree")
def _(spark, d):
    edge, rule = rel(spark, d, "edge", "class_rule")
    return core.closure(edge, _roots(rule, "subject_class", "object_class"))


@query("closure_full", f"with recursive {walk(ALL_ROOTS)} select root, node from tree")
def _(spark, d):
    edge, part = rel(spark, d, "edge", "part")
    return core.closure(edge, _roots(part, "p_partkey"))


@query("closure_up", f"with recursive {walk(ALL_ROOTS, up=True)} select root, node from tree")
def _(spark, d):
    edge, part = rel(spark, d, "edge", "part")
    return core.closure(edge, _roots(part, "p_partkey"), up=True)


# What a rule reaches: members of its object, and of concepts below if the axis expands and nothing denies it.
PAIRS = f"""{walk(RULE_ROOTS)}, {BINDING}, candidates as (
  select r.subject, r.object, r.rel, r.source, m.entity as partner, m.concept as member_class,
    case when m.concept = r.object then 0 else 1 end as depth
  from {{rule}} r join {{axis}} a on a.rel = r.rel join tree t on t.root = r.object
  join {{membership}} m on m.concept = t.node and m.axis = a.membership_axis
  where m.entity <> r.subject and (m.concept = r.object or (a.expands and r.object not in
    (select concept from binding where decision = 'deny')))),
pairs as (select subject, object, rel, source, partner, depth = 0 as is_direct, member_class from (
  select *, row_number() over (partition by subject, object, rel, source, partner order by depth, member_class) as n
  from candidates) as c where n = 1)"""


def candidate_pairs(spark, d):
    return rules.candidate_pairs(*rel(spark, d, "rule", "axis", "edge", "membership", "policy"))


query("candidate_pairs", f"with recursive {PAIRS} select * from pairs")(candidate_pairs)

REACH = f"""{walk(RULE_ROOTS)}, reached as (
  select r.subject, r.object, r.rel, r.source, r.run, m.entity, max(case when m.concept = r.object then 1 else 0 end) as direct
  from {{rule}} r join {{axis}} a on a.rel = r.rel join tree t on t.root = r.object
  join {{membership}} m on m.concept = t.node and m.axis = a.membership_axis and m.entity <> r.subject group by all),
reach as (select r.subject, r.object, r.rel, r.source, r.run, count(x.entity) as subtree_partner_count,
    cast(coalesce(sum(x.direct), 0) as bigint) as direct_partner_count
  from {{rule}} r left join reached x on x.subject = r.subject and x.object = r.object and x.rel = r.rel and x.source = r.source
    and x.run = r.run group by r.subject, r.object, r.rel, r.source, r.run)"""


def rule_reach(spark, d):
    return rules.rule_reach(*rel(spark, d, "rule", "axis", "edge", "membership"))


query("rule_reach", f"with recursive {REACH} select * from reach")(rule_reach)

# Members of a class on one side of class rules, in full, directly, and as far as decisions leave them.
SIDE = f"""{walk(CLASS_ROOTS, "class_tree")}, class_binding as (select concept, decision from {{policy}}
  where superseded_by is null and decision in ('deny', 'allow')),
named as (select subject_class as concept, rel from {{class_rule}} union select object_class as concept, rel from {{class_rule}}),
side_all as (
  select n.concept, n.rel, m.entity, min(case when m.concept = n.concept then 0 else 1 end) as depth,
    min(case when m.concept = n.concept then m.concept end) as own, min(m.concept) as least,
    bool_or(a.expands and coalesce(b.decision, 'allow') <> 'deny') as deep
  from named n join {{axis}} a on a.rel = n.rel join class_tree t on t.root = n.concept
  join {{membership}} m on m.concept = t.node and m.axis = a.membership_axis
  left join class_binding b on b.concept = n.concept group by n.concept, n.rel, m.entity),
side as (select concept, rel, entity, coalesce(own, least) as member_class from side_all where depth = 0 or deep)"""

CLASS_SIZES = """sizes as (
  select concept, rel, count(*) as subtree, count(*) filter (where depth = 0) as direct,
    count(*) filter (where depth = 0 or deep) as effective from side_all group by concept, rel),
class_reach as (
  select r.subject_class, r.object_class, r.rel, r.source,
    coalesce(s.subtree, 0) as subject_subtree, coalesce(s.direct, 0) as subject_direct, coalesce(s.effective, 0) as subject_effective,
    coalesce(o.subtree, 0) as object_subtree, coalesce(o.direct, 0) as object_direct, coalesce(o.effective, 0) as object_effective,
    (select count(*) from side x join side y on y.entity = x.entity and y.rel = x.rel
      where x.concept = r.subject_class and y.concept = r.object_class and x.rel = r.rel) as shared_members
  from (select distinct subject_class, object_class, rel, source from {class_rule}) r
  left join sizes s on s.concept = r.subject_class and s.rel = r.rel
  left join sizes o on o.concept = r.object_class and o.rel = r.rel)"""
CLASS_REACH = f"{SIDE}, {CLASS_SIZES}"


def class_pair_reach(spark, d, held=None):
    class_rule, axis, edge, membership, policy = rel(spark, d, "class_rule", "axis", "edge", "membership", "policy")
    return rules.class_pair_reach(class_rule, axis, edge, held["membership"] if held else membership, policy, held["subtree"] if held else None)


query(
    "class_pair_reach",
    f"with recursive {CLASS_REACH} select *, subject_effective * object_effective - shared_members as max_pair_count from class_reach",
)(class_pair_reach)

# Curated grains.
CURATED = f"""{PAIRS}, {SIDE}, graded as (
  select p.subject, p.partner, p.rel, p.source as candidate_source, cast(null as bigint) as via_subject_class, p.object as via_class,
    p.member_class, u.severity, u.evidence, u.reviewed_at, u.reviewed_by, 'entity_rule' as grain
  from pairs p join {{ruling}} u on u.subject = p.subject and u.object = p.object and u.rel = p.rel
  where u.applies and u.superseded_by is null
  union all
  select s.entity as subject, o.entity as partner, u.rel, c.source as candidate_source, u.subject_class as via_subject_class,
    u.object_class as via_class, o.member_class, u.severity, u.evidence, u.reviewed_at, u.reviewed_by, 'class_rule' as grain
  from {{class_ruling}} u join (select distinct subject_class, object_class, rel, source from {{class_rule}}) c
    on c.subject_class = u.subject_class and c.object_class = u.object_class and c.rel = u.rel
  join side s on s.concept = u.subject_class and s.rel = u.rel join side o on o.concept = u.object_class and o.rel = u.rel
  where u.applies and u.superseded_by is null and s.entity <> o.entity),
curated as (select g.*, coalesce((select v.rank from {{severity}} v where v.severity = g.severity), 0) as effective_rank from graded g)"""
BEST = """best as (select * exclude (n) from (select *, row_number() over (partition by subject, partner, rel
  order by effective_rank, case grain when 'entity_rule' then 0 else 1 end, candidate_source nulls last, via_subject_class nulls last,
    via_class nulls last, member_class nulls last, reviewed_at nulls last, reviewed_by nulls last) as n from curated) as c where n = 1)"""


def curated_pairs(spark, d):
    return rules.curated_grades(*rel(spark, d, "rule", "ruling", "class_rule", "class_ruling", "severity", "axis", "edge", "membership", "policy"))


def effective_pairs(spark, d, asked=None):
    rule, ruling, crule, cruling, severity, axis, edge, membership, policy = rel(spark, d, "rule", "ruling", "class_rule", "class_ruling", "severity", "axis", "edge", "membership", "policy")
    return rules.effective_grades(rule, ruling, crule, cruling, severity, axis, edge, membership, policy, asked)


query("curated_pairs", f"with recursive {CURATED} select * from curated")(curated_pairs)
query("effective_pairs", f"with recursive {CURATED}, {BEST} select * from best")(effective_pairs)


@query("disagreement", f"""with recursive {CURATED}
  select m.subject as rule_subject, m.via_class as rule_object, m.rel, c.via_subject_class as class_subject, c.via_class as class_object,
    m.severity as entity_severity, c.severity as class_severity, m.evidence as entity_evidence, c.evidence as class_evidence,
    count(distinct m.partner) as partners
  from curated m join curated c on m.rel = c.rel and m.grain = 'entity_rule' and c.grain = 'class_rule'
    and ((m.subject = c.subject and m.partner = c.partner) or (m.subject = c.partner and m.partner = c.subject))
  where m.severity is distinct from c.severity or m.evidence is distinct from c.evidence group by all""")
def _(spark, d):
    return rules.disagreement_counts(*rel(spark, d, "rule", "ruling", "class_rule", "class_ruling", "axis", "edge", "membership", "policy"))


@query("pair_lookup", f"""with recursive {CURATED}, {BEST}, asked as (
    select distinct s_suppkey as a, cast(s_suppkey + s_nationkey - 3 as bigint) as b from {{supplier}}),
  ways as (select a, b, a as subject, b as partner, 'forward' as direction from asked
    union all select a, b, b as subject, a as partner, 'backward' as direction from asked),
  graded_ways as (select w.a, w.b, 'graded' as answer, w.direction, x.rel, x.severity, x.evidence, x.effective_rank
    from ways w join best x on x.subject = w.subject and x.partner = w.partner)
  select * from graded_ways union all
  select a, b, case when b not in (select entity from {{entity}}) then 'unknown_entity' when a = b then 'same_entity' else 'no_rule' end as answer,
    cast(null as varchar) as direction, cast(null as varchar) as rel, cast(null as varchar) as severity, cast(null as varchar) as evidence,
    cast(null as int) as effective_rank
  from asked k where not exists (select 1 from graded_ways g where g.a = k.a and g.b = k.b)""")
def _(spark, d):
    supplier, entity = rel(spark, d, "supplier", "entity")
    asked = supplier.select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + F.col("s_nationkey") - 3).cast("long").alias("b"))
    ways = asked.select(F.col("a").alias("subject"), F.col("b").alias("partner"))
    return review.lookup(effective_pairs(spark, d, ways.union(asked.select("b", "a"))), asked, entity)


@query("unrankable", """select * from (
    select 'ruling' as target, id, severity, reviewed_by from {ruling} where superseded_by is null and applies
    union all select 'class_ruling' as target, id, severity, reviewed_by from {class_ruling} where superseded_by is null and applies) as u
  where severity is null or severity not in (select severity from {severity} where rank is not null)""")
def _(spark, d):
    return rules.unrankable(*rel(spark, d, "ruling", "class_ruling", "severity"))


@query("unresolved_targets", """
  select 'ruling' as target, cast(u.subject as varchar) as subject, cast(u.object as varchar) as object, u.rel from {ruling} u
  left join (select distinct subject, object, rel, 1 as here from {rule}) r on r.subject = u.subject and r.object = u.object and r.rel = u.rel
  where u.superseded_by is null and r.here is null
  union all
  select 'cond_ruling' as target, cast(u.subject as varchar) as subject, u.condition as object, null as rel from {cond_ruling} u
  where u.superseded_by is null and (u.subject, u.condition) not in (select (subject, condition) from {cond_rule}
    union select (subject, condition) from {indication})
  union all
  select 'class_ruling' as target, cast(u.subject_class as varchar) as subject, cast(u.object_class as varchar) as object, u.rel
  from {class_ruling} u where u.superseded_by is null
    and (u.subject_class, u.object_class, u.rel) not in (select (subject_class, object_class, rel) from {class_rule})""")
def _(spark, d):
    return rules.unresolved_targets(*rel(spark, d, "ruling", "rule", "class_ruling", "class_rule", "cond_ruling", "cond_rule", "indication"))


@query("policy_current", "select concept, decision from {policy} where superseded_by is null and decision <> 'withdrawn'")
def _(spark, d):
    return rules.binding(*rel(spark, d, "policy"))


@query("policy_unresolved", f"with {BINDING} select concept, decision from binding where concept not in (select concept from {{concept}})")
def _(spark, d):
    policy, concept = rel(spark, d, "policy", "concept")
    return rules.binding(policy).join(concept, "concept", "left_anti")


@query("class_grain_status", f"""with recursive {CURATED}, {CLASS_SIZES}
  select (select count(*) from (select distinct subject_class, object_class, rel from {{class_rule}})) as rules,
    (select count(*) from (select subject_class, object_class, rel from class_reach group by all
      having max(subject_effective * object_effective - shared_members) = 0)) as dead,
    (select count(*) from (select subject_class, object_class, rel from class_reach group by all
      having max(subject_effective * object_effective - shared_members) > 0) k where not exists (select 1 from {{class_ruling}} u
      where u.superseded_by is null and u.subject_class = k.subject_class and u.object_class = k.object_class and u.rel = k.rel)) as ungraded""")
def _(spark, d):
    return rules.class_grain_status(class_pair_reach(spark, d), *rel(spark, d, "class_ruling"))


# Accumulation.
EFFECT_ROOTS = "select effect as root from {effect} union select contributor as root from {grade}"
CONTRIB = f"""{walk(EFFECT_ROOTS, "effect_tree")}, held as (
  select distinct t.root, m.entity from effect_tree t join {{membership}} m on m.concept = t.node),
promoted as (select distinct g.id, g.effect, h.entity, g.magnitude from {{grade}} g join held h on h.root = g.contributor
  where g.superseded_by is null),
contrib as (select e.effect, h.entity, case when exists (select 1 from promoted p where p.effect = e.effect and p.entity = h.entity
    and p.magnitude = 'major') then 'major' else 'minor' end as magnitude
  from (select distinct effect from {{effect}} where superseded_by is null and accumulates) e join held h on h.root = e.effect)"""


def contributors(spark, d):
    return rules.contributors(*rel(spark, d, "effect", "grade", "edge", "membership"))


query("contributors", f"with recursive {CONTRIB} select effect, entity, magnitude from contrib")(contributors)


@query("effect_fires", f"""with recursive {CONTRIB}, counts as (
    select effect, count(*) filter (where magnitude = 'major') as majors, count(*) as total from contrib group by effect)
  select c.effect, c.majors, c.total, c.majors >= e.t_major and c.total >= e.t_total as fires
  from counts c join {{effect}} e on e.effect = c.effect""")
def _(spark, d):
    majors = F.count_if(F.col("magnitude") == "major").alias("majors")
    counts = contributors(spark, d).groupBy("effect").agg(majors, F.count("*").alias("total"))
    fires = rules.fires(F.col("majors"), F.col("total"), F.col("t_major"), F.col("t_total"))
    return counts.join(rel(spark, d, "effect")[0], "effect").select("effect", "majors", "total", fires.alias("fires"))


@query("effect_counts", f"""with recursive {CONTRIB} select c.effect, n.o_custkey as regimen,
    count(*) filter (where c.magnitude = 'major') as majors, count(*) as total
  from contrib c join (select distinct o_custkey, l_suppkey from {{orders}} join {{lineitem}} on l_orderkey = o_orderkey) n
    on n.l_suppkey = c.entity group by all""")
def _(spark, d):
    orders, lineitem = rel(spark, d, "orders", "lineitem")
    regimen = orders.join(lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("regimen"), F.col("l_suppkey").alias("entity"))
    return rules.effect_counts(contributors(spark, d), regimen)


@query("group_members", f"""with recursive {walk("select concept as root from {group_member} where superseded_by is null and satisfies")}
  select distinct g.grp, g.role, m.entity, g.concept as via from {{group_member}} g join tree t on t.root = g.concept
  join {{membership}} m on m.concept = t.node where g.superseded_by is null and g.satisfies""")
def _(spark, d):
    return rules.group_members(*rel(spark, d, "group_member", "edge", "membership"))


@query("group_fires", """select composite, count(*) as roles, min(case when is_active then 1 else 0 end) = 1 as fires
  from {composition} group by composite""")
def _(spark, d):
    (c,) = rel(spark, d, "composition")
    g = c.groupBy("composite").agg(F.collect_set("component").alias("required"), F.collect_set(F.when(F.col("is_active"), F.col("component"))).alias("covered"))
    return g.select("composite", F.size("required").cast("long").alias("roles"), rules.group_fires(F.col("required"), F.col("covered")).alias("fires"))

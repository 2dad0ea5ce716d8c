"""The kinds of gaps, the register of questions, and the worklist."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from rulespan.catalog.base import BINDING, CLASS_ROOTS, QUERIES, RULE_ROOTS, query, rel, uuid_sql, walk
from rulespan.catalog.conditions import IND_REACH, indication_reach
from rulespan.catalog.pairs import CLASS_REACH, CONTRIB, PAIRS, REACH, class_pair_reach, rule_reach
from rulespan.operators import core, gaps, review, rules
from rulespan.plans.steps import cut

#: The release of a row's run.
RELEASE = "(select release from {{run}} where run_id = {0}.run)"
SQLS: dict[str, str] = {}


def gap(name: str, sql: str):
    SQLS[name] = sql
    return query(f"gap_{name}", sql)


def _subtree(spark, d, *more):
    """Closure of every concept that a gap may ask about."""
    effect, grade, edge = rel(spark, d, "effect", "grade", "edge")
    return core.closure(edge, reduce(lambda a, b: a.union(b), [rules.effect_roots(effect, grade), *more]))


def _held(s, d):
    """What several kinds of gaps read, each written once: the closure of every concept that any of them
    asks about, what belongs to concepts, and what rules reach."""
    rule, crule, grade, concept, axis, membership = rel(s, d, "rule", "class_rule", "grade", "concept", "axis", "membership")
    roots = [rule.select("object"), crule.select("subject_class"), crule.select("object_class"), grade.select("effect"), concept.where("concept_type = 'PE'").select("concept")]
    held = {"subtree": cut(_subtree(s, d, *roots)), "membership": cut(membership.select("entity", "concept", "axis"))}
    return held | {"reach": cut(rules.rule_reach(rule, axis, None, held["membership"], held["subtree"]))}


def _members(s, d, held):
    return held["membership"] if held else rel(s, d, "membership")[0]


def _reach(s, d, held):
    return held["reach"] if held else rule_reach(s, d)


@gap("unclassified_entity", "select e.entity, e.name from {entity} e left join {membership} m on m.entity = e.entity and m.axis = 'R' where m.entity is null")
def _(s, d, held=None):
    return gaps.unclassified(*rel(s, d, "entity"), _members(s, d, held), "R")


@gap("unpopulated_rule", f"""with recursive {REACH}
  select c.concept, c.name, c.concept_type, count(*) as rules, max(u.release) as release
  from (select * from reach where subtree_partner_count = 0) x join {{concept}} c on c.concept = x.object
  join {{run}} u on u.run_id = x.run group by c.concept, c.name, c.concept_type""")
def _(s, d, held=None):
    return gaps.unpopulated(_reach(s, d, held), *rel(s, d, "concept", "run"))


@gap("unmatched_ingredient", """with live as (select value from {claim} where scheme = 'RXNORM_IN' and superseded_by is null),
  ordered as (select u.*, r.release, row_number() over (partition by u.rxcui
      order by u.run desc, case when u.name is null then 1 else 0 end, u.reason, u.name) as n
    from {unmatched} u join {run} r on r.run_id = u.run left join live l on l.value = u.rxcui where l.value is null)
  select rxcui, name, release from ordered where n = 1""")
def _(s, d, held=None):
    return gaps.unmatched_names(*rel(s, d, "unmatched", "claim", "run"))


@gap("unreviewed_root", f"""with recursive {walk(RULE_ROOTS + ' union ' + CLASS_ROOTS)}, {BINDING}, naming as (
    select object as concept, rel, run from {{rule}} union all select subject_class, rel, run from {{class_rule}}
    union all select object_class, rel, run from {{class_rule}} where object_class <> subject_class),
  sized as (select root, count(*) - 1 as descendants from tree group by root)
  select c.concept, c.name, c.concept_type, z.descendants, count(*) as rules, max(r.release) as release
  from naming n join {{axis}} a on a.rel = n.rel and a.expands join {{concept}} c on c.concept = n.concept
  join sized z on z.root = n.concept and z.descendants > 20 join {{run}} r on r.run_id = n.run
  where n.concept not in (select concept from binding) group by c.concept, c.name, c.concept_type, z.descendants""")
def _(s, d, held=None):
    rule, crule, axis, edge, policy, concept, run = rel(s, d, "rule", "class_rule", "axis", "edge", "policy", "concept", "run")
    roots = rule.select(F.col("object").alias("root")).union(crule.select("subject_class")).union(crule.select("object_class"))
    return gaps.unreviewed_roots(rule, crule, axis, held["subtree"] if held else core.closure(edge, roots), policy, concept, run)


@gap("dead_by_policy", f"""with recursive {REACH}, {BINDING}
  select c.concept, c.name, c.concept_type, count(*) as rules, max(x.subtree_partner_count) as subtree_partners, max(u.release) as release
  from reach x join {{concept}} c on c.concept = x.object join {{run}} u on u.run_id = x.run join {{axis}} a on a.rel = x.rel
  where a.expands and x.direct_partner_count = 0 and x.subtree_partner_count > 0
    and x.object in (select concept from binding where decision = 'deny') group by c.concept, c.name, c.concept_type""")
def _(s, d, held=None):
    return gaps.dead_by_policy(_reach(s, d, held), *rel(s, d, "axis", "policy", "concept", "run"))


@gap("unresolved_object", """select upper(u.source) as source, u.code, max(u.name) as name,
    string_agg(distinct u.rel, ', ' order by u.rel) as rels, max(u.kind) as kind, cast(sum(u.assertions) as bigint) as rules, max(r.release) as release
  from {unresolved_object} u join {run} r on r.run_id = u.run group by 1, 2""")
def _(s, d, held=None):
    return gaps.unresolved_objects(*rel(s, d, "unresolved_object", "run"))


@gap("condition_without_indication", f"""with recursive {IND_REACH}, letters as (
    select condition, list(distinct left(tree, 1)) as firsts from {{tree_number}} group by condition)
  select c.condition, c.name, c.kind from {{condition}} c join ind_reach r on r.condition = c.condition
  left join letters l on l.condition = c.condition
  where r.direct_rules = 0 and r.generalised_rules = 0
    and (list_has_any(l.firsts, ['C', 'F']) or (l.condition is null and c.scr_class = '3'))""")
def _(s, d, held=None):
    return gaps.conditions_without_indication(*rel(s, d, "condition", "tree_number"), indication_reach(s, d))


@gap("uncurated_effect", f"""with recursive {walk("select p_partkey as root from {part}")}, reach as (
    select t.root, count(distinct m.entity) as members from tree t join {{membership}} m on m.concept = t.node group by t.root)
  select c.concept, c.name, (select count(*) from {{rule}} r where r.object = c.concept) as rules, coalesce(x.members, 0) as members, u.release
  from {{concept}} c join {{run}} u on u.run_id = c.run left join reach x on x.root = c.concept
  where c.concept_type = 'PE' and not exists (select 1 from {{effect}} e where e.effect = c.concept and e.superseded_by is null)
    and (coalesce(x.members, 0) >= 10 or exists (select 1 from {{rule}} r where r.object = c.concept))""")
def _(s, d, held=None):
    concept, run, rule, effect, edge = rel(s, d, "concept", "run", "rule", "effect", "edge")
    roots = concept.where("concept_type = 'PE'").select(F.col("concept").alias("root"))
    return gaps.uncurated_effects(concept, run, rule, effect, held["subtree"] if held else core.closure(edge, roots), _members(s, d, held))


@gap("uncurated_threshold", f"""with recursive {CONTRIB}, counted as (
    select c.effect, count(*) as members,
      count(*) filter (where exists (select 1 from promoted p where p.effect = c.effect and p.entity = c.entity)) as graded_members
    from contrib c group by c.effect),
  touching as (select p.effect, count(distinct p.id) as graded from promoted p join contrib c on c.effect = p.effect and c.entity = p.entity
    group by p.effect)
  select e.effect, e.t_major, e.t_total, coalesce(g.graded, 0) as graded, coalesce(n.members, 0) - coalesce(n.graded_members, 0) as ungraded, u.release
  from {{effect}} e join {{run}} u on u.run_id = e.run left join counted n on n.effect = e.effect left join touching g on g.effect = e.effect
  where e.superseded_by is null and e.accumulates and e.t_major = 0
    and coalesce(n.members, 0) - coalesce(n.graded_members, 0) >= e.t_total""")
def _(s, d, held=None):
    return gaps.uncurated_thresholds(*rel(s, d, "effect", "grade"), held["subtree"] if held else _subtree(s, d), _members(s, d, held), *rel(s, d, "run"))


@gap("ineffective_contribution", f"""with recursive {walk('select effect as root from {effect} union select contributor from {grade} union select effect from {grade}')},
  held as (select t.root, list(distinct m.entity) as entities from tree t join {{membership}} m on m.concept = t.node group by t.root)
  select g.effect, g.contributor, g.magnitude, u.release from {{grade}} g join {{run}} u on u.run_id = g.run
  left join held a on a.root = g.effect left join held b on b.root = g.contributor
  where g.superseded_by is null and not coalesce(list_has_any(a.entities, b.entities), false)""")
def _(s, d, held=None):
    (grade,) = rel(s, d, "grade")
    return gaps.ineffective_contributions(grade, held["subtree"] if held else _subtree(s, d, grade.select("effect")), _members(s, d, held), *rel(s, d, "run"))


@gap("ungraded_contribution", f"""with recursive {walk('select effect as root from {effect}')}
  select e.effect, t.node as contributor, count(distinct m.entity) as members, u.release
  from {{effect}} e join {{run}} u on u.run_id = e.run join tree t on t.root = e.effect join {{membership}} m on m.concept = t.node
  where e.superseded_by is null and e.accumulates and (e.effect, t.node) not in
    (select (effect, contributor) from {{grade}} where superseded_by is null) group by e.effect, t.node, u.release""")
def _(s, d, held=None):
    return gaps.ungraded_contributions(*rel(s, d, "effect", "grade"), held["subtree"] if held else _subtree(s, d), _members(s, d, held), *rel(s, d, "run"))


@gap("unruled_composition", "select composite, count(*) as components from {composition} group by composite having bool_and(is_active is null)")
def _(s, d, held=None):
    return gaps.unruled_compositions(*rel(s, d, "composition"))


@gap("uncurated_contradiction", """select r.subject, r.condition, e.name, c.name as condition_name, count(distinct i.rel) as predicates
  from {cond_rule} r join {indication} i on i.subject = r.subject and i.condition = r.condition
  join {entity} e on e.entity = r.subject join {condition} c on c.condition = r.condition
  where not exists (select 1 from {cond_ruling} u where u.subject = r.subject and u.condition = r.condition and u.superseded_by is null)
  group by r.subject, r.condition, e.name, c.name""")
def contradiction_gaps(s, d, held=None):
    return gaps.uncurated_contradictions(*rel(s, d, "cond_rule", "indication", "cond_ruling", "entity", "condition"))


@gap("uncurated_rule", f"""with recursive {PAIRS}
  select p.subject, p.object, p.rel, count(distinct p.partner) as pairs, e.name as subject_name, c.name as object_name
  from pairs p join {{entity}} e on e.entity = p.subject join {{concept}} c on c.concept = p.object
  where (p.subject, p.object, p.rel) not in (select (subject, object, rel) from {{ruling}} where superseded_by is null)
  group by p.subject, p.object, p.rel, e.name, c.name""")
def _(s, d, held=None):
    counts = rules.rule_pairs(*rel(s, d, "rule", "axis", "edge", "membership", "policy"), held["reach"] if held else None)
    return gaps.uncurated_counts(counts, *rel(s, d, "ruling", "entity", "concept"))


@gap("unresolved_endpoint", """select source, entry, role, max(scheme) as scheme, max(value) as value, max(name) as name, max(release) as release
  from (select u.*, r.release from {unresolved_endpoint} u, {run} r where r.run_id = u.run) as x group by source, entry, role""")
def _(s, d, held=None):
    return gaps.unresolved_endpoints(*rel(s, d, "unresolved_endpoint", "run"))


@gap("uncurated_class_rule", f"""with recursive {CLASS_REACH}
  select subject_class, object_class, rel, max(subject_effective) as subject_effective, max(object_effective) as object_effective,
    max(subject_effective * object_effective - shared_members) as max_pair_count
  from class_reach k where not exists (select 1 from {{class_ruling}} u where u.superseded_by is null
    and u.subject_class = k.subject_class and u.object_class = k.object_class and u.rel = k.rel)
  group by subject_class, object_class, rel having max(subject_effective * object_effective - shared_members) > 0""")
def _(s, d, held=None):
    return gaps.uncurated_class_rules(class_pair_reach(s, d, held), *rel(s, d, "class_ruling"))


@gap("unadjudicated_cell", """with rows as (select x.*, coalesce(x.substance, x.raw_substance) as sub, r.release from {cell} x join {run} r on r.run_id = x.run)
  select source, sub as substance, heading, pathway, disposition, max(raw_substance) as raw_substance, max(markers) as markers, max(release) as release
  from rows where disposition = 'withheld_qualified' group by source, sub, heading, pathway, disposition
  union all select source, sub as substance, null as heading, null as pathway, disposition, max(raw_substance) as raw_substance,
    null as markers, max(release) as release
  from rows where disposition <> 'withheld_qualified' and disposition <> 'member' group by source, sub, disposition""")
def _(s, d, held=None):
    return gaps.unadjudicated_cells(*rel(s, d, "cell", "run"))


#: Key and text of each kind, as expressions that both engines read.
KEYS = {
    "unclassified_entity": ("concat('ENTITY:', cast(entity as {0}))", "concat('What does ', name, ' belong to?')"),
    "unpopulated_rule": ("concat('CLASS:', cast(concept as {0}))", "concat('Which entities belong to ', name, '? Rules on it: ', cast(rules as {0}))"),
    "unmatched_ingredient": ("concat('RXNORM_IN:', rxcui)", "concat('Which entity is ', rxcui, case when name is null then '' else concat(' (', name, ')') end, '?')"),
    "unreviewed_root": ("concat('CLASS:', cast(concept as {0}))", "concat('Do rules on ', name, ' hold for all ', cast(descendants as {0}), ' below?')"),
    "dead_by_policy": ("concat('CLASS:', cast(concept as {0}))", "concat('Should ', name, ' stay denied? Partners below: ', cast(subtree_partners as {0}))"),
    "unresolved_object": ("concat(source, ':', code)", "concat('What is ', name, ' (', rels, ')?')"),
    "condition_without_indication": ("concat('CONDITION:', condition)", "concat('What is indicated for ', name, '?')"),
    "uncurated_effect": ("concat('CLASS:', cast(concept as {0}))", "concat('Does ', name, ' accumulate over ', cast(members as {0}), ' members?')"),
    "uncurated_threshold": ("concat('CLASS:', cast(effect as {0}))", "concat('Are ', cast(ungraded as {0}), ' ungraded members enough?')"),
    "ineffective_contribution": ("concat('CLASS:', cast(effect as {0}), '/CLASS:', cast(contributor as {0}))", "concat('Whom does a ', magnitude, ' grade touch?')"),
    "ungraded_contribution": ("concat('CLASS:', cast(effect as {0}), '/CLASS:', cast(contributor as {0}))", "concat('How much do ', cast(members as {0}), ' members contribute?')"),
    "unruled_composition": ("concat('SUBSTANCE:', cast(composite as {0}))", "concat('Which of ', cast(components as {0}), ' components are active?')"),
    "uncurated_contradiction": ("concat('ENTITY:', cast(subject as {0}), '/CONDITION:', condition)", "concat('Is ', name, ' for or against ', condition_name, '?')"),
    "uncurated_rule": ("concat('ENTITY:', cast(subject as {0}), '/CLASS:', cast(object as {0}), '/AXIS:', rel)", "concat('How severe is ', subject_name, ' with ', object_name, '? Pairs: ', cast(pairs as {0}))"),
    "unresolved_endpoint": ("concat('ONCHIGH:', entry, ':', role, ':', scheme, ':', value)", "concat('Who is ', name, '?')"),
    "uncurated_class_rule": ("concat('CLASS:', cast(subject_class as {0}), '/CLASS:', cast(object_class as {0}), '/AXIS:', rel)", "concat('How severe are ', cast(max_pair_count as {0}), ' pairs?')"),
    "unadjudicated_cell": ("concat('FDACYP:', substance, '|', coalesce(heading, disposition), '|', coalesce(pathway, ''))", "concat('What does the cell of ', raw_substance, ' say?')"),
}
REGISTRY = " union all ".join(
    f"select distinct '{kind}' as kind, {key.format('varchar')} as gap_key, {text.format('varchar')} as text from ({SQLS[kind]}) as g{i}"
    for i, (kind, (key, text)) in enumerate(KEYS.items())
)


def registry(s, d):
    held = _held(s, d)
    kinds = [gaps.keyed(kind, QUERIES[f"gap_{kind}"](s, d, held), F.expr(key.format("string")), F.expr(text.format("string"))) for kind, (key, text) in KEYS.items()]
    return gaps.questions(kinds)


KIND_KEY = "kind || ':' || gap_key"
query("gap_registry", f"select kind, gap_key, text, {uuid_sql(KIND_KEY)} as question from ({REGISTRY}) as g")(registry)

OLD = f"select {uuid_sql(KIND_KEY)} as question, o.* from {{old_question}} o"
WORKED = uuid_sql("'unclassified_entity:' || gap_key")


@query("registry_update", f"""with live as (select kind, gap_key, text, {uuid_sql(KIND_KEY)} as question from ({REGISTRY}) as g),
  old as ({OLD}), worked as (select distinct {WORKED} as question from {{question_work}})
  select l.question, l.kind, l.gap_key, l.text, cast(coalesce(o.first_run, 9) as bigint) as first_run, cast(9 as bigint) as last_run, true as is_current
  from live l left join old o on o.question = l.question
  union all select o.question, o.kind, o.gap_key, o.text, cast(o.first_run as bigint) as first_run, cast(o.last_run as bigint) as last_run, false as is_current
  from old o where o.question in (select question from worked) and o.question not in (select question from live)""")
def _(s, d):
    old, work = rel(s, d, "old_question", "question_work")
    old = gaps.questions([old.select("kind", "gap_key", "text", "first_run", "last_run", "is_current")])
    work = gaps.questions([work.select(F.lit("unclassified_entity").alias("kind"), "gap_key")]).select("question")
    return gaps.register(old, registry(s, d), work, 9)


@query("worklist", """with q as (select distinct user_id as question, cast(user_id % 3 as varchar) as kind from {log} where user_id % 11 <> 10),
  latest as (select question, arg_max(state, id) as state from {question_state} group by question),
  checked as (select distinct user_id as question, event_type as source from {log} where event_type <> 'error' or user_id % 2 = 0),
  ranked as (select q.question, min(t.rank) as rank from q cross join (select event_type as source, row_number() over (order by event_type) as rank
      from (select distinct event_type from {log})) t
    where not exists (select 1 from checked c where c.question = q.question and c.source = t.source) group by q.question)
  select q.question, q.kind, coalesce(l.state, 'open') as state, cast(r.rank as int) as rank
  from q left join latest l on l.question = q.question left join ranked r on r.question = q.question
  where coalesce(l.state, 'open') <> 'withdrawn'""")
def _(s, d):
    from pyspark.sql import Window as W

    log, state = rel(s, d, "log", "question_state")
    asked = log.select(F.col("user_id").alias("question"), (F.col("user_id") % 3).cast("string").alias("kind"), (F.col("user_id") % 11 != 10).alias("is_current")).distinct()
    tiers = log.select(F.col("event_type").alias("source")).distinct().withColumn("rank", F.row_number().over(W.orderBy("source")))
    checks = log.where("event_type <> 'error' or user_id % 2 = 0").select(F.col("user_id").alias("question"), F.col("event_type").alias("source"))
    return review.worklist(asked, state, tiers, checks)

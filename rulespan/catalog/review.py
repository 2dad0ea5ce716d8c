"""The review queue, its metadata, histories and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulespan.catalog.base import BINDING, query, rel
from rulespan.catalog.gaps import SQLS, contradiction_gaps
from rulespan.catalog.pairs import CLASS_REACH, REACH, class_pair_reach, rule_reach
from rulespan.operators import review, rules

IMPACT = f"""{REACH}, {BINDING}, impact as (select x.*, case when a.expands and x.object not in (select concept from binding where decision = 'deny')
  then x.subtree_partner_count else x.direct_partner_count end as impact from reach x join {{axis}} a on a.rel = x.rel)"""
QUEUE = f"""{IMPACT}, queue as (
  select 'interaction_rule' as kind, cast(i.subject as varchar) as subject, cast(i.object as varchar) as object, e.name as subject_name, c.name as object_name,
    i.rel as rels, string_agg(distinct i.source, ',' order by i.source) as sources, string_agg(distinct r.release, ',' order by r.release) as releases,
    max(i.impact) as impact
  from impact i join {{entity}} e on e.entity = i.subject join {{concept}} c on c.concept = i.object join {{run}} r on r.run_id = i.run
  where not exists (select 1 from {{ruling}} u where u.superseded_by is null and u.subject = i.subject and u.object = i.object and u.rel = i.rel)
  group by i.subject, i.object, i.rel, e.name, c.name having max(i.impact) > 0
  union all
  select 'condition_contradiction' as kind, cast(g.subject as varchar) as subject, g.condition as object, g.name as subject_name, g.condition_name as object_name,
    string_agg(distinct p.rel, ',' order by p.rel) as rels, string_agg(distinct p.source, ',' order by p.source) as sources,
    string_agg(distinct r.release, ',' order by r.release) as releases, 1 as impact
  from ({SQLS['uncurated_contradiction']}) g join (select subject, condition, rel, source, run from {{cond_rule}}
    union all select subject, condition, rel, source, run from {{indication}}) p on p.subject = g.subject and p.condition = g.condition
  join {{run}} r on r.run_id = p.run group by g.subject, g.condition, g.name, g.condition_name)"""


def queue(s, d):
    axis, policy, ruling, entity, concept, run, rule, indication = rel(s, d, "axis", "policy", "ruling", "entity", "concept", "run", "cond_rule", "indication")
    return review.review_queue(rule_reach(s, d), axis, policy, ruling, entity, concept, run, contradiction_gaps(s, d), rule, indication)


query("review_queue", f"with recursive {QUEUE} select * from queue")(queue)


@query("review_queue_page", f"""with recursive {QUEUE} select * from queue where kind = 'interaction_rule' and list_contains(string_split(sources, ','), 'S2')
  and contains(lower(subject_name || ' ' || object_name || ' ' || replace(rels, ',', ' ')), 'ring')
  order by impact desc, lower(subject_name), lower(object_name), subject, object, rels limit 7 offset 7""")
def _(s, d):
    return review.page(review.filtered(queue(s, d), kind="interaction_rule", source=" S2 ", search="RING"), 2, 7)


@query("queue_metadata", f"""with recursive {QUEUE}, {CLASS_REACH}, covered as (
    select sum(i.impact) as pairs from impact i join {{ruling}} u on u.subject = i.subject and u.object = i.object and u.rel = i.rel
      where u.superseded_by is null and u.applies
    union all select sum(k.subject_effective * k.object_effective - k.shared_members) from class_reach k join {{class_ruling}} u
      on u.subject_class = k.subject_class and u.object_class = k.object_class and u.rel = k.rel where u.superseded_by is null and u.applies)
  select count(*) filter (where kind = 'interaction_rule') as interaction_rules, count(*) filter (where kind = 'condition_contradiction') as condition_contradictions,
    string_agg(distinct kind, ',' order by kind) as kinds,
    (select string_agg(distinct x, ',' order by x) from (select unnest(string_split(sources, ',')) as x from queue)) as all_sources,
    (select string_agg(distinct x, ',' order by x) from (select unnest(string_split(rels, ',')) as x from queue)) as all_rels,
    count(*) filter (where list_contains(string_split(sources, ','), 'S1')) as total_items,
    (select cast(sum(pairs) as bigint) from covered) as reviewed_pairs from queue""")
def _(s, d):
    q = queue(s, d)
    axis, policy, ruling, cruling = rel(s, d, "axis", "policy", "ruling", "class_ruling")
    covered = review.reviewed_pairs(rule_reach(s, d), axis, policy, ruling, class_pair_reach(s, d), cruling)
    return review.metadata(q, review.filtered(q, source="S1"), covered)


@query("empty_page", """select count(*) as n, cast(null as varchar) as kind from {ruling}""")
def _(s, d):
    # Beyond the last page the metadata still comes, alone.
    (ruling,) = rel(s, d, "ruling")
    meta = ruling.agg(F.count("*").alias("n"))
    return review.with_metadata(meta, ruling.where("false").select(F.lit("x").alias("kind")))


@query("reviewed_against", """select r.subject, r.object, string_agg(distinct u.release, ', ' order by u.release) as releases from {rule} r join {run} u on u.run_id = r.run
  group by r.subject, r.object""")
def _(s, d):
    return review.reviewed_against(*rel(s, d, "rule", "run"), ["subject", "object"])


@query("decision_history", """select id, subject, object, rel, reviewed_by, count(*) over (partition by subject, object order by reviewed_at, id
    rows between unbounded preceding and current row) as turn, case when id % 3 = 0 then 'signed' else 'unsigned' end as status from {ruling}""")
def _(s, d):
    (ruling,) = rel(s, d, "ruling")
    status = ruling.where("id % 3 = 0").select(F.col("id").alias("target"), F.lit("signed").alias("status")).distinct()
    return review.history(ruling, status, ["subject", "object"]).select("id", "subject", "object", "rel", "reviewed_by", "turn", "status")


@query("write_decisions", """with live as (select subject, object, rel, max(id) as id, max(severity) as severity from {ruling} where superseded_by is null group by all),
  asked as (select distinct subject, object, rel from {rule})
  select a.subject, a.object, a.rel, case when (case when a.object % 5 = 0 then -1 else l.id end) is distinct from l.id then 'conflict'
    when l.id is not null and l.severity = 'major' then 'unchanged' else 'written' end as outcome
  from asked a left join live l on l.subject = a.subject and l.object = a.object and l.rel = a.rel""")
def _(s, d):
    rule, ruling = rel(s, d, "rule", "ruling")
    keys = ["subject", "object", "rel"]
    log = ruling.groupBy(*keys, "superseded_by").agg(F.max("id").alias("id"), F.max("severity").alias("severity"))
    seen = log.where("superseded_by is null").select(*keys, "id")
    asked = rule.select(*keys).distinct().join(seen, keys, "left").withColumn("expected", F.when(F.expr("object % 5 = 0"), F.lit(-1)).otherwise(F.col("id")))
    return review.write_decision(log, asked.select(*keys, F.lit("major").alias("severity"), "expected"), keys)


@query("live_judgements", "select subject, object, rel, applies, severity, evidence from {ruling} where superseded_by is null")
def _(s, d):
    return rules.live_judgements(*rel(s, d, "ruling"))


@query("review_record", """with question as (select 'rule' as kind, 'ENTITY:' || cast(user_id as varchar) as gap_key, user_id as question from (select distinct user_id from {events}) where user_id % 4 <> 0),
  item as (select event_id as id, user_id as question, user_id % 7 as reviewer, ts as at, case when event_type = 'error' then 'reference' else 'annotation' end as item, event_type as content, case when event_type = 'error' then 'DOI' end as scheme from {events})
  select q.kind, q.gap_key, i.item, i.id, case when i.reviewer <> 3 then 'r' || cast(i.reviewer as varchar) end as author, i.scheme, i.content, row_number() over (partition by q.question, i.item order by i.at, i.id) as turn
  from question q join item i on i.question = q.question""")
def _(s, d):
    (events,) = rel(s, d, "events")
    key = F.concat(F.lit("ENTITY:"), F.col("user_id"))
    questions = events.select(F.lit("rule").alias("kind"), key.alias("gap_key"), F.col("user_id").alias("question"), (F.col("user_id") % 4 != 0).alias("is_current")).distinct()
    rows = events.select(F.col("user_id").alias("question"), F.col("event_id").alias("id"), (F.col("user_id") % 7).alias("reviewer"), F.col("ts").alias("at"), "event_type")
    notes = rows.where("event_type <> 'error'").withColumnRenamed("event_type", "text")
    references = rows.where("event_type = 'error'").withColumnRenamed("event_type", "value").withColumn("scheme", F.lit("DOI"))
    profiles = events.select((F.col("user_id") % 7).alias("reviewer")).distinct().withColumn("name", F.concat(F.lit("r"), "reviewer")).withColumn("superseded_by", F.when(F.col("reviewer") == 3, 1))
    return review.record(questions.select("kind", "gap_key"), questions, notes, references, profiles)

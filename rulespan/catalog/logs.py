"""Append-only logs, runs, and projections that are rebuilt."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulespan.catalog.base import query, rel
from rulespan.operators import core

KEYS = ["user_id", "event_type"]


@query("live_log", "select l.* from {log} l join (select user_id, event_type, max(id) as id from {log} group by 1, 2) m on m.id = l.id")
def _(s, d):
    (log,) = rel(s, d, "log")
    return core.live(core.supersede(log, KEYS)).select("id", "user_id", "event_type", "value")


@query("superseded_chain", """select l.id, l.user_id, l.event_type, (select min(n.id) from {log} n where n.user_id = l.user_id
  and n.event_type = l.event_type and n.id > l.id) as superseded_by from {log} l""")
def _(s, d):
    (log,) = rel(s, d, "log")
    return core.supersede(log, KEYS).select("id", "user_id", "event_type", "superseded_by")


# A log whose pointers are wrong in each way: a missing target, an earlier one, another key's, two live rows, no key.
BROKEN = """select id, case when id % 101 = 7 then null else user_id end as user_id, event_type,
  case when id % 50 = 3 then id + 1000000000 when id % 50 = 4 then id - 1 when id % 50 = 5 then id + 1
    when id % 50 = 6 then null else superseded_by end as superseded_by
  from (select id, user_id, event_type, lead(id) over (partition by user_id, event_type order by id) as superseded_by from {log}) as l"""


@query("overlay_violations", f"""with l as ({BROKEN}), p as (
    select a.id, a.superseded_by, b.id as target, a.user_id is not distinct from b.user_id and a.event_type is not distinct from b.event_type as same
    from l a left join l b on b.id = a.superseded_by where a.superseded_by is not null)
  select 'wrong target' as kind, id from p where target is null or not same
  union all select 'not later' as kind, id from p where superseded_by <= id
  union all select 'many live' as kind, max(id) as id from l where superseded_by is null group by user_id, event_type having count(*) > 1
  union all select 'null key' as kind, id from l where user_id is null or event_type is null""")
def _(s, d):
    from rulespan.plans.adapters import spark_sql

    return core.overlay_violations(spark_sql(s, d, BROKEN), KEYS)


@query("withdrawn", """select user_id, event_type, max(id) + 1000000 as id, 'withdrawn' as decision,
    case when max(case when event_type = 'error' then 1 else 0 end) = 1 then 'refused' else 'written' end as outcome
  from {log} group by user_id, event_type""")
def _(s, d):
    (log,) = rel(s, d, "log")
    asked = log.select(*KEYS).distinct()
    live = core.live(core.supersede(log.where("event_type <> 'error'"), KEYS))
    last = log.groupBy(*KEYS).agg((F.max("id") + 1000000).alias("id"))
    return core.withdraw(live, asked, KEYS).join(last, KEYS).select(*KEYS, "id", "decision", "outcome")


@query("incomplete_runs", "select run_id, source, writer, started from {run} where run_id not in (select run_id from {run} where finished is not null)")
def _(s, d):
    return core.incomplete_runs(*rel(s, d, "run"))


@query("loaded_release", """select source, writer, max(run_id) as run_id from {run} r where finished is not null and finished =
  (select max(finished) from {run} x where x.source = r.source and x.writer = r.writer) group by source, writer""")
def _(s, d):
    return core.loaded_releases(*rel(s, d, "run"))


@query("rebuild_projection", """select entity, concept, axis as source from {membership} where axis <> 'R'
  union all select entity, concept + 1 as concept, axis as source from {membership} where axis = 'R'""")
def _(s, d):
    (m,) = rel(s, d, "membership")
    new = m.where("axis = 'R'").select("entity", (F.col("concept") + 1).alias("concept"), F.col("axis").alias("source"))
    return core.rebuild(m.select("entity", "concept", F.col("axis").alias("source")), new, "R")


@query("insert_if_absent", "select k, min(kind) as kind from {snapshot_b} where k not in (select k from {snapshot_a}) group by k")
def _(s, d):
    a, b = rel(s, d, "snapshot_a", "snapshot_b")
    return core.insert_if_absent(a.select("k", "kind"), b.select("k", "kind"), ["k"]).select("k", "kind")


@query("upsert_first_seen", """select k, arg_max(v, run) as v, min(run) as first_run, min(run) = 2 as is_new
  from (select k, v, 1 as run from {snapshot_a} union all select k, v, 2 as run from {snapshot_b}) as x group by k""")
def _(s, d):
    a, b = rel(s, d, "snapshot_a", "snapshot_b")
    return core.upsert_first_seen(a.select("k", "v", F.lit(1).alias("first_run")), b.select("k", "v", F.lit(2).alias("first_run")), "k")

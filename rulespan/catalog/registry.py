"""The registry's logs: states, checks, evidence, keys, manifests, status."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulespan.catalog.base import query, rel
from rulespan.catalog.pairs import BEST, CURATED, effective_pairs
from rulespan.operators import core, registry

def _states(s, d):
    return core.supersede(rel(s, d, "question_state")[0], ["question"])


@query("set_states", """with all_rows as (select id, question, state from {question_state} union all
    select 10000000 + question as id, question, 'parked' as state from (select distinct question from {question_state} where question % 3 = 0))
  select id, question, state, lead(id) over (partition by question order by id) as superseded_by from all_rows""")
def _(s, d):
    states = _states(s, d)
    asked = states.where("question % 3 = 0").select("question").distinct().select((10000000 + F.col("question")).alias("id"), "question", F.lit("parked").alias("state"))
    return registry.set_states(states, states.select("question"), asked, ("open", "parked", "withdrawn"))


@query("current_states", "select question, arg_max(state, id) as state from {question_state} group by question union all select -1 as question, 'open' as state")
def _(s, d):
    states = _states(s, d)
    none = s.createDataFrame([(-1,)], "question long")
    return registry.current_state(states.select("question").unionByName(none), states)


@query("source_checks", """with old as (select distinct user_id as question, event_type as source, '1' as version, 'none' as outcome from {events} where user_id % 2 = 0)
  select * from old union all select distinct user_id as question, event_type as source, '1' as version, 'found' as outcome from {events} where user_id % 2 = 1""")
def _(s, d):
    events = rel(s, d, "events")[0].select(F.col("user_id").alias("question"), F.col("event_type").alias("source"), F.lit("1").alias("version"))
    old = events.where("question % 2 = 0").distinct().withColumn("outcome", F.lit("none"))
    return registry.record_checks(old, events.withColumn("outcome", F.lit("found")))


@query("evidence", "select user_id as question, event_type as citation from {events} where event_type <> 'error'")
def _(s, d):
    events = rel(s, d, "events")[0].select(F.col("user_id").alias("question"), F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type")).alias("citation"))
    return registry.add_evidence(events.limit(0), events)


@query("key_registry", """with rows as (select id, key_id, status, status_from from {signing_key} union all select 100 + key_id as id, key_id, 'compromised' as status, timestamp '1997-01-01 00:00:00' as status_from from {signing_key} where superseded_by is null and status = 'active')
  select id, key_id, status, status_from, cast(lead(id) over (partition by key_id order by id) as int) as superseded_by from rows""")
def _(s, d):
    keys, statuses = rel(s, d, "signing_key", "key_status")
    new = keys.where("superseded_by is null and status = 'active'").select((100 + F.col("key_id")).alias("id"), "key_id", F.lit("compromised").alias("status"), F.lit("1997-01-01 00:00:00").cast("timestamp").alias("status_from"))
    return registry.register_keys(keys, new, statuses)


@query("current_keys", """select distinct e.o_custkey % 20 as reviewer, k.key_id, k.status, k.status_from from {orders} e join {signing_key} r on r.id = e.o_orderkey % 9 join {signing_key} k on k.key_id = r.key_id and k.superseded_by is null
  where e.o_orderstatus <> 'P'""")
def _(s, d):
    orders, keys = rel(s, d, "orders", "signing_key")
    enrolments = orders.select((F.col("o_custkey") % 20).alias("reviewer"), (F.col("o_orderkey") % 9).alias("key_row"), (F.col("o_orderstatus") != "P").alias("enrolled"), F.lit(None).cast("int").alias("superseded_by"))
    return registry.current_keys(enrolments, keys)


RULING_FIELDS = [("subject", "bigint"), ("object", "bigint"), ("rel", "string"), ("applies", "boolean"), ("severity", "string")]


def _entries(s, d):
    ruling, cruling = rel(s, d, "ruling", "class_ruling")
    fields = lambda names: [(n, F.col(n), k) for n, k in names]
    classes = [("subject_class", "bigint"), ("object_class", "bigint"), ("rel", "string")]
    # A row per key: the adapter has a ruling for each relation of a pair.
    return registry.manifest_entries({"ruling": (ruling, fields(RULING_FIELDS[:3]), fields(RULING_FIELDS)), "class_ruling": (cruling, fields(classes), fields([*classes, ("severity", "string")]))})


def _field(name: str) -> str:
    text = f"cast({name} as varchar)"
    return f"'{len(name)}:{name}:' || case when {name} is null then 'N' else 'S' end || ':' || cast(strlen(coalesce({text}, '')) as varchar) || ':' || coalesce({text}, '') || chr(10)"


ENTRIES = f"""select 'ruling' as kind, cast(subject as varchar) || '/' || cast(object as varchar) || '/' || rel as key, 'ruling/1' as context,
    sha256('payload/1' || chr(10) || 'ruling/1' || chr(10) || '5' || chr(10) || {' || '.join(_field(n) for n, _ in RULING_FIELDS)}) as digest from {{ruling}} where superseded_by is null
  union all select 'class_ruling' as kind, cast(subject_class as varchar) || '/' || cast(object_class as varchar) || '/' || rel as key, 'class_ruling/1' as context,
    sha256('payload/1' || chr(10) || 'class_ruling/1' || chr(10) || '4' || chr(10) || {' || '.join(_field(n) for n in ('subject_class', 'object_class', 'rel', 'severity'))}) as digest from {{class_ruling}} where superseded_by is null"""


@query("manifest_entries", ENTRIES)
def _(s, d):
    return _entries(s, d)


MANIFEST = f"""entries as ({ENTRIES}), lines as (select kind || ' ' || key || ' ' || context || ' ' || digest as line from entries),
buckets as (select left(sha256(line), 4) as bucket, count(*) as n, sha256(string_agg(line, chr(10) order by line)) as digest from lines group by 1)"""


@query("manifest", f"""with {MANIFEST} select 'R1' as release, cast(sum(n) as bigint) as entries, sha256('manifest/1' || chr(10) || 'R1' || chr(10) || string_agg(digest, chr(10) order by bucket)) as digest from buckets""")
def _(s, d):
    return registry.manifest(_entries(s, d), "R1")


@query("verify_manifest", "select 'R1' as release, false as digest_ok, true as row_count_ok")
def _(s, d):
    entries = _entries(s, d)
    published = registry.manifest(entries, "R1")
    # One entry's digest was altered since.
    altered = entries.withColumn("digest", F.when(F.xxhash64("kind", "key") == entries.agg(F.min(F.xxhash64("kind", "key"))).first()[0], F.lit("0")).otherwise(F.col("digest")))
    return registry.verify_manifest(published, altered, "R1")


@query("grades_of_subjects", f"""with recursive {CURATED}, {BEST} select subject, partner, rel, severity, effective_rank, row_number() over (partition by subject order by effective_rank, partner, rel) as turn from best where subject in (select s_suppkey from {{supplier}} where s_nationkey = 7)""")
def _(s, d):
    subjects = rel(s, d, "supplier")[0].where("s_nationkey = 7").select(F.col("s_suppkey").alias("subject"))
    return registry.grades_of(effective_pairs(s, d, subjects), subjects).select("subject", "partner", "rel", "severity", "effective_rank", "turn")


@query("policy_live", "select policy_id, concept, decision from {policy} p where superseded_by is null")
def _(s, d):
    return registry.policy_history(rel(s, d, "policy")[0])


@query("policy_of_concept", "select policy_id, concept, decision from {policy} where concept = 14")
def _(s, d):
    return registry.policy_history(rel(s, d, "policy")[0], 14)


@query("missing_codes", "select distinct code from (select unii as code from {record} except select value as code from {claim} where scheme = 'UNII') as x")
def _(s, d):
    record, claim = rel(s, d, "record", "claim")
    return registry.missing_codes(record.select(F.col("unii").alias("code")), claim.where("scheme = 'UNII'").select(F.col("value").alias("code")), "code")


@query("status", """select 'runs' as block, 'incomplete' as name, (select count(*) from {run} where finished is null) as n union all select 'runs' as block, 'loaded' as name, (select count(*) from (select distinct source, writer from {run} where finished is not null)) as n
  union all select 'curation' as block, 'live' as name, (select count(*) from {ruling} where superseded_by is null) as n union all select 'policy' as block, 'binding' as name, (select count(*) from {policy} where superseded_by is null and decision <> 'withdrawn') as n
  union all select 'composition' as block, 'unknown' as name, (select count(*) from {composition} where is_active is null) as n union all select 'signatures' as block, 'backdated' as name, (select count(*) from {signature} where recorded_at - signed_at > interval '1' day) as n""")
def _(s, d):
    from rulespan.operators import rules, signing

    run, ruling, policy, composition, signature = rel(s, d, "run", "ruling", "policy", "composition", "signature")
    return registry.status(s, registry.run_blocks(run) | {"curation.live": core.live(ruling), "policy.binding": rules.binding(policy), "composition.unknown": composition.where("is_active is null"), "signatures.backdated": signing.backdated(signature)})


@query("run_ledger", """select run_id, source, writer, started, case when finished is null and run_id % 20 = 0 then started + interval '1' hour else finished end as finished from {run}
  union all select 5000000 + s_suppkey as run_id, 'S' as source, 'w' as writer, timestamp '2001-01-01 00:00:00' as started, null as finished from {supplier}""")
def _(s, d):
    run, supplier = rel(s, d, "run", "supplier")
    run = run.select("run_id", "source", "writer", F.col("started").cast("timestamp").alias("started"), F.col("finished").cast("timestamp").alias("finished"))
    new = supplier.select((5000000 + F.col("s_suppkey")).alias("run_id"), F.lit("S").alias("source"), F.lit("w").alias("writer"), F.lit("2001-01-01 00:00:00").cast("timestamp").alias("started"))
    done = run.where("run_id % 20 = 0").select("run_id", (F.col("started") + F.expr("interval 1 hour")).alias("at"))
    # Finishes are of stored runs, so they come first: a new run may bear one of their numbers.
    return registry.open_runs(registry.finish_runs(run, done), new)


@query("worklist_by_identity", """select distinct rxcui, max(reason) over (partition by rxcui) as reason, cast(7 as bigint) as run from (select rxcui, min(reason) as reason from {unmatched} group by rxcui) as x
  union all select 'old' as rxcui, 'r' as reason, cast(3 as bigint) as run""")
def _(s, d):
    stored = s.createDataFrame([("old", "r", 3), ("gone", "r", 7)], "rxcui string, reason string, run long")
    return registry.persist_worklist(stored, rel(s, d, "unmatched")[0].select("rxcui", "reason"), ["rxcui"], 7)


@query("recorded_signatures", "select run_id, 'payload/1' || chr(10) || 'run/1' || chr(10) || '1' || chr(10) || '6:source:S:' || cast(strlen(source) as varchar) || ':' || source || chr(10) as payload from {run}")
def _(s, d):
    from rulespan.functions import text as T

    run = rel(s, d, "run")[0].select("run_id", T.payload("run/1", [("source", F.col("source"))]).alias("payload"))
    return registry.record_signatures(run.limit(0), run, F.lit("run/1"))

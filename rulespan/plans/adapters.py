"""Relations of the rule engine's shape over the driver's tables, in portable SQL.

Tables stand in braces; Spark gets them as DataFrames, other engines as views."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: How many entities there are.
_ENTITIES = "(select count(*) as n from {supplier}) as s"

RELATIONS = {
    # The registry: concepts in a hierarchy with several parents, entities and what they belong to.
    "edge": """
        select p_partkey as child, cast(floor(p_partkey / 2) as bigint) as parent from {part} where p_partkey >= 1
        union select p_partkey as child, cast(floor(p_partkey / 3) as bigint) as parent from {part}
        where p_partkey >= 1 and p_partkey % 5 = 0
        union select 40 + 3 * n_nationkey as child, 6000000 + n_nationkey as parent from {nation}""",
    # Parts, and for each nation a concept that nothing belongs to (5000000 on) and one with members below only.
    "concept": """
        select p_partkey as concept, case when p_partkey % 2 = 0 then 'MAIN' else 'ALT' end as source,
          concat('C', cast(p_partkey as varchar(20))) as code, p_name as name,
          case when p_partkey % 3 = 0 then 'PE' else 'MoA' end as concept_type, p_partkey % 50 as run from {part}
        union all select 1000000 * kind + n_nationkey as concept, 'OWN' as source, concat('N', cast(n_nationkey as varchar(20))) as code,
          n_name as name, 'EPC' as concept_type, n_nationkey as run from {nation}, (select 5 as kind union all select 6 as kind) as k""",
    "entity": """
        select s_suppkey as entity, s_name as name, s_suppkey % 40 as run from {supplier}
        union all select 9000000 + n_nationkey as entity, n_name as name, n_nationkey as run from {nation}""",
    "membership": """
        select l_suppkey as entity, l_partkey as concept, l_returnflag as axis, min(l_orderkey) as run
        from {lineitem} group by l_suppkey, l_partkey, l_returnflag""",
    "axis": """
        select 'A' as rel, 'A' as membership_axis, true as expands union all
        select 'N' as rel, 'N' as membership_axis, true as expands union all
        select 'R' as rel, 'R' as membership_axis, false as expands""",
    "run": """
        select o_orderkey as run_id, o_orderpriority as source, o_orderstatus as writer, o_orderdate as started,
          case when o_orderkey % 10 = 0 then null else o_orderdate end as finished,
          concat('R', cast(o_orderkey % 23 as varchar(20))) as release from {orders}""",
    # Rules of entities against concepts: a third name broad concepts, the others any.
    "rule": f"""
        select distinct c_custkey % n as subject,
          case when c_custkey % 3 = 0 then 16 + c_custkey % 48 else (c_custkey * 7) % parts end as object,
          case when c_custkey % 4 = 0 then 'A' when c_custkey % 4 = 3 then 'R' else 'N' end as rel,
          case when c_nationkey % 2 = 0 then 'S1' else 'S2' end as source, c_custkey % 60 as run
        from {{customer}}, {_ENTITIES}, (select count(*) as parts from {{part}}) as p
        union select n_nationkey % n as subject, 1000000 * kind + n_nationkey as object, 'N' as rel, 'S1' as source, n_nationkey as run
        from {{nation}}, {_ENTITIES}, (select 5 as kind union all select 6 as kind) as k""",
    "class_rule": """
        select 16 + n_nationkey % 12 as subject_class,
          case when n_nationkey % 5 = 0 then 16 + n_nationkey % 12 else 28 + (n_nationkey * 5) % 60 end as object_class,
          case n_regionkey % 3 when 0 then 'A' when 1 then 'N' else 'R' end as rel,
          case when n_nationkey % 2 = 0 then 'S1' else 'S2' end as source, n_nationkey as run from {nation}""",
    # Decisions by concept, of which the live ones hold; some name concepts that don't exist.
    "policy": """
        select p_partkey as policy_id, p_partkey as concept,
          case when p_partkey % 7 = 0 then 'deny' when p_partkey % 11 = 0 then 'allow' else 'withdrawn' end as decision,
          cast(null as bigint) as superseded_by from {part}
        union all select -1 - s_suppkey as policy_id, 2 * s_suppkey as concept, 'deny' as decision, 2 * s_suppkey as superseded_by
        from {supplier}
        union all select 30000000 + n_nationkey as policy_id, -1 - n_nationkey as concept, 'deny' as decision,
          cast(null as bigint) as superseded_by from {nation}
        union all select 40000000 + n_nationkey as policy_id, 6000000 + n_nationkey as concept, 'deny' as decision,
          cast(null as bigint) as superseded_by from {nation}""",
    "severity": """
        select 'contraindicated' as severity, 1 as rank union all select 'major' as severity, 2 as rank
        union all select 'moderate' as severity, 3 as rank union all select 'minor' as severity, 4 as rank""",
    # Judgements, of which some are superseded, some don't apply, and some name no rule any more.
    "ruling": """
        select 1000 * subject + object as id, subject, object + case when subject % 17 = 3 then 1 else 0 end as object, rel,
          (subject + object) % 3 <> 0 as applies,
          case (subject + object) % 5 when 0 then 'contraindicated' when 1 then 'major' when 2 then 'moderate'
            when 3 then 'minor' else 'odd' end as severity,
          case when subject % 2 = 0 then 'established' else 'probable' end as evidence,
          concat('curator', cast(subject % 3 as varchar(20))) as reviewed_by, subject * 100 + object as reviewed_at,
          case when object % 9 = 4 then 1000 * subject + object + 1 end as superseded_by
        from (select distinct subject, object, rel from {rule}) as r where subject % 2 = 0""",
    "class_ruling": """
        select 100 * subject_class + object_class as id, subject_class,
          object_class + case when subject_class % 8 = 7 then 1 else 0 end as object_class, rel, subject_class % 9 <> 0 as applies,
          case object_class % 3 when 0 then 'major' when 1 then 'minor' else 'grave' end as severity, 'probable' as evidence,
          'curator9' as reviewed_by, subject_class * 100 + object_class as reviewed_at, cast(null as bigint) as superseded_by
        from (select distinct subject_class, object_class, rel from {class_rule}) as r
        where (subject_class + object_class) % 3 <> 0""",
    "log": "select event_id as id, user_id, event_type, value from {events}",
    # Accumulating effects over broad concepts, and grades of contributors.
    "effect": """
        select effect as id, effect, effect % 5 <> 0 as accumulates, effect % 4 as t_major, 1 + effect % 30 as t_total,
          effect % 30 as run, case when effect % 13 = 0 then 900000 + effect end as superseded_by
        from (select distinct 16 + c_custkey % 48 as effect from {customer}) as e""",
    "grade": """
        select 1000 * effect + contributor as id, effect, contributor,
          case when effect % 2 = 0 then 'major' else 'minor' end as magnitude, effect % 30 as run,
          case when contributor % 10 = 0 then 900000 + effect end as superseded_by
        from (select distinct 16 + c_custkey % 48 as effect,
          case when c_custkey % 4 = 0 then 1000 + c_custkey % 48 when c_custkey % 6 = 1 then 64 + (c_custkey * 11) % 90
            else 32 + 2 * (c_custkey % 48) end as contributor
          from {customer} union select 20 + n_nationkey as effect, 5000000 + n_nationkey as contributor from {nation}) as g""",
    "group_member": """
        select distinct n_regionkey as grp, concat('role', cast(n_nationkey % 3 as varchar(20))) as role,
          40 + n_nationkey * 2 as concept, n_nationkey % 7 <> 0 as satisfies,
          case when n_nationkey % 6 = 5 then 1 end as superseded_by from {nation}""",
    # Conditions with dotted tree codes: regions, nations and customers, of which some have two codes and some none.
    "condition": """
        select concat('R', cast(r_regionkey as varchar(20))) as condition, r_name as name, 'descriptor' as kind,
          cast(null as varchar(20)) as scr_class from {region}
        union all select concat('N', cast(n_nationkey as varchar(20))) as condition, n_name as name, 'descriptor' as kind,
          cast(null as varchar(20)) as scr_class from {nation}
        union all select concat('K', cast(c_custkey as varchar(20))) as condition, c_name as name,
          case when c_custkey % 11 = 0 then 'supplementary' else 'descriptor' end as kind,
          case when c_custkey % 11 = 0 then cast(1 + c_custkey % 3 as varchar(20)) end as scr_class from {customer}""",
    "region_tree": """
        select r_regionkey, concat(case r_regionkey % 3 when 0 then 'C' when 1 then 'F' else 'D' end,
          cast(r_regionkey as varchar(20))) as tree from {region}""",
    "tree_number": """
        select concat('R', cast(r_regionkey as varchar(20))) as condition, tree from {region_tree}
        union all select concat('N', cast(n_nationkey as varchar(20))) as condition,
          concat(tree, '.', cast(n_nationkey as varchar(20))) as tree
        from {nation} join {region_tree} on r_regionkey = n_regionkey
        union all select concat('K', cast(c_custkey as varchar(20))) as condition,
          concat(tree, '.', cast(n_nationkey as varchar(20)), '.', cast(c_custkey as varchar(20))) as tree
        from {customer} join {nation} on c_nationkey = n_nationkey join {region_tree} on r_regionkey = n_regionkey
        where c_custkey % 11 <> 0
        union all select concat('K', cast(c_custkey as varchar(20))) as condition,
          concat(tree, '.', cast(n_nationkey as varchar(20)), '.', cast(c_custkey as varchar(20))) as tree
        from {customer} join {nation} on (c_nationkey + 3) % 25 = n_nationkey join {region_tree} on r_regionkey = n_regionkey
        where c_custkey % 7 = 0 and c_custkey % 11 <> 0""",
    "cond_edge": """
        select distinct c.condition as child, p.condition as parent from {tree_number} as c
        join {tree_number} as p on p.tree = regexp_replace(c.tree, '[.][^.]*$', '') where c.tree <> p.tree""",
    "cond_axis": """
        select 'F' as rel, true as expands union all select 'O' as rel, true as expands
        union all select 'P' as rel, false as expands""",
    "cond_rule": f"""
        select distinct o_orderkey % n as subject, case when o_orderkey % 50 = 0 then concat('R', cast(o_orderkey % 5 as varchar(20)))
          when o_orderkey % 20 = 1 then concat('N', cast(o_custkey % 25 as varchar(20)))
          else concat('K', cast(o_custkey as varchar(20))) end as condition, o_orderstatus as rel,
          case when o_orderkey % 2 = 0 then 'S1' else 'S2' end as source, o_orderkey % n as run from {{orders}}, {_ENTITIES}""",
    "ind_axis": "select 'O' as rel, true as expands union all select 'F' as rel, false as expands",
    # 'X' has no axis and so licenses nothing.
    "indication": """
        select distinct l_suppkey as subject, case when l_orderkey % 97 = 0 then concat('N', cast(5 * (l_partkey % 5) as varchar(20)))
          else concat('K', cast(3 * (l_partkey % 400) as varchar(20))) end as condition,
          case when l_linenumber = 7 then 'X' else l_linestatus end as rel, 'S1' as source, l_suppkey as run from {lineitem}""",
    "cond_ruling": """
        select 100000 * subject + cast(substr(condition, 2) as bigint) + case when condition like 'R%' then 50000 else 0 end as id,
          subject, condition, case subject % 4 when 0 then 'spurious' when 1 then 'indicated' else 'contraindicated' end as ruling,
          case subject % 3 when 0 then 'major' else 'minor' end as severity,
          case when subject % 5 = 2 then 100000 * subject end as superseded_by
        from (select distinct subject, condition from {cond_rule}) as r where condition not like 'K%'
        union all select 900000000 + n_nationkey as id, n_nationkey as subject, 'K-1' as condition, 'indicated' as ruling,
          'minor' as severity, cast(null as bigint) as superseded_by from {nation}""",
    # Identity: claims of schemes, of which some are superseded; names that upstream releases gave.
    "claim": f"""
        select 3 * c_custkey as claim_id, c_custkey % n as entity, 'RXNORM_IN' as scheme,
          cast(2 * c_custkey as varchar(20)) as value, case when c_custkey % 9 = 0 then 3 * c_custkey + 1 end as superseded_by
        from {{customer}}, {_ENTITIES}
        union all select 3 * c_custkey + 1 as claim_id, (c_custkey * 3) % n as entity, 'UNII' as scheme,
          concat('U', cast(c_custkey % 700 as varchar(20))) as value, cast(null as bigint) as superseded_by
        from {{customer}}, {_ENTITIES}
        union all select 3 * c_custkey + 2 as claim_id, (c_custkey * 7) % n as entity, 'CAS' as scheme,
          concat(cast(c_custkey % 500 as varchar(20)), '-1') as value, cast(null as bigint) as superseded_by
        from {{customer}}, {_ENTITIES}""",
    "unmatched": """
        select cast(o_custkey as varchar(20)) as rxcui, case when o_orderkey % 3 = 0 then null else o_orderpriority end as name,
          o_orderkey % 90 as run, o_orderstatus as reason from {orders}""",
    "record": """
        select p_partkey as record, concat('U', cast(p_partkey % 1400 as varchar(20))) as unii,
          concat(cast(p_partkey % 900 as varchar(20)), '-1') as cas, p_name as name from {part}""",
    "composition": """
        select l_orderkey as composite, l_partkey as component, case max(l_returnflag) when 'A' then true when 'N' then false
          else cast(null as boolean) end as is_active from {lineitem} group by l_orderkey, l_partkey""",
    "product": "select p_partkey as product, p_name as name, concat(p_name, ' with ', p_type, ', ', p_name) as combined from {part}",
    # What ingests couldn't resolve.
    "unresolved_object": """
        select case when p_partkey % 2 = 0 then 'mesh' else 'MeSH' end as source, concat('D', cast(p_size as varchar(20))) as code,
          p_name as name, p_type as rel, p_brand as kind, 1 + p_partkey % 4 as assertions, p_partkey % 70 as run from {part}""",
    "unresolved_endpoint": """
        select 'ONCHIGH' as source, concat('e', cast(s_nationkey as varchar(20))) as entry,
          case when s_suppkey % 2 = 0 then 'subject' else 'object' end as role, 'UNII' as scheme,
          concat('U', cast(s_nationkey as varchar(20))) as value, s_name as name, s_suppkey % 30 as run from {supplier}""",
    "cell": """
        select 'FDACYP' as source, concat(p_name, ' ', p_type) as raw_substance,
          case when p_size % 4 = 0 then null else p_name end as substance, p_brand as heading,
          concat('cyp', cast(p_size % 6 as varchar(20))) as pathway,
          case p_partkey % 5 when 0 then 'member' when 1 then 'unresolved_substance' when 2 then 'combination_regimen'
            else 'withheld_qualified' end as disposition,
          case when p_partkey % 9 = 0 then null else concat('[', cast(p_size as varchar(20)), ']') end as markers,
          p_partkey % 20 as run from {part}""",
    # Releases and signatures.
    "snapshot_a": "select o_orderkey as k, o_orderstatus as kind, round(o_totalprice) as v from {orders} where o_orderkey % 97 <> 0",
    "snapshot_b": """
        select o_orderkey as k, o_orderstatus as kind, round(o_totalprice) + case when o_orderkey % 89 = 0 then 1 else 0 end as v
        from {orders} where o_orderkey % 101 <> 0""",
    "signature": """
        select o_orderkey as id, case when o_orderkey % 2 = 0 then 'ruling' else 'class_ruling' end as kind,
          o_custkey % 200 as target, o_custkey % 9 as key_id, o_orderdate as signed_at,
          o_orderdate + case when o_orderkey % 4 = 0 then interval '3' day else interval '2' hour end as recorded_at,
          o_orderkey % 17 <> 0 as digest_matches from {orders}""",
    # Key history: the live row of a key has no successor. One key was once compromised and is retired since.
    "signing_key": """
        select 1 as id, 0 as key_id, 'active' as status, timestamp '1992-01-01 00:00:00' as status_from, cast(null as int) as superseded_by
        union all select 2, 1, 'active', timestamp '1992-01-01 00:00:00', 3
        union all select 3, 1, 'retired', timestamp '1996-01-01 00:00:00', null
        union all select 4, 2, 'active', timestamp '1993-01-01 00:00:00', null
        union all select 5, 3, 'compromised', timestamp '1994-01-01 00:00:00', null
        union all select 6, 4, 'compromised', timestamp '1994-01-01 00:00:00', 7
        union all select 7, 4, 'retired', timestamp '1995-01-01 00:00:00', null
        union all select 8, 5, 'unlisted', timestamp '1995-01-01 00:00:00', null""",
    "key_status": """
        select 'active' as status, false as is_revocation, false as invalidates_all
        union all select 'retired', true, false union all select 'compromised', true, true""",
    # Questions that were open before, and what curators left on them.
    "old_question": """
        select 'unclassified_entity' as kind, concat('ENTITY:', cast(s_suppkey as varchar(20))) as gap_key, 'old text' as text,
          s_suppkey % 5 as first_run, 7 as last_run, s_suppkey % 2 = 0 as is_current from {supplier}""",
    "question_work": "select distinct concat('ENTITY:', cast(3 * (user_id % 50) as varchar(20))) as gap_key from {events}",
    "question_state": "select event_id as id, user_id as question, event_type as state from {events}",
}


def needed(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A relation, or a table of the driver's."""
    if name not in RELATIONS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark_sql(spark, sf_dir, RELATIONS[name])


def spark_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Spark SQL over relations and tables in braces."""
    sql = sql.replace("varchar(20)", "string")
    return spark.sql(sql, **{n: relation(spark, sf_dir, n) for n in needed(sql)})


def portable(sql: str, recursive: bool = False) -> str:
    """One statement for another engine: relations become common table expressions."""
    order: list[str] = []

    def visit(text: str) -> None:
        for n in needed(text):
            if n in RELATIONS and n not in order:
                visit(RELATIONS[n])
                order.append(n)

    visit(sql)
    plain = lambda s: re.sub(r"\{(\w+)\}", lambda m: ("r_" if m[1] in RELATIONS else "") + m[1], s).replace("varchar(20)", "varchar")
    ctes = [f"r_{n} as ({plain(RELATIONS[n])})" for n in order]
    body = plain(sql)
    own = re.match(r"\s*with\s+(recursive\s+)?", body, re.I)
    if own:
        ctes, body = [*ctes, ""], body[own.end() :]
        return f"with recursive {', '.join(ctes)}{body}" if ctes[:-1] else f"with recursive {body}"
    return f"with recursive {', '.join(ctes)} {body}" if ctes else body

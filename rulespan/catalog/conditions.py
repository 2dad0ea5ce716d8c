"""Conditions: tree codes, their hierarchy, and rules and indications read along it."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulespan.catalog.base import query, rel, walk
from rulespan.functions import text as T
from rulespan.operators import conditions, core, signing

ANCESTORS = """select condition, tree, unnest(list_transform(range(1, len(string_split(tree, '.'))),
  lambda i: array_to_string(string_split(tree, '.')[1:i], '.'))) as ancestor from {tree_number}"""


@query("tree_ancestors", ANCESTORS)
def _(spark, d):
    (trees,) = rel(spark, d, "tree_number")
    return trees.select("condition", "tree", F.explode(T.ancestors(F.col("tree"))).alias("ancestor"))


@query("tree_descendant_counts", f"select ancestor, count(*) as conditions from ({ANCESTORS}) as t group by 1")
def _(spark, d):
    (trees,) = rel(spark, d, "tree_number")
    return trees.select(F.explode(T.ancestors(F.col("tree"))).alias("ancestor")).groupBy("ancestor").agg(F.count("*").alias("conditions"))


@query("tree_edges", """select distinct c.condition as child, p.condition as parent from {tree_number} c, {tree_number} p
  where starts_with(c.tree, p.tree || '.') and strpos(substr(c.tree, length(p.tree) + 2), '.') = 0 and c.condition <> p.condition""")
def _(spark, d):
    return conditions.tree_edges(*rel(spark, d, "tree_number"))


@query("descriptor_closure", """select distinct c.condition from {tree_number} c join (select distinct t.tree from {tree_number} t
  join {cond_rule} r on r.condition = t.condition) p on starts_with(c.tree, p.tree || '.')""")
def _(spark, d):
    trees, rule = rel(spark, d, "tree_number", "cond_rule")
    return conditions.strictly_below(trees, trees.join(rule.select("condition").distinct(), "condition", "left_semi"))


@query("condition_subtree", f"with recursive {walk('select distinct condition as root from {cond_rule}', edge='cond_edge')} select root, node from tree")
def _(spark, d):
    trees, rule = rel(spark, d, "tree_number", "cond_rule")
    return core.closure(conditions.tree_edges(trees), rule.select(F.col("condition").alias("root")))


EXPANDED = f"""{walk('select distinct condition as root from {cond_rule}', edge='cond_edge')}, expanded as (
  select r.subject, r.condition as object, t.node as member, t.node = r.condition as is_direct, r.rel, r.source
  from {{cond_rule}} r join tree t on t.root = r.condition
  where r.rel in (select rel from {{cond_axis}} where expands) or (t.node = r.condition and r.rel in (select rel from {{cond_axis}})))"""


@query("expanded_conditions", f"with recursive {EXPANDED} select * from expanded")
def _(spark, d):
    trees, rule, axis = rel(spark, d, "tree_number", "cond_rule", "cond_axis")
    return conditions.expanded_rules(rule, axis, conditions.tree_edges(trees))


@query("contraindications_for_condition", f"""with recursive {EXPANDED}
  select * from expanded where member in (select concat('K', o_custkey) from {{orders}})""")
def _(spark, d):
    trees, rule, axis, orders = rel(spark, d, "tree_number", "cond_rule", "cond_axis", "orders")
    asked = orders.select(F.concat(F.lit("K"), F.col("o_custkey")).alias("condition"))
    return conditions.rules_for(asked, rule, axis, conditions.tree_edges(trees))


INDICATED = f"""{walk('select condition as root from {condition}', 'above', edge='cond_edge', up=True)}, indicated as (
  select i.subject, i.condition as object, a.root as member, a.node = a.root as is_direct, i.rel, i.source
  from above a join {{indication}} i on i.condition = a.node join {{ind_axis}} x on x.rel = i.rel where x.expands or a.node = a.root)"""


@query("indications_for_condition", f"with recursive {INDICATED} select * from indicated")
def _(spark, d):
    trees, indication, axis, condition = rel(spark, d, "tree_number", "indication", "ind_axis", "condition")
    return conditions.rules_for(condition.select("condition"), indication, axis, conditions.tree_edges(trees))


IND_REACH = f"""{INDICATED}, ind_reach as (
  select c.condition, count(*) filter (where i.is_direct) as direct_rules, count(*) filter (where not i.is_direct) as generalised_rules
  from {{condition}} c left join indicated i on i.member = c.condition group by c.condition)"""


def indication_reach(spark, d):
    condition, indication, axis, trees = rel(spark, d, "condition", "indication", "ind_axis", "tree_number")
    return conditions.indication_reach(condition, indication, axis, conditions.tree_edges(trees))


query("indication_reach", f"with recursive {IND_REACH} select * from ind_reach")(indication_reach)


@query("contradictions", "select subject, condition from {cond_rule} intersect select subject, condition from {indication}")
def _(spark, d):
    return conditions.contradictions(*rel(spark, d, "cond_rule", "indication"))


@query("curated_rulings", """with signed as (
    select s.target, case when bool_or(k.key_id = 0 or k.key_id = 2) then 'signed' when bool_or(k.key_id is null) then 'signed_by_unknown_key'
      else 'signed_by_revoked_key' end as status
    from (select 100000 * (target % 60) + target % 25 as target, key_id from {signature} where key_id not in (1, 3, 4, 5)) s
    left join (select distinct key_id from {signing_key}) k on k.key_id = s.key_id group by s.target),
  candidates as (select subject, condition, rel, source, 'contraindication' as candidate from {cond_rule}
    union all select subject, condition, rel, source, 'indication' as candidate from {indication})
  select r.id, r.subject, r.condition, r.ruling, r.severity, c.candidate, c.rel, c.source, coalesce(s.status, 'unsigned') as status
  from {cond_ruling} r join candidates c on c.subject = r.subject and c.condition = r.condition left join signed s on s.target = r.id
  where r.superseded_by is null and r.ruling in ('indicated', 'contraindicated')""")
def _(spark, d):
    ruling, rule, indication, signature, keys, statuses = rel(spark, d, "cond_ruling", "cond_rule", "indication", "signature", "signing_key", "key_status")
    # Signatures of keys that were never revoked, and of unknown ones, over the ids of rulings.
    over = signature.where("key_id not in (1, 3, 4, 5)").withColumn("target", F.expr("100000 * (target % 60) + target % 25"))
    status = signing.signature_status(over.withColumn("kind", F.lit("cond_ruling")), keys, statuses)
    return conditions.curated_rulings(ruling, rule, indication, status)

"""Names, ids and the resolution of identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulespan.catalog.base import query, rel, uuid_sql
from rulespan.functions import text as T
from rulespan.operators import identity

CLAIMED = "(select distinct value, entity from {{claim}} where superseded_by is null and scheme = '{0}')"
UNII, CAS, RXNORM = (CLAIMED.format(x) for x in ("UNII", "CAS", "RXNORM_IN"))
TIERS = [("unii", "UNII"), ("cas", "CAS")]
UNII, CAS, RXNORM = (x.replace("{{", "{").replace("}}", "}") for x in (UNII, CAS, RXNORM))


@query("many_valued_keys", f"select u.rxcui, count(*) as n, count(distinct c.entity) as entities from {{unmatched}} u join {RXNORM} c on c.value = u.rxcui group by 1")
def _(s, d):
    unmatched, claim = rel(s, d, "unmatched", "claim")
    rows = identity.many_valued(unmatched, "rxcui", claim, "RXNORM_IN")
    return rows.groupBy("rxcui").agg(F.count("*").alias("n"), F.countDistinct("entity").alias("entities"))


ALL_TIERS = f"""select r.record, r.unii, r.cas, c.entity, 'UNII' as method from {{record}} r join {UNII} c on c.value = r.unii
  union select r.record, r.unii, r.cas, c.entity, 'CAS' as method from {{record}} r join {CAS} c on c.value = r.cas
  where not exists (select 1 from {UNII} u where u.value = r.unii)"""


@query("resolve_by_tier", ALL_TIERS)
def _(s, d):
    record, claim = rel(s, d, "record", "claim")
    return identity.by_tier(record.select("record", "unii", "cas"), TIERS, claim)


@query("resolve_first", f"""select r.record, min(x.entity) as entity, min(x.method) as method
  from {{record}} r left join ({ALL_TIERS}) x on x.record = r.record group by r.record""")
def _(s, d):
    record, claim = rel(s, d, "record", "claim")
    return identity.first_by_tier(record.select("record", "unii", "cas"), "record", TIERS, claim)


COLOURS = ["green", "blue", "red", "ring", "bolt"]
STRIPPED = "regexp_replace(lower(r.name), '\\s+(green|blue|red|ring|bolt)$', '')"


@query("resolve_name", f"""with claimed as (select distinct lower(p_name) as name, p_partkey % 7 as entity from {{part}} where p_size < 25
    union select distinct regexp_replace(lower(p_name), ' .*$', '') as name, 100 + p_partkey % 3 as entity from {{part}} where p_size >= 25)
  select r.record, c.entity, 'exact' as method from {{record}} r join claimed c on c.name = lower(r.name)
  union all select r.record, c.entity, 'salt_stripped' as method from {{record}} r join claimed c on c.name = {STRIPPED}
  where {STRIPPED} <> lower(r.name) and not exists (select 1 from claimed x where x.name = lower(r.name))""")
def _(s, d):
    record, part = rel(s, d, "record", "part")
    few = part.where("p_size < 25").select(F.lower("p_name").alias("name"), (F.col("p_partkey") % 7).alias("entity"))
    many = part.where("p_size >= 25").select(F.split(F.lower("p_name"), " ")[0].alias("name"), (100 + F.col("p_partkey") % 3).alias("entity"))
    names = record.select("record", T.normalise_name(F.col("name")).alias("name"))
    return identity.by_name(names, "name", few.unionByName(many), T.strip_suffix(F.col("name"), COLOURS)).select("record", "entity", "method")


@query("unique_or_unresolved", """select scheme, lower(value) as value, count(distinct entity) as claimants,
  case when min(entity) = max(entity) then min(entity) end as entity from {claim} where superseded_by is null group by 1, 2""")
def _(s, d):
    claim = rel(s, d, "claim")[0].where("superseded_by is null").select("scheme", F.lower("value").alias("value"), "entity")
    return identity.unique_or_unresolved(claim, ["scheme", "value"])


@query("identity_buckets", f"""with hits as (select r.record, c.entity from {{record}} r join {UNII} c on c.value = r.unii
    union select r.record, c.entity from {{record}} r join {CAS} c on c.value = r.cas),
  named as (select distinct r.record, p.p_size as entity from {{record}} r join {{part}} p on p.p_name = r.name and p.p_brand = 'Brand#1'),
  n as (select r.record, (select count(*) from hits h where h.record = r.record) as c, (select count(*) from named h where h.record = r.record) as m from {{record}} r)
  select record, case when c = 1 then 'resolved_exact_claim' when c > 1 then 'ambiguous_identity' when m = 1 then 'candidate_unique_name'
    when m > 1 then 'ambiguous_name' else 'unresolved' end as bucket, greatest(c, case when c = 0 then m else 0 end) as matches from n""")
def _(s, d):
    record, claim, part = rel(s, d, "record", "claim", "part")
    claimed = identity.many_valued(record, "unii", claim, "UNII").select("record", "entity").unionByName(identity.many_valued(record, "cas", claim, "CAS").select("record", "entity"))
    named = record.join(part.where("p_brand = 'Brand#1'").select(F.col("p_name").alias("name"), F.col("p_size").alias("entity")), "name").select("record", "entity")
    return identity.bucketed(record, "record", claimed, named)


@query("salt_forms", """select subject, subject as form from (select distinct l_partkey as subject from {lineitem} where l_linenumber = 1) as a
  union select component as subject, composite as form from {composition} where is_active
    and component in (select l_partkey from {lineitem} where l_linenumber = 1)""")
def _(s, d):
    lineitem, composition = rel(s, d, "lineitem", "composition")
    return identity.with_forms(lineitem.where("l_linenumber = 1").select(F.col("l_partkey").alias("subject")).distinct(), composition)


@query("active_components", "select composite, component from {composition} where coalesce(is_active, false)")
def _(s, d):
    return rel(s, d, "composition")[0].where("is_active is true").select("composite", "component")


@query("name_components", """with parts as (select product, unnest(string_split(regexp_replace(regexp_replace(combined, '\\([^)]*\\)', ' ', 'g'), ' with ', ',', 'g'), ',')) as x from {product})
  select distinct product, regexp_replace(lower(trim(x)), '\\s+', ' ', 'g') as component from parts where trim(x) <> ''""")
def _(s, d):
    return rel(s, d, "product")[0].select("product", F.explode(T.components(F.col("combined"))).alias("component"))


@query("normalise_name", "select product, array_to_string(list_filter(string_split(lower(name), ' '), lambda x: x <> ''), ' ') as name from {product}")
def _(s, d):
    return rel(s, d, "product")[0].select("product", T.normalise_name(F.col("name")).alias("name"))


@query("salt_strip", """select product, case when regexp_matches(name, '^.+ (green|blue|red|ring|bolt)$')
  then regexp_replace(name, ' (green|blue|red|ring|bolt)$', '') end as stripped from {product}""")
def _(s, d):
    return rel(s, d, "product")[0].select("product", T.strip_suffix(F.col("name"), COLOURS).alias("stripped"))


PRODUCT_KEY = "'PRODUCT:' || cast(product as varchar)"


@query("uuid5_ids", f"select product, {uuid_sql(PRODUCT_KEY)} as id from {{product}}")
def _(s, d):
    return rel(s, d, "product")[0].select("product", T.uuid5(F.concat(F.lit("PRODUCT:"), F.col("product").cast("string"))).alias("id"))


@query("admission_signals", """with s as (select p_partkey as entity, unnest([case when p_size % 7 = 0 then '1INN_ID' end, case when p_size % 5 = 0 then '2USAN_ID' end,
    case when p_size % 2 = 0 and p_partkey % 3 = 0 then '3RXCUI' end, case when p_partkey % 41 = 0 then '4LEGACY_ALLOWLIST' end]) as x from {part})
  select entity, coalesce(string_agg(substr(x, 2), ',' order by x), '') as signals from s group by entity""")
def _(s, d):
    kind = F.when(F.expr("p_partkey % 3 = 0"), "chemical").otherwise("mixture")
    signals = T.admission_signals(F.expr("p_size % 7 = 0"), F.expr("p_size % 5 = 0"), F.expr("p_size % 2 = 0"), kind, F.expr("p_partkey % 41 = 0"))
    return rel(s, d, "part")[0].select(F.col("p_partkey").alias("entity"), F.array_join(signals, ",").alias("signals"))


@query("disposition", """select p_partkey as entity, case when p_size % 10 = 0 then 'non_drug_entity'
  when regexp_matches(lower(p_type || ' and ' || p_brand), '\\band\\b') and p_partkey % 4 = 0 then 'combination_regimen'
  when p_partkey % 3 = 0 then 'unresolved_substance' when p_partkey % 5 = 0 then 'withheld_qualified' else 'member' end as disposition from {part}""")
def _(s, d):
    name = F.when(F.expr("p_partkey % 4 = 0"), F.concat_ws(" And ", "p_type", "p_brand")).otherwise(F.concat_ws("band", "p_type", "p_brand"))
    markers = F.when(F.expr("p_partkey % 5 = 0"), F.array(F.lit("a"))).otherwise(F.array().cast("array<string>"))
    return rel(s, d, "part")[0].select(F.col("p_partkey").alias("entity"), T.disposition(F.expr("p_size % 10 = 0"), name, F.expr("p_partkey % 3 <> 0"), markers).alias("disposition"))


@query("canonical_source", """select p_partkey, case upper(trim(p_brand || ' ')) when 'BRAND#1' then 'FIRST' when 'BRAND#2' then 'FIRST' else upper(p_brand) end as source,
  case when p_size % 2 = 0 then upper(p_name) else p_name end as value from {part}""")
def _(s, d):
    source = T.canonical_source(F.concat(F.lower("p_brand"), F.lit(" ")), {"BRAND#1": "FIRST", "BRAND#2": "FIRST"})
    value = T.canonical_value(F.when(F.expr("p_size % 2 = 0"), "unii").otherwise("NAME"), F.concat(F.lit(" "), F.col("p_name")))
    return rel(s, d, "part")[0].select("p_partkey", source.alias("source"), value.alias("value"))


@query("registry_numbers", """select p_partkey, case when length(n) = 10 and n = upper(n) and strpos(n, '-') = 0 then 'UNII'
    when regexp_full_match(n, '[0-9]{1,7}-[0-9][0-9]-[0-9]') then 'CAS' end as kind, n as value from (
  select p_partkey, case p_partkey % 4 when 0 then lpad(cast(p_partkey as varchar), 10, 'X') when 1 then cast(100 + p_partkey as varchar) || '-12-' || cast(p_partkey % 10 as varchar)
    when 2 then '12345678-12-1' else 'abcdefghij' end as n from {part}) as x""")
def _(s, d):
    k = F.col("p_partkey")
    n = F.when(k % 4 == 0, F.lpad(k.cast("string"), 10, "X")).when(k % 4 == 1, F.concat((100 + k).cast("string"), F.lit("-12-"), (k % 10).cast("string")))
    n = n.when(k % 4 == 2, F.lit("12345678-12-1")).otherwise("abcdefghij")
    kind, value = T.registry_number(F.concat(n, F.lit(" (old)")))
    return rel(s, d, "part")[0].select("p_partkey", kind.alias("kind"), value.alias("value"))


@query("accent_fold", """select p_partkey, p_name || ' cafe uber ' || cast(p_partkey as varchar) || ' strasse' as name from {part}""")
def _(s, d):
    raw = F.concat(F.upper("p_name"), F.lit("--Café&nbsp;&Uuml;ber ("), F.col("p_partkey").cast("string"), F.lit(") Straße!"))
    return rel(s, d, "part")[0].select("p_partkey", T.accent_folded(raw).alias("name"))


@query("even_sample", """with o as (select c_custkey, row_number() over (order by c_custkey) - 1 as i, count(*) over () as n from {customer}),
  k as (select unnest(range(0, 37)) as j)
  select distinct c_custkey from o join k on o.i = cast(round_even(k.j * (o.n - 1) / 36.0, 0) as bigint)""")
def _(s, d):
    return T.even_sample(rel(s, d, "customer")[0].select("c_custkey"), "c_custkey", 37)


@query("key_formats", """select subject, object, rel, 'ENTITY:' || cast(subject as varchar) || '/CLASS:' || cast(object as varchar) || '/AXIS:' || rel as key from (select distinct subject, object, rel from {rule})""")
def _(s, d):
    rule = rel(s, d, "rule")[0].select("subject", "object", "rel").distinct()
    key = T.rendered_key(("ENTITY", F.col("subject")), ("CLASS", F.col("object")), ("AXIS", F.col("rel")))
    parts = T.parsed_key(F.col("key"), ("ENTITY", "CLASS", "AXIS"))
    # Keys are read back from their rendering.
    rows = rule.withColumn("key", key).select(parts.alias("parts"), "key")
    return rows.select(F.col("parts.ENTITY").cast("long").alias("subject"), F.col("parts.CLASS").cast("long").alias("object"), F.col("parts.AXIS").alias("rel"), "key")

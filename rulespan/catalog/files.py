"""Readers and ingests, over files that are written from the driver's tables and read back."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rulespan.catalog.base import query, rel, uuid_sql
from rulespan.operators import core, ingest
from rulespan.plans.adapters import spark_sql
from rulespan.plans.steps import new_path
from rulespan.sources import base, pages, records, tables


def _lines(spark: SparkSession, d: str, tag: str, *sqls: str, compression: str | None = None) -> str:
    """A folder of text files that holds the lines of all statements."""
    path = new_path(spark, f"file-{tag}")
    for sql in sqls:
        spark_sql(spark, d, sql).write.mode("append").text(path, compression=compression or "none")
    return path


def _document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's elements as the lines of one document."""
    lines = lambda text: pa.RecordBatch.from_arrays([text], names=["value"])
    yield lines(pa.array(['<?xml version="1.0"?>', "<root>"]))
    # Batches of a column that can't be null have another schema.
    yield from (lines(b.column(0)) for b in batches)
    yield lines(pa.array(["</root>"]))


def _xml(spark: SparkSession, d: str, tag: str, *sqls: str, compression: str | None = None) -> str:
    """A folder of documents, one for each task, that hold the elements of all statements under a root: no task gathers others' elements."""
    path = new_path(spark, f"file-{tag}")
    for sql in sqls:
        spark_sql(spark, d, sql).select("value").mapInArrow(_document, "value string").write.mode("append").text(path, compression=compression or "none")
    return path


def _delimited(spark: SparkSession, d: str, tag: str, sql: str, sep: str, **options) -> str:
    path = new_path(spark, f"file-{tag}")
    spark_sql(spark, d, sql).write.csv(path, sep=sep, header=True, emptyValue="", nullValue="", **options)
    return path


# Substances: blank identifiers, quotes as plain characters, every strength of signal.
SUBSTANCE = """select case when p_partkey % 50 = 0 then '' else concat('u', lpad(cast(p_partkey as varchar(20)), 9, '0')) end as UNII,
  concat(' ', upper(p_name), '  "', cast(p_partkey as varchar(20)), '" ') as `Display Name`, case when p_partkey % 3 = 0 then concat(cast(p_partkey as varchar(20)), '-11-1') else '' end as RN,
  case when p_size % 2 = 0 then cast(2 * p_partkey as varchar(20)) else '' end as RXCUI, '' as PUBCHEM, case when p_size % 7 = 0 then '9' else '' end as INN_ID,
  case when p_size % 5 = 0 then 'AB' else '' end as USAN_ID, concat('ik', cast(p_partkey % 500 as varchar(20))) as INCHIKEY,
  case p_partkey % 4 when 0 then 'chemical' when 1 then 'protein' when 2 then 'mixture' else '' end as SUBSTANCE_TYPE, p_brand as ignored from {part}"""
READ_SUBSTANCE = """substance as (select p_partkey, case when p_partkey % 50 <> 0 then 'u' || lpad(cast(p_partkey as varchar), 9, '0') end as unii,
  upper(p_name) || '  "' || cast(p_partkey as varchar) || '"' as name, p_size % 7 = 0 as has_inn, p_size % 5 = 0 as has_usan,
  case p_partkey % 4 when 0 then 'chemical' when 1 then 'protein' when 2 then 'mixture' end as substance_type,
  case when p_partkey % 3 = 0 then cast(p_partkey as varchar) || '-11-1' end as cas, case when p_size % 2 = 0 then cast(2 * p_partkey as varchar) end as rxcui, p_name,
  'ik' || cast(p_partkey % 500 as varchar) as inchikey from {part}),
entity as (select *, (unii is not null and (has_inn or has_usan or (rxcui is not null and coalesce(substance_type, '') in ('chemical', 'protein')) or p_partkey % 41 = 0)) as admitted from substance)"""


def _substances(s, d):
    return tables.substances(s, _delimited(s, d, "unii", SUBSTANCE, "\t", quote="", escape=""))


@query("src_unii", f"with {READ_SUBSTANCE} select unii, name, has_inn, has_usan, substance_type, cas, rxcui, inchikey from substance")
def _(s, d):
    refs = {"CAS": "cas", "RXNORM_IN": "rxcui", "INCHIKEY": "inchikey"}
    return _substances(s, d).select("unii", "name", "has_inn", "has_usan", "substance_type", *[F.col("refs")[k].alias(v) for k, v in refs.items()])


def _admitted(s, d):
    allowed = rel(s, d, "part")[0].where("p_partkey % 41 = 0").select(F.concat(F.lit("U"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("unii"))
    crosswalk = s.createDataFrame([('small ring "0"', "unused"), ('red widget "1"', "rot")], "name string, inn string")
    return ingest.substances(_substances(s, d), allowed, crosswalk)


UNII_KEY = "'UNII:' || upper(unii)"


@query("ingest_unii", f"""with {READ_SUBSTANCE} select {uuid_sql(UNII_KEY)} as entity, unii, substance_type,
  case when p_partkey = 1 and p_name = 'red widget' then 'rot' else lower(regexp_replace(name, '\\s+', ' ', 'g')) end as name from entity where admitted""")
def _(s, d):
    return _admitted(s, d)["entities"]


@query("ingest_unii_claims", f"""with {READ_SUBSTANCE}, c as (select unii, unnest([struct_pack(scheme := 'UNII', value := upper(unii)), struct_pack(scheme := 'CAS', value := cas),
    struct_pack(scheme := 'RXNORM_IN', value := rxcui), struct_pack(scheme := 'INCHIKEY', value := upper(inchikey))]) as x from entity where admitted)
  select {uuid_sql(UNII_KEY)} as entity, x.scheme as scheme, x.value as value from c where x.value is not null""")
def _(s, d):
    return _admitted(s, d)["claims"]


@query("ingest_unii_counts", f"""with {READ_SUBSTANCE} select count(*) as read, count(*) filter (where unii is null) as without_identity,
  count(*) filter (where admitted) as admitted, count(*) filter (where unii is not null and not admitted) as refused from entity""")
def _(s, d):
    return _admitted(s, d)["counts"]


# Structures: several entities may claim one, and some have the claim already.
STRUCTURE = "select concat('chebi:', cast(s_suppkey as varchar(20))) as CHEBI_ID, concat(' IK', cast(s_suppkey % 40 as varchar(20))) as INCHIKEY from {supplier}"
STRUCTURE_CLAIM = """select s_suppkey as entity, 'INCHIKEY' as scheme, concat('IK', cast(s_suppkey % 60 as varchar(20))) as value, case when s_suppkey % 7 = 0 then 1 end as superseded_by from {supplier}
  union all select s_suppkey as entity, 'CHEBI' as scheme, concat('CHEBI:', cast(s_suppkey as varchar(20))) as value, null as superseded_by from {supplier} where s_nationkey < 12"""


@query("ingest_chebi", f"""with claim as ({STRUCTURE_CLAIM}) select distinct c.entity, 'CHEBI' as scheme, 'CHEBI:' || cast(s_suppkey as varchar) as value
  from {{supplier}} s join claim c on c.scheme = 'INCHIKEY' and c.superseded_by is null and c.value = 'IK' || cast(s.s_suppkey % 40 as varchar)
  where not exists (select 1 from claim x where x.scheme = 'CHEBI' and x.entity = c.entity and x.value = 'CHEBI:' || cast(s.s_suppkey as varchar))""")
def _(s, d):
    rows = tables.structures(s, _delimited(s, d, "chebi", STRUCTURE, "\t"))
    return ingest.structures(rows, spark_sql(s, d, STRUCTURE_CLAIM))["claims"]


# A concept release: inactive and unidentified concepts, other owners, codes that two claim, ends that aren't there.
CONCEPTS = """select concat('<concept><namespace>', case when p_partkey % 29 = 3 then 'Other' else 'MED-RT' end, '</namespace><name>', p_name, '</name><code>',
  case when p_partkey % 31 = 4 then '' when p_partkey % 31 = 5 then concat('C', cast(p_partkey - 1 as varchar(20))) when p_partkey % 31 = 6 then 'C5' else concat('C', cast(p_partkey as varchar(20))) end,
  '</code><status>', case when p_partkey % 23 = 7 then 'I' else 'A' end, '</status><property><name>CTY</name><value>',
  case p_partkey % 4 when 0 then 'PE' when 1 then 'MoA' when 2 then 'EPC' else 'XX' end, '</value></property>',
  case when p_partkey % 31 = 4 and p_partkey % 2 = 0 then '' else concat('<property><name>NUI</name><value>N', cast(p_partkey as varchar(20)), '</value></property>') end, '</concept>') as value from {part}"""
ASSOCIATION = "select concat('<association><name>', name, '</name><from_namespace>', fns, '</from_namespace><from_code>', fc, '</from_code><to_namespace>', tns, '</to_namespace><to_code>', tc, '</to_code></association>') as value from ({0}) as a"
LINKS = """select 'Parent Of' as name, 'MED-RT' as fns, concat('C', cast(cast(floor(p_partkey / 2) as bigint) as varchar(20))) as fc, 'MED-RT' as tns, concat('C', cast(p_partkey as varchar(20))) as tc from {part}
  union all select 'Parent Of' as name, 'MED-RT' as fns, concat('C', cast(p_partkey as varchar(20))) as fc, 'RxNorm' as tns, cast(p_partkey * 3 as varchar(20)) as tc from {part}
  union all select case l_linenumber when 1 then 'has_MoA' when 2 then 'CI_PE' when 3 then 'CI_with' when 4 then 'CI_ChemClass' when 5 then 'may_treat' when 6 then 'induces' else 'odd' end as name,
    'RxNorm' as fns, cast(2 * l_suppkey as varchar(20)) as fc, case when l_linenumber in (1, 2) then 'MED-RT' when l_orderkey % 19 = 0 then 'Elsewhere' else 'MeSH' end as tns,
    case when l_linenumber in (1, 2) then concat('C', cast(l_partkey as varchar(20))) else concat('M', cast(l_partkey % 300 as varchar(20))) end as tc from {lineitem}"""
RELEASE = f"""links as ({LINKS}), own as (select p_partkey as k, p_name as name, case when p_partkey % 31 = 4 then '' when p_partkey % 31 = 5 then 'C' || cast(p_partkey - 1 as varchar)
    when p_partkey % 31 = 6 then 'C5' else 'C' || cast(p_partkey as varchar) end as code, p_partkey % 23 <> 7 as active, ['PE', 'MoA', 'EPC', 'XX'][p_partkey % 4 + 1] as concept_type,
    case when p_partkey % 31 = 4 and p_partkey % 2 = 0 then null else 'N' || cast(p_partkey as varchar) end as nui from {{part}} where p_partkey % 29 <> 3),
  class as (select coalesce(nui, nullif(code, '')) as nui, coalesce(nullif(code, ''), nui) as code, name, concept_type from own where active and concept_type <> 'XX' and coalesce(nui, nullif(code, '')) is not null),
  code as (select code, min(nui) as nui, bool_or(concept_type = 'EPC') as epc from class group by code having min(nui) = max(nui)),
  member as (select distinct l.fc as rxcui, c.nui, l.name as rel from links l join code c on c.code = l.tc where l.name = 'has_MoA'
    union all select l.tc as rxcui, c.nui, 'has_EPC' as rel from links l join code c on c.code = l.fc and c.epc where l.tns = 'RxNorm')"""


def _release(s, d):
    return records.concept_release(s, _xml(s, d, "medrt", CONCEPTS, ASSOCIATION.format(LINKS), compression="gzip"))


@query("src_medrt_classes", f"with {RELEASE} select * from class")
def _(s, d):
    return _release(s, d)["classes"]


@query("src_medrt_edges", f"with {RELEASE} select c.nui as child, p.nui as parent from links l join code p on p.code = l.fc join code c on c.code = l.tc where l.name = 'Parent Of' and l.tns = 'MED-RT'")
def _(s, d):
    return _release(s, d)["parents"]


@query("src_medrt_counts", f"""with {RELEASE} select (select string_agg(distinct concept_type, ',') from own where concept_type = 'XX') as skipped_types,
  (select count(*) from own where not active and concept_type <> 'XX') as inactive, (select count(*) from own where active and concept_type <> 'XX' and nui is null and code = '') as unidentified,
  (select count(*) from (select code from class group by code having count(distinct nui) > 1)) as ambiguous_codes,
  (select count(*) from links where name in ('CI_with', 'CI_ChemClass') and tns = 'Elsewhere') as other_contraindications,
  (select count(*) from links where name in ('may_treat', 'induces') and tns = 'Elsewhere') as other_indications, 'odd' as skipped_predicates""")
def _(s, d):
    return _release(s, d)["counts"]


CLASS_KEY = "'MEDRT:' || upper(m.nui)"
RX = "(select distinct value, entity from {claim} where scheme = 'RXNORM_IN' and superseded_by is null)"


@query("ingest_medrt", f"with {RELEASE} select distinct c.entity, {uuid_sql(CLASS_KEY)} as concept, m.rel as axis from member m join {RX} c on c.value = m.rxcui")
def _(s, d):
    return ingest.concept_release(_release(s, d), rel(s, d, "claim")[0])["memberships"]


@query("ingest_medrt_unmatched", f"""with {RELEASE} select distinct rxcui, reason from (select rxcui, 'classified' as reason from member
    union all select l.fc as rxcui, 'contraindicated' as reason from links l join code c on c.code = l.tc where l.name = 'CI_PE') as x where rxcui not in (select value from {RX})""")
def _(s, d):
    return ingest.concept_release(_release(s, d), rel(s, d, "claim")[0])["unmatched"]


# Subject headings: descriptors with codes and keys, supplementary records without, in compressed files.
HEADING = """select concat('<DescriptorRecord DescriptorClass="1"><DescriptorUI>D', cast(p_partkey as varchar(20)), '</DescriptorUI><DescriptorName><String>', p_name, '</String></DescriptorName><ConceptList><Concept PreferredConceptYN="Y"><ConceptUI>M',
  cast(p_partkey % 300 as varchar(20)), '</ConceptUI><ConceptName><String>x</String></ConceptName><RegistryNumber>', case p_partkey % 5 when 0 then '0' when 1 then lpad(cast(p_partkey as varchar(20)), 10, 'U') when 2 then concat(cast(p_partkey % 500 as varchar(20)), '-11-1 (name)') else concat(cast(p_partkey % 500 as varchar(20)), '-11-1') end,
  '</RegistryNumber></Concept></ConceptList><TreeNumberList><TreeNumber>', case when p_partkey % 3 = 0 then 'C' else 'D' end, cast(p_size as varchar(20)), '</TreeNumber><TreeNumber>F', cast(p_size as varchar(20)), '.', cast(p_partkey as varchar(20)), '</TreeNumber></TreeNumberList></DescriptorRecord>') as value from {part}"""
EXTRA = """select concat('<SupplementalRecord SCRClass="', cast(1 + s_suppkey % 3 as varchar(20)), '"><SupplementalRecordUI>S', cast(s_suppkey as varchar(20)), '</SupplementalRecordUI><SupplementalRecordName><String>', s_name, '</String></SupplementalRecordName><ConceptList><Concept PreferredConceptYN="N"><ConceptUI>M',
  cast(250 + s_suppkey as varchar(20)), '</ConceptUI><RegistryNumber>0</RegistryNumber></Concept></ConceptList></SupplementalRecord>') as value from {supplier}"""
ACTION = """select concat('<PharmacologicalAction><DescriptorReferredTo>', case when r_regionkey = 3 then '' else concat('<DescriptorUI>D', cast(r_regionkey as varchar(20)), '</DescriptorUI>') end, '<DescriptorName><String>', r_name,
  '</String></DescriptorName></DescriptorReferredTo><PharmacologicalActionSubstanceList>', list, '</PharmacologicalActionSubstanceList></PharmacologicalAction>') as value
  from {region} join (select p_partkey % 5 as of, array_join(array_sort(collect_list(concat('<Substance><RecordUI>D', cast(p_partkey as varchar(20)), '</RecordUI><RecordName><String>n</String></RecordName></Substance>'))), '') as list from {part} group by p_partkey % 5) as m on m.of = r_regionkey"""
KEYED = """keyed as (select p_partkey as k, 'D' || cast(p_partkey as varchar) as ui, p_name as name, case when p_partkey % 5 = 1 then lpad(cast(p_partkey as varchar), 10, 'U') end as unii,
  case when p_partkey % 5 > 1 then cast(p_partkey % 500 as varchar) || '-11-1' end as cas, case when p_partkey % 3 = 0 then 'C' else 'D' end || cast(p_size as varchar) as tree from {part}),
identity as (select s_suppkey as entity, 'UNII' as scheme, lpad(cast(s_suppkey * 11 as varchar), 10, 'U') as value from {supplier} union all select s_suppkey as entity, 'CAS' as scheme, cast(s_suppkey * 2 as varchar) || '-11-1' as value from {supplier}
  union all select s_suppkey as entity, 'RXNORM_IN' as scheme, cast(4 * s_suppkey as varchar) as value from {supplier})"""
IDENTITY = """select s_suppkey as entity, 'UNII' as scheme, lpad(cast(s_suppkey * 11 as varchar(20)), 10, 'U') as value, cast(null as int) as superseded_by from {supplier}
  union all select s_suppkey, 'CAS', concat(cast(s_suppkey * 2 as varchar(20)), '-11-1'), null from {supplier} union all select s_suppkey, 'RXNORM_IN', cast(4 * s_suppkey as varchar(20)), null from {supplier}"""


def _headings(s, d):
    one = records.headings(s, _xml(s, d, "desc", HEADING, compression="gzip"))
    return one.unionByName(records.headings(s, _xml(s, d, "supp", EXTRA), "SupplementalRecord"))


@query("src_mesh", f"""with {KEYED} select ui, name, 'descriptor' as kind, null as scr_class, tree || ' F' || cast(p_size as varchar) || '.' || cast(k as varchar) as trees, coalesce(unii, '') as uniis, coalesce(cas, '') as cas,
    'M' || cast(k % 300 as varchar) || 'true' as concepts from keyed join {{part}} on p_partkey = k
  union all select 'S' || cast(s_suppkey as varchar) as ui, s_name as name, 'supplementalrecord' as kind, cast(1 + s_suppkey % 3 as varchar) as scr_class, '' as trees, '' as uniis, '' as cas, 'M' || cast(250 + s_suppkey as varchar) || 'false' as concepts from {{supplier}}""")
def _(s, d):
    joined = [F.array_join(c, " ").alias(c) for c in ("trees", "uniis", "cas")]
    concepts = F.array_join(F.transform("concepts", lambda c: F.concat(c["ui"], c["preferred"].cast("string"))), " ").alias("concepts")
    return _headings(s, d).select("ui", "name", "kind", "scr_class", *joined, concepts)


def _actions(s, d):
    return ingest.actions(records.actions(s, _xml(s, d, "pa", ACTION)), _headings(s, d), spark_sql(s, d, IDENTITY))


MESH_KEY = "'MESH:D' || cast(k % 5 as varchar)"
RESOLVED = f"""{KEYED}, found as (select k.k, k.ui, i.entity from keyed k join identity i on i.scheme = 'UNII' and i.value = k.unii
  union select k.k, k.ui, i.entity from keyed k join identity i on i.scheme = 'CAS' and i.value = k.cas)"""


@query("ingest_mesh_actions", f"with {RESOLVED} select distinct entity, {uuid_sql(MESH_KEY)} as concept, 'has_PA' as axis from found where k % 5 <> 3")
def _(s, d):
    return _actions(s, d)["memberships"]


@query("ingest_mesh_counts", f"""with {RESOLVED} select (select count(*) from {{region}}) - 1 as classes, (select count(*) from (select distinct entity, k % 5 from found where k % 5 <> 3)) as memberships,
  (select count(*) from keyed where k % 5 <> 3 and unii is null and cas is null) as no_key,
  (select count(*) from keyed where k % 5 <> 3 and (unii is not null or cas is not null) and k not in (select k from found)) as not_in_registry, 1 as refused""")
def _(s, d):
    return _actions(s, d)["counts"]


# Rules on subject headings. A concept that several records hold belongs to the least descriptor.
OBJECTS = f"""links as ({LINKS}), {RESOLVED}, owner as (select 'M' || cast(k % 300 as varchar) as mesh, min(ui) as ui from keyed group by 1
    union all select 'M' || cast(250 + s_suppkey as varchar) as mesh, min('S' || cast(s_suppkey as varchar)) as ui from {{supplier}} where 250 + s_suppkey >= 300 or 250 + s_suppkey not in (select k % 300 from keyed) group by 1),
  object as (select o.mesh, o.ui, k.unii, k.cas, k.tree, (select min(f.entity) from found f where f.ui = o.ui) as object from owner o left join keyed k on k.ui = o.ui),
  rx as (select value, entity from identity where scheme = 'RXNORM_IN')"""


def _wanted(s, d):
    parsed = _release(s, d)
    wanted = parsed["mesh_contraindications"].select(F.col("mesh").alias("concept")).union(parsed["mesh_indications"].select("mesh"))
    return parsed, records.wanted_concepts(_headings(s, d), wanted)


@query("ingest_mesh_pairs", f"""with {OBJECTS} select distinct r.entity as subject, o.object, 'CI_ChemClass' as rel, 'MED-RT' as source from links l join object o on o.mesh = l.tc join rx r on r.value = l.fc
  where l.name = 'CI_ChemClass' and l.tns = 'MeSH' and o.object <> r.entity""")
def _(s, d):
    parsed, objects = _wanted(s, d)
    return ingest.pair_rules(parsed["mesh_contraindications"], objects, spark_sql(s, d, IDENTITY))["pairs"]


@query("ingest_mesh_worklist", f"""with {OBJECTS} select o.ui, case when o.unii is not null or o.cas is not null then 'UNREGISTERED_SUBSTANCE' else 'CHEMICAL_CLASS' end as kind, count(*) as assertions
  from links l join object o on o.mesh = l.tc where l.name = 'CI_ChemClass' and l.tns = 'MeSH' and o.object is null group by all""")
def _(s, d):
    parsed, objects = _wanted(s, d)
    return ingest.pair_rules(parsed["mesh_contraindications"], objects, spark_sql(s, d, IDENTITY))["worklist"].select("ui", "kind", "assertions")


@query("ingest_mesh_indications", f"""with {OBJECTS} select distinct r.entity as subject, o.ui as condition, l.name as rel, 'MED-RT' as source from links l join object o on o.mesh = l.tc join rx r on r.value = l.fc
  where l.name = 'may_treat' and l.tns = 'MeSH'""")
def _(s, d):
    parsed, objects = _wanted(s, d)
    return ingest.indication_rules(parsed["mesh_indications"], objects, spark_sql(s, d, IDENTITY))["indications"]


# Compositions: padded lines, malformed ones, records without an identifier, both encodings of one statement.
GSRS = """select case when p_partkey % 37 = 5 then '\\t\\t{{"approvalID": broken' when p_partkey % 37 = 6 then 'no record' else concat('\\t\\t{{"approvalID": ', case when p_partkey % 41 = 7 then 'null' else concat('"P', cast(p_partkey as varchar(20)), '"') end,
  ', "relationships": [{{"type": "PARENT->SALT/SOLVATE", "relatedSubstance": {{"approvalID": "P', cast(p_partkey * 2 % 500 as varchar(20)), '"}}}}, {{"type": "SALT/SOLVATE->PARENT", "relatedSubstance": {{"approvalID": "P', cast(p_partkey + 1 as varchar(20)), '"}}}}, {{"type": "odd", "relatedSubstance": {{"approvalID": "P1"}}}}',
  case when p_partkey % 2 = 0 then concat(', {{"type": "ACTIVE MOIETY", "relatedSubstance": {{"approvalID": "P', cast(case when p_partkey % 4 = 0 then p_partkey * 2 % 500 else 499 end as varchar(20)), '"}}}}') else '' end, ']}}') end as value from {part}"""
STATED = """record as (select p_partkey as k from {part} where p_partkey % 37 <> 5 and p_partkey % 37 <> 6 and p_partkey % 41 <> 7),
stated as (select k as composite, k * 2 % 500 as component, case when k % 2 = 0 and (case when k % 4 = 0 then k * 2 % 500 else 499 end) <> k
    then (case when k % 4 = 0 then k * 2 % 500 else 499 end) = k * 2 % 500 end as is_active from record where k * 2 % 500 <> k
  union all select k + 1 as composite, k as component, null as is_active from record),
merged as (select composite, component, bool_or(is_active) as is_active from stated group by 1, 2)"""
UNII_CLAIM = "select s_suppkey as entity, 'UNII' as scheme, concat('P', cast(s_suppkey * 3 as varchar(20))) as value, cast(null as int) as superseded_by from {supplier}"


def _compositions(s, d):
    return ingest.compositions(records.compositions(s, _lines(s, d, "gsrs", GSRS, compression="gzip")), spark_sql(s, d, UNII_CLAIM))


@query("ingest_gsrs", f"with {STATED} select 'P' || cast(m.composite as varchar) as composite, s_suppkey as component, 'SALT_SOLVATE' as relation, m.is_active from merged m join {{supplier}} on s_suppkey * 3 = m.component")
def _(s, d):
    return _compositions(s, d)["compositions"]


@query("ingest_gsrs_counts", f"""with {STATED}, rows as (select m.* from merged m join {{supplier}} on s_suppkey * 3 = m.component)
  select (select count(*) from record) as records, (select count(*) from (select distinct * from stated)) as statements, (select count(*) from rows) as rows,
    (select count(*) from merged where component not in (select s_suppkey * 3 from {{supplier}})) as components_not_in_registry, (select count(distinct composite) from rows) as composites,
    (select count(*) from (select composite from rows group by composite having bool_and(is_active is null))) as unruled, (select count(*) from {{part}} where p_partkey % 37 = 5) as malformed""")
def _(s, d):
    return _compositions(s, d)["counts"]


# Products: a byte order mark, the word null, either name column, combination names.
PBS = """select case when p_partkey % 43 = 0 then 'null' else concat('I', cast(p_partkey as varchar(20))) end as `﻿li_item_id`, 'B' as brand_name, case when p_partkey % 3 = 0 then 'null' else concat(p_name, ' + ', p_type, ' (as salt)') end as li_drug_name,
  case when p_partkey % 6 = 0 then '' else p_name end as drug_name, 'null' as li_form, p_brand as schedule_form from {part}"""
ITEMS = """item as (select p_partkey as k, case when p_partkey % 43 <> 0 then 'I' || cast(p_partkey as varchar) end as code, case when p_partkey % 3 <> 0 then p_name || ' + ' || p_type || ' (as salt)' when p_partkey % 6 <> 0 then p_name end as name, p_brand as form,
  case when p_partkey % 3 <> 0 then [lower(p_name), lower(p_type)] when p_partkey % 6 <> 0 then [lower(p_name)] else ['<no name>'] end as parts from {part})"""


def _products(s, d):
    return tables.products(s, _delimited(s, d, "pbs", PBS, ","))


@query("src_pbs", f"with {ITEMS} select code, 'B' as brand, name, form from item")
def _(s, d):
    return _products(s, d).select("code", "brand", "name", "form")


NAMED = """named as (select distinct lower(p_type) as name, 1 as entity from {part} union select distinct lower(string_split(p_name, ' ')[1]) as name, p_partkey % 3 as entity from {part})"""
LINKED = f"""{ITEMS}, {NAMED}, part_of as (select distinct code, unnest(parts) as component from item where code is not null),
linked as (select p.code, p.component, n.entity, 'exact' as method from part_of p join named n on n.name = p.component
  union all select p.code, p.component, n.entity, 'salt_stripped' as method from part_of p join named n on n.name = regexp_replace(p.component, ' (ring|bolt|widget)$', '') and p.component <> n.name
  where p.component not in (select name from named))"""
PRODUCT_KEY = "'PBS:' || code"


def _bridged(s, d):
    part = rel(s, d, "part")[0]
    named = part.select(F.lower("p_type").alias("name"), F.lit(1).cast("long").alias("entity")).unionByName(part.select(F.split(F.lower("p_name"), " ")[0].alias("name"), (F.col("p_partkey") % 3).alias("entity")))
    return ingest.products(_products(s, d), named, ["ring", "bolt", "widget"])


@query("ingest_pbs", f"with {LINKED} select distinct {uuid_sql(PRODUCT_KEY)} as product, component, entity, method from linked")
def _(s, d):
    return _bridged(s, d)["links"]


@query("ingest_pbs_counts", f"""with {LINKED} select (select count(*) from item) as read, (select count(*) from item where code is null) as without_identity, (select count(distinct code) from item) as products,
  (select count(distinct code) from linked) as bridged, (select count(distinct code) from linked where method = 'salt_stripped') as by_salt,
  (select count(distinct component) from part_of where (code, component) not in (select (code, component) from linked)) as unmatched""")
def _(s, d):
    return _bridged(s, d)["counts"]


# Role tables: a page per brand, with markers on substances, cells and items, and footnotes.
TITLES = ("Substance", *(f"{system} {band or ''} {role}" for system, role, band in pages.COLUMNS))
HEAD = "".join(f"<th>{t}</th>" for t in TITLES)
PAGE = f"""select concat('<html><head><meta property="article:modified_time" content="05/29/2026 - 14:00"><script>{{{{"dateModified": "Fri, 05/29/2026 - 14:00"}}}}</script></head><body><h1>Roles</h1><table><tr>{HEAD}</tr>',
  array_join(array_sort(collect_list(r)), ''), '</table><table><tr><td>other</td></tr></table><h2> Footnotes </h2><p><sup>5</sup> five &amp; more</p><p><sup>14</sup>fourteen<br>lines</p><h2>End</h2><p><sup>7</sup>not a note</p></body></html>') as value
  from (select p_brand, concat('<!--', lpad(cast(p_partkey as varchar(20)), 9, '0'), '--><tr><td>', p_name, '&nbsp; x', cast(p_partkey as varchar(20)), case when p_size % 5 = 0 then ' 14, b' else '' end, '</td><td>', case when p_size % 3 = 0 then '<b>1A2</b> 5; CYP2C9  strong inhibitor' else '' end,
    '</td><td></td><td></td><td></td><td></td><td></td><td></td><td>', case when p_size % 7 = 0 then '2D6 and 3A moderately sensitive substrates 5' else '' end, '</td><td>', case when p_size % 4 = 0 then 'P-gp, 5 and mate2-k transporter inhibitor' else '' end, '</td><td></td></tr>') as r from {{part}}) as x group by p_brand"""
FACTS = """item as (select * from (values (3, 'CYP strong inhibitor', 'CYP', 'inhibitor', 'strong', '1A2', '5'), (3, 'CYP strong inhibitor', 'CYP', 'inhibitor', 'strong', '2C9', null),
    (7, 'CYP moderate sensitive substrate', 'CYP', 'substrate', 'moderate sensitive', '2D6', '5'), (7, 'CYP moderate sensitive substrate', 'CYP', 'substrate', 'moderate sensitive', '3A', '5'),
    (4, 'transporter inhibitor', 'transporter', 'inhibitor', null, 'P-gp', '5'), (4, 'transporter inhibitor', 'transporter', 'inhibitor', null, 'MATE2-K', null)) as t(of, heading, system, role, potency, pathway, cell_markers)),
fact as (select p_partkey, p_name || ' x' || cast(p_partkey as varchar) as substance, p_size, t.*, case when p_size % 5 = 0 then '14, b' end as row_markers
  from {part} join item t on p_size % t.of = 0)"""
FACT_ROWS = f"""{FACTS}, facts as (select substance, heading, system, pathway, role, potency, row_markers, cell_markers, nullif(concat_ws(', ', row_markers, cell_markers), '') as markers,
  nullif(concat_ws(' / ', case when row_markers is not null then 'fourteen lines' end, case when cell_markers = '5' then 'five & more' end), '') as footnote, '2026-05-29T14:00' as release from fact)"""


def _facts(s, d):
    path = new_path(s, "file-roles")
    # A file for each page: whole files are read.
    spark_sql(s, d, PAGE).repartition(64, F.xxhash64("value")).write.option("maxRecordsPerFile", 1).text(path)
    return pages.role_tables(s, path)


@query("src_fda_facts", f"with {FACT_ROWS} select * from facts")
def _(s, d):
    heading = F.regexp_replace("heading", r"\\s+", " ")
    return _facts(s, d).select("substance", heading.alias("heading"), "system", "pathway", "role", "potency", "row_markers", "cell_markers", "markers", "footnote", "release")


JUDGED = f"""{FACT_ROWS}, judged as (select f.*, case when p.p_partkey % 6 = 0 and p.p_partkey < 25 then 'non_drug_entity' when p.p_partkey % 3 = 1 then 'unresolved_substance'
  when f.markers is not null then 'withheld_qualified' else 'member' end as disposition from facts f join {{part}} p on p.p_name || ' x' || cast(p.p_partkey as varchar) = f.substance)"""


def _roles(s, d):
    part = rel(s, d, "part")[0]
    name = F.concat(F.initcap("p_name"), F.lit(" X"), F.col("p_partkey").cast("string"))
    # Two entities of one folded name resolve to none.
    entities = part.where("p_partkey % 3 <> 1").select(name.alias("name"), F.col("p_partkey").alias("entity"))
    twice = part.where("p_partkey % 3 = 1").select(name.alias("name"), F.explode(F.array(F.lit(-1).cast("long"), F.lit(-2).cast("long"))).alias("entity"))
    # The list of names that are no drugs is short and closed.
    not_drugs = [r["name"] for r in part.where("p_partkey % 6 = 0 and p_partkey < 25").select(name.alias("name")).collect()]
    return ingest.role_facts(_facts(s, d), entities.unionByName(twice), not_drugs)


@query("ingest_fda", f"""with {JUDGED} select substance, pathway, lower(system) || ':' || lower(replace(pathway, '-', '')) || ':' || role || coalesce(':' || replace(potency, ' ', '-'), '') as code, markers, disposition from judged""")
def _(s, d):
    return _roles(s, d)["assertions"].select("substance", "pathway", "code", "markers", "disposition")


@query("ingest_fda_counts", f"""with {JUDGED} select count(*) as facts, count(*) filter (where disposition = 'member') as member, count(*) filter (where disposition = 'withheld_qualified') as withheld_qualified,
  count(*) filter (where disposition = 'unresolved_substance') as unresolved_substance, 0 as combination_regimen, count(*) filter (where disposition = 'non_drug_entity') as non_drug_entity from judged""")
def _(s, d):
    return _roles(s, d)["counts"]


# A curated list: subjects by identifier and by class, with forms; some ends that nothing resolves.
LIST = """select concat('[[entry]]\\nentry_id = "e', cast(n_nationkey as varchar(20)), '"\\n[entry.candidate]\\n', case when n_nationkey % 5 = 4 then concat('subject_medrt_code = "C', cast(n_nationkey as varchar(20)), '"') else concat('subject_unii = "u', cast(n_nationkey as varchar(20)), '"') end,
  '\\nsubject_name = "', n_name, '"\\nobject_medrt_code = "C', cast(n_nationkey + case when n_nationkey = 7 then 900 else 1 end as varchar(20)), '"\\nobject_name = "', 'any', '"\\naxis = "CI_PE"\\ncitation = "c"\\n[entry.judgement]\\napplies = ',
  case when n_nationkey % 3 = 0 then 'false' else 'true\\nseverity = "major"\\nevidence_grade = "established"\\nmanagement = \"\"\"avoid\\nboth\"\"\"' end, '\\n') as value from {nation}"""


def _list(s, d):
    path = new_path(s, "file-list")
    text = spark_sql(s, d, LIST).agg(F.array_join(F.array_sort(F.collect_list("value")), "\n").alias("value"))
    text.coalesce(1).write.text(path)
    entries = pages.curated_list(s, path)
    nation, composition = rel(s, d, "nation", "composition")
    claims = spark_sql(s, d, "select n_nationkey as entity, 'UNII' as scheme, concat('U', cast(n_nationkey as varchar(20))) as value, cast(null as int) as superseded_by from {nation} where n_nationkey <> 11")
    entities = nation.select(F.col("n_nationkey").cast("long").alias("entity"), F.lower("n_name").alias("name"))
    classes = nation.select((-1 - F.col("n_nationkey")).cast("long").alias("concept"), F.concat(F.lit("C"), F.col("n_nationkey")).alias("code"), F.lit("Any").alias("name"))
    subjects = nation.select((-100 - F.col("n_nationkey")).cast("long").alias("concept"), F.concat(F.lit("C"), F.col("n_nationkey")).alias("code"), F.upper("n_name").alias("name")).where("n_nationkey % 5 = 4")
    return entries, claims, entities, classes, subjects, composition


@query("src_onc", """select 'e' || cast(n_nationkey as varchar) as entry, case when n_nationkey % 5 <> 4 then 'u' || cast(n_nationkey as varchar) end as subject_unii, case when n_nationkey % 5 = 4 then 'C' || cast(n_nationkey as varchar) end as subject_code,
  n_name as subject_name, 'C' || cast(n_nationkey + case when n_nationkey = 7 then 900 else 1 end as varchar) as object_code, 'CI_PE' as axis, n_nationkey % 3 <> 0 as applies, case when n_nationkey % 3 <> 0 then 'major' end as severity,
  case when n_nationkey % 3 <> 0 then 'avoid' || chr(10) || 'both' end as management from {nation}""")
def _(s, d):
    return _list(s, d)[0].select("entry", "subject_unii", "subject_code", "subject_name", "object_code", "axis", "applies", "severity", "management")


@query("ingest_onc", """with subject as (select n_nationkey as k from {nation} where n_nationkey % 5 <> 4 and n_nationkey not in (7, 11) and n_nationkey + 1 in (select n_nationkey from {nation}))
  select 'e' || cast(k as varchar) as entry, k as subject, -2 - k as object, 'CI_PE' as rel from subject
  union select 'e' || cast(k as varchar) as entry, composite as subject, -2 - k as object, 'CI_PE' as rel from subject join {composition} on component = k and is_active""")
def _(s, d):
    entries, claims, entities, classes, _, composition = _list(s, d)
    moieties = entries.where("subject_code is null")
    return ingest.curated_pairs(moieties, claims, entities, classes, composition)["rules"]


@query("ingest_onc_unresolved", """select 'e' || cast(n_nationkey as varchar) as entry, 'subject' as role, 'UNII' as scheme, 'U11' as value, n_name as name from {nation} where n_nationkey = 11
  union all select 'e' || cast(n_nationkey as varchar) as entry, 'object' as role, 'MED-RT' as scheme, 'C' || cast(n_nationkey + case when n_nationkey = 7 then 900 else 1 end as varchar) as value, 'any' as name from {nation}
  where n_nationkey % 5 <> 4 and (n_nationkey = 7 or n_nationkey + 1 not in (select n_nationkey from {nation}))""")
def _(s, d):
    entries, claims, entities, classes, _, composition = _list(s, d)
    return ingest.curated_pairs(entries.where("subject_code is null"), claims, entities, classes, composition)["unresolved"]


@query("curate_onc", """select 'e' || cast(n_nationkey as varchar) as entry, case when n_nationkey % 4 = 0 then 'written' when n_nationkey % 4 = 1 and n_nationkey % 3 <> 0 then 'unchanged' else 'superseded' end as outcome from {nation}""")
def _(s, d):
    entries = _list(s, d)[0]
    number = F.substring("entry", 2, 9).cast("int")
    log = entries.where(number % 4 != 0).select("entry", F.lit(1).alias("id"), F.lit(None).cast("int").alias("superseded_by"), F.lit(True).alias("applies"), "severity", "evidence", "mechanism", F.when(number % 4 == 1, F.col("management")).otherwise("other").alias("management"))
    return ingest.judged_changes(entries, log, ["entry"])


@query("src_closed_list", "select distinct lower(p_type) as token from {part}")
def _(s, d):
    path = _lines(s, d, "list", "select '# a comment' as value from {region}", "select concat(' ', p_type, ' ') as value from {part}", "select '' as value from {region}")
    return tables.closed_list(s, path)


@query("src_bdpm", "select cast(p_partkey as varchar) as code, p_name || ' é' || chr(8364) as name from {part} where p_partkey % 5 <> 0")
def _(s, d):
    path = new_path(s, "file-bdpm")
    spark_sql(s, d, "select case when p_partkey % 5 = 0 then cast(p_partkey as varchar(20)) else concat(cast(p_partkey as varchar(20)), '\\t', p_name, ' é', char(128)) end as value from {part}").write.csv(path, sep="\u0001", quote="", escape="", encoding="iso-8859-1")
    return tables.narrow_table(s, path, ["code", "name"])


@query("input_checksum", "select sha256((select string_agg(r_name || chr(10), '' order by r_regionkey) from {region}) || (select string_agg(n_name || chr(10), '' order by n_nationkey) from {nation})) as checksum")
def _(s, d):
    region, nation = rel(s, d, "region", "nation")
    paths = []
    for table, key, name in ((region, "r_regionkey", "r_name"), (nation, "n_nationkey", "n_name")):
        paths.append(new_path(s, "file-sum"))
        table.coalesce(1).sortWithinPartitions(key).select(name).write.text(paths[-1])
    return s.createDataFrame([(base.checksum(s, paths),)], "checksum string")


@query("shrink_guard", "select count(*) as kept from {membership} where axis = 'R'")
def _(s, d):
    (m,) = rel(s, d, "membership")
    new = m.where("axis = 'R'").select("entity", "concept", F.col("axis").alias("source"))
    core.shrink_guard(new.count(), m.where("axis = 'R'").count())
    return core.rebuild(m.select("entity", "concept", F.col("axis").alias("source")), new, "R").where("source = 'R'").agg(F.count("*").alias("kept"))


@query("html_titles", "select page_id, string_split(string_split(html, '<title>')[2], '</title>')[1] as title, len(string_split(html, '<li>')) - 1 as items from {pages}")
def _(s, d):
    items = (F.size(F.split("html", "<li>")) - 1).cast("long")
    return rel(s, d, "pages")[0].select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), items.alias("items"))



LABEL = """select p_partkey as product, case when p_partkey % 7 = 0 then '{{"error": "none"}}' when p_partkey % 7 = 1 then null else concat('[{{"seccion": "4.6.', cast(p_size % 3 as varchar(20)), '", "titulo": "Fertilidad, EMBARAZO y ', p_type, '", "contenido": "<p>', p_name, ' &lt;b&gt;<br>&amp;amp;  x</p>"}}, {{"seccion": "4.6.2", "titulo": "Otra", "contenido": null}}]') end as body from {part}"""


@query("src_label_sections", """select p_partkey as product, '4.6.' || cast(p_size % 3 as varchar) as code, 'pregnancy' as context, p_name || ' <b> &amp; x' as text from {part} where p_partkey % 7 > 1
  union all select p_partkey as product, '4.6.2' as code, 'lactation' as context, '' as text from {part} where p_partkey % 7 > 1""")
def _(s, d):
    rows = records.label_sections(spark_sql(s, d, LABEL))
    return rows.select("product", "code", "context", records.flat_text(F.col("html")).alias("text"))


@query("revision_dates", "select p_partkey, try_cast(cast(2000 + p_size as varchar) || '-' || lpad(cast(p_partkey % 14 as varchar), 2, '0') || '-' || lpad(cast(p_partkey % 32 as varchar), 2, '0') as date) as revised from {part}")
def _(s, d):
    text = lambda c: c.cast("string")
    return rel(s, d, "part")[0].select("p_partkey", records.revision_date(text(2000 + F.col("p_size")), text(F.col("p_partkey") % 14), text(F.col("p_partkey") % 32)).alias("revised"))


@query("with_summary", "select p_partkey from {part} where p_partkey % 3 = 1")
def _(s, d):
    sections = F.array(F.struct(F.lit("other").alias("kind"), F.lit("x").alias("text")), F.struct(F.lit("summary").alias("kind"), F.when(F.expr("p_partkey % 3 = 1"), "y").when(F.expr("p_partkey % 3 = 2"), " ").alias("text")))
    return records.with_summary(rel(s, d, "part")[0].select("p_partkey", sections.alias("sections"))).select("p_partkey")

"""Readers of JSON lines and XML: compositions, concept releases, subject headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespan.functions.text import registry_number
from rulespan.plans.steps import cut

# Relation types of compositions, as (relation, whether the record is the composite).
RELATIONS = {
    "PARENT->SALT/SOLVATE": ("SALT_SOLVATE", True),
    "SALT/SOLVATE->PARENT": ("SALT_SOLVATE", False),
    "ANHYDROUS->SOLVATE": ("SOLVATE_ANHYDROUS", True),
    "SOLVATE->ANHYDROUS": ("SOLVATE_ANHYDROUS", False),
}
ACTIVE = "ACTIVE MOIETY"
# Namespaces, concept types and predicates of concept releases.
OWN, RXNORM, MESH = "MED-RT", "RxNorm", "MeSH"
CONCEPT_TYPES = ("MoA", "PE", "TC", "PK", "EPC", "APC")
MEMBERSHIPS = ("has_MoA", "has_PE", "has_TC", "has_PK")
CONTRAINDICATIONS = ("CI_MoA", "CI_PE")
MESH_CONTRAINDICATIONS = ("CI_with", "CI_ChemClass")
INDICATIONS = ("may_treat", "may_prevent", "may_diagnose", "induces")

LINE = "approvalID string, relationships array<struct<type:string, relatedSubstance:struct<approvalID:string>>>"


def compositions(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A dump of JSON lines, each from its first brace on: ``records`` (unii), ``edges`` (unii,
    composite, component, relation, activity) and ``malformed`` lines.

    Lines without a brace say nothing, malformed ones are told apart, and records without
    an identifier and relations without another end are left out, self-edges too.
    Activity is whether the composite's own record lists the component as active, null
    where it lists none or another record speaks."""
    text = spark.read.text(path).where(F.instr("value", "{") > 0).select(F.expr("substring(value, instr(value, '{'))").alias("line"))
    rows = text.select("line", F.from_json("line", LINE + ", _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("r"))
    records = rows.where("r._bad is null and coalesce(r.approvalID, '') <> ''").select(F.col("r.approvalID").alias("unii"), F.coalesce("r.relationships", F.expr("cast(array() as array<struct<type:string, relatedSubstance:struct<approvalID:string>>>)")).alias("rel"))
    others = F.filter("rel", lambda x: F.coalesce(x["relatedSubstance"]["approvalID"], F.lit("")) != "")
    actives = F.filter(F.transform(F.filter(others, lambda x: x["type"] == ACTIVE), lambda x: x["relatedSubstance"]["approvalID"]), lambda x: x != F.col("unii"))
    one = records.select("unii", actives.alias("actives"), F.explode(others).alias("x")).select("unii", "actives", F.col("x.type").alias("type"), F.col("x.relatedSubstance.approvalID").alias("other"))
    kind = F.create_map(*[F.lit(v) for t, (r, _) in RELATIONS.items() for v in (t, r)])[F.col("type")]
    own = F.col("type").isin(*[t for t, (_, composite) in RELATIONS.items() if composite])
    edges = one.where(kind.isNotNull() & (F.col("other") != F.col("unii"))).select(
        "unii", F.when(own, F.col("unii")).otherwise(F.col("other")).alias("composite"), F.when(own, F.col("other")).otherwise(F.col("unii")).alias("component"),
        kind.alias("relation"), "actives",
    )
    says = (F.col("unii") == F.col("composite")) & (F.size("actives") > 0)
    edges = edges.withColumn("activity", F.when(says, F.array_contains("actives", F.col("component")))).drop("actives").distinct()
    return {"records": records.select("unii"), "edges": edges, "malformed": rows.where("r._bad is not null").select("line")}


def _xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").options(rowTag=tag, ignoreNamespace="true", mode="PERMISSIVE", nullValue="").schema(schema).load(path)


def _text(name: str) -> Column:
    return F.coalesce(F.trim(F.col(name)), F.lit(""))


def concept_release(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A release of concepts and associations: ``classes`` (nui, code, name, concept_type),
    ``parents`` (child, parent), ``memberships`` and ``contraindications`` (rxcui, nui,
    rel), ``mesh_contraindications`` and ``mesh_indications`` (rxcui, mesh, rel), and
    ``counts``, one row of what was refused and why.

    Associations name codes, classes are known by NUI (or else their code). A code that
    two classes claim resolves to neither; associations with an end that isn't resolved are left out.
    The release is parsed once for its concepts and once for its associations, which are then kept as tables."""
    raw = _xml(spark, path, "concept", "namespace string, name string, code string, status string, property array<struct<name:string, value:string>>")
    prop = lambda n: F.trim(F.coalesce(F.try_element_at(F.transform(F.filter("property", lambda p: F.trim(p["name"]) == n), lambda p: p["value"]), F.lit(-1)), F.lit("")))
    own = cut(raw.where(_text("namespace") == OWN).select(_text("code").alias("code"), _text("name").alias("name"), _text("status").alias("status"), prop("CTY").alias("concept_type"), prop("NUI").alias("nui")))
    typed = own.where(F.col("concept_type").isin(*CONCEPT_TYPES))
    active = typed.where("status in ('', 'A')").withColumn("nui", F.coalesce(F.nullif("nui", F.lit("")), F.nullif("code", F.lit(""))))
    classes = active.where("nui is not null").select("nui", F.coalesce(F.nullif("code", F.lit("")), F.col("nui")).alias("code"), "name", "concept_type")
    by_code = classes.groupBy("code").agg(F.countDistinct("nui").alias("claimants"), F.min("nui").alias("nui"), F.bool_or(F.col("concept_type") == "EPC").alias("epc"))
    codes = by_code.where("claimants = 1").select("code", "nui", "epc")
    a = _xml(spark, path, "association", "name string, from_namespace string, from_code string, to_namespace string, to_code string")
    a = cut(a.select(*[_text(c).alias(c) for c in a.columns]))
    ends = lambda f, t: (F.col("from_namespace") == f) & (F.col("to_namespace") == t)
    at = lambda end: codes.select(F.col("code").alias(f"{end}_code"), F.col("nui").alias(f"{end}_nui"), F.col("epc").alias(f"{end}_epc"))
    parent_of = a.where("name = 'Parent Of'")
    parents = parent_of.where(ends(OWN, OWN)).join(at("from"), "from_code").join(at("to"), "to_code").select(F.col("to_nui").alias("child"), F.col("from_nui").alias("parent"))
    direct = lambda names: a.where(F.col("name").isin(*names) & ends(RXNORM, OWN)).join(at("to"), "to_code").select(F.col("from_code").alias("rxcui"), F.col("to_nui").alias("nui"), F.col("name").alias("rel"))
    epc = parent_of.where(ends(OWN, RXNORM)).join(at("from").where("from_epc"), "from_code").select(F.col("to_code").alias("rxcui"), F.col("from_nui").alias("nui"), F.lit("has_EPC").alias("rel"))
    mesh = lambda names: a.where(F.col("name").isin(*names) & ends(RXNORM, MESH)).select(F.col("from_code").alias("rxcui"), F.col("to_code").alias("mesh"), F.col("name").alias("rel"))
    seen = ("Parent Of", *MEMBERSHIPS, *CONTRAINDICATIONS, *MESH_CONTRAINDICATIONS, *INDICATIONS)
    sets = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    counts = own.agg(sets(F.when(~F.col("concept_type").isin(*CONCEPT_TYPES), F.col("concept_type"))).alias("skipped_types"))
    counts = counts.crossJoin(typed.agg(F.count_if(~F.col("status").isin("", "A")).alias("inactive")))
    counts = counts.crossJoin(active.agg(F.count_if(F.col("nui").isNull()).alias("unidentified"))).crossJoin(by_code.agg(F.count_if(F.col("claimants") > 1).alias("ambiguous_codes")))
    outside = lambda names: F.count_if(F.col("name").isin(*names) & ~ends(RXNORM, MESH))
    counts = counts.crossJoin(a.agg(outside(MESH_CONTRAINDICATIONS).alias("other_contraindications"), outside(INDICATIONS).alias("other_indications"), sets(F.when(~F.col("name").isin(*seen), F.col("name"))).alias("skipped_predicates")))
    return {
        "classes": classes, "parents": parents, "memberships": direct(MEMBERSHIPS).unionByName(epc), "contraindications": direct(CONTRAINDICATIONS),
        "mesh_contraindications": mesh(MESH_CONTRAINDICATIONS), "mesh_indications": mesh(INDICATIONS), "counts": counts,
    }


CONCEPT = "struct<_PreferredConceptYN:string, ConceptUI:string, RegistryNumber:array<string>, RegistryNumberList:struct<RegistryNumber:array<string>>>"
HEADINGS = {"DescriptorRecord": "Descriptor", "SupplementalRecord": "SupplementalRecord"}


def headings(spark: SparkSession, path: str, tag: str = "DescriptorRecord") -> DataFrame:
    """Records of a subject heading file (plain or gzip), one row each: ui, name, kind, scr_class,
    trees, uniis and cas, and its concepts (ui, preferred)."""
    of = HEADINGS[tag]
    schema = f"_SCRClass string, {of}UI string, {of}Name struct<String:string>, TreeNumberList struct<TreeNumber:array<string>>, ConceptList struct<Concept:array<{CONCEPT}>>"
    rows = _xml(spark, path, tag, schema)
    listed = lambda c, kind: F.coalesce(c, F.expr(f"cast(array() as array<{kind}>)"))
    numbers = F.flatten(F.transform(listed(F.col("ConceptList.Concept"), CONCEPT), lambda c: F.concat(listed(c["RegistryNumber"], "string"), listed(c["RegistryNumberList"]["RegistryNumber"], "string"))))
    typed = lambda want: F.array_sort(F.array_distinct(F.filter(F.transform(numbers, lambda n: F.when(registry_number(n)[0] == want, registry_number(n)[1])), lambda n: n.isNotNull())))
    concepts = F.transform(listed(F.col("ConceptList.Concept"), CONCEPT), lambda c: F.struct(F.trim(c["ConceptUI"]).alias("ui"), F.coalesce(c["_PreferredConceptYN"] == "Y", F.lit(False)).alias("preferred")))
    trees = F.filter(F.transform(listed(F.col("TreeNumberList.TreeNumber"), "string"), lambda t: F.trim(t)), lambda t: t != "")
    return rows.select(F.trim(f"{of}UI").alias("ui"), F.trim(f"{of}Name.String").alias("name"), F.lit(of.lower()).alias("kind"), F.col("_SCRClass").alias("scr_class"), trees.alias("trees"), typed("UNII").alias("uniis"), typed("CAS").alias("cas"), concepts.alias("concepts"))


def actions(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A pharmacological action file: ``classes`` (ui, name), ``members`` (ui, member), and the
    number of records without a descriptor, which are refused (``refused``, one row)."""
    rows = _xml(spark, path, "PharmacologicalAction", "DescriptorReferredTo struct<DescriptorUI:string, DescriptorName:struct<String:string>>, PharmacologicalActionSubstanceList struct<Substance:array<struct<RecordUI:string, RecordName:struct<String:string>>>>")
    rows = rows.select(F.trim("DescriptorReferredTo.DescriptorUI").alias("ui"), F.trim("DescriptorReferredTo.DescriptorName.String").alias("name"), F.col("PharmacologicalActionSubstanceList.Substance").alias("s"))
    here = rows.where("coalesce(ui, '') <> ''")
    members = here.select("ui", F.explode("s").alias("s")).select("ui", F.trim("s.RecordUI").alias("member")).where("coalesce(member, '') <> ''")
    return {"classes": here.groupBy("ui").agg(F.max("name").alias("name")), "members": members.distinct(), "refused": rows.agg(F.count_if(F.coalesce("ui", F.lit("")) == "").alias("refused"))}


def wanted_concepts(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """The record that owns each of ``wanted(concept)``: descriptors win over others."""
    kind = (F.col("kind") != "descriptor").cast("int")
    rows = records.select("*", F.explode("concepts").alias("c")).join(wanted.distinct(), F.col("c.ui") == F.col("concept"))
    best = F.min(F.struct(kind.alias("order"), "ui", "name", "kind", "scr_class", "trees", "uniis", "cas", F.col("c.preferred").alias("preferred"))).alias("best")
    return rows.groupBy("concept").agg(best).select("concept", "best.*").drop("order")


SECTION = "array<struct<seccion:string, titulo:string, contenido:string>>"


def label_sections(responses: DataFrame) -> DataFrame:
    """``responses(product, body)`` of a label service -> (product, code, title, html, context). An
    object with an error says that there are no sections; any other body that is no list is an
    error. The context is pregnancy or lactation by the section's number or else its title, or mixed."""
    body = F.trim("body")
    none = body.startswith("{") & F.get_json_object("body", "$.error").isNotNull()
    listed = F.from_json("body", SECTION)
    said = F.raise_error(F.concat(F.lit("no list of sections: "), F.coalesce(F.col("product").cast("string"), F.lit("null")))).cast("boolean")
    rows = responses.where(F.coalesce(body, F.lit("")) != "").where(F.when(none, False).when(~body.startswith("[") | listed.isNull(), said).otherwise(True))
    rows = rows.select("product", F.explode(listed).alias("s")).select("product", *[F.coalesce(F.col(f"s.{c}"), F.lit("")).alias(n) for c, n in (("seccion", "code"), ("titulo", "title"), ("contenido", "html"))])
    folded = F.lower("title")
    context = F.when(F.col("code").startswith("4.6.1") | folded.contains("embarazo"), "pregnancy").when(F.col("code").startswith("4.6.2") | folded.contains("lactancia"), "lactation").otherwise("mixed")
    return rows.withColumn("context", context)


def flat_text(html: Column) -> Column:
    """Markup as plain text: tags become spaces, the five basic character references and
    non-breaking spaces are read, white space is one space. The ampersand comes last, so nothing is read twice."""
    out = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    for name, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[\s ]+", " "))


def revision_date(year: Column, month: Column, day: Column) -> Column:
    """A date of its parts, null if they make none."""
    return F.try_to_date(F.concat_ws("-", F.lpad(F.trim(year), 4, "0"), F.lpad(F.trim(month), 2, "0"), F.lpad(F.trim(day), 2, "0")), "yyyy-MM-dd")


def with_summary(records: DataFrame, section: str = "summary") -> DataFrame:
    """Records that hold a non-blank section of the given kind: ``records(..., sections)`` of (kind, text)."""
    return records.where(F.exists("sections", lambda s: (s["kind"] == section) & (F.trim(F.coalesce(s["text"], F.lit(""))) != "")))

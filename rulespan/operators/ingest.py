"""What each source's records become: tables in, a table for each projection and worklist out.

Every record either becomes rows or is counted: each result has ``counts``, one row.
A projection is then put in place of the source's former rows by
:func:`rulespan.operators.core.rebuild`, after :func:`rulespan.operators.core.shrink_guard`
where a source can lose rows without an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulespan.functions import text as T
from rulespan.operators import identity


def _count(table: DataFrame, /, **named: Column | None) -> DataFrame:
    return table.agg(*[(F.count("*") if c is None else F.count_if(c)).alias(n) for n, c in named.items()])


def _side_by_side(*counts: DataFrame) -> DataFrame:
    out = counts[0]
    for c in counts[1:]:
        out = out.crossJoin(c)
    return out


def substances(candidates: DataFrame, allowed: DataFrame, crosswalk: DataFrame) -> dict[str, DataFrame]:
    """Candidates through the gate. ``allowed(unii)`` and ``crosswalk(name, inn)`` are short closed lists.

    Rows without an identifier are refused before the gate; those with any signal are admitted,
    named by the crosswalk or else by their folded name, and claim their identifiers."""
    allow = F.broadcast(allowed.select(F.upper("unii").alias("_unii"), F.lit(True).alias("_allowed")).distinct())
    known = candidates.where("unii is not null").withColumn("_unii", F.upper("unii")).join(allow, "_unii", "left")
    signals = T.admission_signals(F.col("has_inn"), F.col("has_usan"), F.map_contains_key("refs", F.lit("RXNORM_IN")), F.col("substance_type"), F.coalesce("_allowed", F.lit(False)))
    gated = known.withColumn("signals", signals).withColumn("entity", T.uuid5(F.concat(F.lit("UNII:"), F.col("_unii"))))
    folded = T.normalise_name(F.col("name"))
    admitted = gated.where(F.size("signals") > 0).withColumn("_name", folded).join(F.broadcast(crosswalk.select(F.col("name").alias("_name"), "inn")), "_name", "left")
    refs = F.map_concat(F.create_map(F.lit("UNII"), F.col("unii")), "refs")
    claims = admitted.select("entity", F.explode(refs).alias("scheme", "value")).select("entity", "scheme", T.canonical_value(F.col("scheme"), F.col("value")).alias("value")).distinct()
    counts = _side_by_side(
        _count(candidates, read=None, without_identity=F.col("unii").isNull()), _count(gated, admitted=F.size("signals") > 0, refused=F.size("signals") == 0)
    )
    entities = admitted.select("entity", "unii", F.coalesce("inn", "_name").alias("name"), "substance_type").distinct()
    return {"entities": entities, "signals": admitted.select("entity", F.posexplode("signals").alias("strength", "signal")), "claims": claims, "counts": counts}


def structures(rows: DataFrame, claims: DataFrame) -> dict[str, DataFrame]:
    """New claims of every entity that live claims a structure, without those it has already."""
    found = identity.many_valued(rows, "inchikey", claims, "INCHIKEY").select("entity", F.lit("CHEBI").alias("scheme"), T.canonical_value(F.lit("CHEBI"), F.col("chebi")).alias("value")).distinct()
    new = found.join(claims.select("entity", "scheme", "value"), ["entity", "scheme", "value"], "left_anti")
    return {"claims": new, "counts": _side_by_side(_count(rows, read=None), _count(new, added=None))}


def concept_release(parsed: dict[str, DataFrame], claims: DataFrame, source: str = "MED-RT") -> dict[str, DataFrame]:
    """Classes with their ids, the hierarchy, memberships and rules of every claimant of an
    ingredient, and the ingredients nobody claims with the reason that named them."""
    prefix = source.replace("-", "")
    mint = lambda c: T.uuid5(F.concat(F.lit(f"{prefix}:"), F.upper(c)))
    classes = parsed["classes"].select(mint(F.col("nui")).alias("concept"), F.lit(source).alias("source"), "nui", "code", "name", "concept_type").distinct()
    edges = parsed["parents"].where("child <> parent").select(mint(F.col("child")).alias("child"), mint(F.col("parent")).alias("parent")).distinct()
    members = identity.many_valued(parsed["memberships"], "rxcui", claims, "RXNORM_IN")
    rules = identity.many_valued(parsed["contraindications"], "rxcui", claims, "RXNORM_IN")
    named = [parsed[k].select("rxcui", F.lit(reason).alias("reason")) for k, reason in (("memberships", "classified"), ("contraindications", "contraindicated"))]
    unmatched = named[0].unionByName(named[1]).distinct().join(identity.live_claims(claims, "RXNORM_IN").withColumnRenamed("value", "rxcui"), "rxcui", "left_anti")
    memberships = members.select("entity", mint(F.col("nui")).alias("concept"), F.col("rel").alias("axis")).distinct()
    contraindications = rules.select(F.col("entity").alias("subject"), mint(F.col("nui")).alias("object"), "rel", F.lit(source).alias("source")).distinct()
    counts = _side_by_side(
        _count(classes, classes=None), _count(edges, edges=None), _count(memberships, memberships=None), _count(contraindications, rules=None),
        unmatched.agg(F.countDistinct("rxcui").alias("unmatched")), parsed["counts"],
    )
    return {"classes": classes, "edges": edges, "memberships": memberships, "rules": contraindications, "unmatched": unmatched, "counts": counts}


def actions(parsed: dict[str, DataFrame], records: DataFrame, claims: DataFrame, source: str = "MESH") -> dict[str, DataFrame]:
    """Action classes and their members, each resolved to all entities of its first kind of key
    that has any. Members without a key, and with keys that nobody claims, are counted apart."""
    mint = T.uuid5(F.concat(F.lit(f"{source}:"), F.upper("ui")))
    classes = parsed["classes"].select(mint.alias("concept"), "ui", "name")
    keys = records.select(F.col("ui").alias("member"), "uniis", "cas")
    members = parsed["members"].join(keys, "member", "left")
    asked = members.select("ui", "member", F.explode_outer("uniis").alias("unii")).distinct()
    by_unii = identity.many_valued(asked.where("unii is not null"), "unii", claims, "UNII").select("ui", "member", "entity")
    rest = members.join(by_unii.select("ui", "member").distinct(), ["ui", "member"], "left_anti").select("ui", "member", F.explode("cas").alias("cas"))
    by_cas = identity.many_valued(rest, "cas", claims, "CAS").select("ui", "member", "entity")
    found = by_unii.unionByName(by_cas).distinct()
    left = members.join(found.select("ui", "member").distinct(), ["ui", "member"], "left_anti")
    keyless = (F.coalesce(F.size("uniis"), F.lit(0)) <= 0) & (F.coalesce(F.size("cas"), F.lit(0)) <= 0)
    memberships = found.select("entity", mint.alias("concept"), F.lit("has_PA").alias("axis")).distinct()
    counts = _side_by_side(_count(classes, classes=None), _count(memberships, memberships=None), _count(left, no_key=keyless, not_in_registry=~keyless), parsed["refused"])
    return {"classes": classes, "memberships": memberships, "counts": counts}


def pair_rules(assertions: DataFrame, objects: DataFrame, claims: DataFrame, pair_rel: str = "CI_ChemClass", source: str = "MED-RT") -> dict[str, DataFrame]:
    """Rules whose objects are subject headings: of a substance with a pair relation, else of a
    condition. ``objects(concept, ui, name, uniis, cas)`` are the records that own the concepts.

    The object is asked before the subject, as a withheld object doesn't depend on who its
    subject is: a record without keys names a class (withheld), one with keys that nobody
    claims a substance that isn't registered. Both lists, unclaimed subjects and self pairs are separate counts."""
    rows = assertions.join(objects.withColumnRenamed("concept", "mesh"), "mesh")
    paired = rows.where(F.col("rel") == pair_rel)
    ends = paired.select("ui", "uniis", "cas").distinct()
    keyed = lambda c, s: identity.many_valued(ends.select("ui", F.explode(c).alias("key")), "key", claims, s).groupBy("ui").agg(F.min(F.struct("key", "entity")).alias(s))
    found = ends.select("ui").distinct().join(keyed("uniis", "UNII"), "ui", "left").join(keyed("cas", "CAS"), "ui", "left").select("ui", F.coalesce("UNII.entity", "CAS.entity").alias("object"))
    paired = paired.join(found, "ui")
    kind = F.when((F.size("uniis") > 0) | (F.size("cas") > 0), "UNREGISTERED_SUBSTANCE").otherwise("CHEMICAL_CLASS")
    worklist = paired.where("object is null").groupBy("ui", kind.alias("kind")).agg(F.max("name").alias("name"), F.count("*").alias("assertions"))
    subjects = identity.live_claims(claims, "RXNORM_IN").select(F.col("value").alias("rxcui"), F.col("entity").alias("subject"))
    unmatched = rows.select("rxcui").distinct().join(subjects, "rxcui", "left_anti")
    pairs = paired.where("object is not null").join(subjects, "rxcui")
    rules = pairs.where("subject <> object").select("subject", "object", "rel", F.lit(source).alias("source")).distinct()
    conditions = rows.where(F.col("rel") != pair_rel).join(subjects, "rxcui").select("subject", F.col("ui").alias("condition"), "rel", F.lit(source).alias("source")).distinct()
    total = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("assertions"))), F.lit(0)).alias(k.lower())
    counts = _side_by_side(
        _count(rules, pairs=None), _count(conditions, conditions=None), _count(pairs, self_pairs=F.col("subject") == F.col("object")), _count(unmatched, unmatched=None),
        worklist.agg(total("CHEMICAL_CLASS"), total("UNREGISTERED_SUBSTANCE")),
    )
    return {"pairs": rules, "conditions": conditions, "worklist": worklist, "unmatched": unmatched, "counts": counts}


def indication_rules(assertions: DataFrame, objects: DataFrame, claims: DataFrame, source: str = "MED-RT") -> dict[str, DataFrame]:
    """Indications of conditions, and what is induced apart from them. Objects in the chemical
    tree and concepts that aren't their record's preferred one are counted whoever the subject is."""
    rows = assertions.join(objects.withColumnRenamed("concept", "mesh"), "mesh")
    subjects = identity.live_claims(claims, "RXNORM_IN").select(F.col("value").alias("rxcui"), F.col("entity").alias("subject"))
    found = rows.join(subjects, "rxcui").select("subject", F.col("ui").alias("condition"), "rel", F.lit(source).alias("source")).distinct()
    indications, induced = found.where("rel <> 'induces'"), found.where("rel = 'induces'")
    unmatched = rows.select("rxcui").distinct().join(subjects, "rxcui", "left_anti")
    counts = _side_by_side(
        _count(rows, read=None, chemical=F.exists("trees", lambda t: t.startswith("D")), broadened=~F.col("preferred")),
        _count(indications, indications=None), _count(induced, induced=None), _count(unmatched, unmatched=None),
    )
    return {"indications": indications, "induced": induced, "unmatched": unmatched, "counts": counts}


def compositions(parsed: dict[str, DataFrame], claims: DataFrame) -> dict[str, DataFrame]:
    """Compositions with their component resolved. The two encodings of one statement are one
    row, whose activity is what the composite's own record says, if it says anything."""
    merged = parsed["edges"].groupBy("composite", "component", "relation").agg(F.max("activity").alias("is_active"))
    live = identity.live_claims(claims, "UNII").select(F.col("value").alias("component"), "entity")
    rows = merged.join(live, "component").select("composite", F.col("entity").alias("component"), "relation", "is_active").distinct()
    lost = merged.join(live, "component", "left_anti")
    counts = _side_by_side(
        _count(parsed["records"], records=None), _count(parsed["edges"], statements=None), _count(rows, rows=None), _count(lost, components_not_in_registry=None),
        rows.agg(F.countDistinct("composite").alias("composites")), rows.groupBy("composite").agg(F.count("is_active").alias("known")).agg(F.count_if(F.col("known") == 0).alias("unruled")), _count(parsed["malformed"], malformed=None),
    )
    return {"compositions": rows, "counts": counts}


def products(items: DataFrame, named: DataFrame, suffixes: list[str], source: str = "PBS") -> dict[str, DataFrame]:
    """Products with an id of their code, a link to every entity that one of their ingredients
    names exactly or without one trailing salt, and the ingredients that name none.
    ``named(name, entity)``. A product without a name has the one ingredient that says so."""
    known = items.where("code is not null").withColumn("product", T.uuid5(F.concat(F.lit(f"{source}:"), F.col("code"))))
    parts = known.select("product", F.explode(T.components(F.coalesce("name", F.lit("")))).alias("component")).distinct()
    links = identity.by_name(parts, "component", named, T.strip_suffix(F.col("component"), suffixes)).select("product", "component", "entity", "method").distinct()
    residual = parts.join(links.select("product", "component").distinct(), ["product", "component"], "left_anti")
    unmatched = residual.groupBy("component").agg(F.countDistinct("product").alias("products"))
    counts = _side_by_side(
        _count(items, read=None, without_identity=F.col("code").isNull()), known.agg(F.countDistinct("product").alias("products")),
        links.agg(F.countDistinct("product").alias("bridged"), F.countDistinct(F.when(F.col("method") == "salt_stripped", F.col("product"))).alias("by_salt")), _count(unmatched, unmatched=None),
    )
    rows = known.select("product", "code", "brand", "name", "form", "program", "benefit").dropDuplicates(["product"])
    return {"products": rows, "links": links, "unmatched": unmatched, "counts": counts}


def role_facts(facts: DataFrame, entities: DataFrame, not_drugs: list[str], source: str = "FDACYP") -> dict[str, DataFrame]:
    """Facts of role tables: their classes, an assertion each with what became of it, and the
    memberships of those that became one. A substance is the one entity of its folded name."""
    code = F.concat_ws(":", F.lower("system"), F.regexp_replace(F.lower("pathway"), "[- ]", ""), "role", F.translate("potency", " ", "-"))
    name = F.concat(F.when(F.col("system") == "CYP", "CYP").otherwise(""), F.col("pathway"), F.lit(" "), F.concat_ws(" ", "potency", "role"), F.lit(" [FDA-CYP]"))
    rows = facts.withColumn("code", code).withColumn("concept", T.uuid5(F.concat(F.lit(f"{source}:"), F.upper("code"))))
    unique = identity.unique_or_unresolved(entities.select(F.lower("name").alias("folded"), "entity"), ["folded"]).where("entity is not null")
    rows = rows.withColumn("folded", F.lower("substance")).join(unique.select("folded", "entity"), "folded", "left")
    marks = F.when(F.col("markers").isNotNull(), F.split("markers", ", ")).otherwise(F.expr("cast(array() as array<string>)"))
    disposition = T.disposition(F.col("folded").isin(*[n.lower() for n in not_drugs]), F.col("substance"), F.col("entity").isNotNull(), marks)
    assertions = rows.withColumn("disposition", disposition)
    memberships = assertions.where("disposition = 'member'").select("entity", "concept", F.lit("has_PK").alias("axis")).distinct()
    counts = _side_by_side(_count(facts, facts=None), *[_count(assertions, **{d: F.col("disposition") == d}) for d in ("member", "withheld_qualified", "unresolved_substance", "combination_regimen", "non_drug_entity")])
    classes = rows.select("concept", "code", name.alias("name")).distinct()
    columns = ["path", "release", "row", "raw_substance", "substance", "heading", "pathway", "raw_cell", "markers", "row_markers", "cell_markers", "footnote", "code", "entity", "disposition"]
    return {"classes": classes, "assertions": assertions.select(*columns), "memberships": memberships, "counts": counts}


def curated_pairs(entries: DataFrame, claims: DataFrame, entities: DataFrame, classes: DataFrame, compositions: DataFrame) -> dict[str, DataFrame]:
    """Entries of a curated list: rules of each resolved subject and its forms, judgements, and the
    ends that no identifier resolved. An end that resolves to another name than the entry's is an error: a reviewer read the name.
    ``entities(entity, name)``, ``classes(concept, code, name)``, ``compositions(composite, component, is_active)`` by entity."""
    live = identity.live_claims(claims, "UNII").select(F.col("value").alias("subject_unii"), F.col("entity").alias("subject"))
    names = entities.select(F.col("entity").alias("subject"), F.col("name").alias("subject_found"))
    of = lambda end: classes.select(F.col("code").alias(f"{end}_code"), F.col("concept").alias(f"{end}_concept"), F.col("name").alias(f"{end}_class_name"))
    rows = entries.withColumn("subject_unii", T.canonical_value(F.lit("UNII"), F.col("subject_unii"))).join(live, "subject_unii", "left").join(names, "subject", "left")
    rows = rows.join(of("object"), "object_code", "left").join(of("subject"), "subject_code", "left")
    for end, found in (("subject", F.coalesce("subject_found", "subject_class_name")), ("object", F.col("object_class_name"))):
        other = found.isNotNull() & (T.normalise_name(F.col(f"{end}_name")) != T.normalise_name(found))
        said = F.raise_error(F.concat(F.lit("entry "), F.col("entry"), F.lit(f": the {end} resolves to another name, "), found)).cast("boolean")
        # A condition on rows, which no projection of them can leave out.
        rows = rows.where(F.when(other, said).otherwise(True))
    subject = F.coalesce("subject", "subject_concept")
    ends = [
        rows.select("entry", F.lit("subject").alias("role"), F.when(F.col("subject_unii").isNotNull(), "UNII").otherwise("MED-RT").alias("scheme"), F.coalesce("subject_unii", "subject_code").alias("value"), F.col("subject_name").alias("name"), subject.alias("found")),
        rows.select("entry", F.lit("object").alias("role"), F.lit("MED-RT").alias("scheme"), F.col("object_code").alias("value"), F.col("object_name").alias("name"), F.col("object_concept").alias("found")),
    ]
    unresolved = ends[0].unionByName(ends[1]).where("found is null").drop("found")
    whole = rows.where(subject.isNotNull() & F.col("object_concept").isNotNull())
    moieties = whole.where("subject is not null")
    forms = identity.with_forms(moieties.select("subject"), compositions)
    rules = moieties.join(forms, "subject").select("entry", F.col("form").alias("subject"), F.col("object_concept").alias("object"), F.col("axis").alias("rel")).distinct()
    class_rules = whole.where("subject is null").select("entry", F.col("subject_concept").alias("subject_class"), F.col("object_concept").alias("object_class"), F.col("axis").alias("rel"))
    counts = _side_by_side(_count(entries, entries=None), _count(rules, rules=None), _count(class_rules, class_rules=None), _count(unresolved, unresolved=None))
    judgements = whole.select("entry", "applies", "severity", "evidence", "mechanism", "management")
    return {"rules": rules, "class_rules": class_rules, "judgements": judgements, "unresolved": unresolved, "counts": counts}


def judged_changes(entries: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """What writing each judgement would do: nothing if all five graded columns agree with the live
    row, else the first or a superseding one. Two entries of one key that differ are an error."""
    graded = ["applies", "severity", "evidence", "mechanism", "management"]
    distinct = entries.select(*keys, *graded).distinct()
    one = distinct.groupBy(*keys).agg(F.count("*").alias("n"), F.first(F.struct(*graded)).alias("g"))
    one = one.select(*keys, F.when(F.col("n") > 1, F.raise_error(F.lit("two entries of one key differ"))).otherwise(F.col("g")).alias("g")).select(*keys, "g.*")
    live = log.where("superseded_by is null").select(*keys, F.col("id").alias("_live"), *[F.col(c).alias(f"_{c}") for c in graded])
    same = F.col("_live").isNotNull()
    for c in graded:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    rows = one.join(live, keys, "left")
    return rows.select(*keys, F.when(F.col("_live").isNull(), "written").when(same, "unchanged").otherwise("superseded").alias("outcome"))

"""Readers over files with malformed, missing and unusual content, and what the ingests make of it."""

import gzip
import hashlib

import pytest

from rulespan.functions.text import uuid5
from rulespan.operators import ingest
from rulespan.sources import base, pages, records, tables


@pytest.fixture()
def put(tmp_path):
    def write(name, text, encoding="utf-8", zipped=False):
        path = tmp_path / name
        raw = text.encode(encoding)
        path.write_bytes(gzip.compress(raw) if zipped else raw)
        return f"file://{path}"

    return write


@pytest.fixture()
def t(spark):
    def table(schema, *rows):
        return spark.createDataFrame(list(rows), schema)

    return table


HEADER = "UNII\tDisplay Name\tRN\tRXCUI\tPUBCHEM\tINN_ID\tUSAN_ID\tINCHIKEY\tSUBSTANCE_TYPE\textra\n"


def test_substances(spark, put, t):
    path = put("u.tsv", HEADER + 'a1\t SODIUM  "X"\t50-00-0\t\t\t 7 \t\tik\tchemical\tz\n' + "\tno id\t\t5\t\t\t\t\tprotein\t\n" + "b2\tweak\t\t5\t\t\t\t\tprotein\t\n" + "c3\tmixture\t\t6\t\t\t\t\tmixture\t\n" + "d4\tlisted\n")
    got = tables.substances(spark, path)
    assert {(r.unii, r.name, r.has_inn, r.has_usan, r.substance_type, tuple(sorted(r.refs.items()))) for r in got.collect()} == {
        ("a1", 'SODIUM  "X"', True, False, "chemical", (("CAS", "50-00-0"), ("INCHIKEY", "ik"))), (None, "no id", False, False, "protein", (("RXNORM_IN", "5"),)),
        ("b2", "weak", False, False, "protein", (("RXNORM_IN", "5"),)), ("c3", "mixture", False, False, "mixture", (("RXNORM_IN", "6"),)), ("d4", "listed", False, False, None, ()),
    }
    out = ingest.substances(got, t("unii string", ("D4",)), t("name string, inn string", ("weak", "strong")))
    assert {(r.unii, r.name) for r in out["entities"].collect()} == {("a1", 'sodium "x"'), ("b2", "strong"), ("d4", "listed")}
    assert {(r.scheme, r.value) for r in out["claims"].collect()} == {("UNII", "A1"), ("CAS", "50-00-0"), ("INCHIKEY", "IK"), ("UNII", "B2"), ("RXNORM_IN", "5"), ("UNII", "D4")}
    assert tuple(out["counts"].first()) == (5, 1, 3, 1)
    with pytest.raises(base.SourceError, match="SUBSTANCE_TYPE"):
        tables.substances(spark, put("bad.tsv", HEADER.replace("SUBSTANCE_TYPE", "TYPE")))
    assert tables.substances(spark, put("empty.tsv", HEADER)).count() == 0


def test_structures_claim_what_is_new(spark, put, t):
    rows = tables.structures(spark, put("c.tsv", "CHEBI_ID\tINCHIKEY\nchebi:1\tIK\n\tIK\nchebi:2\t\nchebi:3\tnone\n"))
    claims = t("entity string, scheme string, value string, superseded_by long", ("x", "INCHIKEY", "IK", None), ("y", "INCHIKEY", "IK", None), ("z", "INCHIKEY", "IK", 4), ("y", "CHEBI", "CHEBI:1", None))
    assert [tuple(r) for r in ingest.structures(rows, claims)["claims"].collect()] == [("x", "CHEBI", "CHEBI:1")]


def test_products(spark, put, t):
    path = put("p.csv", '﻿li_item_id,li_drug_name,drug_name,li_form,schedule_form\n1,"Alpha with BETA sodium, gamma",x,null,tab\n2,null,Delta\n null ,Alpha,,,\n3,,null,,\n')
    items = tables.products(spark, path)
    assert {(r.code, r.name, r.form, r.brand) for r in items.collect()} == {("1", "Alpha with BETA sodium, gamma", "tab", None), ("2", "Delta", None, None), (None, "Alpha", None, None), ("3", None, None, None)}
    named = t("name string, entity long", ("alpha", 1), ("alpha", 2), ("beta", 3))
    out = ingest.products(items, named, ["sodium"])
    assert {(r.component, r.entity, r.method) for r in out["links"].collect()} == {("alpha", 1, "exact"), ("alpha", 2, "exact"), ("beta sodium", 3, "salt_stripped")}
    assert {tuple(r) for r in out["unmatched"].collect()} == {("gamma", 1), ("delta", 1), ("<no name>", 1)}
    assert tuple(out["counts"].first()) == (4, 1, 3, 1, 1, 3)
    for header in ("code,drug_name", "li_item_id,name"):
        with pytest.raises(base.SourceError, match="no column"):
            tables.products(spark, put("bad.csv", header + "\n1,x\n"))


def test_other_tables(spark, put):
    rows = tables.narrow_table(spark, put("b.txt", "1\tCafé 5€\tz\n2\tshort\n\n3\t\t\n", "cp1252"), ["code", "name", "rest"])
    assert {tuple(r) for r in rows.collect()} == {("1", "Café 5€", "z"), ("3", "", "")}
    assert {r.token for r in tables.closed_list(spark, put("l.txt", "# Sodium\nSodium\n\n  HCl \nsodium\n")).collect()} == {"sodium", "hcl"}
    one, two = put("one", "a\nb"), put("two", "c")
    assert base.checksum(spark, [one, two]) == hashlib.sha256(b"a\nbc").hexdigest() != base.checksum(spark, [two, one])


def test_compositions(spark, put, t):
    rel = lambda kind, to: '{"type":"%s","relatedSubstance":{"approvalID":%s}}' % (kind, f'"{to}"' if to else "null")
    line = lambda unii, *rels: '\t\t{"approvalID":%s,"names":[{"x":1}],"relationships":[%s]}' % (f'"{unii}"' if unii else "null", ",".join(rels))
    text = "\n".join([
        line("S", rel("PARENT->SALT/SOLVATE", "P"), rel("ACTIVE MOIETY", "P"), rel("PARENT->SALT/SOLVATE", "S"), rel("PARENT->SALT/SOLVATE", None), rel("odd", "P")),
        line("P", rel("SALT/SOLVATE->PARENT", "S"), rel("ACTIVE MOIETY", "P")), line("H", rel("ANHYDROUS->SOLVATE", "Q"), rel("ACTIVE MOIETY", "H")), line(None, rel("PARENT->SALT/SOLVATE", "P")),
        line("T", rel("PARENT->SALT/SOLVATE", "P"), rel("ACTIVE MOIETY", "Z")), '\t\t{"approvalID": "X", broken', "no record", '{"approvalID":"E"}', "",
    ])
    parsed = records.compositions(spark, put("g.gz", text, zipped=True))
    assert {r.unii for r in parsed["records"].collect()} == {"S", "P", "H", "T", "E"} and parsed["malformed"].count() == 1
    claims = t("entity long, scheme string, value string, superseded_by long", (1, "UNII", "P", None))
    out = ingest.compositions(parsed, claims)
    # What the composite's own record says holds over the mirrored statement; H lists no moiety but itself.
    assert {tuple(r) for r in out["compositions"].collect()} == {("S", 1, "SALT_SOLVATE", True), ("T", 1, "SALT_SOLVATE", False)}
    assert {(r.composite, r.component, r.activity) for r in parsed["edges"].where("relation = 'SOLVATE_ANHYDROUS'").collect()} == {("H", "Q", None)}
    assert tuple(out["counts"].first()) == (5, 4, 2, 1, 2, 0, 1)


def concept(code, kind, nui="", status="A", owner="MED-RT", name="n"):
    return f"<concept><namespace>{owner}</namespace><name>{name}</name><code>{code}</code><status>{status}</status><property><name>CTY</name><value>{kind}</value></property>" + (f"<property><name>NUI</name><value>{nui}</value></property>" if nui else "") + "</concept>"


def association(name, a, b):
    (an, ac), (bn, bc) = a, b
    return f"<association><name>{name}</name><from_namespace>{an}</from_namespace><from_code>{ac}</from_code><to_namespace>{bn}</to_namespace><to_code>{bc}</to_code></association>"


def test_concept_releases(spark, put, t):
    own, rx, mesh = (lambda c, n=n: (n, c) for n in ("MED-RT", "RxNorm", "MeSH"))
    text = "<root>" + "\n".join([
        concept("c1", "MoA", "N1"), concept("c2", "EPC", "N2"), concept("c3", "PE"), concept("c4", "PE", "N4", "I"), concept("c5", "odd", "N5"), concept("c6", "PE", "N6", owner="other"), concept("", "PE"),
        concept("c7", "PE", "N7"), concept("c7", "MoA", "N8"), concept("", "PE", "N9", status=""),
        association("Parent Of", own("c1"), own("c3")), association("Parent Of", own("c1"), own("c7")), association("Parent Of", own("c2"), rx("7")), association("Parent Of", own("c1"), rx("7")),
        association("has_MoA", rx("5"), own("c1")), association("has_MoA", own("c1"), rx("5")), association("CI_PE", rx("5"), own("c3")), association("CI_with", rx("5"), mesh("M1")), association("CI_with", rx("5"), own("c1")),
        association("may_treat", rx("5"), mesh("M2")), association("may_treat", own("c1"), mesh("M2")), association("strange", rx("5"), own("c1")),
    ]) + "</root>"
    got = records.concept_release(spark, put("m.xml", text))
    assert {(r.nui, r.code) for r in got["classes"].collect()} == {("N1", "c1"), ("N2", "c2"), ("c3", "c3"), ("N7", "c7"), ("N8", "c7"), ("N9", "N9")}
    # A code that two classes claim resolves to neither.
    assert [tuple(r) for r in got["parents"].collect()] == [("c3", "N1")]
    assert {tuple(r) for r in got["memberships"].collect()} == {("5", "N1", "has_MoA"), ("7", "N2", "has_EPC")}
    assert [tuple(r) for r in got["mesh_contraindications"].collect()] == [("5", "M1", "CI_with")] and [tuple(r) for r in got["mesh_indications"].collect()] == [("5", "M2", "may_treat")]
    assert got["counts"].first().asDict() == {"skipped_types": "odd", "inactive": 1, "unidentified": 1, "ambiguous_codes": 1, "other_contraindications": 1, "other_indications": 1, "skipped_predicates": "strange"}
    claims = t("entity long, scheme string, value string, superseded_by long", (1, "RXNORM_IN", "5", None), (2, "RXNORM_IN", "5", None))
    out = ingest.concept_release(got, claims)
    assert {r.entity for r in out["memberships"].collect()} == {1, 2} and {tuple(r) for r in out["unmatched"].collect()} == {("7", "classified")}
    assert out["rules"].count() == 2 and out["edges"].count() == 1


def heading(ui, *concepts, trees=(), tag="DescriptorRecord", cls=""):
    of = {"DescriptorRecord": "Descriptor", "SupplementalRecord": "SupplementalRecord"}[tag]
    body = "".join(f'<Concept PreferredConceptYN="{p}"><ConceptUI>{c}</ConceptUI>' + "".join(f"<RegistryNumber>{n}</RegistryNumber>" for n in numbers) + "</Concept>" for c, p, numbers in concepts)
    return f"<{tag}{cls}><{of}UI>{ui}</{of}UI><{of}Name><String> name of {ui}</String></{of}Name><ConceptList>{body}</ConceptList>" + (f"<TreeNumberList>{''.join(f'<TreeNumber>{x}</TreeNumber>' for x in trees)}</TreeNumberList>" if trees else "") + f"</{tag}>"


def test_headings_and_what_rules_say_of_them(spark, put, t):
    desc = "<DescriptorRecordSet>" + heading("D1", ("M1", "Y", ["0"]), ("M2", "N", ["ABCDEFGHI1", "50-00-0 (x)"]), trees=("C10", "D1.01")) + heading("D2", ("M3", "Y", ["0"]), trees=("C2",)) + heading("D3", ("M4", "Y", ["51-00-1"])) + heading("D4", ("M6", "Y", [])) + "</DescriptorRecordSet>"
    supp = "<Set>" + heading("S1", ("M3", "Y", []), ("M5", "Y", []), tag="SupplementalRecord", cls=' SCRClass="3"') + "</Set>"
    all_ = records.headings(spark, put("d.xml.gz", desc, zipped=True)).unionByName(records.headings(spark, put("s.xml", supp), "SupplementalRecord"))
    got = {r.ui: r for r in all_.collect()}
    assert (got["D1"].name, got["D1"].trees, got["D1"].uniis, got["D1"].cas, got["D2"].uniis, got["S1"].scr_class, got["S1"].trees) == ("name of D1", ["C10", "D1.01"], ["ABCDEFGHI1"], ["50-00-0"], [], "3", [])
    objects = records.wanted_concepts(all_, t("concept string", *[(f"M{i}",) for i in range(1, 8)], ("M1",)))
    assert {(r.concept, r.ui, r.preferred) for r in objects.collect()} == {("M1", "D1", True), ("M2", "D1", False), ("M3", "D2", True), ("M4", "D3", True), ("M5", "S1", True), ("M6", "D4", True)}
    claims = t("entity long, scheme string, value string, superseded_by long", (1, "UNII", "ABCDEFGHI1", None), (9, "CAS", "50-00-0", None), (1, "RXNORM_IN", "5", None), (2, "RXNORM_IN", "6", None))
    said = t("rxcui string, mesh string, rel string", ("5", "M1", "CI_ChemClass"), ("6", "M2", "CI_ChemClass"), ("5", "M3", "CI_ChemClass"), ("404", "M3", "CI_ChemClass"), ("404", "M4", "CI_ChemClass"), ("6", "M6", "CI_with"), ("6", "M99", "CI_with"))
    out = ingest.pair_rules(said, objects, claims)
    assert [tuple(r) for r in out["pairs"].collect()] == [(2, 1, "CI_ChemClass", "MED-RT")] and [tuple(r) for r in out["conditions"].collect()] == [(2, "D4", "CI_with", "MED-RT")]
    # Objects are asked whoever the subject is: 404 is unmatched, and its objects are on the list.
    assert {(r.ui, r.kind, r.assertions) for r in out["worklist"].collect()} == {("D2", "CHEMICAL_CLASS", 2), ("D3", "UNREGISTERED_SUBSTANCE", 1)}
    assert out["counts"].first().asDict() == {"pairs": 1, "conditions": 1, "self_pairs": 1, "unmatched": 1, "chemical_class": 2, "unregistered_substance": 1}
    ind = ingest.indication_rules(t("rxcui string, mesh string, rel string", ("5", "M1", "may_treat"), ("404", "M2", "may_treat"), ("6", "M3", "induces")), objects, claims)
    assert ind["counts"].first().asDict() == {"read": 3, "chemical": 2, "broadened": 1, "indications": 1, "induced": 1, "unmatched": 1}


def test_actions(spark, put, t):
    sub = lambda *uis: "<PharmacologicalActionSubstanceList>" + "".join(f"<Substance><RecordUI>{u}</RecordUI><RecordName><String>x</String></RecordName></Substance>" for u in uis) + "</PharmacologicalActionSubstanceList>"
    pa = "<S>" + "".join(f"<PharmacologicalAction><DescriptorReferredTo><DescriptorUI>{u}</DescriptorUI><DescriptorName><String>n{u}</String></DescriptorName></DescriptorReferredTo>{sub(*m)}</PharmacologicalAction>" for u, m in (("A", ("D1", "D2", "D1")), ("B", ()), ("", ("D1",)))) + "</S>"
    parsed = records.actions(spark, put("pa.xml", pa))
    keyed = t("ui string, uniis array<string>, cas array<string>", ("D1", ["u0", "u1"], ["c1"]), ("D2", [], []))
    claims = t("entity long, scheme string, value string, superseded_by long", (1, "UNII", "u1", None), (2, "CAS", "c1", None))
    out = ingest.actions(parsed, keyed, claims)
    assert [r.entity for r in out["memberships"].collect()] == [1]
    assert out["counts"].first().asDict() == {"classes": 2, "memberships": 1, "no_key": 1, "not_in_registry": 0, "refused": 1}


def page(*rows, stamp="05/29/2026 - 14:00", notes="<h2>Footnotes</h2><p><sup>5</sup>five</p><p><sup>b2</sup> two &lt; <i>x</i></p>", cells=11):
    tr = lambda values, tag: "<tr>" + "".join(f"<{tag}>{v}</{tag}>" for v in values) + "</tr>"
    return f'<meta property="og:updated_time" content="{stamp}"><table>' + tr([f"h{i}" for i in range(cells)], "th") + "".join(tr([*r, *[""] * (11 - len(r))], "td") for r in rows) + f"</table>{notes}"


def test_role_tables(spark, put):
    ok = page(["rito<br>navir 14, 5", "1A2 5, 7; CYP2c9 and 3A strong inhibitors"], ["x", *[""] * 8, "P-gp transporter inhibitor 5"], ["y", *[""] * 7, "2D6 moderately&nbsp;sensitive substrate"])
    got = {(r.row, r.substance, r.pathway, r.role, r.potency, r.row_markers, r.cell_markers, r.markers, r.footnote, r.release) for r in pages.role_tables(spark, put("p.html", ok)).collect()}
    assert got == {
        (1, "rito navir", "1A2", "inhibitor", "strong", "14, 5", "5, 7", "14, 5, 5, 7", "five / five", "2026-05-29T14:00"), (1, "rito navir", "2C9", "inhibitor", "strong", "14, 5", None, "14, 5", "five", "2026-05-29T14:00"),
        (1, "rito navir", "3A", "inhibitor", "strong", "14, 5", None, "14, 5", "five", "2026-05-29T14:00"), (2, "x", "P-gp", "inhibitor", None, None, "5", "5", "five", "2026-05-29T14:00"), (3, "y", "2D6", "substrate", "moderate sensitive", None, None, None, None, "2026-05-29T14:00"),
    }
    for text, why in (
        (page(["x", "1A2"]), "no role"), (page(["x", "1A2 weak inhibitor"]), "contradicts"), (page(["x", "1A2 strong inducer"]), "contradicts"), (page(["x", "1A2 inhibitor"]), "contradicts"), (page(["x", "P-gp strong inhibitor"]), "no CYP pathway"),
        (page(["x", *[""] * 8, "P-gp strong inhibitor"]), "contradicts"), (page(["x 9", "1A2 strong inhibitor"]), "no footnote"), (page(cells=10), "10 cells"), (page(stamp="29 May"), "stamps"), (page(notes=""), "no footnotes"), (page(notes="<h2>Footnotes</h2>"), "empty"), ("<p>nothing</p>", "no table"),
        (page() + '"dateModified": "01/01/2025 - 10:00"', "stamps"),
    ):
        with pytest.raises(base.SourceError, match=why):
            list(pages.page_facts(text))
    assert [f[-1] for f in pages.page_facts(page(["x b", "1A2 strong inhibitor"]))] == [None]
    assert pages.class_code("CYP", "2C19", "substrate", "moderate sensitive") == "cyp:2c19:substrate:moderate-sensitive" and pages.class_name("transporter", "P-gp", "inhibitor", None) == "P-gp inhibitor [FDA-CYP]"


ENTRY = '[[entry]]\nentry_id = "{id}"\n[entry.candidate]\n{subject}\nsubject_name = "Alpha"\nobject_medrt_code = "{object}"\nobject_name = "Beta"\naxis = "CI_PE"\ncitation = "c"\n[entry.judgement]\napplies = {applies}\n'


def entry(id="e", subject='subject_unii = "u1"', object="C1", applies='true\nseverity = "major"\nevidence_grade = "x"'):
    return ENTRY.format(id=id, subject=subject, object=object, applies=applies)


def test_curated_lists(spark, put, t):
    for text, why in (("", "no entries"), (entry() + entry(), "name of its own"), (entry(subject=""), "one subject"), (entry(subject='subject_unii = "a"\nsubject_medrt_code = "b"'), "one subject"), (entry(applies="true"), "grades"), (entry(applies='false\nseverity = "x"'), "grades"), (entry(applies='"yes"'), "grades"), (entry().replace("CI_PE", "CI_X"), "axis"), (entry() + "management = []\n", "no text"), (entry().replace('citation = "c"', 'citation = " "'), "missing")):
        with pytest.raises(base.SourceError, match=why):
            pages.entries(text)
    text = entry() + entry("f", 'subject_medrt_code = "C2"') + entry("g", 'subject_unii = "none"', applies="false") + entry("h", object="C9")
    entries = pages.curated_list(spark, put("l.toml", text))
    claims = t("entity long, scheme string, value string, superseded_by long", (1, "UNII", "U1", None))
    classes = t("concept long, code string, name string", (70, "C1", " beta "), (80, "C2", "ALPHA"))
    parts = t("composite long, component long, is_active boolean", (11, 1, True), (12, 1, None))
    out = ingest.curated_pairs(entries, claims, t("entity long, name string", (1, "alpha")), classes, parts)
    assert {tuple(r) for r in out["rules"].collect()} == {("e", 1, 70, "CI_PE"), ("e", 11, 70, "CI_PE")} and [tuple(r) for r in out["class_rules"].collect()] == [("f", 80, 70, "CI_PE")]
    assert {(r.entry, r.role, r.value) for r in out["unresolved"].collect()} == {("g", "subject", "NONE"), ("h", "object", "C9")}
    assert tuple(out["counts"].first()) == (4, 2, 1, 2)
    with pytest.raises(Exception, match="another name"):
        ingest.curated_pairs(entries, claims, t("entity long, name string", (1, "gamma")), classes, parts)["rules"].collect()
    graded = "entry string, applies boolean, severity string, evidence string, mechanism string, management string"
    log = t(f"{graded}, id long, superseded_by long", ("e", True, "major", "x", None, None, 1, None), ("f", True, "minor", "x", None, None, 2, None), ("g", False, None, None, None, None, 3, 4))
    assert {tuple(r) for r in ingest.judged_changes(entries, log, ["entry"]).collect()} == {("e", "unchanged"), ("f", "superseded"), ("g", "written"), ("h", "written")}
    with pytest.raises(Exception, match="differ"):
        ingest.judged_changes(t(graded, ("e", True, "a", "x", None, None), ("e", True, "b", "x", None, None)), log, ["entry"]).collect()


def test_role_facts_become_memberships(spark, put, t):
    facts = pages.role_tables(spark, put("p.html", page(["Alpha", "1A2 strong inhibitor"], ["beta 5", "1A2 strong inhibitor"], ["gamma", "1A2 strong inhibitor"], ["alpha and beta", "1A2 strong inhibitor"], ["grapefruit", "1A2 strong inhibitor"])))
    entities = t("name string, entity long", ("ALPHA", 1), ("Beta", 2), ("gamma", 3), ("Gamma", 4))
    out = ingest.role_facts(facts, entities, ["Grapefruit"])
    assert {(r.substance, r.disposition) for r in out["assertions"].collect()} == {("Alpha", "member"), ("beta", "withheld_qualified"), ("gamma", "unresolved_substance"), ("alpha and beta", "combination_regimen"), ("grapefruit", "non_drug_entity")}
    got = out["memberships"].collect()
    code = out["classes"].first()
    assert [r.entity for r in got] == [1] and (code.code, code.name) == ("cyp:1a2:inhibitor:strong", "CYP1A2 strong inhibitor [FDA-CYP]")
    want = spark.range(1).select(uuid5(__import__("pyspark").sql.functions.lit("FDACYP:CYP:1A2:INHIBITOR:STRONG"))).first()[0]
    assert code.concept == want and tuple(out["counts"].first()) == (5, 1, 1, 1, 1, 1)


def test_label_sections_and_text(spark, t):
    body = '[{"seccion":"4.6.1","titulo":"x","contenido":"<p>a<style>z</style>&nbsp;b &amp;lt;</p>"},{"seccion":"4.6.9","titulo":"La Lactancia"},{"titulo":"other"}]'
    rows = records.label_sections(t("product string, body string", ("p", body), ("q", '{"error":"404"}'), ("r", None), ("s", " "), ("t", "[]")))
    assert {(r.product, r.code, r.context) for r in rows.collect()} == {("p", "4.6.1", "pregnancy"), ("p", "4.6.9", "lactation"), ("p", "", "mixed")}
    assert rows.where("code = '4.6.1'").select(records.flat_text(rows.html)).first()[0] == "a b &lt;"
    for bad in ('{"x":1}', "text"):
        with pytest.raises(Exception, match="no list"):
            records.label_sections(t("product string, body string", ("p", bad))).collect()


def test_chains(spark, put, tmp_path):
    from rulespan.plans import chain

    put("a_1.txt", "a"), put("b_1.txt", "b"), put("c_1.xml", "c"), put("c_2.xml", "c")
    folder, ran, heard = f"file://{tmp_path}", [], []
    step = lambda name, **inputs: chain.Step(name, inputs, lambda s, files, release: ran.append((name, sorted(files), release)))
    steps = [step("one", a="a_*.txt"), step("two", a="a_*.txt", b="b_*.txt"), step("three", c="c_*.xml"), chain.Step("four", {"d": "d_*"}, lambda s, files, release: 1 / 0, {"d": "packaged"})]
    releases = {"one": "r", "two": "r", "three": "r", "four": "r"}
    log = lambda *x: heard.append(x)
    assert chain.run_chain(spark, steps, folder, releases, log, only=["two", "one"]) == ["one", "two"] and ran == [("one", ["a"], "r"), ("two", ["a", "b"], "r")]
    assert heard == [("one", "begun"), ("one", "finished"), ("two", "begun"), ("two", "finished")]
    for only, stated, why in ((["three"], releases, "2 files match"), (["nine"], releases, "no such"), (["one"], {}, "no release"), (["one", "two"], {"one": "r", "two": "s"}, "can't be of release")):
        ran.clear()
        with pytest.raises(chain.ChainError, match=why):
            chain.run_chain(spark, steps, folder, stated, log, only=only)
        assert not ran
    with pytest.raises(ZeroDivisionError):
        chain.run_chain(spark, steps, folder, releases, log, skip=["three"])
    assert ran == [("one", ["a"], "r"), ("two", ["a", "b"], "r")] and heard[-1] == ("four", "failed")

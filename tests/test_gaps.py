"""Each kind of gap on a few rows: what is one, what is none, nulls, repeats and empty tables."""

import pytest

from rulespan.operators import conditions, gaps, rules

RUNS = [(1, "r1"), (2, "r2")]


@pytest.fixture()
def t(spark):
    def table(schema, *rows):
        return spark.createDataFrame(list(rows), schema)

    return table


@pytest.fixture()
def runs(t):
    return t("run_id long, release string", *RUNS)


@pytest.fixture()
def concepts(t):
    return t("concept long, name string, concept_type string, run long", (1, "one", "PE", 1), (2, "two", "MoA", 2), (3, "three", "PE", 2), (4, "four", "PE", 9))


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


REACH = "subject long, object long, rel string, source string, run long, subtree_partner_count long, direct_partner_count long"


def test_unclassified(t):
    entities = t("entity long, name string", (1, "a"), (2, "b"), (3, None))
    members = t("entity long, concept long, axis string", (1, 5, "R"), (2, 5, "A"), (None, 5, "R"))
    assert {r.entity for r in gaps.unclassified(entities, members, "R").collect()} == {2, 3}
    assert gaps.unclassified(entities.limit(0), members, "R").count() == 0


def test_unpopulated_asks_for_the_subtree(t, concepts, runs):
    reach = t(REACH, (7, 1, "A", "S", 1, 0, 0), (8, 1, "A", "S", 2, 0, 0), (7, 2, "A", "S", 1, 3, 0), (7, 4, "A", "S", 99, 0, 0))
    assert rows(gaps.unpopulated(reach, concepts, runs), "concept", "rules", "release") == [(1, 2, "r2")]
    assert gaps.unpopulated(reach.limit(0), concepts, runs).count() == 0


def test_dead_by_policy_asks_for_partners_below_and_none_directly(t, concepts, runs):
    axis = t("rel string, expands boolean", ("A", True), ("R", False))
    policy = t("concept long, decision string, superseded_by long", (1, "deny", None), (2, "deny", 5), (3, "withdrawn", None))
    reach = t(REACH, (7, 1, "A", "S", 1, 4, 0), (8, 1, "A", "T", 2, 6, 0), (9, 1, "A", "S", 1, 6, 1), (9, 1, "A", "S", 1, 0, 0), (9, 1, "R", "S", 1, 4, 0), (7, 2, "A", "S", 1, 4, 0), (7, 3, "A", "S", 1, 4, 0))
    assert rows(gaps.dead_by_policy(reach, axis, policy, concepts, runs), "concept", "rules", "subtree_partners", "release") == [(1, 2, 6, "r2")]


def test_unreviewed_roots_count_a_class_rule_once_for_both_ends(t, concepts, runs):
    axis = t("rel string, expands boolean", ("A", True), ("R", False))
    rule = t("object long, rel string, run long", (1, "A", 1), (1, "R", 1), (2, "A", 1))
    crule = t("subject_class long, object_class long, rel string, run long", (1, 1, "A", 2), (3, 1, "A", 2))
    subtree = t("root long, node long", *[(r, n) for r in (1, 2, 3) for n in range(100 * r, 100 * r + (23 if r < 3 else 21))])
    policy = t("concept long, decision string, superseded_by long", (2, "allow", None))
    got = gaps.unreviewed_roots(rule, crule, axis, subtree, policy, concepts, runs)
    assert rows(got, "concept", "descendants", "rules", "release") == [(1, 22, 3, "r2")]


def test_unmatched_takes_the_newest_run_and_named_rows_first(t, runs):
    unmatched = t("rxcui string, name string, run long, reason string", ("a", "old", 1, "x"), ("a", None, 2, "a"), ("a", "new", 2, "z"), ("b", "n", 1, "x"), ("c", "n", 1, "x"), (None, "n", 1, "x"))
    claims = t("scheme string, value string, superseded_by long", ("RXNORM_IN", "b", None), ("RXNORM_IN", "c", 4), ("CAS", "a", None))
    assert {(r.rxcui, r.name, r.release) for r in gaps.unmatched_names(unmatched, claims, runs).collect()} == {("a", "new", "r2"), ("c", "n", "r1"), (None, "n", "r1")}


def test_unresolved_objects_fold_the_source(t, runs):
    rows_ = t("source string, code string, name string, rel string, kind string, assertions long, run long", ("mesh", "D1", "n", "b", "k", 2, 1), ("MeSH", "D1", "m", "a", "k", 3, 2), ("MeSH", "D1", None, "a", None, 1, 2))
    assert rows(gaps.unresolved_objects(rows_, runs)) == [("MESH", "D1", "n", "a, b", "k", 6, "r2")]


def test_conditions_without_indication(t):
    condition = t("condition string, name string, kind string, scr_class string", *[(c, c, "d", s) for c, s in (("a", None), ("b", None), ("c", "3"), ("d", "1"), ("e", "3"), ("f", None))])
    trees = t("condition string, tree string", ("a", "C1"), ("a", "D1"), ("b", "D2"), ("e", "D3"), ("f", "F1"))
    reach = t("condition string, direct_rules long, generalised_rules long", ("a", 0, 0), ("b", 0, 0), ("c", 0, 0), ("d", 0, 0), ("e", 0, 0), ("f", 0, 2))
    assert rows(gaps.conditions_without_indication(condition, trees, reach), "condition") == [("a",), ("c",)]


@pytest.fixture()
def below(t):
    return t("root long, node long", (1, 1), (1, 2), (2, 2), (3, 3), (5, 5))


@pytest.fixture()
def held(t):
    return t("entity long, concept long, axis string", *[(e, 2, x) for e in range(12) for x in "AN"], (50, 1, "A"), (60, 3, "A"), (2, 5, "A"))


def test_uncurated_effects(t, concepts, runs, below, held):
    rule = t("object long", (3,), (3,), (2,))
    effect = t("effect long, superseded_by long", (3, 7))
    got = gaps.uncurated_effects(concepts, runs, rule, effect, below, held)
    # Entities count once whatever their axes; the run of 4 isn't known; 2 is of another kind.
    assert rows(got, "concept", "rules", "members", "release") == [(1, 0, 13, "r1"), (3, 2, 1, "r2")]
    assert rows(gaps.uncurated_effects(concepts, runs, rule, t("effect long, superseded_by long", (1, None), (3, None)), below, held)) == []


EFFECT = "id long, effect long, accumulates boolean, t_major int, t_total int, run long, superseded_by long"
GRADE = "id long, effect long, contributor long, magnitude string, run long, superseded_by long"


def test_thresholds_leave_out_minor_graded_members(t, runs, below, held):
    effects = t(EFFECT, (1, 1, True, 0, 11, 1, None), (2, 2, True, 1, 1, 1, None), (3, 3, False, 0, 1, 1, None), (4, 5, True, 0, 1, 1, 9))
    none = t(GRADE, (1, 1, 2, "minor", 1, 8))
    assert rows(gaps.uncurated_thresholds(effects, none, below, held, runs), "effect", "graded", "ungraded") == [(1, 0, 13)]
    # Entity 2 is touched by a minor grade of 5; a grade of members that the effect doesn't have touches none.
    some = t(GRADE, (1, 1, 5, "minor", 1, None), (2, 1, 3, "major", 1, None))
    assert rows(gaps.uncurated_thresholds(effects, some, below, held, runs), "effect", "graded", "ungraded") == [(1, 1, 12)]
    assert gaps.uncurated_thresholds(effects, t(GRADE, (1, 1, 2, "minor", 1, None)), below, held, runs).count() == 0


def test_contributions(t, runs, below, held):
    effects = t(EFFECT, (1, 1, True, 0, 1, 1, None), (2, 3, False, 0, 1, 1, None), (3, 2, True, 0, 1, 1, 4))
    grades = t(GRADE, (1, 1, 2, "major", 1, 3), (2, 1, 1, "minor", 1, None), (3, 1, 3, "major", 2, None), (4, 1, 5, "minor", 2, None))
    assert rows(gaps.ungraded_contributions(effects, grades, below, held, runs)) == [(1, 2, 12, "r1")]
    # 3 shares no member with 1, 5 does; superseded grades are none.
    assert rows(gaps.ineffective_contributions(grades, below, held, runs)) == [(1, 3, "major", "r2")]


def test_compositions_and_contradictions(t):
    parts = t("composite long, component long, is_active boolean", (1, 1, None), (1, 2, None), (2, 1, None), (2, 2, False))
    assert rows(gaps.unruled_compositions(parts)) == [(1, 2)]
    rule = t("subject long, condition string, rel string", (1, "a", "F"), (1, "a", "P"), (1, "b", "F"), (2, "a", "F"))
    ind = t("subject long, condition string, rel string", (1, "a", "treat"), (1, "a", "prevent"), (2, "a", "treat"), (3, "a", "treat"))
    ruling = t("subject long, condition string, superseded_by long", (2, "a", None), (1, "a", 5))
    entities = t("entity long, name string", (1, "x"), (2, "y"))
    named = t("condition string, name string", ("a", "cond"))
    assert rows(gaps.uncurated_contradictions(rule, ind, ruling, entities, named)) == [(1, "a", "x", "cond", 2)]
    assert rows(conditions.contradictions(rule, ind)) == [(1, "a"), (2, "a")]


def test_uncurated_rules_count_partners_not_sources(t):
    pairs = t("subject long, object long, rel string, source string, partner long", (1, 2, "A", "S", 5), (1, 2, "A", "T", 5), (1, 2, "A", "S", 6), (1, 3, "A", "S", 5))
    ruling = t("subject long, object long, rel string, superseded_by long", (1, 3, "A", None), (1, 2, "A", 4))
    got = gaps.uncurated_rules(pairs, ruling, t("entity long, name string", (1, "e")), t("concept long, name string", (2, "c"), (3, "d")))
    assert rows(got, "subject", "object", "rel", "pairs", "object_name") == [(1, 2, "A", 2, "c")]


def test_endpoints_class_rules_and_cells(t, runs):
    ends = t("source string, entry string, role string, scheme string, value string, name string, run long", ("O", "e", "subject", "UNII", "a", "n", 1), ("O", "e", "subject", "UNII", "b", None, 2))
    assert rows(gaps.unresolved_endpoints(ends, runs)) == [("O", "e", "subject", "UNII", "b", "n", "r2")]
    reach = t("subject_class long, object_class long, rel string, source string, subject_effective long, object_effective long, max_pair_count long", (1, 2, "A", "S", 3, 4, 12), (1, 2, "A", "T", 3, 4, 12), (1, 3, "A", "S", 1, 1, 0), (1, 4, "A", "S", 1, 2, 2))
    ruling = t("subject_class long, object_class long, rel string, superseded_by long", (1, 4, "A", None))
    assert rows(gaps.uncurated_class_rules(reach, ruling), "subject_class", "object_class", "max_pair_count") == [(1, 2, 12)]
    cells = t("source string, raw_substance string, substance string, heading string, pathway string, disposition string, markers string, run long", ("F", "x 1", "x", "h", "1A2", "withheld_qualified", "1", 1), ("F", "x 2", "x", "h", "1A2", "withheld_qualified", "2", 2), ("F", "y", None, "h", "1A2", "unresolved_substance", "3", 1), ("F", "y", None, "g", "3A", "unresolved_substance", None, 1), ("F", "z", "z", "h", "3A", "member", None, 1))
    got = {(r.substance, r.heading, r.disposition, r.raw_substance, r.markers, r.release) for r in gaps.unadjudicated_cells(cells, runs).collect()}
    assert got == {("x", "h", "withheld_qualified", "x 2", "2", "r2"), ("y", None, "unresolved_substance", "y", None, "r1")}


def test_the_register_keeps_first_runs_and_what_was_worked_on(t):
    live = gaps.questions([t("kind string, gap_key string, text string", ("k", "a", "new a"), ("k", "b", "new b"))])
    old = gaps.questions([t("kind string, gap_key string, text string, first_run long, last_run long, is_current boolean", ("k", "a", "old a", 1, 2, True), ("k", "b", "old b", 1, 2, False), ("k", "c", "old c", 1, 2, True), ("k", "d", "old d", 1, 2, True), ("other", "a", "old", 1, 2, True))])
    work = old.where("gap_key = 'c'").select("question")
    got = {(r.kind, r.gap_key): (r.text, r.first_run, r.last_run, r.is_current) for r in gaps.register(old, live, work, 5).collect()}
    # A closed gap goes unless somebody worked on it; a reopened one is current again under its id.
    assert got == {("k", "a"): ("new a", 1, 5, True), ("k", "b"): ("new b", 1, 5, True), ("k", "c"): ("old c", 1, 2, False)}
    first = gaps.register(old.limit(0), live, work.limit(0), 3)
    assert {(r.gap_key, r.first_run, r.last_run) for r in first.collect()} == {("a", 3, 3), ("b", 3, 3)}
    assert gaps.register(old.limit(0), live.limit(0), work.limit(0), 3).count() == 0


def test_the_judgements_that_resolve_to_nothing(t):
    ruling = t("subject long, object long, rel string, superseded_by long", (1, 1, "A", None), (1, 2, "A", None), (1, 3, "A", 4))
    rule = t("subject long, object long, rel string", (1, 1, "A"))
    cruling = t("subject_class long, object_class long, rel string, superseded_by long", (1, 1, "A", None))
    crule = t("subject_class long, object_class long, rel string")
    cond = t("subject long, condition string, superseded_by long", (1, "a", None), (1, "b", None), (1, "c", None))
    known = t("subject long, condition string", (1, "a"))
    got = rules.unresolved_targets(ruling, rule, cruling, crule, cond, known, t("subject long, condition string", (1, "b")))
    assert {tuple(r) for r in got.collect()} == {("ruling", "1", "2", "A"), ("cond_ruling", "1", "c", None), ("class_ruling", "1", "1", "A")}

import uuid

import pytest
from pyspark.sql import functions as F

from rulespan.functions import text as T
from rulespan.operators import core, rules

RULE = "subject long, object long, rel string, source string"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture()
def world(spark):
    # 1 over 2 and 3, both over 4 (a diamond); 5 and 6 over each other (a cycle).
    edge = frame(spark, [(2, 1), (3, 1), (4, 2), (4, 3), (5, 6), (6, 5)], "child long, parent long")
    membership = frame(spark, [(10, 1, "A"), (11, 4, "A"), (12, 4, "N"), (7, 4, "A"), (13, 5, "A"), (11, 2, "A")], "entity long, concept long, axis string")
    axis = frame(spark, [("A", "A", True), ("R", "R", False)], "rel string, membership_axis string, expands boolean")
    return edge, membership, axis


def policy(spark, rows=()):
    return frame(spark, [(i, c, d, None) for i, (c, d) in enumerate(rows)], "policy_id long, concept long, decision string, superseded_by long")


def test_closure_ends_on_cycles_and_dedupes_diamonds(spark, world):
    edge, _, _ = world
    got = {tuple(r) for r in core.closure(edge, frame(spark, [(1,), (5,)], "root long")).collect()}
    assert got == {(1, 1), (1, 2), (1, 3), (1, 4), (5, 5), (5, 6)}
    up = {tuple(r) for r in core.closure(edge, frame(spark, [(4,)], "root long"), up=True).collect()}
    assert up == {(4, 4), (4, 2), (4, 3), (4, 1)}


def test_closure_of_no_roots_is_empty(spark, world):
    assert core.closure(world[0], frame(spark, [], "root long")).count() == 0
    assert core.closure(world[0].limit(0), frame(spark, [(3,), (None,), (3,)], "root long").where("true")).collect() == [(3, 3)]


def test_closure_by_joins_and_in_one_pass_agree(spark, monkeypatch):
    import random

    rng = random.Random(6)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(90)] + [(i + 100, i + 101) for i in range(30)] + [(None, 3), (4, None), (5, 5)]
    for kind, of in (("long", lambda x: x), ("string", lambda x: None if x is None else f"n{x}")):
        edge = frame(spark, [(of(a), of(b)) for a, b in pairs], f"child {kind}, parent {kind}")
        roots = frame(spark, [(of(x),) for x in (*range(0, 60, 7), 130, 999, None, 7)], f"root {kind}")
        one = {tuple(r) for r in core.closure(edge, roots).collect()}
        monkeypatch.setattr(core, "WALKED", 5)
        assert {tuple(r) for r in core.closure(edge, roots).collect()} == one
        monkeypatch.setattr(core, "HELD", 10)
        assert {tuple(r) for r in core.closure(edge, roots).collect()} == one
        monkeypatch.undo()
        children = {}
        for a, b in pairs:
            children.setdefault(b, set()).add(a)
        want = set()
        for r in (*range(0, 60, 7), 130, 999, 7):
            seen, todo = {r}, [r]
            while todo:
                for c in children.get(todo.pop(), ()):
                    if c is not None and c not in seen:
                        seen.add(c)
                        todo.append(c)
            want |= {(of(r), of(x)) for x in seen}
        assert one == want


@pytest.mark.parametrize("decisions, want", [((), {(10, 1, True), (11, 2, False)}), (((1, "deny"),), {(10, 1, True)}), (((1, "allow"),), {(10, 1, True), (11, 2, False)}), (((1, "withdrawn"),), {(10, 1, True), (11, 2, False)}), (((2, "deny"),), {(10, 1, True), (11, 2, False)})])
def test_candidate_pairs_follow_axis_and_policy(spark, world, decisions, want):
    edge, membership, axis = world
    rule = frame(spark, [(7, 1, "A", "S")], RULE)
    got = rules.candidate_pairs(rule, axis, edge, membership, policy(spark, decisions)).collect()
    assert {(r.partner, r.member_class, r.is_direct) for r in got} == want


def test_reach_counts_what_pairs_list(spark, world):
    edge, membership, axis = world
    rule = frame(spark, [(7, 1, "A", "S"), (99, 1, "A", "S"), (99, 9, "A", "S")], RULE)
    got = {(r.subject, r.object): (r.subtree_partner_count, r.direct_partner_count) for r in rules.rule_reach(rule, axis, edge, membership).collect()}
    assert got == {(7, 1): (2, 1), (99, 1): (3, 1), (99, 9): (0, 0)}


def test_overlay_violations_are_found(spark):
    log = frame(spark, [(1, "a", 2), (2, "a", None), (3, "a", None), (5, "b", 4), (4, "b", None), (6, "c", 2), (7, None, None)], "id long, k string, superseded_by long")
    got = {(r.kind, r.id) for r in core.overlay_violations(log, ["k"]).collect()}
    assert got == {("many live", 3), ("not later", 5), ("not later", 6), ("wrong target", 6), ("null key", 7)}


def test_rebuild_insert_and_upsert(spark):
    old = frame(spark, [(1, "x"), (2, "y")], "k long, source string")
    assert sorted(tuple(r) for r in core.rebuild(old, frame(spark, [(3, "x")], "k long, source string"), "x").collect()) == [(2, "y"), (3, "x")]
    assert [tuple(r) for r in core.insert_if_absent(old, frame(spark, [(2, "z"), (4, "b"), (4, "a")], "k long, source string"), ["k"]).collect()] == [(4, "a")]
    a = frame(spark, [(1, "old", 1)], "k long, v string, first_run long")
    b = frame(spark, [(1, "new", 2), (2, "n", 2)], "k long, v string, first_run long")
    assert sorted(tuple(r) for r in core.upsert_first_seen(a, b, "k").select("k", "v", "first_run", "is_new").collect()) == [(1, "new", 1, False), (2, "n", 2, True)]


def test_effective_pairs_rank_unrankable_first_and_entity_grain_on_ties(spark):
    schema = "subject long, partner long, rel string, candidate_source string, via_subject_class long, via_class long, member_class long, severity string, evidence string, reviewed_at long, reviewed_by string, grain string, effective_rank int"
    rows = [(1, 2, "A", "S", None, 5, 5, "major", "e", 1, "x", "entity_rule", 2), (1, 2, "A", "S", 4, 5, 5, "minor", "e", 1, "x", "class_rule", 0), (3, 4, "A", "S", 4, 5, 5, "major", "e", 1, "x", "class_rule", 2), (3, 4, "A", "S", None, 5, 5, "major", "e", 1, "x", "entity_rule", 2), (5, 6, "A", None, 4, 5, 5, "a", "e", None, None, "class_rule", 1), (5, 6, "A", "S", 4, 5, 5, "b", "e", 1, "x", "class_rule", 1)]
    got = {(r.subject, r.grain, r.severity) for r in rules.effective_pairs(frame(spark, rows, schema)).collect()}
    # Nulls come last among ties.
    assert got == {(1, "class_rule", "minor"), (3, "entity_rule", "major"), (5, "class_rule", "b")}
    assert rules.effective_pairs(frame(spark, [], schema)).count() == 0


def test_thresholds(spark):
    df = frame(spark, [(1, 3, 1, 3), (0, 3, 1, 3), (0, 0, 0, 1)], "m int, t int, tm int, tt int")
    got = [r[0] for r in df.select(rules.fires(F.col("m"), F.col("t"), F.col("tm"), F.col("tt"))).collect()]
    assert got == [True, False, False]
    with pytest.raises(Exception, match="impossible counts"):
        frame(spark, [(2, 1, 0, 1)], "m int, t int, tm int, tt int").select(rules.fires(F.col("m"), F.col("t"), F.col("tm"), F.col("tt"))).collect()


def test_uuid5_is_the_standard_one(spark):
    keys = ["CLASS:1", "ü:é", ""]
    got = [r[0] for r in frame(spark, [(k,) for k in keys], "k string").select(T.uuid5(F.col("k"))).collect()]
    assert got == [str(uuid.uuid5(uuid.UUID(T.NAMESPACE), k)) for k in keys]


def test_names(spark):
    row = frame(spark, [("Alpha  (x) With beta, ALPHA and Gamma (&) delta",), (" , ",)], "n string").select(T.components(F.col("n"))).collect()
    assert [r[0] for r in row] == [["alpha", "beta", "gamma", "delta"], ["<no name>"]]
    s = frame(spark, [("abc sodium",), ("sodium",), ("abc sodium sodium",)], "n string").select(T.strip_suffix(F.col("n"), ["sodium"])).collect()
    assert [r[0] for r in s] == ["abc", None, "abc sodium"]
    t = frame(spark, [("A.1.2",), ("A",)], "n string").select(T.ancestors(F.col("n"))).collect()
    assert [r[0] for r in t] == [["A", "A.1"], []]


def test_payload_tells_null_from_empty(spark):
    got = [r[0] for r in frame(spark, [(None,), ("",), ("é",)], "n string").select(T.payload("c/1", [("n", F.col("n"))])).collect()]
    assert got == ["payload/1\nc/1\n1\n1:n:N:0:\n", "payload/1\nc/1\n1\n1:n:S:0:\n", "payload/1\nc/1\n1\n1:n:S:2:é\n"]


def test_queries_have_sql():
    from rulespan import catalog

    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_relations_read_whole_tables(spark, tmp_path):
    from rulespan.catalog import queries
    from rulespan.plans.adapters import relation

    d = str(tmp_path)
    frame(spark, [(i, i % 9, "1995-01-01", "F", "1-HIGH") for i in range(40)], "o_orderkey long, o_custkey long, o_orderdate string, o_orderstatus string, o_orderpriority string").selectExpr("* except (o_orderdate)", "cast(o_orderdate as timestamp) as o_orderdate").write.parquet(f"{d}/orders.parquet")
    frame(spark, [(i, 20 + i % 5, i % 11, "A") for i in range(40)], "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string").write.parquet(f"{d}/lineitem.parquet")
    frame(spark, [(i,) for i in range(64)], "p_partkey long").write.parquet(f"{d}/part.parquet")
    frame(spark, [(i, 1) for i in range(11)], "s_suppkey long, s_nationkey int").write.parquet(f"{d}/supplier.parquet")
    frame(spark, [(i, i % 3) for i in range(60)], "c_custkey long, c_nationkey int").write.parquet(f"{d}/customer.parquet")
    frame(spark, [(i, i % 5, f"n{i}") for i in range(25)], "n_nationkey int, n_regionkey int, n_name string").write.parquet(f"{d}/nation.parquet")
    assert {r.id for r in relation(spark, d, "signature").collect()} == set(range(40))
    assert {r.composite for r in queries()["group_fires"](spark, d).collect()} == set(range(40))
    assert {r.root for r in queries()["closure_up"](spark, d).collect()} == set(range(64))
    # Every customer makes a rule, and those of nations come on top.
    want = {(i % 11, 16 + i % 48 if i % 3 == 0 else i * 7 % 64) for i in range(60)}
    got = {(r.subject, r.object) for r in relation(spark, d, "rule").collect()}
    assert {x for x in got if x[1] < 5_000_000} == want and len(got) == len(want) + 50


def test_class_pairs_reach_and_curated_grains(spark, world):
    edge, membership, axis = world
    schema = "subject_class long, object_class long, rel string, source string"
    crule = frame(spark, [(1, 4, "A", "S"), (1, 4, "A", "T"), (4, 4, "A", "S"), (9, 1, "R", "S")], schema)
    got = {(r.subject_class, r.object_class, r.source): (r.subject_subtree, r.subject_direct, r.subject_effective, r.object_effective, r.shared_members, r.max_pair_count) for r in rules.class_pair_reach(crule, axis, edge, membership, policy(spark)).collect()}
    assert got == {(1, 4, "S"): (3, 1, 3, 2, 2, 4), (1, 4, "T"): (3, 1, 3, 2, 2, 4), (4, 4, "S"): (2, 2, 2, 2, 2, 2), (9, 1, "S"): (0, 0, 0, 0, 0, 0)}
    denied = rules.class_pair_reach(crule, axis, edge, membership, policy(spark, ((1, "deny"),)))
    assert denied.where("subject_class = 1").select("subject_effective", "max_pair_count").distinct().collect() == [(1, 2)]
    rule = frame(spark, [(7, 1, "A", "S")], RULE)
    pairs = rules.candidate_pairs(rule, axis, edge, membership, policy(spark))
    graded = "severity string, evidence string, reviewed_at long, reviewed_by string, superseded_by long"
    ruling = frame(spark, [(7, 1, "A", True, "major", "e", 1, "x", None), (7, 1, "A", True, "minor", "e", 0, "x", 5)], f"subject long, object long, rel string, applies boolean, {graded}")
    cruling = frame(spark, [(1, 4, "A", True, "odd", "e", 1, "x", None), (4, 4, "A", False, None, None, 1, "x", None)], f"subject_class long, object_class long, rel string, applies boolean, {graded}")
    severity = frame(spark, [("major", 2)], "severity string, rank int")
    curated = rules.curated_pairs(pairs, ruling, crule, cruling, severity, axis, edge, membership, policy(spark)).cache()
    one = {(r.subject, r.partner, r.severity, r.effective_rank) for r in curated.where("grain = 'entity_rule'").collect()}
    two = sorted((r.subject, r.partner, r.candidate_source) for r in curated.where("grain = 'class_rule'").collect())
    assert one == {(7, 10, "major", 2), (7, 11, "major", 2)}
    assert two == sorted((a, b, s) for a in (7, 10, 11) for b in (7, 11) if a != b for s in "ST")
    best = {(r.subject, r.partner): r.severity for r in rules.effective_pairs(curated).collect()}
    # A grade without a rank comes before all others.
    assert best == {(7, 10): "major", (7, 11): "odd", (10, 7): "odd", (10, 11): "odd", (11, 7): "odd"}
    # The same by numbers of judged rules, with all columns.
    fast = rules.effective_grades(rule, ruling, crule, cruling, severity, axis, edge, membership, policy(spark))
    slow = rules.effective_pairs(curated)
    assert sorted(map(str, fast.select(*slow.columns).collect())) == sorted(map(str, slow.collect()))
    found = {(r.rule_subject, r.class_subject, r.partners) for r in rules.disagreements(curated).collect()}
    assert found == {(7, 1, 2)}


def test_accumulation(spark, world):
    edge, membership, _ = world
    effects = frame(spark, [(1, 1, True, None), (2, 2, True, 9), (3, 3, False, None)], "id long, effect long, accumulates boolean, superseded_by long")
    grades = frame(spark, [(1, 1, 2, "major", None), (2, 1, 4, "major", 9), (3, 1, 4, "minor", None), (4, 1, 5, "major", None)], "id long, effect long, contributor long, magnitude string, superseded_by long")
    got = {(r.effect, r.entity): r.magnitude for r in rules.contributors(effects, grades, edge, membership).collect()}
    # A grade touches members under it, by any axis, but adds none.
    assert got == {(1, 10): "minor", (1, 11): "major", (1, 12): "major", (1, 7): "major"}
    regimen = frame(spark, [("r", 10), ("r", 11), ("r", 11), ("s", 99)], "regimen string, entity long")
    counts = [(r.effect, r.regimen, r.majors, r.total) for r in rules.effect_counts(rules.contributors(effects, grades, edge, membership), regimen).collect()]
    assert counts == [(1, "r", 1, 2)]


def test_supersession_and_first_rows(spark):
    log = frame(spark, [(1, "a"), (3, "a"), (2, "b"), (5, None)], "id long, k string")
    assert {(r.id, r.superseded_by) for r in core.supersede(log, ["k"]).collect()} == {(1, 3), (3, None), (2, None), (5, None)}
    first = core.pick_first(frame(spark, [(1, 2), (1, 1), (None, 7)], "k long, v long"), ["k"], F.col("v").asc())
    assert {tuple(r) for r in first.collect()} == {(1, 1), (None, 7)}
    outcome = core.withdraw(frame(spark, [("a",)], "k string"), frame(spark, [("a",), ("z",), ("a",)], "k string"), ["k"])
    assert {(r.k, r.outcome) for r in outcome.collect()} == {("a", "written"), ("z", "refused")}
    with pytest.raises(ValueError, match="allow the loss"):
        core.shrink_guard(4, 10)
    core.shrink_guard(4, 10, allowed=True)
    core.shrink_guard(0, 0)


def test_text_functions(spark):
    raw = frame(spark, [("Ångström &amp; Straße--2",), (None,), ("  ",)], "n string").select(T.accent_folded(F.col("n"))).collect()
    assert [r[0] for r in raw] == ["angstrom strasse 2", None, ""]
    kind, value = T.registry_number(F.col("n"))
    numbers = frame(spark, [("ABCDEFGHI1 (x)",), ("50-00-0",), ("0",), (None,), ("abcdefghi1",)], "n string").select(kind, value).collect()
    assert [tuple(r) for r in numbers] == [("UNII", "ABCDEFGHI1"), ("CAS", "50-00-0"), (None, "0"), (None, None), (None, "abcdefghi1")]
    ids = frame(spark, [(i,) for i in range(10)], "k long")
    assert sorted(r.k for r in T.even_sample(ids, "k", 4).collect()) == [0, 3, 6, 9]
    assert T.even_sample(ids, "k", 20).count() == 10 and T.even_sample(ids, "k", 0).count() == 0
    assert [r.k for r in T.even_sample(ids, "k", 1).collect()] == [0]
    key = T.rendered_key(("A", F.col("n")), ("B", F.lit("x/y")))
    rows = frame(spark, [("1",), (None,)], "n string").select(key.alias("k")).select("k", T.parsed_key(F.col("k"), ("A", "B")).alias("p")).collect()
    assert rows[0].k == "A:1/B:x/y" and (rows[0].p.A, rows[0].p.B) == ("1", "x/y") and rows[1].k is None and rows[1].p is None
    with pytest.raises(TypeError, match="no canonical text"):
        T.rendered(F.lit(1.5), "double")
    got = frame(spark, [(True, bytearray(b"\xab"))], "b boolean, y binary").select(T.rendered(F.col("b"), "boolean"), T.rendered(F.col("y"), "binary"), T.rendered(F.lit("2024-01-02 03:04:05").cast("timestamp"), "timestamp")).first()
    assert tuple(got) == ("true", "ab", "2024-01-02T03:04:05.000000Z")
    member = T.payload("c", [("n", F.lit("x"))], [("g", F.array(F.lit("é"), F.lit("z"), F.lit("a")))])
    assert spark.range(1).select(member).first()[0] == "payload/1\nc\n1\n1:n:S:1:x\n1:g:3\n1:a\n1:z\n2:é\n"
    gate = T.admission_signals(F.lit(False), F.lit(True), F.lit(True), F.lit(None).cast("string"), F.lit(True))
    assert spark.range(1).select(gate).first()[0] == ["USAN_ID", "LEGACY_ALLOWLIST"]


def test_no_rule_query_needs_the_corpus_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['rulespan.llm'] = None\nfrom rulespan import catalog; print(len(catalog.queries()))"
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=__file__.rsplit("/tests/", 1)[0]).stdout) > 100

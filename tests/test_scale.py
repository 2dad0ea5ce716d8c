"""What only shows on larger tables or other key ranges."""

from pyspark.sql import functions as F

from rulespan import catalog
from rulespan.functions import text as T
from rulespan.operators import rules


def test_even_sample_over_several_range_partitions(spark):
    # Range bounds are sampled anew in each run, which only shows where a sample doesn't hold all rows.
    ids = spark.range(0, 300_000, 1, 8).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    wanted = sorted({round(i * 299_999 / 36) for i in range(37)})
    assert sorted((r.k, r.v) for r in T.even_sample(ids, "k", 37).collect()) == [(k, 2 * k) for k in wanted]


def test_a_new_run_that_bears_a_stored_runs_number_stays_open(spark, tmp_path):
    when = F.lit("2000-01-01 00:00:00").cast("timestamp")
    ids = spark.createDataFrame([(5_000_020,), (40,), (41,)], "o_orderkey long")
    ids.select("o_orderkey", F.lit("p").alias("o_orderpriority"), F.lit("O").alias("o_orderstatus"), when.alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(20,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    got = catalog.queries()["run_ledger"](spark, str(tmp_path)).collect()
    assert sorted((r.run_id, r.source, r.finished is None) for r in got) == [(40, "p", False), (41, "p", False), (5_000_020, "S", True), (5_000_020, "p", False)]


def test_elements_are_not_gathered_in_one_document(spark, tmp_path):
    from rulespan.catalog import files
    from rulespan.sources import records

    spark.range(0, 900, 1, 3).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    element = "select concat('<concept><namespace>MED-RT</namespace><name>n</name><code>C', p_partkey, '</code><status>A</status><property><name>CTY</name><value>PE</value></property></concept>') as value from {part}"
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        path = files._xml(spark, str(tmp_path), "test", element, "select '<association><name>odd</name></association>' as value from {part}", compression="gzip")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    documents = spark.read.text(path).groupBy(F.input_file_name()).agg(F.count_if(F.col("value") == "<root>").alias("open"), F.count_if(F.col("value") == "</root>").alias("shut"), F.count("*").alias("n")).collect()
    assert len(documents) > 2 and all((r.open, r.shut) == (1, 1) and r.n < 900 for r in documents)
    got = records.concept_release(spark, path)
    assert got["classes"].select("code").distinct().count() == 900 and got["counts"].first().skipped_predicates == "odd"


def _small(spark):
    t = spark.createDataFrame
    rules = t([(1, 10, "N", "S1"), (1, 10, "N", "S2"), (2, 11, "N", "S1"), (3, 12, "N", "S1"), (4, 10, "R", "S1")], "subject long, object long, rel string, source string")
    edges = t([(11, 10), (12, 11)], "child long, parent long")
    membership = t([(1, 11, "N"), (2, 12, "N"), (3, 10, "N"), (4, 10, "R"), (5, 12, "N")], "entity long, concept long, axis string")
    axis = t([("N", "N", True), ("R", "R", False)], "rel string, membership_axis string, expands boolean")
    policy = t([(11, "deny", None)], "concept long, decision string, superseded_by long")
    return rules, axis, edges, membership, policy


def test_partners_are_counted_without_making_pairs(spark):
    small = _small(spark)
    pairs = rules.candidate_pairs(*small).groupBy("subject", "object", "rel").agg(F.countDistinct("partner").alias("pairs"))
    want = {tuple(r) for r in pairs.collect()}
    assert want == {(1, 10, "N", 3), (2, 11, "N", 1), (3, 12, "N", 2)}
    assert {tuple(r) for r in rules.rule_pairs(*small).collect()} == want


def test_grades_of_what_is_asked_only(spark):
    rule, axis, edges, membership, policy = _small(spark)
    graded = "applies boolean, severity string, evidence string, reviewed_by string, reviewed_at long, superseded_by long"
    ruling = spark.createDataFrame([(1, 10, "N", True, "major", "e", "c", 1, None), (2, 11, "N", True, "minor", "e", "c", 1, None)], "subject long, object long, rel string, " + graded)
    crule = spark.createDataFrame([(10, 12, "N", "S1")], "subject_class long, object_class long, rel string, source string")
    cruling = spark.createDataFrame([(10, 12, "N", True, "minor", "p", "c", 1, None)], "subject_class long, object_class long, rel string, " + graded)
    severity = spark.createDataFrame([("major", 2), ("minor", 4)], "severity string, rank int")
    of = lambda asked=None: {tuple(r) for r in rules.effective_grades(rule, ruling, crule, cruling, severity, axis, edges, membership, policy, asked).collect()}
    whole = of()
    assert {r[0] for r in whole} > {1, 2}
    assert of(spark.createDataFrame([(1,), (1,), (9,)], "subject long")) == {r for r in whole if r[0] == 1}
    asked = [(1, 5), (2, 1), (5, 2), (2, 2)]
    assert of(spark.createDataFrame(asked, "subject long, partner long")) == {r for r in whole if r[:2] in asked} != set()


def test_disagreements_are_counted_without_making_pairs(spark):
    rule, axis, edges, membership, policy = _small(spark)
    graded = "applies boolean, severity string, evidence string, reviewed_by string, reviewed_at long, superseded_by long"
    rows = [(1, 10, "major", "e"), (1, 10, None, "e"), (2, 11, "minor", "p"), (3, 12, "minor", None)]
    ruling = spark.createDataFrame([(s, o, "N", True, v, e, "c", 1, None) for s, o, v, e in rows], "subject long, object long, rel string, " + graded)
    crule = spark.createDataFrame([(10, 12, "N", "S1"), (10, 12, "N", "S2"), (12, 10, "N", "S1"), (11, 11, "N", "S1"), (10, 10, "N", "S1")], "subject_class long, object_class long, rel string, source string")
    rows = [(10, 12, "minor"), (12, 10, None), (11, 11, "major"), (10, 10, "minor")]
    cruling = spark.createDataFrame([(s, o, "N", True, v, "p", "c", 1, None) for s, o, v in rows], "subject_class long, object_class long, rel string, " + graded)
    severity = spark.createDataFrame([("major", 2), ("minor", 4)], "severity string, rank int")
    pairs = rules.candidate_pairs(rule, axis, edges, membership, policy)
    curated = rules.curated_pairs(pairs, ruling, crule, cruling, severity, axis, edges, membership, policy)
    want = sorted(map(str, rules.disagreements(curated).collect()))
    # Pairs are made of judged rules only, each with what its rule has.
    direct = rules.curated_grades(rule, ruling, crule, cruling, severity, axis, edges, membership, policy)
    assert sorted(direct.columns) == sorted(curated.columns)
    assert sorted(map(str, direct.select(*curated.columns).collect())) == sorted(map(str, curated.collect()))
    counted = rules.disagreement_counts(rule, ruling, crule, cruling, axis, edges, membership, policy)
    assert len(want) > 9 and sorted(map(str, counted.collect())) == want
    assert "partner" not in counted._jdf.queryExecution().toString().replace("partners", "")


def test_rules_of_one_condition_are_read_down_and_up_by_all_tasks(spark, monkeypatch):
    from rulespan.operators import conditions

    monkeypatch.setattr(conditions, "TILE", 8, raising=False)
    # As where nothing is small enough for every task: a join by condition leaves all of one's rows to one task.
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    t = spark.createDataFrame
    edges = t([(f"K{i}", "N0") for i in range(40)] + [("N0", "R0"), ("N1", "R0"), ("R0", "R1"), ("R1", "R0"), ("Q", "Q"), ("N9", None)], "child string, parent string")
    rows = [(s, "N0", "O", "S1") for s in range(40)] + [(None, "N0", "O", None), (7, "N0", "O", "S1"), (3, "R0", "O", "S2"), (3, "N0", "P", "S1"), (4, "K1", "O", "S1"), (5, "away", "O", "S1"), (6, None, "O", "S1"), (8, "N0", "X", "S1"), (9, "Q", "O", "S1")]
    rules = t(rows, "subject long, condition string, rel string, source string")
    axis = t([("O", True), ("P", False)], "rel string, expands boolean")
    below = {"N0": {f"K{i}" for i in range(40)}}
    below["R0"] = {"N0", "N1", "R1", *below["N0"]}
    want = [(s, c, m, m == c, r, o) for s, c, r, o in rows if c and r != "X" for m in [c, *(below.get(c, ()) if r == "O" else ())]]
    got = conditions.expanded_rules(rules, axis, edges)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    asked = [("K1",), ("K1",), ("R0",), ("away",), (None,), ("K9",)]
    got_up = conditions.rules_for(t(asked, "condition string"), rules, axis, edges)
    assert sorted(map(str, map(tuple, got_up.collect()))) == sorted(map(str, [w for w in want if (w[2],) in asked]))
    where = got.where("object = 'N0' and not is_direct").select("member", F.spark_partition_id().alias("task"))
    tasks = {r.task for r in where.collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert len(tasks) == 4


def _judged(spark):
    import random

    r, t = random.Random(5), spark.createDataFrame
    edges = t([(c, c // 2) for c in range(2, 16)] + [(11, 3), (13, 4)], "child long, parent long")
    membership = t([*((e, r.randrange(1, 16), r.choice("NNR")) for e in range(40) for _ in range(3)), (None, 5, "N")], "entity long, concept long, axis string").distinct()
    axis = t([("N", "N", True), ("R", "R", False)], "rel string, membership_axis string, expands boolean")
    policy = t([(3, "deny", None)], "concept long, decision string, superseded_by long")
    graded = "applies boolean, severity string, evidence string, reviewed_at long, reviewed_by string, superseded_by long"
    grade = lambda: (r.random() < 0.9, r.choice(["major", "minor", "odd", None]), r.choice(["e", None]), r.randrange(5), r.choice(["x", None]), r.choice([None, None, None, 1]))
    rule = sorted({(r.choice([*range(45)]), r.randrange(1, 16), r.choice("NR")) for _ in range(90)})
    crule = sorted({(r.randrange(1, 8), r.randrange(1, 16), r.choice("NR")) for _ in range(12)})
    rules_ = t([*((*k, r.choice("ST")) for k in rule), (None, 5, "N", "S")], "subject long, object long, rel string, source string")
    rulings = t([*((*k, *grade()) for k in rule), (None, 5, "N", True, "major", "e", 1, "x", None)], f"subject long, object long, rel string, {graded}")
    classes = t([(*k, s) for k in crule for s in "ST"], "subject_class long, object_class long, rel string, source string")
    class_rulings = t([(*k, *grade()) for k in crule], f"subject_class long, object_class long, rel string, {graded}")
    return rules_, rulings, classes, class_rulings, t([("major", 2), ("minor", 3)], "severity string, rank int"), axis, edges, membership, policy


def test_effective_grades_are_found_in_tiles_and_no_pair_is_moved(spark, monkeypatch):
    rule, ruling, crule, cruling, severity, axis, edges, membership, policy = given = _judged(spark)
    pairs = rules.candidate_pairs(rule, axis, edges, membership, policy)
    want = rules.effective_pairs(rules.curated_pairs(pairs, ruling, crule, cruling, severity, axis, edges, membership, policy))
    columns = want.columns
    want = sorted(map(str, want.collect()))
    assert len(want) > 500
    # Two tiles across by four partitions, and seven by their size, which hand over a few lists at once.
    for tile, entries in ((4096, 262_144), (7, 5)):
        monkeypatch.setattr(rules, "TILE", tile, raising=False)
        monkeypatch.setattr(rules, "ENTRIES", entries, raising=False)
        got = rules.effective_grades(*given)
        assert sorted(map(str, got.select(*columns).collect())) == want
        plan = [x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning(" in x]
        assert plan and not any("subject#" in x.split("ENSURE")[0] and "partner#" in x.split("ENSURE")[0] for x in plan)
    nothing = [ruling.limit(0), crule, cruling.limit(0)]
    assert rules.effective_grades(rule, *nothing, *given[4:]).count() == 0
    one = spark.createDataFrame([(i,) for i in range(3)], "subject long")
    asked = rules.effective_grades(*given, one)
    assert sorted(map(str, asked.select(*columns).collect())) == [x for x in want if x.startswith(("Row(subject=0,", "Row(subject=1,", "Row(subject=2,"))]


def test_class_rules_meet_members_as_lists_and_no_partner_is_copied_for_every_task(spark, monkeypatch):
    rule, ruling, crule, cruling, severity, axis, edges, membership, policy = given = _judged(spark)
    pairs = rules.candidate_pairs(rule, axis, edges, membership, policy)
    want = rules.curated_pairs(pairs, ruling, crule, cruling, severity, axis, edges, membership, policy)
    columns = want.columns
    want = sorted(map(str, want.collect()))
    assert len(want) > 500
    for tile in (4096, 8):
        monkeypatch.setattr(rules, "TILE", tile)
        got = rules.curated_grades(*given)
        assert sorted(map(str, got.select(*columns).collect())) == want
        assert "sequence(" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_register_reads_members_and_counts_partners_once(spark, monkeypatch):
    from rulespan.catalog import gaps

    kinds = ("unpopulated_rule", "dead_by_policy", "uncurated_rule", "uncurated_class_rule", "unreviewed_root")
    alone = sorted(str(r) for kind in kinds for r in catalog.queries()[f"gap_{kind}"](spark, "/root/testdata/sf0.001").collect())
    counted, walked = [], []
    reach, closure = rules.rule_reach, gaps.core.closure
    monkeypatch.setattr(rules, "rule_reach", lambda *a: counted.append(1) or reach(*a))
    monkeypatch.setattr(gaps.core, "closure", lambda *a: walked.append(1) or closure(*a))
    held = gaps._held(spark, "/root/testdata/sf0.001")
    together = sorted(str(r) for kind in kinds for r in catalog.queries()[f"gap_{kind}"](spark, "/root/testdata/sf0.001", held).collect())
    assert together == alone and alone and (len(counted), len(walked)) == (1, 1)


def test_members_of_rules_are_moved_once(spark):
    rule, axis, edges, membership, policy = _small(spark)
    t = spark.createDataFrame
    rule = rule.union(t([(None, 10, "N", "S1"), (9, 99, "N", "S1")], rule.schema))
    got = rules.rule_reach(rule, axis, edges, membership)
    assert "membership_axis" in got._jdf.queryExecution().logical().toString()
    want = {(1, 10, "N", 3, 1), (2, 11, "N", 2, 1), (3, 12, "N", 2, 2), (4, 10, "R", 0, 0), (None, 10, "N", 4, 1), (9, 99, "N", 0, 0)}
    assert {(r.subject, r.object, r.rel, r.subtree_partner_count, r.direct_partner_count) for r in got.collect()} == want
    # What is counted was written, so that members aren't read again for rules.
    assert "entity" not in got._jdf.queryExecution().optimizedPlan().toString()

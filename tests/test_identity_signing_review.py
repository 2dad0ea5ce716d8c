"""Resolution, signatures, releases and review reads on a few rows."""

import pytest
from pyspark.sql import functions as F

from rulespan.functions import ed25519
from rulespan.operators import conditions, identity, review, signing


@pytest.fixture()
def t(spark):
    def table(schema, *rows):
        return spark.createDataFrame(list(rows), schema)

    return table


def rows(df, *columns):
    return {tuple(r[c] for c in columns or df.columns) for r in df.collect()}


CLAIM = "entity long, scheme string, value string, superseded_by long"


def test_all_claimants_of_the_first_tier(t):
    claims = t(CLAIM, (1, "UNII", "a", None), (2, "UNII", "a", None), (3, "CAS", "x", None), (4, "UNII", "b", 9), (5, "CAS", "y", None), (4, "CAS", "y", None))
    records = t("record long, unii string, cas string", (1, "a", "x"), (2, "b", "y"), (3, None, "x"), (4, "z", None))
    tiers = [("unii", "UNII"), ("cas", "CAS")]
    # A superseded claim doesn't resolve, and so the second key is asked.
    assert rows(identity.by_tier(records, tiers, claims), "record", "entity", "method") == {(1, 1, "UNII"), (1, 2, "UNII"), (2, 5, "CAS"), (2, 4, "CAS"), (3, 3, "CAS")}
    assert rows(identity.first_by_tier(records, "record", tiers, claims)) == {(1, 1, "UNII"), (2, 4, "CAS"), (3, 3, "CAS"), (4, None, None)}
    assert identity.by_tier(records.limit(0), tiers, claims).count() == 0


def test_names_exact_before_stripped(t):
    named = t("name string, entity long", ("dimethyl fumarate", 1), ("dimethyl", 2), ("iron", 3), ("iron", 4))
    names = t("id long, name string", (1, "dimethyl fumarate"), (2, "iron fumarate"), (3, "fumarate"), (4, None))
    from rulespan.functions.text import strip_suffix

    got = identity.by_name(names, "name", named, strip_suffix(F.col("name"), ["fumarate"]))
    assert rows(got, "id", "entity", "method") == {(1, 1, "exact"), (2, 3, "salt_stripped"), (2, 4, "salt_stripped")}


def test_unique_or_none_and_buckets(t):
    claimed = t("k string, entity long", ("a", 1), ("a", 1), ("b", 1), ("b", 2), (None, 3))
    assert rows(identity.unique_or_unresolved(claimed, ["k"]), "k", "claimants", "entity") == {("a", 1, 1), ("b", 2, None), (None, 1, 3)}
    records = t("record long", *[(i,) for i in range(5)])
    found = t("record long, entity long", (0, 1), (1, 1), (1, 2))
    named = t("record long, entity long", (0, 7), (0, 8), (2, 1), (3, 1), (3, 2))
    got = rows(identity.bucketed(records, "record", found, named))
    assert got == {(0, "resolved_exact_claim", 1), (1, "ambiguous_identity", 2), (2, "candidate_unique_name", 1), (3, "ambiguous_name", 2), (4, "unresolved", 0)}
    forms = identity.with_forms(t("subject long", (1,), (2,)), t("composite long, component long, is_active boolean", (10, 1, True), (11, 1, None), (12, 3, True), (1, 1, True)))
    assert rows(forms) == {(1, 1), (1, 10), (2, 2)}


def test_trees(t):
    trees = t("condition string, tree string", ("a", "C1"), ("b", "C1.2"), ("c", "C1.22"), ("d", "C1.2.3"), ("d", "D9.1"), ("e", "C1.2.3.4.5"), ("b", "C1.2.3.4"), ("x", "E"), ("b", "E.1"), ("b", "E.1.1"))
    # The parent of D9.1 isn't registered; no condition is its own parent.
    assert rows(conditions.tree_edges(trees)) == {("b", "a"), ("c", "a"), ("d", "b"), ("b", "d"), ("e", "b"), ("b", "x")}
    assert rows(conditions.strictly_below(trees, t("tree string", ("C1.2",)))) == {("d",), ("b",), ("e",)}
    assert rows(conditions.strictly_below(trees, t("tree string", ("C1.22",), (None,)))) == set()


def test_rules_read_down_and_up_agree(t):
    edges = t("child string, parent string", ("b", "a"), ("c", "b"), ("c", "x"), ("a", "c"))
    axis = t("rel string, expands boolean", ("W", True), ("N", False))
    rule = t("subject long, condition string, rel string, source string", (1, "a", "W", "s"), (1, "b", "N", "s"), (2, "x", "W", "s"), (3, "a", "none", "s"), (4, "lone", "N", "s"))
    down = rows(conditions.expanded_rules(rule, axis, edges))
    up = rows(conditions.rules_for(t("condition string", ("a",), ("b",), ("c",), ("x",), ("lone",)), rule, axis, edges))
    assert down == up and (2, "x", "c", False, "W", "s") in down and (1, "b", "c", False, "N", "s") not in down and (4, "lone", "lone", True, "N", "s") in down
    reach = conditions.indication_reach(t("condition string", ("a",), ("b",), ("c",), ("none",)), rule, axis, t("child string, parent string", ("b", "a"), ("c", "b")))
    assert rows(reach) == {("a", 1, 0), ("b", 1, 1), ("c", 0, 1), ("none", 0, 0)}


KEYS = "id long, key_id long, status string, status_from long, superseded_by long"
STATUS = "status string, is_revocation boolean, invalidates_all boolean"


@pytest.fixture()
def keys(t):
    return t(KEYS, (1, 1, "active", 0, None), (2, 2, "retired", 10, None), (3, 3, "compromised", 5, 4), (4, 3, "active", 9, None), (5, 4, "odd", 0, None), (6, 5, "active", 0, 7))


@pytest.fixture()
def statuses(t):
    return t(STATUS, ("active", False, False), ("retired", True, False), ("compromised", True, True))


def test_signature_status_and_verdicts(t, keys, statuses):
    of = [(1, "k", 1, 1, 99), (2, "k", 2, 2, 9), (3, "k", 3, 2, 10), (4, "k", 4, 3, 1), (5, "k", 5, 4, 1), (6, "k", 6, 9, 1), (7, "k", 6, 3, 1), (8, "k", 7, 3, 1), (9, "k", 7, 1, 1), (10, "k", 8, 5, 1)]
    signatures = t("id long, kind string, target long, key_id long, signed_at long", *of)
    status = signing.signature_status(signatures, keys, statuses)
    assert {(r.target, r.status) for r in status.collect()} == {
        (1, "signed"), (2, "signed"), (3, "signed_by_revoked_key"),  # ended at that time
        (4, "signed_by_revoked_key"),  # it was compromised once, whatever it is now
        (5, "signed_by_revoked_key"),  # a status nobody lists vouches for nothing
        (6, "signed_by_unknown_key"), (7, "signed"), (8, "signed_by_unknown_key"),  # without a live row
    }
    judged = signing.verdicts(signatures, keys, statuses, F.col("id") != 9)
    got = {r.id: r.verdict for r in judged.collect()}
    assert got == {1: "valid", 2: "valid", 3: "key_expired", 4: "key_revoked_compromised", 5: "valid", 6: "unknown_key", 7: "key_revoked_compromised", 8: "key_revoked_compromised", 9: "bad_signature", 10: "unknown_key"}
    worst = {r.target: r.verdict for r in signing.worst_verdicts(judged, ["target"]).collect()}
    assert worst[7] == "bad_signature" and worst[6] == "key_revoked_compromised"
    assert rows(signing.key_status(keys, statuses)) == {(1, "active", 0), (2, "retired", 10), (3, "compromised", 5), (4, "odd", 0)}
    rulings = t("kind string, id long, reviewed_by string, reviewed_at long, superseded_by long", ("k", 1, "x", 1, None), ("k", 3, "x", 1, None), ("k", 77, "x", 1, None), ("k", 4, "x", 1, 5))
    assert rows(signing.pending(rulings, status), "id", "signatures") == {(3, 1), (77, 0)}
    trust = signing.key_trust(keys, signatures, t("kind string, target long", ("k", 3), ("k", 7)), status)
    assert rows(trust, "key_id", "signatures", "current_targets", "affected_targets") == {(1, 2, 1, 0), (2, 2, 1, 1), (3, 3, 1, 0), (4, 1, 0, 0)}


def test_ed25519_vectors_and_columns(spark):
    # RFC 8032, section 7.1, tests 1 and 2.
    for seed, public, message, signature in (
        ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
        ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
    ):
        s, p, m, want = (bytes.fromhex(x) for x in (seed, public, message, signature))
        assert ed25519.public_key(s) == p and ed25519.sign(s, m) == want and ed25519.verify(p, m, want)
        assert not ed25519.verify(p, m + b"x", want) and not ed25519.verify(p, m, want[:-1]) and not ed25519.verify(p[:-1], m, want)
        assert not ed25519.verify(p, m, want[:32] + ed25519.ORDER.to_bytes(32, "little"))
        assert not any(ed25519.verify(p, m, bytes([want[0] ^ 1 << i]) + want[1:]) for i in range(8))
    rows_ = [(bytearray(p), bytearray(m), bytearray(want)), (None, bytearray(m), bytearray(want)), (bytearray(p), bytearray(b"?"), bytearray(want))]
    got = spark.createDataFrame(rows_, "p binary, m binary, s binary").select(ed25519.verified(F.col("p"), F.col("m"), F.col("s"))).collect()
    assert [r[0] for r in got] == [True, None, False]


def test_release_diff(t):
    entry = "kind string, key string, digest string"
    published = t(entry, ("k", "a", "1"), ("k", "b", "1"), ("k", "c", "1"), ("k", "d", "1"))
    live = t(entry, ("k", "a", "1"), ("k", "b", "2"), ("k", "c", "2"), ("k", "e", "1"))
    history = t(entry, ("k", "b", "1"), ("k", "b", "1"), ("k", "c", "0"))
    diff = signing.release_diff(published, live, history)
    assert rows(diff, "key", "verdict") == {("a", "intact"), ("b", "revised"), ("c", "altered"), ("d", "dropped"), ("e", "added")}
    report = signing.release_report(diff, F.lit(4)).first()
    assert (report.dropped, report.added, report.altered, report.intact, report.row_count_ok, report.is_intact) == (2, 2, 1, 1, True, False)
    same = signing.release_report(signing.release_diff(published, published), F.lit(4)).first()
    assert same.is_intact and not signing.release_report(signing.release_diff(published, published), F.lit(5)).first().is_intact
    log = t("id long, superseded_by long", (1, 2), (2, 5), (3, None), (4, 5), (5, None), (7, 8), (8, 7))
    assert rows(signing.ancestry(log)) == {(5, 1), (5, 2), (5, 4)}


def test_lookup_answers_both_directions(t):
    effective = t("subject long, partner long, rel string, severity string, evidence string, effective_rank int", (1, 2, "A", "major", "e", 2), (2, 1, "A", "minor", "e", 3), (3, 1, "B", "x", None, 0))
    asked = t("a long, b long", (1, 2), (1, 3), (2, 3), (1, 1), (1, 9), (9, 9), (1, 2))
    got = review.lookup(effective, asked, t("entity long", (1,), (2,), (3,)))
    assert rows(got, "a", "b", "answer", "direction", "effective_rank") == {(1, 2, "graded", "forward", 2), (1, 2, "graded", "backward", 3), (1, 3, "graded", "backward", 0), (2, 3, "no_rule", None, None), (1, 1, "same_entity", None, None), (1, 9, "unknown_entity", None, None), (9, 9, "unknown_entity", None, None)}


QUEUE = "kind string, subject string, object string, subject_name string, object_name string, rels string, sources string, releases string, impact long"


def test_queue_pages_filters_and_metadata(t):
    queue = t(QUEUE, ("interaction_rule", "1", "1", "b", "x", "A", "S1", "r", 5), ("interaction_rule", "2", "1", "A", "x", "B", "S1,S2", "r", 5), ("condition_contradiction", "3", "c", "c", "y", "A,B", "S2", "r", 1))
    assert [r.subject for r in review.page(queue, 1, 2).collect()] == ["2", "1"]
    assert [r.subject for r in review.page(queue, 2, 2).collect()] == ["3"]
    assert review.page(queue, 9, 2).count() == 0
    with pytest.raises(ValueError, match="count from 1"):
        review.page(queue, 0)
    only = lambda **f: {r.subject for r in review.filtered(queue, **f).collect()}
    assert only(kind=" ", source=None, search="") == {"1", "2", "3"} and only(source="S2", rel="B") == {"2", "3"}
    assert only(search=" A X b ") == {"2"} and only(search="%") == set()
    meta = review.metadata(queue, review.filtered(queue, rel="A"), t("pairs long", (4,), (None,)))
    got = meta.first()
    assert (got.interaction_rules, got.condition_contradictions, got.kinds, got.all_sources, got.all_rels, got.total_items, got.reviewed_pairs) == (2, 1, "condition_contradiction,interaction_rule", "S1,S2", "A,B", 2, 4)
    assert review.with_metadata(meta, review.page(queue, 9, 2)).count() == 1
    none = review.metadata(queue.limit(0), queue.limit(0), t("pairs long")).first()
    assert (none.interaction_rules, none.kinds, none.all_sources, none.total_items, none.reviewed_pairs) == (0, "", "", 0, 0)


def test_decisions_and_worklist(t):
    log = t("k string, id long, severity string, superseded_by long", ("a", 1, "x", 2), ("a", 2, "y", None), ("b", 3, None, None))
    asked = t("k string, severity string, expected long", ("a", "y", 2), ("b", "z", 3), ("c", "z", None))
    assert rows(review.write_decision(log, asked, ["k"])) == {("a", "unchanged"), ("b", "written"), ("c", "written")}
    late = t("k string, severity string, expected long", ("a", "z", 1), ("b", "z", None), ("c", "z", 9))
    assert rows(review.write_decision(log, late, ["k"])) == {("a", "conflict"), ("b", "conflict"), ("c", "conflict")}
    question = t("question string, kind string, is_current boolean", ("p", "k", True), ("q", "k", True), ("r", "k", False), ("s", "k", True))
    state = t("id long, question string, state string", (1, "q", "open"), (2, "q", "withdrawn"), (3, "s", "parked"))
    tiers = t("source string, rank int", ("cheap", 1), ("mid", 2), ("dear", 3))
    checks = t("question string, source string", ("p", "cheap"), ("p", "cheap"), ("s", "cheap"), ("s", "mid"), ("s", "dear"), ("s", "other"))
    assert rows(review.worklist(question, state, tiers, checks)) == {("p", "k", "open", 2), ("s", "k", "parked", None)}
    assert rows(review.worklist(question, state.limit(0), tiers, checks.limit(0)), "question", "rank") == {("p", 1), ("q", 1), ("s", 1)}

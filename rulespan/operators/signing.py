"""Signatures, keys and releases: status, verdicts, and what a release differs in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulespan.operators.core import closure, pick_first

LIVE = "superseded_by is null"
#: Verdicts, the worst first.
VERDICTS = ("bad_signature", "key_revoked_compromised", "unknown_key", "key_expired", "valid")


def key_states(keys: DataFrame, statuses: DataFrame) -> DataFrame:
    """One row per key: what its live row says, and whether any row of it, however old,
    invalidates all its signatures. A key whose live row has an unlisted status keeps nulls."""
    kinds = F.broadcast(statuses)
    live = keys.where(LIVE).join(kinds, "status", "left").select("key_id", "status", "status_from", "is_revocation", "invalidates_all")
    ever = keys.join(kinds.where("invalidates_all"), "status").select("key_id").distinct().withColumn("ever_invalid", F.lit(True))
    return live.join(ever, "key_id", "left").withColumn("ever_invalid", F.coalesce("ever_invalid", F.lit(False)))


def key_status(keys: DataFrame, statuses: DataFrame) -> DataFrame:
    """The status that counts for each key: an invalidating row if there ever was one, else the live row."""
    rows = keys.join(F.broadcast(statuses), "status", "left").where(f"invalidates_all or {LIVE}")
    order = (F.coalesce("invalidates_all", F.lit(False)).desc(), F.desc("id"))
    return pick_first(rows, ["key_id"], *order).select("key_id", "status", "status_from")


def signature_status(signatures: DataFrame, keys: DataFrame, statuses: DataFrame) -> DataFrame:
    """Per (kind, target): signed if any signature is unobjected, else by whom it is not."""
    rows = signatures.join(key_states(keys, statuses), "key_id", "left")
    known = F.col("status").isNotNull()
    expired = F.col("is_revocation") & (F.col("signed_at") >= F.col("status_from"))
    unobjected = known & ~F.col("invalidates_all") & ~expired & ~F.col("ever_invalid")
    out = rows.groupBy("kind", "target").agg(
        F.count("*").alias("signatures"), F.count_if(~known).alias("unknown"), F.count_if(F.coalesce(unobjected, F.lit(False))).alias("unobjected")
    )
    status = F.when(F.col("unobjected") > 0, "signed").when(F.col("unknown") > 0, "signed_by_unknown_key").otherwise("signed_by_revoked_key")
    return out.select("kind", "target", "signatures", "unobjected", status.alias("status"))


def verdicts(signatures: DataFrame, keys: DataFrame, statuses: DataFrame, signature_ok: Column) -> DataFrame:
    """What each signature is worth, by the first that holds: nobody knows the key, the
    signature is wrong, the key was compromised, it had ended by then, or it is valid."""
    rows = signatures.join(key_states(keys, statuses), "key_id", "left")
    ended = F.col("is_revocation") & (F.col("signed_at") >= F.col("status_from"))
    verdict = (
        F.when(F.col("status").isNull(), "unknown_key").when(~signature_ok, "bad_signature")
        .when(F.col("invalidates_all") | F.col("ever_invalid"), "key_revoked_compromised").when(ended, "key_expired").otherwise("valid")
    )
    return rows.withColumn("verdict", verdict).select(*signatures.columns, "verdict")


def worst_verdicts(judged: DataFrame, by: list[str], order: tuple[str, ...] = VERDICTS) -> DataFrame:
    """The worst verdict of each group; groups without a signature aren't there."""
    rank = F.array_position(F.array(*[F.lit(v) for v in order]), F.col("verdict"))
    best = F.min(F.struct(rank.alias("rank"), "verdict")).alias("worst")
    return judged.groupBy(*by).agg(best).select(*by, F.col("worst.verdict").alias("verdict"))


def backdated(signatures: DataFrame, by: str = "1 day") -> DataFrame:
    """Signatures that claim a time well before they were recorded, with the lag in seconds."""
    late = signatures.where(F.col("signed_at") < F.col("recorded_at") - F.expr(f"interval {by}"))
    lag = F.unix_seconds(F.col("recorded_at").cast("timestamp")) - F.unix_seconds(F.col("signed_at").cast("timestamp"))
    return late.select("id", "kind", "target", "key_id", lag.alias("lag_seconds"))


def pending(rulings: DataFrame, status: DataFrame) -> DataFrame:
    """Live judgements (kind, id, reviewed_by, reviewed_at) without any unobjected signature."""
    of = status.select("kind", F.col("target").alias("id"), "signatures", "unobjected")
    rows = rulings.where(LIVE).join(of, ["kind", "id"], "left").where("coalesce(unobjected, 0) = 0")
    return rows.select("kind", "id", "reviewed_by", "reviewed_at", F.coalesce("signatures", F.lit(0)).cast("long").alias("signatures"))


def key_trust(keys: DataFrame, signatures: DataFrame, targets: DataFrame, status: DataFrame) -> DataFrame:
    """Each live key with its signatures, the distinct current targets it signed, and how many
    of those have no unobjected signature. ``targets(kind, target)`` are the live judgements."""
    per_key = signatures.groupBy("key_id").agg(F.count("*").alias("signatures"))
    current = signatures.select("key_id", "kind", "target").distinct().join(targets.distinct(), ["kind", "target"], "left_semi")
    current = current.join(status.select("kind", "target", "unobjected"), ["kind", "target"], "left")
    of = current.groupBy("key_id").agg(F.count("*").alias("current_targets"), F.count_if(F.col("unobjected") == 0).alias("affected_targets"))
    rows = keys.where(LIVE).join(per_key, "key_id", "left").join(of, "key_id", "left")
    return rows.na.fill(0, ["signatures", "current_targets", "affected_targets"]).select("key_id", "status", "status_from", "signatures", "current_targets", "affected_targets")


def release_diff(published: DataFrame, live: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Published entries against live ones, both (kind, key, digest): (kind, key, verdict).

    Equal digests are intact. A differing one is a revision if the published digest is in
    the live row's history, else an alteration. ``history(kind, key, digest)`` has what live rows superseded."""
    a = published.select("kind", "key", F.col("digest").alias("was"), F.lit(True).alias("in_published"))
    b = live.select("kind", "key", F.col("digest").alias("now"), F.lit(True).alias("in_live"))
    rows = a.join(b, ["kind", "key"], "full_outer")
    revised = F.lit(False)
    if history is not None:
        old = history.select("kind", "key", F.col("digest").alias("was"), F.lit(True).alias("superseded")).distinct()
        rows = rows.join(old, ["kind", "key", "was"], "left")
        revised = F.coalesce("superseded", F.lit(False))
    verdict = F.when(F.col("in_live").isNull(), "dropped").when(F.col("in_published").isNull(), "added")
    verdict = verdict.when(F.col("was").eqNullSafe(F.col("now")), "intact").when(revised, "revised").otherwise("altered")
    return rows.select("kind", "key", verdict.alias("verdict"))


def release_report(diff: DataFrame, published_rows: int | Column) -> DataFrame:
    """Counts of a release's check: a revision counts as dropped and as added."""
    n = lambda *v: F.count_if(F.col("verdict").isin(*v))
    out = diff.agg(n("dropped", "revised").alias("dropped"), n("added", "revised").alias("added"), n("altered").alias("altered"), n("intact").alias("intact"), n("dropped", "revised", "altered", "intact").alias("entries"))
    out = out.withColumn("row_count_ok", F.col("entries") == published_rows)
    return out.withColumn("is_intact", (F.col("dropped") == 0) & (F.col("added") == 0) & (F.col("altered") == 0) & F.col("row_count_ok"))


def ancestry(log: DataFrame, id_col: str = "id") -> DataFrame:
    """``log(id, superseded_by)`` -> (live, ancestor): each live row with all it superseded, however
    far back, itself left out. Pointers that form a cycle reach no live row."""
    edges = log.where("superseded_by is not null").select(F.col(id_col).alias("child"), F.col("superseded_by").alias("parent"))
    roots = log.where(LIVE).select(F.col(id_col).alias("root"))
    return closure(edges, roots).where("root <> node").select(F.col("root").alias("live"), F.col("node").alias("ancestor"))

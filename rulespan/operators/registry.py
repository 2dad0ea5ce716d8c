"""Writes and reads of the registry's logs: question states, checks, evidence, keys, releases, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespan.functions import text as T
from rulespan.operators.core import incomplete_runs, loaded_releases, pick_first, supersede

LIVE = "superseded_by is null"


def append_revisions(log: DataFrame, new: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """A log after new revisions: each supersedes the row of its key that was live. ``new`` has
    ids above all of the log's; a key's several new rows supersede one another in the order of ids."""
    return supersede(log.drop("superseded_by").unionByName(new.select(*[c for c in log.columns if c != "superseded_by"])), keys, id_col).select(*log.columns)


def set_states(states: DataFrame, questions: DataFrame, asked: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """``asked(id, question, state)`` written over ``states(id, question, state, superseded_by)``.
    A state that isn't allowed, and a question that isn't there, is an error."""
    known = questions.select("question", F.lit(True).alias("_known")).distinct()
    rows = asked.join(known, "question", "left")
    bad = F.col("_known").isNull() | ~F.coalesce(F.col("state").isin(*allowed), F.lit(False))
    said = F.raise_error(F.concat(F.lit("no such question or state: "), F.coalesce(F.col("question").cast("string"), F.lit("null")), F.lit(" "), F.coalesce("state", F.lit("null")))).cast("boolean")
    return append_revisions(states, rows.where(F.when(bad, said).otherwise(True)), ["question"])


def record_checks(checks: DataFrame, new: DataFrame) -> DataFrame:
    """``checks(question, source, version, outcome)`` with new ones; a source's version is checked
    once for each question, whatever its outcome, and closes nothing."""
    keys = ["question", "source", "version"]
    first = pick_first(new, keys, F.col("outcome").asc_nulls_last())
    return checks.unionByName(first.join(checks, keys, "left_anti").select(*checks.columns))


def add_evidence(evidence: DataFrame, new: DataFrame) -> DataFrame:
    """Evidence is only ever appended; blank citations are left out."""
    return evidence.unionByName(new.where("trim(coalesce(citation, '')) <> ''").select(*evidence.columns))


def current_state(questions: DataFrame, states: DataFrame) -> DataFrame:
    """Each question's live state, open by default."""
    live = states.where(LIVE).select("question", "state")
    return questions.select("question").distinct().join(live, "question", "left").withColumn("state", F.coalesce("state", F.lit("open")))


def register_keys(keys: DataFrame, new: DataFrame, statuses: DataFrame) -> DataFrame:
    """Registrations and revocations in a key's history: the new row supersedes the live one. A
    key that was revoked once can't be made active again."""
    revoked = keys.join(F.broadcast(statuses.where("is_revocation")), "status").select("key_id").distinct().withColumn("_revoked", F.lit(True))
    rows = new.join(F.broadcast(statuses.select("status", "is_revocation")), "status", "left").join(revoked, "key_id", "left")
    bad = F.col("is_revocation").isNull() | (F.coalesce("_revoked", F.lit(False)) & ~F.col("is_revocation"))
    said = F.raise_error(F.concat(F.lit("key "), F.col("key_id").cast("string"), F.lit(" can't become "), F.col("status"))).cast("boolean")
    return append_revisions(keys, rows.where(F.when(bad, said).otherwise(True)), ["key_id"])


def current_keys(enrolments: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys that reviewers are enrolled with, as they are now: an enrolment names a row of the key's
    history, and what counts is the live row of the same key."""
    mine = enrolments.where(f"{LIVE} and enrolled").select("reviewer", F.col("key_row").alias("id"))
    of = mine.join(keys.select("id", "key_id"), "id").select("reviewer", "key_id").distinct()
    return of.join(keys.where(LIVE).select("key_id", "status", "status_from"), "key_id")


def record_signatures(signatures: DataFrame, new: DataFrame, context: Column) -> DataFrame:
    """Appends signatures whose payload's header names the context that they claim; others are an error."""
    header = F.split("payload", "\n")[1]
    bad = ~F.coalesce(header == context, F.lit(False))
    said = F.raise_error(F.concat(F.lit("the payload is of "), F.coalesce(header, F.lit("nothing")))).cast("boolean")
    return signatures.unionByName(new.where(F.when(bad, said).otherwise(True)).select(*signatures.columns))


def natural_key(parts: list[tuple[str, Column, str]]) -> Column:
    """A row's key under its context: the canonical texts of its parts joined by slashes, null as nothing between them."""
    return F.concat_ws("/", *[F.coalesce(T.rendered(c, kind), F.lit("")) for _, c, kind in parts])


def manifest_entries(kinds: dict[str, tuple[DataFrame, list[tuple[str, Column, str]], list[tuple]]]) -> DataFrame:
    """(kind, key, context, digest) of every live row of each kind: ``kinds`` maps a kind to its log,
    its key's parts and its fields in their frozen order. Digests are of payloads without a signer."""
    out = None
    for kind, (log, key, fields) in sorted(kinds.items()):
        context = f"{kind}/1"
        rows = log.where(LIVE).select(F.lit(kind).alias("kind"), natural_key(key).alias("key"), F.lit(context).alias("context"), F.sha2(T.payload(context, fields), 256).alias("digest"))
        out = rows if out is None else out.unionByName(rows)
    return out


def manifest(entries: DataFrame, release: str) -> DataFrame:
    """One row that commits to all entries: (release, entries, digest). Entries are hashed by
    kind and bucket first, so no task holds more than a bucket's; the digest is of the buckets' digests in order."""
    line = F.concat_ws(" ", "kind", "key", "context", "digest")
    rows = entries.select("kind", line.alias("line"), F.substring(F.sha2(line, 256), 1, 4).alias("bucket"))
    buckets = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("digest"))
    whole = F.array_sort(F.collect_list(F.struct("bucket", "digest")))
    return buckets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("entries"), F.sha2(F.concat(F.lit(f"manifest/1\n{release}\n"), F.array_join(F.transform(whole, lambda b: b["digest"]), "\n")), 256).alias("digest")).select(F.lit(release).alias("release"), "entries", "digest")


def verify_manifest(manifests: DataFrame, entries: DataFrame, release: str) -> DataFrame:
    """Whether a published manifest still matches its entries: (release, digest_ok, row_count_ok)."""
    now = manifest(entries, release).select(F.col("entries").alias("_n"), F.col("digest").alias("_d"))
    return manifests.where(F.col("release") == release).crossJoin(now).select("release", (F.col("digest") == F.col("_d")).alias("digest_ok"), (F.col("entries") == F.col("_n")).alias("row_count_ok"))


def same_release(stated: str, stamped: str) -> str:
    """The release that an operator stated, if the source's own stamp is the same."""
    if stated != stamped:
        raise ValueError(f"the source says {stamped}, not {stated}")
    return stamped


def missing_codes(wanted: DataFrame, resolved: DataFrame, code: str) -> DataFrame:
    """Wanted codes that resolved to nothing."""
    return wanted.select(code).distinct().join(resolved, code, "left_anti")


def grades_of(effective: DataFrame, subjects: DataFrame) -> DataFrame:
    """Effective grades of each subject, numbered from the most severe."""
    from pyspark.sql import Window as W

    order = W.partitionBy("subject").orderBy("effective_rank", "partner", "rel")
    return effective.join(subjects.select("subject").distinct(), "subject", "left_semi").withColumn("turn", F.row_number().over(order).cast("long"))


def policy_history(policy: DataFrame, concept: int | None = None) -> DataFrame:
    """All live decisions, withdrawn ones too, or one concept's whole history in order."""
    if concept is None:
        return policy.where(LIVE).select("policy_id", "concept", "decision")
    return policy.where(F.col("concept") == concept).select("policy_id", "concept", "decision").orderBy("policy_id")


def status(spark: SparkSession, blocks: dict[str, DataFrame]) -> DataFrame:
    """(block, name, n): how many rows each named table has; a block is the part of a name before its first dot."""
    out = None
    for name, rows in blocks.items():
        block, _, item = name.partition(".")
        one = rows.agg(F.count("*").alias("n")).select(F.lit(block).alias("block"), F.lit(item).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "block string, name string, n long")


def run_blocks(runs: DataFrame) -> dict[str, DataFrame]:
    return {"runs.incomplete": incomplete_runs(runs), "runs.loaded": loaded_releases(runs)}


def open_runs(runs: DataFrame, new: DataFrame) -> DataFrame:
    """The ledger with new runs, which have begun and not finished."""
    return runs.unionByName(new.withColumn("finished", F.lit(None).cast("timestamp")).select(*runs.columns))


def finish_runs(runs: DataFrame, done: DataFrame) -> DataFrame:
    """The ledger after ``done(run_id, at)``: a run finishes once."""
    at = done.groupBy("run_id").agg(F.min("at").alias("_at"))
    return runs.join(at, "run_id", "left").withColumn("finished", F.coalesce("finished", "_at")).select(*runs.columns)


def persist_worklist(stored: DataFrame, found: DataFrame, keys: list[str], run: int) -> DataFrame:
    """A worklist by identity after a run: one row per key of those found, with the run that found it."""
    first = pick_first(found, keys, *[F.col(c).asc_nulls_last() for c in found.columns])
    return stored.where(F.col("run") != run).unionByName(first.withColumn("run", F.lit(run).cast("long")).select(*stored.columns))

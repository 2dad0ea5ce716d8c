"""Scalar functions: ids, folding, names, keys and canonical payloads, as Columns."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rulespan.plans.steps import cut

#: Our own root namespace of minted ids.
NAMESPACE = "6f0b4a52-3c1e-5d8a-9a77-2f4e1c0b8d31"


def uuid5(key: Column, namespace: str = NAMESPACE) -> Column:
    """Version 5 id of a key: SHA-1 of namespace and key with version and variant set."""
    digest = F.lower(F.substring(F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(key, "UTF-8"))), 1, 32))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") + 1, 1)
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def normalise_name(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def components(name: Column) -> Column:
    """Ingredients of a combination name, in order, without repeats or blanks."""
    flat = F.regexp_replace(F.regexp_replace(name, r" \+ | \(&\) ", ", "), r"\([^)]*\)", " ")
    parts = F.transform(F.split(flat, r"(?i)\s+with\s+|\s+and\s+|,"), normalise_name)
    parts = F.array_distinct(F.filter(parts, lambda x: x != ""))
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit("<no name>")))


def strip_suffix(name: Column, suffixes: list[str]) -> Column:
    """The normalised name without one trailing token of the list; null if there is nothing to
    drop or nothing would be left."""
    words = F.split(normalise_name(name), " ")
    some = (F.size(words) >= 2) & F.element_at(words, -1).isin(*[s.lower() for s in suffixes])
    return F.when(some, F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(1))), " "))


def canonical_source(source: Column, known: dict[str, str]) -> Column:
    """A source's one spelling: trimmed and upper-cased, then by the map of known ones."""
    folded = F.upper(F.trim(source))
    out = folded
    for name, canonical in known.items():
        out = F.when(folded == name, F.lit(canonical)).otherwise(out)
    return out


def canonical_value(scheme: Column, value: Column, upper: tuple[str, ...] = ("UNII", "INCHIKEY", "CHEBI")) -> Column:
    """A claim's value, trimmed, and upper-cased in the schemes whose case says nothing."""
    return F.when(F.upper(scheme).isin(*upper), F.upper(F.trim(value))).otherwise(F.trim(value))


def registry_number(raw: Column) -> tuple[Column, Column]:
    """(UNII, CAS or null, the number) by the form of the first token."""
    first = F.split(F.trim(raw), " ")[0]
    kind = F.when(first.rlike("^[0-9A-Z]{10}$"), "UNII").when(first.rlike("^[0-9]{1,7}-[0-9]{2}-[0-9]$"), "CAS")
    return kind, first


def _folded(name: str | None) -> str | None:
    if name is None:
        return None
    plain = "".join(c for c in unicodedata.normalize("NFKD", html.unescape(name)) if not unicodedata.combining(c))
    return re.sub("[^a-z0-9]+", " ", plain.casefold()).strip()


@F.pandas_udf(StringType())
def _accent_folded(names: pd.Series) -> pd.Series:
    return names.map(_folded)


def accent_folded(name: Column) -> Column:
    """A name without character references, accents, case and punctuation. Spark has no
    canonical decomposition, so this runs in Arrow batches."""
    return _accent_folded(name)


def even_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """``n`` rows spread evenly over the order of a unique key, both ends included; all if there
    are fewer. Places are numbered by range partitions, so no task sees all rows; their bounds
    are drawn anew in each run, so the dealt keys are written once and read twice."""
    total = rows.count()
    if total <= n or n < 1:
        return rows if n >= 1 else rows.limit(0)
    wanted = sorted({round(i * (total - 1) / max(1, n - 1)) for i in range(n)})
    ordered = cut(rows.select(key).repartitionByRange(key).withColumn("_part", F.spark_partition_id()))
    sizes = {r["_part"]: r["n"] for r in ordered.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    starts, seen = {}, 0
    for part in sorted(sizes):
        starts[part], seen = seen, seen + sizes[part]
    # One entry per partition and per wanted row: both lists are short by their parameters.
    local = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    start = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair])[F.col("_part")]
    chosen = ordered.withColumn("_at", local + start).where(F.col("_at").isin(wanted)).select(key)
    return rows.join(chosen, key, "left_semi").select(*rows.columns)


def rendered_key(*parts: tuple[str, Column]) -> Column:
    """SCHEME:value parts joined by a slash; null if any value is."""
    out = None
    for scheme, value in parts:
        part = F.concat(F.lit(f"{scheme}:"), value.cast("string"))
        out = part if out is None else F.concat(out, F.lit("/"), part)
    return out


def parsed_key(key: Column, schemes: tuple[str, ...]) -> Column:
    """The values of a rendered key as a struct, null where the key has another form. The last value may hold slashes."""
    pattern = "^" + "/".join(f"{s}:([^/]+)" for s in schemes[:-1]) + ("/" if len(schemes) > 1 else "") + f"{schemes[-1]}:(.+)$"
    return F.when(key.rlike(pattern), F.struct(*[F.regexp_extract(key, pattern, i + 1).alias(s) for i, s in enumerate(schemes)]))


def ancestors(code: Column) -> Column:
    """All strict dotted prefixes of a tree code."""
    parts = F.split(code, r"\.")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "."))).otherwise(F.array().cast("array<string>"))


def rendered(value: Column, kind: str) -> Column:
    """The canonical text of a value of the given type: true or false, UTC microseconds, lower
    hexadecimal bytes, plain integers and strings; other types have none and raise."""
    if kind == "timestamp":
        return F.date_format(F.to_utc_timestamp(value, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    if kind == "binary":
        return F.lower(F.hex(value))
    if kind in ("boolean", "string", "int", "bigint", "smallint", "tinyint"):
        return value.cast("string")
    raise TypeError(f"{kind} has no canonical text")


def field(name: str, value: Column, kind: str = "string") -> Column:
    """One canonical field: byte lengths, name, S or N (null), value."""
    text = F.coalesce(rendered(value, kind), F.lit(""))
    return F.concat(F.lit(f"{len(name.encode())}:{name}:"), F.when(value.isNull(), "N").otherwise("S"), F.lit(":"), F.octet_length(text).cast("string"), F.lit(":"), text, F.lit("\n"))


def group(name: str, values: Column) -> Column:
    """A canonical group of strings: its name and size, and members in the order of their bytes."""
    members = F.array_sort(F.transform(values, lambda v: F.encode(v, "UTF-8")))
    lines = F.transform(members, lambda v: F.concat(F.octet_length(v).cast("string"), F.lit(":"), F.decode(v, "UTF-8"), F.lit("\n")))
    return F.concat(F.lit(f"{len(name.encode())}:{name}:"), F.size(members).cast("string"), F.lit("\n"), F.array_join(lines, ""))


def payload(context: str, fields: list[tuple], groups: list[tuple[str, Column]] = []) -> Column:  # noqa: B006
    """Canonical text of a row: context, number of fields, fields in their frozen order as
    (name, column[, type]), then groups of strings."""
    return F.concat(F.lit(f"payload/1\n{context}\n{len(fields)}\n"), *[field(*f) for f in fields], *[group(*g) for g in groups])


def admission_signals(inn: Column, usan: Column, rxcui: Column, kind: Column, allowed: Column) -> Column:
    """Signals that admit an identity, strongest first."""
    typed = kind.isin("chemical", "protein", "nucleicAcid")
    return F.filter(F.array(F.when(inn, "INN_ID"), F.when(usan, "USAN_ID"), F.when(rxcui & typed, "RXCUI"), F.when(allowed, "LEGACY_ALLOWLIST")), lambda x: x.isNotNull())


def disposition(non_entity: Column, name: Column, resolved: Column, markers: Column) -> Column:
    """What an assertion becomes, by the first test that holds."""
    return F.when(non_entity, "non_drug_entity").when(name.rlike(r"(?i)\band\b"), "combination_regimen").when(~resolved, "unresolved_substance").when(F.size(markers) > 0, "withheld_qualified").otherwise("member")

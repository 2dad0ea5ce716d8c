"""Registration of queries, and the pieces of SQL that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rulespan.functions.text import NAMESPACE
from rulespan.plans.adapters import portable, relation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query with its SQL over relations in braces, if it has one."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = portable(sql)
        return f

    return add


def rel(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [relation(spark, sf_dir, n) for n in names]


def walk(roots: str, name: str = "tree", edge: str = "edge", up: bool = False) -> str:
    """A walk from roots along edges as a set, as a recursive table expression (root, node)."""
    here, there = ("child", "parent") if up else ("parent", "child")
    return f"""{name} as (
  select root, root as node from ({roots}) as q
  union select {name}.root, e.{there} as node from {name} join {{{edge}}} e on e.{here} = {name}.node)"""


RULE_ROOTS = "select distinct object as root from {rule}"
CLASS_ROOTS = "select subject_class as root from {class_rule} union select object_class as root from {class_rule}"
#: The decision that holds for a concept.
BINDING = "binding as (select concept, decision from {policy} where superseded_by is null and decision in ('deny', 'allow'))"

_NS = NAMESPACE.replace("-", "")


def uuid_sql(key: str) -> str:
    """The version 5 id of a key."""
    h = f"sha1(unhex('{_NS}') || encode({key}))"
    return (
        f"concat(substr({h}, 1, 8), '-', substr({h}, 9, 4), '-5', substr({h}, 14, 3), '-', "
        f"substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr({h}, 17, 1)), 1), substr({h}, 18, 3), '-', substr({h}, 21, 12))"
    )

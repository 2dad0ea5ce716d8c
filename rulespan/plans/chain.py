"""A chain of ingests: which steps run, on which files, in which order, and their runs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

Runner = Callable[[SparkSession, dict[str, str], str], None]


class ChainError(ValueError):
    """Inputs that a chain refuses before anything runs."""


@dataclass(frozen=True)
class Step:
    """One ingest: the patterns of its inputs, the files that stand in where nothing matches,
    and what it does with (session, files by name, release)."""

    name: str
    inputs: dict[str, str]
    run: Runner
    defaults: dict[str, str] = field(default_factory=dict)


def matching(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Files under a folder of any store that match a pattern, in order."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in found or [])


def resolve(spark: SparkSession, folder: str, step: Step) -> dict[str, str]:
    """Each input's one file. Nothing but a default may stand in for none; of several none is chosen."""
    out = {}
    for name, pattern in step.inputs.items():
        found = matching(spark, folder, pattern)
        if not found and name in step.defaults:
            found = [step.defaults[name]]
        if len(found) != 1:
            raise ChainError(f"{step.name}: {len(found)} files match {pattern}: {found}")
        out[name] = found[0]
    return out


def select(steps: list[Step], only: list[str] | None = None, skip: list[str] | None = None) -> list[Step]:
    """The wanted steps in the order of the chain, whatever order they are asked in."""
    unknown = (set(only or ()) | set(skip or ())) - {s.name for s in steps}
    if unknown:
        raise ChainError(f"no such steps: {sorted(unknown)}")
    return [s for s in steps if (only is None or s.name in only) and s.name not in (skip or ())]


def run_chain(spark: SparkSession, steps: list[Step], folder: str, releases: dict[str, str], log: Callable[[str, str], None], only: list[str] | None = None, skip: list[str] | None = None) -> list[str]:
    """Runs the wanted steps; ``log(step, event)`` hears of each one's begin and end. All files are
    resolved, and one file under two releases is refused, before the first step runs. A step
    that fails ends the chain and is logged as failed; the steps before it stay."""
    wanted = select(steps, only, skip)
    missing = [s.name for s in wanted if not releases.get(s.name, "").strip()]
    if missing:
        raise ChainError(f"no release stated for {missing}")
    files = {s.name: resolve(spark, folder, s) for s in wanted}
    stated: dict[str, str] = {}
    for step in wanted:
        for file in files[step.name].values():
            if stated.setdefault(file, releases[step.name]) != releases[step.name]:
                raise ChainError(f"{file} can't be of release {stated[file]} and {releases[step.name]}")
    for step in wanted:
        log(step.name, "begun")
        try:
            step.run(spark, files[step.name], releases[step.name])
        except Exception:
            log(step.name, "failed")
            raise
        log(step.name, "finished")
    return [s.name for s in wanted]

"""Published sets of tables: a run writes beside what readers use, and one small file makes it current.

    root/runs/<run>/<table>            what a run wrote
    root/_snapshots/<version>.json     one manifest per published version, never changed

The greatest version is the pointer.  A manifest is put in place by a rename that fails where the file is
there, so of two publishers that saw the same version one takes the next number and the other looks again.
A run that fails before its manifest leaves readers with the version they have; a run that is repeated after
its manifest finds it and publishes nothing.  Readers keep the version they opened while others publish.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lucidex.sources.work import create_if_absent, delete, files_in


class Conflict(Exception):
    """Another publisher was first and the caller had asked for a certain base."""


@dataclass(frozen=True)
class Snapshot:
    """A published version, fixed for who holds it."""

    spark: SparkSession
    root: str
    version: int
    run: str
    stamp: str
    tables: tuple[str, ...]

    def path(self, name: str) -> str:
        if name not in self.tables:
            raise KeyError(f"version {self.version} has no table {name!r}")
        return f"{self.root}/runs/{self.run}/{name}"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


def versions(spark: SparkSession, root: str) -> list[int]:
    """Published versions in order; their number is bounded by :func:`expire`."""
    return sorted(int(name[:-5]) for name in files_in(spark, f"{root}/_snapshots") if name.endswith(".json") and name[:-5].isdigit())


def open_version(spark: SparkSession, root: str, version: int) -> Snapshot:
    told = json.loads(spark.read.text(f"{root}/_snapshots/{version:012d}.json", wholetext=True).first()[0])
    return Snapshot(spark, root, version, told["run"], told["stamp"], tuple(told["tables"]))


def latest(spark: SparkSession, root: str) -> Snapshot | None:
    """The current version, or None where none was published."""
    known = versions(spark, root)
    return open_version(spark, root, known[-1]) if known else None


def publish(spark: SparkSession, root: str, run: str, tables: Mapping[str, DataFrame] | Callable[[str], Mapping[str, object]],
            stamp: str = "", base: int | None = None) -> Snapshot:
    """Writes the tables of a run and makes them current.

    *tables* are rows by name, or a function that writes them into the folder it is given and returns their
    names.  *run* names the run, such as a day: one that is published already is returned as it is.  With
    *base*, the version that the run started from, :class:`Conflict` is raised where another came after it.
    """
    known = versions(spark, root)
    done = next((s for s in (open_version(spark, root, v) for v in reversed(known)) if s.run == run), None)
    if done:
        return done
    folder = f"{root}/runs/{run}"
    delete(spark, folder)  # left by an attempt that failed before its manifest
    if callable(tables):
        names = list(tables(folder))
    else:
        names = list(tables)
        for name, rows in tables.items():
            rows.write.parquet(f"{folder}/{name}")
    manifest = json.dumps({"run": run, "stamp": stamp, "tables": names})
    while True:
        known = versions(spark, root)
        last = known[-1] if known else 0
        if base is not None and last != base:
            raise Conflict(f"version {last} was published after {base}")
        if create_if_absent(spark, f"{root}/_snapshots/{last + 1:012d}.json", manifest):
            return open_version(spark, root, last + 1)
        time.sleep(0.01)


def expire(spark: SparkSession, root: str, keep: int = 3, running: tuple[str, ...] = ()) -> list[str]:
    """Removes all but the newest *keep* versions and the runs that none of these names.

    *running* names runs that still write.  Returns the removed runs.
    """
    known = versions(spark, root)
    used = {open_version(spark, root, v).run for v in known[-keep:]} | set(running)
    for version in known[:-keep]:
        delete(spark, f"{root}/_snapshots/{version:012d}.json")
    gone = [run for run in files_in(spark, f"{root}/runs") if run not in used]
    for run in gone:
        delete(spark, f"{root}/runs/{run}")
    return sorted(gone)

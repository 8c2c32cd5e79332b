"""Changes of stored tables in order: a journal of steps, changes of columns, and constraints that a version must keep."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.operators.migrate import Tables, dangling
from kerbline.operators.quality import duplicate_keys
from kerbline.operators.stored import Folder

Step = tuple[str, Callable[[Tables], Tables]]


class Broken(ValueError):
    """A constraint doesn't hold; nothing was committed."""


@dataclass(frozen=True)
class Unique:
    """No two rows of a table have one value of the column; nulls may repeat."""

    table: str
    column: str

    def check(self, tables: Tables) -> None:
        own = tables[self.table].where(F.col(self.column).isNotNull())
        if not duplicate_keys(own, self.column).isEmpty():
            raise Broken(f"{self.table}.{self.column} repeats")


@dataclass(frozen=True)
class Restrict:
    """A row's key has its parent: a parent that is still used can't go."""

    table: str
    column: str
    parent: str
    parent_column: str

    def check(self, tables: Tables) -> None:
        if not dangling(tables[self.table], tables[self.parent], self.column, self.parent_column).isEmpty():
            raise Broken(f"{self.table}.{self.column} has no row in {self.parent}")


def add_column(table: str, column: str, kind: str, default: object = None) -> Callable[[Tables], Tables]:
    return lambda tables: tables | {table: tables[table].withColumn(column, F.lit(default).cast(kind))}


def drop_column(table: str, column: str) -> Callable[[Tables], Tables]:
    return lambda tables: tables | {table: tables[table].drop(column)}


def change_column(table: str, column: str, kind: str) -> Callable[[Tables], Tables]:
    """Another type for a column; a value that it can't hold is an error, not null."""
    return lambda tables: tables | {table: tables[table].withColumn(column, F.expr(f"CASE WHEN `{column}` IS NULL THEN NULL ELSE coalesce(try_cast(`{column}` AS {kind}), raise_error('{table}.{column} is no {kind}')) END"))}


class StoredTables:
    """Named tables under versions. A version is a manifest that names each table's folder and the steps
    that were applied; it is renamed into place whole, and of two writers one loses."""

    def __init__(self, spark: SparkSession, root: str, constraints: Sequence[Unique | Restrict] = ()):
        self.spark, self.folder, self.constraints = spark, Folder(spark, root), tuple(constraints)

    def manifest(self) -> dict:
        names = [n for n in self.folder.names("versions") if n.endswith(".json")]
        return self.folder.read_json(f"versions/{names[-1]}") if names else {"version": 0, "tables": {}, "journal": []}

    def read(self) -> Tables:
        return {name: self.spark.read.parquet(f"{self.folder.root}/{path}") for name, path in self.manifest()["tables"].items()}

    def journal(self) -> list[str]:
        return self.manifest()["journal"]

    def commit(self, before: dict, tables: Tables, step: str) -> None:
        """Writes the tables that changed, checks every constraint on what was written, and commits the step."""
        version, now, stored = before["version"] + 1, self.read(), {}
        paths = {name: path for name, path in before["tables"].items() if name in tables}
        for name, df in tables.items():
            if name in now and df is before["frames"].get(name):
                stored[name] = now[name]
                continue
            paths[name] = f"tables/{name}-{step}-{uuid.uuid4().hex[:12]}"
            df.write.parquet(f"{self.folder.root}/{paths[name]}")
            stored[name] = self.spark.read.parquet(f"{self.folder.root}/{paths[name]}")
        for constraint in self.constraints:
            if constraint.table in stored and getattr(constraint, "parent", constraint.table) in stored:
                constraint.check(stored)
        if not self.folder.put_json_once(f"versions/v{version:012d}.json", {"version": version, "tables": paths, "journal": [*before["journal"], step]}):
            raise RuntimeError(f"version {version} was committed by another writer")

    def migrate(self, steps: Sequence[Step]) -> list[str]:
        """Applies the steps that the journal doesn't have, each a version of its own; returns their names.
        A step that fails leaves the version before it; a repeated run goes on from there or does nothing."""
        applied = []
        for name, change in steps:
            before = self.manifest()
            if name in before["journal"]:
                continue
            frames = self.read()
            self.commit(before | {"frames": frames}, change(frames), name)
            applied.append(name)
        return applied

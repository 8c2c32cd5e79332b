"""Size-tiered compaction of Parquet shards under a versioned manifest. DataFrame operations only.

Arrivals are appended as small immutable files, one for each partition of the arriving table. Compaction
puts files that are below the target size into tiers by size; where a tier holds FAN_IN files or more,
files of similar size are merged into files of about the target size. Every merge is one task that reads
its files and writes one: no shuffle, and no task larger than the target. Files of a merged run stay
until `vacuum`, so readers of an earlier version are not disturbed.

A version of the table is a manifest: a small JSON file that names lists of shards, which are files of
their own and never change. A commit writes lists only for what it adds and for the lists that it takes
shards from; the others are named again. A manifest is written under another name and renamed without
overwriting, so a version appears whole or not at all, and of two writers one loses and starts over from
the newer version. Files that no manifest lists don't belong to
the table, whatever failed or ran twice; lost executors only repeat tasks.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET_BYTES = 128 << 20
FAN_IN = 4
LEAST_BYTES = 1 << 20
#: Merges that are planned in one Spark job; the plan has one scan for each.
MERGES_PER_JOB = 64
#: Shards in a list at most, and lists of a manifest from which on those half empty are put together.
LIST_SHARDS, MANY_LISTS = 10_000, 64


@dataclass(frozen=True)
class Shard:
    path: str  # below the store's root
    n_bytes: int
    n_rows: int


class Conflict(RuntimeError):
    """Another writer committed first."""


class ShardStore:
    """Table of immutable shards under `root`, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, schema, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.target_bytes, self.fan_in = target_bytes, fan_in
        self._lists: dict[str, list[Shard]] = {}  # lists that were read; they never change
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}" if name else self.root)

    # -- manifests ------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        folder = self._path("manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, list[Shard]]:
        """A version and its shards, the latest where none is given; version 0 is the empty table."""
        have = self.versions()
        version = version if version is not None else (have[-1] if have else 0)
        if version == 0:
            return 0, []
        return version, [s for name in self._names(version) for s in self._listed(name)]

    def _json(self, name: str):
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put_json(self, name: str, value) -> None:
        stream = self._fs.create(self._path(name), False)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()

    def _names(self, version: int) -> list[str]:
        """Lists of a version."""
        return self._json(f"manifests/v{version:012d}.json")["lists"] if version else []

    def _listed(self, name: str) -> list[Shard]:
        if name not in self._lists:
            self._lists[name] = [Shard(**s) for s in self._json(name)]
        return self._lists[name]

    def _lists_of(self, after: int, shards: list[Shard]) -> list[str]:
        """Names of lists that hold exactly `shards`: those of version `after` that stay whole, and new ones."""
        left, kept = set(shards), []
        names = self._names(after)
        many = len(names) >= MANY_LISTS
        for name in names:
            own = self._listed(name)
            if left.issuperset(own) and not (many and 2 * len(own) < LIST_SHARDS):
                left.difference_update(own)
                kept.append(name)
        rest = sorted(left, key=lambda s: s.path)
        for at in range(0, len(rest), LIST_SHARDS):
            name = f"lists/{uuid.uuid4().hex}.json"
            self._put_json(name, [asdict(s) for s in rest[at : at + LIST_SHARDS]])
            kept.append(name)
        return kept

    def _commit(self, after: int, shards: list[Shard]) -> int:
        version = after + 1
        draft, final = f"manifests/.draft-{uuid.uuid4().hex}", self._path(f"manifests/v{version:012d}.json")
        self._put_json(draft, {"version": version, "lists": self._lists_of(after, shards)})
        draft = self._path(draft)
        modes = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 1)
        modes[0] = getattr(self._hadoop, "Options$Rename").NONE
        context = self._hadoop.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, final, modes)
        except Py4JJavaError as error:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(error.java_exception):
                raise Conflict(f"version {version} exists") from error
            raise
        return version

    # -- writing --------------------------------------------------------------------------------

    def _write(self, df: DataFrame, kind: str) -> list[Shard]:
        folder = f"shards/{kind}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        sizes = {s.getPath().getName(): s.getLen() for s in self._fs.listStatus(self._path(folder)) if s.getPath().getName().endswith(".parquet")}
        if not sizes:
            return []
        # a schema of its own keeps columns of any name out of the way of Spark's file column
        rows = self.spark.read.schema("unrelated int").parquet(f"{self.root}/{folder}").groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
        return [Shard(f"{folder}/{r['name']}", sizes[r["name"]], r["n"]) for r in sorted(rows.collect())]  # a row for each file; files without rows are left out

    def append(self, arrivals: DataFrame) -> int:
        """Adds rows as new shards; returns the version that has them."""
        quoted = lambda name: "`" + name.replace("`", "``") + "`"
        new = self._write(arrivals.select(*[F.col(quoted(f.name)).cast(f.dataType).alias(f.name) for f in self.schema]), "arrival")
        while True:
            version, shards = self.manifest()
            try:
                return self._commit(version, shards + new)
            except Conflict:
                continue

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """Runs to merge: similarly sized shards, together about as large as the target at most."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if 2 * s.n_bytes < self.target_bytes:
                tier = max(0, math.floor(math.log(max(s.n_bytes, 1) / LEAST_BYTES, self.fan_in)))
                tiers.setdefault(tier, []).append(s)
        runs = []
        for tier in sorted(tiers):
            if len(tiers[tier]) < self.fan_in:
                continue
            run: list[Shard] = []
            for s in sorted(tiers[tier], key=lambda s: (s.n_bytes, s.path)):
                if run and sum(x.n_bytes for x in run) + s.n_bytes > self.target_bytes:
                    runs.append(run)
                    run = []
                run.append(s)
            runs.append(run)
        return [r for r in runs if len(r) > 1]

    def _read(self, shards: list[Shard]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{s.path}" for s in shards])

    def compact(self) -> int:
        """Merges until no tier holds a full run; returns the latest version.

        Each round's files replace theirs in one commit, after their rows are counted. A commit that
        meets a newer version is repeated on it, for appends don't touch the merged shards; where
        another compaction has taken one of them, the round is dropped.
        """
        while True:
            version, shards = self.manifest()
            runs = self.plan(shards)
            if not runs:
                return version
            new: list[Shard] = []
            for at in range(0, len(runs), MERGES_PER_JOB):
                batch = runs[at : at + MERGES_PER_JOB]
                merged = self._read(batch[0]).coalesce(1)
                for run in batch[1:]:
                    merged = merged.unionAll(self._read(run).coalesce(1))
                made = self._write(merged, "merged")
                if sum(s.n_rows for s in made) != sum(s.n_rows for run in batch for s in run):
                    raise RuntimeError("a merge lost rows; nothing was committed")
                new += made
            gone = {s for run in runs for s in run}
            while gone <= set(shards):
                try:
                    self._commit(version, [s for s in shards if s not in gone] + new)
                    break
                except Conflict:
                    version, shards = self.manifest()

    def vacuum(self, keep: int = 1) -> None:
        """Deletes all but the last `keep` versions, and shards that none of those lists.

        Not to be run beside writers: shards that are not committed yet are not listed either.
        """
        have = self.versions()
        names = {name for v in have[-keep:] for name in self._names(v)}
        listed = {s.path for name in names for s in self._listed(name)}
        for v in have[:-keep]:
            self._fs.delete(self._path(f"manifests/v{v:012d}.json"), False)
        if self._fs.exists(self._path("lists")):
            for f in self._fs.listStatus(self._path("lists")):
                if f"lists/{f.getPath().getName()}" not in names:
                    self._fs.delete(f.getPath(), False)
        if self._fs.exists(self._path("shards")):
            for folder in self._fs.listStatus(self._path("shards")):
                for f in self._fs.listStatus(folder.getPath()):
                    name = f"shards/{folder.getPath().getName()}/{f.getPath().getName()}"
                    if name.endswith(".parquet") and name not in listed:
                        self._fs.delete(f.getPath(), False)

    # -- reading --------------------------------------------------------------------------------

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; an empty table where it has no shard."""
        _, shards = self.manifest(version)
        return self._read(shards) if shards else self.spark.createDataFrame([], self.schema)


@dataclass(frozen=True)
class Arrival:
    """An append and the compaction after it."""

    number: int
    appended: int  # version
    rows_appended: int  # of that version
    compacted: int
    rows_compacted: int


def shard_documents(documents: DataFrame, root: str, target_bytes: int = TARGET_BYTES, by: str | None = None, arrivals: int = 1) -> tuple[ShardStore, list[Arrival]]:
    """Store under `root` with all rows of `documents` in compacted shards, and what each arrival did.

    Rows arrive in as many appends as said, told apart by the column `by`, whose values are 0 to
    arrivals - 1; tiers are merged after each. Rows are kept as they are, repeated rows, nulls and
    columns of any name too. An empty table has versions without shards.
    """
    store = ShardStore(documents.sparkSession, root, documents.schema, target_bytes)
    done = []
    for number in range(arrivals):
        appended = store.append(documents.where(F.col(by) == number) if by else documents)
        before = sum(s.n_rows for s in store.manifest(appended)[1])
        compacted = store.compact()
        done.append(Arrival(number, appended, before, compacted, sum(s.n_rows for s in store.manifest(compacted)[1])))
        store.vacuum()
    return store, done

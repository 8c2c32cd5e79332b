"""Stored tables in a folder that driver and executors share: working tables, logs that take a batch once,
and keyed tables whose parts a batch rewrites under a versioned manifest."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kerbline.operators.spread import tasks
from kerbline.operators.upsert import fold_into


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the session names in spark.checkpoint.dir. A local session without
    one gets a temporary folder; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "kerbline-work")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


class Folder:
    """Files below a path, by Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self.path("").getFileSystem(self._conf)

    def path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, name: str = "") -> list[str]:
        folder = self.path(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.path(name))

    def delete(self, name: str) -> None:
        self._fs.delete(self.path(name), True)

    def read_json(self, name: str):
        stream = self._fs.open(self.path(name))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def put_json_once(self, name: str, value) -> bool:
        """Writes a file whole under a name that must be free; false where another writer was first."""
        draft = self.path(f"{name}.draft-{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        modes = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 1)
        modes[0] = getattr(self._hadoop, "Options$Rename").NONE
        final = self.path(name)
        try:
            self._hadoop.FileContext.getFileContext(final.toUri(), self._conf).rename(draft, final, modes)
        except Py4JJavaError as error:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(error.java_exception):
                return False
            raise
        return True


class Saved:
    """Working tables of one call; a saved table cuts lineage and outlives executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.folder = Folder(spark, work_folder(spark, name))

    def save(self, df: DataFrame) -> DataFrame:
        name = uuid.uuid4().hex[:12]
        df.write.parquet(f"{self.folder.root}/{name}")
        out = self.folder.spark.read.schema(df.schema).parquet(f"{self.folder.root}/{name}")
        out._saved_as = name
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            self.folder.delete(table._saved_as)

    def close(self) -> None:
        self.folder.delete("")


class StoredLog:
    """A log that takes each batch once: entries lie in a folder of their batch, and a batch that is
    repeated after a failure adds nothing, or replaces what it had not written whole."""

    def __init__(self, spark: SparkSession, root: str, schema):
        self.folder, self.schema = Folder(spark, root), schema

    def append(self, entries: DataFrame, batch: str) -> bool:
        """Whether the batch was added now."""
        if self.folder.exists(f"batch={batch}/_SUCCESS"):
            return False
        entries.write.mode("overwrite").parquet(f"{self.folder.root}/batch={batch}")
        return True

    def read(self) -> DataFrame:
        whole = [f"{self.folder.root}/{n}" for n in self.folder.names() if n.startswith("batch=") and self.folder.exists(f"{n}/_SUCCESS")]
        spark = self.folder.spark
        return spark.read.schema(self.schema).parquet(*whole) if whole else spark.createDataFrame([], self.schema)


@dataclass(frozen=True)
class Merge:
    """What a batch did to a keyed table. n_new and n_updated count keys; a repeated batch has the counts
    of its first run."""

    version: int
    n_new: int
    n_updated: int
    repeated: bool


class KeyedTable:
    """A table of one row for each key, in parts by a hash of the key.

    A version is a manifest that names each part's newest folder. A batch reads and rewrites only the parts
    that its keys fall into, and is committed by renaming its manifest to the next version, which only one
    writer can. The loser's parts are kept where the winner left them alone; else it merges again. Batches
    are numbered by their writer; a number that isn't above the writer's last is a repeat and changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str, schema, keys: Sequence[str], first: Sequence[str], last: Sequence[str], last_known: Sequence[str] = (), parts: int = 64):
        self.spark, self.folder, self.schema, self.parts = spark, Folder(spark, root), schema, parts
        self.shape = dict(keys=list(keys), first=list(first), last=list(last), last_known=list(last_known))
        self.columns = [*keys, *first, *last, *last_known]

    # -- versions -------------------------------------------------------------------------------

    def version(self) -> int:
        return max((int(n[1:-5]) for n in self.folder.names("versions") if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        return self.folder.read_json(f"versions/v{version:012d}.json") if version else {"version": 0, "parts": {}, "writers": {}}

    def _rows(self, folders: Sequence[str]) -> DataFrame:
        marked = self.spark.createDataFrame([], self.schema).select(*self.columns, F.lit("").alias("batch"), F.lit(True).alias("is_new")).schema
        return self.spark.read.schema(marked).parquet(*[f"{self.folder.root}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], marked)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        return self._rows(list(self.manifest(version)["parts"].values())).select(*self.columns)

    def changes(self, writer: str, number: int, version: int | None = None) -> DataFrame:
        """keys, is_new of the rows that the batch was the last to write, as a version holds them."""
        rows = self._rows(list(self.manifest(version)["parts"].values()))
        return rows.where(F.col("batch") == f"{writer}:{number}").select(*self.shape["keys"], "is_new")

    # -- merging --------------------------------------------------------------------------------

    def part(self) -> Column:
        return F.pmod(F.xxhash64(*self.shape["keys"]), F.lit(self.parts)).cast("int")

    def dealt(self, rows: DataFrame, *beside: str) -> DataFrame:
        """Rows over all tasks, those of one part in tasks of their own, so that a staged part has few files.
        `beside` columns are hashed with the keys, lest a key that holds much of the batch be one task."""
        own = -(-tasks(self.spark) // self.parts)
        kinds = self._rows([]).schema
        keys = [F.col(k).cast(kinds[k].dataType) for k in self.shape["keys"]]
        place = F.pmod(F.xxhash64(*keys), F.lit(self.parts)) + self.parts * F.pmod(F.hash(*keys, *beside), F.lit(own))
        return rows.repartitionById(self.parts * own, place.cast("int"))

    def stage(self, batch: DataFrame) -> str:
        """Writes a batch by part, once; `merge_staged` reads each part from there."""
        name = f"staged/{uuid.uuid4().hex}"
        if "part" not in batch.columns:
            batch = batch.withColumn("part", self.part())
        batch.write.partitionBy("part").parquet(f"{self.folder.root}/{name}")
        return name

    def merge(self, batch: DataFrame, writer: str, number: int, seq: Sequence[str]) -> Merge:
        """Folds a batch, in `seq` order, into the table. Rows without one of the keys have no row to go to
        and are left out."""
        last = self.manifest()["writers"].get(writer)
        if last and number <= last["number"]:
            return Merge(last["version"], last["n_new"], last["n_updated"], True)
        there = F.lit(True)
        for k in self.shape["keys"]:
            there &= F.col(k).isNotNull()
        staged = self.stage(batch.where(there))
        done = self.merge_staged(staged, batch.schema, writer, number, seq)
        self.folder.delete(staged)
        return done

    def _written(self, base: dict, staged: str, schema, touched: list[int], tag: str, seq: Sequence[str]) -> tuple[dict[str, str], dict]:
        """Rewrites the touched parts of a version; their folders, and how many keys are new and updated."""
        if not touched:
            return {}, {"n_new": 0, "n_updated": 0}
        batch = self.spark.read.schema(schema).parquet(*[f"{self.folder.root}/{staged}/part={p}" for p in touched])
        before = self._rows([base["parts"][str(p)] for p in touched if str(p) in base["parts"]])
        after = fold_into(before.select(*self.columns, "batch"), batch.withColumn("batch", F.lit(tag)), self.shape["keys"], seq, self.shape["first"], [*self.shape["last"], "batch"], self.shape["last_known"])
        # rows that the batch doesn't touch keep their batch, so is_new means something only beside it
        mine = F.col("batch") == tag
        seen = Observation()
        counted = after.observe(seen, F.count_if(mine & F.col("is_new")).alias("n_new"), F.count_if(mine & ~F.col("is_new")).alias("n_updated"))
        name = f"parts/{uuid.uuid4().hex}"
        counted.select(*self.columns, "batch", "is_new", self.part().alias("part")).write.partitionBy("part").parquet(f"{self.folder.root}/{name}")
        return {str(p): f"{name}/part={p}" for p in touched}, seen.get

    def merge_staged(self, staged: str, schema, writer: str, number: int, seq: Sequence[str], before_commit: Callable[[], None] = lambda: None) -> Merge:
        touched = sorted(int(n.removeprefix("part=")) for n in self.folder.names(staged) if n.startswith("part=") and not n.startswith("part=-"))
        tag, base, done = f"{writer}:{number}", self.manifest(), None
        while True:
            last = base["writers"].get(writer)
            if last and number <= last["number"]:
                return Merge(last["version"], last["n_new"], last["n_updated"], True)
            if done is None:
                done = self._written(base, staged, schema, touched, tag, seq)
            before_commit()
            parts, counts = done
            version = base["version"] + 1
            entry = {"number": number, "version": version, **counts}
            if self.folder.put_json_once(f"versions/v{version:012d}.json", {"version": version, "parts": base["parts"] | parts, "writers": base["writers"] | {writer: entry}}):
                return Merge(version, counts["n_new"], counts["n_updated"], False)
            now = self.manifest()
            if any(now["parts"].get(p) != base["parts"].get(p) for p in parts):
                done = None  # another writer changed a part that this batch touches
            base = now

    def vacuum(self, keep: int = 1) -> None:
        """Deletes all but the last versions and what no kept one names. Not to be run beside writers or readers of older versions."""
        names = [n for n in self.folder.names("versions") if n.endswith(".json")]
        used = {f for n in names[-keep:] for f in self.folder.read_json(f"versions/{n}")["parts"].values()}
        for n in names[:-keep]:
            self.folder.delete(f"versions/{n}")
        for folder in self.folder.names("parts"):
            for part in self.folder.names(f"parts/{folder}"):
                if part.startswith("part=") and f"parts/{folder}/{part}" not in used:
                    self.folder.delete(f"parts/{folder}/{part}")
        self.folder.delete("staged")

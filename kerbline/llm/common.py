"""Helpers shared by the training-data operators: scratch tables, text hashing, graph components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """Shared folder that the session names in spark.checkpoint.dir.

    Where none is named, a local session gets a temporary one (tests); on a cluster that is an error,
    for executors would write to disks of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "kerbline-scratch")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_open: list[Scratch] = []


class Scratch:
    """Intermediate tables of one operator call, as Parquet in the shared folder.

    A saved table cuts lineage and outlives executors; `drop` frees one that is no longer needed,
    `close` all of them. Results of operators read from these tables, so whoever writes a result
    closes them: see `scratch_released`.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        _open.append(self)

    def save(self, df: DataFrame, label: str) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{label}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._kerbline_path = path
        return out

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            self._delete(table._kerbline_path)

    def close(self) -> None:
        self._delete(self.root)


@contextmanager
def scratch_released():
    """Deletes, at its end, the tables of all operators that were called inside; write their results inside."""
    before = len(_open)
    yield
    for scratch in _open[before:]:
        scratch.close()
    del _open[before:]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A table is broadcast up to this many rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True where `df` has at most so many rows and bytes (as JSON text); reads no further than that."""
    some = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return some[0] <= max_rows and (some[1] or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` marked for broadcast where its rows are few; else Spark shuffles it and splits skewed keys."""
    return F.broadcast(df) if fits_broadcast(df, max_rows) else df


def with_part(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds part to (doc_id, text, ...): 0 where all rows of a doc_id have one text, else a hash of the
    row's text, so that (doc_id, part) stands for one text."""
    known = F.xxhash64("text")
    several = texts.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(known).alias("x"), F.max(known).alias("y"))
    several = broadcast_if_small(scratch.save(several.where("x <> y").select(F.col("doc_id").alias("several")), "several"))
    joined = texts.join(several, F.col("doc_id") == F.col("several"), "left")
    return joined.withColumn("part", F.when(F.col("several").isNotNull(), known).otherwise(F.lit(0).cast("long"))).drop("several")


# ---------------------------------------------------------------------------------------------
# Hashing of words and word shingles, for code that runs inside tasks

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z hash as a-z: lower-casing for free
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_STEP = np.array([pow(0xD1342543DE82EF95, k + 1, 2**64) for k in range(64)], dtype=np.uint64)
_powers: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            powers = np.full(size, base, dtype=np.uint64)
            powers[0] = 1
            powers = np.multiply.accumulate(powers)
            _powers[k : k + 1] = [powers]
    return _powers


#: Bytes that are hashed at a time.
_PIECE = 1 << 20


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes -> 64-bit hash, start and end of every word; words are runs of anything but ASCII
    white space, A-Z lower-cased. Works through pieces that end at white space, so the memory it takes
    follows the number of words."""
    found, at = [], 0
    while at < len(data):
        end = min(at + _PIECE, len(data))
        while end < len(data):
            gaps = np.flatnonzero(_SPACE[data[end : end + _PIECE]])
            if len(gaps):
                end += int(gaps[0])
                break
            end = min(end + _PIECE, len(data))
        words, start, stop = _word_spans(data[at:end])
        found.append((words, start + at, stop + at))
        at = end
    if not found:
        return _word_spans(data)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if len(found) > 1 else found[0]


def _word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    none = np.empty(0, dtype=np.int64)
    if not len(data):
        return np.empty(0, dtype=np.uint64), none, none
    edge = np.diff(np.concatenate(([True], _SPACE[data], [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.empty(0, dtype=np.uint64), none, none
    up, down = _power_tables(len(data) + 1)
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)))
    return mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start, end


#: Characters that a task hashes at a time; a single longer text is hashed alone.
CHUNK_CHARS = 1 << 19


def chunks(batch: pd.DataFrame, column: str) -> Iterator[pd.DataFrame]:
    """Rows of a batch in pieces of about CHUNK_CHARS characters, so memory follows the longest text."""
    part = batch[column].str.len().fillna(0).cumsum() // CHUNK_CHARS
    for _, rows in batch.groupby(part, sort=False):
        yield rows


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hash of every word of a text."""
    return word_spans(np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8))[0]


class Sequences:
    """Words in a row, cut into sequences; hashes of any run of them by prefix sums."""

    def __init__(self, words: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.words, self.start, self.end, self.n = words, start, end, end - start
        self.up, self.down = _power_tables(len(words) + 1)
        self._sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(words * self.up[: len(words)], dtype=np.uint64)))

    def run(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words from start to end, wherever they stand."""
        return (self._sums[end] - self._sums[start]) * self.down[start]


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hash of each run of `size` words, in order; a shorter text is one shingle, an empty one none."""
    if not len(words):
        return words
    width = min(size, len(words))
    n = len(words) - width + 1
    out = np.full(n, np.uint64(width), dtype=np.uint64)
    for k in range(width):
        out += words[k : k + n] * _STEP[k]
    return mix64(out)


# ---------------------------------------------------------------------------------------------


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(src, dst) links -> (node, component): the smallest node reachable, for every linked node.

    Alternates the large-star and small-star rewrites of an edge list until it stops changing: each
    edge then joins a node to the smallest node of its component. Every round is grouping and joins
    over edges; nothing is gathered in one place, and each round is written, so lineage stays short.
    """
    current = scratch.save(
        edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges"
    )
    seen = None
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
        after = scratch.save(small, "edges")
        scratch.drop(current)
        current = after
        mark = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )

"""Compression of vectors to short codes by product quantisation in whole numbers.

A component x becomes floor(scale * x). Vectors are cut into equal consecutive parts, each with a
codebook of its own. Codebooks start from the parts of the vectors with the smallest ids and are fitted
in rounds: every part goes to its nearest entry, then an entry becomes the floored mean of its parts.

Each round broadcasts the codebooks, whose size is fixed by the parameters. Tasks compute the distances
of Arrow batches as |v|^2 - 2 v.c + |c|^2 by int64 matrix products and keep sums by entry, so the shuffle
carries `entries` rows for each part and task, whatever the vectors. All is exact: nothing depends on the
order of rows or on lost tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import Scratch, broadcast_if_small

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Whole components must stay below this, so that int64 holds every distance and every task's sum.
LARGEST = 1 << 27
_BATCH = 4096


@dataclass(frozen=True)
class Codebooks:
    """entries[part] is a table of whole numbers, an entry a row."""

    entries: tuple[np.ndarray, ...]
    scale: int = SCALE

    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(x) for book in self.entries for x in book.ravel().tolist()).encode()).hexdigest()

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Entry numbers, a row for each vector -> the vectors that they stand for."""
        return np.concatenate([book[codes[:, k]] for k, book in enumerate(self.entries)], axis=1) / self.scale


def whole_vectors(vectors: DataFrame, scratch: Scratch, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, embedding, label) -> vec_id, label, v of the vectors that are kept."""
    known = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("x"))
    odd = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # a few rows' check beside a plain comparison: too large a component has no exact code
    too_large = F.exists("x", lambda x: F.abs(x) >= LARGEST / scale)
    checked = F.when(too_large, F.raise_error(F.lit(f"a component is {LARGEST} / {scale} or more"))).otherwise(F.transform("x", lambda x: F.floor(x * scale).cast("int")))
    kept = scratch.save(known.where(F.col("x").isNotNull() & ~odd).select("vec_id", "label", checked.alias("v")), "whole")
    size = kept.agg(F.min_by(F.size("v"), F.struct(F.col("vec_id").isNull(), "vec_id", F.size("v")))).first()[0]
    if size is not None and (size == 0 or size % parts):
        raise ValueError(f"vectors of {size} components can't be cut into {parts} equal parts")
    return kept.where(F.size("v") == F.lit(size if size is not None else 0))


def nearest(v: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest entry, the first of equally near ones, and the squared distance to it."""
    gap = (v * v).sum(axis=1)[:, None] - 2 * (v @ book.T) + (book * book).sum(axis=1)[None, :]
    at = gap.argmin(axis=1)
    return at, gap[np.arange(len(v)), at]


def _parts(batch: pa.RecordBatch, parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of a batch and their vectors, as (row, part, component)."""
    for at in range(0, batch.num_rows, _BATCH):
        some = batch.slice(at, _BATCH)
        flat = some.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        yield some, flat.reshape(some.num_rows, parts, -1)


def _entry_sums(books: tuple[np.ndarray, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), dtype=np.int64) for b in books]
        for batch in batches:
            for _, v in _parts(batch, len(books)):
                for k, book in enumerate(books):
                    at, _ = nearest(v[:, k], book)
                    order = np.argsort(at, kind="stable")
                    used, first = np.unique(at[order], return_index=True)
                    sums[k][used] += np.add.reduceat(v[order, k], first, axis=0)
                    counts[k] += np.bincount(at, minlength=len(book))
        rows = [(k, int(e), int(counts[k][e]), sums[k][e].tolist()) for k in range(len(books)) for e in np.flatnonzero(counts[k])]
        names = ["part", "entry", "n", "sums"]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    return run


def fit_codebooks(whole: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks of `whole_vectors`; None where there is no vector. Only entries reach the driver."""
    known = whole.where("vec_id IS NOT NULL")
    seeds = [r["v"] for r in known.orderBy("vec_id", "v").limit(entries).select("v").collect()]
    if not seeds:
        return None
    start = np.array(seeds, dtype=np.int64).reshape(len(seeds), parts, -1)
    books = [start[:, k].copy() for k in range(parts)]
    width = start.shape[2]
    for _ in range(rounds):
        sums = whole.select("v").mapInArrow(_entry_sums(tuple(books)), "part int, entry int, n long, sums array<long>")
        each = [F.sum(F.col("sums")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)]
        for row in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).collect():  # parts * entries rows at most
            books[row["part"]][row["entry"]] = [int(row[f"s{k}"]) // row["n"] for k in range(width)]
    return Codebooks(tuple(books), scale)


def _codes(books: tuple[np.ndarray, ...], digits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, v in _parts(batch, len(books)):
                found = [nearest(v[:, k], book) for k, book in enumerate(books)]
                code = ["".join(f"{e:0{digits}x}" for e in row) for row in np.stack([at for at, _ in found], axis=1).tolist()]
                error = np.sum([gap for _, gap in found], axis=0)
                columns = [some.column("vec_id"), some.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    return run


def encode(whole: DataFrame, books: Codebooks) -> DataFrame:
    """`whole_vectors` -> vec_id, label, code, error."""
    digits = max(2, len(f"{len(books.entries[0]) - 1:x}"))
    label = whole.schema["label"].dataType.simpleString()
    return whole.select("vec_id", "label", "v").mapInArrow(_codes(books.entries, digits), f"vec_id long, label {label}, code string, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, embedding, label, ...) -> vec_id, code, error, label_error, codebooks_sha256.

    Vectors that are null or hold null or non-finite components are dropped, and so are those whose
    length is not that of the smallest id's vector; that length must be a multiple of `parts`. A
    component of LARGEST / scale or more is an error, for whole sums would not be exact. Rows that repeat
    an id are vectors of their own, and count among the first `entries` in the order of their components.
    A null id gets a code but is no first entry. Null labels count as one label. With fewer vectors than
    `entries` there are as many entries as vectors. Other columns are ignored, whatever their names; an
    empty table gives no rows, and so does one without a usable vector that has an id.
    """
    scratch = Scratch(vectors.sparkSession, "codes")
    whole = whole_vectors(vectors, scratch, parts, scale)
    books = fit_codebooks(whole, parts, entries, rounds, scale)
    schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    if books is None:
        return vectors.sparkSession.createDataFrame([], schema)
    coded = scratch.save(encode(whole, books), "coded")
    by_label = broadcast_if_small(coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error")))
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("of_label")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same result in DuckDB's SQL, by all distances, round after round."""

    def assigned(book: str) -> str:
        return f"""
  SELECT vec_id, label, part, any_value(v) AS v, min(entry) FILTER (gap = least) AS entry, min(gap) AS gap
  FROM (SELECT p.*, entry, gap, min(gap) OVER (PARTITION BY vec_id, part) AS least
        FROM (SELECT p.*, b.entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS gap
              FROM pieces p JOIN {book} b USING (part)) p) GROUP BY vec_id, label, part"""

    steps = [
        f"""kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {scale})::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""pieces AS MATERIALIZED (
  SELECT vec_id, label, k AS part, v[k * len(v) // {parts} + 1 : (k + 1) * len(v) // {parts}] AS v FROM kept, range(0, {parts}) AS r(k))""",
        f"""b0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM pieces
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries}))""",
    ]
    for k in range(rounds):
        steps += [
            f"a{k} AS MATERIALIZED ({assigned(f'b{k}')})",
            f"""s{k} AS (
  SELECT part, entry, place, sum(x)::BIGINT AS s, count(*) AS n
  FROM (SELECT part, entry, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS place FROM a{k}) GROUP BY part, entry, place)""",
            f"""m{k} AS (
  SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY place)::BIGINT[] AS v FROM s{k} GROUP BY part, entry)""",
            f"b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN m{k} m USING (part, entry))",
        ]
    steps += [
        f"coded AS MATERIALIZED ({assigned(f'b{rounds}')})",
        "joined AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(gap)::BIGINT AS error FROM coded GROUP BY vec_id, label)",
        f"digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})",
    ]
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM joined, digest"

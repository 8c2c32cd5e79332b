"""Near-duplicate vectors by spherical-cap filters with structured random product codes.

A filter is a direction; a vector passes where its cosine with the direction reaches the vector's own
height. Two vectors are compared where they pass a filter together. Directions are a product code: a
randomly rotated vector is cut into BLOCKS parts, each part has a code of random unit vectors, and every
combination of code words is a direction. A vector is list-decoded to the directions that it exceeds:
the best words of each part are combined, and the height is that of the PASSES best combinations, so
every vector passes the same number of filters, wherever it lies. ROTATIONS independent codes are used,
for what one rotation misses another finds. The number of directions follows the number of vectors, so
that a filter holds about PER_FILTER unrelated vectors at every size.

The search is probabilistic; more directions mean narrower caps. Measured by `recall` on pairs of
64-dimensional random vectors at cosine 0.95, which is the hardest case (a pair above it is missed less
often, and clustered vectors share caps): see MEASURED_RECALL, which a test keeps true.

Filters with many vectors are cut into cells of two blocks of at most CELL vectors, so any filter is
compared whole by many small tasks. Cells see sketches first, SKETCH signs of random projections, and
only vectors that are within `sketch_distance` of another one there are fetched: at the threshold the
chance to lie further apart is below 1e-6. A cell then compares its vectors in double precision and
returns, for each vector, how many it links with and one link that leads to the smallest vector
reachable within the cell: never all pairs. A pair is counted in the first filter that it shares. Equal
vectors are one class with a count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import Scratch, broadcast_if_small, connected_components

BLOCKS = 2
ROTATIONS = 8
PASSES = 2
PER_FILTER = 192
CELL = 512
SKETCH = 192
#: Vectors in a table -> share of the pairs at cosine 0.95 that meet.
MEASURED_RECALL = {10_000: 1.0, 1_000_000: 1.0, 100_000_000: 0.995}
_LEAST_DIMENSION = 16
_SKETCH = [f"s{k}" for k in range(SKETCH // 64)]

Code = tuple[np.ndarray, list[np.ndarray]]


def _codes(dimension: int, words: int) -> list[Code]:
    """For each rotation: the rotation of the padded space, and the code words of each part."""
    rng = np.random.default_rng([dimension, words, 20240229])
    padded = max(_LEAST_DIMENSION, -(-dimension // BLOCKS) * BLOCKS)
    out = []
    for _ in range(ROTATIONS):
        rotation = np.linalg.qr(rng.standard_normal((padded, padded)))[0][:dimension]
        codes = [rng.standard_normal((words, padded // BLOCKS)) for _ in range(BLOCKS)]
        out.append((rotation, [c / np.linalg.norm(c, axis=1, keepdims=True) for c in codes]))
    return out


def code_words(vectors: int) -> int:
    """Code words for each part, for this many vectors."""
    return int(np.ceil(max(8.0, PASSES * vectors / PER_FILTER) ** (1 / BLOCKS)))


def _best(scores: np.ndarray, numbers: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n highest scores of each row and their numbers."""
    n = min(n, scores.shape[1])
    at = np.argpartition(-scores, n - 1, axis=1)[:, :n]
    return np.take_along_axis(scores, at, 1), np.take_along_axis(numbers, at, 1)


def passed_filters(unit: np.ndarray, codes: list[Code]) -> np.ndarray:
    """Directions that each row of `unit` (vectors of length 1) exceeds, as sorted numbers."""
    out = []
    for r, (rotation, parts) in enumerate(codes):
        words, width = parts[0].shape
        turned = unit @ rotation
        total, number = np.zeros((len(unit), 1)), np.zeros((len(unit), 1), dtype=np.int64)
        for b, part in enumerate(parts):
            scores = turned[:, b * width : (b + 1) * width] @ part.T
            # the best combinations take their words from the best of each part
            scores, word = _best(scores, np.broadcast_to(np.arange(words), scores.shape), PASSES)
            total = (total[:, :, None] + scores[:, None, :]).reshape(len(unit), -1)
            number = (number[:, :, None] * words + word[:, None, :]).reshape(len(unit), -1)
            total, number = _best(total, number, PASSES)
        out.append(number + r * words**BLOCKS)
    return np.sort(np.concatenate(out, axis=1), axis=1)


def recall(vectors: int, pairs: int = 2000, cosine: float = 0.95, dimension: int = 64, seed: int = 1) -> float:
    """Share of random pairs at this cosine that meet under the codes of a table of so many vectors."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((pairs, dimension))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.standard_normal((pairs, dimension))
    z -= (z * x).sum(axis=1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    codes = _codes(dimension, code_words(vectors))
    a, b = passed_filters(x, codes), passed_filters(cosine * x + np.sqrt(1 - cosine**2) * z, codes)
    return float((a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).mean())


def sketch_distance(threshold: float, miss: float = 1e-6) -> int:
    """Signs of SKETCH that may differ: two vectors at this cosine differ in more with chance `miss` at most."""
    share = math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    left, distance = 1.0, 0
    for distance in range(SKETCH + 1):
        left -= math.comb(SKETCH, distance) * share**distance * (1 - share) ** (SKETCH - distance)
        if left <= miss:
            break
    return distance


def _sketches(unit: np.ndarray) -> np.ndarray:
    """Three integers with the signs of each row's projections."""
    planes = np.random.default_rng([unit.shape[1], SKETCH]).standard_normal((unit.shape[1], SKETCH))
    return np.packbits(unit @ planes > 0, axis=1).view(np.int64)


def _values(vector: object) -> np.ndarray | None:
    """The vector's numbers, in single precision where that holds them exactly; None where it links with nothing."""
    if vector is None:
        return None
    values = np.array([np.nan if x is None else x for x in vector], dtype=np.float64)
    if not len(values) or not np.isfinite(values).all() or not values.any():
        return None
    with np.errstate(over="ignore"):
        single = values.astype(np.float32)
    return single if (single == values).all() else values


def _units(raw: pd.Series, dimension: int) -> np.ndarray:
    """Vectors of length 1, in double precision."""
    values = np.stack([np.frombuffer(x, dtype=np.float32 if len(x) == 4 * dimension else np.float64).astype(np.float64) for x in raw])
    values /= np.abs(values).max(axis=1)[:, None]
    return values / np.linalg.norm(values, axis=1)[:, None]


def _usable(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        values = [_values(v) for v in batch["embedding"]]
        good = np.array([v is not None for v in values], dtype=bool)
        out = batch.loc[good, ["h1", "h2", "node", "n"]].copy()
        out["dimension"] = np.array([len(v) for v in values if v is not None], dtype=np.int32)
        out["raw"] = [v.tobytes() for v in values if v is not None]
        yield out


def _decoded(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes: dict[int, list[Code]] = {}
        for batch in batches:
            for dimension, rows in batch.groupby("dimension"):
                if dimension not in codes:
                    codes[dimension] = _codes(dimension, words)
                unit = _units(rows["raw"], dimension)
                sketch = _sketches(unit)
                out = rows[["id", "node", "n", "dimension", "raw"]].copy()
                yield out.assign(filters=list(passed_filters(unit, codes[dimension])), **{name: sketch[:, k] for k, name in enumerate(_SKETCH)})

    return run


def _earlier_shared(earlier: list[np.ndarray]) -> np.ndarray:
    """Matrix of vectors: True where two of them share one of the earlier filters."""
    numbers, column = np.unique(np.concatenate(earlier), return_inverse=True)
    passes = np.zeros((len(earlier), max(1, len(numbers))), dtype=np.float32)
    passes[np.repeat(np.arange(len(earlier)), [len(f) for f in earlier]), column] = 1
    return passes @ passes.T > 0


def _compared(cell: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """One cell, its rows in the order of node."""
    unit = _units(cell["raw"], int(cell["dimension"].iloc[0]))
    linked = unit @ unit.T >= threshold
    np.fill_diagonal(linked, False)
    if cell["i"].iloc[0] != cell["j"].iloc[0]:
        block = cell["block"].to_numpy()
        linked &= block[:, None] != block[None, :]
    some = np.flatnonzero(linked.any(axis=1))
    linked = linked[np.ix_(some, some)]
    node, n = cell["node"].to_numpy()[some], cell["n"].to_numpy()[some]
    if len(some):
        linked &= ~_earlier_shared([np.asarray(cell["earlier"].iloc[k], dtype=np.int64) for k in some])
    least = np.arange(len(some))
    while len(some):
        lower = np.where(linked, least[None, :], len(some)).min(axis=1)
        after = np.minimum(least, lower)
        if (after == least).all():
            break
        least = after
    out = pd.DataFrame({"node": node, "degree": linked @ n, "other": node[least]})
    return out[out["degree"] > 0]


_CELL = ["dimension", "filter", "i", "j"]


def _near_sketches(cell: pd.DataFrame, distance: int) -> pd.DataFrame:
    """The rows of one cell that have another one within the distance."""
    apart = np.zeros((len(cell), len(cell)), dtype=np.int32)
    for name in _SKETCH:
        signs = cell[name].to_numpy().view(np.uint64)
        apart += np.bitwise_count(signs[:, None] ^ signs[None, :])
    np.fill_diagonal(apart, SKETCH + 1)
    if cell["i"].iloc[0] != cell["j"].iloc[0]:
        block = cell["block"].to_numpy()
        apart[block[:, None] == block[None, :]] = SKETCH + 1
    return cell.loc[(apart <= distance).any(axis=1), [*_CELL, "block", "id"]]


def _by_cell(work):
    """Runs work on each cell of two rows or more. Rows come sorted by cell; the last cell of a batch may go on in the next one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(rows):
                continue
            key = rows[_CELL].to_numpy(dtype=np.int64)
            begin = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1))))
            done = [work(rows.iloc[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True) if b - a > 1]
            if done:
                yield pd.concat(done, ignore_index=True)
            held = rows.iloc[begin[-1] :]
        if held is not None and len(held) > 1:
            yield work(held)

    return run


def near_vectors(embeddings: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(vec_id, embedding, ...) -> one row per vector: vec_id, n_links, component_id, kept.

    Two vectors of one dimension link where their cosine in double precision is at least `threshold`.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing.
    component_id is the smallest vec_id reachable over links; n_links counts the other vectors linked
    directly, copies too. Rows of equal vectors are one class however many they are. Rows that repeat
    a vec_id are vectors of their own that share a component. A null vec_id links with nothing and
    keeps its row, with a null component. Vectors of any length are compared whole. Other columns are
    ignored; an empty table gives no rows.
    """
    scratch = Scratch(embeddings.sparkSession, "vectors")
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    hashed = vectors.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")})
    classes = hashed.where("vec_id IS NOT NULL AND embedding IS NOT NULL").groupBy("h1", "h2").agg(
        F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding")
    )
    schema = "h1 long, h2 long, node long, n long, dimension int, raw binary"
    classes = classes.mapInPandas(_usable, schema).withColumn("id", F.monotonically_increasing_id())
    classes = scratch.save(classes, "classes")  # ids are fixed when the table is written
    words = code_words(classes.count())

    schema = "id long, node long, n long, dimension int, raw binary, filters array<long>, " + ", ".join(f"{name} long" for name in _SKETCH)
    decoded = scratch.save(classes.select("id", "node", "n", "dimension", "raw").mapInPandas(_decoded(words), schema), "decoded")
    passed = decoded.select("id", "dimension", *_SKETCH, F.explode("filters").alias("filter"))
    crowded = passed.groupBy("dimension", "filter").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > CELL)
    crowded = crowded.select("dimension", "filter", F.ceil(F.col("members") / CELL).cast("int").alias("blocks"))
    crowded = broadcast_if_small(scratch.save(crowded, "crowded"))
    blocks = F.coalesce("blocks", F.lit(1))
    member = passed.join(crowded, ["dimension", "filter"], "left").withColumn("block", F.pmod(F.xxhash64("id", "filter"), blocks).cast("int"))
    member = member.withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cells = member.withColumns({"i": F.least("block", "with"), "j": F.greatest("block", "with")}).drop("with", "blocks")
    dealt = cells.repartition(*_CELL).sortWithinPartitions(*_CELL)
    distance = sketch_distance(threshold)
    close = dealt.mapInPandas(_by_cell(lambda cell: _near_sketches(cell, distance)), "dimension int, filter long, i int, j int, block int, id long")
    close = scratch.save(close, "close")

    earlier = F.expr("slice(filters, 1, greatest(0, array_position(filters, filter) - 1))")  # filters are sorted
    fetched = close.join(decoded.select("id", "node", "n", "raw", "filters"), "id").withColumn("earlier", earlier).drop("filters", "id")
    dealt = fetched.repartition(*_CELL).sortWithinPartitions(*_CELL, "node")
    found = scratch.save(dealt.mapInPandas(_by_cell(lambda cell: _compared(cell, threshold)), "node long, degree long, other long"), "links")
    scratch.drop(decoded, close)

    degrees = found.groupBy("node").agg(F.sum("degree").alias("degree"))
    components = connected_components(found.select(F.col("node").alias("src"), F.col("other").alias("dst")), scratch)
    known = classes.select("h1", "h2", "node", "n").join(degrees, "node", "left").join(components, "node", "left")
    links = F.coalesce("degree", F.lit(0)) + F.col("n") - 1
    known = scratch.save(known.select("h1", "h2", links.alias("links"), F.coalesce("component", "node").alias("component")), "known")
    scratch.drop(classes, found)
    rows = hashed.select("vec_id", F.when(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull(), F.col("h1")).alias("h1"), "h2")
    result = rows.join(broadcast_if_small(known), ["h1", "h2"], "left")
    component = F.coalesce("component", "vec_id")
    return result.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))

"""Packing of tokenised documents into fixed-length sequences: dominance reduction, then best fit.

Lengths are integers up to the capacity, so however many pieces there are, their lengths are a
histogram of at most `capacity` counts. The packing is planned on the histogram alone: a plan is a
list of (count, pattern) where a pattern is the lengths one sequence holds. Pieces then take the
plan's places by their rank among pieces of equal length; pieces as long as a sequence need no rank.
Only the histogram reaches the driver.

Planning first applies the Martello-Toth dominance criteria: for a length j, a set holding j that
dominates every other feasible set holding j is packed for good (j alone where nothing fits beside
it; j with its exact complement; j with the largest k that fits where no two pieces fit beside j, or
where no three do and no two fill more than k). The shrunken histogram is packed by best fit, longest
pieces first, all equal pieces and equal sequences at a time.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbline.llm.common import Scratch

CAPACITY = 2048
Pattern = tuple[tuple[int, int], ...]  # (length, how many), longest first


def _add(pattern: Pattern, length: int, n: int) -> Pattern:
    return (*pattern[:-1], (length, pattern[-1][1] + n)) if pattern and pattern[-1][0] == length else (*pattern, (length, n))


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, Pattern]], dict[int, int]]:
    """Histogram -> sequences that an optimal packing may contain as they are, and what is left."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    fixed: list[tuple[int, Pattern]] = []

    def smallest(skip: int, n: int) -> list[int]:
        """The n smallest lengths left, without one piece of length `skip`."""
        out: list[int] = []
        for at in np.flatnonzero(left):
            out += [int(at)] * int(min(n - len(out), left[at] - (at == skip)))
            if len(out) >= n:
                break
        return out

    def best_pair(j: int) -> int:
        """Most that two pieces beside j can fill."""
        room, there = capacity - j, left.copy()
        there[j] -= 1
        lengths = [int(x) for x in np.flatnonzero(there[: room + 1])]
        best, lo, hi = 0, 0, len(lengths) - 1
        while lo <= hi:
            total = lengths[lo] + lengths[hi]
            if total > room:
                hi -= 1
                continue
            if lo < hi or there[lengths[lo]] > 1:
                best = max(best, total)
            lo += 1
        return best

    for j in range(capacity, 0, -1):
        while left[j] > 0:
            room = capacity - j
            fits = np.flatnonzero(left[: room + 1])
            if len(fits) and fits[-1] == j and left[j] == 1:
                fits = fits[:-1]
            if not len(fits):
                fixed.append((int(left[j]), ((j, 1),)))
                left[j] = 0
                break
            k = int(fits[-1])
            low = smallest(j, 3)
            alone = k == room or len(low) < 2 or sum(low[:2]) > room
            if not alone and (len(low) < 3 or sum(low) > room):
                alone = k >= best_pair(j)
            if not alone:
                break
            n = int(left[j] // 2 if j == k else min(left[j], left[k]))
            if n == 0:
                break
            fixed.append((n, ((j, 2),) if j == k else ((max(j, k), 1), (min(j, k), 1))))
            left[j] -= n
            left[k] -= n
    return fixed, {int(x): int(left[x]) for x in np.flatnonzero(left)}


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, Pattern]]:
    """Histogram -> sequences by best fit, longest first. Equal sequences are handled together."""
    open_: dict[int, dict[Pattern, int]] = {}

    def put(room: int, pattern: Pattern, n: int) -> None:
        if n:
            group = open_.setdefault(room, {})
            group[pattern] = group.get(pattern, 0) + n

    for length in sorted(counts, reverse=True):
        need = counts[length]
        for room in sorted(r for r in open_ if r >= length):
            if not need:
                break
            for pattern, n in list(open_[room].items()):
                each = room // length
                full = min(n, need // each)
                rest = need - full * each
                part = min(rest, each - 1) if full < n else 0
                need -= full * each + part
                kept = n - full - (part > 0)
                open_[room][pattern] = kept
                if not kept:
                    del open_[room][pattern]
                put(room - each * length, _add(pattern, length, each), full)
                if part:
                    put(room - part * length, _add(pattern, length, part), 1)
                if not need:
                    break
            if not open_[room]:
                del open_[room]
        each = capacity // length
        put(capacity - each * length, ((length, each),), need // each)
        if need % each:
            put(capacity - (need % each) * length, ((length, need % each),), 1)
    return [(n, pattern) for group in open_.values() for pattern, n in group.items()]


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, Pattern]]:
    fixed, left = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(left, capacity)


def _encoder(path: str):
    """Text -> ids. The vocabulary is given as a tokenizers file; where a file with the same ranks lies
    beside it, that is used, for its encoder is several times as fast and gives the same ids."""
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    fast = None
    try:
        import public_tokenizers

        with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    except (ImportError, FileNotFoundError):
        pass

    def encode(text: str) -> np.ndarray:
        if fast is not None and not any(s in text for s in special):
            try:
                return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), dtype=np.uint32)
            except BaseException as error:  # the fast pattern engine gives up on some extreme texts
                if type(error).__name__ not in ("PanicException", "ValueError", "RuntimeError"):
                    raise
        return np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return encode


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(path)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                start, end = 0, len(ids) % capacity or capacity
                piece = 0
                while start < len(ids):
                    out.append((doc_id, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                    piece, start, end = piece + 1, end, end + capacity
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return run


def pack(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, text, ...) -> one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and `end_id`. One longer than `capacity` is cut into pieces of
    `capacity`, the first of which may be shorter. Each sequence holds pieces without gaps from
    offset 0. Null or empty text is the end token alone. Rows that repeat a doc_id are packed each on
    its own; a null doc_id stays null. Very long texts are encoded whole. Other columns are ignored. An
    empty table gives no rows.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "packing")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    # a piece's number: its task's and its place in that task's output, fixed when the table is written
    pieces = texts.mapInPandas(_pieces(tokenizer_path, capacity, end_id), schema).withColumn("number", F.monotonically_increasing_id())
    pieces = scratch.save(pieces, "pieces").withColumn("chunk", F.shiftright("number", 33))

    full, short = pieces.where(F.col("length") == capacity), pieces.where(F.col("length") < capacity)
    chunks = short.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in chunks.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    slots, first_free, next_id = [], dict.fromkeys(counts, 0), 0
    for n, pattern in plan_sequences(counts, capacity):
        offset = 0
        for length, each in pattern:
            slots.append((length, first_free[length], first_free[length] + n * each, next_id, each, offset))
            first_free[length] += n * each
            offset += length * each
        next_id += n
    # the plan has a few rows for each length, whatever the input
    places = F.broadcast(spark.createDataFrame(slots, "length long, lo long, hi long, first_id long, each long, at long"))

    # ranks within one length of one task's pieces, and how many pieces of it earlier tasks have
    before = chunks.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("chunk")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy("length", "chunk").orderBy("number")) - 1
    ranked = short.withColumn("within", within).join(before, ["length", "chunk"]).withColumn("rank", F.col("before") + F.col("within"))
    placed = ranked.join(places, "length").where("rank >= lo AND rank < hi")
    piece = ["doc_id", "piece", "start", "length", "ids_crc32"]
    placed = placed.select(*piece, F.expr("first_id + (rank - lo) div each").alias("sequence_id"), F.expr("at + ((rank - lo) % each) * length").alias("offset"))
    alone = full.select(*piece, (-1 - F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(alone)

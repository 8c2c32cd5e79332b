"""Removal of passages that repeat an earlier passage word for word, across all documents.

A window is `window` words in a row of one document; words are runs of anything but ASCII white space,
unchanged. A window is a repeat where the same words also start earlier, by (doc_id, word number). Every
word that a repeat covers goes; windows are judged on the input.

Each window has a rolling polynomial hash of its words, 64 bits and 16 bits of a second one. Texts are
hashed in chunks of about a million words. Of equal windows in a chunk only the first goes on, so however
often a passage repeats, it costs the shuffle one row a chunk:
* a chunk's hashes are dealt into buckets by their first bits, as packed arrays; the number of buckets
  follows the corpus, so a bucket fits in a task at any size. A bucket gives back the windows whose hash
  another chunk has too;
* windows that are left take their place (doc_id, word number) and are counted by hash in Spark; all but
  the earliest are repeats;
* repeats of a document, those found inside a chunk among them, merge into maximal intervals of words.

Two windows with other words count as equal with a chance of 2^-80.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm.common import Scratch, _power_tables, mix64, with_part

WINDOW = 20
#: Bytes of text that are hashed as one chunk (a longer text is one chunk's input alone), and that a bucket stands for.
CHUNK_BYTES, BUCKET_BYTES = 1 << 22, 1 << 24
LEAST_BUCKETS = 256
_CHUNK_WINDOWS = 1 << 20
_BYTE = np.random.default_rng(20250611).integers(0, 2**64, 256, dtype=np.uint64)
_SECOND = np.uint64(0xA54FF53A5F1D36F1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_GAP = re.compile(rb"[ \t-\r]")
_PIECE = 1 << 20


def _cut(data: bytes) -> Iterator[bytes]:
    """The bytes in pieces of about _PIECE that end at white space."""
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + _PIECE)
        end = gap.start() if gap else len(data)
        yield data[at:end]
        at = end


def _word_values(text: str | None) -> np.ndarray:
    """64-bit hash of every word."""
    found = [np.empty(0, dtype=np.uint64)]
    for piece in _cut((text or "").encode("utf-8", "surrogatepass")):
        data = np.frombuffer(piece, dtype=np.uint8)
        edge = np.diff(np.concatenate(([True], _SPACE[data], [True])).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        up, down = _power_tables(len(data) + 1)
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)))
        found.append(mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)))
    return np.concatenate(found)


def window_hashes(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes of every run of `window` words: 64 bits, and 16 bits of another."""
    n = len(words) - window + 1
    up, down = _power_tables(len(words) + 1)
    out = []
    for values in (words, mix64(words ^ _SECOND)):
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)))
        out.append(mix64((total[window:] - total[:n]) * down[:n]))
    return out[0], (out[1] >> np.uint64(48)).astype(np.uint16)


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last place of every run of set flags."""
    edge = np.diff(np.concatenate(([False], flags, [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _chunk_rows(docs: list[tuple[int, int, str]], window: int, bits: int, number: int) -> Iterator[tuple]:
    """Rows of one chunk: its documents with the repeats inside it, and its windows by bucket."""
    docs = sorted({(d, p): (d, p, t) for d, p, t in docs}.values(), key=lambda x: x[:2])
    ids, parts, counts, hs, gs = [], [], [], [], []
    for doc_id, part, text in docs:
        words = _word_values(text)
        if len(words) >= window:
            h, g = window_hashes(words, window)
            ids.append(doc_id)
            parts.append(part)
            counts.append(len(h))
            hs.append(h)
            gs.append(g)
    if not ids:
        return
    h_all, g_all = np.concatenate(hs), np.concatenate(gs)
    doc = np.repeat(np.arange(len(ids)), counts)
    start = np.arange(len(h_all)) - np.repeat(np.cumsum(counts) - counts, counts)
    ids, parts = np.array(ids, dtype=np.int64), np.array(parts, dtype=np.int64)
    for at in range(0, len(h_all), _CHUNK_WINDOWS):
        h, g, d, s = (x[at : at + _CHUNK_WINDOWS] for x in (h_all, g_all, doc, start))
        order = np.argsort(h, kind="stable")
        again = np.concatenate(([False], (h[order][1:] == h[order][:-1]) & (g[order][1:] == g[order][:-1])))
        inside = np.zeros(len(h), dtype=bool)
        inside[order[again]] = True
        used, first = np.unique(d, return_index=True)
        # names its place and its content, so rows of a task that ran twice on other rows never meet
        content = int(np.sum(h * (np.arange(len(h), dtype=np.uint64) + np.uint64(1)), dtype=np.uint64)) ^ int(np.sum(mix64(ids[used].view(np.uint64)), dtype=np.uint64))
        chunk = int(mix64(np.array([content ^ number ^ (at << 20)], dtype=np.uint64)).view(np.int64)[0])
        # runs of repeats, cut where a document ends
        from_, to = _runs(inside)
        cut = np.unique(np.concatenate((from_, first[inside[first]])))
        ends = np.minimum(to[np.searchsorted(to, cut, side="right")] if len(cut) else to, np.append(first[1:], len(h))[np.searchsorted(first, cut, side="right") - 1])
        repeats = np.stack([ids[d[cut]], parts[d[cut]], s[cut], ends - cut]).astype("<i8")
        places = np.stack([ids[used], parts[used], first, s[first]]).astype("<i8")
        yield chunk & ((1 << bits) - 1), chunk, places.tobytes(), repeats.tobytes(), None, None, None, None
        left = np.flatnonzero(~inside)
        bucket = (h[left] >> np.uint64(64 - bits)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        left, bucket = left[by], bucket[by]
        gap = np.diff(left, prepend=0)
        cut = np.flatnonzero((np.diff(bucket, prepend=-1) != 0) | (gap > 0xFFFF))
        gap[cut] = 0
        tails = h[left].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]  # the bucket has the first byte
        for lo, hi in zip(cut, np.append(cut[1:], len(left)), strict=True):
            yield int(bucket[lo]), chunk, None, None, int(left[lo]), gap[lo:hi].astype("<u2").tobytes(), tails[lo:hi].tobytes(), g[left[lo:hi]].astype("<u2").tobytes()


_BLOCK = ["bucket", "chunk", "docs", "repeats", "first", "gaps", "tails", "g"]
_BLOCK_SCHEMA = "bucket int, chunk long, docs binary, repeats binary, first int, gaps binary, tails binary, g binary"


def _blocks(window: int, bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, docs, held = TaskContext.get().partitionId() << 24, [], 0
        for batch in batches:
            for row in zip(batch["doc_id"], batch["part"], batch["text"], strict=True):
                docs.append(row)
                held += len(row[2] or "")
                if held >= CHUNK_BYTES:
                    number += 1
                    yield pd.DataFrame(_chunk_rows(docs, window, bits, number), columns=_BLOCK)
                    docs, held = [], 0
        yield pd.DataFrame(_chunk_rows(docs, window, bits, number + 1), columns=_BLOCK)

    return run


_MET_SCHEMA = "chunk long, docs binary, repeats binary, places binary, h binary, g binary"


def _met_elsewhere(bits: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """A bucket's rows -> the same with only the windows whose hash stands in another row too."""
        packed = rows["tails"].notna().to_numpy()
        others = rows.loc[~packed, ["chunk", "docs", "repeats"]].assign(places=None, h=None, g=None)
        blocks = rows[packed]
        if not len(blocks):
            return others
        tails = np.frombuffer(b"".join(blocks["tails"]), dtype=np.uint8).reshape(-1, 7)
        h = np.zeros((len(tails), 8), dtype=np.uint8)
        h[:, :7] = tails
        h = h.view("<u8").ravel()
        h |= np.uint64(int(rows["bucket"].iloc[0]) >> (bits - 8)) << np.uint64(56)
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        met = np.zeros(len(h), dtype=bool)
        met[order[1:][same]] = True
        met[order[:-1][same]] = True
        out, ends = [], np.cumsum(blocks["g"].map(len).to_numpy() // 2)
        for chunk, first, gaps, g, lo, hi in zip(blocks["chunk"], blocks["first"], blocks["gaps"], blocks["g"], np.append(0, ends[:-1]), ends, strict=True):
            keep = met[lo:hi]
            if keep.any():
                places = int(first) + np.cumsum(np.frombuffer(gaps, dtype="<u2"), dtype=np.int64)
                out.append((chunk, None, None, places[keep].astype("<u4").tobytes(), h[lo:hi][keep].tobytes(), np.frombuffer(g, dtype="<u2")[keep].tobytes()))
        return pd.concat([others, pd.DataFrame(out, columns=others.columns)])

    return run


_PLACED_SCHEMA = "h long, g int, doc_id long, part long, start int, n int"


def _placed(rows: pd.DataFrame) -> pd.DataFrame:
    """A chunk's rows -> its windows by hash and place, and its own repeats (h null) as runs of n windows."""
    known = rows["docs"].notna().to_numpy()
    if not known.any():
        raise RuntimeError("a task ran again on other rows; save the documents as a table first")
    docs = np.frombuffer(rows["docs"][known].iloc[0], dtype="<i8").reshape(4, -1)
    repeats = np.frombuffer(rows["repeats"][known].iloc[0], dtype="<i8").reshape(4, -1)
    blocks = rows[~known]
    at = np.frombuffer(b"".join(blocks["places"]), dtype="<u4").astype(np.int64)
    doc = np.searchsorted(docs[2], at, side="right") - 1
    met = pd.DataFrame({
        "h": np.frombuffer(b"".join(blocks["h"]), dtype="<i8"), "g": np.frombuffer(b"".join(blocks["g"]), dtype="<u2").astype(np.int32),
        "doc_id": docs[0][doc], "part": docs[1][doc], "start": (at - docs[2][doc] + docs[3][doc]).astype(np.int32), "n": np.ones(len(at), dtype=np.int32),
    }).astype({"h": "Int64"})
    own = pd.DataFrame({"h": pd.array([None] * repeats.shape[1], dtype="Int64"), "g": 0, "doc_id": repeats[0], "part": repeats[1], "start": repeats[2].astype(np.int32), "n": repeats[3].astype(np.int32)})
    return pd.concat([met, own.astype({"g": np.int32})])


@contextmanager
def _shuffles_freed(spark: SparkSession):
    """Inside, a write's shuffle files go when it ends; the table written stands for them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def repeated_windows(texts: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """(doc_id, part, text) -> doc_id, part, spans: runs of repeats, as first window * 2^32 + how many."""
    spark = texts.sparkSession
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = (max(LEAST_BUCKETS, -(-n_bytes // BUCKET_BYTES)) - 1).bit_length()
    blocks = texts.where("doc_id IS NOT NULL").select("doc_id", "part", "text").mapInPandas(_blocks(window, bits), _BLOCK_SCHEMA)
    with _shuffles_freed(spark):
        met = scratch.save(blocks.groupBy("bucket").applyInPandas(_met_elsewhere(bits), _MET_SCHEMA), "met")
        placed = scratch.save(met.groupBy("chunk").applyInPandas(_placed, _PLACED_SCHEMA), "placed")
        scratch.drop(met)
        windows, at = placed.where("h IS NOT NULL"), F.struct("doc_id", "part", "start")
        first = windows.groupBy("h", "g").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("seen")).where("seen > 1").select("h", "g", "first")
        later = windows.join(first.hint("merge"), ["h", "g"]).where(at > F.col("first"))
        repeats = later.select("doc_id", "part", "start", "n").unionByName(placed.where("h IS NULL").select("doc_id", "part", "start", "n"))
        span = F.shiftleft(F.col("start").cast("long"), 32) + F.col("n")
        spans = repeats.groupBy("doc_id", "part").agg(F.collect_list(span).alias("spans"))  # at most a text's own windows
        out = scratch.save(spans, "spans")
    scratch.drop(placed)
    return out


def removal_intervals(spans: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Runs of repeats (first window * 2^32 + how many, in any order) -> rows (first word, one past the
    last word) of the maximal intervals that they cover."""
    spans = np.sort(np.asarray(spans, dtype=np.int64))
    begin = spans >> 32
    end = np.maximum.accumulate(begin + (spans & 0xFFFFFFFF) + window - 1)
    fresh = np.concatenate(([True], begin[1:] > end[:-1]))
    last = np.concatenate((fresh[1:], [True]))
    return np.stack([begin[fresh], end[last]], axis=1)


def _kept(text: str | None, spans: np.ndarray | None, window: int) -> Iterator[tuple[int, list[bytes]]]:
    """The words of a text piece by piece: how many there are, and those outside the intervals."""
    gone = removal_intervals(spans, window) if spans is not None and len(spans) else np.empty((0, 2), dtype=np.int64)
    done = 0
    for piece in _cut((text or "").encode("utf-8", "surrogatepass")):
        words = piece.split()
        here = gone[(gone[:, 0] < done + len(words)) & (gone[:, 1] > done)] - done
        kept, at = [], 0
        for lo, hi in here:
            kept += words[at : max(lo, 0)]
            at = max(at, min(hi, len(words)))
        kept += words[at:]
        done += len(words)
        yield len(words), kept


def _texts(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, spans in zip(batch["text"], batch["spans"], strict=True):
                n = n_kept = 0
                kept = []
                for n_piece, words in _kept(text, spans, window):
                    n, n_kept = n + n_piece, n_kept + len(words)
                    if words:
                        kept.append(b" ".join(words))
                text = b" ".join(kept)
                out.append((n, n - n_kept, text.decode("utf-8", "surrogatepass")))
            yield pd.concat([batch[["doc_id"]].reset_index(drop=True), pd.DataFrame(out, columns=["n_words", "n_removed", "text"])], axis=1).astype({"doc_id": "Int64"})

    return run


def _digests(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, spans in zip(batch["text"], batch["spans"], strict=True):
                n = n_kept = 0
                digest = hashlib.sha256()
                for n_piece, words in _kept(text, spans, window):
                    if words:
                        digest.update((b" " if n_kept else b"") + b" ".join(words))
                    n, n_kept = n + n_piece, n_kept + len(words)
                out.append((n, n - n_kept, digest.hexdigest()))
            yield pd.concat([batch[["doc_id"]].reset_index(drop=True), pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256"])], axis=1).astype({"doc_id": "Int64"})

    return run


def _judged(documents: DataFrame, window: int) -> DataFrame:
    scratch = Scratch(documents.sparkSession, "substrings")
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = with_part(own, scratch)
    # a merge join at every size: the spans grow with the corpus
    return own.join(repeated_windows(own, scratch, window).hint("merge"), ["doc_id", "part"], "left").select("doc_id", "text", "spans")


def remove_repeats(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, n_words, n_removed, text: its words that stay, joined by one space.

    One row for each row. A null or empty text, or one without words, has no words and an empty text. A
    text of fewer than `window` words loses none. Of equal windows the earliest by (doc_id, word number)
    stays, within a document as well. Rows that repeat a doc_id and text are one document's copies and
    lose the same words; rows of one doc_id with other texts are documents of their own, ordered by a
    hash of the text. Rows without doc_id keep all words and take none from others. Very long texts are
    read whole, in pieces. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    return _judged(documents, window).mapInPandas(_texts(window), "doc_id long, n_words long, n_removed long, text string")


def repeat_digests(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """As `remove_repeats`, with kept_sha256, the digest of the words that stay, in place of the text."""
    return _judged(documents, window).mapInPandas(_digests(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")


ORACLE_SQL = """
WITH worded AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
begins AS (SELECT doc_id, unnest(range(0, len(w) - 19)) AS start, w FROM worded WHERE len(w) >= 20),
windows AS (SELECT doc_id, start, sha256(array_to_string(w[start + 1 : start + 20], ' ')) AS words FROM begins),
ranked AS (SELECT doc_id, start, row_number() OVER (PARTITION BY words ORDER BY doc_id, start) AS place FROM windows),
gone AS (SELECT DISTINCT doc_id, start + unnest(range(0, 20)) AS word FROM ranked WHERE place > 1),
each AS (SELECT doc_id, unnest(w) AS said, unnest(range(0, len(w))) AS word FROM worded),
kept AS (
  SELECT doc_id, count(*) AS n_kept, string_agg(said, ' ' ORDER BY word) AS text
  FROM each ANTI JOIN gone USING (doc_id, word) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM worded LEFT JOIN kept USING (doc_id)"""

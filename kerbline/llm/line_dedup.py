"""Removal of lines that repeat an earlier line, exactly or within a short run of words, across all documents.

A line is its words (runs of anything but ASCII white space, A-Z lower-cased). Lines with the same
words are equal. Lines of `min_words` words or more also match where one becomes the other by putting
at most `run` words in a row in place of at most `run` words in a row: with `run` = 1, the default,
one word inserted, deleted or replaced. A line goes where an earlier line, by (doc_id, line number),
matches; whether that earlier line itself stays makes no difference. Lines that differ in several
places, and passages inside longer lines, do not match.

Matches come from a deletion-neighbourhood join over the first occurrences of distinct lines. The
variants of each line would be as many keys as the corpus has words, so lines that can't match are put
aside first: of two matching lines, the longer of n words, either the first (n - run + 1) div 2 words
are equal or the last. A line has keys for that, for every length that the longer line may have. Only
lines that share such a key with another line emit their variants:
* two lines with equal text before and after the words left out match by a replaced run;
* a line without a run of words that equals another line matches by an inserted or deleted run.
Each key thus needs just its earliest line: grouping, and no pairs within a group. Matches are then
verified on the words of the two lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import Scratch, Sequences, chunks, mix64, with_part, word_spans

MIN_WORDS = 10
RUN = 1
_REPLACED, _DELETED = np.uint64(0x3C6EF372FE94F82B), np.uint64(0x510E527FADE682D1)
_NEWLINE = 10


def _sequences(lines: list[str]) -> tuple[Sequences, np.ndarray, np.ndarray]:
    """Texts -> the lines with words as sequences, the text of each line and its number in that text."""
    data = [t.encode("utf-8", "surrogatepass") for t in lines]
    joined = np.frombuffer(b"\n".join(data), dtype=np.uint8)
    words, start, _ = word_spans(joined)
    breaks = np.flatnonzero(joined == _NEWLINE)
    line = np.searchsorted(breaks, start)
    used, first = np.unique(line, return_index=True)
    end = np.append(first[1:], len(words)) if len(first) else first
    begins = np.cumsum([0] + [len(d) + 1 for d in data[:-1]])
    first_line = np.searchsorted(breaks, begins)
    text = np.searchsorted(first_line, used, side="right") - 1
    return Sequences(words, first.astype(np.int64), end.astype(np.int64)), text, used - first_line[text]


def _line_rows(min_words: int, run: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (part for whole in batches for part in chunks(whole, "text")):
            seq, text, number = _sequences([t or "" for t in batch["text"]])
            n = seq.n.astype(np.uint64)
            whole = seq.run(seq.start, seq.end)
            other = Sequences(mix64(seq.words ^ _REPLACED), seq.start, seq.end)
            ends, before = {}, None
            for k in range(run + 1):
                length = (seq.n + k - run + 1) // 2
                none = (seq.n < min_words) | (length < 1 if before is None else (length == before) | (length < 1))
                held = np.minimum(np.maximum(length, 0), seq.n)
                tag = length.astype(np.uint64) * np.uint64(2)
                for name, at in (("first", seq.start), ("last", seq.end - held)):
                    key = mix64(mix64(seq.run(at, at + held)) + tag + np.uint64(name == "last"))
                    ends[f"{name}{k}"] = pd.arrays.IntegerArray(key.view(np.int64), none)
                before = length
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].to_numpy()[text], "part": batch["part"].to_numpy()[text],
                "line": number.astype(np.int32), "n_words": seq.n.astype(np.int32),
                "a": mix64(whole + n).view(np.int64), "b": mix64(other.run(seq.start, seq.end) + n).view(np.int64), **ends,
            })

    return rows


def _word_rows(run: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (part for whole in batches for part in chunks(whole, "words")):
            seq, row, _ = _sequences([t or "" for t in batch["words"]])
            whole = np.repeat(np.arange(len(seq.n)), seq.n)
            every = np.arange(len(seq.words))
            keys, of, kind = [], [], []
            for width in range(1, run + 1):
                fits = every + width <= seq.end[whole]
                each, at = whole[fits], every[fits]
                start, end, n = seq.start[each], seq.end[each], seq.n[each]
                place, after_n = (at - start).astype(np.uint64), (end - at - width).astype(np.uint64)
                before, after = seq.run(start, at), seq.run(at + width, end)
                keys.append(mix64((mix64(before + place) + mix64(after + after_n) * np.uint64(3)) ^ _REPLACED))
                keys.append(mix64((before + after * seq.up[at - start] + (n - width).astype(np.uint64)) ^ _DELETED))
                of += [row[each], row[each]]
                kind += [np.zeros(len(each), np.int32), np.ones(len(each), np.int32)]
            keys.append(mix64((seq.run(seq.start, seq.end) + seq.n.astype(np.uint64)) ^ _DELETED))
            of, kind = np.concatenate([*of, row]), np.concatenate([*kind, np.full(len(row), 2, np.int32)])
            out = {c: batch[c].to_numpy()[of] for c in ("doc_id", "part", "line")}
            yield pd.DataFrame({**out, "key": np.concatenate(keys).view(np.int64), "kind": kind})

    return rows


def one_run_apart(x: list[str], y: list[str], run: int = RUN) -> bool:
    """True where at most `run` words in a row in place of at most `run` words in a row turn x into y."""
    least = min(len(x), len(y))
    first = 0
    while first < least and x[first] == y[first]:
        first += 1
    last = 0
    while last < least - first and x[-1 - last] == y[-1 - last]:
        last += 1
    return max(len(x), len(y)) - first - last <= run


def _words(line: str) -> list[str]:
    ascii_lower = {k: k + 32 for k in range(65, 91)}
    return [w for w in line.translate(ascii_lower).replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]


def _verified(run: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = [one_run_apart(_words(x), _words(y), run) for x, y in zip(batch["words"], batch["other_words"], strict=True)]
            yield batch.loc[np.array(good, dtype=bool), ["doc_id", "part", "line"]]

    return rows


_BLANK = r"^[ \t\r\x0B\x0C]*$"


def repeated_lines(texts: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS, run: int = RUN) -> DataFrame:
    """(doc_id, part, text) -> doc_id, part, dropped: numbers of the lines to go, for texts that have any."""
    known = texts.where("doc_id IS NOT NULL")
    ends = [f"{name}{k}" for k in range(run + 1) for name in ("first", "last")]
    schema = "doc_id long, part long, line int, n_words int, a long, b long, " + ", ".join(f"{e} long" for e in ends)
    lines = scratch.save(known.mapInPandas(_line_rows(min_words, run), schema), "lines")

    of_line, of_text = ["n_words", "a", "b"], ["doc_id", "part"]
    at = F.struct(*of_text, "line")
    first = scratch.save(lines.groupBy(*of_line).agg(F.min(at).alias("first"), *[F.first(e).alias(e) for e in ends], F.count(F.lit(1)).alias("n")), "first")
    repeats = first.where("n > 1").select(*of_line, "first")
    repeated = lines.drop(*ends).join(repeats, of_line).where(at > F.col("first")).select(*of_text, "line")

    end = first.where(F.col("n_words") >= min_words).select("first", F.explode(F.array_compact(F.array(*ends))).alias("key"))
    shared = end.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    near = end.join(shared, "key", "left_semi").select("first.*").distinct()
    wanted = near.groupBy(*of_text).agg(F.collect_set("line").alias("wanted"))  # at most a text's own lines
    # a merge join at every size: what is wanted grows with the corpus
    one_text = known.join(wanted.hint("merge"), of_text).groupBy(*of_text).agg(F.min("text").alias("text"), F.first("wanted").alias("wanted"))
    split = one_text.select(*of_text, "wanted", F.split("text", "\n", -1).alias("parts"))
    near_lines = split.select(*of_text, F.explode_outer(F.transform("wanted", lambda k: F.struct(k.alias("line"), F.get("parts", k).alias("words")))).alias("l"))
    near_lines = scratch.save(near_lines.select(*of_text, "l.line", "l.words"), "near")
    keys = scratch.save(near_lines.mapInPandas(_word_rows(run), "doc_id long, part long, line int, key long, kind int").select("key", "kind", at.alias("at")), "keys")
    earliest = keys.groupBy("key").agg(
        F.min(F.when(F.col("kind") == 0, F.col("at"))).alias("same_gap"),
        F.min(F.when(F.col("kind") == 1, F.col("at"))).alias("longer"),
        F.min(F.when(F.col("kind") == 2, F.col("at"))).alias("shorter"),
        F.count(F.lit(1)).alias("n"),
    )
    earlier = F.expr("CASE kind WHEN 0 THEN same_gap WHEN 1 THEN shorter ELSE longer END")
    pairs = keys.join(earliest.where("n > 1"), "key").withColumn("other", earlier).where("other < at")
    pairs = pairs.select("at.*", *[F.col(f"other.{c}").alias(f"other_{c}") for c in (*of_text, "line")]).distinct()
    other_lines = near_lines.select(*[F.col(c).alias(f"other_{c}") for c in near_lines.columns])
    held = pairs.join(near_lines, [*of_text, "line"]).join(other_lines, ["other_doc_id", "other_part", "other_line"])
    close = held.mapInPandas(_verified(run), "doc_id long, part long, line int")
    dropped = repeated.unionByName(close).groupBy(*of_text).agg(F.array_sort(F.collect_set("line")).alias("dropped"))
    dropped = scratch.save(dropped, "dropped")
    scratch.drop(lines, first, near_lines, keys)
    return dropped


def _judged(documents: DataFrame, min_words: int, run: int) -> DataFrame:
    """row (all columns as they were), doc_id, old_text, text (without its dropped lines), n_lines, dropped."""
    scratch = Scratch(documents.sparkSession, "lines")
    own = documents.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = with_part(own, scratch)
    dropped = repeated_lines(own.select("doc_id", "part", "text"), scratch, min_words, run)
    lines = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(lines, lambda _, k: ~F.array_contains("dropped", k)), "\n")
    n_lines = F.coalesce(F.size(F.filter(lines, lambda x: ~x.rlike(_BLANK))), F.lit(0)).cast("long")
    joined = own.join(dropped.hint("merge"), ["doc_id", "part"], "left")
    return joined.select(
        "row", "doc_id", F.col("text").alias("old_text"), F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(n_lines).alias("n_lines"), "dropped",
    )


def dedup_lines(documents: DataFrame, min_words: int = MIN_WORDS, run: int = RUN) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, text without repeated lines, n_lines, n_dropped, dropped.

    Lines end at \\n; n_lines counts those with a word. Blank lines and null or empty texts stay as
    they are. `dropped` holds the numbers, from 0, of the lines that went, in order; null where none
    did. Of equal lines the earliest by (doc_id, line number) stays, within a document as well. Rows
    that repeat a doc_id and text are one document's copies: they lose the same lines. Rows of one
    doc_id with different texts are documents of their own, ordered by a hash of the text. A null
    doc_id sorts before all others and its rows keep their lines. Very long texts are read whole, in
    pieces. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    n_dropped = F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).cast("long")
    return _judged(documents, min_words, run).select("doc_id", "text", "n_lines", n_dropped.alias("n_dropped"), "dropped")


def keep_first_lines(documents: DataFrame, min_words: int = MIN_WORDS, run: int = RUN) -> DataFrame:
    """Documents with their repeated lines removed; those that lose every line they had go.

    All columns stay as they are but text, and n_chars where it is there. A document that had no
    line with a word to begin with stays.
    """
    out = _judged(documents, min_words, run).where("dropped IS NULL OR size(dropped) < n_lines")
    changed = {"text": F.col("text")}
    if "n_chars" in documents.columns:
        n_chars = F.length("text").cast(documents.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col("dropped").isNull(), F.col("row.n_chars")).otherwise(n_chars)
    return out.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in documents.columns])

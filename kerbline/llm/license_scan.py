"""License scan: fixed phrases, and an exact set-similarity join of text blocks with license templates.
DataFrame operations only.

A block is a sentence, over line breaks: it ends at a full stop, question or exclamation mark before
white space, and at a blank line or one without a letter or digit. A sentence of more than twice the
longest template's words is cut into overlapping windows of that length, one at every half of the
longest template, so each run of one and a half times its length stands whole in a block. A template is
a sentence of a license or notice. A block matches where it holds at least a share CONTAINMENT of the
template's different words; templates of fewer than SHORT words must also stand there word for word.

Words are ordered by how many texts hold them, rarest first. With `need` = ceil(CONTAINMENT * size):
* length: a block with fewer than `need` template words can't match;
* prefix: a block that matches holds one of the template's first size - need + 1 words among its own
  first n - need + 1;
* position: at the word that they share, enough words must follow in both to reach `need`.
Pairs that are left are counted exactly. Texts are split into words once: what counts, the template
words a text has and, of texts that could hold a template, the text itself go to a scratch table, and
only such texts are cut into blocks.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import Scratch, broadcast_if_small

CONTAINMENT = 0.8
SHORT = 6
#: Phrases whose places are counted, with their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Sentences of public licenses and notices, with their labels.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("gpl", "gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("lgpl", "lesser general public license"),
    ("mpl", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("cc-by", "creative commons attribution license"),
    ("cc-by", "creative commons attribution 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-nc", "cc by nc"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc-by-sa", "cc by sa"),
    ("cc0", "creative commons zero"),
    ("all-rights-reserved", "all rights reserved"),
)
_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: For text in lower case, in which A-Z don't occur. Spark's form gives nothing back: Java would follow each
#: blank line by a call of its own, and many of them end its stack. Nothing comes after, so both find the same.
_SENTENCE_END = r"[.!?][ \t\n\x0B\f\r]+|\n(?:[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]*\n)+"
_SPARK_SENTENCE_END = r"[.!?][ \t\n\x0B\f\r]++|\n(?:[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]*+\n)++"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LONGEST = max(len(text.split()) for _, text in TEMPLATES)
_WINDOW, _STEP = 2 * _LONGEST, _LONGEST // 2


def template_table(templates: tuple[tuple[str, str], ...] = TEMPLATES, containment: float = CONTAINMENT) -> list[tuple[int, str, list[str], int, str | None]]:
    """(number, label, distinct words, need, text of a short template) of each template."""
    out = []
    for k, (label, text) in enumerate(templates):
        words = sorted(set(text.split()))
        out.append((k, label, words, math.ceil(round(containment * len(words), 9)), text if len(text.split()) < SHORT else None))
    return out


def _lower(text: Column) -> Column:
    """A-Z only: other letters, such as the Kelvin sign, stay as they are."""
    return F.translate(text, _UPPER, _LOWER)


def _array(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _SEPARATOR), lambda w: w != "")


def _known() -> list[str]:
    return sorted({w for _, _, words, *_ in template_table() for w in words} | {w for p in PHRASES for w in p.split()})


def _stands(words: list[str]):
    """Whether these words stand in w from a place on."""
    return lambda i: reduce(Column.__and__, [F.get("w", i + k) == word for k, word in enumerate(words)])


def _read(texts: DataFrame) -> DataFrame:
    """(doc_id, text, k1, k2) -> the same with what is counted, have (its template words), and text only
    where a template could stand in it."""
    lower = _lower(F.coalesce("text", F.lit("")))
    # explode keeps Spark from splitting the text again for each use of its words
    worded = texts.select("doc_id", "text", "k1", "k2", F.explode(F.array(_words(lower))).alias("w"))
    seen = worded.withColumn("have", F.array_intersect("w", _array(_known())))
    labels, places = [], []
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        could = (F.size("w") >= len(parts)) & (F.size(F.array_intersect("have", _array(parts))) == len(parts))
        places.append(F.when(could, F.filter(F.sequence(F.lit(0), F.size("w") - len(parts)), _stands(parts))).otherwise(F.array().cast("array<int>")))
        labels.append((label, F.size(f"p{len(labels)}") > 0))
    seen = seen.withColumns({f"p{k}": p for k, p in enumerate(places)})
    every = F.concat(*[F.col(f"p{k}") for k in range(len(places))])
    could = reduce(Column.__or__, [F.size(F.array_intersect("have", _array(words))) >= need for _, _, words, need, _ in template_table()])
    least = min(need for _, _, _, need, _ in template_table())
    return seen.select(
        "doc_id", "k1", "k2", "have", F.size("w").cast("long").alias("n_words"), F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.array_compact(F.array(*[F.when(there, F.lit(label)) for label, there in labels])).alias("base_labels"),
        F.when((F.size("have") >= least) & could, F.col("text")).alias("text"),
    )


def matching_blocks(read: DataFrame) -> DataFrame:
    """Rows of `_read` -> k1, k2, template, label, containment for every match of a block."""
    rows = template_table()
    # one number for each word that a template has
    often = {r["word"]: r["n"] for r in read.select(F.explode("have").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = {w: k for k, w in enumerate(sorted(_known(), key=lambda w: (often.get(w, 0), w)))}
    prefixes = []
    for number, label, words, need, short in rows:
        ranked = sorted(words, key=order.__getitem__)
        prefixes += [(number, label, len(ranked), need, w, at, ranked, short and f" {short} ") for at, w in enumerate(ranked[: len(ranked) - need + 1])]
    prefix = F.broadcast(read.sparkSession.createDataFrame(prefixes, "template int, label string, size int, need int, word string, place int, of_template array<string>, phrase string"))

    texts = read.where("text IS NOT NULL").dropDuplicates(["k1", "k2"])
    parts = texts.select("k1", "k2", F.explode(F.split(_lower(F.col("text")), _SPARK_SENTENCE_END)).alias("part"))
    worded = parts.select("k1", "k2", F.explode(F.array(_words(F.col("part")))).alias("all"))
    begins = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("all") - _WINDOW + _STEP - 1), F.lit(_STEP))
    blocks = worded.select("k1", "k2", F.explode(F.transform(begins, lambda at: F.slice("all", at + 1, F.lit(_WINDOW)))).alias("block"))
    # in the order of the words, rarest first
    least = min(need for _, _, _, need, _ in rows)
    near = blocks.withColumn("have", F.array_intersect(_array(sorted(order, key=order.__getitem__)), "block")).where(F.size("have") >= least)
    asked = near.select("k1", "k2", "block", "have", F.size("have").alias("n"), F.posexplode("have").alias("at", "word")).join(prefix, "word")
    asked = asked.where("n >= need AND at <= n - need AND 1 + least(n - at - 1, size - place - 1) >= need")
    shared = F.size(F.array_intersect("have", "of_template"))
    whole = F.col("phrase").isNull() | F.concat(F.lit(" "), F.array_join("block", " "), F.lit(" ")).contains(F.col("phrase"))
    found = asked.where((shared >= F.col("need")) & whole).select("k1", "k2", "template", "label", (shared / F.col("size")).alias("containment"))
    return found.distinct()


def scan_licenses(documents: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    One row for each row. n_base counts the places of all phrases; first_word and last_word are the
    word numbers where the first and the last begin, null without any. labels has the labels of the
    matching templates too. score is 1 where a phrase stands, else the highest containment of a
    template in a matching block, 0 without any. A null or empty text has no words; very long texts are
    read whole. Rows of equal doc_id and text are alike, rows of one doc_id with other texts are judged
    each on its own text; a null doc_id stays. Other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(documents.sparkSession, "licenses")
    text = F.col("text").cast("string")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))
    read = scratch.save(_read(texts), "read")
    # equal texts have equal blocks: labels are joined by the text's hashes
    labels = matching_blocks(read).groupBy("k1", "k2").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))  # a few labels
    labels = scratch.save(labels, "labels")
    out = read.drop("text", "have").join(broadcast_if_small(labels), ["k1", "k2"], "left")
    joined = F.array_sort(F.array_distinct(F.concat("base_labels", F.coalesce("more", F.array().cast("array<string>")))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base_labels"), ",").alias("base_labels"), F.array_join(joined, ",").alias("labels"), score.alias("score"),
    )


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def oracle_sql() -> str:
    """The same result in DuckDB's SQL, by comparing all blocks with all templates."""
    separator = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    place = " OR ".join("(" + " AND ".join(f"w[i + {k + 1}] = '{word}'" for k, word in enumerate(p.split())) + ")" for p in PHRASES)
    base = ", ".join(f"CASE WHEN contains(padded, ' {p} ') THEN '{label}' END" for p, label in PHRASES.items())
    values = ", ".join(f"({k}, '{label}', {_sql_list(words)}, {need}, {f"' {short} '" if short else 'NULL'})" for k, label, words, need, short in template_table())
    return f"""
WITH texts AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
worded AS (SELECT doc_id, t, regexp_extract_all(t, '{separator}') AS w FROM texts),
placed AS (
  SELECT doc_id, t, len(w) AS n_words, ' ' || array_to_string(w, ' ') || ' ' AS padded,
         list_filter(range(0, len(w)), lambda i: {place}) AS places FROM worded),
templates(template, label, words, need, phrase) AS (VALUES {values}),
parts AS (SELECT DISTINCT t, unnest(string_split_regex(t, '{_SENTENCE_END}')) AS part FROM texts),
sentences AS (SELECT t, regexp_extract_all(part, '{separator}') AS w FROM parts),
begins AS (SELECT t, w, unnest(range(0, greatest(0, len(w) - {_WINDOW} + {_STEP} - 1) + 1, {_STEP})) AS b FROM sentences),
blocks AS (SELECT t, w[b + 1 : b + {_WINDOW}] AS block FROM begins),
sets AS (SELECT t, list_distinct(block) AS have, ' ' || array_to_string(block, ' ') || ' ' AS joined FROM blocks),
found AS (
  SELECT t, label, len(list_intersect(have, words)) / len(words) AS c FROM sets, templates
  WHERE len(list_intersect(have, words)) >= need AND (phrase IS NULL OR contains(joined, phrase))),
more AS (SELECT t, list(DISTINCT label) AS more, max(c) AS best FROM found GROUP BY t)
SELECT doc_id, n_words::BIGINT AS n_words, len(places)::BIGINT AS n_base,
       list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word,
       array_to_string(list_sort(list_filter([{base}], lambda x: x IS NOT NULL)), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(list_filter([{base}], lambda x: x IS NOT NULL), coalesce(more, [])))), ',') AS labels,
       CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM placed LEFT JOIN more USING (t)"""

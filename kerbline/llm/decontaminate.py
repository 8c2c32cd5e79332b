"""Benchmark passages in documents: SimHash of item-sized windows, a multi-index Hamming join, and an
exact weighted-shingle similarity. DataFrame operations only.

Words are runs of letters, digits and non-ASCII characters in lower case; shingles are SHINGLE words
in a row (a text with fewer words is one shingle). A shingle's weight is how often it occurs.
Similarity is the sum of the lesser weights over the sum of the greater ones.

1. A window has the size of an item and starts at any word of a document; a document shorter than the
   item is one window. Of m shingles in a window and n in an item, similarity p takes at least
   p * (m + n) / (1 + p) shingles of the window that the item has too. A running count over the places
   where a document has shingles of items of that size leaves out the windows below that bound, and
   only those: nothing is assumed about the order of what is shared. Items with fewer words than a
   shingle are one shingle of their own length, looked for among the documents' runs of that length.
2. Each window and item gets a 64-bit SimHash of its weighted shingles, cut into BLOCKS blocks. Two
   fingerprints within distance BLOCKS * (ERRORS + 1) - 1 have a block with at most ERRORS differing
   bits. Items enumerate all values within ITEM_ERRORS of each block, windows all within
   WINDOW_ERRORS, so every pair within the distance meets. At similarity 0.8 a bit differs with
   probability 0.15 or less; all blocks have more than 4 differing bits with probability 4e-5 at most.
3. Pairs that meet are verified exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import Scratch, broadcast_if_small

SHINGLE = 5
BLOCKS, BLOCK_BITS = 4, 16
ITEM_ERRORS, WINDOW_ERRORS = 3, 1
_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), _SEPARATOR), "")


def _shingles(size: int) -> Column:
    """Hash of each run of `size` words, in order; none for fewer words. Needs a column words."""
    each = lambda i: F.xxhash64(F.lit(size), *[F.get("words", i + k) for k in range(size)])
    none = F.array().cast("array<bigint>")
    return F.when(F.size("words") >= size, F.transform(F.sequence(F.lit(0), F.size("words") - size), each)).otherwise(none)


def _simhash(shingles: Column) -> Column:
    one = F.lit(1).cast("long")
    ones = lambda b: F.aggregate(shingles, F.lit(0), lambda n, h: n + F.getbit(h, b))
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(2 * ones(b) > F.size(shingles), F.call_function("shiftleft", one, b)))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(F.coalesce(y, F.lit(0).cast("long"))))


def _near_values(fingerprint: Column, errors: int) -> Column:
    """(block, value) as one integer, for all values that differ in at most `errors` bits from a block."""
    masks = F.array(*[F.lit(m).cast("long") for m in range(1 << BLOCK_BITS) if m.bit_count() <= errors])
    low = F.lit((1 << BLOCK_BITS) - 1).cast("long")

    def of_block(b: int) -> Column:
        value = F.shiftrightunsigned(fingerprint, BLOCK_BITS * b).bitwiseAND(low)
        return F.transform(masks, lambda m: value.bitwiseXOR(m) + F.lit(b << BLOCK_BITS))

    return F.concat(*[of_block(b) for b in range(BLOCKS)])


def _full_windows(docs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """doc_id, text_key, size, start of the windows that could reach the similarity with an item of SHINGLE words or more."""
    of_items = items.where(F.col("n_words") >= SHINGLE).select(F.col("n_words").alias("size"), F.explode("shingles").alias("h")).distinct()
    # posexplode_outer: for a plain one Spark infers a filter on the array, which it would compute twice
    places = docs.select("doc_id", "text_key", F.size("words").alias("n_words"), F.posexplode_outer(_shingles(SHINGLE)).alias("p", "h"))
    hits = places.join(broadcast_if_small(of_items), "h").groupBy("doc_id", "text_key", "n_words", "size").agg(F.array_sort(F.collect_set("p")).alias("places"))  # a text's own places
    width = F.col("size") - (SHINGLE - 1)
    held = F.least(width, F.col("n_words") - (SHINGLE - 1))
    need = F.ceil(F.lit(percent) * (width + held) / F.lit(100 + percent)).cast("int")
    hits = hits.withColumns({"held": held, "need": need, "last": F.col("n_words") - (SHINGLE - 1) - held})
    hits = hits.where(F.size("places") >= F.col("need"))

    def starts(i: Column) -> Column:
        first, end = F.get("places", i), F.get("places", i + F.col("need") - 1)
        return F.when(end - first < F.col("held"), F.sequence(F.greatest(F.lit(0), end - F.col("held") + 1), F.least(first, F.col("last"))))

    runs = F.array_compact(F.transform(F.sequence(F.lit(0), F.size("places") - F.col("need")), starts))
    return hits.select("doc_id", "text_key", "size", F.explode(F.array_distinct(F.flatten(runs))).alias("start"))


def _short_windows(docs: DataFrame, items: DataFrame) -> DataFrame | None:
    """doc_id, text_key, size, start, shingles of the runs that equal an item with fewer words than a shingle."""
    short = items.where(F.col("n_words") < SHINGLE).select(F.col("n_words").alias("size"), F.explode("shingles").alias("h")).distinct()
    found = None
    for size in sorted(r["size"] for r in short.select("size").distinct().collect()):  # fewer than SHINGLE rows
        runs = docs.select("doc_id", "text_key", F.posexplode_outer(_shingles(size)).alias("start", "h"))
        same = runs.join(broadcast_if_small(short.where(F.col("size") == size)), "h")
        same = same.select("doc_id", "text_key", "size", "start", F.array("h").alias("shingles"))
        found = same if found is None else found.unionByName(same)
    return found


def leaks(documents: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """Documents (doc_id, text, ...) that hold an item of benchmark (item_id, text, ...).

    One row per document and item: doc_id, item_id, first_word and n_words of the most similar window
    (the first of equal ones), common and total (the sums of lesser and greater weights), where
    100 * common >= percent * total. Null or empty texts and items hold nothing. Rows without doc_id
    or item_id are not compared. Rows that share a doc_id are one document of several texts, no window
    of which goes across two; items of equal text match alike. Very long texts are compared whole.
    Other columns are ignored; empty tables give no rows.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "decontaminate")
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), words_of(F.col("text")).alias("words"))
    of_size = F.coalesce(*[F.when(F.size("words") == n, _shingles(n)) for n in range(1, SHINGLE)], _shingles(SHINGLE))
    items = items.select("item_id", F.size("words").alias("n_words"), of_size.alias("shingles")).where("n_words > 0")
    items = scratch.save(items.withColumn("fingerprint", _simhash(F.col("shingles"))), "items")
    text = F.col("text").cast("string")
    docs = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), words_of(text).alias("words"))

    windows = scratch.save(_full_windows(docs, items, percent), "windows")
    touched = broadcast_if_small(windows.select("doc_id", "text_key").distinct())
    known = docs.join(touched, ["doc_id", "text_key"], "left_semi").select("doc_id", "text_key", _shingles(SHINGLE).alias("all"))
    known = scratch.save(known.dropDuplicates(["doc_id", "text_key"]), "touched")
    cut = F.slice("all", F.col("start") + 1, F.col("size") - (SHINGLE - 1))
    prints = windows.join(known, ["doc_id", "text_key"]).select("doc_id", "text_key", "size", "start", cut.alias("shingles"))
    short = _short_windows(docs, items)
    prints = prints if short is None else prints.unionByName(short)
    prints = prints.select("doc_id", "start", "size", "shingles", F.xxhash64("shingles").alias("c1"), F.xxhash64(F.lit(1), "shingles").alias("c2"))
    prints = scratch.save(prints, "prints")
    # windows of equal content are compared once, however often a passage occurs
    content = ["size", "c1", "c2"]
    contents = prints.groupBy(*content).agg(F.first("shingles").alias("shingles")).where("size(shingles) > 0")
    contents = scratch.save(scratch.save(contents, "contents").withColumn("fingerprint", _simhash(F.col("shingles"))), "fingerprints")

    fingerprint = F.col("fingerprint")
    by_item = items.select("item_id", F.col("n_words").alias("size"), F.explode_outer(_near_values(fingerprint, ITEM_ERRORS)).alias("key"))
    by_window = contents.select(*content, F.explode_outer(_near_values(fingerprint, WINDOW_ERRORS)).alias("key"))
    pair = [*content, "item_id"]
    met = scratch.save(by_window.join(by_item, ["size", "key"]).select(*pair).distinct(), "candidates")

    mine = met.join(contents.select(*content, F.explode("shingles").alias("h")), content).select(*pair, "h", F.lit(1).alias("x"), F.lit(0).alias("y"))
    theirs = met.join(items.select("item_id", F.explode("shingles").alias("h")), "item_id").select(*pair, "h", F.lit(0).alias("x"), F.lit(1).alias("y"))
    weights = mine.unionByName(theirs).groupBy(*pair, "h").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    scored = weights.groupBy(*pair).agg(F.sum(F.least("x", "y")).alias("common"), F.sum(F.greatest("x", "y")).alias("total"))
    scored = scratch.save(scored.where(F.expr(f"100 * common >= {percent} * total")), "scored")
    found = prints.drop("shingles").join(broadcast_if_small(scored), content)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("common") / F.col("total")).alias("r"), (-F.col("start")).alias("s"), "size", "common", "total")).alias("w"))
    best = scratch.save(best.select("doc_id", "item_id", (-F.col("w.s")).cast("long").alias("first_word"), F.col("w.size").cast("long").alias("n_words"), "w.common", "w.total"), "leaks")
    scratch.drop(items, windows, known, prints, contents, met, scored)
    return best


def without_leaks(documents: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """Documents that hold no item, all columns as they are. Rows without doc_id stay."""
    found = leaks(documents, benchmark, percent).select(F.col("doc_id").alias("leaked")).distinct()
    own = documents.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    return own.join(found, F.col("id") == F.col("leaked"), "left_anti").select("row.*")

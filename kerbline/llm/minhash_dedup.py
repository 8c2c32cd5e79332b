"""Near-duplicate documents by a multi-index Hamming join over b-bit MinHash signatures.

A document is its set of distinct five-word shingles. Two documents link where their sets' Jaccard
similarity reaches the threshold; links are confirmed on the full sets. Equal sets are one class.

The signature has CHUNKS * WIDTH symbols of b = 16 bits. Two signatures within distance
CHUNKS * (ERRORS + 1) - 1 (symbols that differ) have, by pigeonhole, a chunk with at most ERRORS
differing symbols. All placements of the allowed errors in a chunk are enumerated by leaving those
symbols out, and what is left is a join key: every pair within the distance shares a key. At
similarity 0.85 a symbol differs with probability 0.15, so all chunks fail with probability
0.224 ** 9 = 1.4e-6; that is the chance to miss a link at the threshold, less above it.

A bucket of documents with one key is never expanded into all pairs. First each member is verified
against the bucket's smallest document, then against the member with most confirmed links; what
these leave in one component needs no further comparison. Members of buckets that still hold
different components meet by a prefix filter over their shingles, rarest first, and those pairs whose
overlap can still suffice are verified, so no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import Scratch, broadcast_if_small, connected_components, mix64, shingle_hashes, with_part, word_hashes

CHUNKS, WIDTH, ERRORS = 9, 6, 1
SYMBOLS = CHUNKS * WIDTH
SHINGLE_WORDS = 5
#: Documents with one shingle in their prefixes that a task compares with the others.
SALT_ROWS = 256

_RNG = np.random.default_rng(77)
_MULTIPLY = _RNG.integers(0, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**64, SYMBOLS, dtype=np.uint64)
_KEPT = np.array([[c * WIDTH + i for i in kept] for c in range(CHUNKS) for kept in combinations(range(WIDTH), WIDTH - ERRORS)])
_KEY_STEP = _RNG.integers(0, 2**63, WIDTH - ERRORS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLOCK = 4096
_FEATURES = "doc_id long, part long, n_shingles long, set_a long, set_b long, keys array<long>"


def _signature(shingles: np.ndarray) -> np.ndarray:
    low = np.full(SYMBOLS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), _BLOCK):
        block = shingles[at : at + _BLOCK]
        low = np.minimum(low, (block[None, :] * _MULTIPLY[:, None] + _ADD[:, None]).min(axis=1))
    return mix64(low) & np.uint64(0xFFFF)


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc_id, part, text in zip(batch["doc_id"], batch["part"], batch["text"], strict=True):
            shingles = np.unique(shingle_hashes(word_hashes(text), SHINGLE_WORDS))
            if not len(shingles):
                rows.append((doc_id, part, 0, 0, 0, None))
                continue
            symbols = _signature(shingles)
            keys = mix64((symbols[_KEPT] * _KEY_STEP).sum(axis=1, dtype=np.uint64) + np.arange(len(_KEPT), dtype=np.uint64) * np.uint64(_STRIDE))
            whole = mix64(shingles)
            rows.append((doc_id, part, len(shingles), int(whole.sum(dtype=np.uint64).view(np.int64)), int(mix64(whole ^ np.uint64(_STRIDE)).sum(dtype=np.uint64).view(np.int64)), keys.view(np.int64)))
        yield pd.DataFrame(rows, columns=["doc_id", "part", "n_shingles", "set_a", "set_b", "keys"]).astype({"doc_id": "Int64"})


_STRIDE = 0xA24BAED4963EE407


def _verify(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, own = None, None
        for batch in batches:
            links = []
            for a, b, text_a, text_b in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"], strict=True):
                if a != held:
                    held, own = a, np.unique(shingle_hashes(word_hashes(text_a), SHINGLE_WORDS))
                other = np.unique(shingle_hashes(word_hashes(text_b), SHINGLE_WORDS))
                both = len(np.intersect1d(own, other, assume_unique=True))
                links.append(100 * both >= percent * (len(own) + len(other) - both))
            yield batch.loc[np.array(links, dtype=bool), ["a", "b"]]

    return run


def _shingle_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets = [np.unique(shingle_hashes(word_hashes(text), SHINGLE_WORDS)).view(np.int64) for text in batch["text"]]
        yield pd.DataFrame({"id": batch["id"], "shingles": sets})


def _could_link(rows: DataFrame, members: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """rows: (id, component, n) of open buckets -> pairs (a, b) of different components that may link.

    Shingles are ordered by how rare they are among these documents. Linked sets share one of their
    first n - ceil(percent / 100 * n) + 1 shingles, and at the first that they share, enough follow in
    both for the overlap that a link takes. Copies of one text that differ too much to link have
    rare shingles of their own in front, so they don't meet.
    """
    docs = rows.groupBy("id").agg(F.first("component").alias("component"))
    sets = members.join(docs.select("id"), "id", "left_semi").mapInPandas(_shingle_rows, "id long, shingles array<long>")
    sets = scratch.save(sets, "sets").select("id", F.explode("shingles").alias("shingle"))
    shared = sets.groupBy("shingle").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    # shingles of one document alone stand before all others, in any order: a count of them will do
    common = sets.join(shared, "shingle").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("often", "shingle"))).alias("common"))  # a document's own
    sizes = rows.groupBy("id").agg(F.first("n").alias("n"), F.first("component").alias("component"))
    first = common.join(sizes, "id").withColumn("alone", F.col("n") - F.size("common"))
    length = F.expr(f"n - ceil({percent} * n / 100) + 1 - alone").cast("int")
    prefix = first.where(length > 0).select("id", "n", "component", "alone", F.posexplode(F.slice("common", 1, F.greatest(F.lit(1), length))).alias("at", "token"))
    prefix = prefix.select("id", "n", "component", (F.col("n") - F.col("alone") - F.col("at")).alias("left"), F.col("token.shingle").alias("shingle"))
    counts = prefix.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("size"))
    of_shingle = counts.groupBy("shingle").agg(
        F.max_by("component", F.struct("size", "component")).alias("largest"), F.count(F.lit(1)).alias("components"),
        F.ceil(F.sum("size") / SALT_ROWS).cast("int").alias("salts"),
    )
    of_shingle = broadcast_if_small(scratch.save(of_shingle.where("components > 1").drop("components"), "shingles"))
    prefix = scratch.save(prefix.join(of_shingle, "shingle"), "prefixes")
    # the left rows of a frequent shingle are dealt over its salts, the right ones are there for each
    dealt = prefix.where("component <> largest").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    copied = prefix.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    enough = f"{100 + percent} * least(x.left, y.left) >= {percent} * (x.n + y.n)"
    return (
        dealt.alias("x")
        .join(copied.alias("y"), F.expr(f"x.shingle = y.shingle AND x.salt = y.salt AND x.component <> y.component AND (y.component = y.largest OR x.id < y.id) AND {enough}"))
        .select(F.expr("least(x.id, y.id)").alias("a"), F.expr("greatest(x.id, y.id)").alias("b")).distinct()
    )


def near_duplicates(documents: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, text, ...) -> one row per document: doc_id, n_shingles, component_id, kept.

    Links hold where 100 * intersection >= percent * union of the distinct shingle sets; component_id
    is the smallest doc_id reachable over links. `percent` below 80 weakens the guarantee above.
    Null, empty or blank text: no shingles, linked with nothing. Fewer than five words: the whole
    sequence is one shingle. Rows of equal text are one class however many they are. A repeated
    doc_id gives a row for each of its rows, each judged by its own text where they differ; a null
    doc_id links with nothing and keeps its row. Very long texts are hashed in pieces, whole. Columns
    other than doc_id and text are ignored; an empty table gives no rows.
    """
    scratch = Scratch(documents.sparkSession, "minhash")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _judged(texts, percent, scratch).select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def _judged(texts: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(doc_id, text) -> doc_id, part, n_shingles, component_id, link_group (what a component is known by;
    component_id may name several where texts share a doc_id), one row for each row."""
    texts = with_part(texts, scratch)
    features = scratch.save(texts.mapInPandas(_features, _FEATURES), "features")

    of_set = ["n_shingles", "set_a", "set_b"]
    classes = features.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*of_set).agg(
        F.min(F.struct("doc_id", "part")).alias("first"), F.first("keys").alias("keys")
    )
    # a class goes by its smallest doc_id, and by a number of its own where that one has other texts too
    node = F.when(F.col("first.part") == 0, F.col("first.doc_id")).otherwise(F.xxhash64("first.doc_id", "first.part"))
    classes = scratch.save(classes.select(*of_set, node.alias("id"), "first.doc_id", "first.part", "keys"), "classes")
    keyed = classes.select("id", F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("id").alias("center"), F.max("id").alias("last")).where("center < last")
    buckets = scratch.save(keyed.join(shared.select("key", "center"), "key"), "buckets")
    wanted = buckets.select("id").distinct().join(classes.select("id", "doc_id", "part"), "id")
    members = texts.where("doc_id IS NOT NULL").join(wanted, ["doc_id", "part"]).groupBy("doc_id", "part").agg(F.min("text").alias("text"), F.first("id").alias("id"))
    members = scratch.save(members.select("id", "text"), "texts")
    similar_size = lambda x, y: f"100 * least({x}, {y}) >= {percent} * greatest({x}, {y})"

    def verified(pairs: DataFrame, label: str) -> DataFrame:
        """Pairs (a, b) -> those that link."""
        held = pairs.join(members.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(
            members.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b"
        )
        return scratch.save(held.sortWithinPartitions("a").mapInPandas(_verify(percent), "a long, b long"), label)

    def star(rows: DataFrame, tried: DataFrame | None, label: str) -> tuple[DataFrame, DataFrame]:
        """rows: (id, n, center) of buckets -> pairs that were compared, links among them."""
        sizes = classes.select(F.col("id").alias("center"), F.col("n_shingles").alias("m"))
        pairs = rows.where("id <> center").select("id", "n", "center").distinct().join(sizes, "center").where(similar_size("n", "m"))
        pairs = pairs.select(F.greatest("id", "center").alias("b"), F.least("id", "center").alias("a")).distinct()
        pairs = scratch.save(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), f"{label}-pairs")
        return pairs, verified(pairs, f"{label}-links")

    def mixed(links: DataFrame) -> DataFrame:
        """Members of the buckets that hold more than one component, with their component."""
        found = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")), scratch)
        labelled = buckets.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", "n", "key", F.coalesce("component", "id").alias("component"))
        open_keys = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
        return scratch.save(labelled.join(open_keys.select("key"), "key", "left_semi"), "mixed")

    tried, links = star(buckets, None, "first")
    rows = mixed(links)
    degree = links.select(F.col("a").alias("id")).unionAll(links.select(F.col("b").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    ranked = rows.join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    hubs = ranked.groupBy("key").agg(F.max_by(F.struct("id", "component"), F.struct("degree", -F.col("id"))).alias("hub"))
    second = rows.join(hubs, "key").where("component <> hub.component").withColumn("center", F.col("hub.id"))
    tried_hub, more = star(second, tried, "hub")
    tried, links = tried.unionByName(tried_hub), links.unionByName(more)

    rest = _could_link(mixed(links).select("id", "component", "n"), members, percent, scratch).join(tried, ["a", "b"], "left_anti")
    links = links.unionByName(verified(rest, "rest-links"))

    found = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")), scratch)
    scratch.drop(buckets, members)
    grouped = classes.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    # components that hold a number of ours are named anew, by the smallest doc_id in them
    odd = broadcast_if_small(scratch.save(grouped.where("part <> 0").select("component").distinct(), "odd"))
    names = grouped.join(odd, "component").groupBy("component").agg(F.min("doc_id").alias("name"))
    names = broadcast_if_small(scratch.save(names, "names"))
    grouped = grouped.join(names, "component", "left").select(*of_set, F.coalesce("name", "component").alias("component_id"), F.col("component").alias("link_group"))
    result = features.select("doc_id", "part", *of_set).join(grouped, of_set, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return result.select("doc_id", "part", "n_shingles", component.alias("component_id"), "link_group")


def without_copies(documents: DataFrame, percent: int = 80) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id, all columns as
    they are. Rows without doc_id or words stay. Of rows that repeat a doc_id and text one stays, and
    of different texts under one doc_id that are near duplicates too."""
    scratch = Scratch(documents.sparkSession, "copies")
    own = documents.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    judged = _judged(own.select("doc_id", "text"), percent, scratch).where("doc_id IS NOT NULL AND n_shingles > 0")
    each = judged.groupBy("doc_id", "part").agg(F.first("component_id").alias("component_id"), F.first("link_group").alias("link_group"), F.count(F.lit(1)).alias("n"))
    each = scratch.save(each, "each")
    first = each.where("doc_id = component_id AND part <> 0").groupBy("doc_id", "link_group").agg(F.min("part").alias("first"))
    first = broadcast_if_small(scratch.save(first, "first"))
    gone = each.join(first, ["doc_id", "link_group"], "left").where("doc_id <> component_id OR part <> first").select("doc_id", "part")
    kept = with_part(own, scratch).join(gone, ["doc_id", "part"], "left_anti")
    again = each.where("n > 1").select("doc_id", "part")
    if not again.isEmpty():
        again = broadcast_if_small(again)
        once = kept.join(again, ["doc_id", "part"], "left_anti")
        kept = once.unionByName(kept.join(again, ["doc_id", "part"], "left_semi").dropDuplicates(["doc_id", "part"]))
    return kept.select("row.*")

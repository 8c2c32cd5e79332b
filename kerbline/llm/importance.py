"""Resampling of documents by how much their word n-grams resemble a target corpus. DataFrame operations only.

Features of a text are all runs of one to `n` words in a row, each hashed to one of `buckets`. A bucket's
gain is the logarithm of its share among the target's features over its share among the documents'; a
document's weight is the mean gain of its features. The documents with the highest weight plus Gumbel
noise, drawn from a hash of the id, are taken: sampling without replacement by importance weight.

Texts are skewed in length, so they are split at word boundaries into chunks of CHUNK_WORDS words that
carry the next n - 1 words along. A chunk owns the features that start at its own words, so each feature
counts once; counts and gains of chunks are summed by document. Features are hashed once, into a scratch
table of bucket numbers; counts and gains read that. What is broadcast has `buckets` rows, and ranks come
from a sort over ranges, counted range by range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import Scratch

N, BUCKETS, PERCENT, LEAST_WORDS, SEED = 2, 10_000, 25, 20, 7
CHUNK_WORDS = 8192
_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; a null text has none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _SEPARATOR), lambda w: w != "")


def hashed_features(texts: DataFrame, n: int, buckets: int) -> DataFrame:
    """(..., text) -> (...), n_words, features: a row for each chunk of each text, a text without words
    among them. `features` are the buckets of the features that start in the chunk."""
    others = [F.col(c) for c in texts.columns if c != "text"]
    # explode keeps Spark from splitting the text again for each use of its words
    worded = texts.select(*others, F.explode(F.array(_words(F.col("text")))).alias("all"))
    begins = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("all") - 1), F.lit(CHUNK_WORDS))
    own = lambda at: F.struct(F.least(F.lit(CHUNK_WORDS), F.size("all") - at).alias("n_words"), F.slice("all", at + 1, F.lit(CHUNK_WORDS + n - 1)).alias("w"))
    chunks = worded.select(*others, F.explode(F.transform(begins, own)).alias("c")).select(*others, "c.*")
    bucket = lambda feature: (F.crc32(feature) % buckets).cast("int")
    kinds = [F.transform(F.slice("w", 1, F.col("n_words")), bucket)]
    for more in range(1, n):
        joined = F.slice("w", 1, F.least(F.col("n_words"), F.greatest(F.lit(0), F.size("w") - more)))
        for k in range(1, more + 1):
            # zip_with pads the longer side with null: both have the length of the first
            joined = F.zip_with(joined, F.slice("w", k + 1, F.size(joined)), lambda a, b: F.concat(a, F.lit(" "), b))
        kinds.append(F.transform(joined, bucket))
    return chunks.select(*others, "n_words", F.concat(*kinds).alias("features"))


def _bucket_counts(features: DataFrame, name: str) -> DataFrame:
    return features.select(F.explode("features").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def bucket_gains(documents: DataFrame, target: DataFrame, scratch: Scratch, buckets: int) -> DataFrame:
    """Hashed features of both -> bucket, gain for every bucket that either has."""
    counts = scratch.save(_bucket_counts(documents, "s").join(_bucket_counts(target, "t"), "bucket", "full").na.fill(0), "counts")
    all_s, all_t = (float(x or 0) for x in counts.agg(F.sum("s"), F.sum("t")).first())
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = (t + 1) * F.lit(all_s + buckets) / ((s + 1) * F.lit(all_t + buckets))
    return counts.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).cast("long").alias("gain"))


def weigh(documents: DataFrame, target: DataFrame, scratch: Scratch, n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, text), (text) -> number, doc_id, n_words, n_features, weight; a row for each row of documents."""
    numbered = documents.withColumn("number", F.monotonically_increasing_id())  # fixed when the table is written
    features = scratch.save(hashed_features(numbered, n, buckets), "features")
    aims = scratch.save(hashed_features(target, n, buckets), "target")
    gains = bucket_gains(features, aims, scratch, buckets)  # at most `buckets` rows
    each = features.select("number", F.explode("features").alias("bucket")).join(F.broadcast(gains), "bucket")
    gained = each.groupBy("number").agg(F.sum("gain").alias("gain"), F.count(F.lit(1)).alias("n_features"))
    sizes = features.groupBy("number", "doc_id").agg(F.sum("n_words").cast("long").alias("n_words"))
    joined = sizes.join(gained, "number", "left").withColumn("n_features", F.coalesce("n_features", F.lit(0)).cast("long"))
    mean = F.expr("coalesce((gain - pmod(gain, n_features)) div n_features, 0L)")
    weight = F.when(F.col("n_features") > 0, mean).otherwise(F.lit(0)).cast("long")
    out = scratch.save(joined.select("number", "doc_id", "n_words", "n_features", weight.alias("weight")), "weights")
    scratch.drop(features, aims)
    return out


def resample(
    documents: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, n: int = N, buckets: int = BUCKETS
) -> DataFrame:
    """(doc_id, text, ...), (text, ...) -> doc_id, n_features, weight, score, rank; a row for each document.

    Of the documents with `least_words` words or more and an id, `percent` in a hundred are drawn: those
    of the highest scores, ties to the smaller id. rank is their place in that order, from 1, and null
    for all others. A null or empty text, or one without words, has no features and weight 0. A null id
    has no score. Rows that repeat an id are documents of their own with equal noise; which of two equal
    ones goes first is not defined, but their rows are alike. Whole texts are read; a very long one's
    words are held once, in the task that splits it. Other columns are ignored, whatever their names; an
    empty table gives no rows, and an empty target gives every bucket the same count of one.
    """
    scratch = Scratch(documents.sparkSession, "importance")
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    weights = weigh(own, target.select(F.col("text").cast("string").alias("text")), scratch, n, buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")
    scored = weights.withColumn("score", F.col("weight") + noise)
    scored = scratch.save(scored.withColumn("eligible", (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()), "scored")
    drawn = scored.where("eligible").count() * percent // 100
    # place: the range's number and the place inside it, fixed when the table is written
    placed = scored.orderBy(F.desc("eligible"), F.desc("score"), "doc_id", "number").withColumn("place", F.monotonically_increasing_id())
    placed = scratch.save(placed, "placed").withColumn("range", F.shiftright("place", 33))
    before, at = {}, 0
    for row in placed.groupBy("range").agg(F.count(F.lit(1)).alias("n")).orderBy("range").collect():  # a row for each range of the sort
        before[row["range"]] = at
        at += row["n"]
    firsts = documents.sparkSession.createDataFrame(list(before.items()), "range long, before long")
    rank = F.col("before") + F.col("place") - F.shiftleft(F.col("range"), 33) + 1
    ranked = placed.join(F.broadcast(firsts), "range").withColumn("rank", rank)
    taken = F.col("eligible") & (F.col("rank") <= drawn)
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(taken, F.col("rank")).alias("rank"))


def oracle_sql() -> str:
    """The same result in DuckDB's SQL; crc32 is folded over the bytes of each different feature."""
    table = f"""
bits AS (SELECT i::BIGINT AS i, list_reduce(list_prepend(i::BIGINT, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {0xEDB88320}) ELSE c >> 1 END) AS c FROM range(0, 256) AS r(i)),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits)"""
    words = r"regexp_extract_all(translate(coalesce(text, ''), '" + _UPPER + "', '" + _LOWER + r"'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH {table.strip()},
worded AS (SELECT doc_id, {words} AS w FROM documents),
aimed AS (SELECT {words} AS w FROM benchmark),
each AS (
  SELECT 0 AS side, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM worded
  UNION ALL SELECT 1, NULL, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) FROM aimed),
different AS (SELECT DISTINCT f, hex(encode(f)) AS x FROM each),
hashed AS (
  SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(x) // 2), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::BIGINT)),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % {BUCKETS} AS bucket FROM different, crc),
counted AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM each JOIN hashed USING (f) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM counted),
weights AS (
  SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS g FROM each JOIN hashed USING (f) JOIN gains USING (bucket) WHERE side = 0 GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce((g - ((g % n) + n) % n) // n, 0)::BIGINT AS weight,
         floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise
  FROM worded d LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT *, weight + noise AS score, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY weight + noise DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_words >= {LEAST_WORDS} AND place <= (SELECT {PERCENT} * count(*) // 100 FROM scored WHERE n_words >= {LEAST_WORDS}) THEN place END AS rank
FROM ranked"""

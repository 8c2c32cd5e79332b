"""Keyed merges of a log into a table: what is set once, what is overwritten, what keeps its last value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(log: DataFrame, keys: Sequence[str], seq: Sequence[str], first: Sequence[str], last: Sequence[str], last_known: Sequence[str] = ()) -> DataFrame:
    """State after all rows of a log, one row per key, as if they were upserted one by one in `seq` order.

    `first` columns keep the value of the key's first row, null too; `last` columns that of its last row;
    `last_known` the last value that isn't null. Grouping combines before the shuffle, so a key that
    holds much of the log is no burden. `seq` must order a key's rows fully.
    """
    order = F.struct(*seq)
    aggregates = []
    if first:
        aggregates.append(F.min(F.struct(order.alias("o"), F.struct(*first).alias("v"))).alias("__first"))
    if last:
        aggregates.append(F.max(F.struct(order.alias("o"), F.struct(*last).alias("v"))).alias("__last"))
    known = [F.max(F.when(F.col(c).isNotNull(), F.struct(order.alias("o"), F.col(c).alias("v")))).alias(f"__k_{c}") for c in last_known]
    out = log.groupBy(*keys).agg(*aggregates, *known)
    return out.select(*keys, *[F.col(f"__first.v.{c}").alias(c) for c in first], *[F.col(f"__last.v.{c}").alias(c) for c in last], *[F.col(f"__k_{c}.v").alias(c) for c in last_known])


def fold_into(target: DataFrame, log: DataFrame, keys: Sequence[str], seq: Sequence[str], first: Sequence[str], last: Sequence[str], last_known: Sequence[str] = ()) -> DataFrame:
    """Target after a batch, with is_new (the key wasn't there). A replay of the batch changes nothing else."""
    # rows are sorted by a hash first: keys often begin alike, and whole texts cost much to compare
    hashed, placed = F.xxhash64(*keys), ["__hash", *keys]
    new = fold(log.withColumn("__hash", hashed), placed, seq, first, last, last_known)
    t, n = target.withColumn("__hash", hashed).alias("t"), new.alias("n")
    joined = t.join(n, on=[F.col(f"t.{k}") == F.col(f"n.{k}") for k in placed], how="full")
    there, comes = F.col(f"t.{keys[0]}").isNotNull(), F.col(f"n.{keys[0]}").isNotNull()
    pick = lambda c, old, new: F.when(old, F.col(f"t.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
    return joined.select(
        *[F.coalesce(F.col(f"t.{k}"), F.col(f"n.{k}")).alias(k) for k in keys],
        *[pick(c, there, comes) for c in first],
        *[pick(c, ~comes, comes) for c in last],
        *[F.coalesce(F.col(f"n.{c}"), F.col(f"t.{c}")).alias(c) for c in last_known],
        (~there).alias("is_new"),
    )


def insert_absent(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target and those rows whose key it lacks; of rows with one key any one is taken."""
    return target.unionByName(rows.dropDuplicates(list(keys)).join(target.select(*keys), list(keys), "left_anti").select(*target.columns))


def fallback_ids(listings: DataFrame, sources: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing ids filled from the source whose platform and handle are the listing's platform."""
    own = sources.where("platform = handle").select(F.col("platform").alias("__p"), *[F.col(c).alias(f"__{c}") for c in columns])
    out = listings.join(own, F.col("source_platform") == F.col("__p"), "left")
    return out.withColumns({c: F.coalesce(c, f"__{c}") for c in columns}).select(*listings.columns)


#: Columns of a listing by what a repeated address does to them: kept from the first row, taken from the
#: last, or taken from the last that has one.
LISTING_KEYS = ("source_platform", "source_url")
LISTING_FIRST = (
    "make", "model", "variant", "year", "fuel_type", "transmission", "owner_count", "color", "body_type", "location", "city",
    "source_listing_id", "seller_name", "seller_phone", "seller_type", "listed_at", "scraped_at",
)
LISTING_LAST = ("price", "listing_status", "km_driven", "media", "description", "dealer_source_id", "dealer_id", "sale_status", "is_active", "updated_at", "content_hash")
LISTING_LAST_KNOWN = ("sold_at",)


def merge_counts(merged: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n_new and n_updated of a batch, from what `fold_into` returned for it."""
    touched = merged.join(batch.select(*keys).distinct(), list(keys), "left_semi")
    return touched.agg(F.count_if("is_new").alias("n_new"), F.count_if(~F.col("is_new")).alias("n_updated"))


def ensured(target: DataFrame, rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, is_new) of every row asked for: what the target has, else the row's own; the smallest of equal keys."""
    asked = rows.groupBy(key).agg(F.min(value).alias("__new"))
    there = target.select(F.col(key).alias("__key"), F.col(value).alias("__old"))
    out = asked.join(there, F.col(key) == F.col("__key"), "left")
    return out.select(key, F.coalesce("__old", "__new").alias(value), F.col("__key").isNull().alias("is_new"))


def updated_from(target: DataFrame, source: DataFrame, target_key, source_key, values: dict) -> DataFrame:
    """Target with columns set from the source row of equal key (one at most); others stay as they are.

    values: target column -> expression over the source's columns. Rows without a match keep theirs.
    """
    found = source.select(source_key.alias("__key"), *[v.alias(f"__{c}") for c, v in values.items()])
    joined = target.withColumn("__own", target_key).join(found, F.col("__own") == F.col("__key"), "left")
    there = F.col("__key").isNotNull()
    return joined.withColumns({c: F.when(there, F.col(f"__{c}")).otherwise(F.col(c)) for c in values}).select(*target.columns)

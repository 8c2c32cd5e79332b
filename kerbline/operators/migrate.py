"""Set-oriented changes of stored tables, as an ordered list of steps over named tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.functions.text import slug_untrimmed
from kerbline.operators.upsert import insert_absent, updated_from

Tables = dict[str, DataFrame]
#: Platforms that gather the listings of many dealers.
AGGREGATORS = ("source-a", "source-b", "source-c")


def source_slug() -> Column:
    return slug_untrimmed(F.coalesce("display_name", "handle"))


def photos_to_media(listings: DataFrame) -> DataFrame:
    """photos (array of addresses) become media (array of items); no photos are no items."""
    items = F.transform(F.coalesce("photos", F.array().cast("array<string>")), lambda p: F.struct(p.alias("url"), F.lit("image").alias("type")))
    return listings.withColumn("media", items).drop("photos")


def dealers_from_sources(tables: Tables) -> Tables:
    """A dealer for each source of its own that has none under its slug."""
    own = tables["sources"].where(~F.col("platform").isin(*AGGREGATORS))
    rows = own.select(source_slug().alias("slug"), F.coalesce("display_name", "handle").alias("name"), F.lit("dealer").alias("kind"), "city")
    return tables | {"dealers": insert_absent(tables["dealers"], rows, ["slug"])}


def profile_addresses(tables: Tables) -> Tables:
    """Dealers without a profile address get that of the social source with their slug."""
    social = tables["sources"].where("platform = 'social'")
    found = social.groupBy(source_slug().alias("slug")).agg(F.min("handle").alias("handle"))
    url = F.concat(F.lit("https://www.instagram.com/"), F.col("handle"), F.lit("/"))
    own = F.when(F.col("profile_url").isNull(), F.col("slug"))
    return tables | {"dealers": updated_from(tables["dealers"], found, own, F.col("slug"), {"profile_url": url})}


def sources_to_dealers(tables: Tables) -> Tables:
    """Sources get the slug of their dealer's row and their type; those without a dealer stay as they are."""
    gathers = F.col("platform").isin(*AGGREGATORS)
    key = F.when(gathers, F.col("platform")).otherwise(source_slug())
    kind = F.when(F.col("platform") == "social", "instagram_dealer").when(gathers, "marketplace_aggregator").otherwise("other")
    typed = tables["sources"].withColumn("__kind", kind)
    found = updated_from(typed, tables["dealers"], key, F.col("slug"), {"dealer_slug": F.col("slug")})
    there = F.col("dealer_slug").isNotNull()
    return tables | {"sources": found.withColumn("source_type", F.when(there, F.col("__kind")).otherwise(F.col("source_type"))).drop("__kind")}


#: In the order in which they are applied.
JOURNAL: list[tuple[str, Callable[[Tables], Tables]]] = [
    ("0001_dealers_from_sources", dealers_from_sources),
    ("0002_profile_addresses", profile_addresses),
    ("0003_sources_to_dealers", sources_to_dealers),
]


def migrated(tables: Mapping[str, DataFrame], done: set[str] | frozenset[str] = frozenset()) -> tuple[Tables, list[str]]:
    """Tables after the steps that aren't done yet, and the names of these."""
    now, names = dict(tables), []
    for name, step in JOURNAL:
        if name not in done:
            now = step(now)
            names.append(name)
    return now, names


def dangling(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows whose key is set and that have no parent."""
    keys = parent.select(F.col(parent_key).alias("__key"))
    return child.where(F.col(child_key).isNotNull()).join(keys, F.col(child_key) == F.col("__key"), "left_anti")


def set_null_where_dangling(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows, their key null where the parent is gone."""
    keys = parent.select(F.col(parent_key).alias("__key")).distinct()
    out = child.join(keys, F.col(child_key) == F.col("__key"), "left")
    return out.withColumn(child_key, F.when(F.col("__key").isNotNull(), F.col(child_key))).select(*child.columns)

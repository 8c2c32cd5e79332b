"""Dealer directory, dealer and listing details, saved lists, and what visitors send in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.functions.text import trimmed
from kerbline.operators.stored import Folder

LATEST = 48


def directory(dealers: DataFrame, listings: DataFrame, kind: str | None = None) -> DataFrame:
    """Active dealers with how many of the given listings they have, zero too; most first, then by name.

    `listings` is filtered before it gets here: a filter after the outer join would lose empty dealers.
    """
    shown = dealers.where("is_active") if kind is None else dealers.where(F.col("is_active") & (F.col("kind") == kind))
    counts = listings.groupBy("dealer_id").agg(F.count(F.lit(1)).alias("n"))
    out = shown.join(counts, shown["id"] == counts["dealer_id"], "left").drop("dealer_id")
    return out.withColumn("listing_count", F.coalesce("n", F.lit(0))).drop("n").orderBy(F.col("listing_count").desc(), "name")


def by_slug(dealers: DataFrame, slug: str) -> DataFrame:
    """The active dealer of that slug: one row or none."""
    return dealers.where((F.col("slug") == slug) & F.col("is_active")).limit(1)


def sources_of(sources: DataFrame, dealer_id: int) -> DataFrame:
    return sources.where(F.col("dealer_id") == dealer_id)


def latest(listings: DataFrame, dealer_id: int, k: int = LATEST) -> DataFrame:
    """A dealer's newest active listings; a null time counts as newest, the id settles ties."""
    return listings.where(F.col("is_active") & (F.col("dealer_id") == dealer_id)).orderBy(F.col("scraped_at").desc_nulls_first(), "id").limit(k)


def by_key(df: DataFrame, column: str, value: object) -> DataFrame:
    return df.where(F.col(column) == value).limit(1)


def saved(spark: SparkSession, listings: DataFrame, ids: Sequence[int]) -> DataFrame:
    """Listings of a client's id list, in its order; unknown ids have no row, no ids no rows."""
    wanted = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "id bigint, position int")
    return listings.join(wanted, "id").orderBy("position")  # a client's list is short; Spark broadcasts it by its size


def toggled(saved_ids: Column, one: Column) -> Column:
    """Id list after a click: taken out where it is there, else put first."""
    return F.when(F.array_contains(saved_ids, one), F.array_remove(saved_ids, one)).otherwise(F.concat(F.array(one), saved_ids))


def feedback(sent: DataFrame) -> DataFrame:
    """(category, rating, message) as they are stored: a rating of 0 is none, the message is trimmed."""
    return sent.select("category", F.nullif("rating", F.lit(0)).alias("rating"), trimmed(F.col("message")).alias("message"))


def reports(sent: DataFrame) -> DataFrame:
    """(listing_id, report_type, description) as they are stored: without listing or type there is no
    report, a blank description is none, the status is open."""
    there = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    kept = sent.where(there("listing_id") & there("report_type"))
    return kept.select("listing_id", "report_type", F.nullif(trimmed(F.col("description")), F.lit("")).alias("description"), F.lit("open").alias("status"))


#: Addresses that a sitemap file may hold, and how sitemap files and their index begin.
SITEMAP_URLS = 50_000
_NAMESPACE = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


def export_sitemap(entries: DataFrame, folder: Folder, base: str, size: int = SITEMAP_URLS) -> list[str]:
    """Writes (url, change) as sitemap files of at most `size` addresses, and an index of them; returns
    the files' names.

    Addresses are sorted by ranges and each range is cut by itself, so files are written side by side. An
    export that was written whole stays as it is; one that failed is written anew.
    """

    def xml(df: DataFrame, root: str, row: str, name: str) -> None:
        options = {"rootTag": f"{root} {_NAMESPACE}", "rowTag": row, "declaration": 'version="1.0" encoding="UTF-8"', "maxRecordsPerFile": size}
        df.write.mode("overwrite").format("xml").options(**options).save(f"{folder.root}/{name}")

    if not folder.exists("done.json"):
        rows = entries.orderBy("url", "change").select(F.concat(F.lit(base), "url").alias("loc"), F.col("change").alias("changefreq"))
        xml(rows, "urlset", "url", "urls")
        files = [n for n in folder.names("urls") if n.startswith("part-")]
        names = entries.sparkSession.createDataFrame([(f"{base}/urls/{n}",) for n in files], "loc string")  # a row for each file
        xml(names.coalesce(1), "sitemapindex", "sitemap", "index")
        folder.put_json_once("done.json", files)
    return folder.read_json("done.json")

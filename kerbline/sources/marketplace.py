"""Marketplace tables over the star-schema test tables: orders stand for listings, customers for dealers,
suppliers for the sources that dealers publish through.

The columns are written as SQL expressions that Spark and the checking engine both read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.operators.spread import spread

def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: name -> expression over orders, customer and nation; ~ stands for integer division.
_LISTING = {
    "id": "o_orderkey",
    "make": "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'BMW' WHEN 'BUILDING' THEN 'Hyundai' WHEN 'FURNITURE' THEN 'Maruti Suzuki' WHEN 'HOUSEHOLD' THEN 'Honda' ELSE 'LAND ROVER' END",
    "model": "c_name",
    "variant": "CASE WHEN o_orderkey % 6 <> 0 THEN o_orderpriority END",
    "description": "CASE WHEN o_orderkey % 5 = 0 THEN 'Single owner, ' || lower(n_name) END",
    "year": "CAST(year(o_orderdate) AS INT)",
    "price": "CASE WHEN o_orderstatus <> 'P' THEN CAST(o_totalprice AS DECIMAL(12,2)) END",
    "sale_status": "CASE WHEN o_orderstatus = 'F' THEN 'sold' ELSE 'available' END",
    "km_driven": "CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderkey * 37 % 2100000 AS INT) END",
    "fuel_type": "CASE o_orderkey % 4 WHEN 1 THEN '' WHEN 2 THEN 'Petrol' WHEN 3 THEN 'diesel' END",
    "transmission": "CASE WHEN o_orderkey % 3 = 0 THEN 'manual' ELSE 'automatic' END",
    "body_type": "CASE o_orderkey % 5 WHEN 1 THEN '' WHEN 2 THEN 'suv' WHEN 3 THEN 'sedan' WHEN 4 THEN 'hatchback' END",
    "source_platform": "'source-' || CAST(o_orderkey % 3 AS STRING)",
    "source_url": "'https://cars.example.com/buy/' || lower(c_mktsegment) || '-' || lpad(CAST(o_orderkey AS STRING), 9, '0')",
    "city": "n_name",
    "dealer_id": "o_custkey",
    "scraped_at": "o_orderdate",
    "is_active": "o_orderkey % 10 <> 0",
    "media_count": "CAST(o_orderkey % 4 AS INT)",
}
#: One media item, number i of listing id: mostly images, some videos with or without a poster, some that can't be used.
_MEDIA = {
    "url": "CASE WHEN id % 11 = 0 AND i = 1 THEN 'ftp://img.example.com/x' ELSE 'https://img.example.com/' || CAST(id AS STRING) || '/' || CAST(i AS STRING) END",
    "type": "CASE WHEN id % 13 = 0 AND i = 2 THEN 'audio' WHEN id % 7 = 0 AND i = 0 THEN 'video' WHEN id % 8 = 1 THEN 'video' ELSE 'image' END",
    "poster_url": "CASE WHEN id % 7 = 0 AND i = 0 THEN 'https://img.example.com/poster/' || CAST(id AS STRING) END",
}
_DEALER = {
    "id": "c_custkey",
    "name": "c_name",
    "slug": "'customer-' || substr(c_name, 10)",
    "kind": "CASE WHEN c_custkey % 100 = 0 THEN 'marketplace' ELSE 'dealer' END",
    "city": "CASE WHEN c_custkey % 4 <> 0 THEN 'City ' || CAST(c_nationkey AS STRING) END",
    "description": "CASE WHEN c_custkey % 3 = 0 THEN 'Dealer of ' || lower(c_mktsegment) END",
    "is_active": "c_custkey % 9 <> 0",
}
_SOURCE = {
    "id": "s_suppkey",
    "platform": "CASE s_suppkey % 3 WHEN 0 THEN 'social' WHEN 1 THEN 'source-a' ELSE 'web' END",
    "handle": "lower(s_name)",
    "display_name": "CASE WHEN s_suppkey % 2 = 0 THEN 'Shop (' || s_name || ')!' END",
    "city": "CASE WHEN s_suppkey % 5 <> 0 THEN 'Chennai' END",
    "is_active": "s_suppkey % 7 <> 0",
    "dealer_id": "s_suppkey",
}


def _select(columns: dict[str, str]) -> list[str]:
    return [f"{sql} AS {name}" for name, sql in columns.items()]


def listings(spark: SparkSession, sf_dir: str, over_tasks: bool = False) -> DataFrame:
    """One row per order; `over_tasks` spreads the orders before anything is made of them."""
    o, c, n = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    o = spread(o, "o_orderkey") if over_tasks else o
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).selectExpr(*_select(_LISTING))


def with_media(listings: DataFrame) -> DataFrame:
    """Adds media, an array of (url, type, poster_url) of media_count items."""
    fields = ", ".join(f"'{name}', {sql}" for name, sql in _MEDIA.items())
    return listings.withColumn("media", F.expr(f"CASE WHEN media_count > 0 THEN transform(sequence(0, media_count - 1), i -> named_struct({fields})) ELSE array() END"))


def dealers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").selectExpr(*_select(_DEALER))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").selectExpr(*_select(_SOURCE))


LISTINGS_SQL = f"listings AS (SELECT {', '.join(_select(_LISTING))} FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"
DEALERS_SQL = f"dealers AS (SELECT {', '.join(_select(_DEALER))} FROM customer)"
SOURCES_SQL = f"sources AS (SELECT {', '.join(_select(_SOURCE))} FROM supplier)"
#: One row per media item, number i from 0.
MEDIA_SQL = f"media AS (SELECT id, i, {', '.join(_select(_MEDIA))} FROM (SELECT id, unnest(range(0, media_count)) AS i FROM listings))"

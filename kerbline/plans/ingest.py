"""Captured pages to listings, validation, runs, keyed merges, incremental work and changes of stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.functions import text as T
from kerbline.operators import incremental as I
from kerbline.operators import ledger as L
from kerbline.operators import migrate as M
from kerbline.operators import quality as Q
from kerbline.operators import upsert as U
from kerbline.plans.registry import query
from kerbline.sources import elements, jsonld, posts
from kerbline.sources.marketplace import DEALERS_SQL, LISTINGS_SQL, MEDIA_SQL, SOURCES_SQL, dealers, listings, read, sources, with_media

# -- structured data of pages ------------------------------------------------------------------

_K = "CAST(p_partkey AS STRING)"
_SCRIPT = "'<script type=\"application/ld+json\">'"
_LIST_JSON = f"'{{\"@graph\": [{{\"@type\": \"ListItem\", \"name\": \"' || p_name || '\", \"url\": \"/u/' || {_K} || '\"}}, {{\"@type\": \"Thing\", \"url\": \"/t\"}}, {{\"@type\": \"ListItem\", \"url\": \"\"}}, {{\"@type\": \"ListItem\", \"url\": \"/v\", \"image\": \"i.jpg\"}}]}}'"
_LIST_PAGE = f"'<html>' || {_SCRIPT} || '{{bad</script><p>' || {_SCRIPT} || {_LIST_JSON} || '</script>'"


@query(
    f"""WITH t AS (SELECT p_partkey, json_extract(CAST({_LIST_JSON} AS JSON), '$."@graph"') AS g FROM part), u AS (SELECT p_partkey, unnest(CAST(g AS JSON[])) AS n FROM t)
SELECT 'p' || p_partkey AS url, coalesce(n->>'name', '') AS name, n->>'url' AS link, n->>'image' AS image FROM u WHERE n->>'$."@type"' = 'ListItem' AND coalesce(n->>'url', '') <> ''"""
)
def jsonld_list(spark, d):
    pages = read(spark, d, "part").selectExpr(f"'p' || {_K} AS url", f"{_LIST_PAGE} AS html")
    return jsonld.listing_links(pages).select("url", "name", "link", "image")


_CAR_JSON = (
    "'{\"@type\": \"Car\", \"name\": \"2019 ' || p_brand || ' Modelo ' || p_type || '\", \"brand\": {\"name\": \"' || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_brand END || '\"}, \"model\": \"Modelo\", \"vehicleModelDate\": '"
    " || CASE p_partkey % 3 WHEN 0 THEN '2019' WHEN 1 THEN '\"2019-05\"' ELSE '\"2019\"' END || ', \"offers\": {\"price\": ' || CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS STRING) || '000' WHEN 1 THEN '\"' || CAST(p_size AS STRING) || '000.5 INR\"' WHEN 2 THEN '0' ELSE '\"7\"' END"
    " || '}, \"mileageFromOdometer\": {\"value\": \"' || CAST(p_size AS STRING) || '123 km\"}, \"fuelType\": \"Petrol\", \"image\": [\"a.jpg\", \"b.jpg\"]}'"
)
_CAR_PAGE = f"{_SCRIPT} || '{{bad</script>' || {_SCRIPT} || '[{{\"@type\": \"Thing\"}}, ' || {_CAR_JSON} || ', {{\"@type\": \"Car\", \"model\": \"second\"}}]</script>'"
_BUY = "'https://a.example.com/buy-' || lpad(CAST(p_partkey AS STRING), 9, '0') || '/'"


@query(
    f"""WITH t AS (SELECT p_partkey, p_brand, p_type, {_BUY} AS url, CAST({_CAR_JSON} AS JSON) AS n FROM part),
u AS (SELECT *, n->'$.brand'->>'name' AS make, TRY_CAST(regexp_extract(n->>'vehicleModelDate', '^[0-9]+') AS INT) AS year, TRY_CAST(regexp_extract(n->'$.offers'->>'price', '^[0-9]+\\.?[0-9]*') AS DECIMAL(12,2)) AS price FROM t)
SELECT url AS source_url, make, n->>'model' AS model, trim(p_type) AS variant, year, price, TRY_CAST(regexp_extract(n->'$.mileageFromOdometer'->>'value', '^[0-9]+') AS INT) AS km_driven, n->>'fuelType' AS fuel_type,
 lpad(p_partkey::VARCHAR, 9, '0') AS source_listing_id, 'dealer' AS seller_type, 2 AS n_photos FROM u WHERE make <> '' AND year <> 0 AND price <> 0"""
)
def jsonld_car(spark, d):
    pages = read(spark, d, "part").selectExpr(f"{_BUY} AS url", f"{_CAR_PAGE} AS html")
    kept = ["source_url", "make", "model", "variant", "year", "price", "km_driven", "fuel_type", "source_listing_id", "seller_type"]
    return jsonld.cars(pages, "Chennai", "source-a").select(*kept, F.size("photos").alias("n_photos"))


_PRODUCT = (
    "'{\"@type\": \"Product\", \"name\": \"2018 ' || p_brand || ' Swift VXI\", \"offers\": {\"' || CASE WHEN p_partkey % 2 = 0 THEN 'price' ELSE 'lowPrice' END || '\": \"' || CAST(p_size AS STRING) || '.5 Lakh\"},"
    " \"productionDate\": ' || CASE WHEN p_partkey % 3 = 0 THEN 'null' ELSE '\"2016\"' END || ', \"vehicleEngine\": {\"fuelType\": \"CNG\"}, \"url\": \"/used-car-details/x-' || CAST(p_partkey AS STRING) || '.htm\", \"mileageFromOdometer\": {\"value\": 4200}}'"
)
_LISTED = f"'{{\"itemListElement\": [{{\"item\": ' || {_PRODUCT} || '}}, {{\"@type\": \"Car\", \"brand\": {{\"name\": \"Acme Motors\"}}, \"name\": \"Only\", \"price\": 5}}]}}'"
_PRODUCT_PAGE = f"{_SCRIPT} || CASE p_partkey % 3 WHEN 0 THEN '{{\"@graph\": [' || {_LISTED} || ']}}' WHEN 1 THEN '[' || {_LISTED} || ', {{\"@type\": \"Car\", \"name\": \"a b\", \"price\": 0}}]' ELSE {_PRODUCT} END || '</script>'"


@query(
    """SELECT 'p' || p_partkey AS page_url, p_brand AS make, 'Swift' AS model, 'VXI' AS variant, CASE WHEN p_partkey % 3 = 0 THEN 2018 ELSE 2016 END AS year, CAST(p_size * 100000 + 50000 AS DECIMAL(12,2)) AS price, 4200 AS km_driven, 'CNG' AS fuel_type,
 'https://b/used-car-details/x-' || p_partkey || '.htm' AS source_url, p_partkey::VARCHAR AS source_listing_id FROM part"""
)
def jsonld_products(spark, d):
    pages = read(spark, d, "part").selectExpr(f"'p' || {_K} AS url", f"{_PRODUCT_PAGE} AS html")
    return jsonld.products(pages, "https://b", "Chennai", "source-b").select("page_url", "make", "model", "variant", "year", "price", "km_driven", "fuel_type", "source_url", "source_listing_id")


# -- elements of pages -------------------------------------------------------------------------

_SIZE = "CAST(p_size AS STRING)"
_BOX = f"'<div data-aut-id=\"itemBox\"><a href=\"/item/' || {_K} || '\"><b data-aut-id=\"itemTitle\"> 2017 Used ' || p_brand || ' Swift VXI</b><br><p class=\"price-now\">₹ ' || {_SIZE} || '.5 Lakh</p><i class=\"x-location\">Adyar</i></a></div><div data-aut-id=\"itemBox\"><a href=\"/item/0\"><b class=\"title\">no price</b></a></div>'"
_ROW = f"'<ul><li class=\"ad-card\"><a href=\"https://c/x/' || {_K} || '\"><h3>2016 ' || p_brand || ' City</h3><p class=\"price\">7,500</p></a><li class=\"ad-card\"><h2>no link</h2><p class=\"price\">1</p></ul><a href=\"/item/9\">x</a>'"


@query(
    """SELECT 'p' || p_partkey AS url, p_brand AS make, CASE p_partkey % 3 WHEN 0 THEN 'Swift' ELSE 'City' END AS model, CASE p_partkey % 3 WHEN 0 THEN 'VXI' END AS variant, CASE p_partkey % 3 WHEN 0 THEN 2017 ELSE 2016 END AS year,
 CAST(CASE p_partkey % 3 WHEN 0 THEN p_size * 100000 + 50000 ELSE 7500 END AS DECIMAL(12,2)) AS price, CASE p_partkey % 3 WHEN 0 THEN 'Adyar' END AS location, CASE p_partkey % 3 WHEN 0 THEN 'https://b/item/' ELSE 'https://c/x/' END || p_partkey AS source_url FROM part WHERE p_partkey % 3 < 2"""
)
def element_cards(spark, d):
    pages = read(spark, d, "part").selectExpr(f"'p' || {_K} AS url", f"CASE p_partkey % 3 WHEN 0 THEN {_BOX} || {_ROW} WHEN 1 THEN {_ROW} ELSE '' END AS html")
    return elements.result_cards(pages, "https://b").drop("at", "image", "said")


_DETAILS_PAGE = (
    f"'<div class=\"image-box\"><img src=\"https://i/1.jpg\"><img src=\"/2.jpg\"><img src=\"https://i/placeholder.png\"><img src=\"https://i/1.jpg\"></div><figure><img src=\"https://i/a' || {_K} || '.jpg\"></figure><img src=\"https://i/9.jpg\">'"
    f" || '<div data-aut-id=\"itemDescriptionContent\"> Good &amp; <b>clean</b> </div><div class=\"seller-box\"><b class=\"the-name\">N' || {_K} || '</b></div><ul class=\"detail\"><li>Model year <b>x</b><span>2015</span></li><li>KM driven <strong>' || {_SIZE} || ',000 km</strong></li>"
    "<li>Fuel <i class=\"value\">Diesel</i></li><li>Transmission: Manual</li><li>Owner <span>2nd</span><li>Fuel <span>steam</span></ul>'"
)


@query("SELECT 'p' || p_partkey AS url, 'https://i/1.jpg https://i/a' || p_partkey || '.jpg' AS photos, 'Good & clean' AS description, 'N' || p_partkey AS seller_name, 2015 AS year, p_size * 1000 AS km_driven, 'diesel' AS fuel_type, 'manual' AS transmission, 2 AS owner_count FROM part")
def element_details(spark, d):
    pages = read(spark, d, "part").selectExpr(f"'p' || {_K} AS url", f"{_DETAILS_PAGE} AS html")
    return elements.details_pages(pages).withColumn("photos", F.array_join("photos", " "))


_LISTED_CARD = f"'<div class=\"listingCard\"><h3></h3><h2>2019 ' || p_brand || ' Swift</h2><p class=\"Price\">' || {_SIZE} || ' Lakh</p>12,300 kms Petrol AMT 2nd owner<span class=\"cityLocation\"> Adyar </span>' || CASE WHEN p_partkey % 4 = 1 THEN '<a href=\"/used-car-details/x-' || {_K} || '.htm\">x</a><img data-src=\"/i.jpg\">' ELSE '' END || '</div><div class=\"listingCard\"><h3>2019 Only</h3><p class=\"price\">5</p></div>'"
_ONE_PRODUCT = f"{_SCRIPT} || '{{\"@type\": \"Car\", \"name\": \"2018 ' || p_brand || ' City\", \"price\": 5, \"url\": \"/u\"}}</script>'"


@query(
    """SELECT 'p' || p_partkey AS page_url, p_brand AS make, CASE WHEN p_partkey % 2 = 0 THEN 'City' ELSE 'Swift' END AS model, CASE WHEN p_partkey % 2 = 0 THEN 2018 ELSE 2019 END AS year, CAST(CASE WHEN p_partkey % 2 = 0 THEN 5 ELSE p_size * 100000 END AS DECIMAL(12,2)) AS price,
 CASE WHEN p_partkey % 2 = 1 THEN 12300 END AS km_driven, CASE WHEN p_partkey % 2 = 1 THEN 'petrol' END AS fuel_type, CASE WHEN p_partkey % 2 = 1 THEN 'automatic' END AS transmission, CASE WHEN p_partkey % 2 = 1 THEN 2 END AS owner_count, CASE WHEN p_partkey % 2 = 1 THEN 'Adyar' END AS location,
 CASE WHEN p_partkey % 2 = 0 THEN 'https://b/u' WHEN p_partkey % 4 = 1 THEN 'https://b/used-car-details/x-' || p_partkey || '.htm' ELSE 'https://b/search' END AS source_url, CASE WHEN p_partkey % 4 = 1 THEN p_partkey::VARCHAR END AS source_listing_id,
 CASE WHEN p_partkey % 4 = 1 THEN 1 ELSE 0 END AS n_photos FROM part"""
)
def products_or_cards(spark, d):
    pages = read(spark, d, "part").selectExpr(f"'p' || {_K} AS url", f"{_LISTED_CARD} || CASE WHEN p_partkey % 2 = 0 THEN {_ONE_PRODUCT} ELSE '' END AS html")
    out = elements.products_or_cards(pages, "https://b", "/search", "Chennai", "source-b")
    return out.withColumn("n_photos", F.size("photos")).drop("at", "variant", "photos", "city", "source_platform")


# -- pages of posts ----------------------------------------------------------------------------

_S = "CAST(s_suppkey AS STRING)"
_PROFILE = f"'<a class=x href=/p/A' || {_S} || '/>x</a><a href=\"/about\"></a><a href=''https://s.example.com/reel/B' || {_S} || '/''></a><a href=\"/p/A' || {_S} || '/\"></a>'"


@query(
    """SELECT lower(s_name) AS handle, 0 AS position, 'https://s.example.com/p/A' || s_suppkey || '/' AS url FROM supplier
UNION ALL SELECT lower(s_name), 1, 'https://s.example.com/reel/B' || s_suppkey || '/' FROM supplier"""
)
def profile_links(spark, d):
    pages = read(spark, d, "supplier").selectExpr("lower(s_name) AS handle", f"{_PROFILE} AS html")
    return posts.profile_links(pages, "https://s.example.com")


_CDN = "https://scontent.cdninstagram.com/v"
#: References in attributes, attributes in any order and quotes, an image element's src before its own set.
_POST = (
    f"'<meta content=\"5 likes - &quot;' || p_name || ' &amp; co: - 4.5L&quot;\" property=og:description><meta property=\"og:image\" content=\"{_CDN}/1.jpg?x=1&amp;ig_cache_key=A' || {_S} || '\"><link as=\"image\" rel=\"preload\" href=\"{_CDN}/2.jpg\" imagesrcset=\"{_CDN}/3.jpg 1x, {_CDN}/2.jpg?x=2 2x\">'"
    f" || '<img src=\"{_CDN}/1b.jpg?x=1&amp;ig_cache_key=A' || {_S} || '\" srcset=\"{_CDN}/s150x150/4.jpg 1x, {_CDN}/5.jpg?a=1&amp;b=2 2x\"><img src=\"{_CDN}/6.jpg\" srcset=\"{_CDN}/7.jpg 1x\"><time datetime=\"2024-03-05T10:20:30.000Z\">' || CASE WHEN s_suppkey % 2 = 0 THEN '<meta property=\"og:video\" content=\"v.mp4?a=1&amp;b=2\">' ELSE '' END || '<script>{{\"u\":\"https:\\\\/\\\\/x.fbcdn.net\\\\/v\\\\/9.jpg?a=1\\\\u0026b=2\"}}</script>'"
).replace("{{", "{").replace("}}", "}").replace("p_name", "lower(s_name)")


_PICTURES = f"'{_CDN}/1.jpg?x=1&ig_cache_key=A' || s_suppkey || ' {_CDN}/2.jpg {_CDN}/3.jpg {_CDN}/5.jpg?a=1&b=2 {_CDN}/6.jpg {_CDN}/7.jpg https://x.fbcdn.net/v/9.jpg?a=1&b=2'"


@query(
    f"""SELECT lower(s_name) AS handle, 'A' || s_suppkey AS post_id, lower(s_name) || ' & co: - 4.5L' AS caption, {_PICTURES} AS images, '2024-03-05 10:20:30' AS posted_at,
 s_suppkey % 2 = 0 AS is_reel, CASE WHEN s_suppkey % 2 = 0 THEN 'video:v.mp4?a=1&b=2' ELSE 'image:{_CDN}/1.jpg?x=1&ig_cache_key=A' || s_suppkey END AS first_media,
 CASE WHEN s_suppkey % 2 = 0 THEN '{_CDN}/1.jpg?x=1&ig_cache_key=A' || s_suppkey END AS poster, CASE WHEN s_suppkey % 2 = 0 THEN 8 ELSE 7 END AS n_media FROM supplier"""
)
def post_pages(spark, d):
    pages = read(spark, d, "supplier").selectExpr("lower(s_name) AS handle", f"'https://s.example.com/p/A' || {_S} || '/' AS url", f"{_POST} AS html")
    item, at = F.get("media", F.lit(0)), F.date_format("posted_at", "yyyy-MM-dd HH:mm:ss")
    return posts.post_pages(pages).select("handle", "post_id", "caption", F.array_join("images", " ").alias("images"), at.alias("posted_at"), "is_reel", F.concat(item["type"], F.lit(":"), item["url"]).alias("first_media"), item["poster_url"].alias("poster"), "n_media")


_O = "CAST(o_orderkey % 50 + 1 AS STRING)"
_CAR_TEXT = f"CASE o_orderkey % 5 WHEN 0 THEN '2019 Swift ' || {_O} || '.5L petrol SUV ' || {_O} || 'k km 98765 9876543210' WHEN 1 THEN 'SOLD 2015 diesel manual ' || {_O} || ',000 kms 2nd owner' WHEN 2 THEN '2020 sedan DM for price' WHEN 3 THEN 'happy new year 2024' ELSE 'booked ' || {_O} || ' lakhs lpg' END"


@query(
    f"""WITH t AS (SELECT o_orderkey, lower({_CAR_TEXT}) AS s FROM orders),
u AS (SELECT o_orderkey, s, TRY_CAST(regexp_extract(s, '\\b((?:19|20)[0-9]{{2}})\\b', 1) AS INT) AS year, CAST(round(TRY_CAST(regexp_extract(s, '([0-9]+(?:\\.[0-9]+)?)\\s*(?:lakhs?|lacs?|l)\\b', 1) AS DOUBLE) * 100000) AS DECIMAL(12,2)) AS price,
 coalesce(TRY_CAST(regexp_extract(s, '([0-9]+)\\s*k\\s*kms?\\b', 1) AS INT) * 1000, TRY_CAST(replace(regexp_extract(s, '([0-9,]+)\\s*(?:kms?|km)', 1), ',', '') AS INT)) AS km_driven,
 nullif(regexp_extract(s, '\\b(petrol|diesel|cng|electric|hybrid)\\b', 1), '') AS fuel_type, nullif(regexp_extract(s, '\\b(sedan|suv|hatchback)\\b', 1), '') AS body_type, nullif(regexp_extract(s, '[6-9][0-9]{{9}}'), '') AS seller_phone FROM t)
SELECT o_orderkey, year, price, km_driven, fuel_type, body_type, seller_phone, regexp_matches(s, '\\bsold\\b|\\bbooked\\b') AS is_sold, year IS NOT NULL AND (price IS NOT NULL OR km_driven IS NOT NULL OR fuel_type IS NOT NULL OR contains(s, 'dm for price')) AS is_car_listing FROM u"""
)
def caption_cars(spark, d):
    out = read(spark, d, "orders").selectExpr("o_orderkey", f"{_CAR_TEXT} AS s").select("o_orderkey", posts.car_in_caption(F.col("s")).alias("c"))
    return out.select("o_orderkey", *[f"c.{c}" for c in ("year", "price", "km_driven", "fuel_type", "body_type", "seller_phone", "is_sold", "is_car_listing")])


@query(
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'petrol' END AS fuel_type, CASE WHEN o_orderkey % 2 = 0 THEN 'manual' END AS transmission, o_orderkey % 3 <> 1 AND o_orderkey % 2 = 0 AS in_schema FROM orders"""
)
def record_schema(spark, d):
    rows = read(spark, d, "orders").selectExpr("o_orderkey", "CASE o_orderkey % 3 WHEN 0 THEN 'petrol' WHEN 1 THEN 'steam' END AS fuel_type", "CASE WHEN o_orderkey % 2 = 0 THEN 'manual' ELSE 'amt' END AS transmission", "CAST(NULL AS STRING) AS body_type")
    return posts.checked_records(rows).select("o_orderkey", "fuel_type", "transmission", "in_schema")


@query(
    f"""WITH {SOURCES_SQL} SELECT s.id, 'Swift' AS model, CASE WHEN s.id % 2 = 0 THEN CAST(5000 AS DECIMAL(12,2)) END AS price, CASE WHEN s.id % 2 = 0 THEN 'priced' ELSE 'price_on_request' END AS listing_status,
 coalesce(CASE WHEN platform = 'social' THEN city END, 'Madurai') AS city, coalesce(CASE WHEN platform = 'social' THEN display_name END, '@' || handle) AS seller_name, CASE WHEN platform = 'social' THEN dealer_id END AS dealer_id, 'P' || s.id AS source_listing_id
 FROM sources s WHERE s.id % 4 <> 1"""
)
def post_listings(spark, d):
    every = sources(spark, d)
    records = every.selectExpr(
        "handle", "'https://s.example.com/p/P' || CAST(id AS STRING) || '/' AS url", "'Maruti' AS make", "'Swift' AS model", "CASE WHEN id % 4 = 1 THEN NULL ELSE 2019 END AS year",
        "CASE WHEN id % 2 = 0 THEN CAST(5000 AS DECIMAL(12,2)) END AS price", "true AS is_car_listing", "false AS is_sold",
    )
    out = posts.listings_of_posts(records, every.where("platform = 'social'"), "Madurai")
    return out.select(T.trailing_number(F.col("source_listing_id")).cast("long").alias("id"), "model", "price", "listing_status", "city", "seller_name", "dealer_id", "source_listing_id")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'url:u' || s_suppkey ELSE 'base64:' || base64(encode('d' || s_suppkey)) END || '|base64:' || base64(encode('e')) AS parts FROM supplier")
def images_to_read(spark, d):
    rows = read(spark, d, "supplier").selectExpr("s_suppkey", "array('a', 'b', 'c') AS images", f"array(CASE WHEN s_suppkey % 2 = 0 THEN 'u' || {_S} END, NULL, NULL) AS stored", f"array('d' || {_S}, 'e', 'f') AS data")
    parts = posts.images_to_read(F.col("images"), F.col("stored"), F.col("data"))
    return rows.select("s_suppkey", F.array_join(F.transform(parts, lambda p: F.concat_ws(":", p["kind"], p["value"])), "|").alias("parts"))


# -- quality -----------------------------------------------------------------------------------

_AS_OF = 1999
_PRICE_SAID = "CASE WHEN price = floor(price) THEN CAST(CAST(price AS BIGINT) AS VARCHAR) ELSE rtrim(CAST(price AS VARCHAR), '0') END"
_CHECKED = f"""tried AS (SELECT * REPLACE (CASE WHEN id % 23 = 0 THEN ' ' ELSE make END AS make, CASE WHEN id % 29 = 0 THEN NULL ELSE model END AS model, CASE WHEN id % 31 = 0 THEN NULL ELSE year END AS year) FROM listings),
bad AS (SELECT id, count(*) FILTER (WHERE NOT (regexp_matches(url, '^https?://.+') AND type IN ('image', 'video'))) AS n FROM media GROUP BY id),
blocked AS (SELECT t.*, list_filter([
  CASE WHEN trim(coalesce(make, '')) = '' THEN 'make is empty' END, CASE WHEN trim(coalesce(model, '')) = '' THEN 'model is empty' END,
  CASE WHEN price NOT BETWEEN 10000 AND 100000000 THEN 'price ' || {_PRICE_SAID} || ' outside ₹10000–₹100000000 range' END,
  CASE WHEN year IS NULL THEN 'year is missing' WHEN year NOT BETWEEN 1990 AND 2000 THEN 'year ' || year || ' outside 1990–2000 range' END,
  CASE WHEN km_driven NOT BETWEEN 0 AND 2000000 THEN 'kmDriven ' || km_driven || ' outside 0–2000000 range' END], lambda x: x IS NOT NULL) AS blocking, coalesce(n, 0) AS n_bad FROM tried t LEFT JOIN bad USING (id)),
checked AS (SELECT *, len(blocking) = 0 AS valid, list_concat(blocking, CASE WHEN n_bad > 0 THEN [n_bad || ' invalid media item(s) filtered'] ELSE [] END) AS errors FROM blocked)"""
_ALL = f"WITH {LISTINGS_SQL}, {MEDIA_SQL}, {_CHECKED} "


def _checked(spark, d):
    k = F.col("id")
    tried = with_media(listings(spark, d)).withColumns({"make": F.when(k % 23 == 0, " ").otherwise(F.col("make")), "model": F.when(k % 29 != 0, F.col("model")), "year": F.when(k % 31 != 0, F.col("year"))})
    return Q.validated(tried, _AS_OF)


@query(_ALL + "SELECT id, valid, array_to_string(errors, '; ') AS errors, media_count - n_bad AS n_media FROM checked")
def validate(spark, d):
    return _checked(spark, d).select("id", "valid", F.array_join("errors", "; ").alias("errors"), F.size("media").cast("bigint").alias("n_media"))


@query(_ALL + "SELECT source_url, source_url || ': ' || array_to_string(errors, ', ') AS reason FROM checked WHERE NOT valid")
def reject_reasons(spark, d):
    return Q.reject_reasons(_checked(spark, d), "source_url")


@query(_ALL + "SELECT count(*) AS found, count(*) FILTER (WHERE valid) AS accepted, count(*) FILTER (WHERE NOT valid) AS rejected, CASE WHEN count(*) FILTER (WHERE NOT valid) > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status FROM checked")
def run_summary(spark, d):
    return Q.run_summary(_checked(spark, d))


_SECTION = "CASE WHEN event_type = 'click' THEN 'error' ELSE 'rejection' END"


@query(
    """SELECT user_id AS run, concat_ws(chr(10) || chr(10), string_agg('e' || event_id, chr(10) ORDER BY event_id) FILTER (WHERE event_type = 'click'),
 'Validation rejections:' || chr(10) || string_agg('e' || event_id, chr(10) ORDER BY event_id) FILTER (WHERE event_type <> 'click')) AS message FROM events WHERE event_id % 3 = 0 GROUP BY user_id"""
)
def error_messages(spark, d):
    rows = read(spark, d, "events").where("event_id % 3 = 0")
    return Q.error_message(rows.selectExpr("user_id AS run", f"{_SECTION} AS section", "event_id AS position", "'e' || CAST(event_id AS STRING) AS line"))


_COVERED = {"make": "make <> ''", "price": "price <> 0", "km_driven": "km_driven <> 0", "fuel_type": "fuel_type <> ''", "description": "description <> ''", "city": "city <> ''", "media": "media_count > 0"}


@query(f"WITH {LISTINGS_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER (WHERE {w}) AS n_filled, (count(*) FILTER (WHERE {w}) * 200 + count(*)) // (2 * count(*)) AS percent FROM listings" for c, w in _COVERED.items()))
def coverage(spark, d):
    return Q.coverage(with_media(listings(spark, d)), list(_COVERED))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return Q.duplicate_keys(read(spark, d, "events"), "user_id")


@query(
    f"""WITH {LISTINGS_SQL} SELECT unnest(['make is filled', 'price is filled', 'year in 1990-2027', 'price in 0-1e8', 'source_url is an address', 'source_url is unique', 'city is FRANCE']) AS "check",
 unnest([count(*) FILTER (WHERE coalesce(make, '') = ''), count(*) FILTER (WHERE coalesce(price, 0) = 0), count(*) FILTER (WHERE year IS NULL OR year NOT BETWEEN 1990 AND 2027), count(*) FILTER (WHERE price <= 0 OR price > 100000000),
 count(*) FILTER (WHERE NOT starts_with(source_url, 'http')), count(*) - count(DISTINCT source_url), count(*) FILTER (WHERE city <> 'FRANCE')]) AS n_failed FROM listings"""
)
def source_expectations(spark, d):
    return Q.expectations(listings(spark, d), ["make", "price"], "source_url", {"city": "FRANCE"})


@query(f"WITH {LISTINGS_SQL} SELECT min(price) AS min_price, max(price) AS max_price, min(year) AS min_year, max(year) AS max_year, bool_and(is_active OR id % 10 = 0) AS every_flag FROM listings")
def value_ranges(spark, d):
    return listings(spark, d).agg(F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.min("year").alias("min_year"), F.max("year").alias("max_year"), F.every(F.col("is_active") | (F.col("id") % 10 == 0)).alias("every_flag"))


@query("SELECT 'source-a' AS source, count(*) > 0 AS healthy FROM part UNION ALL SELECT 'source-b', false")
def health_check(spark, d):
    part = read(spark, d, "part")
    rows = [("source-a", L.is_healthy(part)), ("source-b", L.is_healthy(part.where("p_partkey < 0")))]
    return spark.createDataFrame(rows, "source string, healthy boolean")


# -- runs and logs -----------------------------------------------------------------------------


@query(
    """SELECT user_id AS run, min(ts) AS started_at, max(ts) AS last_at, arg_max(CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'failed' ELSE 'running' END, (ts, event_id)) AS status FROM events GROUP BY user_id"""
)
def run_ledger(spark, d):
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "click", "failed").otherwise("running")
    entries = read(spark, d, "events").select(F.col("user_id").alias("run"), "ts", "event_id", status.alias("status"))
    return L.current(entries, "run", "ts").select("run", "started_at", "last_at", "status")


@query(
    "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 7 ELSE event_id % 10 + event_id % 3 END AS total_tokens, event_id % 9 <> 0 AS success FROM events"
)
def usage_log(spark, d):
    calls = read(spark, d, "events").selectExpr("event_id", "event_id % 10 AS input_tokens", "event_id % 3 AS output_tokens", "CASE WHEN event_id % 4 = 0 THEN 7L END AS total_tokens", "CASE WHEN event_id % 9 = 0 THEN 'timeout' END AS error_message")
    return L.usage(calls).select("event_id", "total_tokens", "success")


# -- merges ------------------------------------------------------------------------------------

_LOG = "log AS (SELECT event_type, user_id, ts, event_id, value AS price, CASE WHEN event_type = 'purchase' THEN 'sold' ELSE 'available' END AS status, CASE WHEN event_id % 3 = 0 THEN ts END AS sold_at FROM events)"
_KEYS = ["event_type", "user_id"]
_SHAPE = dict(keys=_KEYS, seq=["ts", "event_id"], first=["scraped_at"], last=["price", "status"], last_known=["sold_at"])


def _log(spark, d):
    status = F.when(F.col("event_type") == "purchase", "sold").otherwise("available")
    return read(spark, d, "events").select("event_type", "user_id", "ts", "event_id", F.col("value").alias("price"), F.col("ts").alias("scraped_at"), status.alias("status"), F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("sold_at"))


_FOLD_SQL = """SELECT event_type, user_id, max(CASE WHEN f = 1 THEN ts END) AS scraped_at, max(CASE WHEN l = 1 THEN price END) AS price, max(CASE WHEN l = 1 THEN status END) AS status, max(CASE WHEN k = 1 THEN sold_at END) AS sold_at{more}
FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS f, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS l,
 row_number() OVER (PARTITION BY event_type, user_id ORDER BY sold_at IS NULL, ts DESC, event_id DESC) AS k FROM log) GROUP BY event_type, user_id"""


@query(f"WITH {_LOG} {_FOLD_SQL.format(more='')}")
def upsert_fold(spark, d):
    return U.fold(_log(spark, d), **_SHAPE)


@query(f"WITH {_LOG} {_FOLD_SQL.format(more=', bool_and(event_id % 2 = 1) AS is_new')}".replace("PARTITION BY event_type, user_id ORDER BY ", "PARTITION BY event_type, user_id ORDER BY event_id % 2, ").replace("ORDER BY event_id % 2, ts DESC", "ORDER BY event_id % 2 DESC, ts DESC").replace("ORDER BY event_id % 2, sold_at IS NULL", "ORDER BY sold_at IS NULL, event_id % 2 DESC"))
def upsert_into_existing(spark, d):
    log = _log(spark, d)
    return U.fold_into(U.fold(log.where("event_id % 2 = 0"), **_SHAPE), log.where("event_id % 2 = 1"), **_SHAPE)


@query("SELECT count(*) FILTER (WHERE is_new) AS n_new, count(*) FILTER (WHERE NOT is_new) AS n_updated FROM (SELECT event_type, user_id, bool_and(event_id % 2 = 1) AS is_new FROM events GROUP BY 1, 2 HAVING bool_or(event_id % 2 = 1))")
def upsert_counts(spark, d):
    log = _log(spark, d)
    batch = log.where("event_id % 2 = 1")
    return U.merge_counts(U.fold_into(U.fold(log.where("event_id % 2 = 0"), **_SHAPE), batch, **_SHAPE), batch, _KEYS)


@query("SELECT user_id AS post, coalesce(min(ts) FILTER (WHERE event_id % 3 = 0), min(ts)) AS created_at, max(ts) AS last_checked_at, arg_max(event_type = 'purchase', (ts, event_id)) AS is_car_listing, user_id % 2 = 0 AS is_reel FROM events GROUP BY user_id")
def posts_upsert(spark, d):
    reel = T.is_reel(F.concat(F.when(F.col("user_id") % 2 == 0, "https://s/reel/").otherwise("https://s/p/"), F.col("user_id").cast("string")))
    log = read(spark, d, "events").select(F.col("user_id").alias("post"), "ts", "event_id", F.col("ts").alias("created_at"), F.col("ts").alias("last_checked_at"), (F.col("event_type") == "purchase").alias("is_car_listing"), reel.alias("is_reel"))
    shape = dict(keys=["post"], seq=["ts", "event_id"], first=["created_at"], last=["last_checked_at", "is_car_listing", "is_reel"])
    return U.fold_into(U.fold(log.where("event_id % 3 = 0"), **shape), log, **shape).drop("is_new")


@query("SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey + 23, r_name FROM region WHERE r_regionkey + 23 NOT IN (SELECT n_nationkey FROM nation)")
def insert_if_absent(spark, d):
    target = read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return U.insert_absent(target, read(spark, d, "region").select((F.col("r_regionkey") + 23).alias("k"), F.col("r_name").alias("name")), ["k"])


@query("SELECT r_name || '-' || n AS slug, coalesce(CASE WHEN n = 0 THEN r_regionkey END, r_regionkey + 100)::BIGINT AS id, n <> 0 AS is_new FROM region, (VALUES (0), (1)) v(n)")
def ensure_keys(spark, d):
    region = read(spark, d, "region")
    target = region.select(F.concat("r_name", F.lit("-0")).alias("slug"), F.col("r_regionkey").cast("long").alias("id"))
    asked = region.select(F.explode(F.array(F.lit("-0"), F.lit("-1"), F.lit("-1"))).alias("n"), "r_name", "r_regionkey").select(F.concat("r_name", "n").alias("slug"), (F.col("r_regionkey") + 100).cast("long").alias("id"))
    return U.ensured(target, asked, "slug", "id")


@query(f"WITH {LISTINGS_SQL} SELECT id, coalesce(CASE WHEN id % 2 = 0 THEN dealer_id END, CASE source_platform WHEN 'source-0' THEN 900 WHEN 'source-1' THEN 901 END)::BIGINT AS dealer_id FROM listings")
def fallback_source(spark, d):
    own = listings(spark, d).select("id", F.when(F.col("id") % 2 == 0, F.col("dealer_id")).alias("dealer_id"), "source_platform")
    known = spark.createDataFrame([("source-0", "source-0", 900), ("source-1", "source-1", 901), ("source-2", "other", 902)], "platform string, handle string, dealer_id bigint")
    return U.fallback_ids(own, known, ["dealer_id"]).select("id", "dealer_id")


# -- changes of stored tables ------------------------------------------------------------------


def _tables(spark, d):
    own = sources(spark, d).selectExpr("id", "platform", "handle", "display_name", "city", "CAST(NULL AS STRING) AS dealer_slug", "CAST(NULL AS STRING) AS source_type")
    there = own.where("id % 3 = 0 AND id % 2 = 0").select(M.source_slug().alias("slug"), F.lit("kept").alias("name"), F.lit("dealer").alias("kind"), F.lit(None).cast("string").alias("city"))
    there = there.unionByName(spark.createDataFrame([("source-a", "Source A", "marketplace", None)], "slug string, name string, kind string, city string"))
    return {"sources": own, "dealers": there.withColumn("profile_url", F.when(F.col("slug").endswith("6"), "given"))}


_STEPS = f"""{SOURCES_SQL}, own AS (SELECT *, lower(regexp_replace(coalesce(display_name, handle), '[^a-zA-Z0-9]+', '-', 'g')) AS slug FROM sources),
had AS (SELECT slug, 'kept' AS name, 'dealer' AS kind, CAST(NULL AS VARCHAR) AS city FROM own WHERE id % 3 = 0 AND id % 2 = 0 UNION ALL SELECT 'source-a', 'Source A', 'marketplace', NULL),
all_dealers AS (SELECT *, ends_with(slug, '6') AS given FROM had UNION ALL SELECT slug, coalesce(display_name, handle), 'dealer', city, false FROM own WHERE platform NOT IN ('source-a', 'source-b', 'source-c') AND slug NOT IN (SELECT slug FROM had))"""


@query(f"WITH {_STEPS} SELECT a.slug, a.name, a.kind, a.city, CASE WHEN given THEN 'given' WHEN o.handle IS NOT NULL THEN 'https://www.instagram.com/' || o.handle || '/' END AS profile_url FROM all_dealers a LEFT JOIN own o ON o.slug = a.slug AND o.platform = 'social'")
def update_from_slug(spark, d):
    given = _tables(spark, d)
    given["dealers"] = given["dealers"].drop("profile_url")
    made = M.dealers_from_sources(given)
    kept = _tables(spark, d)["dealers"].select("slug", F.col("profile_url").alias("profile_url"))
    made["dealers"] = made["dealers"].join(kept, "slug", "left")
    return M.profile_addresses(made)["dealers"]


@query(
    f"""WITH {_STEPS} SELECT o.id, a.slug AS dealer_slug, CASE WHEN a.slug IS NULL THEN NULL WHEN platform = 'social' THEN 'instagram_dealer' WHEN platform = 'source-a' THEN 'marketplace_aggregator' ELSE 'other' END AS source_type
FROM own o LEFT JOIN had a ON a.slug = CASE WHEN platform = 'source-a' THEN platform ELSE o.slug END"""
)
def update_from_case(spark, d):
    return M.sources_to_dealers(_tables(spark, d))["sources"].select("id", "dealer_slug", "source_type")


@query(f"WITH {_STEPS} SELECT (SELECT count(*) FROM all_dealers) AS dealers, (SELECT count(*) FROM own o WHERE CASE WHEN platform = 'source-a' THEN platform ELSE slug END IN (SELECT slug FROM all_dealers)) AS placed, '0001_dealers_from_sources,0002_profile_addresses,0003_sources_to_dealers' AS steps")
def migration_journal(spark, d):
    given = _tables(spark, d)
    given["dealers"] = given["dealers"].drop("profile_url")
    now, first = M.migrated({k: v for k, v in given.items()}, {"0002_profile_addresses", "0003_sources_to_dealers"})
    now["dealers"] = now["dealers"].withColumn("profile_url", F.lit(None).cast("string"))
    now, rest = M.migrated(now, set(first))
    counted = now["dealers"].agg(F.count(F.lit(1)).alias("dealers")).crossJoin(now["sources"].agg(F.count("dealer_slug").alias("placed")))  # one row each
    return counted.withColumn("steps", F.lit(",".join(first + rest)))


@query("SELECT o_orderkey, CAST(o_orderkey % 4 AS INT) AS n, CASE WHEN o_orderkey % 4 > 1 THEN 'p1:image' END AS second FROM orders")
def photos_to_media(spark, d):
    rows = read(spark, d, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 4 > 0 THEN transform(sequence(0, CAST(o_orderkey % 4 - 1 AS INT)), i -> 'p' || CAST(i AS STRING)) END AS photos")
    media = M.photos_to_media(rows)
    return media.select("o_orderkey", F.size("media").alias("n"), F.concat_ws(":", F.get("media", F.lit(1))["url"], F.get("media", F.lit(1))["type"]).alias("second")).withColumn("second", F.nullif("second", F.lit("")))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END AS o_custkey, o_custkey % 7 = 0 AS was_dangling FROM orders")
def foreign_keys(spark, d):
    orders, kept = read(spark, d, "orders").select("o_orderkey", "o_custkey"), read(spark, d, "customer").where("c_custkey % 7 <> 0")
    bad = M.dangling(orders, kept, "o_custkey", "c_custkey").select("o_orderkey", F.lit(True).alias("b"))
    return M.set_null_where_dangling(orders, kept, "o_custkey", "c_custkey").join(bad, "o_orderkey", "left").select("o_orderkey", "o_custkey", F.coalesce("b", F.lit(False)).alias("was_dangling"))


# -- incremental work --------------------------------------------------------------------------


@query("SELECT event_id, user_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def seen_first(spark, d):
    return I.first_seen(read(spark, d, "events").select("event_id", "user_id", "event_type", "ts"), "user_id", ["ts", "event_id"])


_CHUNKED = "c AS (SELECT event_id, user_id, CAST((r - 1) // 6 AS INT) AS chunk, CAST((r - 1) % 6 + 1 AS INT) AS index FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events))"


def _chunked(spark, d):
    return I.chunk_numbers(read(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"]).drop("ts")


@query(f"WITH {_CHUNKED} SELECT * FROM c")
def chunk_index(spark, d):
    return _chunked(spark, d)


@query(f"WITH {_CHUNKED} SELECT event_id, user_id, chunk, index, CASE WHEN index % 3 <> 0 THEN CASE WHEN index % 2 = 0 THEN 'again' ELSE 'once' END END AS value, index % 3 <> 0 AS is_car_listing FROM c")
def chunk_align(spark, d):
    items = _chunked(spark, d)
    given = items.where("index % 3 <> 0").select("user_id", "chunk", "index", F.lit("once").alias("value"), F.lit(True).alias("is_car_listing"), F.lit(0).alias("pos"))
    again = given.where("index % 2 = 0").withColumns({"value": F.lit("again"), "pos": F.lit(1)})
    beyond = given.withColumns({"index": F.lit(9), "pos": F.lit(2)})
    return I.aligned(items, given.unionByName(again).unionByName(beyond), ("user_id", "chunk", "index"), ("value", "is_car_listing"), empty=I.EMPTY_RECORD).drop("answered")


_POST_TEXT = "CASE WHEN {id} % 4 = 0 THEN '' WHEN {id} % 4 = 1 THEN '2019 Swift 4.5L petrol' ELSE 'good morning' END"


@query(
    f"""WITH {_CHUNKED}, a AS (SELECT c.*, e.ts, bool_or(c.event_id % 4 <> 0) OVER (PARTITION BY c.user_id, chunk) AS asked FROM c JOIN events e USING (event_id)),
b AS (SELECT *, asked AND index <> 4 AND event_id % 4 = 1 AS car FROM a)
SELECT event_id, user_id, chunk, index, car AS is_car_listing, CASE WHEN car THEN 2019 END AS year, CASE WHEN car THEN 450000.00::DECIMAL(12,2) END AS price FROM b"""
)
def batch_extraction(spark, d):
    """Posts through chunks, an extractor that leaves out every fourth of a chunk, and back; what a chunk without content says is never asked."""
    items = read(spark, d, "events").select("event_id", "user_id", "ts", F.expr(_POST_TEXT.format(id="event_id")).alias("caption"), F.lit(0).alias("n_images"))

    def ask(chunks):
        said = chunks.where("index <> 4").select("user_id", "chunk", "index", F.lit(0).alias("pos"), posts.car_in_caption(F.col("caption")).alias("c"))
        return said.select("user_id", "chunk", "index", "pos", "c.is_car_listing", "c.year", "c.price")

    return I.extracted(items, "user_id", ["ts", "event_id"], "caption", "n_images", ask, ("is_car_listing", "year", "price")).select("event_id", "user_id", "chunk", "index", "is_car_listing", "year", "price")


@query(f"WITH {_CHUNKED} SELECT user_id, chunk, count(*) AS n_items, sum(event_id % 3)::BIGINT AS n_images FROM c GROUP BY 1, 2 HAVING bool_or(event_id % 2 = 0 OR event_id % 3 > 0)")
def chunk_send(spark, d):
    items = _chunked(spark, d).withColumns({"caption": F.when(F.col("event_id") % 2 == 0, "text").otherwise(""), "n_images": F.col("event_id") % 3})
    return I.chunks_to_send(items, ["user_id", "chunk"], F.col("caption"), "n_images")


@query("SELECT event_id, user_id, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r <= 8")
def top_n_per_group(spark, d):
    return I.top_n(read(spark, d, "events"), "user_id", [F.col("ts").desc(), F.col("event_id")], 8).select("event_id", "user_id", "rank")


@query("SELECT page, n_rows FROM (SELECT n_nationkey + 1 AS page, (n_nationkey * 7 + 3) % 11 AS n_rows FROM nation) p WHERE page < (SELECT min(n_nationkey + 1) FROM nation WHERE (n_nationkey * 7 + 3) % 11 = 0)")
def page_early_stop(spark, d):
    return I.until_empty(read(spark, d, "nation").selectExpr("n_nationkey + 1 AS page", "(n_nationkey * 7 + 3) % 11 AS n_rows"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE 2000 END AS year, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN 'detail' ELSE 'card' END AS photos FROM part"""
)
def list_detail(spark, d):
    part = read(spark, d, "part")
    cards = part.selectExpr("p_partkey", "2000 AS year", "array('card') AS photos")
    details = part.where("p_partkey % 3 = 0").selectExpr("p_partkey", "p_size AS year", "CASE WHEN p_partkey % 2 = 0 THEN array('detail') ELSE CAST(array() AS ARRAY<STRING>) END AS photos")
    return I.enriched(cards, details, "p_partkey", ["year", "photos"]).withColumn("photos", F.array_join("photos", " "))


@query("SELECT 'source-a' AS source, p_partkey AS k FROM part UNION ALL SELECT 'source-b', s_suppkey FROM supplier UNION ALL SELECT 'source-b', s_suppkey FROM supplier")
def source_union(spark, d):
    part = read(spark, d, "part").select(F.lit("source-a").alias("source"), F.col("p_partkey").alias("k"))
    other = read(spark, d, "supplier").select(F.lit("source-b").alias("source"), F.col("s_suppkey").alias("k"))
    return part.unionByName(other).unionByName(other)


_CUTOFF = "WITH c AS (SELECT user_id, max(ts) AS last_checked_at FROM events GROUP BY user_id) SELECT c_custkey AS user_id FROM customer WHERE c_custkey {how} (SELECT user_id FROM c WHERE last_checked_at >= TIMESTAMP '2024-01-30' - INTERVAL 48 HOURS)"


def _candidates(spark, d):
    checked = read(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_checked_at"))
    return read(spark, d, "customer").select(F.col("c_custkey").alias("user_id")), checked


@query(_CUTOFF.format(how="NOT IN"))
def recheck_antijoin(spark, d):
    return I.not_recent(*_candidates(spark, d), "user_id", "2024-01-30 00:00:00")


@query(_CUTOFF.format(how="IN"))
def recheck_semijoin(spark, d):
    return I.checked_since(*_candidates(spark, d), "user_id", "2024-01-30 00:00:00")


@query(
    """WITH RECURSIVE p AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id
UNION ALL SELECT p.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = p.user_id AND e.ts > p.ts + INTERVAL 48 HOURS) FROM p WHERE p.ts IS NOT NULL)
SELECT e.event_id, e.user_id, e.ts, p.ts IS NOT NULL AS processed FROM events e LEFT JOIN (SELECT DISTINCT * FROM p WHERE ts IS NOT NULL) p ON e.user_id = p.user_id AND e.ts = p.ts"""
)
def recheck_greedy(spark, d):
    return I.greedy_recheck(read(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts")


@query(f"WITH {DEALERS_SQL}, {SOURCES_SQL} SELECT s.id, coalesce(g.city, 'Chennai') AS city, coalesce(s.display_name, '@' || s.handle) AS seller_name FROM sources s LEFT JOIN dealers g ON g.id = s.dealer_id AND g.is_active")
def handle_lookup(spark, d):
    known = dealers(spark, d).where("is_active").select(F.col("id").alias("__id"), F.col("city").alias("__city"))
    out = sources(spark, d).join(known, F.col("dealer_id") == F.col("__id"), "left")
    return out.select("id", F.coalesce("__city", F.lit("Chennai")).alias("city"), F.coalesce("display_name", F.concat(F.lit("@"), "handle")).alias("seller_name"))

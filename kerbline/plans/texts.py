"""Parsing of titles, prices, distances, addresses and captured text. Inputs are written once, as SQL that
Spark and the checking engine both read; the checking SQL parses the same texts by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.functions import text as T
from kerbline.plans.registry import query
from kerbline.sources import posts
from kerbline.sources.marketplace import LISTINGS_SQL, listings, read


def _shapes(key: str, *shapes: str) -> str:
    """One of the shapes for each row, by its key."""
    return f"CASE {key} % {len(shapes)} " + " ".join(f"WHEN {k} THEN {s}" for k, s in enumerate(shapes)) + " END"


_N = "CAST(p_size AS STRING)"
_PRICE = _shapes("p_partkey", f"'₹ ' || {_N} || '.5 Lakh'", f"{_N} || ',50,000'", f"{_N} || '.2 Cr'", f"{_N} || '.5L'", f"'Rs.' || {_N} || '.5Lakh'", "'DM for price'", "''", f"{_N} || '.2.3 lac'", f"' ' || {_N} || ' crore only'", f"'price ' || {_N}")
_LEAD = "TRY_CAST(regexp_extract({x}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)') AS DOUBLE)"


@query(
    f"""WITH t AS (SELECT p_partkey, regexp_replace(lower({_PRICE}), '[₹,\\s]', '', 'g') AS x FROM part),
u AS (SELECT *, {_LEAD.format(x="regexp_extract(x, '([0-9.]+)(?:lakh|lac)', 1)")} AS lakh, {_LEAD.format(x="regexp_extract(x, '([0-9.]+)(?:crore|cr)', 1)")} AS crore FROM t)
SELECT p_partkey, coalesce(round(lakh * 100000), round(crore * 10000000), {_LEAD.format(x='x')}) AS price FROM u"""
)
def parse_price(spark, d):
    return read(spark, d, "part").selectExpr("p_partkey", f"{_PRICE} AS t").select("p_partkey", T.parse_indian_price(F.col("t")).alias("price"))


_KM = _shapes("p_partkey", f"{_N} || ',345 km'", f"'run ' || {_N} || ' 000'", "'none'", f"{_N} || '.6'", f"'{{' || {_N} || '}}nd owner'")


@query(
    f"""WITH t AS (SELECT p_partkey, {_KM} AS t FROM part)
SELECT p_partkey, CAST(round({_LEAD.format(x="regexp_extract(regexp_replace(t, '[,\\s]', '', 'g'), '[0-9.]+')")}) AS INT) AS km, TRY_CAST(regexp_extract(t, '[0-9]+') AS INT) AS owners FROM t"""
)
def parse_km(spark, d):
    t = F.col("t")
    return read(spark, d, "part").selectExpr("p_partkey", f"{_KM} AS t").select("p_partkey", T.parse_km(t).alias("km"), T.parse_owner_count(t).alias("owners"))


_YEAR = "CAST(1985 + p_partkey % 40 AS STRING)"
_TITLE = _shapes("p_partkey", f"{_YEAR} || ' ' || p_brand || ' ' || p_name || ' 2020'", "p_brand", f"{_YEAR} || '  Used ' || p_brand || ' 800 (AC) for  sale'", "''", f"'Focused ' || p_brand || ' {{VXI}} ' || {_YEAR}", f"'secondhand ' || p_name || ' [' || p_type || '] pre owned ' || {_YEAR} || ' 1999'", f"'pre-owned ' || p_brand || ' ' || {_YEAR} || 'x'")


def _title_sql(year: str, rest: str) -> str:
    return f"""WITH t AS (SELECT p_partkey, {_TITLE} AS t FROM part), u AS (SELECT p_partkey, regexp_extract(t, '\\b{year}\\b') AS y, regexp_replace(t, '\\b{year}\\b', '') AS t FROM t),
v AS (SELECT p_partkey, y, list_filter(string_split_regex({rest}, '\\s+'), lambda x: x <> '') AS w FROM u)
SELECT p_partkey, TRY_CAST(y AS INT) AS year, w[1] AS make, w[2] AS model, CASE WHEN len(w) > 2 THEN array_to_string(w[3:], ' ') END AS variant FROM v"""


@query(_title_sql("20[0-9]{2}", "t"))
def parse_title_a(spark, d):
    return read(spark, d, "part").selectExpr("p_partkey", f"{_TITLE} AS t").select("p_partkey", T.parse_title(F.col("t")).alias("t")).select("p_partkey", "t.*")


@query(_title_sql("(?:19|20)[0-9]{2}", "regexp_replace(regexp_replace(t, '\\b(?:for\\s+sale|used|second\\s*hand|pre\\s*owned)\\b', '', 'gi'), '[\\[\\](){}]', '', 'g')"))
def parse_title_b(spark, d):
    return read(spark, d, "part").selectExpr("p_partkey", f"{_TITLE} AS t").select("p_partkey", T.parse_title(F.col("t"), wide=True).alias("t")).select("p_partkey", "t.*")


@query(
    "SELECT p_partkey, nullif(trim(p_type || ' x'), '') AS variant FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, NULL FROM part WHERE p_partkey % 2 = 1"
)
def variant_of_name(spark, d):
    c = F.col
    name = F.when(c("p_partkey") % 2 == 0, F.concat(c("p_type"), F.lit(" 2019 "), c("p_brand"), F.lit(" "), F.lit("Modelo"), F.lit(" x"))).otherwise(F.concat(F.lit(" 2019 "), c("p_brand"), F.lit(" Modelo")))
    found = T.variant_of(name, F.lit(2019), c("p_brand"), F.lit("Modelo"))
    return read(spark, d, "part").select("p_partkey", F.regexp_replace(found, r"\s+", " ").alias("variant"))


@query("SELECT c_custkey, regexp_replace(lower(regexp_replace('(' || c_name || ')!', '[^a-zA-Z0-9]+', '-', 'g')), '^-|-$', '', 'g') AS slug, lower(regexp_replace('(' || c_name || ')!', '[^a-zA-Z0-9]+', '-', 'g')) AS slug_untrimmed FROM customer")
def slugs(spark, d):
    name = F.concat(F.lit("("), "c_name", F.lit(")!"))
    return read(spark, d, "customer").select("c_custkey", T.slug(name).alias("slug"), T.slug_untrimmed(name).alias("slug_untrimmed"))


@query(
    f"""WITH {LISTINGS_SQL} SELECT id, sha256(make || '|' || model || '|' || year || '|' || coalesce(CASE WHEN price = floor(price) THEN CAST(CAST(price AS BIGINT) AS VARCHAR) ELSE rtrim(CAST(price AS VARCHAR), '0') END, 'null') || '|' || source_url) AS hash,
 CASE WHEN price IS NULL THEN 'price_on_request' ELSE 'priced' END AS listing_status, CASE WHEN id % 5 = 0 THEN scraped_at WHEN sale_status = 'sold' THEN TIMESTAMP '2024-01-30' END AS sold_at FROM listings"""
)
def content_hash(spark, d):
    c = F.col
    given, now = F.when(c("id") % 5 == 0, c("scraped_at")), F.lit("2024-01-30").cast("timestamp_ntz")
    return listings(spark, d).select(
        "id", T.content_hash(c("make"), c("model"), c("year"), c("price"), c("source_url")).alias("hash"), T.listing_status(F.lit(None).cast("string"), c("price")).alias("listing_status"), T.sold_at(given, c("sale_status"), now).alias("sold_at")
    )


_KEY = "CAST(o_orderkey AS STRING)"
_URL = _shapes(
    "o_orderkey", f"'https://a.example.com/buy-' || lpad({_KEY}, 9, '0') || '/'", f"'https://b.example.com/used-car-details/x-' || {_KEY} || '.htm'", f"'https://c.example.com/item/' || {_KEY}",
    f"'https://s.example.com/p/Ab' || {_KEY} || '/'", f"'https://s.example.com/reel/R' || {_KEY} || '/?x=1'", "'https://d.example.com/'",
)


@query(
    f"""WITH t AS (SELECT o_orderkey, {_URL} AS u FROM orders)
SELECT o_orderkey, nullif(regexp_extract(u, '-([0-9]{{8,}})/?$', 1), '') AS a, nullif(regexp_extract(u, '/used-car-details/[^/]*?-([0-9]+)\\.htm', 1), '') AS b, nullif(regexp_extract(u, '([0-9]+)$', 1), '') AS c,
 CASE WHEN contains(u, '/p/') THEN replace(split_part(u, '/p/', 2), '/', '') END AS d,
 coalesce(nullif(regexp_extract(u, '/(?:p|reel)/([^/?]+)', 1), ''), list_filter(string_split(u, '/'), lambda s: s <> '')[-1]) AS post, contains(u, '/reel/') AS reel FROM t"""
)
def listing_ids(spark, d):
    u = F.col("u")
    out = read(spark, d, "orders").selectExpr("o_orderkey", f"{_URL} AS u")
    return out.select("o_orderkey", T.listing_id(u).alias("a"), T.details_page_id(u).alias("b"), T.trailing_number(u).alias("c"), T.post_path_id(u).alias("d"), T.post_id(u).alias("post"), T.is_reel(u).alias("reel"))


_HREF = _shapes("o_orderkey", f"'http://x.example.com/' || {_KEY} || '/a.jpg?ig_cache_key=K' || {_KEY} || '&b=1#f'", f"'/rel/' || {_KEY}", f"'rel/' || {_KEY} || '/?page=2&search=x&minPrice=&sortBy=year'", "''", "'https://y.example.com/a/b/?city=Z&fuelType=diesel'")


@query(
    f"""WITH t AS (SELECT o_orderkey, {_HREF} AS u FROM orders), q AS (SELECT *, list_filter(string_split(regexp_extract(u, '\\?([^#]*)', 1), '&'), lambda s: s <> '') AS kv FROM t)
SELECT o_orderkey, CASE WHEN starts_with(u, 'http') THEN u WHEN starts_with(u, '/') THEN 'https://b' || u ELSE 'https://b/' || u END AS absolute, nullif(regexp_extract(u, 'ig_cache_key=([^&#]*)', 1), '') AS cache_key,
 list_filter(string_split(regexp_replace(regexp_replace(u, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '/'), lambda s: s <> '')[-1] AS segment,
 len(list_filter(kv, lambda s: split_part(s, '=', 1) NOT IN ('sortBy', 'sortOrder', 'page')))::INT AS n_active,
 len(list_filter(kv, lambda s: split_part(s, '=', 2) <> '' AND split_part(s, '=', 1) IN ('search', 'minPrice', 'maxPrice', 'minYear', 'maxYear', 'fuelType', 'transmission', 'bodyType', 'sourcePlatform', 'city')))::INT AS n_known FROM q"""
)
def url_parts(spark, d):
    u = F.col("u")
    out = read(spark, d, "orders").selectExpr("o_orderkey", f"{_HREF} AS u")
    return out.select("o_orderkey", T.absolute_url(u, "https://b").alias("absolute"), T.query_value(u, "ig_cache_key").alias("cache_key"), T.last_segment(u).alias("segment"), T.active_filters(u).alias("n_active"), T.known_filters(u).alias("n_known"))


_SRCSET = _shapes("o_orderkey", f"'https://a/' || {_KEY} || ' 1x,  https://b/2 2x'", "''", f"'https://a/' || {_KEY}", f"', ,x' || {_KEY}")


@query(f"WITH t AS (SELECT o_orderkey, {_SRCSET} AS s FROM orders) SELECT o_orderkey, array_to_string(list_filter(list_transform(string_split(s, ','), lambda x: string_split_regex(trim(x), '\\s+')[1]), lambda u: u <> ''), '|') AS urls FROM t")
def srcset(spark, d):
    return read(spark, d, "orders").selectExpr("o_orderkey", f"{_SRCSET} AS s").select("o_orderkey", F.array_join(T.srcset_urls(F.col("s")), "|").alias("urls"))


_CAPTION = _shapes("o_orderkey", f"'9 likes - shop: - \"Car ' || {_KEY} || '\"'", f"'plain ' || {_KEY}", "''", f"'a - b' || {_KEY} || ' - c'")


@query(
    f"""WITH t AS (SELECT o_orderkey, {_CAPTION} AS s FROM orders)
SELECT o_orderkey, CASE WHEN contains(s, ' - ') THEN regexp_replace(regexp_replace(substr(s, instr(s, ' - ') + 3), '^"', ''), '"$', '') ELSE s END AS caption,
 'https://x/a&b' AS unescaped FROM t"""
)
def caption(spark, d):
    out = read(spark, d, "orders").selectExpr("o_orderkey", f"{_CAPTION} AS s")
    return out.select("o_orderkey", T.caption_of(F.col("s")).alias("caption"), T.unescape_slashes(F.lit(r"https:\/\/x\/a\u0026b")).alias("unescaped"))


_TYPE = _shapes("o_orderkey", "'image/PNG'", "'image/webp; q=1'", "'GIF'", "NULL", "'text/html'")


@query(
    f"""WITH t AS (SELECT o_orderkey, {_TYPE} AS c FROM orders), u AS (SELECT o_orderkey, CASE WHEN c ILIKE '%png%' THEN 'image/png' WHEN c ILIKE '%webp%' THEN 'image/webp' WHEN c ILIKE '%gif%' THEN 'image/gif' ELSE 'image/jpeg' END AS media_type FROM t)
SELECT o_orderkey, media_type, 'instagram/shop/P' || o_orderkey || '/' || o_orderkey % 8 || '.' || substr(media_type, 7) AS object_key, base64(encode('img' || o_orderkey)) AS data FROM u"""
)
def content_types(spark, d):
    kind = T.media_type(F.col("c"))
    key = F.col("o_orderkey")
    post = F.concat(F.lit("P"), key.cast("string"))
    return read(spark, d, "orders").selectExpr("o_orderkey", f"{_TYPE} AS c").select(
        "o_orderkey", kind.alias("media_type"), T.object_key(F.lit("shop"), post, key % 8, kind).alias("object_key"), F.base64(F.concat(F.lit("img"), key.cast("string"))).alias("data")
    )


_DETAILS = _shapes("o_orderkey", f"'PETROL, {{AMT}} ' || {_KEY} || ' kms 2nd owner'", "'Diesel Manual 45,000 km 1 owner'", "'gasoline'", f"'lpg cvt owner ' || {_KEY}", "'electrical manually 3rdowner'")


@query(
    f"""WITH t AS (SELECT o_orderkey, lower({_DETAILS}) AS s FROM orders), u AS (SELECT *, regexp_extract(s, '\\b(manual|automatic|amt|cvt|dct|imt)\\b', 1) AS tr FROM t)
SELECT o_orderkey, nullif(regexp_extract(s, '\\b(petrol|diesel|cng|electric|hybrid|lpg)\\b', 1), '') AS fuel, CASE WHEN tr = 'manual' THEN 'manual' WHEN tr <> '' THEN 'automatic' END AS transmission,
 TRY_CAST(regexp_extract(s, '([0-9]+)\\s*(?:st|nd|rd|th)?\\s*owner', 1) AS INT) AS owners, TRY_CAST(replace(regexp_extract(s, '([0-9,]+)\\s*(?:kms?|km)', 1), ',', '') AS INT) AS km FROM u"""
)
def text_classifiers(spark, d):
    s = F.col("s")
    return read(spark, d, "orders").selectExpr("o_orderkey", f"{_DETAILS} AS s").select("o_orderkey", T.fuel_in(s).alias("fuel"), T.transmission_in(s).alias("transmission"), T.owners_in(s).alias("owners"), T.km_in(s).alias("km"))


_LABEL = _shapes("p_partkey", "'Model Year'", "'KM driven'", "'Fuel'", "'Transmission'", "'Owner'", "'Colour'")
_VALUE = _shapes("p_partkey", "'built 2017'", f"{_N} || ',000 km'", "'Petrol + CNG'", "'Semi-Manual'", f"{_N} || 'nd'", "'red'")


@query(
    f"""SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 2017 END AS year, CASE WHEN p_partkey % 6 = 1 THEN p_size * 1000 END AS km_driven, CASE WHEN p_partkey % 6 = 2 THEN 'petrol' END AS fuel_type,
 CASE WHEN p_partkey % 6 = 3 THEN 'manual' END AS transmission, CASE WHEN p_partkey % 6 = 4 THEN p_size END AS owner_count FROM part"""
)
def detail_attributes(spark, d):
    return read(spark, d, "part").selectExpr("p_partkey", f"{_LABEL} AS l", f"{_VALUE} AS v").select("p_partkey", T.attribute_value(F.col("l"), F.col("v")).alias("a")).select("p_partkey", "a.*")


_ISO = _shapes("o_orderkey", "'2024-03-05T10:20:30.000Z'", "'soon'", "NULL", "'2024-03-05T00:00:00Z'")
_LOOSE = _shapes("o_orderkey", "'12km'", "'2019-05'", "'x1'", "' 7.5'")


@query(
    f"""WITH t AS (SELECT o_orderkey, {_ISO} AS t, {_LOOSE} AS n FROM orders)
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '2024-03-05 10:20:30' WHEN 3 THEN '2024-03-05 00:00:00' END AS at, TRY_CAST(regexp_extract(n, '^\\s*([+-]?[0-9]+)', 1) AS INT) AS whole,
 TRY_CAST(regexp_extract(trim(n), '^[0-9]+\\.?[0-9]*') AS DOUBLE) AS number, o_orderkey % 4 NOT IN (1) AS retryable FROM t"""
)
def loose_values(spark, d):
    out = read(spark, d, "orders").selectExpr("o_orderkey", f"{_ISO} AS t", f"{_LOOSE} AS n", "CASE o_orderkey % 4 WHEN 1 THEN 'HTTP 403' WHEN 2 THEN 'timeout' ELSE 'HTTP 500' END AS m")
    at = F.date_format(F.to_utc_timestamp(F.col("t").try_cast("timestamp"), F.current_timezone()), "yyyy-MM-dd HH:mm:ss")
    return out.select("o_orderkey", at.alias("at"), T.leading_int(F.col("n")).alias("whole"), T.leading_number(F.col("n")).alias("number"), T.is_retryable(F.col("m")).alias("retryable"))


_IMAGES = [
    f"'https://scontent.cdninstagram.com/v/a' || {_KEY} || '.jpg?ig_cache_key=K1'", f"'https://scontent.fbcdn.net/v/b' || {_KEY} || '.jpg?ig_cache_key=K1'", "'https://scontent.fbcdn.net/v/c.jpg?x=1'",
    "'https://other.fbcdn.net/w/c.jpg'", "'https://scontent.fbcdn.net/profile_pic/d.jpg'", "'https://scontent.fbcdn.net/s150x150/e.jpg'", "'https://elsewhere.example.com/f.jpg'",
]


@query(f"SELECT o_orderkey, {_IMAGES[0]} || ' ' || {_IMAGES[2]} AS images, 2 AS n FROM orders")
def canonical_images(spark, d):
    urls = F.array(*[F.expr(u) for u in _IMAGES])
    kept = posts.first_of_each_image(F.filter(urls, T.usable_image))
    return read(spark, d, "orders").select("o_orderkey", F.array_join(kept, " ").alias("images"), F.size(kept).alias("n"))

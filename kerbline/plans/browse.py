"""Search pages, the dealer directory, details, saved lists and what pages show."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.functions import present as P
from kerbline.functions import text as T
from kerbline.operators import directory as D
from kerbline.operators import search as S
from kerbline.plans.registry import query
from kerbline.sources.marketplace import DEALERS_SQL, LISTINGS_SQL, MEDIA_SQL, SOURCES_SQL, dealers, listings, read, sources, with_media

SHOWN = ["id", "make", "variant", "year", "price", "sale_status", "city", "scraped_at", "media_count"]
_COLUMNS = ", ".join(SHOWN)
_WITH = f"WITH {LISTINGS_SQL} "
_PREMIUM = ", ".join(f"'{m}'" for m in S.PREMIUM_MAKES)
_FEATURED = f"ORDER BY (sale_status = 'available') DESC NULLS FIRST, (media_count > 0) DESC, (lower(make) IN ({_PREMIUM})) DESC, price DESC NULLS LAST, scraped_at DESC NULLS FIRST, id"


def _page(spark, d, **filters):
    return S.listing_page(listings(spark, d), S.ListingFilters(**filters))


# -- search ------------------------------------------------------------------------------------


@query(_WITH + f"SELECT {_COLUMNS} FROM listings WHERE is_active {_FEATURED} LIMIT 24")
def featured_feed(spark, d):
    return _page(spark, d)[0].select(SHOWN)


@query(_WITH + f"SELECT {_COLUMNS} FROM listings WHERE is_active {_FEATURED} LIMIT 24 OFFSET 24")
def page_2(spark, d):
    return _page(spark, d, page=2)[0].select(SHOWN)


@query(_WITH + f"SELECT {_COLUMNS} FROM listings WHERE is_active AND price >= 20000 AND body_type = 'suv' {_FEATURED} LIMIT 10 OFFSET 10")
def page_from_url(spark, d):
    given = S.filters_of({"search": "", "minPrice": "20000", "bodyType": "suv", "page": "2", "sortBy": "scrapedAt", "sortOrder": "desc", "unknown": "x"})
    return S.listing_page(listings(spark, d), S.ListingFilters(**{**given.__dict__, "page_size": 10}))[0].select(SHOWN)


@query(_WITH + "SELECT id, make, model, variant FROM listings WHERE is_active AND (make ILIKE '%der_o%' OR model ILIKE '%der_o%' OR variant ILIKE '%der_o%' OR description ILIKE '%der_o%' )")
def search_ilike(spark, d):
    return S.search(listings(spark, d), S.ListingFilters(search="der_o")).select("id", "make", "model", "variant")


@query(_WITH + "SELECT id, description FROM listings WHERE is_active AND (make ILIKE '%OWNER, f%' OR model ILIKE '%OWNER, f%' OR variant ILIKE '%OWNER, f%' OR description ILIKE '%OWNER, f%')")
def search_description(spark, d):
    return S.search(listings(spark, d), S.ListingFilters(search="OWNER, f")).select("id", "description")


@query(_WITH + "SELECT id, price, year, transmission FROM listings WHERE is_active AND price >= 50000 AND price <= 200000 AND year >= 1996 AND year <= 2000 AND transmission = 'manual' AND source_platform = 'source-0'")
def search_filters(spark, d):
    filters = S.ListingFilters(min_price=50000, max_price=200000, min_year=1996, max_year=2000, transmission="manual", source_platform="source-0")
    return S.search(listings(spark, d), filters).select("id", "price", "year", "transmission")


@query(_WITH + "SELECT id, fuel_type, body_type, city FROM listings WHERE is_active AND fuel_type = 'diesel' AND body_type = 'sedan' AND city = (SELECT min(n_name) FROM nation) AND price >= 0")
def search_exact(spark, d):
    city = read(spark, d, "nation").agg(F.min("n_name")).scalar()
    return S.search(listings(spark, d), S.ListingFilters(fuel_type="diesel", body_type="sedan", min_price=0)).where(F.col("city") == city).select("id", "fuel_type", "body_type", "city")


@query(_WITH + "SELECT count(*) AS total, CAST(ceil(count(*) / 24.0) AS BIGINT) AS total_pages FROM listings WHERE is_active AND transmission = 'manual'")
def search_count(spark, d):
    return _page(spark, d, transmission="manual")[1]


def _sort_queries() -> None:
    for field, column in S.SORTS.items():
        for order, nulls in (("asc", "LAST"), ("desc", "FIRST")):
            if (field, order) == ("scrapedAt", "desc"):
                continue  # that is the featured order
            sql = _WITH + f"SELECT id, {column} FROM listings WHERE is_active ORDER BY {column} {order} NULLS {nulls}, id LIMIT 24 OFFSET 48"
            page = lambda spark, d, field=field, order=order, column=column: _page(spark, d, sort_by=field, sort_order=order, page=3)[0].select("id", column)
            query(sql, f"sort_{column}_{order}")(page)


_sort_queries()


@query(
    _WITH
    + " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS facet, {c} AS value FROM listings WHERE is_active" + (f" AND {c} <> ''" if c in S.OPTIONAL_FACETS else "") for c in S.FACETS)
)
def facets(spark, d):
    return S.facets(listings(spark, d))


@query(_WITH + "SELECT DISTINCT city FROM listings WHERE is_active ORDER BY city")
def facet_cities_sorted(spark, d):
    return listings(spark, d).where("is_active").select("city").distinct().orderBy("city")


@query(_WITH + "SELECT DISTINCT ON (body_type) body_type FROM listings WHERE is_active AND body_type IS NOT NULL")
def facet_one_row_each(spark, d):
    return listings(spark, d).where("is_active AND body_type IS NOT NULL").select("body_type").dropDuplicates(["body_type"])


@query(_WITH + "SELECT count(DISTINCT source_platform) AS sources, count(DISTINCT city) AS cities FROM listings WHERE is_active")
def facet_headline(spark, d):
    return listings(spark, d).where("is_active").agg(F.count_distinct("source_platform").alias("sources"), F.count_distinct("city").alias("cities"))


# -- directory ---------------------------------------------------------------------------------

_DIRECTORY = "SELECT g.id, g.slug, g.name, g.kind, g.city, g.description, count(o_orderkey) AS listing_count FROM dealers g LEFT JOIN orders ON o_custkey = g.id AND o_orderstatus = 'O' AND o_orderkey % 10 <> 0 WHERE g.is_active{more} GROUP BY g.id, g.slug, g.name, g.kind, g.city, g.description ORDER BY listing_count DESC, name"


def _directory(spark, d, kind=None):
    shown = read(spark, d, "orders").where("o_orderstatus = 'O' AND o_orderkey % 10 <> 0").select(F.col("o_custkey").alias("dealer_id"))
    return D.directory(dealers(spark, d), shown, kind).drop("is_active")


@query(f"WITH {DEALERS_SQL} " + _DIRECTORY.format(more=""))
def dealer_directory(spark, d):
    return _directory(spark, d)


@query(f"WITH {DEALERS_SQL} " + _DIRECTORY.format(more=" AND g.kind = 'marketplace'"))
def dealer_directory_of_kind(spark, d):
    return _directory(spark, d, "marketplace")


@query(_WITH + "SELECT id, price, scraped_at FROM listings WHERE is_active AND dealer_id = 7 ORDER BY scraped_at DESC NULLS FIRST, id LIMIT 48")
def dealer_latest(spark, d):
    return D.latest(listings(spark, d), 7).select("id", "price", "scraped_at")


@query(f"WITH {DEALERS_SQL} SELECT id, name, kind, slug FROM dealers WHERE slug IN ('customer-000000042', 'customer-000000009') AND is_active")
def dealer_by_slug(spark, d):
    found = [D.by_slug(dealers(spark, d), s) for s in ("customer-000000042", "customer-000000009", "no-such-slug")]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("id", "name", "kind", "slug")


@query(f"WITH {SOURCES_SQL} SELECT id, platform, handle, is_active FROM sources WHERE dealer_id = 3")
def dealer_sources(spark, d):
    return D.sources_of(sources(spark, d), 3).select("id", "platform", "handle", "is_active")


@query(f"WITH {DEALERS_SQL} SELECT kind, count(*) AS n FROM dealers WHERE is_active GROUP BY kind")
def dealer_kind_counts(spark, d):
    return dealers(spark, d).where("is_active").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(_WITH + "SELECT l.id, make, price, position FROM listings l JOIN (VALUES (33, 0), (2, 1), (-5, 2), (70, 3), (1, 4)) AS w(id, position) ON l.id = w.id ORDER BY position")
def saved_in_order(spark, d):
    return D.saved(spark, listings(spark, d), [33, 2, -5, 70, 1]).select("id", "make", "price", "position")


@query(_WITH + "SELECT id, make FROM listings WHERE false")
def saved_nothing(spark, d):
    return D.saved(spark, listings(spark, d), []).select("id", "make")


@query(
    "SELECT c_custkey, array_to_string(CASE WHEN list_contains(ids, one) THEN list_filter(ids, lambda x: x <> one) ELSE list_concat([one], ids) END, ',') AS ids"
    " FROM (SELECT c_custkey, [c_custkey, c_custkey + 2, c_custkey + 4] AS ids, c_custkey + c_custkey % 4 AS one FROM customer)"
)
def bookmark_toggle(spark, d):
    key = F.col("c_custkey")
    ids = D.toggled(F.array(key, key + 2, key + 4), key + key % 4)
    return read(spark, d, "customer").select("c_custkey", F.array_join(ids.cast("array<string>"), ",").alias("ids"))


@query(_WITH + f"SELECT {_COLUMNS} FROM listings WHERE id = 100")
def listing_by_id(spark, d):
    return D.by_key(listings(spark, d), "id", 100).select(SHOWN)


@query(f"WITH {DEALERS_SQL} SELECT '/' AS url, 'hourly' AS change UNION ALL SELECT '/dealers', 'daily' UNION ALL SELECT '/dealers/' || slug, 'daily' FROM dealers WHERE is_active")
def sitemap(spark, d):
    fixed = spark.createDataFrame([("/", "hourly"), ("/dealers", "daily")], "url string, change string")
    return fixed.unionByName(dealers(spark, d).where("is_active").select(F.concat(F.lit("/dealers/"), "slug").alias("url"), F.lit("daily").alias("change")))


@query(f"WITH {SOURCES_SQL}, {DEALERS_SQL} SELECT s.id AS source_id, handle, name FROM sources s JOIN dealers g ON dealer_id = g.id WHERE s.is_active AND g.is_active AND platform = 'social'")
def dealer_sources_active(spark, d):
    work = sources(spark, d).where("is_active AND platform = 'social'").select(F.col("id").alias("source_id"), "handle", "dealer_id")
    shown = dealers(spark, d).where("is_active").select("id", "name")
    return work.join(shown, F.col("dealer_id") == F.col("id")).select("source_id", "handle", "name")


# -- what visitors send in ---------------------------------------------------------------------


@query("SELECT CASE event_type WHEN 'view' THEN 'Bug' ELSE 'Other' END AS category, nullif(CAST(event_id % 6 AS INT), 0) AS rating, 'm' || event_id AS message FROM events")
def feedback_sink(spark, d):
    sent = read(spark, d, "events").selectExpr("CASE event_type WHEN 'view' THEN 'Bug' ELSE 'Other' END AS category", "CAST(event_id % 6 AS INT) AS rating", r"'\t m' || CAST(event_id AS STRING) || ' \n' AS message")
    return D.feedback(sent)


@query(
    "SELECT event_id AS listing_id, event_type AS report_type, CASE WHEN event_id % 3 = 0 THEN 'wrong ' || user_id END AS description, 'open' AS status FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0"
)
def report_sink(spark, d):
    sent = read(spark, d, "events").selectExpr(
        "CASE WHEN event_id % 5 <> 0 THEN event_id END AS listing_id", "CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type END AS report_type",
        r"CASE event_id % 3 WHEN 0 THEN ' wrong ' || CAST(user_id AS STRING) || '\t' WHEN 1 THEN ' \n' END AS description",
    )
    return D.reports(sent)


# -- what pages show ---------------------------------------------------------------------------


@query(
    f"""WITH {LISTINGS_SQL}, {MEDIA_SQL}
SELECT l.id, CASE WHEN count(*) FILTER (WHERE type = 'image') > 0 THEN arg_min(url, i) FILTER (WHERE type = 'image') ELSE max(poster_url) FILTER (WHERE i = 0) END AS preview,
 coalesce(bool_or(type = 'video'), false) AS has_video, arg_min(url, i) FILTER (WHERE type IN ('image', 'video')) AS hero,
 count(*) FILTER (WHERE type IN ('image', 'video')) AS n_shown
FROM listings l LEFT JOIN media m ON l.id = m.id GROUP BY l.id"""
)
def media_preview(spark, d):
    media = F.col("media")
    return with_media(listings(spark, d)).select("id", P.preview_url(media).alias("preview"), P.has_video(media).alias("has_video"), P.hero_url(media).alias("hero"), F.size(P.shown_media(media)).cast("bigint").alias("n_shown"))


@query(
    f"""WITH {LISTINGS_SQL}, {MEDIA_SQL}, shown AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS r FROM media WHERE type IN ('image', 'video'))
SELECT l.id, coalesce(string_agg(url, ' ' ORDER BY r) FILTER (WHERE r BETWEEN 2 AND 5), '') AS thumbnails FROM listings l LEFT JOIN shown s ON l.id = s.id GROUP BY l.id"""
)
def thumbnails(spark, d):
    return with_media(listings(spark, d)).select("id", F.array_join(P.thumbnail_urls(F.col("media")), " ").alias("thumbnails"))


_GROUPED = "CASE WHEN {x} < 1000 THEN {x}::VARCHAR WHEN {x} < 100000 THEN ({x} // 1000)::VARCHAR || ',' || lpad(({x} % 1000)::VARCHAR, 3, '0') ELSE ({x} // 100000)::VARCHAR || ',' || lpad(({x} // 1000 % 100)::VARCHAR, 2, '0') || ',' || lpad(({x} % 1000)::VARCHAR, 3, '0') END"
_HUNDREDTHS = "({h} // 100)::VARCHAR || '.' || lpad(({h} % 100)::VARCHAR, 2, '0')"
_PAISE = "CAST(price * 100 AS BIGINT)"
_PRICE_TEXT = (
    f"CASE WHEN price IS NULL THEN 'Price on request' WHEN price >= 10000000 THEN {_HUNDREDTHS.format(h=f'(({_PAISE} + 5000000) // 10000000)')} || ' Cr' "
    f"WHEN price >= 100000 THEN {_HUNDREDTHS.format(h=f'(({_PAISE} + 50000) // 100000)')} || ' L' "
    f"ELSE {_GROUPED.format(x=f'({_PAISE} // 100)')} || CASE WHEN {_PAISE} % 100 = 0 THEN '' ELSE '.' || rtrim(lpad(({_PAISE} % 100)::VARCHAR, 2, '0'), '0') END END"
)
_KM_TEXT = f"CASE WHEN km_driven IS NULL THEN '—' ELSE {_GROUPED.format(x='km_driven')} || ' km' END"
_CAPITAL = "upper(substr({c}, 1, 1)) || substr({c}, 2)"


@query(_WITH + f"SELECT id, {_PRICE_TEXT} AS price_text, coalesce(price > 0, false) AS priced, {_KM_TEXT} AS km_text, strftime(scraped_at, '%-d %b %Y') AS date_text, CASE WHEN coalesce(fuel_type, '') = '' THEN '—' ELSE {_CAPITAL.format(c='fuel_type')} END AS fuel_text FROM listings")
def formats(spark, d):
    return listings(spark, d).select(
        "id", T.format_price(F.col("price")).alias("price_text"), T.is_priced(F.col("price")).alias("priced"), T.format_km(F.col("km_driven")).alias("km_text"),
        T.format_date(F.col("scraped_at")).alias("date_text"), T.capitalize(F.col("fuel_type")).alias("fuel_text"),
    )


_SCALED = "CAST(CASE o_orderkey % 4 WHEN 0 THEN o_totalprice * 100 WHEN 1 THEN o_totalprice / 7 ELSE o_totalprice END AS DECIMAL(12,2))"


@query(f"SELECT id, {_PRICE_TEXT} AS price_text FROM (SELECT o_orderkey AS id, {_SCALED} AS price FROM orders)")
def format_price(spark, d):
    return read(spark, d, "orders").selectExpr("o_orderkey AS id", f"{_SCALED} AS price").select("id", T.format_price(F.col("price")).alias("price_text"))


@query(
    _WITH
    + f"""SELECT id, year || ' ' || make || ' ' || model || CASE WHEN coalesce(variant, '') <> '' THEN ' ' || variant ELSE '' END AS title,
 concat_ws(' · ', CASE WHEN price IS NULL THEN 'Price on request' ELSE '₹' || {_PRICE_TEXT} END, CASE WHEN km_driven IS NOT NULL THEN {_KM_TEXT} END,
 CASE WHEN coalesce(fuel_type, '') <> '' THEN {_CAPITAL.format(c='fuel_type')} END, CASE WHEN coalesce(transmission, '') <> '' THEN {_CAPITAL.format(c='transmission')} END, city) AS description FROM listings"""
)
def meta_description(spark, d):
    c = F.col
    return listings(spark, d).select("id", P.title(c("year"), c("make"), c("model"), c("variant")).alias("title"), P.description(c("price"), c("km_driven"), c("fuel_type"), c("transmission"), c("city")).alias("description"))


_BADGES = {"source-0": "Source Zero", "source-1": "Source One"}


@query(
    f"""WITH {LISTINGS_SQL} SELECT DISTINCT source_platform, CASE lower(source_platform) WHEN 'source-0' THEN 'Source Zero' WHEN 'source-1' THEN 'Source One' ELSE source_platform END AS badge,
 CASE source_platform WHEN 'source-0' THEN 'Instagram' WHEN 'source-1' THEN 'Marketplace feed' ELSE 'new_kind' END AS source_type FROM listings"""
)
def labels(spark, d):
    kind = F.when(F.col("source_platform") == "source-0", "instagram_dealer").when(F.col("source_platform") == "source-1", "marketplace_aggregator").otherwise("new_kind")
    badge = P.label(F.upper("source_platform"), {k: v for k, v in _BADGES.items()}, fold_case=True)
    badge = F.when(badge == F.upper("source_platform"), F.col("source_platform")).otherwise(badge)
    return listings(spark, d).select("source_platform", badge.alias("badge"), P.label(kind, P.SOURCE_TYPES).alias("source_type")).distinct()


@query(f"WITH {DEALERS_SQL} SELECT id, coalesce(description, 'Car listings from ' || name || CASE WHEN coalesce(city, '') <> '' THEN ' in ' || city ELSE '' END || '.') AS description FROM dealers WHERE is_active")
def dealer_descriptions(spark, d):
    return dealers(spark, d).where("is_active").select("id", P.dealer_description(F.col("description"), F.col("name"), F.col("city")).alias("description"))

"""Runs over stored listings, sinks that take a batch once, pages of a stored order, and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.operators import directory as D
from kerbline.operators import migrate as M
from kerbline.operators import runs as R
from kerbline.operators import search as S
from kerbline.operators import versions as V
from kerbline.operators.paging import StoredOrder
from kerbline.operators.stored import Folder, KeyedTable, Saved, StoredLog, work_folder
from kerbline.plans.browse import _FEATURED, SHOWN
from kerbline.plans.ingest import _FOLD_SQL, _LOG, _SHAPE, _STEPS, _log, _tables
from kerbline.plans.registry import query
from kerbline.sources import paged
from kerbline.sources.marketplace import DEALERS_SQL, LISTINGS_SQL, dealers, listings, read
from kerbline.streaming.merge import distinct_within, merge_stream
from kerbline.streaming.recheck import recheck_stream

_AS_OF = 1999
#: What run n finds of listing id, in words that Spark and the checking engine both read.
_SCRAPED = {
    "id": "id",
    "source_platform": "'source-0'",
    "source_url": "source_url",
    "make": "CASE WHEN id % 23 = 0 THEN ' ' ELSE make END",
    "model": "CASE WHEN id % 29 = 0 THEN NULL ELSE model END",
    "year": "year",
    "city": "city || ' {n}'",
    "price": "CAST(price + {n} * 1000 AS DECIMAL(12,2))",
    "km_driven": "km_driven + {n}",
    "description": "CASE WHEN {n} <> 1 THEN 'seen {n}' END",
    "sale_status": "CASE WHEN (id + {n}) % 4 = 0 THEN 'sold' WHEN id % 5 > 0 THEN 'available' END",
    "sold_at": "CASE WHEN (id + {n}) % 8 = 0 THEN TIMESTAMP '2023-12-0{m} 00:00:00' END",
    "dealer_id": "CASE WHEN id % 2 = 0 THEN dealer_id END",
}
_RUNS = 3


def _at(n: int) -> str:
    return f"2024-01-0{n + 1} 12:00:00"


def _columns(n: int) -> list[str]:
    return [f"{sql.format(n=n, m=n + 1)} AS {name}" for name, sql in _SCRAPED.items()]


def _after_runs(spark, d):
    """Three runs of one source, the second of them twice."""
    every = Saved(spark, "every").save(listings(spark, d, over_tasks=True).select("id", "source_url", "make", "model", "year", "city", "price", "km_driven", "dealer_id"))
    sources = spark.createDataFrame([("source-0", "source-0", 90, 900), ("source-1", "other", 91, 901)], "platform string, handle string, dealer_source_id long, dealer_id long")
    root = work_folder(spark, "listings")
    table = R.listing_table(spark, f"{root}/table", parts=16)
    runs = R.RunLog(spark, f"{root}/runs")
    for n in (0, 1, 1, 2):
        found = every.where(f"(id + {n}) % 3 <> 0").selectExpr(*_columns(n))
        problems = spark.createDataFrame([("https://b/1", "timeout", 0), ("https://b/2", "blocked", 1)], "url string, message string, position int") if n == 1 else None
        R.run_batch(table, runs, found, sources, "source-0", n, _at(n), _AS_OF, ["id"], problems)
        table.vacuum()
    return table, runs


_PRICE_SAID = "CASE WHEN price = floor(price) THEN CAST(CAST(price AS BIGINT) AS VARCHAR) ELSE rtrim(CAST(price AS VARCHAR), '0') END"
_SQL = (
    f"WITH {LISTINGS_SQL}, s AS ("
    + " UNION ALL ".join(f"SELECT {n} AS n, TIMESTAMP '{_at(n)}' AS seen, {', '.join(_columns(n))} FROM listings WHERE (id + {n}) % 3 <> 0" for n in range(_RUNS))
    + f"""), b AS (SELECT *, list_filter([
  CASE WHEN trim(coalesce(make, '')) = '' THEN 'make is empty' END, CASE WHEN trim(coalesce(model, '')) = '' THEN 'model is empty' END,
  CASE WHEN price NOT BETWEEN 10000 AND 100000000 THEN 'price ' || {_PRICE_SAID} || ' outside ₹10000–₹100000000 range' END,
  CASE WHEN year NOT BETWEEN 1990 AND 2000 THEN 'year ' || year || ' outside 1990–2000 range' END,
  CASE WHEN km_driven NOT BETWEEN 0 AND 2000000 THEN 'kmDriven ' || km_driven || ' outside 0–2000000 range' END], lambda x: x IS NOT NULL) AS errors FROM s),
ok AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n) AS f, row_number() OVER (PARTITION BY id ORDER BY n DESC) AS l,
  coalesce(sold_at, CASE WHEN sale_status = 'sold' THEN seen END) AS sold FROM b WHERE len(errors) = 0)"""
)


@query(
    _SQL
    + f""", k AS (SELECT id, arg_max(sold, n) FILTER (WHERE sold IS NOT NULL) AS sold_at FROM ok GROUP BY id)
SELECT x.source_url, x.make, x.city, x.seen AS scraped_at, y.price, y.km_driven, y.description, CASE WHEN y.price IS NULL THEN 'price_on_request' ELSE 'priced' END AS listing_status,
 coalesce(y.sale_status, 'available') AS sale_status, k.sold_at, coalesce(y.dealer_id, 900)::BIGINT AS dealer_id, 90::BIGINT AS dealer_source_id, true AS is_active, y.seen AS updated_at,
 sha256(concat_ws('|', y.make, y.model, y.year::VARCHAR, coalesce({_PRICE_SAID.replace('price', 'y.price')}, 'null'), y.source_url)) AS content_hash
FROM ok x JOIN ok y ON x.id = y.id AND x.f = 1 AND y.l = 1 JOIN k ON k.id = x.id"""
)
def stored_listings(spark, d):
    table, _ = _after_runs(spark, d)
    return table.read().select(
        "source_url", "make", "city", "scraped_at", "price", "km_driven", "description", "listing_status", "sale_status", "sold_at", "dealer_id", "dealer_source_id", "is_active", "updated_at", "content_hash"
    )


@query(_SQL + " SELECT source_url, f = 1 AS is_new FROM ok WHERE n = 2")
def stored_changes(spark, d):
    """What the last run did to each listing that it touched."""
    table, _ = _after_runs(spark, d)
    return table.changes("source-0", 2).select("source_url", "is_new")


@query(
    _SQL
    + """, c AS (SELECT n, count(*) AS found, count(*) FILTER (WHERE len(errors) > 0) AS rejected, string_agg(source_url || ': ' || array_to_string(errors, ', '), chr(10) ORDER BY id) FILTER (WHERE len(errors) > 0) AS reasons FROM b GROUP BY n),
m AS (SELECT n, count(*) FILTER (WHERE f = 1) AS new, count(*) FILTER (WHERE f > 1) AS updated FROM ok GROUP BY n)
SELECT 'source-0-' || n AS run_id, 'completed_with_errors' AS status, found, coalesce(new, 0) AS new, coalesce(updated, 0) AS updated, rejected, md5(reasons) AS reasons_md5,
 md5(CASE WHEN n = 1 THEN 'https://b/1: timeout' || chr(10) || 'https://b/2: blocked' || chr(10) || chr(10) ELSE '' END || 'Validation rejections:' || chr(10) || reasons) AS message_md5 FROM c LEFT JOIN m USING (n)"""
)
def stored_runs(spark, d):
    _, runs = _after_runs(spark, d)
    return runs.read().select("run_id", "status", "found", "new", "updated", "rejected", "reasons_md5", "message_md5")


@query("SELECT event_id, user_id, event_type FROM events")
def stored_sink(spark, d):
    """Feedback, reports or usage in batches, the first of which comes twice."""
    log = StoredLog(spark, work_folder(spark, "feedback"), "event_id long, user_id long, event_type string")
    rows = read(spark, d, "events").selectExpr("CAST(event_id AS BIGINT) AS event_id", "CAST(user_id AS BIGINT) AS user_id", "event_type")
    for batch in (0, 0, 1, 2):
        log.append(rows.where(F.col("event_id") % 3 == batch), str(batch))
    return log.read()


@query(
    f"WITH {DEALERS_SQL} SELECT 'https://c.example.com/dealers/' || slug || '?a=1&b=<2>' AS loc, 'daily' AS changefreq, true AS in_limit FROM dealers WHERE is_active"
)
def sitemap_export(spark, d):
    """What the exported files hold, and whether each keeps to its limit; the export is asked for twice."""
    folder, limit = Folder(spark, work_folder(spark, "sitemap")), 500
    entries = dealers(spark, d).where("is_active").select(F.concat(F.lit("/dealers/"), "slug", F.lit("?a=1&b=<2>")).alias("url"), F.lit("daily").alias("change"))
    for _ in range(2):
        D.export_sitemap(entries, folder, "https://c.example.com", limit)
    found = spark.read.format("xml").option("rowTag", "url").schema("loc string, changefreq string").load(f"{folder.root}/urls").withColumn("file", F.input_file_name())
    sizes = found.groupBy("file").agg((F.count(F.lit(1)) <= limit).alias("in_limit"))
    return found.join(sizes, "file").drop("file")


@query(
    f"""WITH {LISTINGS_SQL}, r AS (SELECT *, row_number() OVER ({_FEATURED}) AS place, count(*) OVER () AS n FROM listings WHERE is_active)
SELECT {', '.join(SHOWN)} FROM r WHERE place > n // 48 * 24 AND place <= n // 48 * 24 + 24"""
)
def deep_page(spark, d):
    """The page in the middle of the featured order, from the files of the stored order that it lies in."""
    order = StoredOrder.build(S.search(listings(spark, d), S.ListingFilters()), work_folder(spark, "order"), S.featured_order())
    return order.page(order.total() // 48 + 1).select(SHOWN)


@query(
    """WITH p AS (SELECT DISTINCT (p_partkey - 1) // 50 + 1 AS page FROM part)
SELECT 'a' AS source, page::INT AS page, 'listingCard ' || page AS said FROM p WHERE page < 7 UNION ALL SELECT 'b', page::INT, 'listingCard ' || page FROM p WHERE page <= 20"""
)
def paged_source(spark, d):
    """Result pages of two sources, as they were captured: one has an empty page, the other more than are read."""
    paged.register(spark)
    root = work_folder(spark, "captured")
    numbers = read(spark, d, "part").selectExpr("CAST((p_partkey - 1) div 50 + 1 AS INT) AS page").distinct()
    pages = numbers.select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("source"), "page")
    empty = (F.col("source") == "a") & (F.col("page") == 7)
    paged.capture(pages.withColumn("html", F.when(empty, "<p>no cars</p>").otherwise(F.concat(F.lit("listingCard "), "page"))), root)
    return spark.read.format(paged.FORMAT).load(root).select("source", "page", F.trim(F.regexp_replace("html", r"\s+$", "")).alias("said"))


@query(
    f"""WITH {_STEPS} SELECT o.id, a.slug AS dealer_slug, CASE WHEN a.slug IS NULL THEN NULL WHEN platform = 'social' THEN 'instagram_dealer' WHEN platform = 'source-a' THEN 'marketplace_aggregator' ELSE 'other' END AS source_type,
 o.id::VARCHAR AS handle_number, 6 AS n_steps FROM own o LEFT JOIN all_dealers a ON a.slug = CASE WHEN platform = 'source-a' THEN platform ELSE o.slug END"""
)
def stored_migration(spark, d):
    """Sources after the journal and changes of columns, run twice over stored tables that keep their constraints."""
    stored = V.StoredTables(spark, work_folder(spark, "tables"), [V.Unique("dealers", "slug"), V.Restrict("sources", "dealer_slug", "dealers", "slug")])
    given = _tables(spark, d)
    first = ("0000_given", lambda _: given | {"dealers": given["dealers"].drop("profile_url"), "sources": given["sources"].withColumn("handle_number", F.col("id"))})
    steps = [first, M.JOURNAL[0], ("0001_profile_url", V.add_column("dealers", "profile_url", "string")), *M.JOURNAL[1:], ("0004_handle_number", V.change_column("sources", "handle_number", "string"))]
    for _ in range(2):
        stored.migrate(steps)
    return stored.read()["sources"].select("id", "dealer_slug", "source_type", "handle_number", F.lit(len(stored.journal())).alias("n_steps"))


# -- streams -----------------------------------------------------------------------------------


def _stream(spark, d, *columns):
    """The events table as a stream of its files (a stream reads no single file but through a pattern)."""
    schema = read(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events.parquet*").select(*columns)


@query(f"WITH {_LOG} {_FOLD_SQL.format(more='')}")
def stream_upsert(spark, d):
    root, rows = work_folder(spark, "stream"), _log(spark, d)
    made = [F.col("value").alias("price"), F.col("ts").alias("scraped_at"), F.when(F.col("event_type") == "purchase", "sold").otherwise("available").alias("status"), F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("sold_at")]
    stream = _stream(spark, d, "event_type", "user_id", "ts", "event_id", *made)
    table = KeyedTable(spark, f"{root}/table", rows.select(*_SHAPE["keys"], *_SHAPE["first"], *_SHAPE["last"], *_SHAPE["last_known"]).schema, _SHAPE["keys"], _SHAPE["first"], _SHAPE["last"], _SHAPE["last_known"], parts=16)
    merge_stream(stream, table, f"{root}/check", _SHAPE["seq"]).awaitTermination()
    return table.read()


def _sunk(spark, stream, schema):
    root = work_folder(spark, "stream")
    stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{root}/out")


@query("SELECT DISTINCT user_id FROM events")
def stream_distinct(spark, d):
    """Users of one delivery of events, each once: repeated rows within the delay are dropped as they arrive."""
    first = distinct_within(_stream(spark, d, "user_id", "ts"), "user_id", "ts").select("user_id")
    return _sunk(spark, first, first.schema)


@query(
    """WITH RECURSIVE p AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id
UNION ALL SELECT p.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = p.user_id AND e.ts > p.ts + INTERVAL 48 HOURS) FROM p WHERE p.ts IS NOT NULL)
SELECT e.event_id, e.user_id, e.ts, p.ts IS NOT NULL AS processed FROM events e LEFT JOIN (SELECT DISTINCT * FROM p WHERE ts IS NOT NULL) p ON e.user_id = p.user_id AND e.ts = p.ts
WHERE e.ts <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 1 HOUR"""
)
def stream_recheck(spark, d):
    """Events that the watermark, an hour behind the latest, has passed."""
    judged = recheck_stream(_stream(spark, d, "event_id", "user_id", "ts"), "user_id", "ts", "1 hour")
    return _sunk(spark, judged, judged.schema)

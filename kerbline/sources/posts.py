"""Captured pages of social profiles and posts: links, media, captions, and what a caption says of a car."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.functions import text as T
from kerbline.operators.spread import spread
from kerbline.sources.markup import tokens

LINKS_PER_PROFILE, IMAGES_PER_POST, IMAGES_TO_READ = 20, 8, 2
#: What an extracted record may say.
FUELS = ("petrol", "diesel", "cng", "electric", "hybrid")
TRANSMISSIONS = ("manual", "automatic")
BODIES = ("sedan", "suv", "hatchback", "muv", "coupe", "convertible", "pickup", "van", "wagon")


#: What a page's elements say: metas and time (null without one), addresses of links, preloads and images in page order.
_SAID = "description string, preview string, video string, posted string, links array<string>, preloads array<string>, pictures array<string>"


def _srcset(value: str) -> list[str]:
    return [parts[0] for part in value.split(",") if (parts := part.split())]


def _said(html: str | None) -> tuple:
    metas, posted = {}, None
    links, preloads, pictures = [], [], []
    for kind, tag, attributes in tokens(html):
        if kind != "start" or tag not in ("meta", "a", "link", "img", "time"):
            continue
        has = dict(reversed(attributes))
        if tag == "meta":
            metas.setdefault(has.get("property"), has.get("content", ""))
        elif tag == "a":
            if "/p/" in has.get("href", "") or "/reel/" in has.get("href", ""):
                links.append(has["href"])
        elif tag == "link":
            if has.get("rel") == "preload" and has.get("as") == "image":
                preloads += [has.get("href", ""), *_srcset(has.get("imagesrcset", ""))]
        elif tag == "time":
            posted = has.get("datetime") if posted is None else posted
        elif "srcset" in has or any(host in has.get("src", "") for host in ("cdninstagram", "fbcdn")):
            pictures += [has.get("src", ""), *_srcset(has.get("srcset", ""))]
    return metas.get("og:description"), metas.get("og:image"), metas.get("og:video"), posted, links, preloads, pictures


def _said_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [column.split()[0] for column in _SAID.split(", ")]
    for batch in batches:
        yield pd.concat([batch.reset_index(drop=True), pd.DataFrame([_said(html) for html in batch["html"]], columns=names, dtype=object)], axis=1)


def page_elements(pages: DataFrame, *columns: str) -> DataFrame:
    """(columns, html) -> the same and what the page's elements say, references decoded, attributes in any
    order and quotes. A null or empty page says nothing."""
    own = spread(pages.select(*columns, "html"), *columns, "html")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    return own.mapInPandas(_said_rows, f"{kept}, {_SAID}")


def profile_links(pages: DataFrame, base: str, most: int = LINKS_PER_PROFILE) -> DataFrame:
    """(handle, html) -> handle, position, url: the first different links to posts and reels."""
    links = F.slice(F.array_distinct("links"), 1, most)
    out = page_elements(pages, "handle").select("handle", F.posexplode(links).alias("position", "href"))
    return out.select("handle", "position", T.absolute_url(F.col("href"), base).alias("url"))


def image_urls() -> Column:
    """Usable images of a post, of the columns of `page_elements`; the first of each image: its preview,
    preloads, image tags (each with its own set of sources), and whatever addresses of image hosts the
    page's text has, where references and JSON escapes are undone."""
    loose = F.regexp_extract_all("html", F.lit(r"""(https:(?:\\?/){2}[^"'\s<>]*?(?:cdninstagram\.com|fbcdn\.net)[^"'\s<>]+)"""), F.lit(1))
    plain = lambda u: F.replace(T.unescape_slashes(u), F.lit("&amp;"), F.lit("&"))
    every = F.concat(F.array(F.coalesce("preview", F.lit(""))), "preloads", "pictures", F.coalesce(F.transform(loose, plain), F.array().cast("array<string>")))
    return first_of_each_image(F.array_distinct(F.filter(every, T.usable_image)))


def first_of_each_image(urls: Column) -> Column:
    """Addresses in order, without those whose image an earlier one has."""
    keys = F.transform(urls, T.image_key)
    return F.filter(urls, lambda u, i: F.array_position(keys, F.get(keys, i)) == i + 1)


def post_media(images: Column, video: Column, types: Column | None = None) -> Column:
    """A post's media: its video first, with the first image as poster, then its images. types: the
    images' content types where they were fetched."""
    kind = lambda i: F.lit(None).cast("string") if types is None else T.media_type(F.get(types, i))
    item = lambda url, what, mime, poster: F.struct(url.alias("url"), F.lit(what).alias("type"), mime.alias("mime_type"), poster.alias("poster_url"))
    pictures = F.transform(images, lambda u, i: item(u, "image", kind(i), F.lit(None).cast("string")))
    return F.when(video.isNull(), pictures).otherwise(F.concat(F.array(item(video, "video", F.lit("video/mp4"), F.get(images, F.lit(0)))), pictures))


def post_pages(pages: DataFrame) -> DataFrame:
    """(handle, url, html) -> handle, url, post_id, caption, images, video_url, posted_at, is_reel, media, n_media."""
    out = page_elements(pages, "handle", "url").select(
        "handle", "url", T.post_id(F.col("url")).alias("post_id"), T.caption_of(F.coalesce("description", F.lit(""))).alias("caption"),
        F.slice(image_urls(), 1, IMAGES_PER_POST).alias("images"), F.nullif("video", F.lit("")).alias("video_url"), F.col("posted").try_cast("timestamp").alias("posted_at"),
    )
    out = out.withColumns({"is_reel": T.is_reel(F.col("url"), F.col("video_url").isNotNull()), "media": post_media(F.col("images"), F.col("video_url"))})
    return out.withColumn("n_media", F.size("media"))


def images_to_read(images: Column, stored: Column, data: Column) -> Column:
    """The first images of a post as (kind, value): the stored address, else the data in base64."""
    pick = lambda i: F.when(F.get(stored, i).isNotNull(), F.struct(F.lit("url").alias("kind"), F.get(stored, i).alias("value"))).otherwise(F.struct(F.lit("base64").alias("kind"), F.base64(F.get(data, i)).alias("value")))
    return F.transform(F.sequence(F.lit(0), F.least(F.lit(IMAGES_TO_READ), F.size(images)) - 1), pick)


def car_in_caption(caption: Column) -> Column:
    """What a caption says by fixed rules: struct of year, price, km_driven, fuel_type, transmission,
    owner_count, body_type, seller_phone, is_sold, is_car_listing.

    "4.5L" and "4.5 lakhs" are 450000, "45k km" is 45000; a listing needs a year and any of price,
    distance, fuel or a request for the price.
    """
    blank = lambda c: F.nullif(c, F.lit(""))
    text = F.coalesce(caption, F.lit(""))
    lower = F.lower(text)
    year = blank(F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1)).try_cast("int")
    lakh = T.leading_number(F.regexp_extract(lower, r"(\d+(?:\.\d+)?)\s*(?:lakhs?|lacs?|l)\b", 1))
    thousand = T.leading_number(F.regexp_extract(lower, r"(\d+(?:\.\d+)?)\s*k\s*kms?\b", 1))
    km = F.coalesce(F.round(thousand * 1000, 0).cast("int"), T.km_in(text))
    body = blank(F.regexp_extract(lower, rf"\b({'|'.join(BODIES)})\b", 1))
    fuel = T.fuel_in(text)
    fuel = F.when(fuel.isin(*FUELS), fuel)
    price = F.round(lakh * 100000, 0).cast("decimal(12,2)")
    asked = lower.rlike(r"dm for price|price on request")
    return F.struct(
        year.alias("year"), price.alias("price"), km.alias("km_driven"), fuel.alias("fuel_type"), T.transmission_in(text).alias("transmission"), T.owners_in(text).alias("owner_count"),
        body.alias("body_type"), blank(F.regexp_extract(text, r"(?<!\d)((?:\+91[ -]?)?[6-9]\d{9})(?!\d)", 1)).alias("seller_phone"),
        lower.rlike(r"\bsold\b|\bbooked\b|no longer available").alias("is_sold"),
        (year.isNotNull() & (price.isNotNull() | km.isNotNull() | fuel.isNotNull() | asked)).alias("is_car_listing"),
    )


def checked_records(records: DataFrame) -> DataFrame:
    """Records of an extractor with values outside the known ones set to null, and in_schema where none was."""
    known = {"fuel_type": FUELS, "transmission": TRANSMISSIONS, "body_type": BODIES}
    good = [F.col(c).isNull() | F.col(c).isin(*v) for c, v in known.items()]
    out = records.withColumn("in_schema", good[0] & good[1] & good[2])
    return out.withColumns({c: F.when(F.col(c).isin(*v), F.col(c)) for c, v in known.items()})


def listings_of_posts(records: DataFrame, dealers: DataFrame, city: str) -> DataFrame:
    """Extracted records (handle, url, make, model, year, ...) of car posts as listings.

    Only records that are a listing and have make, model and year; the dealer is looked up by handle,
    what it lacks is filled in. Where records have media, caption and posted_at of their post, so does the listing.
    """
    more = {"media": "media", "description": "caption", "listed_at": "posted_at"}
    there = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    cars = records.where(F.col("is_car_listing") & there("make") & there("model") & (F.col("year") != 0))
    known = dealers.select(F.col("handle").alias("__handle"), F.col("display_name").alias("__name"), F.col("city").alias("__city"), F.col("dealer_id").alias("__dealer"))
    out = cars.join(known, F.col("handle") == F.col("__handle"), "left")
    return out.select(
        "make", "model", "year", "price", T.listing_status(F.lit(None).cast("string"), F.col("price")).alias("listing_status"), F.when(F.col("is_sold"), "sold").otherwise("available").alias("sale_status"),
        F.coalesce("__city", F.lit(city)).alias("city"), F.lit("social").alias("source_platform"), F.col("url").alias("source_url"), T.post_path_id(F.col("url")).alias("source_listing_id"),
        F.coalesce("__name", F.concat(F.lit("@"), "handle")).alias("seller_name"), F.lit("dealer").alias("seller_type"), F.col("__dealer").alias("dealer_id"),
        *[(F.nullif(c, F.lit("")) if c == "caption" else F.col(c)).alias(name) for name, c in more.items() if c in records.columns],
    )

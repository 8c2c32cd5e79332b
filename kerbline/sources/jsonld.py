"""Structured data of captured pages: JSON-LD blocks to listing rows, with Spark's own JSON functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.functions import text as T
from kerbline.operators.spread import spread

_BLOCK = r'(?is)<script[^>]*type=["\']application/ld\+json["\'][^>]*>(.*?)</script>'


def blocks(pages: DataFrame, *keep: str) -> DataFrame:
    """(url, keep, html) -> url, keep, block, root: JSON-LD blocks of each page; malformed ones have no row."""
    told = spread(pages.select("url", *keep, "html"), "url", "html")
    found = told.select("url", *keep, F.posexplode(F.regexp_extract_all("html", F.lit(_BLOCK), F.lit(1))).alias("block", "json"))
    return once(found, ["url", *keep, "block"], root=F.try_parse_json("json")).where("root IS NOT NULL")


def _list(value: str, path: str) -> Column:
    return F.try_variant_get(value, path, "array<variant>")


def _text(path: str, value: str = "node") -> Column:
    return F.try_variant_get(value, path, "string")


def _number(path: str) -> Column:
    """A number, or the leading number of a text."""
    return F.coalesce(F.try_variant_get("node", path, "double"), T.leading_number(_text(path)))


def _whole(path: str) -> Column:
    """A whole number, or the leading one of a text."""
    return F.coalesce(F.try_variant_get("node", path, "int"), T.leading_int(_text(path)))


def _photos() -> Column:
    one = F.nullif(_text("$.image"), F.lit(""))
    return F.coalesce(F.try_variant_get("node", "$.image", "array<string>"), F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def listing_links(pages: DataFrame) -> DataFrame:
    """url, name, link, image of the list items in a block's @graph that have a link."""
    nodes = blocks(pages).select("url", "block", F.posexplode(_list("root", '$["@graph"]')).alias("at", "node"))
    items = nodes.where((_text('$["@type"]') == "ListItem") & _filled(_text("$.url")))
    return items.select("url", "block", "at", F.coalesce(_text("$.name"), F.lit("")).alias("name"), _text("$.url").alias("link"), _text("$.image").alias("image"))


def cars(pages: DataFrame, city: str, platform: str) -> DataFrame:
    """One listing for each page whose first Car, over its blocks, has make, model, year and price."""
    nodes = blocks(pages).select("url", "block", F.posexplode(F.coalesce(_list("root", "$"), F.array("root"))).alias("at", "node"))
    found = nodes.where(_text('$["@type"]') == "Car").select("url", "block", "at", F.to_json("node").alias("json"))
    first = found.groupBy("url").agg(F.min(F.struct("block", "at", "json")).alias("f")).select("url", F.try_parse_json("f.json").alias("node"))
    make, model, year, price = _text("$.brand.name"), _text("$.model"), _whole("$.vehicleModelDate"), _number("$.offers.price")
    raw = first.select(
        "url", make.alias("make"), model.alias("model"), year.alias("year"), price.cast("decimal(12,2)").alias("price"), F.coalesce(_text("$.name"), F.lit("")).alias("name"),
        F.nullif(_whole("$.mileageFromOdometer.value"), F.lit(0)).alias("km_driven"), _text("$.fuelType").alias("fuel_type"), _text("$.vehicleTransmission").alias("transmission"),
        _text("$.color").alias("color"), _text("$.bodyType").alias("body_type"), _photos().alias("photos"),
    )
    kept = raw.where(_filled(F.col("make")) & _filled(F.col("model")) & (F.col("year") != 0) & (F.col("price") != 0))
    return kept.select(
        T.trimmed(F.col("make")).alias("make"), T.trimmed(F.col("model")).alias("model"), T.variant_of(F.col("name"), F.col("year"), F.col("make"), F.col("model")).alias("variant"),
        "year", "price", "km_driven", "fuel_type", "transmission", "color", "body_type", F.lit(city).alias("city"), F.lit(platform).alias("source_platform"),
        F.col("url").alias("source_url"), T.listing_id(F.col("url")).alias("source_listing_id"), F.lit("dealer").alias("seller_type"), "photos",
    )


def once(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """`keep` and computed columns; a generator stands between, so what is above works with their values
    instead of working them out again for each use."""
    return df.select(*keep, F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))).alias("__o")).select(*keep, "__o.*")


def _first_said(*paths: str) -> Column:
    """text and JSON of the first of the paths that has a value."""
    json = lambda p: F.to_json(F.try_variant_get("node", p, "variant"))
    return F.coalesce(*[F.when(_text(p).isNotNull(), F.struct(_text(p).alias("text"), json(p).alias("json"))) for p in paths])


def products(pages: DataFrame, base: str, city: str, platform: str, page: str | None = None) -> DataFrame:
    """Listings of the cars and products with make, model and price on each page, one row each.

    A block is an object with @graph, a list, or one object; lists of items inside are opened and items
    unwrapped. Make is the brand, else the first word of the name; model is the second word of the
    name. The year is the model date, else the production date, else the name's; one of the dates that
    doesn't begin with a number leaves none. A distance of the number 0 is none. `page` names a column that
    tells captures of one address apart and is kept.
    """
    own = [page] if page else []
    roots = F.coalesce(_list("root", '$["@graph"]'), _list("root", "$"), F.array("root"))
    nodes = blocks(pages, *own).select("url", *own, "block", F.posexplode(roots).alias("at", "outer"))
    opened = nodes.select("url", *own, "block", "at", F.posexplode(F.coalesce(_list("outer", "$.itemListElement"), F.array("outer"))).alias("within", "element"))
    node = F.coalesce(F.try_variant_get("element", "$.item", "variant"), F.col("element"))
    place = ["url", *own, "block", "at", "within"]
    typed = once(opened, place, node=node).where(_text('$["@type"]').isin("Car", "Product"))
    said = once(
        typed, place, title=T.parse_title(F.coalesce(_text("$.name"), F.lit(""))), brand=F.nullif(_text("$.brand.name"), F.lit("")), dated=F.coalesce(_text("$.vehicleModelDate"), _text("$.productionDate")),
        price=_first_said("$.offers.price", "$.offers.lowPrice", "$.price"), km=_first_said("$.mileageFromOdometer.value"), fuel_type=F.coalesce(_text("$.fuelType"), _text("$.vehicleEngine.fuelType")),
        transmission=_text("$.vehicleTransmission"), link=F.coalesce(_text("$.url"), _text("$.offers.url"), F.lit("")), photos=_photos(),
    )
    kept = said.where(_filled(F.coalesce("brand", "title.make")) & _filled(F.col("title.model")))
    in_words = lambda c: F.col(f"{c}.json").startswith('"')
    number = lambda c: F.col(f"{c}.json").try_cast("double")
    price = F.when(in_words("price"), T.parse_indian_price(F.col("price.text"))).otherwise(number("price"))
    km = F.when(in_words("km"), T.parse_km(F.col("km.text"))).when(number("km") != 0, F.round(number("km"), 0).try_cast("int"))
    priced = once(kept, [*place, "title", "brand", "dated", "fuel_type", "transmission", "link", "photos"], price=price.cast("decimal(12,2)"), km_driven=km).where("price <> 0")
    year = F.when(F.col("dated").isNotNull(), T.leading_int(F.col("dated"))).otherwise(F.col("title.year"))
    source_url = T.absolute_url(F.col("link"), base)
    return priced.select(
        F.col("url").alias("page_url"), *own, "block", "at", "within", T.trimmed(F.coalesce("brand", "title.make")).alias("make"), F.col("title.model").alias("model"), F.col("title.variant").alias("variant"), year.alias("year"),
        "price", "km_driven", "fuel_type", "transmission", F.lit(city).alias("city"), F.lit(platform).alias("source_platform"), source_url.alias("source_url"), T.details_page_id(source_url).alias("source_listing_id"), "photos",
    )

"""What pages show of a listing or dealer: preview and hero media, titles, descriptions, labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbline.functions.text import capitalize, format_km, format_price

#: Kinds of sources and how they are shown.
SOURCE_TYPES = {"instagram_dealer": "Instagram", "marketplace_aggregator": "Marketplace feed", "dealer_website": "Website", "other": "Other"}


def shown_media(media: Column) -> Column:
    """Items with an address that are images or videos."""
    return F.filter(media, lambda m: (F.coalesce(m["url"], F.lit("")) != "") & m["type"].isin("image", "video"))


def preview_url(media: Column) -> Column:
    """The first image's address; without one, the first item's poster."""
    image = F.get(F.filter(media, lambda m: m["type"] == "image"), F.lit(0))
    return F.when(image.isNotNull(), image["url"]).otherwise(F.get(media, F.lit(0))["poster_url"])


def has_video(media: Column) -> Column:
    return F.coalesce(F.exists(media, lambda m: m["type"] == "video"), F.lit(False))


def hero_url(media: Column) -> Column:
    """The first of the shown items."""
    return F.get(shown_media(media), F.lit(0))["url"]


def thumbnail_urls(media: Column) -> Column:
    """The second to fifth of the shown items."""
    return F.transform(F.slice(shown_media(media), 2, 4), lambda m: m["url"])


def title(year: Column, make: Column, model: Column, variant: Column) -> Column:
    return F.concat_ws(" ", year.cast("string"), make, model, F.nullif(variant, F.lit("")))


def description(price: Column, km: Column, fuel: Column, transmission: Column, city: Column) -> Column:
    """What is known of a listing, in a line; what is null or empty is left out."""
    money = F.when(price.isNull(), "Price on request").otherwise(F.concat(F.lit("₹"), format_price(price)))
    word = lambda c: F.when(F.coalesce(c, F.lit("")) != "", capitalize(c))
    return F.concat_ws(" · ", money, F.when(km.isNotNull(), format_km(km)), word(fuel), word(transmission), F.nullif(city, F.lit("")))


def label(value: Column, labels: Mapping[str, str], fold_case: bool = False) -> Column:
    """A value's label; the value itself where it has none."""
    known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.element_at(known, F.lower(value) if fold_case else value), value)


def dealer_description(description: Column, name: Column, city: Column, intro: str = "Car listings from ") -> Column:
    place = F.when(F.coalesce(city, F.lit("")) != "", F.concat(F.lit(" in "), city)).otherwise("")
    return F.coalesce(description, F.concat(F.lit(intro), name, place, F.lit(".")))

"""Scalar functions on listing text: prices, distances, titles, ids, slugs, classifiers, display formats.
Column in, Column out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def leading_number(text: Column) -> Column:
    """Leading decimal number of a text, null where there is none."""
    return F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+))", 1).try_cast("double")


def leading_int(text: Column) -> Column:
    """Leading whole number of a text, null where there is none."""
    return F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("int")


def _blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def trimmed(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _hundredths(value: Column) -> Column:
    return (value.cast("decimal(18,2)") * 100).cast("long")


def _decimals(rest: Column) -> Column:
    """What stands after the point, with it, without zeros that say nothing; rest is 0 to 99."""
    return F.when(rest == 0, "").when(rest % 10 == 0, F.concat(F.lit("."), F.floor(rest / 10).cast("string"))).otherwise(F.concat(F.lit("."), F.lpad(rest.cast("string"), 2, "0")))


def plain_number(value: Column) -> Column:
    """A decimal as text, without zeros after the point that say nothing."""

    def said(cents: Column) -> Column:
        return F.concat(F.when(cents < 0, "-").otherwise(""), F.floor(F.abs(cents) / 100).cast("string"), _decimals(F.abs(cents) % 100))

    return _once(_hundredths(value), said)


def without_first(text: Column, part: Column) -> Column:
    """text without the first place where part stands in it; as it is where part is null or empty."""
    at = F.instr(text, part)
    cut = F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(part), F.length(text)))
    return F.when((F.coalesce(part, F.lit("")) != "") & (at > 0), cut).otherwise(text)


# -- parsing -----------------------------------------------------------------------------------


def parse_indian_price(text: Column) -> Column:
    """Rupees of a price text: lakh and crore are scaled and rounded, anything else is its leading number."""

    def said(plain: Column) -> Column:
        lakh = leading_number(F.regexp_extract(plain, r"([\d.]+)(?:lakh|lac)", 1))
        crore = leading_number(F.regexp_extract(plain, r"([\d.]+)(?:crore|cr)", 1))
        return F.coalesce(F.round(lakh * 100000, 0), F.round(crore * 10000000, 0), leading_number(plain))

    return _once(F.regexp_replace(F.lower(text), r"[₹,\s]", ""), said)


def parse_km(text: Column) -> Column:
    found = F.regexp_extract(F.regexp_replace(text, r"[,\s]", ""), r"[\d.]+", 0)
    return F.round(leading_number(found), 0).cast("int")


def parse_owner_count(text: Column) -> Column:
    return _blank_to_null(F.regexp_extract(text, r"\d+", 0)).try_cast("int")


def parse_title(text: Column, wide: bool = False) -> Column:
    """Struct of year, make, model, variant. `wide` also takes 19xx years and strips sale words and brackets."""
    year = r"\b(?:19|20)\d{2}\b" if wide else r"\b20\d{2}\b"
    rest = F.regexp_replace(text, f"(?s)^(.*?){year}", "$1")  # the first year only
    if wide:
        rest = F.regexp_replace(rest, r"(?i)\b(?:for\s+sale|used|second\s*hand|pre\s*owned)\b", "")
        rest = F.regexp_replace(rest, r"[\[\](){}]", "")
    said = F.regexp_extract(text, year, 0).try_cast("int")

    def parts(tokens: Column) -> Column:
        variant = F.array_join(F.slice(tokens, 3, F.greatest(F.lit(0), F.size(tokens) - 2)), " ")
        return F.struct(said.alias("year"), F.get(tokens, F.lit(0)).alias("make"), F.get(tokens, F.lit(1)).alias("model"), F.when(F.size(tokens) > 2, variant).alias("variant"))

    return _once(F.filter(F.split(trimmed(rest), r"\s+"), lambda t: t != ""), parts)


def variant_of(name: Column, year: Column, make: Column, model: Column) -> Column:
    """What a name says beside year, make and model; null where nothing is left."""
    rest = trimmed(without_first(name, year.cast("string")))
    return _blank_to_null(trimmed(without_first(without_first(rest, make), model)))


# -- addresses ---------------------------------------------------------------------------------


def listing_id(url: Column) -> Column:
    """Trailing number of eight digits or more after a dash."""
    return _blank_to_null(F.regexp_extract(url, r"-(\d{8,})/?$", 1))


def details_page_id(url: Column) -> Column:
    return _blank_to_null(F.regexp_extract(url, r"/used-car-details/[^/]*?-(\d+)\.htm", 1))


def trailing_number(url: Column) -> Column:
    return _blank_to_null(F.regexp_extract(url, r"(\d+)$", 1))


def post_path_id(url: Column) -> Column:
    """What follows the first /p/, up to another, less its first slash; null without /p/."""
    after = F.get(F.split(url, "/p/"), F.lit(1))
    return F.regexp_replace(after, r"^([^/]*)/", "$1")


def post_id(url: Column) -> Column:
    """Id of a post or reel, else the last part of the address that isn't empty."""
    named = _blank_to_null(F.regexp_extract(url, r"/(?:p|reel)/([^/?]+)", 1))
    parts = F.filter(F.split(url, "/"), lambda s: s != "")
    return F.coalesce(named, F.get(parts, F.size(parts) - 1), F.lit("unknown"))


def is_reel(url: Column, has_video: Column | None = None) -> Column:
    return url.contains("/reel/") if has_video is None else url.contains("/reel/") | has_video


def last_segment(url: Column) -> Column:
    """Last path segment that isn't empty, without query and fragment."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-z]+://[^/]*", "")
    return F.get(F.reverse(F.filter(F.split(path, "/"), lambda s: s != "")), F.lit(0))


def query_value(url: Column, name: str) -> Column:
    """Value of a query parameter; null where it is missing or empty."""
    return _blank_to_null(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1))


def absolute_url(href: Column, base: str) -> Column:
    return F.when(href.startswith("http"), href).when(href.startswith("/"), F.concat(F.lit(base), href)).otherwise(F.concat(F.lit(base + "/"), href))


def active_filters(url: Column) -> Column:
    """How many parameters of an address filter, whatever their names; sorting and paging don't count."""
    keys = F.transform(F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda s: s != ""), lambda s: F.substring_index(s, "=", 1))
    return F.size(F.filter(keys, lambda k: ~k.isin("sortBy", "sortOrder", "page")))


#: Names of the filters in an address.
FILTER_KEYS = ("search", "minPrice", "maxPrice", "minYear", "maxYear", "fuelType", "transmission", "bodyType", "sourcePlatform", "city")


def known_filters(url: Column) -> Column:
    """How many of the known filters have a value in an address."""
    return sum((query_value(url, k).isNotNull().cast("int") for k in FILTER_KEYS), F.lit(0))


def slug(text: Column) -> Column:
    """Lower case, runs of other characters as a dash, one dash trimmed from each end."""
    return F.regexp_replace(F.regexp_replace(trimmed(F.lower(text)), "[^a-z0-9]+", "-"), "^-|-$", "")


def slug_untrimmed(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "[^a-zA-Z0-9]+", "-"))


# -- captured pages ----------------------------------------------------------------------------


def unescape_slashes(text: Column) -> Column:
    """Slashes and ampersands as they are, where JSON text has them escaped."""
    return F.regexp_replace(F.replace(text, F.lit("\\/"), F.lit("/")), r"(?i)\\u0026", "&")


def srcset_urls(text: Column) -> Column:
    """Addresses of a srcset attribute."""
    each = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.get(F.split(trimmed(x), r"\s+"), F.lit(0)))
    return F.filter(each, lambda u: u != "")


def caption_of(description: Column) -> Column:
    """Text after the first " - ", less one quote at each end; the whole text without one."""
    at = F.instr(description, F.lit(" - "))
    after = F.substring(description, at + 3, F.length(description))
    return F.when(at > 0, F.regexp_replace(F.regexp_replace(after, '^"', ""), '"$', "")).otherwise(description)


def media_type(content_type: Column) -> Column:
    """Image type of a content-type header; JPEG where it says nothing else."""
    known = F.lower(F.coalesce(content_type, F.lit("")))
    return F.when(known.contains("png"), "image/png").when(known.contains("webp"), "image/webp").when(known.contains("gif"), "image/gif").otherwise("image/jpeg")


def extension_of(media_type: Column) -> Column:
    return F.split_part(media_type, F.lit("/"), F.lit(2))


def object_key(handle: Column, post: Column, number: Column, kind: Column) -> Column:
    """Key under which an image of a post is stored."""
    return F.concat_ws("/", F.lit("instagram"), handle, post, F.concat(number.cast("string"), F.lit("."), extension_of(kind)))


def usable_image(url: Column) -> Column:
    """An image of a post: from the image hosts, neither a profile picture nor a small preview."""
    bad = url.contains("profile_pic") | url.rlike(r"/(s|p)\d{2,3}x\d{2,3}/") | url.rlike("s150x150|s320x320|s240x240")
    return F.coalesce(url.rlike("cdninstagram|fbcdn") & ~bad, F.lit(False))


def image_key(url: Column) -> Column:
    """What tells images apart wherever they are hosted: the cache key, else the file name."""
    key = query_value(url, "ig_cache_key")
    return F.when(key.isNotNull(), F.concat(F.lit("ck:"), key)).otherwise(F.concat(F.lit("f:"), F.coalesce(last_segment(url), F.lit("/"))))


# -- classifiers of free text ------------------------------------------------------------------


def fuel_in(text: Column) -> Column:
    return _blank_to_null(F.lower(F.regexp_extract(text, r"(?i)\b(petrol|diesel|cng|electric|hybrid|lpg)\b", 1)))


def transmission_in(text: Column) -> Column:
    found = _blank_to_null(F.lower(F.regexp_extract(text, r"(?i)\b(manual|automatic|amt|cvt|dct|imt)\b", 1)))
    return F.when(found == "manual", "manual").when(found.isNotNull(), "automatic")


def owners_in(text: Column) -> Column:
    return _blank_to_null(F.regexp_extract(text, r"(?i)(\d+)\s*(?:st|nd|rd|th)?\s*owner", 1)).try_cast("int")


def km_in(text: Column) -> Column:
    return parse_km(_blank_to_null(F.regexp_extract(text, r"(?i)([\d,]+)\s*(?:kms?|km)", 1)))


def attribute_value(label: Column, value: Column) -> Column:
    """Struct of what a labelled attribute of a details page says: year, km_driven, fuel_type, transmission, owner_count."""
    name, said = F.lower(label), F.lower(value)
    has = lambda *words: F.array_contains(F.array(*[name.contains(w) for w in words]), True)
    is_year, is_km, is_fuel = has("year"), has("km", "mileage", "driven"), has("fuel")
    is_transmission, is_owner = has("transmission"), has("owner")
    number = lambda pattern, text: _blank_to_null(F.regexp_extract(text, pattern, 1)).try_cast("int")
    fuel = F.when(F.lit(False), F.lit(None).cast("string"))
    for word in ("petrol", "diesel", "cng", "electric", "hybrid"):
        fuel = fuel.when(said.contains(word), word)
    return F.struct(
        F.when(is_year, number(r"((?:19|20)\d{2})", value)).alias("year"),
        F.when(~is_year & is_km, number(r"(\d+)", F.regexp_replace(value, r"[,\s]", ""))).alias("km_driven"),
        F.when(~is_year & ~is_km & is_fuel, fuel).alias("fuel_type"),
        F.when(~is_year & ~is_km & ~is_fuel & is_transmission, F.when(said.contains("manual"), "manual").otherwise("automatic")).alias("transmission"),
        F.when(~is_year & ~is_km & ~is_fuel & ~is_transmission & is_owner, number(r"(\d+)", value)).alias("owner_count"),
    )


# -- derived values ----------------------------------------------------------------------------


def content_hash(make: Column, model: Column, year: Column, price: Column, url: Column) -> Column:
    """sha256 of the five between bars; null reads "null"."""
    parts = [make, model, year.cast("string"), plain_number(price), url]
    return F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("null")) for p in parts]), 256)


def listing_status(given: Column, price: Column) -> Column:
    return F.coalesce(given, F.when(price.isNotNull(), "priced").otherwise("price_on_request"))


def sold_at(given: Column, sale_status: Column, as_of: Column) -> Column:
    """When it was sold, as far as known: a sold listing without a time was sold now."""
    return F.coalesce(given, F.when(sale_status == "sold", as_of))


def is_retryable(message: Column) -> Column:
    """Whether a failed request may be tried again: not where access was denied."""
    return ~message.contains("403") & ~message.contains("401")


# -- display -----------------------------------------------------------------------------------


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it stands in there. Spark shares nothing
    between the branches of a conditional, and long ones grow beyond what the JVM compiles."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _grouped(n: Column) -> Column:
    part = lambda unit: F.lpad((F.floor(n / unit) % 100).cast("string"), 2, "0")
    tail = F.concat(F.lit(","), F.lpad((n % 1000).cast("string"), 3, "0"))
    long = F.regexp_replace(n.cast("string"), r"(\d)(?=(\d{2})*\d{3}$)", "$1,")
    return (
        F.when((n > -1000) & (n < 1000), n.cast("string"))
        .when((n >= 0) & (n < 100_000), F.concat(F.floor(n / 1000).cast("string"), tail))
        .when((n >= 0) & (n < 10_000_000), F.concat(F.floor(n / 100_000).cast("string"), F.lit(","), part(1000), tail))
        .otherwise(long)
    )


def grouped_digits(number: Column) -> Column:
    """Indian digit groups of a whole number: the last three, then pairs."""
    return _once(number, _grouped)


def format_price(price: Column) -> Column:
    """Crore and lakh with two decimals, else grouped digits with the decimals that say something."""
    two = lambda n: F.concat(F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))
    # hundredths of a unit of so many rupees
    rounded = lambda cents, unit, name: F.concat(_once(F.floor((cents + unit // 2) / unit).cast("long"), two), F.lit(name))

    def said(cents: Column) -> Column:
        small = F.concat(F.when(cents < 0, "-").otherwise(""), grouped_digits(F.floor(F.abs(cents) / 100).cast("long")), _once(F.abs(cents) % 100, _decimals))
        return F.when(cents >= 1_000_000_000, rounded(cents, 10_000_000, " Cr")).when(cents >= 10_000_000, rounded(cents, 100_000, " L")).otherwise(small)

    return F.coalesce(_once(_hundredths(price), said), F.lit("Price on request"))


def is_priced(price: Column) -> Column:
    return F.coalesce(price > 0, F.lit(False))


def format_km(km: Column) -> Column:
    return F.when(km.isNull(), "—").otherwise(F.concat(grouped_digits(km), F.lit(" km")))


def format_date(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "d MMM yyyy"), F.lit("—"))


def capitalize(text: Column) -> Column:
    """First letter only; the rest stays."""
    return F.when(F.coalesce(text, F.lit("")) == "", "—").otherwise(F.concat(F.upper(F.substring(text, 1, 1)), text.substr(F.lit(2), F.length(text))))

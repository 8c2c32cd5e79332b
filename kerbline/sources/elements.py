"""Listings in the elements of captured pages, for pages that say nothing in structured data.

Python only finds the texts and addresses of cards and details pages, a page at a time in Arrow batches;
what they say is read by Spark's functions.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.functions import text as T
from kerbline.operators.spread import spread
from kerbline.operators.stored import Saved
from kerbline.sources import jsonld
from kerbline.sources.markup import Node, tree

_CARD = dict.fromkeys(("title", "price", "location", "href", "image", "said"), "string")
_DETAILS = {"photos": "array<string>", "description": "string", "seller_name": "string", "attributes": "array<struct<label string, value string>>"}


class Elements:
    """Elements of a page in document order: tag, attributes, and the number after their last descendant."""

    def __init__(self, html: str | None):
        self.tag: list[str] = []
        self.attributes: list[dict[str, str]] = []
        self.end: list[int] = []
        self.parent: list[int] = []
        self.last_child: list[bool] = []
        self._pieces: list[str] = []
        self._said: list[list[int]] = []
        self._places: dict[Test, list[int]] = {}
        self._values: dict[str, tuple[list[int], list[str], str]] = {}
        # an element's own number ends it; what a table throws out stands before it
        todo: list[Node | str | int] = tree(html).children[::-1]
        inner, latest = -1, -1  # the element around, and its latest child
        while todo:
            item = todo.pop()
            if isinstance(item, str):
                self._pieces.append(item)
            elif isinstance(item, int):
                self.end[item], self._said[item][1] = len(self.tag), len(self._pieces)
                inner, latest = self.parent[item], item
            elif item.before:
                thrown, item.before = item.before, ()
                todo.append(item)
                todo += thrown[::-1]
            else:
                own = len(self.tag)
                if latest >= 0:
                    self.last_child[latest] = False
                self.tag.append(item.tag)
                self.attributes.append(item.attributes)
                self.last_child.append(True)
                self.parent.append(inner)
                self.end.append(own + 1)
                self._said.append([len(self._pieces), len(self._pieces)])
                if item.children:
                    todo.append(own)
                    todo += item.children[::-1]
                    inner, latest = own, -1
                else:
                    latest = own

    def text(self, i: int | None) -> str:
        return "" if i is None else "".join(self._pieces[slice(*self._said[i])])

    def all(self, *tests: Test) -> list[int]:
        """Elements that any test holds for, each test made once for a page."""
        if len(tests) > 1:
            return sorted({i for test in tests for i in self.all(test)})
        found = self._places.get(tests[0])
        if found is None:
            find, *words = tests[0]
            found = self._places[tests[0]] = find(self, *words)
        return found

    def first(self, i: int | None, *tests: Test) -> int | None:
        """First element inside i, or on the page, that any test holds for."""
        begin, end = (0, len(self.tag)) if i is None else (i + 1, self.end[i])
        nearest = end
        for test in tests:
            found = self._places.get(test)
            if found is None:
                found = self.all(test)
            if found and begin <= found[-1]:
                nearest = min(nearest, found[bisect_left(found, begin)])
        return nearest if nearest < end else None

    def inside(self, i: int, found: list[int]) -> int | None:
        """First of the found elements inside i."""
        at = bisect_left(found, i + 1)
        return found[at] if at < len(found) and found[at] < self.end[i] else None

    def values(self, attribute: str) -> tuple[list[int], list[str], str]:
        """Elements that have the attribute, its values, and these in one text, where a part that none has is soon missed."""
        if attribute not in self._values:
            own = [i for i, attributes in enumerate(self.attributes) if attribute in attributes]
            said = [self.attributes[i][attribute] for i in own]
            self._values[attribute] = own, said, "\n".join(said)
        return self._values[attribute]

    def within(self, outer: list[Test], inner: Test) -> list[int]:
        out, until, opens, at = [], 0, self.all(*outer), 0
        for i in self.all(inner):
            while at < len(opens) and opens[at] < i:
                until, at = max(until, self.end[opens[at]]), at + 1
            if i < until:
                out.append(i)
        return out

    def closest(self, i: int, tag: str) -> int | None:
        """The element itself or the nearest one around it with that tag."""
        while i >= 0 and self.tag[i] != tag:
            i = self.parent[i]
        return i if i >= 0 else None

    def attribute(self, i: int | None, *names: str) -> str | None:
        """The first of the named attributes that the element has."""
        return None if i is None else next((self.attributes[i][n] for n in names if n in self.attributes[i]), None)


#: What finds the elements of a page, in order, and its words: tests of the same words are equal, so a page makes one once.
Test = tuple[Callable[..., list[int]], *tuple[str | None, ...]]


def _has(page: Elements, attribute: str, part: str, tag: str | None) -> list[int]:
    own, values, every = page.values(attribute)
    return [i for i, said in zip(own, values, strict=True) if part in said and (tag is None or page.tag[i] == tag)] if part in every else []


def _equal(page: Elements, attribute: str, value: str) -> list[int]:
    own, values, every = page.values(attribute)
    return [i for i, said in zip(own, values, strict=True) if said == value] if value in every else []


def _tagged(page: Elements, *tags: str) -> list[int]:
    return [i for i, tag in enumerate(page.tag) if tag in tags]


def _last_child(page: Elements, tag: str) -> list[int]:
    return [i for i, t in enumerate(page.tag) if t == tag and page.last_child[i]]


def _classes(page: Elements, *names: str) -> list[int]:
    own, values, every = page.values("class")
    if names[0] not in every:
        return []
    wanted, one = set(names), names[0]
    return [i for i, said in zip(own, values, strict=True) if one in said and wanted.issubset(said.split())]


def has(attribute: str, part: str, tag: str | None = None) -> Test:
    return _has, attribute, part, tag


def equal(attribute: str, value: str) -> Test:
    return _equal, attribute, value


def named(value: str) -> Test:
    return equal("data-aut-id", value)


def tagged(*tags: str) -> Test:
    return _tagged, *tags


def last_child(tag: str) -> Test:
    return _last_child, tag


def classes(*names: str) -> Test:
    return _classes, *names


def card_texts(html: str | None) -> list[tuple]:
    """Cards of a result page. Boxes by their own name need title, price and address; only where there
    is none, whatever is called a card counts, and needs title and price."""
    page, out = Elements(html), []
    said = lambda i: page.text(i).strip()
    get = lambda box, *tests: said(page.first(box, *tests))
    named_or = lambda box, name, word: get(box, has("class", word)) if (own := page.first(box, named(name))) is None else said(own)
    for box in page.all(named("itemBox")):
        link = page.first(box, tagged("a"))
        row = (named_or(box, "itemTitle", "title"), named_or(box, "itemPrice", "price"), named_or(box, "item-location", "location"), page.attribute(link, "href") or "")
        if row[0] and row[1] and row[3]:
            out.append((*row, page.attribute(page.first(box, tagged("img")), "src") or "", page.text(box)))
    if out:
        return out
    for box in page.all(has("class", "card", "li"), has("class", "card", "div"), has("href", "/item/", "a")):
        link = box if page.tag[box] == "a" else page.first(box, tagged("a"))
        row = (get(box, tagged("h2", "h3"), has("class", "title")), get(box, has("class", "price")), get(box, has("class", "location")), page.attribute(link, "href") or "")
        if link is not None and row[0] and row[1]:
            out.append((*row, page.attribute(page.first(box, tagged("img")), "src") or "", page.text(box)))
    return out


_DETAILS_LINK = has("href", "/used-car-details/", "a")
#: What cards of listings are marked by, the first that a page has counts; a second test is for what is around them.
_LISTED: list[tuple[Test, ...]] = [
    (classes("gsc_col-xs-12", "gsc_col-sm-12", "gsc_col-md-12", "gsc_col-lg-12"),), (equal("data-tracking-section", "used-car-listing"),), (classes("usedCarListing"),),
    (_DETAILS_LINK, classes("carsGrid")), (classes("listingCard"),), (has("class", "UsedListingCard"),), (has("class", "usedCarCard"),), (_DETAILS_LINK,),
]
#: Where a card says something, the first that says anything counts; and its links, the first that there is.
_TITLE, _PRICE = [tagged("h3"), tagged("h2"), has("class", "title"), has("class", "carName")], [has("class", "price"), has("class", "Price")]
_LOCATION, _LINK, _IMAGE = [has("class", "location"), has("class", "Location")], [_DETAILS_LINK, has("href", "/used-cars", "a")], tagged("img")


def listed_texts(html: str | None) -> list[tuple]:
    """Cards of a page of listings, as (title, price, location, href, image, said)."""
    page = Elements(html)
    boxes = next((found for card, *around in _LISTED if (found := page.within(around, card) if around else page.all(card))), [])
    if not boxes:
        return []
    titles, prices, locations, links = ([found for test in tests if (found := page.all(test))] for tests in (_TITLE, _PRICE, _LOCATION, _LINK))
    images, out = page.all(_IMAGE), []

    def said(box: int, places: list[list[int]]) -> str:
        for found in places:
            if text := page.text(page.inside(box, found)):
                return text
        return ""

    for box in boxes:
        link = next((i for found in links if (i := page.inside(box, found)) is not None), None)
        href = page.attribute(page.closest(box, "a") if link is None else link, "href") or ""
        image = page.attribute(page.inside(box, images), "src", "data-src", "data-lazy") or ""
        out.append((said(box, titles), said(box, prices), said(box, locations).strip(), href, image, page.text(box)))
    return out


def details_texts(html: str | None) -> tuple:
    """Photos, description, seller and labelled attributes of a details page."""
    page = Elements(html)
    images = page.within([named("image-gallery"), has("class", "gallery"), has("class", "image"), tagged("figure")], tagged("img"))
    photos = [page.attribute(i, "src") or "" for i in images]
    photos = list(dict.fromkeys(p for p in photos if p.startswith("http") and "placeholder" not in p))
    said = lambda *places: next((page.text(i).strip() for i in places if i is not None), None)
    description = said(page.first(None, named("itemDescriptionContent")), page.first(None, has("class", "description")))
    seller = said(page.first(None, named("profileName")), next(iter(page.within([has("class", "seller")], has("class", "name"))), None))
    items = set(page.within([named("itemDetails"), has("class", "detail"), has("class", "attribute")], tagged("li"))) | set(page.all(has("class", "property")))
    attributes = []
    for i in sorted(items):
        label = page.text(i).lower().strip()
        value = said(page.first(i, last_child("span"), tagged("strong"), has("class", "value")))
        attributes.append((label, label if value is None else value))
    return photos, description, seller, attributes


_ARROW = {"string": pa.string(), "array<string>": pa.list_(pa.string()), "array<struct<label string, value string>>": pa.list_(pa.struct([("label", pa.string()), ("value", pa.string())]))}


def _found(pages: DataFrame, read: Callable[[str | None], list[tuple]], columns: dict[str, str]) -> DataFrame:
    """(url, html) -> url, at, columns: what is read from each page. Pages go over all tasks, copies of a
    page to one, where those in one batch are read once."""
    schema = pa.schema([("url", pa.string()), ("at", pa.int32()), *[(name, _ARROW[kind]) for name, kind in columns.items()]])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, htmls = batch.column("url").to_pylist(), batch.column("html").to_pylist()
            known = {html: read(html) for html in dict.fromkeys(htmls)}
            found = [(url, at, *row) for url, html in zip(urls, htmls, strict=True) for at, row in enumerate(known[html])]
            values = zip(*found, strict=True) if found else [()] * len(schema)
            yield pa.record_batch([pa.array(v, f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    return spread(pages.select("url", "html"), "url", "html").mapInArrow(rows, ", ".join(["url string", "at int", *[f"{name} {kind}" for name, kind in columns.items()]]))


def result_cards(pages: DataFrame, base: str) -> DataFrame:
    """(url, html) -> url, at, make, model, variant, year, price, location, source_url, image, said: the cards
    of each result page in order. A null or empty page has none; a card without an address has an empty one."""
    found = _found(pages, card_texts, _CARD)
    read = jsonld.once(found, ["url", "at", "price", "location", "href", "image", "said"], title=T.parse_title(F.col("title"), wide=True))
    title = F.col("title")
    link = lambda c: F.when(F.col(c) == "", "").otherwise(T.absolute_url(F.col(c), base))
    return read.select(
        "url", "at", title["make"].alias("make"), title["model"].alias("model"), title["variant"].alias("variant"), title["year"].alias("year"),
        T.parse_indian_price(F.col("price")).cast("decimal(12,2)").alias("price"), F.nullif("location", F.lit("")).alias("location"), link("href").alias("source_url"), link("image").alias("image"), "said",
    )


def details_pages(pages: DataFrame) -> DataFrame:
    """(url, html) -> url, photos, description, seller_name, year, km_driven, fuel_type, transmission,
    owner_count, one row a page. Of repeated attributes the last that says something counts."""
    found = _found(pages, lambda html: [details_texts(html)], _DETAILS)
    read = found.withColumn("read", F.transform("attributes", lambda a: T.attribute_value(a["label"], a["value"])))
    last = lambda name: F.try_element_at(F.filter(F.transform("read", lambda r: r[name]), lambda x: x.isNotNull()), F.lit(-1))
    return read.select("url", "photos", "description", "seller_name", *[last(n).alias(n) for n in ("year", "km_driven", "fuel_type", "transmission", "owner_count")])


def listed_cards(pages: DataFrame, base: str, search_path: str) -> DataFrame:
    """(url, html) -> the cards with make, model and price on pages of listings; a card without an address
    has that of the search."""
    found, own = _found(pages, listed_texts, _CARD), ["url", "at", "location", "href", "image", "said"]
    titled = jsonld.once(found, [*own, "price"], title=T.parse_title(F.col("title"))).where("title.make IS NOT NULL AND title.model IS NOT NULL")
    priced = jsonld.once(titled, [*own, "title"], price=T.parse_indian_price(F.col("price")).cast("decimal(12,2)")).where("price <> 0")
    title, said = F.col("title"), F.col("said")
    return priced.select(
        F.col("url").alias("page_url"), "at", title["make"].alias("make"), title["model"].alias("model"), title["variant"].alias("variant"), title["year"].alias("year"),
        "price", T.km_in(said).alias("km_driven"), T.fuel_in(said).alias("fuel_type"), T.transmission_in(said).alias("transmission"),
        T.owners_in(said).alias("owner_count"), F.nullif("location", F.lit("")).alias("location"),
        F.when(F.col("href") == "", F.lit(base + search_path)).otherwise(T.absolute_url(F.col("href"), base)).alias("source_url"),
        F.when(F.col("image") == "", F.array().cast("array<string>")).otherwise(F.array(T.absolute_url(F.col("image"), base))).alias("photos"),
    )


def products_or_cards(pages: DataFrame, base: str, search_path: str, city: str, platform: str) -> DataFrame:
    """Listings of each page's structured data; of its cards where that has none. Captures of one address
    with other contents are pages of their own. What the data says is read once, into a working table."""
    told = pages.select("url", "html", F.xxhash64("html").alias("capture"))
    own = Saved(pages.sparkSession, "products").save(jsonld.products(told, base, city, platform, page="capture").drop("block", "within", "source_listing_id"))
    bare = told.join(own.select(F.col("page_url").alias("url"), "capture").distinct(), ["url", "capture"], "left_anti")
    cards = listed_cards(bare, base, search_path).withColumns({"city": F.lit(city), "source_platform": F.lit(platform)})
    return own.drop("capture").unionByName(cards, allowMissingColumns=True).withColumn("source_listing_id", T.details_page_id(F.col("source_url")))

"""Faceted search over listings: filters, orders, pages, totals and facet values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_SIZE = 24
SEARCHED = ("make", "model", "variant", "description")
#: Makes that the featured order puts first, in lower case.
PREMIUM_MAKES = (
    "bmw", "mercedes-benz", "mercedes", "audi", "porsche", "lexus", "jaguar", "land rover", "range rover", "volvo", "mini",
    "lamborghini", "ferrari", "bentley", "rolls-royce", "rolls royce", "maserati", "aston martin", "mclaren", "jeep", "bmw motorrad",
)
#: Names of the sort fields in a URL, and their columns.
SORTS = {"price": "price", "year": "year", "kmDriven": "km_driven", "scrapedAt": "scraped_at"}
#: Facets, and those whose blank values are left out.
FACETS = ("city", "fuel_type", "transmission", "body_type", "source_platform")
OPTIONAL_FACETS = ("fuel_type", "transmission", "body_type")


@dataclass(frozen=True)
class ListingFilters:
    """Only what is set filters: a text that isn't empty, a number that isn't None (0 counts)."""

    search: str | None = None
    min_price: float | None = None
    max_price: float | None = None
    min_year: int | None = None
    max_year: int | None = None
    fuel_type: str | None = None
    transmission: str | None = None
    body_type: str | None = None
    source_platform: str | None = None
    city: str | None = None
    sort_by: str = "scrapedAt"
    sort_order: str = "desc"
    page: int = 1
    page_size: int = PAGE_SIZE


def filters_of(params: Mapping[str, str]) -> ListingFilters:
    """Filters of a URL's parameters: an empty value is as good as none, "0" is a number."""
    number = {"minPrice": float, "maxPrice": float, "minYear": int, "maxYear": int, "page": int}
    names = {"minPrice": "min_price", "maxPrice": "max_price", "minYear": "min_year", "maxYear": "max_year", "fuelType": "fuel_type", "bodyType": "body_type", "sourcePlatform": "source_platform", "sortBy": "sort_by", "sortOrder": "sort_order"}
    known = ("search", "transmission", "city", "page", *names)
    return ListingFilters(**{names.get(k, k): number.get(k, str)(params[k]) for k in known if params.get(k)})


def like_pattern(search: str) -> str:
    """%search%: % and _ are wildcards, a backslash before an ordinary character is dropped."""
    out, at = [], 0
    while at < len(search):
        if search[at] == "\\":
            if at + 1 == len(search):
                raise ValueError("search text ends in a backslash")
            out.append("\\" + search[at + 1] if search[at + 1] in "%_\\" else search[at + 1])
            at += 2
        else:
            out.append(search[at])
            at += 1
    return "%" + "".join(out) + "%"


def build_predicate(filters: ListingFilters) -> Column:
    """Conjunction of the filters that are set, always with is_active."""
    parts = [F.col("is_active")]
    if filters.search:
        parts.append(reduce(Column.__or__, [F.col(c).ilike(like_pattern(filters.search)) for c in SEARCHED]))
    for name, column, lowest in (("min_price", "price", True), ("max_price", "price", False), ("min_year", "year", True), ("max_year", "year", False)):
        bound = getattr(filters, name)
        if bound is not None:
            parts.append(F.col(column) >= bound if lowest else F.col(column) <= bound)
    for name in ("fuel_type", "transmission", "body_type", "source_platform", "city"):
        if getattr(filters, name):
            parts.append(F.col(name) == getattr(filters, name))
    return reduce(Column.__and__, parts)


def search(listings: DataFrame, filters: ListingFilters) -> DataFrame:
    return listings.where(build_predicate(filters))


def featured_order() -> list[Column]:
    """Available, with media, premium make, dearest, newest; the id settles ties."""
    return [
        (F.col("sale_status") == "available").desc_nulls_first(),
        (F.coalesce(F.col("media_count"), F.lit(0)) > 0).desc(),
        F.coalesce(F.lower("make").isin(*PREMIUM_MAKES), F.lit(False)).desc(),
        F.col("price").desc_nulls_last(),
        F.col("scraped_at").desc_nulls_first(),
        F.col("id").asc_nulls_last(),
    ]


def sorted_by(column: str, descending: bool) -> list[Column]:
    """Nulls count as largest; the id settles ties."""
    first = F.col(column).desc_nulls_first() if descending else F.col(column).asc_nulls_last()
    return [first, F.col("id").asc_nulls_last()]


def order_of(filters: ListingFilters) -> list[Column]:
    """The featured order where the newest are asked for (the default), else the one field that is named."""
    if filters.sort_by == "scrapedAt" and filters.sort_order == "desc":
        return featured_order()
    return sorted_by(SORTS[filters.sort_by], filters.sort_order != "asc")


def page_of(df: DataFrame, order: Sequence[Column], page: int, size: int = PAGE_SIZE) -> DataFrame:
    if page < 1:
        raise ValueError("pages count from 1")
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def page_totals(df: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total")).select("total", F.ceil(F.col("total") / size).cast("bigint").alias("total_pages"))


def listing_page(listings: DataFrame, filters: ListingFilters) -> tuple[DataFrame, DataFrame]:
    """A page of listings in its order, and total and total_pages under the same filters."""
    found = search(listings, filters)
    return page_of(found, order_of(filters), filters.page, filters.page_size), page_totals(found, filters.page_size)


def facets(listings: DataFrame, columns: Sequence[str] = FACETS, drop_blank: Sequence[str] = OPTIONAL_FACETS) -> DataFrame:
    """(facet, value) of active rows in one pass; null and blank values go from the `drop_blank` columns."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    out = listings.where("is_active").select(pairs.alias("f")).select("f.facet", "f.value")
    blank = F.col("facet").isin(*drop_blank) & (F.coalesce("value", F.lit("")) == "")
    return out.where(~blank).distinct()

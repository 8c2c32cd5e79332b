"""Validation of listings, reject reasons, run summaries and coverage profiles."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.functions.text import plain_number, trimmed

#: Bounds that a listing must keep.
LEAST_PRICE, MOST_PRICE = 10_000, 100_000_000
LEAST_YEAR, MOST_KM = 1990, 2_000_000


def usable_media(media: Column) -> Column:
    """Items with an http(s) address and a known type; the others don't block a listing."""
    usable = lambda m: F.coalesce(m["url"].rlike("^https?://.+") & m["type"].isin("image", "video"), F.lit(False))
    return F.filter(F.coalesce(media, F.array().cast("array<struct<url:string,type:string,poster_url:string>>")), usable)


def blocking_errors(as_of_year: int) -> Column:
    """What keeps a listing out, in rule order. A null price or distance is fine."""
    blank = lambda c: F.coalesce(trimmed(F.col(c)), F.lit("")) == ""
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    price, year, km = F.col("price"), F.col("year"), F.col("km_driven")
    return F.array_compact(
        F.array(
            F.when(blank("make"), "make is empty"),
            F.when(blank("model"), "model is empty"),
            F.when(~price.between(LEAST_PRICE, MOST_PRICE), say("price ", plain_number(price), f" outside ₹{LEAST_PRICE}–₹{MOST_PRICE} range")),
            F.when(year.isNull(), "year is missing").when(~year.between(LEAST_YEAR, as_of_year + 1), say("year ", year.cast("string"), f" outside {LEAST_YEAR}–{as_of_year + 1} range")),
            F.when(~km.between(0, MOST_KM), say("kmDriven ", km.cast("string"), f" outside 0–{MOST_KM} range")),
        )
    )


def validated(listings: DataFrame, as_of_year: int) -> DataFrame:
    """Adds errors (with a last one that counts unusable media, which doesn't block), valid, and media
    without what can't be used. Listings without a column media have none."""
    if "media" not in listings.columns:
        listings = listings.withColumn("media", F.array().cast("array<struct<url:string,type:string,poster_url:string>>"))
    usable = usable_media(F.col("media"))
    bad = F.size(F.coalesce("media", F.array())) - F.size(usable)
    out = listings.withColumns({"__blocking": blocking_errors(as_of_year), "__bad": bad, "media": usable})
    warning = F.when(F.col("__bad") > 0, F.array(F.concat(F.col("__bad").cast("string"), F.lit(" invalid media item(s) filtered")))).otherwise(F.array().cast("array<string>"))
    return out.withColumns({"errors": F.concat("__blocking", warning), "valid": F.size("__blocking") == 0}).drop("__blocking", "__bad")


def reject_reasons(checked: DataFrame, key: str) -> DataFrame:
    """key, reason ("key: e1, e2") of the rows that aren't valid."""
    bad = checked.where(~F.col("valid"))
    return bad.select(key, F.concat(F.col(key).cast("string"), F.lit(": "), F.array_join("errors", ", ")).alias("reason"))


def run_summary(checked: DataFrame) -> DataFrame:
    out = checked.agg(F.count(F.lit(1)).alias("found"), F.count_if(F.col("valid")).alias("accepted"), F.count_if(~F.col("valid")).alias("rejected"))
    return out.withColumn("status", F.when(F.col("rejected") > 0, "completed_with_errors").otherwise("completed"))


def error_message(problems: DataFrame) -> DataFrame:
    """(run, section, position, line) -> run, message: the lines of section "error" by line break, then,
    after a blank line and under a heading, those of section "rejection".

    A run's report goes into one cell of its ledger row, so its lines are gathered; they are as many as
    one run had problems.
    """
    lines = lambda section: F.transform(F.array_sort(F.collect_list(F.when(F.col("section") == section, F.struct("position", "line")))), lambda x: x["line"])
    whole = problems.groupBy("run").agg(lines("error").alias("errors"), lines("rejection").alias("rejections"))
    said = F.when(F.size("errors") > 0, F.array_join("errors", "\n"))
    refused = F.when(F.size("rejections") > 0, F.concat(F.lit("Validation rejections:\n"), F.array_join("rejections", "\n")))
    return whole.select("run", F.concat_ws("\n\n", said, refused).alias("message"))


def is_filled(df: DataFrame, column: str) -> Column:
    """Whether a value says something: not null, not empty, not 0."""
    kind = df.schema[column].dataType.typeName()
    c = F.col(column)
    filled = F.size(c) > 0 if kind == "array" else c != "" if kind == "string" else c if kind == "boolean" else c != 0
    return F.coalesce(filled, F.lit(False))


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """field, n_filled, percent (rounded): one pass, one row for each column."""
    one = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(is_filled(df, c)).alias(c) for c in columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n_filled")) for c in columns]))
    out = one.select("__n", rows.alias("r"))
    percent = F.when(F.col("__n") > 0, F.floor((F.col("r.n_filled") * 200 + F.col("__n")) / (2 * F.col("__n")))).cast("bigint")
    return out.select("r.field", "r.n_filled", percent.alias("percent"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def expectations(df: DataFrame, required: list[str], key: str, constant: Mapping[str, str]) -> DataFrame:
    """check, n_failed: what a source's listings must keep, in one pass.

    Required fields are filled, years lie in 1990-2027, prices above 0 and up to 1e8, addresses begin
    with http, no address repeats, and the given columns hold one value.
    """
    checks = {f"{c} is filled": F.count_if(~is_filled(df, c)) for c in required}
    checks["year in 1990-2027"] = F.count_if(~F.coalesce(F.col("year").between(1990, 2027), F.lit(False)))
    checks["price in 0-1e8"] = F.count_if((F.col("price") <= 0) | (F.col("price") > 100_000_000))
    checks[f"{key} is an address"] = F.count_if(~F.coalesce(F.col(key).startswith("http"), F.lit(False)))
    checks[f"{key} is unique"] = F.count(F.lit(1)) - F.count_distinct(key)
    checks |= {f"{c} is {v}": F.count_if(~F.coalesce(F.col(c) == v, F.lit(False))) for c, v in constant.items()}
    one = df.agg(*[c.alias(f"c{k}") for k, c in enumerate(checks.values())])
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("check"), F.col(f"c{k}").alias("n_failed")) for k, name in enumerate(checks)]))
    return one.select(rows.alias("r")).select("r.*")

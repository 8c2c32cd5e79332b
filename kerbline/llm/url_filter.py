"""Temporal URL lists: dated entries become validity intervals, and each capture is judged by the
entries that were active when it was fetched. DataFrame operations only.

An entry is a dated instruction of a list: from `since` on, `pattern` has `action` ("allow", "block",
or "clear", which ends it). A pattern is a host ("example.org", which also covers its subdomains) or a
host and a path prefix ("example.org/private", whole path segments). Entries of one list and pattern
follow each other, so each is valid until the next: an interval.

A capture is looked up under every pattern that can cover its URL: each parent domain of its host with
each leading run of path segments, for the numbers of labels and segments that entries have. The as-of
join matches pattern and fetch time with the intervals. Of the active entries the longest pattern decides; of equal ones, "allow".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbline.llm.common import broadcast_if_small


def host_of(url: Column) -> Column:
    """Host in lower case without user, port and final dot; empty where there is none."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://", "")
    authority = F.regexp_extract(rest, r"^[^/?#\\\s]*", 0)
    return F.rtrim(F.regexp_replace(F.lower(F.regexp_replace(authority, r"^.*@", "")), r":[0-9]*$", ""), F.lit("."))


def path_of(url: Column) -> Column:
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://", "")
    return F.regexp_extract(rest, r"^[^/?#\\\s]*([^?#\s]*)", 1)


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, action, since) -> list, pattern, action, valid_from, valid_to (null: still valid).

    Of entries with one list, pattern and time, "block" comes before "allow" before "clear" and the
    last holds; entries without pattern, action or time hold nowhere.
    """
    rank = F.when(F.col("action") == "block", 0).when(F.col("action") == "allow", 1).otherwise(2)
    known = entries.where("pattern IS NOT NULL AND action IS NOT NULL AND since IS NOT NULL")
    known = known.groupBy("list", F.lower("pattern").alias("pattern"), "since").agg(F.max_by("action", rank).alias("action"))
    after = F.lead("since").over(Window.partitionBy("list", "pattern").orderBy("since"))
    spans = known.select("list", "pattern", "action", F.col("since").alias("valid_from"), after.alias("valid_to"))
    return spans.where("action <> 'clear'")


def _shapes(spans: DataFrame) -> DataFrame:
    """One row, shapes: the different (labels, segments) numbers that the patterns have."""
    parts = F.split("pattern", "/")
    labels = F.size(F.split(F.get(parts, F.lit(0)), r"\."))
    shapes = spans.select(F.struct(labels.alias("labels"), (F.size(parts) - 1).alias("segments")).alias("shape")).distinct()
    return shapes.agg(F.collect_set("shape").alias("shapes"))  # as many as patterns differ in form


def _patterns(host: Column, path: Column, shapes: Column) -> Column:
    """All patterns of these shapes that can cover a URL."""
    labels = F.split(host, r"\.")
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    fitting = F.filter(shapes, lambda x: (x["labels"] <= F.size(labels)) & (x["segments"] <= F.size(segments)))
    domain = lambda x: F.array_join(F.slice(labels, -x["labels"], x["labels"]), ".")
    run = lambda x: F.when(x["segments"] > 0, F.concat(F.lit("/"), F.array_join(F.slice(segments, 1, x["segments"]), "/"))).otherwise("")
    return F.transform(fitting, lambda x: F.concat(domain(x), F.lower(run(x))))


def judge_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, url, fetched, ...) x (list, pattern, action, since) -> one row per capture.

    page_id, url, host, fetched, n_active (active entries that cover it), pattern and action of the
    deciding one (null where none is active), kept (not blocked). A null or empty URL has an empty host
    and is covered by nothing; so is a capture without `fetched`. Rows that repeat a page_id with one
    URL and time are judged alike. Very long URLs are read whole; other columns are ignored; without
    entries all captures are kept, without captures there are no rows.
    """
    key = ["page_id", "url", "fetched"]
    intervals = validity_intervals(entries)
    spans = broadcast_if_small(intervals)
    own = captures.select("page_id", "url", "fetched", host_of(F.col("url")).alias("host"))
    known = own.where("host <> '' AND fetched IS NOT NULL").crossJoin(F.broadcast(_shapes(intervals)))
    asked = known.select(*key, F.explode_outer(_patterns(F.col("host"), path_of(F.col("url")), F.col("shapes"))).alias("pattern"))
    active = asked.distinct().join(spans, "pattern").where("fetched >= valid_from AND (valid_to IS NULL OR fetched < valid_to)")
    order = F.struct(F.length("pattern"), F.col("pattern"), (F.col("action") == "allow").cast("int"))
    decided = active.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("pattern", "action"), order).alias("by"))
    decided = decided.select(*[F.col(k).alias(f"__{k}") for k in key], "n", "by")
    same = F.col("__page_id").eqNullSafe(F.col("page_id")) & (F.col("__url") == F.col("url")) & (F.col("__fetched") == F.col("fetched"))
    out = own.join(decided, same, "left")
    return out.select(
        *key, "host", F.coalesce("n", F.lit(0)).cast("long").alias("n_active"), F.col("by.pattern").alias("pattern"), F.col("by.action").alias("action"),
        F.coalesce(F.col("by.action") != "block", F.lit(True)).alias("kept"),
    )

"""Incremental work: first occurrences, chunks and their results, early stop, and the recheck rule."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbline.operators.stored import Saved

RECHECK_HOURS = 48


def first_seen(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """First row of each key in arrival order. Grouping, so frequent keys combine before the shuffle."""
    rest = [c for c in df.columns if c != key]
    kept = df.groupBy(key).agg(F.min(F.struct(F.struct(*order).alias("o"), F.struct(*rest).alias("v"))).alias("f"))
    return kept.select(key, *[F.col(f"f.v.{c}").alias(c) for c in rest]).select(*df.columns)


def top_n(df: DataFrame, group: str, order: Sequence, n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)


#: Microseconds of a slot of time, and consecutive whole numbers of one, in which rows of a key are ranked together.
SLOT, SLOT_NUMBERS = 60_000_000, 1 << 16


def _micros(c: Column | str) -> Column:
    """A time as whole microseconds; it keeps the order."""
    return F.unix_micros(F.to_timestamp(c))


def slot_of(df: DataFrame, column: str) -> Column:
    """Number of the slot that a time or whole number falls into."""
    kind = df.schema[column].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.floor(_micros(F.col(column)) / SLOT)
    if kind in ("byte", "short", "integer", "long"):
        return F.floor(F.col(column) / SLOT_NUMBERS)
    raise ValueError(f"{column} is a {kind}; give the slot of its rows")


def ranks(df: DataFrame, group: str, order: Sequence[str], slot: Column | None = None) -> DataFrame:
    """Adds rank (long, from 1) of each row in its group, by two-level counts.

    A group is cut into slots of its first order column; slot must not fall where that column rises.
    Rows are ranked inside their slot, after the running count of the slots before it, so only slots, one
    row each, of a group come together. Rows without a value of the first column come first. Ties of all
    of `order` are ranked in any order.
    """
    slotted = df.withColumn("__slot", slot if slot is not None else slot_of(df, order[0]))
    counts = slotted.groupBy(group, "__slot").agg(F.count(F.lit(1)).alias("__n"))
    running = F.sum("__n").over(Window.partitionBy(group).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select(F.col(group).alias("__g"), F.col("__slot").alias("__s"), F.coalesce(running, F.lit(0)).alias("__before"))
    joined = slotted.join(before, F.col(group).eqNullSafe(F.col("__g")) & F.col("__slot").eqNullSafe(F.col("__s")))
    inside = F.row_number().over(Window.partitionBy(group, "__slot").orderBy(*order))
    return joined.withColumn("rank", F.col("__before") + inside).drop("__slot", "__g", "__s", "__before")


def chunk_numbers(df: DataFrame, group: str, order: Sequence[str], size: int = 6, slot: Column | None = None) -> DataFrame:
    """chunk (from 0) and index in it (from 1) of each row of a group, however many rows it has."""
    out = ranks(df, group, order, slot).withColumn("rank", F.col("rank") - 1)
    return out.withColumns({"chunk": F.floor(F.col("rank") / size).cast("int"), "index": (F.col("rank") % size + 1).cast("int")}).drop("rank")


def chunks_to_send(items: DataFrame, keys: Sequence[str], content: Column, images: str) -> DataFrame:
    """keys, n_items, n_images of the chunks that have any text or image; the others get empty results unasked."""
    there = (F.coalesce(content, F.lit("")) != "") | (F.col(images) > 0)
    out = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_items"), F.sum(images).alias("n_images"), F.bool_or(there).alias("__any"))
    return out.where("__any").drop("__any")


#: What an extractor says of an item that it says nothing of.
EMPTY_RECORD = {"is_car_listing": False}


def aligned(items: DataFrame, results: DataFrame, keys: Sequence[str] = ("chunk", "index"), values: Sequence[str] = ("value",), order: str = "pos", empty: Mapping[str, object] | None = None) -> DataFrame:
    """Items with the last result for their index, and answered; indexes without an item are dropped, items
    without a result have the empty record: what `empty` says, else null."""
    last = results.groupBy(*keys).agg(F.max(F.struct(order, F.struct(*values).alias("v"))).alias("r"))
    joined = items.join(last, list(keys), "left").withColumn("answered", F.col("r").isNotNull())
    pick = lambda c: F.when(F.col("answered"), F.col(f"r.v.{c}")).otherwise(F.lit((empty or {}).get(c)))
    return joined.withColumns({c: pick(c) for c in values}).drop("r")


def extracted(posts: DataFrame, group: str, order: Sequence[str], content: str, images: str, ask: Callable[[DataFrame], DataFrame], values: Sequence[str], size: int = 6) -> DataFrame:
    """Posts with what an extractor says of each, chunk by chunk, in one flow.

    Posts are dealt into chunks of their group; chunks with any text or image are asked; `ask` takes their
    posts (with chunk and index) and returns (group, chunk, index, pos, values) of whatever it answers, in
    any order, repeated or beside the point. Posts of other chunks and without an answer get the empty record.
    """
    chunked = chunk_numbers(posts, group, order, size)
    asked = chunks_to_send(chunked, [group, "chunk"], F.col(content), images).select(group, "chunk")
    answers = ask(chunked.join(asked, [group, "chunk"], "left_semi"))
    return aligned(chunked, answers, (group, "chunk", "index"), values, empty=EMPTY_RECORD)


def enriched(cards: DataFrame, details: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Cards with what their details page says; where it says nothing (null, no items), the card's own."""
    found = details.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in columns])
    kinds = {c: cards.schema[c].dataType.typeName() for c in columns}
    pick = lambda c: F.when(F.size(f"__{c}") > 0, F.col(f"__{c}")).otherwise(F.col(c)) if kinds[c] == "array" else F.coalesce(f"__{c}", c)
    return cards.join(found, F.col(key) == F.col("__key"), "left").withColumns({c: pick(c) for c in columns}).select(*cards.columns)


def until_empty(pages: DataFrame, page: str = "page", rows: str = "n_rows") -> DataFrame:
    """Pages before the first one without rows."""
    stop = pages.where(F.col(rows) == 0).agg(F.coalesce(F.min(page), F.lit(2**31 - 1)).alias("stop"))
    return pages.where(F.col(page) < stop.scalar())


def checked_since(candidates: DataFrame, checked: DataFrame, key: str, as_of: str, hours: int = RECHECK_HOURS) -> DataFrame:
    """Candidates that were checked within `hours` of `as_of`; a check at the limit counts."""
    return candidates.join(_recent(checked, key, as_of, hours), key, "left_semi")


def not_recent(candidates: DataFrame, checked: DataFrame, key: str, as_of: str, hours: int = RECHECK_HOURS) -> DataFrame:
    """The other candidates."""
    return candidates.join(_recent(checked, key, as_of, hours), key, "left_anti")


def _recent(checked: DataFrame, key: str, as_of: str, hours: int) -> DataFrame:
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {hours} HOURS")
    return checked.where(F.col("last_checked_at") >= cutoff).select(key)


#: A key with more events than this is followed by links between them instead of by one task.
HOT_ROWS = 1_000_000


def greedy_recheck(events: DataFrame, key: str, ts: str, hours: int = RECHECK_HOURS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds processed: true where the key's last processed event lies more than `hours` back, or none is.

    Each processed event sets the key's clock, so order matters. Keys of up to `hot_rows` events are dealt
    out, sorted and read once; a search jumps from one processed event to the next. The events of larger
    keys are linked to their successors and followed by doubling, which no task does alone. Of events of
    one key and time all are processed or none. Rows without key or time are not processed and set no clock.
    """
    hot = events.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where((F.col("__n") > hot_rows) & F.col(key).isNotNull()).select(key)
    if hot.isEmpty():
        return _recheck_by_key(events, key, ts, hours)
    linked = events.join(hot, key, "left_semi")
    return _recheck_by_key(events.join(hot, key, "left_anti"), key, ts, hours).unionByName(_recheck_by_links(linked, key, ts, hours))


def successors(times: DataFrame, hours: int = RECHECK_HOURS) -> DataFrame:
    """Different (k, t) -> k, t, next: the key's first time more than `hours` after t, in microseconds; null at its end.

    Times and the moments that they ask for are put into slots. Inside a slot a moment meets the first
    later time; where there is none, the first of the next slot that has any. Only slots of a key, one row
    each, come together; they are as many as its span of time has, whatever its events.
    """
    wait = hours * 3_600_000_000
    both = times.select("k", F.col("t").alias("at"), F.lit(0).alias("asks")).unionByName(times.select("k", (F.col("t") + wait).alias("at"), F.lit(1).alias("asks")))
    slotted = both.withColumn("slot", F.floor(F.col("at") / SLOT))
    slots = slotted.groupBy("k", "slot").agg(F.min(F.when(F.col("asks") == 0, F.col("at"))).alias("least"))
    # read from the end: a frame that looks ahead is computed anew for each row, one that looks back is carried on
    behind = (Window.unboundedPreceding, -1)
    ahead = F.last("least", ignorenulls=True).over(Window.partitionBy("k").orderBy(F.desc("slot")).rowsBetween(*behind))
    slots = slots.select("k", "slot", ahead.alias("beyond"))
    # at one moment times stand before what asks for a later one
    here = F.last(F.when(F.col("asks") == 0, F.col("at")), ignorenulls=True).over(Window.partitionBy("k", "slot").orderBy(F.desc("at"), F.desc("asks")).rowsBetween(*behind))
    met = slotted.withColumn("here", here).where("asks = 1").join(slots, ["k", "slot"])
    return met.select("k", (F.col("at") - wait).alias("t"), F.coalesce("here", "beyond").alias("next"))


def _recheck_by_links(events: DataFrame, key: str, ts: str, hours: int) -> DataFrame:
    """The rule by successor links: the processed times are those that the first one leads to. Links double
    in length each round, and those reached double in number, so rounds are the logarithm of the longest chain."""
    work = Saved(events.sparkSession, "recheck")
    own = events.withColumns({"__k": F.col(key), "__t": _micros(F.col(ts))})
    times = work.save(own.where("__k IS NOT NULL AND __t IS NOT NULL").select(F.col("__k").alias("k"), F.col("__t").alias("t")).distinct())
    links = work.save(successors(times, hours))
    reached = work.save(times.groupBy("k").agg(F.min("t").alias("t")))
    work.drop(times)
    while True:
        follow = links.where("next IS NOT NULL")
        if follow.isEmpty():
            break
        more = reached.join(follow, ["k", "t"]).select("k", F.col("next").alias("t"))
        longer = follow.join(follow.select("k", F.col("t").alias("next"), F.col("next").alias("after")), ["k", "next"]).select("k", "t", F.col("after").alias("next"))
        reached_now, links_now = work.save(reached.unionByName(more).distinct()), work.save(longer)
        work.drop(reached, links)
        reached, links = reached_now, links_now
    marks = reached.select(F.col("k").alias("__k"), F.col("t").alias("__t"), F.lit(True).alias("__done"))
    return own.join(marks, ["__k", "__t"], "left").select(*events.columns, F.coalesce("__done", F.lit(False)).alias("processed"))


def _recheck_by_key(events: DataFrame, key: str, ts: str, hours: int) -> DataFrame:
    window = np.timedelta64(hours, "h")
    at_ts, at_key = events.columns.index(ts), events.columns.index(key)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key, clock = None, None
        for batch in batches:
            keys, times = batch.iloc[:, at_key], batch.iloc[:, at_ts].to_numpy("datetime64[us]")
            done = np.zeros(len(batch), dtype=bool)
            known = np.flatnonzero((keys.notna() & ~np.isnat(times)).to_numpy())
            held = keys.to_numpy()[known]
            begins = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1]))) if len(held) else []
            for begin, end in zip(begins, [*begins[1:], len(held)], strict=True):
                own = times[known[begin:end]]
                if held[begin] != last_key:
                    last_key, clock = held[begin], None
                at = 0 if clock is None else np.searchsorted(own, clock + window, side="right")
                if clock is not None:  # the clock's own time may go on in this batch
                    done[known[begin : begin + np.searchsorted(own, clock, side="right")]] = True
                while at < len(own):
                    clock = own[at]
                    upto = np.searchsorted(own, clock, side="right")
                    done[known[begin + at : begin + upto]] = True
                    at = np.searchsorted(own, clock + window, side="right")
            yield batch.assign(processed=done)

    schema = events.schema.add("processed", "boolean")
    return events.repartition(F.col(key)).sortWithinPartitions(key, ts).mapInPandas(scan, schema)

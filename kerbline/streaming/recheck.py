"""The recheck rule over a stream: a clock for each key, and a timer that decides what is due and frees it."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from kerbline.operators.incremental import RECHECK_HOURS

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Rows wait as JSON; times keep their microseconds.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


class RecheckClock(StatefulProcessor):
    """Rows of a key wait until the watermark has passed them, so they are judged in the order of time
    whatever batch they came in. A key's clock goes once the watermark lies `wait` behind it, for then the
    next row is due whether there is a clock or not."""

    def __init__(self, wait: int):
        self.wait = wait  # microseconds

    def init(self, handle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "t long")
        self.waiting = handle.getListState("waiting", "t long, row string")

    def _wake(self, at: int) -> None:
        """One timer a key, at the earliest moment asked for (microseconds)."""
        at = math.ceil(at / 1000)
        timers = list(self.handle.listTimers())
        if timers and min(timers) <= at:
            return
        for t in timers:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        least = None
        for batch in rows:
            times = batch["micros"].tolist()
            self.waiting.appendList(list(zip(times, batch["row"].tolist(), strict=True)))
            least = min(times) if least is None else min(least, *times)
        if least is not None:
            self._wake(least)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = list(self.waiting.get())
        due, later = sorted(tuple(r) for r in held if r[0] <= passed), [tuple(r) for r in held if r[0] > passed]
        clock = self.clock.get()[0] if self.clock.exists() else None
        out = []
        for t, row in due:
            if clock is None or t > clock + self.wait:
                clock = t
            out.append((key[0], row, t == clock))
        self.waiting.clear()
        if later:
            self.waiting.put(later)
        if clock is None or (not later and clock + self.wait <= passed):
            self.clock.clear()
        else:
            self.clock.update((clock,))
        wake = min([t for t, _ in later], default=None if clock is None or clock + self.wait <= passed else clock + self.wait)
        if wake is not None:
            self.handle.registerTimer(math.ceil(wake / 1000))
        if out:
            yield pd.DataFrame(out, columns=["key", "row", "processed"])


def recheck_stream(stream: DataFrame, key: str, ts: str, delay: str, hours: int = RECHECK_HOURS) -> DataFrame:
    """Adds processed to the rows of a stream, by the rule of `greedy_recheck`: true where the key's last
    processed row lies more than `hours` back, or none is.

    A row is given out once the watermark, `delay` behind the latest time, has passed it; up to that delay
    rows may come in any order and any split into batches. Later ones, and rows without key or time, go.
    The session's state must be kept in RocksDB, which this sets.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    known = stream.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    at = F.to_timestamp(F.col(ts))
    rows = known.select(F.col(key).cast("string").alias("key"), at.alias("at"), F.unix_micros(at).alias("micros"), F.to_json(F.struct("*"), _JSON | {"ignoreNullFields": "false"}).alias("row"))
    clock = RecheckClock(hours * 3_600_000_000)
    judged = rows.withWatermark("at", delay).groupBy("key").transformWithStateInPandas(clock, "key string, row string, processed boolean", "Append", "EventTime")
    return judged.select(F.from_json("row", stream.schema, _JSON).alias("r"), "processed").select("r.*", "processed")

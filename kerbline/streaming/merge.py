"""Streaming forms: a keyed merge by micro-batch, and first rows within a delay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kerbline.operators.stored import KeyedTable


def merge_stream(stream: DataFrame, table: KeyedTable, checkpoint: str, seq: Sequence[str], writer: str = "stream") -> StreamingQuery:
    """Starts a query that folds each micro-batch into a stored table.

    The table knows the number of the last batch of each writer, so a batch that is repeated after a
    failure changes nothing. `writer` must be the query's own and go with its checkpoint.
    """
    return stream.writeStream.foreachBatch(lambda batch, number: table.merge(batch, writer, number, seq)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_within(stream: DataFrame, key: str, ts: str, delay: str = "48 hours") -> DataFrame:
    """First row of each key within the watermark's delay; repeated rows go, and so does old state. Not
    the recheck rule: state expires by the watermark, not by the last processed row."""
    return stream.withColumn("__t", F.col(ts).cast("timestamp")).withWatermark("__t", delay).dropDuplicatesWithinWatermark([key]).drop("__t")

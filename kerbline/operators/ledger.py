"""The run ledger and the usage log: append-only tables whose last entry for an id is its state."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def started(run_id: str, source: str, at: str, spark) -> DataFrame:
    """Entry of a run that begins."""
    return spark.createDataFrame([(run_id, source, "running", at, None, None, None, None, None, None)], RUNS)


RUNS = "run_id string, source_platform string, status string, at string, found long, new long, updated long, rejected long, rejection_reasons string, error_message string"


#: Entries of runs whose report is kept beside them, a row for each line.
ENTRIES = RUNS.split(", rejection_reasons")[0]
LINES = "run string, section string, position struct<n:long,by:string>, line string"


def run_status(n_source_errors: int, n_rejected: int) -> str:
    return "completed_with_errors" if n_source_errors or n_rejected else "completed"


def report_chunks(lines: DataFrame) -> DataFrame:
    """LINES -> run, section, range, number, text: each report in pieces, whose order is that of the columns.
    Lines are sorted by ranges, so no report comes together in one task; a piece ends without a line break."""

    schema = pa.schema([("run", pa.string()), ("section", pa.string()), ("range", pa.int32()), ("number", pa.int64()), ("text", pa.string())])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(batches):
            pieces: dict[tuple, list[str]] = {}
            for row in zip(*(batch.column(c).to_pylist() for c in ("run", "section", "range", "line")), strict=True):
                pieces.setdefault(row[:3], []).append(row[3])
            rows = [(*place, number, "\n".join(said)) for place, said in pieces.items()]
            yield pa.record_batch([pa.array([row[k] for row in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    ordered = lines.where("line IS NOT NULL").orderBy("run", "section", "position.n", "position.by", "line")
    return ordered.select("run", "section", "line", F.spark_partition_id().alias("range")).mapInArrow(texts, "run string, section string, range int, number long, text string")


def report_digests(lines: DataFrame) -> DataFrame:
    """LINES -> run, reasons_md5, message_md5: md5 of the rejections by line break, and of the message as
    `quality.error_message` words it, over the whole texts. A digest takes a report piece by piece, in order."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, said, done = None, {}, []

        def end() -> None:
            if run is not None:
                done.append((run, reasons.hexdigest() if said.get("rejection") else None, message.hexdigest()))

        for batch in batches:
            for name, section, text in zip(*(batch.column(c).to_pylist() for c in ("run", "section", "text")), strict=True):
                if name != run:
                    end()
                    run, said, reasons, message = name, {}, hashlib.md5(), hashlib.md5()
                heading = "Validation rejections:\n" if section == "rejection" else ""
                before = "\n" if said.get(section) else ("\n\n" if said else "") + heading
                message.update((before + text).encode())
                if section == "rejection":
                    reasons.update((("\n" if said.get(section) else "") + text).encode())
                said[section] = True
        end()
        yield pa.RecordBatch.from_arrays([pa.array([row[k] for row in done], pa.string()) for k in range(3)], ["run", "reasons_md5", "message_md5"])

    pieces = report_chunks(lines).repartition("run").sortWithinPartitions("run", "section", "range", "number")
    return pieces.select("run", "section", "text").mapInArrow(digests, "run string, reasons_md5 string, message_md5 string")


def current(entries: DataFrame, key: str, order: str) -> DataFrame:
    """Last entry of each id; started_at is the time of its first."""
    rest = [c for c in entries.columns if c not in (key, order)]
    out = entries.groupBy(key).agg(F.min(order).alias("started_at"), F.max(F.struct(order, *rest)).alias("l"))
    return out.select(key, "started_at", F.col(f"l.{order}").alias("last_at"), *[F.col(f"l.{c}").alias(c) for c in rest])


def append_quietly(write: Callable[[], None]) -> bool:
    """Runs an append that must never fail its caller; tells whether it worked."""
    try:
        write()
    except Exception:  # noqa: BLE001  a log entry is not worth a failed run
        return False
    return True


def usage(calls: DataFrame) -> DataFrame:
    """Entries of the usage log from calls: total_tokens where it is missing, success where there is no error."""
    total = F.coalesce("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
    return calls.withColumns({"total_tokens": total, "success": F.col("error_message").isNull()})


def is_healthy(listings: DataFrame) -> bool:
    """Whether a source gives any listing; reads no further than the first."""
    return not listings.isEmpty()

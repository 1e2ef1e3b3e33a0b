"""Segments to the event table, exactly once.

The stream's checkpoint moves only after a micro-batch is appended, and the
append skips ids the table already has, so a replay of any length adds nothing.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from eventloom.operators.envelopes import accepted, check_batches, rejected
from eventloom.schema import Limits
from eventloom.session import configure
from eventloom.sources import rollup_table, text_sieve
from eventloom.sources.segments import split_bad_lines, stream_segments
from eventloom.sources.store import append_new


def run_ingest(
    spark: SparkSession, source: str, store: str, checkpoint: str, rejects: str | None = None,
    max_files: int = 1000, interval: str | None = "200 milliseconds", available_now: bool = False,
    archive: str | None = None, rollup: bool = False, sieve: bool = False,
) -> StreamingQuery:
    """Start copying segments below `source` into the table at `store`.

    Lines that are not events go to `rejects` as text (default: `<store>__rejects`)
    and never stop the stream.  `available_now` drains what has landed and ends.  Segments
    move to `archive`, when given, once they are in the table.  With `rollup`, the
    stored hours of :mod:`eventloom.sources.rollup_table` follow each micro-batch; with
    `sieve`, so do the text bitmaps of :mod:`eventloom.sources.text_sieve`.
    """
    configure(spark)
    rejects = (rejects or f"{store.rstrip('/')}__rejects").rstrip("/")

    def write(lines: DataFrame, epoch: int) -> None:
        session = configure(lines.sparkSession)
        lines = lines.persist(StorageLevel.MEMORY_AND_DISK)  # both halves read it
        try:
            events, bad = split_bad_lines(lines)
            days = append_new(session, store, events)
            if rollup:
                rollup_table.update(session, store, days)
            if sieve:
                text_sieve.update(session, store, days)
            # Overwriting one folder per micro-batch keeps retries from repeating lines.
            bad.write.mode("overwrite").text(f"{rejects}/batch={epoch}")
        finally:
            lines.unpersist()

    writer = (
        stream_segments(spark, source, max_files, archive)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def run_body_ingest(
    bodies: DataFrame, sources: DataFrame, store: str, checkpoint: str, rejects: str | None = None,
    interval: str | None = "200 milliseconds", available_now: bool = False, limits: Limits = Limits(),
) -> StreamingQuery:
    """Start checking posted bodies (a stream of ``batch_id, source_id, received_at, body``) into the table at `store`.

    Each micro-batch is checked once: events of admitted batches are appended,
    verdicts on the others go to `rejects` (default: ``<store>__rejects``) as
    Parquet, a folder per micro-batch.  Ids follow from content, so a replay
    adds nothing.
    """
    configure(bodies.sparkSession)
    rejects = (rejects or f"{store.rstrip('/')}__rejects").rstrip("/")

    def write(batch: DataFrame, epoch: int) -> None:
        session = configure(batch.sparkSession)
        checked = check_batches(batch, sources, limits).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            append_new(session, store, accepted(checked, limits))
            rejected(checked).write.mode("overwrite").parquet(f"{rejects}/batch={epoch}")
        finally:
            checked.unpersist()

    writer = bodies.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def dedup_stream(ev: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A stream with each id once within the delay; state is bounded by the watermark.

    For duplicates any distance apart, rely on :func:`run_ingest`.
    """
    return ev.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["_id"])

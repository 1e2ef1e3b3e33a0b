"""Newline-delimited JSON segments, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.values import get
from eventloom.operators.pages import document_sql
from eventloom.schema import EVENT_COLUMNS

SEGMENT_GLOB = "seg-*.ndjson"
READER = {"lineSep": "\n", "pathGlobFilter": SEGMENT_GLOB}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.options(**READER).text(path)


def parse_events(doc: str = "_doc") -> list[str]:
    """SQL for the event columns of a stored JSON document; ISO text becomes instants."""
    texts = ("_id", "app", "env", "event", "level", "ts", "message")
    return [
        *[f"{get(doc, '$.' + c, 'string')} as {c}" for c in texts],
        f"{get(doc, '$.ids', 'map<string,string>')} as ids",
        f"{get(doc, '$.data', 'variant')} as data",
        f"try_to_timestamp({get(doc, '$.receivedAt', 'string')}) as received_at",
        f"try_to_timestamp({get(doc, '$.expiresAt', 'string')}) as expires_at",
    ]


def split_bad_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines ``value STRING`` to (events, bad lines).  Works on batches and streams.

    An event has every text that the table requires, and instants that can be
    read: a line without them could neither be found again nor expire.
    """
    parsed = lines.filter("trim(value) <> ''").selectExpr("value", "try_parse_json(value) as _doc")
    needed = [get("_doc", f"$.{c}", "string") for c in ("_id", "app", "env", "event", "level")]
    needed += [f"try_to_timestamp({get('_doc', f'$.{c}', 'string')})" for c in ("receivedAt", "expiresAt")]
    good = " and ".join(f"{e} is not null" for e in needed)
    # Rows are picked by explode: a filter would be pushed below the parse and run it twice.
    events = parsed.selectExpr(f"explode(if({good}, array(_doc), null)) as _doc").selectExpr(*parse_events())
    return events, parsed.selectExpr(f"explode(if({good}, null, array(value))) as value")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Events of all segments below a path; lines that are not JSON are dropped."""
    return split_bad_lines(_lines(spark, path))[0]


def stream_segments(spark: SparkSession, path: str, max_files: int = 1000, archive: str | None = None) -> DataFrame:
    """The lines of segments as they land, oldest file first, from the stream's last position.

    Land sealed segments by an atomic move: a file is read once.  With `archive`
    finished segments move there, so listing the source stays cheap.
    """
    reader = spark.readStream.options(**READER).option("maxFilesPerTrigger", max_files)
    if archive is not None:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.text(path)


def segment_report(spark: SparkSession, path: str) -> DataFrame:
    """Per segment: complete lines, corrupt lines, and whether it lacks the final newline.

    Line lengths plus one newline each add up to the file size exactly when the
    file ends in a newline, so no file is ever read as a whole and large ones
    split across tasks.
    """
    lines = _lines(spark, path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_size").alias("size"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
        ).alias("at"),
        (F.octet_length("value") + 1).cast("long").alias("bytes"),
        (F.col("value") != "").alias("filled"),
        ((F.col("value") != "") & F.try_parse_json("value").isNull()).alias("corrupt"),
    )
    per_file = lines.groupBy("path").agg(
        (F.sum("bytes") > F.max("size")).alias("torn"),
        F.count_if("filled").alias("_filled"),
        F.count_if("corrupt").alias("_corrupt"),
        F.max_by("corrupt", "at").alias("_last_corrupt"),
    )
    torn = F.col("torn").cast("long")
    return per_file.select(
        "path",
        (F.col("_filled") - torn).alias("lines"),
        (F.col("_corrupt") - F.when(F.col("torn") & F.col("_last_corrupt"), 1).otherwise(0)).alias("corrupt"),
        F.col("torn").alias("torn_tail"),
    )


def to_lines(ev: DataFrame) -> DataFrame:
    """Events as segment lines ``value STRING``, in stored field order."""
    return ev.selectExpr(f"{document_sql(EVENT_COLUMNS)} as value")

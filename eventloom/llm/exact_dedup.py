"""Exact deduplication with a heavy-hitter split.

Every text becomes a digest in one pass.  Misra-Gries summaries, one per task
and merged, name the digests that may be frequent; their exact counts and
winners are then verified.  That table has at most `counters` rows, so it is
broadcast and its groups are settled map-side.  All other digests are rare by
the summary's guarantee and take an ordinary shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import doc_key, written

COUNTERS = 1023


def misra_gries(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest, count): at most `counters` rows; every digest of more than n / (counters + 1) rows is among them.

    Each task keeps `counters` counters; summaries are added up and the
    (counters + 1)-th largest sum is taken off, which keeps the guarantee.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for batch in batches:
            seen = batch.column(0).value_counts()
            for value, n in zip(seen.field(0).to_pylist(), seen.field(1).to_pylist(), strict=True):
                held[value] = held.get(value, 0) + n
            if len(held) > counters:
                least = sorted(held.values(), reverse=True)[counters]
                held = {k: v - least for k, v in held.items() if v > least}
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["digest", "count"])

    partial = digests.select("digest").mapInArrow(summarise, "digest string, count long")
    merged = partial.groupBy("digest").agg(F.sum("count").alias("count"))
    top = merged.orderBy(F.desc("count"), "digest").limit(counters + 1)
    ranked = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("count"), "digest")))
    least = F.max(F.when(F.col("place") == counters + 1, F.col("count")).otherwise(0)).over(Window.partitionBy())
    return ranked.withColumn("count", F.col("count") - least).filter("count > 0").select("digest", "count")


def group_exact(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty.  The largest doc_id
    of a group stays (keep_id); a row without doc_id never wins over one that
    has one, and a group with no doc_id at all keeps its rows.  Rows that
    repeat both text and doc_id are the same document: each counts in
    group_size and each carries the same kept.  An empty table gives no rows;
    columns other than doc_id and text are ignored.
    """
    digests, heavy = _split(docs, counters)
    settled = digests.join(F.broadcast(heavy), "digest").select("doc_id", "keep_id", "group_size", "digest")
    return settled.unionAll(_rest(digests, heavy)).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def _split(docs: DataFrame, counters: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest) of all rows, and (digest, keep_id, group_size) of the frequent digests, `counters` rows at most."""
    digests = written(doc_key(docs).select("doc_id", F.sha2("text", 256).alias("digest")), "digests")
    # A summary row counts only if its exact count repeats: singles need no settling by broadcast.
    candidates = misra_gries(digests, counters).select("digest")
    heavy = digests.join(F.broadcast(candidates), "digest").groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return digests, written(heavy.filter("group_size > 1"), "heavy")


def _rest(digests: DataFrame, heavy: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, digest) of the rows whose digest is not frequent."""
    of_text = Window.partitionBy("digest")
    return digests.join(F.broadcast(heavy), "digest", "left_anti").select(
        "doc_id", F.max("doc_id").over(of_text).alias("keep_id"), F.count("*").over(of_text).alias("group_size"), "digest"
    )


def drop_exact(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The rows of `docs` that :func:`group_exact` keeps, with all their columns; rows that repeat id and text come once.

    Texts stay where they are read: losers of frequent digests go by broadcast,
    those of the others by their ids, which Spark broadcasts or shuffles by
    their measured size.  Only rows that repeat both id and text are brought
    together.
    """
    digests, heavy = _split(docs, counters)
    lost = _rest(digests, heavy).filter(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    losers = written(lost.select("doc_id", "digest").distinct(), "losers")
    repeated = written(digests.groupBy("doc_id", "digest").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "digest"), "repeated")
    whole = docs.select(
        F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("sha")
    )
    winners = F.broadcast(heavy.select(F.col("digest").alias("frequent"), "keep_id"))
    stay = F.col("frequent").isNull() | F.col("id").eqNullSafe(F.col("keep_id"))
    kept = whole.join(winners, F.col("sha") == F.col("frequent"), "left").filter(stay).select("row", "id", "sha")

    def named(few: DataFrame, how: str) -> DataFrame:
        return kept.join(few, kept["id"].eqNullSafe(few["doc_id"]) & (kept["sha"] == few["digest"]), how)

    kept = named(losers, "left_anti")
    if not repeated.isEmpty():
        kept = named(repeated, "left_anti").unionAll(named(repeated, "left_semi").dropDuplicates(["id", "sha"]))
    return kept.select("row.*")

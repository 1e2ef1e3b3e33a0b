"""Views kept current while events arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventloom.functions.times import GROUPS, bucket
from eventloom.operators import percentiles
from eventloom.operators.filters import Params, filter_events
from eventloom.operators.pages import tail_buffer
from eventloom.operators.rollups import STATS_PERCENTILES, bucket_aggregates, bucket_columns, measures
from eventloom.schema import LEVELS, TAIL_MAX
from eventloom.session import shared_path
from eventloom.sources import files


def stream_stats(ev: DataFrame, group: str = "hour", delay: str = "10 minutes") -> DataFrame:
    """The time-bucket rollup over a stream, with percentiles from a bounded summary; write it in ``update`` mode.

    Exact percentiles of large buckets are those of :func:`stream_counts`.  State is one bounded aggregate per open bucket.  Buckets start on UTC hours
    and days, as in the batch rollup.
    """
    if group not in GROUPS:
        raise ValueError(f"group must be one of: {', '.join(GROUPS)}")
    rows = measures(ev.withWatermark("received_at", delay))
    buckets = rows.groupBy(F.window("received_at", f"1 {group}")).agg(*bucket_aggregates(percentiles.approximate("latency", STATS_PERCENTILES.values())))
    return bucket_columns(buckets, "window.start")


def keep_counts(state: str, batch: DataFrame, epoch: int, group: str = "hour") -> None:
    """Keeps what one micro-batch adds to the time-bucket rollup: sums per bucket and latency, a folder per micro-batch.

    No state is held between micro-batches, so events may be as late as they
    like; a micro-batch that runs again writes the same folder.
    """
    if group not in GROUPS:
        raise ValueError(f"group must be one of: {', '.join(GROUPS)}")
    rows = measures(batch).selectExpr("*", f"{bucket('received_at', group)} as bucket")
    sums = [F.count("*").alias("total"), *[F.expr(f"count_if(level = '{name}') as {name}") for name in LEVELS]]
    sums += [F.expr("count(status) as _statuses"), F.expr("count_if(status >= 400) as _status_errors")]
    sums += [F.sum(c).alias(c) for c in ("cost", "tokens_in", "tokens_out")]
    rows.groupBy("bucket", "latency").agg(*sums).write.mode("overwrite").parquet(f"{state}/epoch={epoch}")


def read_counts(spark: SparkSession, state: str) -> DataFrame | None:
    """The time-bucket rollup of all micro-batches so far, with exact percentiles; None before the first one."""
    done = _epochs(spark, state)
    if not done:
        return None
    kept = spark.read.parquet(*[f"{state}/epoch={e}" for e in done])
    sums = [c for c in kept.columns if c not in ("bucket", "latency")]
    totals = kept.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in sums])
    values = kept.filter("latency is not null").groupBy("bucket", "latency").agg(F.sum("total").alias("n"))
    totals = totals.selectExpr("*", "round(cost, 6) as cost_usd", "tokens_in as input_tokens", "tokens_out as output_tokens")
    return bucket_columns(totals.join(percentiles.counted(values, ["bucket"], "latency", "n", STATS_PERCENTILES), "bucket", "left"))


def stream_counts(
    ev: DataFrame, checkpoint: str, group: str = "hour", state: str | None = None, interval: str = "2 seconds", available_now: bool = False,
) -> StreamingQuery:
    """Keep the exact time-bucket rollup over all micro-batches, where :func:`read_counts` finds it (default: beside the checkpoint)."""
    where = state or f"{checkpoint.rstrip('/')}__counts"
    writer = ev.writeStream.foreachBatch(lambda batch, epoch: keep_counts(where, batch, epoch, group)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def keep_tail(spark: SparkSession, state: str, batch: DataFrame, epoch: int, n: int = TAIL_MAX) -> DataFrame:
    """Moves a kept tail on by the matching events of one micro-batch, and returns it.

    The tail is the `n` latest arrivals, each id once: by micro-batch, then by
    instant and id; an id seen again moves up.  It is a table of `n` rows with
    ``arrived``, the micro-batch, one folder per micro-batch below `state`.
    A micro-batch that runs again starts from the one before it and writes the
    same folder, so a retry changes nothing; folders no retry can need are removed.
    """
    order = [F.desc("arrived"), F.desc("received_at"), F.desc("_id")]
    arrivals = tail_buffer(batch, n).withColumn("arrived", F.lit(epoch).cast("long"))
    known = sorted(_epochs(spark, state))
    before = [e for e in known if e < epoch]
    if before:
        earlier = spark.read.schema(arrivals.schema).parquet(f"{state}/epoch={before[-1]}")
        seen = arrivals.select("_id")
        arrivals = arrivals.unionByName(earlier.join(seen, "_id", "left_anti"))  # at most n rows a side
    arrivals.orderBy(*order).limit(n).write.mode("overwrite").parquet(f"{state}/epoch={epoch}")
    for e in known:
        if e != epoch and (not before or e != before[-1]):
            files.delete(spark, f"{state}/epoch={e}")
    return spark.read.schema(arrivals.schema).parquet(f"{state}/epoch={epoch}").orderBy(*order)


def read_tail(spark: SparkSession, state: str) -> DataFrame | None:
    """The kept tail as the last micro-batch left it, latest arrival first; None before the first one."""
    last = max(_epochs(spark, state), default=None)
    if last is None:
        return None
    return spark.read.parquet(f"{state}/epoch={last}").orderBy(F.desc("arrived"), F.desc("received_at"), F.desc("_id"))


def _epochs(spark: SparkSession, state: str) -> list[int]:
    """Micro-batches that left a complete folder."""
    found = [f for f in files.listed(spark, state) if "/epoch=" in f and files.exists(spark, f"{f}/_SUCCESS")]
    return [int(f.rsplit("=", 1)[1]) for f in found]


def stream_tail(
    ev: DataFrame, deliver: Callable[[DataFrame, int], None] | None = None, params: Params | None = None,
    n: int = TAIL_MAX, interval: str = "2 seconds", checkpoint: str | None = None, state: str | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Keep the newest `n` distinct matching arrivals over all micro-batches, and hand them to `deliver` after each.

    The kept rows are at `state` (default: beside the checkpoint), where
    :func:`read_tail` finds them; a restarted stream goes on with them.
    """
    spark = ev.sparkSession
    where = state or (f"{checkpoint.rstrip('/')}__tail" if checkpoint else shared_path(spark, "tail"))

    def move(batch: DataFrame, epoch: int) -> None:
        kept = keep_tail(batch.sparkSession, where, batch, epoch, n)
        if deliver:
            deliver(kept, epoch)

    writer = filter_events(ev, params).writeStream.foreachBatch(move)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()

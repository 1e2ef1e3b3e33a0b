"""Hourly partial aggregates kept beside the event table, from which longer rollups are combined.

`<table>__rollup/event_date=<day>/` has a row per data file, hour, app and event:
counts, sums and a mergeable sketch of the latencies.  It follows the event table
as :mod:`eventloom.sources.beside` says.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions.times import bucket, lit_instant, resolve_window
from eventloom.operators.filters import event_prefix, scope
from eventloom.operators.rollups import STATS_PERCENTILES, bucket_columns, measures
from eventloom.schema import EVENT_SCHEMA, HOT_SCHEMA, LEVELS
from eventloom.sources import beside

#: Size of a latency sketch: its ranks are off by about 0.4% of the values it has seen.
SKETCH = 800
KEYS = ["file", "hour", "app", "event"]
SUMS = ["total", *LEVELS, "_statuses", "_status_errors", "cost", "tokens_in", "tokens_out"]
SCHEMA = (
    "file string, hour timestamp, app string, event string, total long, "
    + ", ".join(f"{name} long" for name in LEVELS)
    + ", _statuses long, _status_errors long, cost double, tokens_in double, tokens_out double, latencies long, sketch binary"
)
_READ = T.StructType([*EVENT_SCHEMA.fields, T.StructField("hot", HOT_SCHEMA)])


def root(path: str) -> str:
    return f"{path.rstrip('/')}__rollup"


def partials(spark: SparkSession, data_files: list[str]) -> DataFrame:
    """The rollup rows of some data files."""
    ev = spark.read.schema(_READ).parquet(*data_files).withColumn("file", F.expr(beside.NAME))
    rows = measures(ev, "file", "app", "event").selectExpr("*", f"{bucket('received_at', 'hour')} as hour")
    counts = ["count(*) as total", *[f"count_if(level = '{name}') as {name}" for name in LEVELS]]
    counts += ["count(status) as _statuses", "count_if(status >= 400) as _status_errors"]
    counts += [f"sum({c}) as {c}" for c in ("cost", "tokens_in", "tokens_out")]
    counts += ["count(latency) as latencies", f"kll_sketch_agg_double(latency, {SKETCH}) as sketch"]
    return rows.groupBy(*KEYS).agg(*[F.expr(e) for e in counts])


def update(spark: SparkSession, path: str, days: Iterable) -> None:
    """Adds the rows of those data files of the days that the rollup does not have."""
    beside.follow(spark, path, root(path), days, SCHEMA, KEYS, lambda new: partials(spark, new))


def rollup(spark: SparkSession, path: str, days: Iterable) -> DataFrame:
    """The rollup rows of the data files that the days have now, each once."""
    have, current = [], []
    for day in days:
        have += beside.kept_files(spark, root(path), day)
        current += [(beside.name(f),) for f in beside.data_files(spark, path, day)]
    if not have or not current:
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(SCHEMA).parquet(*have).join(spark.createDataFrame(current, "file string"), "file", "left_semi")
    return rows.dropDuplicates(KEYS)


def stats(
    spark: SparkSession, path: str, group: str = "hour", from_=None, to=None, app=None, event=None, projects=None, project=None, now=None,
) -> DataFrame:
    """The time-bucket rollup of :func:`eventloom.operators.rollups.stats`, combined from stored hours.

    Counts and sums are those of the events; percentiles are off by the sketch's
    rank error.  The window has to begin and end on whole hours.
    """
    start, end = resolve_window(from_, to, now)
    if any((t.minute, t.second, t.microsecond) != (0, 0, 0) for t in (start, end)):
        raise ValueError("a window over stored hours begins and ends on whole hours")
    first, last = start.date(), (end - timedelta(microseconds=1)).date()
    days = [first + timedelta(days=i) for i in range((last - first).days + 1)]
    rows = rollup(spark, path, days).filter((F.col("hour") >= lit_instant(start)) & (F.col("hour") < lit_instant(end)))
    rows = scope(rows, app, projects, project)
    if event:
        rows = rows.filter(event_prefix(event))
    sums = [F.sum(c).alias(c) for c in SUMS] + [F.expr("kll_merge_agg_double(sketch) filter (where latencies > 0)").alias("sketch")]
    merged = rows.withColumn("bucket", F.expr(bucket("hour", group))).groupBy("bucket").agg(*sums, F.sum("latencies").alias("latencies"))
    wanted = ", ".join(f"{float(p)}D" for p in STATS_PERCENTILES.values())
    merged = merged.selectExpr(
        "*", f"if(latencies > 0, kll_sketch_get_quantile_double(sketch, array({wanted})), null) as _latency", "round(cost, 6) as cost_usd",
        "tokens_in as input_tokens", "tokens_out as output_tokens",
    )
    return bucket_columns(merged).orderBy("bucket")

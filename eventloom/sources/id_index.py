"""Which ids a day of the event table has, kept beside the table.

`<table>__ids/event_date=<day>/` holds the ids of one day as runs: Parquet files
of `_id` alone, sorted, with small pages and Bloom filters.  A lookup of a small
batch is a list of ids pushed to those files: sorted row groups outside the
list, and those whose Bloom filter knows none of it, are never read, so its cost
follows the batch and not the day.  Runs of similar size merge, which keeps
their number logarithmic.

A day with a folder here is covered: all its ids are in the runs.  The ids of an
append are written first, aside; then its rows; then the ids become runs.  Ids
left aside by a failed append are held against the table before the next one.
Runs may hold an id twice, which changes nothing.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.sources import files

SCHEMA = "_id string"
#: Batches up to this many ids are looked up as a list; larger ones by a join with the days' ids.
LISTED = 1000
#: Ids of a list that readers take value by value (Spark's own default limit).
SHORT = 10
#: Runs of one size class that stay before they merge, and the size from which a run is final.
FAN, FINAL_BYTES = 8, 256 << 20
LAYOUT = {
    "parquet.bloom.filter.enabled#_id": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
    "parquet.block.size": str(8 << 20),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "false",
}


def root(path: str) -> str:
    return f"{path.rstrip('/')}__ids"


def _aside(path: str) -> str:
    return f"{path.rstrip('/')}__ids_pending"


def _day(path: str, day) -> str:
    return f"{root(path)}/event_date={day}"


def _write(ids: DataFrame, where: str, small: bool = False) -> None:
    """Ids (`_id`, `event_date`) as sorted files per day."""
    ids = ids.select("_id", "event_date")
    laid = (ids.coalesce(1) if small else ids.hint("rebalance", "event_date")).sortWithinPartitions("event_date", "_id")
    laid.write.mode("overwrite").options(**LAYOUT).partitionBy("event_date").parquet(where)


def runs(spark: SparkSession, path: str, days: Iterable) -> DataFrame:
    """The ids that covered days have."""
    folders = [f for d in days if files.exists(spark, f := _day(path, d))]
    return spark.read.schema(SCHEMA).parquet(*folders) if folders else spark.createDataFrame([], SCHEMA)


def listed(spark: SparkSession, path: str, days: Iterable, ids: list[str]) -> DataFrame:
    """Those of at most LISTED ids that the days have; the list is pushed to the files.

    It goes as a balanced tree of short lists: each value of a short list meets
    the statistics, page index and Bloom filters by itself, and the readers, who
    walk it recursively, never go deep.
    """
    tests = [F.col("_id").isin(ids[at : at + SHORT]) for at in range(0, len(ids), SHORT)] or [F.lit(False)]
    while len(tests) > 1:
        tests = [a | b for a, b in zip(tests[::2], tests[1::2])] + tests[len(tests) // 2 * 2 :]
    return runs(spark, path, days).filter(tests[0])


def known(spark: SparkSession, path: str, days: Iterable, batch: DataFrame, size: int) -> DataFrame:
    """Those ids of a batch of `size` rows that its days have already."""
    if size > LISTED:
        return runs(spark, path, days).join(batch.select("_id"), "_id", "left_semi").distinct()
    ids = [r["_id"] for r in batch.select("_id").collect()]
    return spark.createDataFrame([(r["_id"],) for r in listed(spark, path, days, ids).distinct().collect()], SCHEMA)


def cover(spark: SparkSession, path: str, days: Iterable) -> None:
    """Makes runs, from the table, for those of the days it has rows of that have none yet."""
    for day in days:
        table, built = f"{path.rstrip('/')}/event_date={day}", f"{root(path)}_built-{uuid.uuid4().hex}"
        if files.exists(spark, table) and not files.exists(spark, _day(path, day)):
            ids = spark.read.schema(SCHEMA).parquet(table).withColumn("event_date", F.lit(str(day)))
            _write(ids, built)
            files.make(spark, root(path))
            files.make(spark, f"{built}/event_date={day}")
            files.move(spark, f"{built}/event_date={day}", _day(path, day))
            files.delete(spark, built)


def stage(spark: SparkSession, path: str, fresh: DataFrame, small: bool = False) -> None:
    """Writes the ids of rows that are about to be appended aside; those of a `small` batch by one task."""
    _write(fresh.select("_id", F.to_date("received_at").alias("event_date")), _aside(path), small)


def publish(spark: SparkSession, path: str) -> None:
    """The rows are in the table: what is aside becomes runs."""
    _admit(spark, path, _aside(path))
    files.delete(spark, _aside(path))


def _admit(spark: SparkSession, path: str, where: str) -> None:
    for folder in files.listed(spark, where):
        if "event_date=" not in folder:
            continue
        day = folder.rsplit("event_date=", 1)[1]
        files.make(spark, _day(path, day))
        for file in files.listed(spark, folder):
            files.move(spark, file, f"{_day(path, day)}/run-{uuid.uuid4().hex}.parquet")
        _merge(spark, path, day)


def recover(spark: SparkSession, path: str) -> None:
    """After a failed append: of the ids left aside, those that did reach the table become runs."""
    aside = _aside(path)
    if files.exists(spark, f"{aside}/_SUCCESS"):
        pending = spark.read.schema(f"{SCHEMA}, event_date date").parquet(aside)
        days = [f.rsplit("event_date=", 1)[1] for f in files.listed(spark, aside) if "event_date=" in f]
        folders = [f for d in days if files.exists(spark, f := f"{path.rstrip('/')}/event_date={d}")]
        if folders:
            there = spark.read.schema(f"{SCHEMA}, event_date date").option("basePath", path).parquet(*folders)
            verified = f"{root(path)}_verified"
            _write(there.join(pending, ["_id", "event_date"], "left_semi"), verified)
            _admit(spark, path, verified)
            files.delete(spark, verified)
    files.delete(spark, aside)


def forget(spark: SparkSession, path: str, days: Iterable) -> None:
    """Days whose rows changed otherwise; they are covered anew when rows are next appended to them."""
    for day in days:
        files.delete(spark, _day(path, day))


def _merge(spark: SparkSession, path: str, day) -> None:
    """Runs of one size class become one run of a higher class once there are FAN of them."""
    while True:
        classes: dict[int, list[str]] = {}
        sizes = files.sizes(spark, _day(path, day))
        for file, size in sizes.items():
            if size < FINAL_BYTES:
                classes.setdefault(int(math.log(max(size, 1 << 14), FAN)), []).append(file)
        full = next((f for f in classes.values() if len(f) >= FAN), None)
        if full is None:
            return
        merged = f"{root(path)}_merged-{uuid.uuid4().hex}"
        ids = spark.read.schema(SCHEMA).parquet(*full)
        many = -(-sum(sizes[f] for f in full) // FINAL_BYTES)
        ids = ids.coalesce(1) if many == 1 else ids.repartitionByRange(many, "_id")
        ids.sortWithinPartitions("_id").write.options(**LAYOUT).parquet(merged)
        for file in files.listed(spark, merged):
            if file.endswith(".parquet"):
                files.move(spark, file, f"{_day(path, day)}/run-{uuid.uuid4().hex}.parquet")
        for file in [*full, merged]:
            files.delete(spark, file)

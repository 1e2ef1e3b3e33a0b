"""Tables kept beside the event table, whose rows each belong to one of its data files.

Bringing such a table up to date means computing the rows of the data files it
does not know yet, in any order and as often as it takes; rows of files that
retention or compaction replaced no longer count.  All rows of a data file are
in one file here, which appears by one move: there are all of them or none.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.sources import files

#: Files of a day before they are put into one.
FAN = 16


def name(file: str) -> str:
    """A data file's day folder and name: tasks that write several days use one name in all of them."""
    return "/".join(file.rsplit("/", 2)[-2:])


#: SQL of :func:`name` for the rows of a read, and of the day in it.
NAME = "substring_index(_metadata.file_path, '/', -2)"
_DAY = "substring_index(substring_index(file, '/', 1), '=', -1)"


def data_files(spark: SparkSession, path: str, day) -> list[str]:
    """The data files that a day of the event table has now."""
    return files.listed(spark, f"{path.rstrip('/')}/event_date={day}")


def kept_files(spark: SparkSession, root: str, day) -> list[str]:
    return files.listed(spark, f"{root}/event_date={day}")


def follow(
    spark: SparkSession, path: str, root: str, days: Iterable, schema: str, keys: list[str], rows_of: Callable[[list[str]], DataFrame], order: list[str] | None = None,
) -> None:
    """Adds the rows of those data files of the days that the table at `root` does not have.

    `rows_of` computes the rows of some data files, with their :func:`name` as `file`;
    `keys` tell the rows of a file apart.  All days are done together, so the
    number of jobs does not follow the number of days.
    """
    days = list(dict.fromkeys(days))
    have = {day: kept_files(spark, root, day) for day in days}
    every = [f for kept in have.values() for f in kept]
    # one name per data file of the days
    known = {r["file"] for r in spark.read.schema(schema).parquet(*every).select("file").distinct().collect()} if every else set()
    new = [f for day in days for f in data_files(spark, path, day) if name(f) not in known]
    if new:
        _put(spark, rows_of(new), root, order)
    full = [f for kept in have.values() if len(kept) >= FAN for f in kept]
    if full:
        _put(spark, spark.read.schema(schema).parquet(*full).dropDuplicates(keys), root, order)
        for file in full:
            files.delete(spark, file)


def _put(spark: SparkSession, rows: DataFrame, root: str, order: list[str] | None) -> None:
    aside = f"{root}_aside-{uuid.uuid4().hex}"
    rows = rows.withColumn("event_date", F.expr(_DAY)).repartition("file").sortWithinPartitions("event_date", *(order or []))
    rows.write.partitionBy("event_date").parquet(aside)
    for folder in files.listed(spark, aside):
        kept = f"{root}/{folder.rsplit('/', 1)[-1]}"
        files.make(spark, kept)
        for file in files.listed(spark, folder):
            files.move(spark, file, f"{kept}/{uuid.uuid4().hex}.parquet")
    files.delete(spark, aside)

"""The event table: layout, idempotent append, retention.

Parquet partitioned by ``event_date``.  Writes rebalance by day, so a hot day is
split over many tasks and files while small days share one, and sort files by
``app, event, received_at`` so that row-group statistics prune those filters;
Bloom filters do so for the correlation ids in `hot_ids`.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions.times import instant, lit_instant
from eventloom.functions.values import hot_columns
from eventloom.schema import EVENT_SCHEMA, HOT_IDS_SCHEMA, HOT_SCHEMA, INDEXED_IDS, STORE_COLUMNS
from eventloom.sources import files, id_index

STORE_SCHEMA = T.StructType(
    [*EVENT_SCHEMA.fields, T.StructField("hot", HOT_SCHEMA), T.StructField("hot_ids", HOT_IDS_SCHEMA), T.StructField("event_date", T.DateType())]
)
# Correlation ids are looked up one at a time: Bloom filters tell which row groups have one.
BLOOMS = {f"parquet.bloom.filter.enabled#hot_ids.{k}": "true" for k in INDEXED_IDS} | {"parquet.bloom.filter.adaptive.enabled": "true"}


def to_store(ev: DataFrame) -> DataFrame:
    """Events with the typed side columns and the partition column."""
    if "hot" not in ev.columns:
        ev = ev.selectExpr("*", f"{hot_columns()} as hot")
    indexed = F.struct(*[F.col("ids")[k].alias(k) for k in INDEXED_IDS])
    return ev.withColumn("hot_ids", indexed).withColumn("event_date", F.to_date("received_at")).select(*STORE_COLUMNS)


def _write_laid_out(df: DataFrame, path: str, mode: str, **options) -> None:
    (
        df.hint("rebalance", "event_date")
        .sortWithinPartitions("event_date", "app", "event", "received_at")
        .write.mode(mode)
        .options(**BLOOMS, **options)
        .partitionBy("event_date")
        .parquet(path)
    )


def write_events(ev: DataFrame, path: str, mode: str = "append") -> None:
    """Write events to the table as they are, without a duplicate check; its ids are kept up where they are kept."""
    spark = ev.sparkSession
    if mode != "append":
        files.delete(spark, id_index.root(path))
    if not files.exists(spark, id_index.root(path)):
        return _write_laid_out(to_store(ev), path, mode)
    id_index.recover(spark, path)
    id_index.cover(spark, path, _days(ev))
    _write_with_ids(spark, ev, path)


def _write_with_ids(spark: SparkSession, ev: DataFrame, path: str, small: bool = False) -> None:
    id_index.stage(spark, path, ev, small)
    _write_laid_out(to_store(ev), path, "append")
    id_index.publish(spark, path)


def read_events(spark: SparkSession, path: str, days: list | None = None) -> DataFrame:
    """The event table, or only the folders of some days: other days are not even listed."""
    reader = spark.read.schema(STORE_SCHEMA)
    if days is None:
        return reader.parquet(path)
    folders = [f for d in days if files.exists(spark, f := f"{path.rstrip('/')}/event_date={d}")]
    return reader.option("basePath", path).parquet(*folders) if folders else spark.createDataFrame([], STORE_SCHEMA)


def one_per_id(batch: DataFrame) -> DataFrame:
    """One row per `_id`: the earliest, ties by content, so that every retry keeps the same one."""
    texts = [F.col(c) for c in ("app", "env", "event", "level", "ts", "message")]
    same = Window.partitionBy("_id")
    # documents become text only where an id does repeat
    rest = [F.when(F.col("_copies") > 1, F.to_json(c)) for c in ("ids", "data")]
    counted = batch.withColumn("_copies", F.count("*").over(same))
    ranked = counted.withColumn("_nth", F.row_number().over(same.orderBy("received_at", *texts, *rest)))
    return ranked.filter("_nth = 1").drop("_nth", "_copies")


def _without_repeats(batch: DataFrame) -> DataFrame:
    """:func:`one_per_id` by which only rows of ids that do repeat are moved; the others are told by their ids alone."""
    repeated = batch.groupBy("_id").agg(F.count("*").alias("_n")).filter("_n > 1").select("_id")
    if repeated.isEmpty():
        return batch
    few = one_per_id(batch.join(repeated, "_id", "left_semi").select(*batch.columns))
    return batch.join(repeated, "_id", "left_anti").select(*batch.columns).unionByName(few)


def new_rows(store: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of a batch, one per id, whose `_id` is not in the store on any day of the batch.

    Two columns of those days are read.  Spark picks the join from the sizes it
    has measured: a small batch is broadcast, a large one shuffled.
    """
    kept = store
    if "event_date" in store.columns:
        kept = kept.filter(F.col("event_date").isin(_days(batch)))
    duplicates = kept.select("_id").join(batch.select("_id"), "_id", "left_semi")
    return batch.join(duplicates, "_id", "left_anti").select(*batch.columns)


def _days(batch: DataFrame) -> list:
    """The days of a batch, a row each."""
    return sorted(r[0] for r in batch.select(F.to_date("received_at")).distinct().collect())


def append_new(spark: SparkSession, path: str, batch: DataFrame) -> list:
    """Append the rows of a batch that the table does not have yet.

    Running it again with the same batch, or after a failed attempt, adds
    nothing twice.  An id belongs to one day: the same id on the same day is the
    same event whatever its instant.  What the days of the batch have is looked
    up in :mod:`eventloom.sources.id_index`, so the cost of a small batch does not
    depend on how much they hold.  Returns the days of the batch.
    """
    id_index.recover(spark, path)
    # The batch is read for its days, its ids and its rows; kept in memory or on
    # disk meanwhile, and recomputed where an executor is lost.
    whole = batch.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        batch = _without_repeats(whole)
        # one row per day of the batch
        days = {r["day"]: r["n"] for r in batch.groupBy(F.to_date("received_at").alias("day")).agg(F.count("*").alias("n")).collect()}
        fresh, size = batch, sum(days.values())
        if files.exists(spark, path):
            id_index.cover(spark, path, days)
            held = id_index.known(spark, path, days, batch, size)
            fresh = batch.join(held, "_id", "left_anti").select(*batch.columns)
        _write_with_ids(spark, fresh, path, size <= id_index.LISTED)
        return sorted(days)
    finally:
        whole.unpersist()


def apply_retention(ev: DataFrame, now) -> DataFrame:
    """Events that have not expired."""
    return ev.filter(F.col("expires_at") > lit_instant(instant(now)))


def expire_events(spark: SparkSession, path: str, now, shortest_days: int | None = None) -> list:
    """Drop expired events from the table; returns the days that changed.

    Only days that hold expired rows are touched, and in them only the files
    there when they were read: survivors become new files, then exactly the
    recorded old ones go.  Rows appended meanwhile are in other files and stay.
    An interrupted run is finished first: its survivors and its list of files
    are complete in a staging folder before anything moves.  Between the two
    steps a reader may see a survivor twice, never not at all.
    `shortest_days`, the shortest lifetime in use, leaves younger days unread.
    """
    path = path.rstrip("/")
    staging = f"{path}__retained"
    finish_retention(spark, path)
    table = read_events(spark, path)
    at = lit_instant(instant(now))
    old = table if shortest_days is None else table.filter(F.col("event_date") <= F.date_sub(F.to_date(at), shortest_days))
    per_day = (
        old.groupBy("event_date")
        .agg(F.count_if(F.col("expires_at") <= at).alias("gone"))
        .filter("gone > 0")
        .collect()  # one row per day of the table
    )
    days = sorted(r["event_date"] for r in per_day)
    if days:
        read = read_events(spark, path, days)
        old_files = [(f,) for f in read.inputFiles()]  # one name per file of the days concerned
        _write_laid_out(read.filter(F.col("expires_at") > at), f"{staging}/rows", "overwrite")
        spark.createDataFrame(old_files, "file string").coalesce(1).write.mode("overwrite").text(f"{staging}/replaced")
        id_index.forget(spark, path, days)
        finish_retention(spark, path)
    return days


def finish_retention(spark: SparkSession, path: str) -> None:
    """Puts complete survivors in place and removes the files they replace; harmless to repeat."""
    staging = f"{path.rstrip('/')}__retained"
    if files.exists(spark, f"{staging}/replaced/_SUCCESS"):
        fs, where = files.system(spark, f"{staging}/rows")
        jvm = spark._jvm
        for folder in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{where}/event_date=*")) or []:
            day = jvm.org.apache.hadoop.fs.Path(path, folder.getPath().getName())
            fs.mkdirs(day)
            for file in fs.listStatus(folder.getPath()):
                fs.rename(file.getPath(), jvm.org.apache.hadoop.fs.Path(day, file.getPath().getName()))
        for r in spark.read.text(f"{staging}/replaced").collect():
            files.delete(spark, r["value"])
    files.delete(spark, staging)


def compact_day(spark: SparkSession, path: str, day) -> None:
    """Rewrites the files of one closed day as few sorted ones, by the same steps as retention."""
    path = path.rstrip("/")
    finish_retention(spark, path)
    read = read_events(spark, path, [day])
    _write_laid_out(read, f"{path}__retained/rows", "overwrite")
    spark.createDataFrame([(f,) for f in read.inputFiles()], "file string").coalesce(1).write.mode("overwrite").text(f"{path}__retained/replaced")
    finish_retention(spark, path)

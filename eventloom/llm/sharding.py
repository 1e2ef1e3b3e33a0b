"""Sharding by a two-pass external shuffle, with DataFrame functions only.

Pass one scatters whole records with seeded hashes: an id picks its shard, a
second hash picks one of the shard's buckets, whose number keeps a bucket's
bytes within memory.  Pass two takes one bucket at a time, shuffles it with
Fisher-Yates and numbers its records.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import written

SEED = 20240611
BUCKET_BYTES = 16 << 20
#: Tasks of pass two with one bucket each; beyond them a task takes up to BUCKETS_PER_TASK, one after the other.
SINGLE_TASKS, BUCKETS_PER_TASK = 4096, 16


def _score(key: Column, shard: int, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(shard), key)


def pick_shard(key: Column, shards: int, seed: int = SEED) -> Column:
    """(score, shard): the shard whose hash with the key is largest (the highest number wins a tie).

    The key and the number of shards decide; with one more shard, a record
    either stays or moves into the new one.
    """
    return F.greatest(*[F.struct(_score(key, s, seed).alias("score"), F.lit(s).alias("shard")) for s in range(shards)])


def bucket_counts(records: DataFrame, key: str, size: str, shards: int, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> list[int]:
    """How many buckets each shard needs for its own bytes."""
    best = pick_shard(F.col(key), shards, seed)
    sums = records.select(best["shard"].alias("shard"), F.col(size).alias("bytes")).groupBy("shard").agg(F.sum("bytes").alias("n")).collect()  # a row per shard
    held = {r["shard"]: int(r["n"] or 0) for r in sums}
    return [max(1, -(-held.get(s, 0) // bucket_bytes)) for s in range(shards)]


def scatter(
    records: DataFrame, key: str, size: str, shards: int, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, counts: list[int] | None = None
) -> DataFrame:
    """(key, record, shard, grown_shard, bucket) for every record; `counts` are the shards' :func:`bucket_counts`, where known.

    Buckets spread by a hash of the whole record, so rows that share a key
    spread too; equal rows of more than a quarter of a bucket spread in runs of
    that size.  A record larger than a bucket has one to itself and whatever
    else falls there.
    """
    buckets = F.array(*[F.lit(n) for n in counts or bucket_counts(records, key, size, shards, seed, bucket_bytes)])
    new = _score(F.col("key"), shards, seed)
    whole = _spread(records.select(F.col(key).alias("key"), F.struct(*records.columns).alias("record"), F.col(size).alias("bytes")), seed, bucket_bytes)
    dealt = whole.select("key", "record", "run", pick_shard(F.col("key"), shards, seed).alias("best"))
    return dealt.select(
        "key",
        "record",
        F.col("best.shard").alias("shard"),
        F.when(new >= F.col("best.score"), F.lit(shards)).otherwise(F.col("best.shard")).alias("grown_shard"),
        F.pmod(F.xxhash64(F.lit(seed + 1), "record", "run"), F.get(buckets, F.col("best.shard"))).cast("int").alias("bucket"),
    )


def _spread(whole: DataFrame, seed: int, bucket_bytes: int) -> DataFrame:
    """(key, record, run): rows equal to too many others are counted and written out again in numbered runs, all others have run 0."""
    digest = F.xxhash64(F.lit(seed), "record").alias("digest")
    counts = whole.groupBy(digest).agg(F.count("*").alias("n"), F.max("bytes").alias("bytes"))
    repeats = written(counts.filter("n > 1").filter(F.col("n") * F.col("bytes") * 4 > bucket_bytes).select("digest"), "repeats")
    if repeats.isEmpty():
        return whole.select("key", "record", F.lit(0).cast("long").alias("run"))
    named, few = whole.select("*", digest), repeats  # four per bucket at most; Spark knows the written table's size
    per = F.greatest(F.lit(1), F.floor(F.lit(bucket_bytes) / 4 / F.greatest(F.lit(1), F.col("bytes")))).cast("long")
    equal = named.join(few, "digest", "left_semi").groupBy("key", "record", "bytes").agg(F.count("*").alias("n")).select("*", per.alias("per"))
    runs = equal.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.col("per")))).alias("run")).repartition("record", "run")
    size = F.least(F.col("per"), F.col("n") - F.col("run") * F.col("per")).cast("int")
    again = runs.select("key", "record", "run", F.explode(F.array_repeat(F.lit(0), size))).select("key", "record", "run")
    return named.join(few, "digest", "left_anti").select("key", "record", F.lit(0).cast("long").alias("run")).union(again)


def shuffle_shards(records: DataFrame, key: str, size: str, shards: int, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(record, shard, slot, grown_shard) for every record; slot is its place in the shard, gapless from 0.

    `record` is the whole row, so its column names are free; `size` names the
    column of its bytes.  The order follows from the records, the seed and the
    bucket size alone, whatever the session's number of partitions: a bucket is
    sorted before it is shuffled, and its number decides its task, whose number
    and seed are the state of Spark's generator.  Null keys hash like any key,
    equal rows are all kept, an empty table gives no rows.
    """
    counts = bucket_counts(records, key, size, shards, seed, bucket_bytes)
    dealt = scatter(records, key, size, shards, seed, bucket_bytes, counts)
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    offsets = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    # a bucket's offset travels as one more row, so records move once and nothing is joined to them
    rows = dealt.select("shard", "bucket", F.struct("key", "record", "grown_shard").alias("row")).unionByName(offsets, allowMissingColumns=True)
    total = sum(counts)
    tasks = min(total, max(SINGLE_TASKS, -(-total // BUCKETS_PER_TASK)))
    number = F.get(F.array(*[F.lit(n - c) for n, c in zip(accumulate(counts), counts, strict=True)]), F.col("shard")) + F.col("bucket")
    placed = rows.withColumn("task", (number % tasks).cast("int")).repartitionById(tasks, "task")
    held = placed.groupBy("task", "shard", "bucket").agg(F.sort_array(F.collect_list("row")).alias("rows"), F.max("offset").alias("offset"))
    # Fisher-Yates within a bucket, one bucket after the other
    mixed = held.sortWithinPartitions("shard", "bucket").select("shard", "offset", F.shuffle("rows", seed).alias("rows"))
    out = mixed.select("shard", "offset", F.posexplode("rows").alias("pos", "row"))
    return out.select("row.record", "shard", (F.col("offset") + F.col("pos")).cast("long").alias("slot"), "row.grown_shard")


def write_shards(records: DataFrame, path: str, key: str, size: str, shards: int, seed: int = SEED) -> None:
    """Writes :func:`shuffle_shards` as Parquet, a folder per shard, records in slot order within each file."""
    out = shuffle_shards(records, key, size, shards, seed)
    out.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

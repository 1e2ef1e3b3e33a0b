"""Hard negatives of anchors by slot-decomposed selection.

A positive with score p admits negatives of other labels with a score from
low% to high% of p.  An anchor's positives have overlapping windows; their upper
limits split the scores into disjoint slots, slot k holding what lies below the
k-th limit but not below the next.  Every task keeps only the first negatives
of each anchor and slot; after the merge over tasks, the slots from k on, in
order, are the answer under the k-th limit, so one short list per anchor serves
all its windows.

Scores are whole numbers.  Anchors and rows meet in tiles of bounded size: rows
are dealt into parts, anchors into blocks, and a task multiplies one of each.
Only what can still be among the first leaves a tile.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import partitions_for, written

#: Codes beyond this size could give scores that exceed a long.
LARGEST = 2**22
#: Entries of a part of the rows; a block of anchors has a fourth of that.
ENTRIES = 1 << 20
SCORES = 1 << 20


def codes(vector: Column, scale: int) -> Column:
    """floor(scale * c) of every entry; null where the vector or an entry is null, not finite or too large."""
    fine = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) * scale < LARGEST, F.lit(False)))
    return F.when(fine, F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("int")))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of whole numbers as rows of doubles, filled up with zeros."""
    lists = column.combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(size), width))
    out[np.arange(width) < size[:, None]] = lists.flatten().to_numpy()
    return out


def _scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products, exact: in doubles where these hold them, else in longs."""
    most = np.abs(left).max(initial=0) * np.abs(right).max(initial=0) * left.shape[1]
    if most < 2**53:
        return (left @ right.T).astype(np.int64)
    return left.astype(np.int64) @ right.astype(np.int64).T


def _first(k: int, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of the first `k` entries of each group, higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, group))
    sorted_group = group[order]
    start = np.ones(len(order), dtype=bool)
    start[1:] = sorted_group[1:] != sorted_group[:-1]
    at = np.flatnonzero(start)
    nth = np.arange(len(order)) - np.repeat(at, np.diff([*at, len(order)]))
    return order[nth < k]


Pick = Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _in_tiles(anchors: DataFrame, rows: DataFrame, sizes: tuple[int, int, int], pick: Pick, schema: str) -> DataFrame:
    """What `pick` takes of the scores of every tile: (anchor_id, slot, vec_id, score) rows."""
    n_anchors, n_rows, width = sizes
    blocks, parts = partitions_for(n_anchors, max(1, ENTRIES // 4 // width)), partitions_for(n_rows, max(1, ENTRIES // width))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # rows are dealt by their place in the scan: ids may repeat without end
    place = F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int")
    left = anchors.withColumn("block", F.pmod(F.xxhash64("anchor_id"), F.lit(blocks)).cast("int")).withColumn("part", every(parts))
    right = rows.withColumn("part", place).withColumn("block", every(blocks))

    def run(anchor: pa.Table, row: pa.Table) -> pa.Table:
        found = []
        if anchor.num_rows and row.num_rows:
            label, ids = (row.column(c).to_numpy() for c in ("label", "vec_id"))
            x = _matrix(row.column("x"), width)
            step = max(1, SCORES // row.num_rows)
            for at in range(0, anchor.num_rows, step):
                some = anchor.slice(at, step)
                score = _scores(_matrix(some.column("x"), width), x)
                i, slot, j = pick(some, score, label, ids)
                taken = [some.column("anchor_id").to_numpy()[i], slot.astype(np.int32), ids[j], score[i, j]]
                found.append(pa.Table.from_arrays([pa.array(t) for t in taken], ["anchor_id", "slot", "vec_id", "score"]))
        empty = pa.schema([("anchor_id", pa.int64()), ("slot", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())]).empty_table()
        return pa.concat_tables([empty, *found])

    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(run, schema)


def mine(
    rows: DataFrame, anchors: DataFrame, scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """One row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Both tables have vec_id, embedding and label (whole numbers).  A score is
    the inner product of floor(scale * c) of both vectors' entries; higher ones
    come first, ties by smaller vec_id.  An anchor's positives are its first
    rows of the same label and another vec_id.  A positive's negatives are the
    first rows of other labels with low * positive_score <= 100 * score <= high *
    positive_score; a positive without any gives no row, and so does a negative
    positive_score, whose window is empty.

    Rows with a null vec_id, label or vector, or an entry that is null, not
    finite or codes beyond 2**22, take no part.  Shorter vectors count as ending
    in zeros, an empty one as all zeros.  Repeated rows, and different rows with
    one vec_id, each count as a row; of anchors with one vec_id, the one with
    the smallest label and vector counts.  Empty tables give no rows; other
    columns are ignored.
    """
    def coded(df: DataFrame) -> DataFrame:
        x = codes(F.col("embedding"), scale)
        df = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))
        return df.filter("vec_id is not null and label is not null and x is not null")

    spark = rows.sparkSession
    rows = coded(rows)
    asked = coded(anchors).groupBy(F.col("vec_id").alias("anchor_id")).agg(F.min(F.struct("label", "x")).alias("a"))
    asked = written(asked.select("anchor_id", "a.label", "a.x"), "anchors")
    n_rows, width = rows.agg(F.count("*"), F.max(F.size("x"))).head()
    n_anchors, wide = asked.agg(F.count("*"), F.max(F.size("x"))).head()
    if not n_rows or not n_anchors:
        return spark.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        )
    sizes = n_anchors, n_rows, max(width, wide, 1)
    best = lambda *keys: Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    schema = "anchor_id long, slot int, vec_id long, score long"

    def same_label(some: pa.Table, score: np.ndarray, label: np.ndarray, ids: np.ndarray):
        own, name = (some.column(c).to_numpy()[:, None] for c in ("label", "anchor_id"))
        i, j = np.nonzero((label == own) & (ids != name))
        keep = _first(positives, i, score[i, j], ids[j])
        return i[keep], np.zeros(len(keep), dtype=np.int32), j[keep]

    near = _in_tiles(asked, rows, sizes, same_label, schema).withColumn("nth", F.row_number().over(best("anchor_id")))
    near = near.filter(F.col("nth") <= positives).groupBy("anchor_id")
    near = written(near.agg(F.array_sort(F.collect_list(F.struct("nth", F.col("vec_id").alias("positive_id"), "score"))).alias("near")), "positives")
    limited = asked.join(near.select("anchor_id", F.col("near.score").alias("scores")), "anchor_id")

    def in_slots(some: pa.Table, score: np.ndarray, label: np.ndarray, ids: np.ndarray):
        own = some.column("label").to_numpy()[:, None]
        given = some.column("scores").to_pylist()
        none = np.iinfo(np.int64).min
        upper = np.array([[high * p // 100 for p in ps] + [none] * (positives - len(ps)) for ps in given], dtype=np.int64)
        lower = np.array([min(-(-low * p // 100) for p in ps) for ps in given], dtype=np.int64)
        i, j = np.nonzero((label != own) & (score <= upper[:, :1]) & (score >= lower[:, None]))
        value = score[i, j]
        slot = (upper[i] >= value[:, None]).sum(axis=1)
        keep = _first(negatives, i * (positives + 1) + slot, value, ids[j])
        return i[keep], slot[keep], j[keep]

    slots = _in_tiles(limited, rows, sizes, in_slots, schema).withColumn("nth", F.row_number().over(best("anchor_id", "slot")))
    slots = slots.filter(F.col("nth") <= negatives).groupBy("anchor_id")
    slots = slots.agg(F.array_sort(F.collect_list(F.struct("slot", "nth", F.col("vec_id").alias("negative_id"), "score"))).alias("slots"))
    windows = near.join(slots, "anchor_id").select("anchor_id", "slots", F.explode("near").alias("p"))
    under = F.slice(F.filter("slots", lambda s: s["slot"] >= F.col("p.nth")), 1, negatives)
    inside = F.filter(under, lambda s: s["score"] * 100 >= F.col("p.score") * low)
    return windows.select("anchor_id", "p", F.posexplode(inside).alias("place", "s")).select(
        "anchor_id", F.col("p.positive_id").alias("positive_id"), (F.col("place") + 1).alias("rank"), F.col("s.negative_id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("s.score").alias("negative_score"),
    )

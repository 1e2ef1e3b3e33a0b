"""Near-duplicate groups by b-bit MinHash.

A text is its set of k-word shingles.  Per distinct set, 128 minima give band
keys (full minima) and a packed signature (their low bits).  Documents that
share a band are candidates; the signature's collision-corrected estimate
throws out clear misses, full sets confirm the rest, and confirmed links give
connected components.

A band with many documents does not emit its pairs.  Every member is compared
with the band's pivot, the member that meets most others overall; near copies
of one text share one pivot in most bands.  Bands whose members are then one
component are done.  What is left is compared family by family (the members of
open bands with one pivot): those outside the family's largest component meet
the whole family on full sets, in blocks of bounded size, and only links leave
a task.  So no link between candidates is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import components, doc_key, written
from eventloom.llm.words import mix, shingles, small_batches, split_words

MINIMA, BANDS, BITS = 128, 32, 4
SET_SCHEMA = "doc_id long, n_shingles long, fp binary, signature binary, bands array<long>"
#: Estimates this far below the threshold are beyond six standard errors of 128 minima.
MARGIN = 0.23
BLOCK_SHINGLES = 100_000


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * MINIMA + 1, dtype=np.uint64))
    return (seeds[:MINIMA] | np.uint64(1)).astype(np.uint32) | np.uint32(1), seeds[MINIMA:].astype(np.uint32)


def distinct_shingles(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of every text end to end, where each text begins)."""
    hashes, owner, _, _ = split_words(column)
    value, of = shingles(hashes, owner, k)
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    fresh = np.ones(len(value), dtype=bool)
    fresh[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    value, of = value[fresh], of[fresh]
    return value, np.searchsorted(of, np.arange(len(column) + 1))


def signatures(value: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The minima of each nonempty text, one row per text; empty texts are left at the largest value."""
    a, b = _permutations()
    filled = np.flatnonzero(starts[1:] > starts[:-1])
    out = np.full((len(starts) - 1, MINIMA), 0xFFFFFFFF, dtype=np.uint32)
    if not len(filled):
        return out
    x = (mix(value) >> np.uint64(32)).astype(np.uint32)
    x ^= x >> np.uint32(15)
    at = starts[:-1][filled]
    for i in range(MINIMA):
        y = x * a[i] + b[i]
        y ^= y >> np.uint32(16)
        out[filled, i] = np.minimum.reduceat(y * np.uint32(0x85EBCA6B), at)
    return out


def describe(docs: DataFrame, k: int) -> DataFrame:
    """Per document: set size, set fingerprint, packed b-bit signature, band keys (none for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = MINIMA // BANDS
        salt = mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(77))
        for batch in small_batches(batches):
            value, starts = distinct_shingles(batch.column(1), k)
            minima = signatures(value, starts)
            low = (minima & np.uint32((1 << BITS) - 1)).astype(np.uint8)
            packed = np.packbits(np.unpackbits(low[:, :, None], axis=2)[:, :, 8 - BITS :].reshape(len(low), -1), axis=1)
            keys = np.broadcast_to(salt, (len(low), BANDS)).copy()
            for j in range(rows):
                keys = mix(keys * np.uint64(31) + minima[:, j::rows].astype(np.uint64))
            # order-free sums of two mixings, with the size, name a set
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(value ^ np.uint64(s)))]) for s in (0x5BD1E995, 0x27D4EB2F165667C5)]
            size = starts[1:] - starts[:-1]
            fp = np.stack([size.astype(np.uint64), *(s[starts[1:]] - s[starts[:-1]] for s in sums)], axis=1)
            full = size > 0
            bands = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32)), pa.array(keys[full].reshape(-1).view(np.int64))
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size.astype(np.int64)), _binary(fp.view(np.uint8)), _binary(packed), bands],
                ["doc_id", "n_shingles", "fp", "signature", "bands"],
            )

    return doc_key(docs).mapInArrow(run, SET_SCHEMA)


def _binary(rows: np.ndarray) -> pa.Array:
    """One binary value per row of a byte matrix."""
    rows = np.ascontiguousarray(rows)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def estimate() -> Callable[[pa.Array, pa.Array], np.ndarray]:
    """Collision-corrected similarity of two packed signatures, for use inside a task."""
    spread = np.array([bin(x).count("1") for x in range(1 << BITS)])
    differs = np.array([(spread[x >> 4] > 0) + (spread[x & 15] > 0) for x in range(256)], dtype=np.uint8)

    def of(left: pa.Array, right: pa.Array) -> np.ndarray:
        width = MINIMA * BITS // 8
        x, y = (np.frombuffer(b"".join(c.to_pylist()), dtype=np.uint8).reshape(-1, width) for c in (left, right))
        same = 1 - differs[x ^ y].sum(axis=1) / MINIMA
        return (same - 2.0**-BITS) / (1 - 2.0**-BITS)

    return of


def _plausible(pairs: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b, sig_a, sig_b) whose estimate does not rule out the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        similar = estimate()
        for batch in batches:
            if batch.num_rows:
                keep = similar(batch.column("sig_a"), batch.column("sig_b")) >= threshold / 100 - MARGIN
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold (100 * shared >= threshold * all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                left, right = (distinct_shingles(batch.column(c), k) for c in ("text_a", "text_b"))
                keep = np.zeros(batch.num_rows, dtype=bool)
                for i in range(batch.num_rows):
                    x, y = (v[s[i] : s[i + 1]] for v, s in (left, right))
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = shared > 0 and 100 * shared >= threshold * (len(x) + len(y) - shared)
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(run, "a long, b long")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each left set, how many elements it shares with every right set."""
    owner = np.repeat(np.arange(len(right)), [len(x) for x in right])
    value = np.concatenate(right) if right else np.zeros(0, np.int64)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    for x in left:
        low, high = np.searchsorted(value, x, "left"), np.searchsorted(value, x, "right")
        size = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        yield np.bincount(owner[at], minlength=len(right))


def _within_families(left: DataFrame, texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """Links between different components of a family (family, rep, comp), on full sets.

    Everything outside a family's largest component meets the whole family.
    Both sides are cut into blocks of about BLOCK_SHINGLES shingles and a task
    compares two blocks, so its memory is bounded and only links leave it.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            value, starts = distinct_shingles(batch.column(1), k)
            lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(value.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(starts)), lists], ["rep", "n", "shingles"])

    mine = texts.join(left.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    full = written(mine.mapInArrow(sets, "rep long, n long, shingles array<long>"), "shingles")
    sized = left.join(full.select("rep", "n"), "rep")
    parts = sized.groupBy("family", "comp").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))
    shape = parts.groupBy("family").agg(F.max(F.struct("docs", "comp", "n")).alias("main"), F.sum("n").alias("n"))
    blocks = lambda n: F.ceil(n / F.lit(BLOCK_SHINGLES)).cast("int")
    shape = shape.select(
        "family", F.col("main.comp").alias("main"), F.greatest(blocks(F.col("n") - F.col("main.n")), F.lit(1)).alias("outer"), blocks(F.col("n")).alias("whole")
    )
    rows = left.join(shape, "family")
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outside = rows.filter("comp <> main").select("family", "rep", "comp", block("outer").alias("i"), every("whole").alias("j"), F.lit(0).alias("side"))
    inside = rows.select("family", "rep", "comp", every("outer").alias("i"), block("whole").alias("j"), F.lit(1).alias("side"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["side", "rep"], kind="stable")
        one, two = frame[frame["side"] == 0], frame[frame["side"] == 1]
        reps, comps, size = two["rep"].to_numpy(), two["comp"].to_numpy(), two["shingles"].map(len).to_numpy()
        found: list[tuple[int, int]] = []
        counts = shared_counts(list(one["shingles"]), list(two["shingles"]))
        for rep, comp, n, shared in zip(one["rep"], one["comp"], one["shingles"].map(len), counts, strict=True):
            hit = (shared > 0) & (100 * shared >= threshold * (n + size - shared)) & (comps != comp)
            found += [(min(rep, r), max(rep, r)) for r in reps[hit].tolist()]
        return pd.DataFrame(found, columns=["a", "b"])

    return outside.unionAll(inside).join(full.select("rep", "shingles"), "rep").groupBy("family", "i", "j").applyInPandas(compare, "a long, b long")


def near_groups(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept.

    Two documents are linked when 100 * |shared shingles| >= threshold * |all
    shingles|; component_id is the smallest doc_id reachable over links.  A text
    of fewer than k words is one shingle of all of them; a null or empty text,
    or one of white space, has no shingle and no link.  Rows that share a doc_id
    count as one document.  A row without doc_id takes no part: component_id is
    null and it is kept.  An empty table gives no rows; other columns are ignored.
    """
    sets = written(describe(docs, k), "sets")
    known = sets.filter("doc_id is not null and n_shingles > 0")
    classes = written(known.groupBy("fp").agg(F.min(F.struct("doc_id", "signature", "n_shingles", "bands")).alias("r")).select("fp", "r.*"), "classes")
    reps = classes.select(F.col("doc_id").alias("rep"), "signature", F.col("n_shingles").alias("n"))

    keyed = classes.select(F.explode("bands").alias("key"), F.col("doc_id").alias("rep"))
    counts = keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    members = written(keyed.join(counts, "key"), "members")
    popular = members.groupBy("rep").agg(F.sum("size").alias("pop"))
    active = members.select("key", "rep").join(popular, "rep")

    texts = doc_key(docs).join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    # two sets may share a doc_id: they are one document
    best = F.max(F.struct("pop", (-F.col("rep")).alias("neg"))).alias("p")
    pivots = active.groupBy("key").agg(best).select("key", (-F.col("p.neg")).alias("pivot"))
    met = written(active.join(pivots, "key").select("key", "rep", "pivot"), "met")
    pairs = met.filter("rep <> pivot").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
    side = lambda c: reps.select(F.col("rep").alias(c), F.col("signature").alias(f"sig_{c}"), F.col("n").alias(f"n_{c}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").filter(f"100 * least(n_a, n_b) >= {threshold} * greatest(n_a, n_b)")
    likely = written(_plausible(sized.select("a", "b", "sig_a", "sig_b"), threshold), "likely")
    ends = likely.select(F.col("a").alias("doc_id")).union(likely.select(F.col("b").alias("doc_id"))).distinct()
    links = written(_confirmed(likely, texts.join(ends, "doc_id", "left_semi"), k, threshold).distinct(), "links")
    labels = components(links)

    named = met.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    split = named.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("key")
    left = written(named.join(split, "key", "left_semi").select(F.col("pivot").alias("family"), "rep", "comp").distinct(), "left")
    more = written(_within_families(left, texts, k, threshold).distinct(), "links")
    if not more.isEmpty():
        labels = components(links.unionAll(more))

    named = classes.select("fp", F.col("doc_id").alias("node")).join(labels, "node", "left")
    named = named.select("fp", F.coalesce("component", "node").alias("component_id"))
    out = sets.select("doc_id", "n_shingles", "fp").join(named, "fp", "left")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    out = out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of `docs` that :func:`near_groups` keeps, with all their columns."""
    kept = near_groups(docs, k, threshold).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["kept_id"]), "left_semi")

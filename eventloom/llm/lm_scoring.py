"""Stupid-backoff language-model scores of every document against the rest of the corpus.

Counts are exact and cover all texts.  For each order the n-grams of a part (a
few megabytes of texts, written once) are exploded, packed by hash bucket and
joined with that bucket's count table; the totals come back to the part, where
they are summed per document.  Packing is what keeps the exchange near the size
of the text: a row per n-gram would be many times as large.

A document is scored by what others say: its own occurrences are taken off each
count.  So an n-gram can only count if both its shorter halves occur elsewhere,
and higher orders exchange just those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import written
from eventloom.llm.parts import LOW, pack_keys, unpack_keys, write_parts
from eventloom.llm.words import mix, split_words

ORDER, BACKOFF = 3, 0.4
PART_BYTES = 2 << 20


class Part:
    """The n-grams of a part, order by order, as it learns which of them occur elsewhere."""

    def __init__(self, text: bytes, ends: bytes, buckets: int) -> None:
        cuts = np.concatenate([[0], np.frombuffer(ends, dtype=np.int64)])
        column = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(text)])
        self.word, self.owner, _, _ = split_words(column)
        self.buckets = buckets
        self.order, self.key = 0, np.zeros(len(self.word), np.uint64)
        self.elsewhere: list[np.ndarray] = []  # per order: count outside the document of the n-gram that ends at each word
        self.distinct = 0

    def open(self) -> np.ndarray:
        """The words that end an n-gram of the next order whose halves both occur elsewhere."""
        n = self.order + 1
        if n == 1:
            return np.arange(len(self.word))
        end = np.arange(n - 1, len(self.word))
        end = end[self.owner[end] == self.owner[end - n + 1]]
        before = self.elsewhere[-1]
        return end[(before[end] > 0) & (before[end - 1] > 0)]

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bucket, key) of the distinct open n-grams of the next order, in order; where each open word's is; the words."""
        n, at = self.order + 1, self.open()
        value = self.word[at - n + 1].copy() if n > 1 else self.word[at].copy()
        for i in range(n - 2, -1, -1):
            value = mix(value * np.uint64(31) + self.word[at - i] + np.uint64(n))
        value = mix(value)
        bucket = (value >> np.uint64(40)) % np.uint64(self.buckets)
        # a bucket and 48 more bits name an n-gram, however many buckets there are
        name = (bucket << np.uint64(48)) | (mix(value + np.uint64(1)) & LOW)
        distinct, place = np.unique(name, return_inverse=True)
        return distinct >> np.uint64(48), distinct & LOW, place, at

    def learn(self, totals: dict[int, np.ndarray]) -> None:
        """Takes the corpus totals of the next order's distinct n-grams, by bucket."""
        bucket, _, place, at = self.grams()
        total = np.zeros(len(bucket), np.int64)
        for b, counts in totals.items():
            total[np.searchsorted(bucket, b) : np.searchsorted(bucket, b, "right")] = counts
        pair = self.owner[at].astype(np.int64) * max(len(bucket), 1) + place
        _, back, own = np.unique(pair, return_inverse=True, return_counts=True)
        count = np.zeros(len(self.word), np.int64)
        count[at] = total[place] - own[back] if len(at) else 0
        self.elsewhere.append(count)
        self.order += 1


def _explode(order: int, buckets: int):
    """Rows (bucket, part, keys, counts) of the distinct n-grams of a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = _known(batch, i, order - 1, buckets)
                bucket, key, place, _ = part.grams()
                count = np.bincount(place, minlength=len(key)).astype(np.uint32)
                present, first = np.unique(bucket, return_index=True)
                raw = pack_keys(key)
                cuts = np.append(first, len(key))
                blobs = [(raw[a:b].tobytes(), count[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(present.astype(np.int32)),
                        pa.array([batch.column("part")[i].as_py()] * len(present), pa.int64()),
                        pa.array([b[0] for b in blobs], pa.binary()),
                        pa.array([b[1] for b in blobs], pa.binary()),
                    ],
                    ["bucket", "part", "keys", "counts"],
                )

    return run


def _known(batch: pa.RecordBatch, i: int, orders: int, buckets: int) -> Part:
    part = Part(batch.column("text")[i].as_py(), batch.column("ends")[i].as_py(), buckets)
    for n in range(1, orders + 1):
        got = batch.column(f"totals{n}")[i].as_py() or []
        part.learn({x["bucket"]: np.frombuffer(x["totals"], dtype=np.uint32) for x in got})
    return part


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's count table, joined back to every part's n-grams in it; keys and counts of its buckets are all a task holds."""
    held: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        for bucket, part, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.setdefault(bucket, []).append((part, unpack_keys(keys), np.frombuffer(counts, dtype=np.uint32)))
    for bucket, rows in held.items():
        name, place = np.unique(np.concatenate([k for _, k, _ in rows]), return_inverse=True)
        total = np.bincount(place, np.concatenate([c for _, _, c in rows])).astype(np.uint32)
        at, distinct = 0, len(name)
        for part, keys, _ in rows:
            mine = total[place[at : at + len(keys)]]
            at += len(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([bucket], pa.int32()), pa.array([mine.tobytes()], pa.binary()), pa.array([distinct])],
                ["part", "bucket", "totals", "distinct"],
            )
            distinct = 0  # a bucket's number of distinct n-grams is told once


SCORED = "doc_id long, n_words long, log_score double, n_full long, n_backed_off long"


def score(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, log_score, mean_log_score, n_full, n_backed_off.

    A word after its history scores count(history, word) / count(history) for
    the longest history with a positive count, times `backoff` for every word
    the history was shortened by; with none, (count + 1) / (words + distinct
    words + 1).  Counts leave the document itself out.  Histories start anew in
    each document, shorter at its beginning without penalty.  log_score sums
    natural logarithms over the words, n_full counts words scored at the longest
    history their place allows, n_backed_off the others.  Texts without words
    score 0 with a null mean.  Rows with a null or repeated doc_id are documents
    like any other; an empty table gives no rows; other columns are ignored.
    """
    parts, buckets = write_parts(docs, PART_BYTES)
    known, vocabulary = parts, 0
    for n in range(1, order + 1):
        grams = known.mapInArrow(_explode(n, buckets), "bucket int, part long, keys binary, counts binary")
        counted = grams.repartition(buckets, "bucket").mapInArrow(_count, "part long, bucket int, totals binary, distinct long")
        counted = written(counted, f"totals{n}")
        if n == 1:
            vocabulary = counted.agg(F.coalesce(F.sum("distinct"), F.lit(0)).alias("n")).first()["n"]
        totals = counted.groupBy("part").agg(F.collect_list(F.struct("bucket", "totals")).alias(f"totals{n}"))
        known = known.join(totals, "part", "left")

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(Part(t, e, 1).word) for t, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64())], ["n"])

    words = parts.select("text", "ends").mapInArrow(lengths, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = _known(batch, i, order, buckets)
                docs, valid = np.frombuffer(batch.column("docs")[i].as_py(), np.int64), np.frombuffer(batch.column("known")[i].as_py(), np.uint8)
                owner, count = part.owner, np.bincount(part.owner, minlength=len(docs))
                first = np.concatenate([[0], np.cumsum(count)[:-1]])
                place = np.arange(len(owner)) - first[owner]  # words before this one in its document
                others = words - count[owner]
                log = np.log((part.elsewhere[0] + 1) / (others + vocabulary + 1))
                used = np.zeros(len(owner), np.int64)
                for n in range(2, order + 1):
                    hit = np.flatnonzero(part.elsewhere[n - 1] > 0)
                    log[hit] = np.log(part.elsewhere[n - 1][hit] / part.elsewhere[n - 2][hit - 1])
                    used[hit] = n - 1
                full = np.minimum(place, order - 1)
                log += (full - used) * np.log(backoff)
                # of no words at all, bincount gives integers
                sums = [np.bincount(owner, w, len(docs)).astype(float) for w in (log, (used == full).astype(float))]
                exact = sums[1].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, mask=valid == 0), pa.array(count.astype(np.int64)), pa.array(sums[0]), pa.array(exact), pa.array(count - exact)],
                    [x.split()[0] for x in SCORED.split(", ")],
                )

    scored = known.mapInArrow(run, SCORED)
    return scored.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))

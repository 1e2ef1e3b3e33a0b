"""Texts in parts: a few megabytes of documents to a row, written once and bucketed by part.

Operators that exchange packed n-grams or suffixes with other tasks join the
answers back by part; since parts are bucketed, only the answers move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from eventloom.llm.common import doc_key
from eventloom.llm.words import small_batches, text_bytes
from eventloom.session import shared_path

PARTS = "part long, docs binary, known binary, text binary, ends binary"
#: Bytes of a hash that travel: with the bucket's own number they name a gram however much data there is.
KEY_BYTES = 6
LOW = np.uint64((1 << 8 * KEY_BYTES) - 1)


def write_parts(docs: DataFrame, part_bytes: int) -> tuple[DataFrame, int]:
    """The parts table (doc ids, which of them are known, the texts' bytes end to end, where each ends) and its buckets."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in small_batches(batches, limit=part_bytes):
            data, starts = text_bytes(batch.column(1))
            keys = batch.column(0)
            docs, known = keys.fill_null(0).to_numpy().astype(np.int64), np.asarray(keys.is_valid()).astype(np.uint8)
            values = [x.tobytes() for x in (docs, known, data, starts[1:].astype(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + n]), *[pa.array([v], pa.binary()) for v in values]], ["part", "docs", "known", "text", "ends"])
            n += 1

    path = shared_path(spark, "parts")
    name = "parts_" + path.rpartition("-")[2]
    rows = doc_key(docs).mapInArrow(run, PARTS)
    rows.write.bucketBy(buckets, "part").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    return spark.table(name), buckets


def pack_keys(key: np.ndarray) -> np.ndarray:
    """The low bytes of each 64-bit key, one row per key."""
    return np.ascontiguousarray(key).view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]


def unpack_keys(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, KEY_BYTES)
    return out.view(np.uint64).reshape(-1)

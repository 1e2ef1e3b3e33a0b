"""Words of a batch of texts as 64-bit hashes, vectorised over the batch's bytes.

Used inside tasks on one Arrow batch at a time.  A word is a run of bytes
outside white space (0x20, 0x09-0x0D); `A-Z` count as `a-z`.  UTF-8 never uses
those bytes inside a longer character, so byte runs and character runs agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end, and where each text begins (one more than texts); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    data, starts = column.buffers()[2], np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[starts[0] : starts[-1]], starts - starts[0]


_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power(n: int, inverse: bool) -> np.ndarray:
    """The first n powers of the base or its inverse, kept for the next batch."""
    if len(_powers[inverse]) < n:
        full = np.full(n + n // 4, _INVERSE if inverse else BASE, dtype=np.uint64)
        full[0] = 1
        _powers[inverse] = np.multiply.accumulate(full)
    return _powers[inverse][:n]


def span_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums of bytes, for :func:`span_hash`."""
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(len(data), False), out=total[1:])
    return total


def span_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes begin:end for each pair: a polynomial from running sums, then mixed."""
    return mix((sums[end] - sums[begin]) * _power(len(sums), True)[begin])


def small_batches(batches: Iterator[pa.RecordBatch], column: int = 1, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about `limit` bytes of text, so that working arrays stay small; one long text is one slice."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        group = (np.cumsum(size) - size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)


def split_words(column: pa.Array | pa.ChunkedArray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, text number of each word, begin, end): begin and end in the joined bytes.

    `keep` maps bytes to bytes before splitting (default: lower case).
    """
    raw, starts = text_bytes(column)
    data = (LOWER if keep is None else keep)[raw]
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = starts[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    owner = np.searchsorted(starts, begin, side="right") - 1
    return span_hash(span_sums(data), begin, end), owner, begin, end


def shingles(hashes: np.ndarray, owner: np.ndarray, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every run of `k` words inside one text, in order.

    With `short`, a text of 1 to k-1 words gives all its words as one shingle.
    """
    n = len(hashes) - k + 1
    if n > 0:
        value = hashes[:n].copy()
        for i in range(1, k):
            value = mix(value * np.uint64(31) + hashes[i : n + i] + np.uint64(i))
        inside = owner[:n] == owner[k - 1 :]
        value, of = value[inside], owner[:n][inside]
    else:
        value, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if short and len(owner):
        texts, at, count = np.unique(owner, return_index=True, return_counts=True)
        few = count < k
        if few.any():
            extra = np.array([_fold(hashes[a : a + c]) for a, c in zip(at[few], count[few], strict=True)], dtype=np.uint64)
            value, of = np.concatenate([value, extra]), np.concatenate([of, texts[few]])
            order = np.argsort(of, kind="stable")
            value, of = value[order], of[order]
    return value, of


def _fold(words: np.ndarray) -> np.uint64:
    value = words[:1].copy()
    for i in range(1, len(words)):
        value = mix(value * np.uint64(31) + words[i : i + 1] + np.uint64(i))
    return mix(value + np.uint64(len(words)))[0]

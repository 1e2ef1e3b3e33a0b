"""Best-two-fit packing of documents into token sequences of one length.

Tokenising gives a small row per piece; pieces are dealt evenly, whatever
their document, to blocks of bounded size, and each block is packed by itself.
Only its last few sequences can be loose, one block in tens of thousands of
pieces.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from eventloom.llm.common import doc_key, partitions_for, written

CAPACITY = 2048
SEPARATOR = 0
VOCABULARY = "byte_bpe_50k.json"
# Fixed value: how byte-level tokenizers of this kind split text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length.

    A sequence is filled with the largest length that still fits, again and
    again.  If a gap is left, its smallest member gives way to the two unpacked
    lengths that together fill the widened gap best, as long as that is better.
    Available lengths are the bits of one integer, so each search is a few
    shifts and masks.
    """
    order = np.argsort(lengths, kind="stable")
    bounds = np.searchsorted(lengths[order], np.arange(capacity + 2))
    stacks = {n: order[a:b].tolist() for n, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a}
    free = sum(1 << n for n in stacks)
    mirror = sum(1 << (capacity - n) for n in stacks)
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)

    def take(n: int) -> int:
        nonlocal free, mirror
        i = stacks[n].pop()
        if not stacks[n]:
            free ^= 1 << n
            mirror ^= 1 << (capacity - n)
        return i

    def give(n: int, i: int) -> None:
        nonlocal free, mirror
        if not stacks[n]:
            free ^= 1 << n
            mirror ^= 1 << (capacity - n)
        stacks[n].append(i)

    def pair(least: int, most: int) -> tuple[int, int] | None:
        for total in range(most, least, -1):
            # bit n is set when both n and total - n are free
            both = free & (mirror >> (capacity - total)) & ((1 << (total // 2 + 1)) - 1)
            while both:
                n = both.bit_length() - 1
                if 2 * n != total or len(stacks[n]) > 1:
                    return n, total - n
                both ^= 1 << n
        return None

    bins = 0
    while free:
        held: list[tuple[int, int]] = []
        gap = capacity
        while gap and (fits := free & ((1 << (gap + 1)) - 1)):
            n = fits.bit_length() - 1
            held.append((n, take(n)))
            gap -= n
        while gap and free:
            n, i = min(held)
            if (two := pair(n, gap + n)) is None:
                break
            held.remove((n, i))
            held += [(x, take(x)) for x in two]
            give(n, i)
            gap += n - sum(two)
        at = 0
        for n, i in held:
            sequence[i], offset[i] = bins, at
            at += n
        bins += 1
    return sequence, offset


def encoder(path: str | None = None) -> Callable[[str], np.ndarray]:
    """The ids of a text under the byte-level BPE tokenizer file at `path`, without added special tokens.

    Ids equal those of the `tokenizers` library.  A text with the name of a
    special token goes to that library.  All others take the same vocabulary
    through `tiktoken`, about four times as fast: ids rise in merge order, so
    they serve as its ranks.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tiktoken import Encoding
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = [t["content"] for t in spec["added_tokens"]]
    # byte-level vocabularies spell byte b as the b-th of a fixed alphabet: printable bytes as themselves, others from U+0100 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelled = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    assert set(spelled) == set(ByteLevel.alphabet())
    ranks = {bytes(spelled[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    fast = Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    whole = Tokenizer.from_file(path)

    def encode(text: str) -> np.ndarray:
        if any(name in text for name in special):
            return np.array(whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return fast.encode_to_numpy(text, disallowed_special=())

    return encode


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32.

    A document is its token ids and the separator.  Only one longer than
    `capacity` is cut; all its pieces but the first are full.  `tokenizer` is
    the path of a tokenizer file, the same on every node.
    """

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            out: list[tuple[int | None, int, int, int, int]] = []
            keys, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 64):  # few texts in Python at once
                for key, text in zip(keys.slice(at, 64).to_pylist(), texts.slice(at, 64).to_pylist(), strict=True):
                    ids = np.append(encode(text), separator).astype("<u4")
                    first = len(ids) % capacity or min(len(ids), capacity)
                    cuts = [0, *range(first, len(ids) + 1, capacity)]
                    out += [(key, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return doc_key(docs).mapInArrow(tokenize, PIECES)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, separator: int = SEPARATOR, block: int = BLOCK) -> DataFrame:
    """Every piece of every document with its sequence_id and offset.

    Null text is an empty document of one separator; rows with a null or
    repeated doc_id are packed like any other; an empty table gives no rows;
    columns other than doc_id and text are ignored.
    """
    cut = written(pieces(docs, tokenizer, capacity, separator), "pieces")
    parts = partitions_for(cut.count(), block)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, held = TaskContext.get().partitionId(), 0, []

        def flush() -> pa.RecordBatch:
            nonlocal done, held
            rows = pa.Table.from_batches(held).combine_chunks()
            sequence, offset = best_two_fit(rows.column("length").to_numpy(), capacity)
            ids = (np.int64(part) << np.int64(32)) + done + sequence
            done += int(sequence.max()) + 1
            held = []
            return rows.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset)).to_batches()[0]

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= 2 * block:
                yield flush()
        if held:
            yield flush()

    return cut.repartition(parts).mapInArrow(fill, PIECES + ", sequence_id long, offset long")

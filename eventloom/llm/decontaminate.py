"""Benchmark decontamination: rare n-gram seeds find candidates, Smith-Waterman scores them.

Texts are compared as lower-case words of letters, marks and digits; where a
script has no spaces between words, each character is one.  An alignment earns 2
for an equal word and loses 1 for a replaced or missing item word and 2 for an
extra document word; similarity is the share of equal words that replacements
alone would leave at that score.  At similarity s an item of L words can lose at
most n(1-s)L of its n-word seeds, so one of any n(1-s)L + 1 of them survives:
the rarest that many, by document frequency in the corpus, are the seeds that
join, and a candidate must share as many seeds in all as the bound leaves.
Seeds have three words, or fewer in short items, as many as leave a survivor in
any case (at 0.8: three from six words on, two from two, one in one word), so
no copy at or above the threshold is missed, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import doc_key, written
from eventloom.llm.words import shingles, small_batches, split_words, text_bytes

#: Words of a seed at most.
SEED_WORDS = 3
SIMILARITY = 0.8
#: Seeds sent to every task at once (8 bytes each); a larger benchmark is searched in blocks of items.
BLOCK_SEEDS = 1 << 20


def plain(column: pa.Array) -> pa.Array:
    """Texts in lower case with everything but letters, marks and digits as one space; characters of scripts without spaces stand alone."""
    column = pc.utf8_lower(pc.fill_null(column, ""))
    if (text_bytes(column)[0] >= 0xE0).any():  # such scripts take three bytes a character
        column = pc.replace_substring_regex(column, r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])", r" \1 ")
    return pc.replace_substring_regex(column, r"[^\p{L}\p{M}\p{N}]+", " ")


def lost_seeds(words: np.ndarray, n: np.ndarray | int, similarity: float) -> np.ndarray:
    """How many n-word seeds of an item a copy at the threshold can lack at most."""
    return np.floor(n * (1 - similarity) * words + 1e-9).astype(np.int64)


def seed_words(words: np.ndarray, similarity: float, most: int) -> np.ndarray:
    """Words of an item's seeds: the most up to `most` that leave every copy at the threshold a seed."""
    out = np.ones(len(words), dtype=np.int64)
    for n in range(2, most + 1):
        out[words - n + 1 > lost_seeds(words, n, similarity)] = n
    return out


def item_seeds(items: DataFrame, most: int, similarity: float) -> DataFrame:
    """(copy, n, pos, runs, lost, seed) for every seed of every item (copy, text): of n words, of `runs` in all, of which `lost` may lack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            hashes, owner, _, _ = split_words(plain(batch.column(1)))
            count = np.bincount(owner, minlength=batch.num_rows)
            length = seed_words(count, similarity, most)
            for n in range(1, most + 1):
                value, of = shingles(hashes, owner, n, short=False)
                mine = length[of] == n
                value, of = value[mine], of[mine]
                first = np.searchsorted(of, np.arange(batch.num_rows))
                numbers = [np.full(len(of), n), np.arange(len(of)) - first[of], count[of] - n + 1, lost_seeds(count[of], n, similarity)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(of)), *map(pa.array, numbers), pa.array(value.view(np.int64))], ["copy", "n", "pos", "runs", "lost", "seed"]
                )

    return items.select("copy", "text").mapInArrow(run, "copy long, n long, pos long, runs long, lost long, seed long")


def seed_hits(docs: DataFrame, seeds: dict[int, np.ndarray]) -> DataFrame:
    """(doc_id, n, seed): which of sorted seeds of n words each document has, once each."""
    sent = docs.sparkSession.sparkContext.broadcast(seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # most n-grams are settled by one look-up of their top bits
        bits = {n: 64 - max(16, int(len(known)).bit_length() + 6) for n, known in sent.value.items()}
        marked = {}
        for n, known in sent.value.items():
            marked[n] = np.zeros(1 << (64 - bits[n]), dtype=bool)
            marked[n][known >> np.uint64(bits[n])] = True
        for batch in small_batches(batches):
            hashes, owner, _, _ = split_words(plain(batch.column(1)))
            for n, known in sent.value.items():
                value, of = shingles(hashes, owner, n, short=False)
                may = marked[n][value >> np.uint64(bits[n])]
                value, of = value[may], of[may]
                at = np.searchsorted(known, value)
                hit = known[np.minimum(at, len(known) - 1)] == value
                value, of = value[hit], of[hit]
                if len(value):
                    pair = np.unique(np.stack([of.astype(np.uint64), value], axis=1), axis=0)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(pair[:, 0].astype(np.int64))), pa.array(np.full(len(pair), n)),
                            pa.array(np.ascontiguousarray(pair[:, 1]).view(np.int64)),
                        ],
                        ["doc_id", "n", "seed"],
                    )

    return docs.mapInArrow(run, "doc_id long, n long, seed long")


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """(best local score, index after its last word in `words`), by rows over the item's words.

    Moving along `words` costs 2 a step, so a row's best is a running maximum
    of score + 2 * index.
    """
    steps = 2 * np.arange(len(words) + 1)
    row, best, end = np.zeros(len(words) + 1, np.int64), 0, 0
    for word in item:
        new = np.maximum(row - 1, 0)
        np.maximum(new[1:], row[:-1] + np.where(words == word, 2, -1), out=new[1:])
        row = np.maximum.accumulate(new + steps) - steps
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def score_pairs(pairs: DataFrame, similarity: float) -> DataFrame:
    """Aligns each (doc_id, item_id, text, item_text) and keeps those at the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                sides = []
                for name in ("text", "item_text"):
                    hashes, owner, _, _ = split_words(plain(batch.column(name)))
                    sides.append((hashes, np.searchsorted(owner, np.arange(batch.num_rows + 1))))
                out = []
                for i, (doc, item) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("item_id").to_pylist(), strict=True)):
                    words, of_item = (h[s[i] : s[i + 1]] for h, s in sides)
                    score, end = align(of_item, words)
                    same = (score / len(of_item) + 1) / 3
                    if same >= similarity - 1e-9:
                        begin = end - align(of_item[::-1], words[:end][::-1])[1]
                        out.append((doc, item, same, score, begin, end))
                columns = list(zip(*out, strict=True)) or [[]] * 6
                types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], FOUND.replace(",", "").split()[::2])

    return pairs.select("doc_id", "item_id", "text", "item_text").mapInArrow(run, FOUND)


FOUND = "doc_id long, item_id long, similarity double, score long, word_begin long, word_end long"


def leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, n: int = SEED_WORDS, block_seeds: int = BLOCK_SEEDS) -> DataFrame:
    """One row per document and test item it holds a copy of: similarity, score and the span of plain words.

    `items` has item_id and text.  Texts without a word on either side, null and
    empty ones among them, match nothing; an item of one word matches where that
    word occurs.  Rows without doc_id are not searched.  Each text of an item_id
    is searched by itself; rows that share a doc_id or an item_id and match give
    one row, the best.  Empty tables give no rows; other columns are ignored.
    """
    own = doc_key(docs).filter("doc_id is not null")
    tests = doc_key(items, "item_id").withColumnRenamed("doc_id", "item_id").filter("item_id is not null").distinct()
    tests = written(tests.withColumn("copy", F.monotonically_increasing_id()), "items")
    seeds = written(item_seeds(tests, n, similarity), "seeds")
    blocks = max(1, -(-seeds.count() // block_seeds))
    found = []
    for block in range(blocks):
        mine = seeds.filter(F.pmod(F.xxhash64("copy"), F.lit(blocks)) == block)
        # about block_seeds long values, whatever the size of the benchmark
        known: dict[int, list[int]] = {}
        for r in mine.select("n", "seed").distinct().toLocalIterator():
            known.setdefault(r["n"], []).append(r["seed"])
        if known:
            found.append(_search(own, tests, mine, {k: np.unique(np.array(v, dtype=np.int64).view(np.uint64)) for k, v in known.items()}, similarity))
    if not found:
        return docs.sparkSession.createDataFrame([], FOUND)
    every = found[0]
    for more in found[1:]:
        every = every.unionAll(more)
    best = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("similarity"), F.desc("score"), "word_begin", "word_end")
    return every.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


def _search(own: DataFrame, tests: DataFrame, seeds: DataFrame, known: dict[int, np.ndarray], similarity: float) -> DataFrame:
    hits = written(seed_hits(own, known), "hits")
    spread = hits.groupBy("n", "seed").agg(F.count("*").alias("df"))
    rank = Window.partitionBy("copy").orderBy(F.coalesce("df", F.lit(0)), "seed", "pos")
    ranked = seeds.join(spread, ["n", "seed"], "left").withColumn("nth", F.row_number().over(rank))
    ranked = written(ranked.select("copy", "n", "seed", "lost", "nth", "runs"), "ranked")
    # what a copy may lack is one number per item text, so any of its rows tells it
    joined = hits.join(ranked, ["n", "seed"]).groupBy("doc_id", "copy").agg(
        F.count("*").alias("shared"), F.min(F.col("nth") - F.col("lost")).alias("rarest"), F.first("lost").alias("lost"), F.first("runs").alias("runs")
    )
    pairs = written(joined.filter("rarest <= 1 and shared >= runs - lost").select("doc_id", "copy"), "candidates")
    texts = own.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    return score_pairs(pairs.join(texts, "doc_id").join(tests.withColumnRenamed("text", "item_text"), "copy"), similarity)


def drop_leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `docs` that hold no test item, with all their columns; rows without doc_id stay."""
    hit = leaks(docs, items, similarity).select(F.col("doc_id").alias("hit_id")).distinct()
    return docs.join(hit, docs["doc_id"].cast("long") == hit["hit_id"], "left_anti")

"""Toxicity by a chain of linear classifiers.

Categories are predicted in order; each later model also sees the earlier
categories' log-odds.  While fitting, those come from folds that did not train
on the row (out-of-fold), so later models learn from predictions as uncertain
as they will meet.  Features are the distinct words of a text and their first
bytes, hashed: stems count even where the rest of a word is new.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import doc_key, written
from eventloom.llm.words import LOWER, mix, small_batches, span_hash, span_sums, split_words, text_bytes

#: Labelled texts used for fitting, at most; the only sample in this operator.
FIT_ROWS = 8_000
FOLDS = 4
BUCKET_BITS = 18
PREFIXES = (4, 5, 6, 7)
ROUNDS, STEP, SHRINK, SMOOTH = 40, 1.0, 1e-3, 20.0
#: What one clean text taken for toxic costs against one toxic text found, when the cut is chosen.
FALSE_COST = 2.0
CATEGORIES = ("low_quality", "toxic")


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashed features of every text end to end, where each text begins)."""
    hashes, owner, begin, end = split_words(column)
    data = LOWER[text_bytes(column)[0]]
    sums = span_sums(data)
    parts, of = [mix(hashes)], [owner]
    for n in PREFIXES:
        longer = end - begin > n
        parts.append(mix(span_hash(sums, begin[longer], begin[longer] + n) + np.uint64(n)))
        of.append(owner[longer])
    bucket = np.concatenate(parts) >> np.uint64(64 - BUCKET_BITS)
    both = np.unique((np.concatenate(of).astype(np.uint64) << np.uint64(BUCKET_BITS)) | bucket)
    starts = np.searchsorted(both >> np.uint64(BUCKET_BITS), np.arange(len(column) + 1, dtype=np.uint64))
    return (both & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int32), starts


def margins(weights: np.ndarray, index: np.ndarray, starts: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """The log-odds of each text: weights are one per bucket, one per earlier category, and a bias."""
    size = starts[1:] - starts[:-1]
    total = np.concatenate([[0.0], np.cumsum(weights[index], dtype=np.float64)])
    sums = total[starts[1:]] - total[starts[:-1]]
    dims = 1 << BUCKET_BITS
    return sums / np.sqrt(np.maximum(size, 1)) + earlier @ weights[dims:-1] + weights[-1]


def fit(index: np.ndarray, starts: np.ndarray, earlier: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by full-batch Adam on features scaled by their log ratio of the two classes; deterministic."""
    dims = 1 << BUCKET_BITS
    size = starts[1:] - starts[:-1]
    scale = 1 / np.sqrt(np.maximum(size, 1))
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    with_it = np.bincount(index, np.repeat(y, size), dims)
    without = np.bincount(index, minlength=dims) - with_it
    ratio = np.log((with_it + SMOOTH * share) / share) - np.log((without + SMOOTH * (1 - share)) / (1 - share))
    ratio = np.concatenate([ratio, np.ones(earlier.shape[1] + 1)])
    free = np.zeros(len(ratio))
    free[-1] = np.log(share / (1 - share))
    mean, square = np.zeros_like(free), np.zeros_like(free)
    for t in range(1, ROUNDS + 1):
        gap = 1 / (1 + np.exp(-np.clip(margins(free * ratio, index, starts, earlier), -30, 30))) - y
        slope = np.concatenate([np.bincount(index, np.repeat(gap * scale, size), dims), earlier.T @ gap, [gap.sum()]]) * ratio
        slope[:dims] += SHRINK * free[:dims]
        slope /= max(len(y), 1)
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        free -= STEP * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-4)
    return free * ratio


def _sample(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], rows: int) -> DataFrame:
    """At most `rows` labelled, distinct texts, by the order of a hash: (doc_id, fold, y, index)."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("double").alias(c) for c in categories])
    known = known.dropna().groupBy("doc_id").agg(*[F.max(c).alias(c) for c in categories])
    # texts stay where they are: only ids and hashes are shuffled, and the chosen ids (at most `rows`) broadcast
    hashed = doc_key(docs).select("doc_id", F.xxhash64("text").alias("order")).join(known, "doc_id")
    chosen = hashed.groupBy("order").agg(F.min(F.struct("doc_id", *categories)).alias("r")).select("order", "r.*").orderBy("order", "doc_id").limit(rows)
    chosen = written(chosen, "sample")
    picked = doc_key(docs).join(F.broadcast(chosen), "doc_id").filter(F.xxhash64("text") == F.col("order")).dropDuplicates(["doc_id"])
    picked = picked.select("doc_id", "text", F.pmod(F.hash("order"), F.lit(FOLDS)).alias("fold"), F.array(*categories).alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            index, starts = features(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(index))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), lists], ["doc_id", "fold", "y", "index"])

    return written(picked.mapInArrow(run, "doc_id long, fold int, y array<double>, index array<int>"), "features")


def _learner(place: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Fits one fold of one category; model FOLDS leaves no row out and returns its weights."""

    def learn(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc_id", kind="stable")
        out = frame["fold"].to_numpy() == key[0]

        def arrays(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            lists = list(part["index"])
            starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            earlier = np.array([list(x) for x in part["earlier"]], dtype=float).reshape(len(part), place)
            return (np.concatenate(lists) if lists else np.zeros(0, np.int64)).astype(np.int64), starts, earlier

        used = frame[~out]
        weights = fit(*arrays(used), used["y"].map(lambda v: v[place]).to_numpy(float))
        if key[0] == FOLDS:
            return pd.DataFrame({"doc_id": [None], "odds": [None], "weights": [weights.tobytes()]})
        held = frame[out]
        return pd.DataFrame({"doc_id": held["doc_id"], "odds": margins(weights, *arrays(held)), "weights": None})

    return learn


def chain(models: list[np.ndarray], texts: pa.Array) -> np.ndarray:
    """The log-odds of every text (rows) for every category (columns), each model seeing those before it."""
    index, starts = features(texts)
    odds = np.zeros((len(texts), 0))
    for weights in models:
        odds = np.column_stack([odds, margins(weights, index, starts, odds)])
    return odds


def best_cut(odds: np.ndarray, y: np.ndarray) -> float:
    """The log-odds above which true hits less FALSE_COST times false ones are most, midway to the next row; infinite if never positive."""
    order = np.argsort(-odds, kind="stable")
    odds, y = odds[order], y[order]
    gain = np.cumsum(np.where(y > 0, 1.0, -FALSE_COST))
    if not len(gain) or gain.max() <= 0:
        return np.inf
    last = int(gain.argmax())
    return float(odds[last] if last + 1 == len(odds) else (odds[last] + odds[last + 1]) / 2)


def train(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, rows: int = FIT_ROWS) -> tuple[list[np.ndarray], float]:
    """(weights of each category's model, cut for the last one's log-odds); each fit is a Spark task over the bounded sample.

    The cut also comes from out-of-fold predictions.
    """
    sample = _sample(docs, labels, categories, rows).withColumn("earlier", F.expr("cast(array() as array<double>)"))
    models = []
    for place in range(len(categories)):
        copies = sample.withColumn("model", F.explode(F.array(*[F.lit(m) for m in range(FOLDS + 1)])))  # model FOLDS leaves no row out
        fitted = written(copies.groupBy("model").applyInPandas(_learner(place), "doc_id long, odds double, weights binary"), "models")
        whole = fitted.filter("weights is not null").first()
        models.append(np.frombuffer(bytes(whole["weights"])) if whole else np.zeros((1 << BUCKET_BITS) + place + 1))
        held = sample.join(fitted.filter("weights is null").select("doc_id", "odds"), "doc_id")
        if place < len(categories) - 1:
            sample = written(held.withColumn("earlier", F.concat("earlier", F.array("odds"))).drop("odds"), "features")
    seen = held.select("odds", F.col("y")[len(categories) - 1].alias("y")).orderBy("odds").toPandas()  # at most `rows` rows
    return models, best_cut(seen["odds"].to_numpy(float), seen["y"].to_numpy(float))


def score(docs: DataFrame, models: list[np.ndarray], cut: float) -> DataFrame:
    """Per row of `docs`: doc_id, probabilities (one per category, in order) and toxic (the last log-odds reach the cut)."""
    sent = docs.sparkSession.sparkContext.broadcast([m.astype(np.float32) for m in models])  # a megabyte each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            odds = chain(sent.value, batch.column(1))
            likely = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(odds) + 1, dtype=np.int32) * len(models)), pa.array(likely.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(odds[:, -1] >= cut)], ["doc_id", "probabilities", "toxic"])

    return doc_key(docs).mapInArrow(run, "doc_id long, probabilities array<double>, toxic boolean")


def with_low_quality(labels: DataFrame) -> DataFrame:
    """Labels (doc_id, quality, toxic) with the chain's first category, low_quality."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def classify(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """One row per row of `docs`: doc_id, low_quality and toxicity (probabilities), toxic, kept.

    The models are fitted on at most `rows` labelled texts of `docs`; labels
    with a null are left out, several labels of one doc_id count as their
    largest.  Null and empty texts are scored by the earlier odds and bias
    alone; with no usable labels everything scores 0.5 and nothing is toxic.
    Repeated rows and null ids are scored like any other; an empty table gives
    no rows; other columns are ignored.
    """
    scored = score(docs, *train(docs, with_low_quality(labels), CATEGORIES, rows))
    return scored.select(
        "doc_id", F.col("probabilities")[0].alias("low_quality"), F.col("probabilities")[1].alias("toxicity"), "toxic", (~F.col("toxic")).alias("kept")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """The rows of `docs` that are not toxic, with all their columns; each row is judged by itself, in place."""
    models, cut = train(docs, with_low_quality(labels), CATEGORIES, rows)
    sent = docs.sparkSession.sparkContext.broadcast([m.astype(np.float32) for m in models])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, at):
            yield batch.filter(pa.array(chain(sent.value, batch.column(at))[:, -1] < cut))

    return docs.mapInArrow(run, docs.schema)

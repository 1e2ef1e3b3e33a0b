"""The n-gram join against comparison of all pairs."""

import numpy as np
import pyarrow as pa
import pytest
from brute import near
from conftest import SF_SMALL
from test_dedup import DOCS, ODD, corpus

from eventloom.llm import ngram_join
from eventloom.llm.queries import QUERIES


def components(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_join_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert components(QUERIES["op12_ngram_jaccard_join"](spark, SF_SMALL)) == near(rows, 5, 80)


@pytest.mark.parametrize("seed, k, threshold, tile", [(1, 5, 80, 200_000), (2, 2, 80, 50), (3, 1, 60, 200), (4, 3, 90, 1)])
def test_join(spark, monkeypatch, seed, k, threshold, tile):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    rows = corpus(seed)
    assert components(ngram_join.join_ngrams(spark.createDataFrame(rows, DOCS).repartition(3), k, threshold)) == near(rows, k, threshold)


def test_join_odd_inputs(spark):
    odd = [(1, "t u"), (1, "t u"), (1, "v w x"), (None, "t u"), (2, "T  u"), (3, None), (4, "   "), (5, "v w x")]
    df = spark.createDataFrame([(*r, *"abcd", 1, 2, 3) for r in odd], ODD)
    got = ngram_join.join_ngrams(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    rows = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in got.collect())
    assert rows == [(-1, 1, None), (1, 1, 1), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4), (5, 1, 1)]
    assert ngram_join.join_ngrams(df.limit(0)).isEmpty()


@pytest.mark.parametrize("threshold", [50, 80, 95])
def test_similar_sets_share_a_signature(threshold):
    """For pairs just at the threshold, of every size up to 60 and some larger ones."""
    rnd = np.random.default_rng(threshold)
    for size in [*range(1, 61), 150, 700]:
        for _ in range(20):
            other = int(rnd.integers(-(-size * threshold // 100), size + 1))
            shared = -(-threshold * (size + other) // (100 + threshold))
            if shared > other:
                continue
            value = rnd.integers(0, 2**63, size + other - shared).astype(np.uint64)
            one, two = value[:size], value[size - shared :]
            found = []
            for x in (one, two):
                s, owner = ngram_join.signatures(np.sort(x), np.array([0, len(x)]), threshold)
                assert (owner == 0).all() and len(s) <= 4 * len(x) + 40
                found.append(set(s.tolist()))
            assert found[0] & found[1], (size, other, shared)


def test_signatures_do_not_depend_on_the_batch():
    texts = [t for _, t in corpus(7)]
    value, starts = ngram_join.distinct_sets(pa.array(texts, pa.string()), 3)
    together, owner = ngram_join.signatures(value, starts, 80)
    for i in range(len(texts)):
        alone, _ = ngram_join.signatures(value[starts[i] : starts[i + 1]], np.array([0, starts[i + 1] - starts[i]]), 80)
        assert sorted(together[owner == i].tolist()) == sorted(alone.tolist())

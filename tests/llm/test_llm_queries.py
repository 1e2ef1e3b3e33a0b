"""The registered queries over whole tables: against SQL where there is some, else against brute force."""

import hashlib

import pytest
from brute import backoff_scores, near, repeats
from compare import connect, differences
from conftest import SF_SMALL

import __spark_entry__ as contract
from eventloom.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    assert differences(QUERIES[name](spark, SF_SMALL), connect(SF_SMALL), ORACLES[name]) == ""


def test_near(spark, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op3_minhash_near_dedup"](spark, SF_SMALL).collect()}
    assert got == near(rows, 2, 80)


def test_scores(spark, rows):
    got = {r.doc_id: r for r in QUERIES["op6_lm_scoring"](spark, SF_SMALL).collect()}
    want = backoff_scores(rows, 3, 0.4)
    assert set(got) == set(want)
    assert all(got[d].n_words == n and got[d].n_full == f and abs(got[d].log_score - s) <= 1e-6 * max(1, abs(s)) for d, (n, s, f) in want.items())


def test_repeats(spark, rows):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op7_suffix_dedup"](spark, SF_SMALL).collect()}
    assert got == {d: (*x[:3], hashlib.sha256(x[3]).hexdigest()) for d, x in repeats(rows, 50).items()}


def test_whole_tables(spark, rows):
    assert QUERIES["op4_toxicity"](spark, SF_SMALL).count() == len(rows)
    shards = QUERIES["op8_sharding"](spark, SF_SMALL).collect()
    assert sorted(r.doc_id for r in shards) == sorted(d for d, _ in rows) and {r.law for r in shards} == {"key"}
    assert all(r.size == len((dict(rows)[r.doc_id] or "").encode()) + 16 for r in shards)
    assert {r.doc_id for r in QUERIES["op9_best_fit_packing"](spark, SF_SMALL).collect()} == {d for d, _ in rows}
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").count()
    assert QUERIES["op10_html_extraction"](spark, SF_SMALL).count() == pages


def test_leaks_are_all_verbatim_ones_at_least(spark, rows):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in QUERIES["op1_benchmark_decontamination"](spark, SF_SMALL).collect()}
    assert {(d, i) for d, t in rows for i, x in items if x in (t or "")} <= got

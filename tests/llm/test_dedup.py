"""Exact, near and repeated-string deduplication against brute force."""

import random

import pyarrow as pa
import pytest
from brute import exact, near, repeats, words

from eventloom.llm import exact_dedup, near_dedup, suffix_dedup
from eventloom.llm.words import shingles, split_words

DOCS = "doc_id long, text string"
ODD = "doc_id long, text string, keep_id string, row string, key string, _id string, hit_id int, id int, kept_id int"


def prose(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def corpus(seed, n=120):
    """Random texts with exact copies, near copies, a hot text, shared passages, nulls, blanks and a long one."""
    rnd = random.Random(seed)
    passage = prose(rnd, 40)
    texts = [None, "", " \t\n", "one", "One", "zwei Wörter", prose(rnd, 6000), passage]
    while len(texts) < n:
        kind = rnd.random()
        if kind < 0.25:
            texts.append(rnd.choice(texts))
        elif kind < 0.5:
            w = (rnd.choice(texts) or "x y").split()[:300] or ["x"]
            for _ in range(rnd.randrange(1, 4)):
                w[rnd.randrange(len(w))] = f"edit{rnd.randrange(9)}"
            texts.append(" ".join(w))
        elif kind < 0.65:
            texts.append(prose(rnd, 20) + " " + passage[: rnd.randrange(60, len(passage))] + " " + prose(rnd, 5))
        elif kind < 0.8:
            texts.append("hot text of many copies, longer than fifty bytes in any case")
        else:
            texts.append(prose(rnd, rnd.randrange(1, 120)))
    ids = rnd.sample(range(10_000), n)
    return list(zip(ids, texts, strict=True))


def test_words_match_plain_splitting():
    texts = ["Hello  World", None, "", "\x0b\x0c", "Ünï  çødé\tX", "a" * 5000 + " b", "x"]
    _, owner, begin, end = split_words(pa.array(texts, pa.string()))
    raw = "".join(t or "" for t in texts).encode()
    got = [[] for _ in texts]
    for o, a, b in zip(owner, begin, end, strict=True):
        got[o].append("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in raw[a:b].decode()))
    assert got == [words(t) for t in texts]


def test_short_texts_are_one_shingle():
    hashes, owner, _, _ = split_words(pa.array(["a b", "a b", "b a", "a b c", ""]))
    value, of = shingles(hashes, owner, 3)
    assert of.tolist() == [0, 1, 2, 3] and value[0] == value[1] and len(set(value.tolist())) == 3


@pytest.mark.parametrize("counters", [1, 3, 1023])
def test_exact_groups(spark, counters):
    rows = corpus(1)
    got = exact_dedup.group_exact(spark.createDataFrame(rows, DOCS), counters).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == exact(rows) and len(got) == len(rows)


def test_misra_gries_keeps_frequent(spark):
    rows = [("a",)] * 40 + [("b",)] * 30 + [(f"x{i}",) for i in range(29)]
    got = exact_dedup.misra_gries(spark.createDataFrame(rows, "digest string").repartition(5), 3).collect()
    assert {"a", "b"} <= {r.digest for r in got} and len(got) <= 3 and all(r["count"] <= 40 for r in got)


@pytest.mark.parametrize("counters", [2, 1023])
@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_dropped_exact_copies_by_brute_force(spark, counters, broadcast):
    """Whatever way losers' ids reach the rows, with repeated rows and rows without id among frequent and rare texts."""
    rows = corpus(4, 200)
    rows = rows + rows[::3] + rows[::3] + [(None, t) for _, t in rows[::7]] + [(None, "no id"), (None, "no id"), (None, None), (10_000, "")]
    best = {}
    for d, t in rows:
        best[t or ""] = max(best.get(t or "", -1), -1 if d is None else d)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = exact_dedup.drop_exact(spark.createDataFrame(rows, DOCS), counters).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in got) == sorted((d, t) for t, d in best.items())


def test_exact_odd_inputs(spark):
    odd = spark.createDataFrame([(1, "t", *"abcd", 1, 2, 3), (1, "t", *"abcd", 1, 2, 3), (None, "t", *"abcd", 1, 2, 3), (None, "u", *"abcd", 1, 2, 3)], ODD)
    got = sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in exact_dedup.group_exact(odd).collect())
    assert got == [(-1, -1, 1, True), (-1, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True)]
    kept = exact_dedup.drop_exact(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id or -1, r._id) for r in kept.collect()) == [(-1, "d"), (1, "d")]
    empty = spark.createDataFrame([], DOCS)
    assert exact_dedup.group_exact(empty).isEmpty() and exact_dedup.drop_exact(empty).isEmpty()


@pytest.mark.parametrize("k", [2, 5])
def test_near_groups(spark, k):
    rows = corpus(2)
    got = near_dedup.near_groups(spark.createDataFrame(rows, DOCS), k=k).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near(rows, k, 80) and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_family_whose_members_differ(spark, monkeypatch):
    """A base text and edits of it: many members link only through others, and blocks are tiny."""
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 300)
    rnd = random.Random(7)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(60):
        w = list(base)
        for j in rnd.sample(range(80), rnd.randrange(0, 14)):
            w[j] = f"e{rnd.randrange(10_000)}"
        rows.append((1000 - i, " ".join(w)))
    got = near_dedup.near_groups(spark.createDataFrame(rows, DOCS), k=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near(rows, 2, 80)


def test_near_odd_inputs(spark):
    text = "a b c d e f g h"
    odd = spark.createDataFrame([(5, text, *"abcd", 1, 2, 3), (5, "other words here now", *"abcd", 1, 2, 3), (None, text, *"abcd", 1, 2, 3), (7, text, *"abcd", 1, 2, 3)], ODD)
    got = sorted(((r.doc_id or -1), (r.component_id or -1), r.kept) for r in near_dedup.near_groups(odd).collect())
    assert got == [(-1, -1, True), (5, 5, True), (5, 5, True), (7, 5, False)]
    assert sorted(r.doc_id or -1 for r in near_dedup.drop_near(odd).collect()) == [-1, 5, 5]
    assert near_dedup.near_groups(spark.createDataFrame([], DOCS)).isEmpty()


@pytest.mark.parametrize("length", [50, 20])
def test_repeated_strings(spark, length, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH", 64)
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 4000)
    rows = corpus(3) + [(20_000, "ab" * 200), (20_001, "x" + "ab" * 100), (20_002, "é" * 60), (20_003, "é" * 40 + "z")]
    got = suffix_dedup.drop_repeats(spark.createDataFrame(rows, DOCS).repartition(3), length).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == repeats(rows, length)


def test_repeated_strings_odd_inputs(spark):
    text = "a passage that is surely longer than fifty bytes, twice over and more"
    odd = spark.createDataFrame([(3, text, *"abcd", 1, 2, 3), (3, text, *"abcd", 1, 2, 3), (None, text, *"abcd", 1, 2, 3), (9, text + "!", *"abcd", 1, 2, 3)], ODD)
    got = sorted((r.doc_id or -1, r.n_removed) for r in suffix_dedup.drop_repeats(odd).collect())
    assert got == [(-1, len(text)), (3, 0), (3, 0), (9, len(text))]
    alone = spark.createDataFrame([(None, text), (None, text)], DOCS)
    assert [r.n_removed for r in suffix_dedup.drop_repeats(alone).collect()] == [0, 0]
    assert suffix_dedup.drop_repeats(spark.createDataFrame([], DOCS)).isEmpty()


def test_levels_grow_geometrically():
    import numpy as np

    levels, rnd = suffix_dedup.Levels(), np.random.default_rng(1)
    seen = {}
    for doc in range(40):
        p, c = (rnd.integers(0, 50, 30).astype(np.uint64) for _ in range(2))
        levels.add(p, c, np.full(30, doc))
        for x in zip(p.tolist(), c.tolist(), strict=True):
            seen.setdefault(x, doc)
    sizes = [len(x[0]) for x in levels.held]
    assert all(a > 2 * b for a, b in zip(sizes[:-1], sizes[1:], strict=True)) and len(sizes) < 9
    p, c = (rnd.integers(0, 60, 500).astype(np.uint64) for _ in range(2))
    want = [seen.get(x, suffix_dedup.LAST) for x in zip(p.tolist(), c.tolist(), strict=True)]
    assert levels.scan(p, c).tolist() == want


def test_short_texts_have_no_repeated_strings(spark):
    """Parts none of whose texts is as long as a string."""
    rows = [(1, "short"), (2, "short"), (3, None), (4, "")]
    got = suffix_dedup.drop_repeats(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == repeats(rows, 50)


def test_anchors_follow_the_bytes_of_each_string():
    """Equal strings have equal anchors wherever they stand, and every string inside a text has one."""
    import numpy as np

    rnd = random.Random(5)
    texts = [prose(rnd, rnd.randrange(0, 60), 3).encode() for _ in range(60)] + [b"", b"a" * 49, b"a" * 50, b"ab" * 90]
    texts.append(rnd.randbytes(suffix_dedup.STRINGS) + texts[0] * 3 + b"ab" * 90)  # more than is hashed at a time
    starts = np.cumsum([0] + [len(t) for t in texts])
    key, text, begin, end = (x.tolist() for x in suffix_dedup.anchors(np.frombuffer(b"".join(texts), np.uint8), starts, 50))
    seen, whole = {}, set()
    for k, t, a, b in zip(key, text, begin, end, strict=True):
        assert starts[t] <= a and b <= starts[t + 1]
        for i in range(a, b - 49):
            assert seen.setdefault(texts[t][i - starts[t] : i - starts[t] + 50], k) == k and (t, i) not in whole
            whole.add((t, i))
    assert whole == {(t, i) for t in range(len(texts)) for i in range(starts[t], starts[t + 1] - 49)}


def test_levels_meet_batches_in_order_of_docs():
    """What a level holds keeps its first document and is held once."""
    import numpy as np

    levels, rnd, seen = suffix_dedup.Levels(), np.random.default_rng(2), {}
    for doc in [*range(0, 60, 2), suffix_dedup.LAST]:
        p, c = (rnd.integers(0, 30, 40).astype(np.uint64) for _ in range(2))
        pairs = list(zip(p.tolist(), c.tolist(), strict=True))
        for x in pairs:
            seen.setdefault(x, doc)
        assert levels.meet(p, c, np.full(40, doc)).tolist() == [seen[x] for x in pairs]
    assert sum(len(x[0]) for x in levels.held) == len(seen)


def test_copied_contexts_are_indexed_once(monkeypatch):
    """The strings that are named follow the different contexts, not their copies."""
    import numpy as np

    class Rows(list):
        def mapInArrow(self, run, schema):
            return Rows(run(iter(self)))

        def repartitionById(self, *_):
            return self

    rnd = random.Random(6)
    passage, parts, named = prose(rnd, 100).encode(), [], []
    for doc in range(30):
        text = passage + prose(rnd, 5, 10**9).encode()
        grams = suffix_dedup.anchors(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
        mask = [{"shard": 0, "mask": np.packbits(np.ones(len(grams), bool)).tobytes()}]
        row = (doc, np.int64(100 - doc).tobytes(), b"\x01", text, np.int64(len(text)).tobytes(), mask)
        names = ("part", "docs", "known", "text", "ends", "masks")
        parts.append(pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names))
    plain = suffix_dedup._suffixes
    monkeypatch.setattr(suffix_dedup, "_suffixes", lambda *a: (named.append(len((out := plain(*a))[0])), out)[1])
    found = suffix_dedup._earlier(suffix_dedup._contexts(Rows(parts), 1, 50), 1, 50)
    runs = {r["part"]: np.frombuffer(r["runs"], suffix_dedup.RUN) for b in found for r in b.to_pylist()}
    assert sum(named) < len(passage) + 30 * 150
    for doc in range(29):  # the last part has the smallest document
        gone = np.zeros(len(passage), bool)
        for a, b in runs[doc].tolist():
            gone[a:b] = True
        assert gone.all()
    assert 29 not in runs

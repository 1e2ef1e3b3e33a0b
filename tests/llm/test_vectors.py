"""Operators over embeddings, against plain answers."""

import math
from fractions import Fraction

import numpy as np
import pytest
from conftest import SF_SMALL

from eventloom.llm import hard_negatives, whitening
from eventloom.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<float>"


def plain_whitening(vectors, width=16):
    """(ids, n, deviations, whitened up to sign, shares) by a double eigensolver over the distinct codes."""
    x = np.floor(64 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    c = fit - sums / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1][:width], q[:, ::-1][:, :width]
    return n, ((n * x.astype(object) - sums) ** 2).sum(axis=1), (x - sums / n) @ q / np.sqrt(e), e / (c**2).mean(axis=0).sum()


def check_whitening(rows, got, width=16):
    n, deviation, white, share = plain_whitening([v for _, v in rows], width)
    mine = {(r.vec_id, r.component): r for r in got}
    assert len(mine) == len(got) == len(rows) * width and {r.n for r in got} == {n}
    w = np.array([[mine[i, k + 1].whitened for k in range(width)] for i, _ in rows])
    assert np.abs(w * np.sign((w * white).sum(axis=0)) - white).max() < 1e-8
    assert [mine[i, 1].deviation for i, _ in rows] == deviation.tolist()
    assert np.allclose([mine[rows[0][0], k + 1].explained for k in range(width)], share, rtol=1e-9)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_whitening_of_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    check_whitening(rows, QUERIES["op13_embedding_whitening"](spark, SF_SMALL).collect())


def test_whitening_odd_rows(spark):
    rnd = np.random.default_rng(3)
    good = [(i, v) for i, v in enumerate(rnd.normal(size=(40, 5)).round(3).tolist())]
    good += [(100, good[0][1]), (101, good[0][1])]  # copies count once in the fit
    bad = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [float("nan")] * 5), (203, [float("inf")] + [0.0] * 4), (204, [1e30] * 5)]
    short = [(300, [1.5]), (301, [])]
    df = spark.createDataFrame([(*r, "x", 1) for r in good + bad + short], VECTORS + ", component string, n int")
    got = whitening.whiten(df, components=3).collect()
    check_whitening(good + [(300, [1.5, 0, 0, 0, 0]), (301, [0.0] * 5)], got, 3)


def test_whitening_without_spread(spark):
    same = [(i, [1.0, 2.0]) for i in range(5)]
    for rows in ([], same, [(1, []), (2, None)]):
        assert whitening.whiten(spark.createDataFrame(rows, VECTORS)).isEmpty()
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)] + [(None, [0.5, 1.0, 0.0])], VECTORS)
    got = whitening.whiten(line).collect()  # rank one: one component
    assert {r.component for r in got} == {1} and len(got) == 10 and abs(got[0].explained - 1) < 1e-9


def test_equal_eigenvalues(spark):
    rows = [(i, [float(s * (j == i % 4)) for j in range(4)]) for s in (1, -1) for i in range(4 if s > 0 else 0, 4 if s > 0 else 8)]
    corners = [(i, [float((i >> j) & 1) for j in range(4)]) for i in range(16)]
    for case in (corners, rows):
        got = whitening.whiten(spark.createDataFrame(case, VECTORS)).collect()
        assert got[0].identity_error < 1e-9 and {r.component for r in got} <= {1, 2, 3, 4}


@pytest.mark.parametrize("seed", range(4))
def test_characteristic_polynomial(spark, seed):
    rnd = np.random.default_rng(seed)
    x = rnd.integers(-(10**seed), 10**seed + 1, (7, 6 - seed))
    a = (x.T @ x).astype(object)
    d = len(a)
    poly = whitening.characteristic(spark, a.tolist())
    # Faddeev and LeVerrier, in fractions
    c, m = [Fraction(1)], np.zeros((d, d), dtype=object)
    eye = np.eye(d, dtype=int).astype(object)
    for k in range(1, d + 1):
        m = a @ m + eye * c[-1]
        c.append(-sum((a @ m)[i, i] for i in range(d)) / Fraction(k))
    assert poly == [int(v) for v in c[::-1]]
    roots = [float(r) for r, k in whitening.largest_roots(poly, d) for _ in range(k)]
    assert np.allclose(roots, [v for v in np.linalg.eigvalsh(a.astype(float))[::-1] if v > 1e-9 * roots[0]], rtol=1e-9)


def test_products_of_large_numbers():
    rnd = np.random.default_rng(1)
    for top in (2**10, 2**30, 2**46):
        x = rnd.integers(-top, top + 1, (50, 3))
        assert (whitening._products(x) == x.astype(object).T @ x.astype(object)).all()


def plain_negatives(rows, anchors, positives=5, negatives=10, low=30, high=90):
    """Sorted result rows of (vec_id, vector, label) lists."""
    def coded(some):
        fine = lambda v: v is not None and all(c is not None and math.isfinite(c) and abs(256 * c) < 2**22 for c in v)
        return [(i, [math.floor(256 * float(np.float32(c))) for c in v], y) for i, v, y in some if i is not None and y is not None and fine(v)]

    rows, best, out = coded(rows), {}, []
    for i, x, y in coded(anchors):
        best[i] = min(best.get(i, (y, x)), (y, x))
    for a, (label, x) in best.items():
        scored = sorted((-sum(p * q for p, q in zip(x, v)), i, y) for i, v, y in rows)
        near = [(-s, i) for s, i, y in scored if y == label and i != a][:positives]
        for p, positive in near:
            window = [(-s, i) for s, i, y in scored if y != label and low * p <= -100 * s <= high * p]
            out += [(a, positive, n + 1, i, p, s) for n, (s, i) in enumerate(window[:negatives])]
    return sorted(out)


@pytest.mark.parametrize("entries, seed", [(1 << 20, 1), (64, 2), (16, 3)])
def test_hard_negatives(spark, monkeypatch, entries, seed):
    monkeypatch.setattr(hard_negatives, "ENTRIES", entries)  # many tiles
    monkeypatch.setattr(hard_negatives, "SCORES", 40)
    rnd = np.random.default_rng(seed)
    rows = [(i, v, int(rnd.integers(0, 3))) for i, v in enumerate((rnd.integers(-3, 4, (120, 3)) / 4).tolist())]  # many ties
    rows += [(500 + i, rows[0][1], int(i % 2)) for i in range(60)]  # a vector with many copies
    rows += [(7, [0.5, 0.5, 0.5], 1), rows[9], (None, [1.0, 1.0, 1.0], 0), (900, None, 0), (901, [1.0, None, 1.0], 0), (902, [1.0, 1.0, 1.0], None)]
    rows += [(903, [float("nan"), 1.0, 1.0], 0), (904, [float("inf"), 1.0, 1.0], 0), (905, [1e20, 1.0, 1.0], 0), (906, [1.5], 2), (907, [], 1)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, score int, slot int")
    asked = [r for r in rows if r[0] is not None and (r[0] % 10 == 0 or r[0] in (7, 901, 902, 906))]
    got = hard_negatives.mine(df.repartition(3), df.filter("vec_id % 10 = 0 or vec_id in (7, 901, 902, 906)"))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, asked)


def test_hard_negatives_of_little(spark):
    df = spark.createDataFrame([(1, [1.0], 0), (2, [1.0], 0)], "vec_id long, embedding array<float>, label int")
    for rows, anchors in ((df, df), (df.limit(0), df), (df, df.limit(0))):
        assert hard_negatives.mine(rows, anchors).isEmpty()


def test_scores_beyond_doubles():
    x = np.array([[2.0**22, 3.0], [1.0, -(2.0**22)]] * 2)
    big = np.hstack([x] * 300)
    assert (hard_negatives._scores(big, big) == big.astype(np.int64) @ big.astype(np.int64).T).all()

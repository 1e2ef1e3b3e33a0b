"""Whitening of embeddings from the exact characteristic polynomial of their integer scatter.

Components are coded as whole numbers, so counts, sums and the scatter matrix
are exact.  One pass over the distinct vectors gives their number and sums, a
second, centred one the products.  The characteristic polynomial of the scatter
follows by Hessenberg reduction modulo many primes (one Spark row each) and
Chinese remaindering.  Its roots are all real, so the sign changes of a Taylor
shift count the roots beyond a point exactly: bisection isolates the largest
ones.  Inverse iteration in high precision gives each root's null space, and a
last pass projects every row.

Only the d x d scatter and one residue row per prime reach the driver; both
depend on the dimension d of the vectors, not on the number of rows.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from fractions import Fraction
from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import written

#: Codes beyond this size would not be exact in a double.
LARGEST = 2.0**46
#: Roots closer than this share of the largest one count as one root of higher multiplicity.
SAME = Fraction(1, 2**160)
DIGITS = 160


def codes(vector: Column, scale: int, shift: int) -> Column:
    """floor(scale * c) + shift of every entry; null where the vector or an entry is null, not finite or beyond 2**46."""
    fine = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False)))
    whole = F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long") + F.lit(shift))
    return F.when(fine, whole)


def _matrix(column: pa.Array) -> np.ndarray:
    """Equally long lists of whole numbers as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _limbs(rows: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Digits of base 2**20 whose weighted sum is `rows`, as doubles: products of two and sums of 8,192 of those are exact."""
    out, at = [], 0
    while at == 0 or rows.any():
        low = rows & 0xFFFFF
        out.append((at, low.astype(np.float64)))
        rows, at = (rows - low) >> 20, at + 20
        if at == 40:  # what is left carries the sign
            out.append((at, rows.astype(np.float64)))
            break
    return out


def _products(rows: np.ndarray) -> np.ndarray:
    """rows.T @ rows over whole numbers of any size, exactly."""
    total = np.zeros((rows.shape[1],) * 2, dtype=object)
    for at in range(0, len(rows), 8192):
        part = rows[at : at + 8192]
        if np.abs(part).max(initial=0) < 2**20:
            digits = [(0, part.astype(np.float64))]
        else:
            digits = _limbs(part)
        for i, x in digits:
            for j, y in digits:
                total += (x.T @ y).astype(np.int64).astype(object) * (1 << (i + j))
    return total


def moments(fit: DataFrame, middle: list[int] | None) -> tuple[int, list[int], list[list[int]] | None]:
    """(rows, sums, products): sums of `x`; with a `middle`, sums and products of x - middle.  One row per task and entry is exchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, 0, 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0)) - np.array(middle or [0], dtype=np.int64)
                n += len(x)
                sums = sums + x.astype(object).sum(axis=0) if np.abs(x).max() > 2**40 else sums + x.sum(axis=0).astype(object)
                products = products + _products(x) if middle else 0
        if n:
            i, j, value = [-1], [-1], [n]
            for a, s in enumerate(sums):
                i, j, value = [*i, a], [*j, -1], [*value, s]
                row = products[a][: a + 1] if middle else []
                i, j, value = i + [a] * len(row), j + list(range(len(row))), [*value, *row]
            texts = [str(int(v)) for v in value]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(texts)], ["i", "j", "value"])

    parts = fit.mapInArrow(run, "i int, j int, value string")
    got = {(r.i, r.j): int(r.value) for r in parts.groupBy("i", "j").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()}
    d = max((i for i, _ in got), default=-1) + 1
    products = [[got[max(a, b), min(a, b)] for b in range(d)] for a in range(d)] if middle else None
    return got.get((-1, -1), 0), [got[a, -1] for a in range(d)], products


# --- characteristic polynomial ---------------------------------------------------


def _primes(bits: int) -> list[int]:
    """Primes below 2**31, the largest first, whose product has more than `bits` bits."""
    small = np.ones(46_342, dtype=bool)
    small[:2] = False
    for p in range(2, 216):
        if small[p]:
            small[p * p :: p] = False
    divisors, found, have, top = np.flatnonzero(small), [], 0.0, 2**31
    while have <= bits:
        block = np.arange(top - 4096, top)
        whole = np.ones(4096, dtype=bool)
        for p in divisors:
            whole[-(top - 4096) % p :: p] = False
        for q in block[whole][::-1].tolist():
            found.append(q)
            have += 30.9
        top -= 4096
    return found


def _residue(scatter: list[list[int]], p: int) -> list[int]:
    """Coefficients of det(x - scatter) modulo p, constant term first, by Hessenberg reduction."""
    h = np.array([[v % p for v in row] for row in scatter], dtype=np.int64)
    d = len(h)
    for k in range(d - 2):
        nonzero = np.flatnonzero(h[k + 1 :, k])
        if not len(nonzero):
            continue
        pivot = k + 1 + nonzero[0]
        h[[k + 1, pivot]], h[:, [k + 1, pivot]] = h[[pivot, k + 1]], h[:, [pivot, k + 1]]
        factor = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - factor[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * factor % p).sum(axis=1)) % p
    # leading minors of x - h, by expansion along the last column
    minors = [np.array([1], dtype=np.int64)]
    for k in range(d):
        new = np.concatenate([[0], minors[k]])
        new[:-1] -= h[k, k] * minors[k] % p
        below = 1
        for i in range(k - 1, -1, -1):
            below = below * int(h[i + 1, i]) % p
            new[: i + 1] -= int(h[i, k]) * below % p * minors[i] % p
        minors.append(new % p)
    return minors[d].tolist()


def characteristic(spark, scatter: list[list[int]]) -> list[int]:
    """Coefficients of det(x - scatter), constant term first, of a positive semidefinite whole-number matrix."""
    d = len(scatter)
    mean = -(-sum(scatter[i][i] for i in range(d)) // d) + 1
    # elementary symmetric means fall: the k-th coefficient is at most comb(d, k) * mean ** k
    primes = _primes(2 + max((comb(d, k) * mean**k).bit_length() for k in range(d + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_residue(scatter, p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["p", "residue"])

    tasks = min(len(primes), spark.sparkContext.defaultParallelism)
    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks, "p").mapInArrow(run, "p long, residue array<long>")
    product, value = 1, [0] * (d + 1)
    for p, residue in rows.collect():
        inverse = pow(product, -1, p)
        value = [v + product * ((r - v) * inverse % p) for v, r in zip(value, residue, strict=True)]
        product *= p
    return [v - product if 2 * v > product else v for v in value]


# --- its largest roots ---------------------------------------------------------------


def _beyond(poly: list[int], at: int, bits: int) -> int:
    """How many roots, by multiplicity, lie beyond at / 2**bits: all are real, so it is the sign changes of the shifted polynomial."""
    d = len(poly) - 1
    c = [v << bits * (d - k) for k, v in enumerate(poly)]
    for k in range(d):
        for i in range(d - 1, k - 1, -1):
            c[i] += at * c[i + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs[:-1], signs[1:], strict=True))


def largest_roots(poly: list[int], wanted: int) -> list[tuple[Fraction, int]]:
    """The largest positive roots with their multiplicities, largest first, until `wanted` are there.

    Each is within 2**-64 of its distance to the next one, and of its own size.
    """
    d = len(poly) - 1
    positive = d - next(k for k, v in enumerate(poly) if v)
    top = 1 << max(1, (-poly[d - 1]).bit_length()) if d else 1
    found: list[tuple[int, int, int, int]] = []  # low, high, bits, roots in (low, high]
    work = [(0, top, 0, positive, 0)]
    have = 0
    while work and have < wanted:
        low, high, bits, above_low, above_high = work.pop()
        n = above_low - above_high
        if not n:
            continue
        if (n == 1 and low) or Fraction(high - low, 1 << bits) < SAME * top:
            found.append((low, high, bits, n))
            have += n
            continue
        low, high, bits = 2 * low, 2 * high, bits + 1
        middle = (low + high) // 2
        above = _beyond(poly, middle, bits)
        work += [(low, middle, bits, above_low, above), (middle, high, bits, above, above_high)]
    edge = max((Fraction(h, 1 << b) for _, h, b, a, c in work if a > c), default=Fraction(0))
    out = []
    for i, (low, high, bits, n) in enumerate(found):
        after = Fraction(found[i + 1][1], 1 << found[i + 1][2]) if i + 1 < len(found) else edge
        before = Fraction(found[i - 1][0], 1 << found[i - 1][2]) if i else None
        above = _beyond(poly, high, bits)
        while n == 1:
            lo, hi = Fraction(low, 1 << bits), Fraction(high, 1 << bits)
            gap = lo - after if before is None else min(lo - after, before - hi)
            if (hi - lo) * (1 << 64) <= gap or hi - lo < SAME * top:
                break
            low, high, bits = 2 * low, 2 * high, bits + 1
            middle = (low + high) // 2
            if _beyond(poly, middle, bits) > above:
                low = middle
            else:
                high = middle
        out.append((Fraction(low + high, 2 << bits), n))
    return out


# --- and their null spaces -----------------------------------------------------------


def null_space(scatter: list[list[int]], root: Fraction, n: int) -> np.ndarray:
    """An orthonormal basis (as columns, doubles) of the `n` directions the scatter stretches by `root`."""
    with decimal.localcontext(decimal.Context(prec=DIGITS)):
        of = np.vectorize(decimal.Decimal, otypes=[object])
        shift = decimal.Decimal(root.numerator) / decimal.Decimal(root.denominator)
        d = len(scatter)
        a = of(np.array(scatter, dtype=object)) - of(np.eye(d, dtype=int).astype(object)) * shift
        tiny = shift * decimal.Decimal(10) ** (8 - DIGITS)
        order = np.arange(d)
        for k in range(d):  # a becomes its own LU, rows in `order`
            pivot = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
            a[[k, pivot]], order[[k, pivot]] = a[[pivot, k]], order[[pivot, k]]
            if not abs(a[k, k]) > tiny:
                a[k, k] = tiny
            a[k + 1 :, k] /= a[k, k]
            a[k + 1 :, k + 1 :] -= a[k + 1 :, k, None] * a[k, None, k + 1 :]
        x = of(np.random.default_rng(7).integers(-999, 1000, (d, n)).astype(object))
        for _ in range(4):
            x = x[order]
            for k in range(1, d):
                x[k] -= a[k, :k] @ x[:k]
            for k in range(d - 1, -1, -1):
                x[k] = (x[k] - a[k, k + 1 :] @ x[k + 1 :]) / a[k, k] if k < d - 1 else x[k] / a[k, k]
            for _ in range(2):  # Gram-Schmidt, twice for close columns
                for c in range(n):
                    for b in range(c):
                        x[:, c] -= x[:, b] * (x[:, b] @ x[:, c])
                    x[:, c] /= (x[:, c] @ x[:, c]).sqrt()
        out = x.astype(np.float64)
    return out * np.where(out[np.abs(out).argmax(axis=0), np.arange(n)] < 0, -1.0, 1.0)


def _root(value: Fraction) -> float:
    """Square root of a fraction, correct to a double."""
    bits = max(0, 128 - value.numerator.bit_length() + value.denominator.bit_length())
    bits += bits % 2
    return float(Fraction(isqrt((value.numerator << bits) // value.denominator), 1 << bits // 2))


# --- the operator ----------------------------------------------------------------------


def whiten(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16, scale: int = 64, shift: int = 1_000_000
) -> DataFrame:
    """One row per row of `rows` and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Entries c count as x = floor(scale * c) + shift.  The fit goes over the
    distinct x vectors (`n` of them, covariance with divisor n); `whitened` is
    the centred x projected on the component, over the square root of its
    eigenvalue.  `deviation`, the same for a row's components, is the sum of
    (n * x - sum of x)**2, and null where that exceeds a long.

    Rows whose vector is null, or holds a null, a non-finite entry or one beyond
    2**46, take no part and give no row.  Shorter vectors count as ending in
    zeros, an empty one as all zeros.  Components of eigenvalue 0 do not exist
    for whitening, so there are as many as the rank at most, and none (no rows)
    for an empty table or one distinct vector.  Of equal eigenvalues any
    orthonormal directions are components, the same ones for all rows.  Repeated
    rows, null ids and ids in several rows give rows as they are; other columns
    are ignored.
    """
    spark = rows.sparkSession
    coded = rows.select(F.col(key).alias("vec_id"), codes(F.col(vector), scale, 0).alias("x")).filter("x is not null")
    d = coded.agg(F.max(F.size("x"))).head()[0]
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not d:
        return spark.createDataFrame([], schema)
    padded = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.coalesce(F.get("x", i), F.lit(0)) + F.lit(shift))
    coded = coded.select(F.col("vec_id").cast("long").alias("vec_id"), padded.alias("x"))
    fit = written(coded.select("x").distinct(), "fit")

    n, sums, _ = moments(fit, None)
    middle = [(2 * s + n) // (2 * n) for s in sums]
    _, rest, products = moments(fit, middle)
    # n * n * covariance, in whole numbers
    scatter = [[n * products[i][j] - rest[i] * rest[j] for j in range(d)] for i in range(d)]
    trace = sum(scatter[i][i] for i in range(d))
    if not trace:
        return spark.createDataFrame([], schema)
    roots = largest_roots(characteristic(spark, scatter), components)
    basis = np.concatenate([null_space(scatter, root, k) for root, k in roots], axis=1)[:, :components]
    values = [root for root, k in roots for _ in range(k)][:components]
    scaled = basis / np.array([_root(v / (n * n)) for v in values])
    explained = [float(v / trace) for v in values]
    width = len(values)
    middle_of, rest_of = np.array(middle, dtype=np.int64), np.array(rest, dtype=object)
    centre = np.array([float(Fraction(r, n)) for r in rest])

    def project(x: np.ndarray) -> np.ndarray:
        return ((x - middle_of) - centre) @ scaled

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(width), np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                w = project(_matrix(batch.column(0)))
                total += w.sum(axis=0)
                products += w.T @ w
        # the last row holds the sums
        whole = np.vstack([products, total])
        i, j = (g.ravel() for g in np.indices(whole.shape))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(whole.ravel())], ["i", "j", "value"])

    whole = np.zeros((width + 1, width))
    for i, j, value in fit.mapInArrow(cross, "i long, j long, value double").groupBy("i", "j").agg(F.sum("value")).collect():
        whole[i, j] = value / n
    error = float(np.abs(whole[:-1] - np.outer(whole[-1], whole[-1]) - np.eye(width)).max())

    def deviations(x: np.ndarray) -> list[int | None]:
        y = x - middle_of
        if (n + 1) * (int(np.abs(y).max(initial=0)) + 1) < 2**31 // (isqrt(d) + 1):  # rest is n / 2 at most
            return ((n * y - rest_of.astype(np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((n * y.astype(object) - rest_of) ** 2).sum(axis=1)
        return [int(v) if v < 2**63 else None for v in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                x = _matrix(batch.column(1))
                rows = len(x)
                repeat = lambda a: a.take(pa.array(np.repeat(np.arange(rows), width)))
                yield pa.RecordBatch.from_arrays(
                    [
                        repeat(batch.column(0)), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), rows)),
                        pa.array(np.full(rows * width, n)), repeat(pa.array(deviations(x), pa.int64())),
                        pa.array(project(x).ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * width, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return coded.mapInArrow(run, schema)

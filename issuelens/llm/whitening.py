"""Whitening of embeddings by the exact characteristic polynomial of their scatter.

Every entry c becomes the whole number ``floor(256 c)``, so all that follows is exact until
an eigenvector is taken:

1. the fit list holds each distinct vector once (one shuffle, repeats removed before it);
   it is written once, as three jobs read it;
2. scatter, jobs of n rows: ``M = n * sum(x x') - S S'``, whole numbers, which is n * n times
   the covariance. Each task adds up its rows exactly; its sums travel as 32-bit limbs, so
   their number depends on the dimensions alone;
3. characteristic polynomial of M: modulo a prime the matrix is brought to Hessenberg form
   and its polynomial read off by recurrence; as many primes as the coefficients can be
   long, worked on by separate tasks; remainders are joined by the Chinese remainder
   theorem, a task for each coefficient;
4. its roots, largest first: all roots are real, so the number of roots above a is exactly
   the number of sign changes of p(x + a). Bisection on that count isolates a root, with its
   multiplicity, to ``BITS`` bits;
5. components: inverse iteration towards the null space of M - root, with ``DIGITS`` decimal
   digits; roots that agree to all bits share one orthonormal basis;
6. rows are projected by Arrow batches; the covariance of the whitened fit list is measured.

The driver holds d x d numbers and d + 1 coefficients (d dimensions), none that grow with rows.

Defined results: rows whose vector is null, empty, or holds a null or non-finite entry are
left out, and so are rows whose vector is not as long as most of the fit list (ties: the
shorter). Repeated rows count once in the fit and are returned each. Components without
variance (root 0) cannot be whitened and are left out; so one distinct vector, or an empty
table, gives no rows. A root's sign of the vector is chosen so that its largest entry is
positive. Other columns stay in ``row`` and clash with nothing. Entries beyond 2 ** 55
saturate at the ends of a long. ``deviation`` is exact up to 38 digits, null beyond.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal, localcontext
from fractions import Fraction
from math import comb
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from issuelens.llm.common import keep_row, land, settled

BITS = 96  # of a root, relative
DIGITS = 90  # of the inverse iteration
ROUNDS = 4  # of the inverse iteration
LIMB = 32
PRIMES_FROM = (1 << 31) - 1


class Whitening(NamedTuple):
    """n vectors of the fit list, their sums, the largest roots of M, unit vectors beside them, trace of M."""

    n: int
    sums: list[int]
    roots: list[Fraction]
    vectors: np.ndarray
    trace: int


def grid(vector: Column) -> Column:
    """The whole numbers of a vector; null if it is null, empty, or has an entry without a number."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return F.when((F.size(vector) > 0) & ~bad, F.transform(vector, lambda c: F.floor(256 * c.cast("double"))))


# Scatter

def _product(x: np.ndarray) -> np.ndarray:
    """x' x of whole numbers, exactly, as Python integers."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    out = np.zeros((x.shape[1], x.shape[1]), object)
    if most * most < 1 << 53:  # sums below 2 ** 53 are exact in doubles
        rows = max(1, min(len(x), ((1 << 53) - 1) // max(1, most * most)))
        for k in range(0, len(x), rows):
            part = x[k:k + rows].astype(np.float64)
            out += (part.T @ part).astype(np.int64).astype(object)
        return out
    wide = x.astype(object)
    return out + wide.T @ wide


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    sign, value, k = (-1, -value, 0) if value < 0 else (1, value, 0)
    while value:
        if part := value & ((1 << LIMB) - 1):
            yield k, sign * part
        value >>= LIMB
        k += 1


def scatter(fit_list: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """n, sums S and M = n * sum(x x') - S S' of the rows of column ``x``, exactly."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((d + 1, d + 1), object)  # the last row and column: sums and count
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            gram[:d, :d] += _product(x)
            total = x.astype(object).sum(axis=0) if np.abs(x.astype(np.float64)).sum() >= 2.0 ** 62 else x.sum(axis=0).astype(object)
            gram[d, :d] += total
            gram[d, d] += len(x)
        cells = [(i * (d + 1) + j, k, v) for i in range(d + 1) for j in range(i + 1) for k, v in _limbs(int(gram[i, j]))]
        cell, limb, value = zip(*cells) if cells else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(limb, pa.int32()), pa.array(value, pa.int64())],
                                         names=["cell", "limb", "value"])

    parts = fit_list.select("x").mapInArrow(partial, "cell int, limb int, value bigint")
    gram = np.zeros((d + 1, d + 1), object)
    for r in parts.groupBy("cell", "limb").agg(F.sum("value").alias("value")).collect():
        gram[r.cell // (d + 1), r.cell % (d + 1)] += r.value << (LIMB * r.limb)
    n, sums = int(gram[d, d]), [int(v) for v in gram[d, :d]]
    m = np.zeros((d, d), object)
    for i in range(d):
        for j in range(i + 1):
            m[i, j] = m[j, i] = n * int(gram[i, j]) - sums[i] * sums[j]
    return n, sums, m


# Characteristic polynomial

def primes(count: int) -> list[int]:
    """The largest ``count`` primes below 2 ** 31."""
    root = int(PRIMES_FROM ** 0.5) + 1
    sieve = np.ones(root + 1, bool)
    sieve[:2] = False
    for k in range(2, int(root ** 0.5) + 1):
        if sieve[k]:
            sieve[k * k::k] = False
    small, out, at = np.flatnonzero(sieve), [], PRIMES_FROM
    while len(out) < count:
        if (at % small).all():
            out.append(at)
        at -= 2
    return out


def polynomial_mod(m: np.ndarray, p: int) -> list[int]:
    """Coefficients (of 1, x, x ** 2 ...) of det(x - m) modulo the prime p, by Hessenberg reduction."""
    d = len(m)
    h = (m % p).astype(np.int64)
    for c in range(d - 2):
        below = np.flatnonzero(h[c + 1:, c])
        if not len(below):
            continue
        pivot = c + 1 + int(below[0])
        if pivot != c + 1:
            h[[pivot, c + 1]] = h[[c + 1, pivot]]
            h[:, [pivot, c + 1]] = h[:, [c + 1, pivot]]
        by = h[c + 2:, c] * pow(int(h[c + 1, c]), -1, p) % p
        h[c + 2:] = (h[c + 2:] - by[:, None] * h[c + 1] % p) % p
        h[:, c + 1] = (h[:, c + 1] + (h[:, c + 2:] * by % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)  # polynomials of the leading blocks
    polys[0, 0] = 1
    for k in range(1, d + 1):
        now = np.zeros(d + 1, np.int64)
        now[1:] = polys[k - 1, :-1]
        now = (now - h[k - 1, k - 1] * polys[k - 1]) % p
        chain = 1
        for i in range(k - 1, 0, -1):
            chain = chain * int(h[i, i - 1]) % p
            if not chain:
                break
            now = (now - int(h[i - 1, k - 1]) * chain % p * polys[i - 1]) % p
        polys[k] = now
    return polys[d].tolist()


def joined(residues: list[int], moduli: list[int]) -> int:
    """The whole number of least size with these remainders."""
    x, m = 0, 1
    for r, p in zip(residues, moduli):
        x += m * ((r - x) * pow(m, -1, p) % p)
        m *= p
    return x - m if 2 * x > m else x


def characteristic_polynomial(spark: SparkSession, m: np.ndarray) -> list[int]:
    """Coefficients (of 1, x, x ** 2 ...) of det(x - m), for a matrix of whole numbers without negative roots.

    With no root negative, coefficient d - k is at most C(d, k) * (trace / d) ** k in size.
    """
    d = len(m)
    mean = -(-int(np.trace(m)) // d)
    bits = max((comb(d, k) * mean ** k).bit_length() for k in range(d + 1)) + 2
    moduli = primes(-(-bits // 30))  # each is over 2 ** 30

    def reduced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p in f["p"].tolist():
                yield pd.DataFrame({"k": np.arange(d + 1, dtype=np.int32), "p": p, "r": polynomial_mod(m, p)})

    def whole(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": f["k"].iloc[:1], "c": [str(joined(f["r"].tolist(), f["p"].tolist()))]})

    tasks = max(1, min(len(moduli), 2 * spark.sparkContext.defaultParallelism))
    found = (spark.range(len(moduli), numPartitions=tasks)
             .select(F.get(F.lit(moduli), F.col("id").cast("int")).cast("long").alias("p"))
             .mapInPandas(reduced, "k int, p long, r long").groupBy("k").applyInPandas(whole, "k int, c string"))
    return [int(r.c) for r in sorted(found.collect())]


# Roots

def roots_above(poly: list[int], numerator: int, scale: int) -> int:
    """Roots over numerator / 2 ** scale, with multiplicity, of a polynomial that has real roots only."""
    d = len(poly) - 1
    c = [v << (scale * (d - k)) for k, v in enumerate(poly)]
    for i in range(d):  # c becomes the polynomial of x + numerator
        for k in range(d - 1, i - 1, -1):
            c[k] += numerator * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def largest_roots(poly: list[int], count: int, bound: int, bits: int = BITS) -> list[tuple[Fraction, Fraction]]:
    """Intervals (low, high] of the ``count`` largest positive roots, repeated ones repeated, each to ``bits`` bits.

    Equal roots give equal intervals. No root may be above ``bound``.
    """
    out: list[tuple[Fraction, Fraction]] = []
    for k in range(1, min(count, roots_above(poly, 0, 0)) + 1):
        if out and roots_above(poly, out[-1][0].numerator, out[-1][0].denominator.bit_length() - 1) >= k:
            out.append(out[-1])
            continue
        low, high, scale = 0, bound, 0
        while True:
            if high - low == 1:
                if low and low.bit_length() > bits:
                    break
                step = 1 if not low else max(1, bits + 1 - low.bit_length())
                low, high, scale = low << step, high << step, scale + step
            middle = (low + high) // 2
            if roots_above(poly, middle, scale) >= k:
                low = middle
            else:
                high = middle
        out.append((Fraction(low, 1 << scale), Fraction(high, 1 << scale)))
    return out


# Components

def null_vectors(m: np.ndarray, root: Fraction, count: int) -> np.ndarray:
    """``count`` orthonormal vectors (rows) of m for this root, by inverse iteration."""
    d = len(m)
    with localcontext() as context:
        context.prec = DIGITS
        number = lambda v: Decimal(int(v))
        a = np.array([[number(v) for v in row] for row in m], object).reshape(d, d)
        a[np.arange(d), np.arange(d)] -= Decimal(root.numerator) / Decimal(root.denominator)
        tiny = max(Decimal(1), max(abs(v) for v in a.ravel())) * Decimal(10) ** (-DIGITS)
        order = list(range(d))
        for c in range(d):
            pivot = max(range(c, d), key=lambda r: abs(a[r, c]))
            if pivot != c:
                a[[pivot, c]] = a[[c, pivot]]
                order[c], order[pivot] = order[pivot], order[c]
            if abs(a[c, c]) < tiny:
                a[c, c] = tiny
            by = a[c + 1:, c] / a[c, c]
            a[c + 1:, c + 1:] -= by[:, None] * a[c, c + 1:]
            a[c + 1:, c] = by
        # A start that no eigenvector of ordinary data is orthogonal to; each vector its own.
        v = np.array([[Decimal(1) / (1 + (i * (k + 2) + k) % (d + 1 + k)) for i in range(d)] for k in range(count)], object).reshape(count, d)
        for _ in range(ROUNDS):
            y = v[:, order].copy()
            for c in range(d):
                y[:, c] -= y[:, :c] @ a[c, :c] if c else Decimal(0)
            for c in range(d - 1, -1, -1):
                if c < d - 1:
                    y[:, c] -= y[:, c + 1:] @ a[c, c + 1:]
                y[:, c] /= a[c, c]
            for k in range(count):
                for _ in range(2):
                    y[k] /= (y[k] @ y[k]).sqrt()
                    for j in range(k):
                        y[k] -= (y[k] @ y[j]) * y[j]
                y[k] /= (y[k] @ y[k]).sqrt()
            v = y
        out = v.astype(np.float64)
    largest = out[np.arange(count), np.abs(out).argmax(axis=1)]
    return out * np.sign(largest)[:, None]


def fit(vectors: DataFrame, components: int) -> tuple[Whitening | None, DataFrame]:
    """The whitening of column ``x`` (whole numbers), and the fit list; None without vectors."""
    spark = vectors.sparkSession
    fit_list = land(vectors.filter(F.col("x").isNotNull()).select("x").distinct(), "whitening")
    usual = fit_list.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if usual is None:
        return None, fit_list
    fit_list = fit_list.filter(F.size("x") == usual.d)
    n, sums, m = scatter(fit_list, usual.d)
    trace = int(np.trace(m))
    intervals = largest_roots(characteristic_polynomial(spark, m), components, trace) if trace else []
    found, k = [], 0
    while k < len(intervals):
        same = intervals.count(intervals[k])
        found.append(null_vectors(m, sum(intervals[k]) / 2, same))
        k += same
    held = np.concatenate(found) if found else np.zeros((0, usual.d))
    return Whitening(n, sums, [(a + b) / 2 for a, b in intervals], held, trace), fit_list


def projected(x: Column, w: Whitening) -> Column:
    """deviation (digits of the sum over dimensions of (n x - S) ** 2) and whitened components of a vector of whole numbers."""
    n, sums = w.n, w.sums
    weights = (w.vectors / np.sqrt([float(r) for r in w.roots])[:, None]).T if len(w.roots) else w.vectors.T

    @F.pandas_udf("deviation string, w array<double>")
    def of(rows: pd.Series) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"deviation": [], "w": []})
        values = np.stack(rows.to_list()).astype(np.int64)
        most = max(abs(int(values.max())), abs(int(values.min()))) * n + max(map(abs, sums))
        if most * most * len(sums) < 1 << 63:
            centred = values * n - np.array(sums, np.int64)
            squares = (centred * centred).sum(axis=1)
        else:
            centred = values.astype(object) * n - np.array(sums, object)
            squares = (centred * centred).sum(axis=1)
        return pd.DataFrame({"deviation": [str(v) for v in squares.tolist()], "w": list(centred.astype(np.float64) @ weights)})

    return of(x)


def identity_error(fit_list: DataFrame, w: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = len(w.roots)
    done = fit_list.select(projected(F.col("x"), w).alias("p")).select(*[F.get("p.w", F.lit(i)).alias(f"w{i}") for i in range(k)])
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    found = done.agg(*[F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs]).first()
    return max(abs(v - (i == j)) for (i, j), v in zip(pairs, found))


def whiten(vectors: DataFrame, components: int = 4, vector: str = "embedding") -> DataFrame:
    """``row``, ``component`` (from 1), n, deviation, whitened, explained, identity_error: a row for each usable vector and component."""
    rows = keep_row(vectors).withColumn("x", grid(F.col("row")[vector]))
    w, fit_list = fit(rows, components)
    k = len(w.roots) if w else 0
    d = len(w.sums) if w else 0
    error = identity_error(fit_list, w) if k else 0.0
    if not k:
        w = Whitening(0, [0] * d, [], np.zeros((0, d)), 1)
    usable = rows.filter(settled(F.col("x").isNotNull() & (F.size("x") == d))) if k else rows.filter(F.lit(False))
    explained = [float(r / w.trace) for r in w.roots]
    out = usable.select("row", projected(F.col("x"), w).alias("p")).select("row", "p.deviation", F.posexplode("p.w").alias("k", "whitened"))
    return out.select(
        "row", (F.col("k") + 1).cast("int").alias("component"), F.lit(w.n).cast("long").alias("n"),
        F.expr("try_cast(deviation AS DECIMAL(38,0))").alias("deviation"), "whitened",
        F.get(F.lit(explained) if k else F.array(F.lit(0.0)), F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))

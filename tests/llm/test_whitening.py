from fractions import Fraction

import numpy as np
import pytest

from issuelens.llm import queries, whitening as W


def determinant(m):
    """By fractions, without division of whole numbers."""
    m = [[Fraction(int(v)) for v in row] for row in m]
    out = Fraction(1)
    for c in range(len(m)):
        pivot = next((r for r in range(c, len(m)) if m[r][c]), None)
        if pivot is None:
            return Fraction(0)
        if pivot != c:
            m[c], m[pivot], out = m[pivot], m[c], -out
        out *= m[c][c]
        for r in range(c + 1, len(m)):
            by = m[r][c] / m[c][c]
            m[r] = [a - by * b for a, b in zip(m[r], m[c])]
    return out


def scatter_of(x):
    x = x.astype(object)
    s = x.sum(axis=0)
    return len(x) * (x.T @ x) - np.outer(s, s)


def exact(m):
    ps = W.primes(12)
    return [W.joined(list(r), ps) for r in zip(*[W.polynomial_mod(m, p) for p in ps])]


@pytest.mark.parametrize("seed", range(12))
def test_polynomial_roots_and_components(seed):
    rng = np.random.default_rng(seed)
    d = int(rng.integers(1, 7))
    x = rng.integers(-300, 300, (int(rng.integers(2, 15)), d))
    if seed % 3 == 0:
        x[:, -1] = x[:, 0]  # a matrix without full rank
    m = scatter_of(x)
    poly = exact(m)
    for at in (-5, 0, 3, 10 ** 6):
        shifted = np.array([[at * (i == j) - m[i, j] for j in range(d)] for i in range(d)], object)
        assert sum(c * at ** k for k, c in enumerate(poly)) == determinant(shifted)
    intervals = W.largest_roots(poly, 4, int(np.trace(m)))
    assert len(intervals) == min(4, sum(c != 0 for c in poly) and W.roots_above(poly, 0, 0))
    values = np.sort(np.linalg.eigvalsh(m.astype(float)))[::-1]
    for (low, high), v in zip(intervals, values):
        assert low < high and float((high - low) / high) < 2 ** -90 and abs(float(low) - v) <= 1e-9 * values[0]
    for low, high in intervals:
        v = W.null_vectors(m, (low + high) / 2, 1)[0]
        assert abs(v @ v - 1) < 1e-14 and np.abs(m.astype(float) @ v - float(low) * v).max() <= 1e-12 * values[0]


def test_repeated_roots_share_a_basis():
    m = np.diag([7, 7, 7, 2, 0]).astype(object)
    m[0, 1] = m[1, 0] = 0
    intervals = W.largest_roots(exact(m), 4, 23)
    assert intervals[0] == intervals[1] == intervals[2] != intervals[3]
    v = W.null_vectors(m, sum(intervals[0]) / 2, 3)
    assert np.allclose(v @ v.T, np.eye(3), atol=1e-15) and np.abs(v[:, 3:]).max() < 1e-30


def test_products_and_limbs_are_exact():
    rng = np.random.default_rng(1)
    for top in (9, 10 ** 7, 2 ** 55):
        x = rng.integers(-top, top, (50, 3))
        assert (W._product(x) == x.astype(object).T @ x.astype(object)).all()
    for v in (0, 1, -1, 2 ** 200 + 12345, -(2 ** 97)):
        assert sum(part << (W.LIMB * k) for k, part in W._limbs(v)) == v


def vectors():
    rng = np.random.default_rng(7)
    good = [[float(v) for v in row] for row in rng.normal(size=(90, 6)) * [9, 5, 2, 1, .5, .2]]
    odd = [None, [], [1.0, None, 2.0, 3.0, 4.0, 5.0], [float("nan")] * 6, [1.0, 2.0, float("inf"), 0.0, 0.0, 0.0], [1.0, 2.0]]
    return good + odd + good[:20] + [good[0]] * 50


def check(rows, given):
    usable = [(i, np.floor(256 * np.array(v)).astype(np.int64)) for i, v in given]
    fit = np.unique([x for _, x in usable], axis=0)
    n, s = len(fit), fit.sum(axis=0)
    values, basis = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, basis = values[::-1], basis[:, ::-1]
    assert len(rows) == len(usable) * 4
    by = {}
    for r in rows:
        by.setdefault(r.component, []).append(r)
    for k, found in by.items():
        found = sorted(found, key=lambda r: r.vec_id)
        want = (np.array([x for _, x in usable]) - s / n) @ basis[:, k - 1] / np.sqrt(values[k - 1])
        got = np.array([r.whitened for r in found])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-9
        assert [r.deviation for r in found] == [int(((n * x - s) ** 2).sum()) for _, x in usable]
        assert {r.n for r in found} == {n} and abs(found[0].explained - values[k - 1] / values.sum()) < 1e-9
        assert {r.identity_error for r in found} == {found[0].identity_error} and found[0].identity_error < 1e-9


def test_query_against_numpy(spark, tmp_dir):
    given = list(enumerate(vectors()))
    schema = "vec_id long, embedding array<double>, x int, row int, p int"
    spark.createDataFrame([(i, v, 1, 2, 3) for i, v in given], schema).repartition(5).write.parquet(f"{tmp_dir}/embeddings.parquet")
    check(queries.op12_whitened_embeddings(spark, tmp_dir).collect(), [(i, v) for i, v in given if i < 90 or i >= 96])


def test_few_vectors_and_large_entries(spark):
    frame = lambda rows: spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    assert W.whiten(frame([])).count() == 0
    assert W.whiten(frame([None, [1.0, 2.0], [1.0, 2.0]])).count() == 0  # one distinct vector has no variance
    two = W.whiten(frame([[1.0, 2.0], [3.0, 5.0], [3.0, 5.0]])).collect()
    assert [r.component for r in two] == [1, 1, 1] and sorted(round(abs(r.whitened), 12) for r in two) == [1, 1, 1]
    large = W.whiten(frame([[2.0 ** 40, 1.0], [-2.0 ** 41, 2.0], [5.0, 2.0 ** 39]])).collect()
    assert len(large) == 6 and all(r.identity_error < 1e-9 for r in large)
    x = [[2 ** 48, 256], [-2 ** 49, 512], [1280, 2 ** 47]]
    s = [sum(c) for c in zip(*x)]
    assert {int(r.deviation) for r in large} == {sum((3 * a - b) ** 2 for a, b in zip(v, s)) for v in x}

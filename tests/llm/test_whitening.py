import numpy as np
import pytest

from crawl_analytics.llm import queries, whitening

KINDS = "vec_id long, embedding array<float>, label int"


def brute(rows, most=16):
    """{(length): (n, eigenvalues, vectors, mean, trace, deviation by x)} of the usable rows, all in one matrix."""
    good = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) and abs(c) <= 2.0**40 for c in v)]
    out = {}
    for size in {len(v) for _, v in good}:
        mine = [(i, tuple(int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in v)) for i, v in good if len(v) == size]
        fit = sorted({x for _, x in mine})
        n, sums = len(fit), [sum(d) for d in zip(*fit, strict=True)]
        centred = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in fit])
        values, vectors = np.linalg.eigh(centred.T @ centred / n)
        out[size] = mine, n, sums, values[::-1][:most], vectors[:, ::-1][:, :most], values.sum()
    return out


def check(got, rows, most=16, close=1e-8):
    want, seen = brute(rows, most), 0
    table = {}
    for r in got:
        table.setdefault((r.vec_id, r.component), []).append(r)
    for mine, n, sums, values, vectors, trace in want.values():
        width = int((values > 1e-12 * max(values[0], 1e-300)).sum())
        signs = np.zeros(width)
        seen += len(mine) * width
        for i, x in mine:
            centred = np.array([(n * a - s) / n for a, s in zip(x, sums, strict=True)])
            for k in range(width):
                r = next(r for r in table[i, k + 1] if r.n == n)
                deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
                assert r.deviation == (deviation if deviation < 1 << 63 else None)
                assert r.explained == pytest.approx(values[k] / trace, rel=1e-9) and r.identity_error < 1e-9
                value = centred @ vectors[:, k] / np.sqrt(values[k])
                if not signs[k] and abs(value) > 1e-3:
                    signs[k] = np.sign(value * r.whitened)
                assert r.whitened == pytest.approx((signs[k] or 1) * value, abs=close)
    assert len(got) == seen


@pytest.mark.parametrize("size,n", [(1, 9), (3, 40), (24, 200), (40, 12)])
def test_against_dense_eigenvectors(spark, size, n):
    random = np.random.default_rng(size)
    vectors = random.normal(size=(n, size)) * np.linspace(1, 2, size)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], KINDS)
    check(whitening.whitened(frame).collect(), rows)


def test_registered_query(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    check(queries.registry()["op13_whitening"](spark, sf).collect(), rows)


@pytest.mark.parametrize("values", [np.geomspace(1, 1e-3, 300), np.repeat([4.0, 2.0, 1.0], 100), 1 + np.linspace(0, 1e-6, 300)[::-1]])
def test_pairs_of_a_large_matrix(values):
    """Search spaces far smaller than the matrix, repeated and crowded eigenvalues: every residual at double precision."""
    size = len(values)
    basis = np.linalg.qr(np.random.default_rng(1).normal(size=(size, size)))[0]
    matrix, calls = (basis * values) @ basis.T, []
    matrix = (matrix + matrix.T) / 2

    def product(block):
        calls.append(block.shape[1])
        return matrix @ block

    found, vectors = whitening.leading_pairs(product, size, 8)
    assert np.allclose(found, np.sort(values)[::-1][:8], rtol=1e-12)
    assert np.linalg.norm(matrix @ vectors - vectors * found, axis=0).max() <= 5e-12 * values.max()
    assert np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-12
    assert max(calls) <= 16


def test_inner_solver():
    random = np.random.default_rng(2)
    a = random.normal(size=(12, 12))
    a = a + a.T
    right = random.normal(size=(12, 3))
    x = whitening._minres(lambda v: a @ v, right, 40, 1e-13)
    assert np.abs(a @ x - right).max() < 1e-8


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [2.0, -1.0]), (2, [2.0, -1.0]), (None, [0.5, 0.0]), (3, None), (4, []), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0])]
    rows += [(8, [1.0, 1.0, 5.0]), (9, [1.0, 2.0, 3.0]), (10, [0.0, 0.0, 0.0]), (11, [1e30, 0.0]), (12, [7.0])]
    frame = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], KINDS + ", x string, component string")
    got = whitening.whitened(frame).collect()
    check([r for r in got], [r for r in rows if r[0] != 2] + [(2, [2.0, -1.0])] * 2)
    assert {r.vec_id for r in got} == {1, 2, None, 8, 9, 10}
    assert [r.n for r in got if r.vec_id == 2] == [3] * 4 and {r.n for r in got if r.vec_id == 8} == {3}
    assert whitening.whitened(frame.where("vec_id = 2")).count() == 0
    assert whitening.whitened(frame.where("vec_id = 3")).count() == 0
    assert whitening.whitened(spark.createDataFrame([], KINDS)).columns == got[0].__fields__


def test_copies_do_not_weigh_and_large_entries_stay_exact(spark):
    random = np.random.default_rng(3)
    base = [[float(np.float32(c)) for c in v] for v in random.normal(size=(30, 4))]
    rows = list(enumerate(base + [base[0]] * 50))
    check(whitening.whitened(spark.createDataFrame([(*r, 1) for r in rows], KINDS)).collect(), rows)
    for factor in (1e5, 1e6):  # the second has deviations beyond a long
        large = [(i, [float(np.float32(c * factor)) for c in v]) for i, v in enumerate(base)]
        check(whitening.whitened(spark.createDataFrame([(*r, 1) for r in large], KINDS)).collect(), large)

import math

import numpy as np
from helpers import rows

from voxstars.llm import whitening
from voxstars.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, x int, component double, n string"


def table(spark, given):
    return spark.createDataFrame([(i, v, 1, 1.0, "x") for i, v in given], SCHEMA)


def usable(given):
    fine = [(i, v) for i, v in given if v and all(c is not None and math.isfinite(c) for c in v)]
    return [(i, [math.floor(256 * c) for c in v]) for i, v in fine]


def brute(given, k=4):
    """Eigenvectors of the covariance of the distinct whole vectors, as right singular vectors of all of them."""
    kept = usable(given)
    fit = np.array(sorted({tuple(x) for _, x in kept}), float)
    mean = fit.mean(axis=0)
    _, values, vectors = np.linalg.svd(fit - mean, full_matrices=False)
    values, vectors = values**2 / len(fit), vectors.T
    total = [sum(int(x[j]) for x in {tuple(x) for _, x in kept}) for j in range(fit.shape[1])]
    out = []
    for i, x in kept:
        far = sum((len(fit) * c - s) ** 2 for c, s in zip(x, total))
        far = far if far < 1 << 63 else None
        out += [(i, j + 1, len(fit), far, (np.array(x, float) - mean) @ vectors[:, j] / math.sqrt(values[j]), values[j] / values.sum()) for j in range(min(k, len(mean)))]
    return out


COLUMNS = ("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def same(got, want):
    """Equal up to the sign of each component."""
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3] or 0, abs(r[4]))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for j in {w[1] for w in want}:
        a, b = (np.array([r[4] for r in side if r[1] == j]) for side in (got, want))
        sign = 1 if a[np.abs(a).argmax()] * b[np.abs(a).argmax()] > 0 else -1
        assert np.allclose(a, sign * b, rtol=1e-8, atol=1e-8)
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    assert len({g[6] for g in got}) <= 1 and all(g[6] < 1e-9 for g in got)


def test_equals_eigenvectors(spark):
    rng = np.random.default_rng(3)
    spread = 2.0 ** -np.arange(10)
    given = [(i, (rng.normal(size=10) * spread).tolist()) for i in range(500)]
    hot = given[0][1]
    given += [(i, hot) for i in range(500, 900)] + given[:5] + [(None, given[7][1]), (None, given[7][1])]
    given += [(901, None), (902, []), (903, [math.nan] * 10), (904, [math.inf] + [0.0] * 9), (905, [None] + [1.0] * 9), (906, [1.0, 2.0])]
    got = rows(whitening.whiten(table(spark, given).repartition(7)), *COLUMNS)
    same(got, brute([g for g in given if g[0] != 906]))
    assert len(got) == 4 * 907


def test_badly_scaled_and_dependent_entries(spark):
    """A constant entry, a sum of two others, and variances ten orders apart."""
    rng = np.random.default_rng(4)
    a, b, c = rng.normal(size=(3, 400)) * np.array([[1e6], [30.0], [1.0]])
    given = [(i, [7.0, float(a[i]), float(b[i]), math.floor(256 * c[i]) / 256, float(math.floor(a[i]))]) for i in range(400)]
    got = rows(whitening.whiten(table(spark, given)), *COLUMNS)
    same(got, brute(given))


def test_no_variance(spark):
    got = rows(whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])), *COLUMNS)
    assert sorted(got) == [(i, j, 1, 0, None, None, None) for i in (1, 2) for j in (1, 2)]
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(6)]
    got = rows(whitening.whiten(table(spark, line)), *COLUMNS)
    assert all((w is None) == (j > 1) for _, j, _, _, w, _, _ in got) and all(e < 1e-12 for *_, e in got)
    assert whitening.whiten(table(spark, [])).collect() == []


def test_entries_beyond_exact_products(spark):
    """The deviation is exact where it fits a long, and null beyond."""
    given = [(1, [1e5, 3.0]), (2, [-1e5, 5.0]), (3, [0.0, 9.0])]
    same(rows(whitening.whiten(table(spark, given)), *COLUMNS), brute(given))
    huge = rows(whitening.whiten(table(spark, [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.5, 3.0])])), *COLUMNS)
    assert {(i, far) for i, _, _, far, *_ in huge} == {(1, None), (2, None), (3, 257**2 + 768**2)}


def test_shift_is_needed(spark):
    """The Gram matrix of these rows has no Cholesky factor in doubles; the passes still find all directions."""
    rng = np.random.default_rng(8)
    q, _ = np.linalg.qr(rng.normal(size=(300, 6)))
    rows_ = (q * 10.0 ** -np.arange(0, 12, 2)) @ np.linalg.qr(rng.normal(size=(6, 6)))[0]
    steps_seen = []

    def gram(steps):
        x = rows_
        for r in steps:
            x = whitening._solved(np.asfortranarray(x), r)
        steps_seen.append(len(steps))
        return x.T @ x

    r, _ = whitening.shifted_cholesky_qr(gram, 300, 6)
    values = np.linalg.svd(r, compute_uv=False)
    assert np.allclose(values, 10.0 ** -np.arange(0, 12, 2), rtol=1e-4) and 3 <= len(steps_seen) <= 6


def test_query_over_the_whole_table(spark, folder):
    given = rows(spark.read.parquet(f"{folder}/embeddings.parquet"), "vec_id", "embedding")
    same(rows(QUERIES["op12_whitened_vectors"](spark, folder), *COLUMNS), brute(given))

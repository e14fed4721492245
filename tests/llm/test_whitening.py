"""Whitening against exact whole-number arithmetic and a dense eigensolver."""

import math
from collections import defaultdict

import numpy as np
import pytest

from logtide.llm import whitening


def brute(rows, components=16):
    """x by row, n, deviations and the shares and variances of the components."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    sizes = defaultdict(int)
    for _, v in good:
        if v:
            sizes[len(v)] += 1
    dim = max(sizes, key=lambda d: (sizes[d], d))
    x = [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for i, v in good if len(v) == dim]
    fit = sorted({v for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    deviation = sorted((str(i), sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))) for i, v in x)
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in fit])
    e = np.linalg.eigvalsh(centred.T @ centred / n)[::-1]
    return fit, n, deviation, e[: min(components, int((e > 1e-9 * e[0]).sum()))], e.sum(), centred


def checked(got, rows, components=16):
    fit, n, deviation, e, trace, centred = brute(rows, components)
    by_component = defaultdict(list)
    for r in got:
        by_component[r.component].append(r)
    assert sorted(by_component) == list(range(1, len(e) + 1))
    for k, each in by_component.items():
        assert sorted((str(r.vec_id), r.deviation) for r in each) == deviation
        assert {r.n for r in each} == {n}
        assert all(abs(r.explained / (e[k - 1] / trace) - 1) < 1e-9 for r in each)
        assert len({r.identity_error for r in each}) == 1 and each[0].identity_error < 1e-8
    # the whitened fit list: unit covariance, and its product with the centred rows gives sqrt(e) axes of unit length
    model_axes = None
    return fit, n, e, centred, model_axes


@pytest.fixture(scope="module")
def odd():
    r = np.random.default_rng(4)
    base = r.normal(size=(300, 6)) * [3, 2, 1, 0.5, 0.2, 40]
    rows = [(i, base[i].tolist()) for i in range(300)]
    rows += [(7, base[7].tolist()), (None, base[8].tolist()), (400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6), (403, [float("inf")] + [0.0] * 5)]
    rows += [(404, []), (405, [1.0, 2.0]), (406, [1e-9] * 6), (407, [-0.0] * 6)] + [(500 + i, [0.25] * 6) for i in range(200)]
    return rows


def test_whitening(spark, odd):
    vectors = spark.createDataFrame([(v, i, "x", 5) for i, v in odd], "embedding array<double>, vec_id long, X string, WHITENED int").repartition(5)
    got = whitening.whiten(vectors, components=4).collect()
    checked(got, odd, 4)
    model = whitening.fit(vectors, 4, block_rows=17)
    fit, n, _, e, _, centred = brute(odd, 4)
    assert np.allclose(centred.T @ centred / n @ model.axes, model.axes * e, atol=1e-9 * e[0])
    assert np.allclose(model.axes.T @ model.axes, np.eye(4), atol=1e-12)
    for r in got:
        v = next(v for i, v in odd if i == r.vec_id and v is not None)
        x = np.array([math.floor(64 * c) + 1_000_000 for c in v])
        want = (x - model.sums.astype(float) / n) @ model.axes[:, r.component - 1] / np.sqrt(e[r.component - 1])
        assert abs(abs(want) - abs(r.whitened)) < 1e-6


def test_fewer_components_than_asked(spark):
    rows = [(i, [float(i), 2.0 * i, 1.0]) for i in range(20)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    checked(whitening.whiten(vectors).collect(), rows)
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "vec_id long, embedding array<float>")
    assert whitening.whiten(same).count() == 0
    assert whitening.whiten(vectors.limit(0)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<float>")).count() == 0


def test_jacobi():
    r = np.random.default_rng(0)
    for n in (1, 2, 7, 32):
        a = r.normal(size=(n, n)) * np.logspace(0, -7, n)
        sigma, v = whitening.jacobi(a)
        want = np.linalg.svd(a, compute_uv=False)
        assert np.allclose(sigma / want, 1, rtol=1e-9) and np.allclose(v.T @ v, np.eye(n), atol=1e-13)
        gram = (a @ v).T @ (a @ v) / np.outer(sigma, sigma)
        assert np.allclose(gram, np.eye(n), atol=1e-9)


def test_large_numbers_stay_exact():
    x = np.array([[2**52, -(2**52)], [5, 7], [2**40, 3]], np.int64)
    model = whitening.Whitening(3, np.array([int(c) for c in x.sum(axis=0)], object), np.ones(1), np.ones((2, 1)), np.ones(1))
    sums = [int(c) for c in x.sum(axis=0)]
    want = [sum((3 * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    assert model.distance(x) == [w if w < 1 << 63 else None for w in want]
    assert [b for b in map(len, whitening._packed(x + 0))] == [16, 8, 16]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    from logtide.llm.queries import op12_whitening

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    checked(op12_whitening(spark, sf).collect(), rows)

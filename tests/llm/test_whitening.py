"""Eigenvalues against numpy, whitening against a plain computation."""

import math

import numpy as np
import pytest

from oracle import TESTDATA
from paperlantern.llm import whitening as wh
from paperlantern.llm.common import table


def matrices():
    rng = np.random.default_rng(3)
    for d in (1, 2, 3, 8, 40):
        a = rng.normal(size=(d, 3 * d))
        yield a @ a.T
    yield np.eye(12) * 5.0  # one eigenvalue, twelve times
    yield np.diag([3.0, 3.0, 3.0, 1.0, 1.0, 0.0])
    q, _ = np.linalg.qr(rng.normal(size=(30, 30)))
    yield (q * np.array([7.0] * 10 + [7.0 - 1e-9] * 5 + [1e-3] * 15)) @ q.T  # clusters
    yield np.kron(np.eye(4), np.array([[2.0, 1.0], [1.0, 2.0]]))  # falls apart into equal blocks
    b = rng.normal(size=(20, 4))
    yield b @ b.T * 1e-9  # rank 4


@pytest.mark.parametrize("v", list(matrices()), ids=lambda v: str(len(v)))
def test_components_of_a_matrix(v):
    v = (v + v.T) / 2
    true = np.linalg.eigvalsh(v)[::-1]
    values, vectors = wh.principal_components(v, 16)
    norm = true[0]
    k = min(16, int((true > len(v) * 1e-12 * norm).sum()))
    assert len(values) >= k and np.abs(values[:k] - true[:k]).max() <= 1e-13 * norm
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() <= 1e-13
    assert np.abs(v @ vectors - vectors * values).max() <= 2e-14 * norm * max(4, len(v))


def test_tridiagonal_and_counts():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(9, 9))
    a = a + a.T
    diagonal, off, _ = wh.tridiagonal(a)
    t = np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1)
    true = np.linalg.eigvalsh(a)
    assert np.allclose(np.linalg.eigvalsh(t), true)
    at = np.concatenate([(true[1:] + true[:-1]) / 2, [true[0] - 1, true[-1] + 1]])
    assert wh.sturm_counts(diagonal, off, at).tolist() == [*range(1, 9), 0, 9]


def brute(rows, k=16):
    """{vec_id: …} of the rows that take part, by numpy's own eigenvectors and whole numbers."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in kept]
    different = sorted(set(map(tuple, x)))
    n, s = len(different), [sum(c) for c in zip(*different)]
    centred = np.array([[(n * a - b) / n for a, b in zip(v, s)] for v in different])
    cov = centred.T @ centred / n
    e, p = np.linalg.eigh(cov)
    e, p = e[::-1][:k], p[:, ::-1][:, :k]
    out = []
    for (i, _), v in zip(kept, x):
        z = [n * a - b for a, b in zip(v, s)]
        out.append((i, n, sum(a * a for a in z), np.array([a / n for a in z]) @ p / np.sqrt(e), e / np.trace(cov)))
    return out


def assert_same(found, wanted, k):
    by = {}
    for r in found:
        by.setdefault((r.vec_id, r.deviation), {})[r.component] = r
    assert len(found) == len(wanted) * k and {r.component for r in found} == set(range(1, k + 1))
    mine = np.array([[by[i, dev][c].whitened for c in range(1, k + 1)] for i, _, dev, _, _ in wanted])
    theirs = np.array([w[3] for w in wanted])
    sign = np.sign((mine * theirs).sum(0))
    assert np.abs(mine - sign * theirs).max() < 1e-7
    for i, n, dev, _, explained in wanted:
        for c in range(1, k + 1):
            assert by[i, dev][c].n == n and by[i, dev][c].explained == pytest.approx(explained[c - 1], rel=1e-9)
    errors = {r.identity_error for r in found}
    assert len(errors) == 1 and errors.pop() < 1e-9


def test_given_vectors(spark):
    vectors = table(spark, f"{TESTDATA}/sf0.01", "embeddings")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    assert_same(wh.whiten(vectors).collect(), brute(rows), 16)


def test_copies_do_not_weigh(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 5)))]
    rows += [(100 + i, rows[7][1]) for i in range(500)] + [(7, rows[7][1]), (None, rows[8][1])]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, n string, x string")
    rows = [(i, np.array(v, np.float32).tolist()) for i, v in rows]
    found = wh.whiten(df.repartition(5)).collect()
    assert len(found) == len(rows) * 5
    assert_same([r for r in found if r.vec_id != 7], [w for w in brute(rows) if w[0] != 7], 5)
    assert sorted(found, key=repr) == sorted(wh.whiten(df.repartition(3)).collect(), key=repr)


def test_rows_that_take_no_part(spark):
    inf, nan = float("inf"), float("nan")
    good = [(i, [float(i % 4), float(i * i % 5), float(i % 2)]) for i in range(20)]
    bad = [(90, None), (91, []), (92, [nan, 1.0, 1.0]), (93, [-inf, 1.0, 1.0]), (94, [None, 1.0, 1.0]), (95, [1.0, 2.0])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>")
    found = wh.whiten(df).collect()
    assert {r.vec_id for r in found} == set(range(20))
    assert wh.whiten(df.limit(0)).count() == 0
    assert wh.whiten(df.where("vec_id = 3")).count() == 0  # one vector does not vary
    assert wh.whiten(df.where("vec_id >= 90 AND vec_id < 95")).count() == 0
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(9)], "vec_id long, embedding array<double>")
    assert {r.component for r in wh.whiten(flat).collect()} == {1}


def test_vast_entries(spark):
    df = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5.0, 2.0])], "vec_id long, embedding array<double>")
    found = wh.whiten(df).collect()
    assert {r.vec_id for r in found} == {1, 2, 3} and all(math.isfinite(r.whitened) for r in found)
    assert {r.deviation for r in found if r.vec_id < 3} == {None}

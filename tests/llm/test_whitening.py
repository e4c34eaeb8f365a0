"""Whitening against numpy's eigenvectors of the covariance matrix, and its solver on hard spectra."""

import math

import numpy as np
import pytest

from amberline.llm import whitening as w


def plainly(rows, components):
    used = [(i, [math.floor(256 * c) + 0 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.unique(np.array([x for _, x in used]), axis=0)
    n, s = len(fit), fit.sum(0)
    centred = (fit * n - s) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = min(components, int((values > 1e-12 * values[0]).sum()))
    out = {}
    for i, x in used:
        white = ((np.array(x) * n - s) / n) @ vectors[:, :keep] / np.sqrt(values[:keep])
        for k in range(keep):
            out.setdefault((i, k + 1), []).append((n, int(((n * np.array(x) - s) ** 2).sum()), white[k], values[k] / values.sum()))
    return out


def held_against(found, rows, components=4):
    right = plainly(rows, components)
    got = {}
    for r in found:
        got.setdefault((r["vec_id"], r["component"]), []).append((r["n"], r["deviation"], r["whitened"], r["explained"]))
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in right.items()}
    signs = {}
    for (_, k), v in sorted(got.items(), key=str):
        other = sorted(right[_, k])
        for a, b in zip(sorted(v), other) if len(v) == 1 else []:
            assert a[:2] == b[:2] and math.isclose(a[3], b[3], rel_tol=1e-9)
            if abs(b[2]) > 1e-6:
                sign = signs.setdefault(k, np.sign(a[2]) * np.sign(b[2]))
                assert math.isclose(a[2] * sign, b[2], rel_tol=1e-7, abs_tol=1e-9)
    assert all(r["identity_error"] < 1e-9 and r["certified"] for r in found)


def test_made_vectors(spark):
    rng = np.random.default_rng(1)
    made = rng.standard_normal((300, 12)) * np.linspace(3, 0.3, 12) + 40
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(made)]
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (1002, None), (1003, []), (1004, rows[1][1][:-1] + [None]), (1005, rows[1][1][:-1] + [math.nan]),
             (1006, rows[1][1][:-1] + [-math.inf]), (1007, [-0.0] * 12), (None, rows[2][1]), (5, rows[5][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS x", "'a' AS n").repartition(4)
    held_against(w.whiten(frame).collect(), rows)


def test_given_vectors(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    held_against(w.whiten(frame).collect(), [(r["vec_id"], r["embedding"]) for r in frame.collect()])


def test_low_rank_single_and_empty(spark):
    line = [(i, [float(i), 2.0 * i, 1.0]) for i in range(5)]
    held_against(found := w.whiten(spark.createDataFrame(line, "vec_id long, embedding array<float>")).collect(), line)
    assert {r["component"] for r in found} == {1}
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        assert w.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count() == 0


def test_vectors_of_another_length_are_dropped(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, 1.0]), (3, [1.0, 2.0, 3.0]), (4, [5.0, 5.0])]
    found = w.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r["vec_id"] for r in found} == {1, 2, 4}


@pytest.mark.parametrize("values", [np.arange(64) + 100.0, np.r_[[1e6, 10, 9, 8.9], np.ones(60)], np.r_[np.full(6, 5.0), np.ones(58)],
                                    np.r_[[5.0, 3.0], np.zeros(62)], np.array([3.0, 2.0, 1.0]), np.r_[[1.0], np.full(99, 0.999)]], ids=str)
def test_solver(values):
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
    matrix = (q * values) @ q.T
    found = w.leading(lambda x: matrix @ x, len(values), 4)
    right = np.sort(values)[::-1][:len(found.values)]
    assert len(found.values) == min(4, int((values > 0).sum())) and np.allclose(found.values, right, rtol=0, atol=1e-12 * right[0])
    assert np.linalg.norm(matrix @ found.vectors - found.vectors * found.values, axis=0).max() <= 1e-10 * right[0]


def test_a_missed_vector_is_taken_in():
    """A block that starts without the leading vector still ends with it."""
    values = np.r_[[9.0], np.linspace(5, 1, 63)]
    bound, missed = w.largest_outside(lambda x: values[:, None] * x, np.eye(64)[:, 1:5], np.random.default_rng(3))
    assert bound >= 9 - 1e-9 and abs(missed[0]) > 0.99

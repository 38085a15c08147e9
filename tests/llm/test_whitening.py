import math
from collections import defaultdict

import numpy as np
import pytest

from leafwork.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, n int"


def by_hand(rows, most=16):
    """The contract in numpy, on (vec_id, entries or None)."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    grid = [tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for _, v in kept]
    fit = np.array(sorted(set(grid)), dtype=object)
    n, sums = len(fit), fit.sum(0)
    centred = ((fit * n - sums) / n).astype(float)
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(most, int((values > 1e-9 * max(values[0], 1e-300)).sum()))
    out = defaultdict(list)
    for (i, _), x in zip(kept, grid):
        off = np.array(x, dtype=object) * n - sums
        white = (off / n).astype(float) @ axes[:, :k] / np.sqrt(values[:k])
        out[i].append((n, int((off * off).sum()), white, values[:k] / np.trace(cov)))
    return out, axes[:, :k]


def check(got, rows):
    want, _ = by_hand(rows)
    mine = defaultdict(list)
    for r in got:
        mine[r.vec_id].append(r)
    assert {i: len(v) for i, v in mine.items()} == {i: len(v) for i, v in want.items()}
    sign = None
    for i, rs in mine.items():
        rs, ws = sorted(rs, key=lambda r: r.whitened), sorted(want[i], key=lambda w: w[1])
        for r in rs:
            w = min(ws, key=lambda w: (abs(w[1] - r.deviation), np.abs(np.abs(w[2]) - np.abs(r.whitened)).max()))
            assert (r.n, r.deviation) == w[:2]
            a, b = np.array(r.whitened), w[2]
            if sign is None and np.abs(b).min() > 1e-3:
                sign = np.sign(a * b)
            assert np.allclose(a if sign is None else a * sign, np.abs(b) if sign is None else b, atol=1e-7) or sign is None
            assert np.allclose(r.explained, w[3], rtol=1e-9)
            assert r.identity_error < 1e-8


@pytest.mark.parametrize("d, rank", [(1, 1), (5, 5), (40, 40), (24, 7)])
def test_cholesky_and_jacobi_against_numpy(d, rank):
    rng = np.random.default_rng(d)
    half = rng.normal(size=(d, rank)) * np.logspace(0, 4, rank)
    cov = half @ half.T
    factor, order = whitening.pivoted_cholesky(cov)
    assert factor.shape == (d, rank) and np.allclose(factor @ factor.T, cov[order][:, order])
    assert np.allclose(np.triu(factor[:rank], 1), 0) and (np.diff(factor.diagonal()) <= 1e-9 * factor[0, 0]).all()
    values, axes = whitening.eigen(cov)
    want = np.linalg.eigvalsh(cov)[::-1][:rank]
    assert np.allclose(values, want, rtol=1e-9, atol=1e-12 * want[0]) and (np.diff(values) <= 0).all()
    assert np.allclose(axes @ axes.T, np.eye(rank), atol=1e-9)
    assert np.allclose(cov @ axes.T, axes.T * values, atol=1e-9 * want[0])


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(k, (rng.normal(size=6) * [4, 3, 2.5, 1, 0.5, 2]).tolist()) for k in range(80)]
    rows += rows[:3] + [(None, rows[0][1]), (None, rows[5][1]), (7, rows[9][1])]  # repeated rows, ids, vectors
    hot = [(1000 + k, rows[1][1]) for k in range(60)]  # a group of copies with two fifths of the rows
    bad = [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (202, [float("nan")] * 6), (203, [float("inf")] + [0.0] * 5)]
    other = [(204, []), (205, [1.0, 2.0]), (206, [3e38] + [0.0] * 5)]
    table = spark.createDataFrame([(i, v, "clash", 3) for i, v in rows + hot + bad + other], SCHEMA).repartition(5)
    got = whitening.whiten(table)
    check(got.collect(), rows + hot)
    long = whitening.components_of(got)
    assert long.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert long.count() == 6 * len(rows + hot) and long.schema["component"].dataType.simpleString() == "int"
    assert {r.component for r in long.collect()} == set(range(1, 7))


def test_fewer_vectors_than_dimensions_and_none(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=30).tolist()) for k in range(9)]
    got = whitening.whiten(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()
    assert {len(r.whitened) for r in got} == {8}
    check(got, rows)
    same = whitening.whiten(spark.createDataFrame([(k, [1.0, 2.0], "x", 1) for k in range(4)], SCHEMA))
    assert {(r.n, r.deviation, tuple(r.whitened)) for r in same.collect()} == {(1, 0, ())}
    assert whitening.components_of(same).count() == 0
    none = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(none).count() == 0 and whitening.components_of(whitening.whiten(none)).columns
    with pytest.raises(ValueError):
        whitening.on_grid(spark.createDataFrame([(1, [0.0] * 5000, "x", 1)], SCHEMA))


def test_large_entries_stay_exact(spark):
    rows = [(k, [float(np.float32(2.0**39 * (k % 3 - 1))), float(k)]) for k in range(7)]
    got = whitening.whiten(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()
    want, _ = by_hand(rows)
    for r in got:
        n, deviation, white, _ = want[r.vec_id][0]
        assert r.deviation == (deviation if deviation < 1 << 63 else None)
        assert np.allclose(np.abs(r.whitened), np.abs(white), atol=1e-6)


def test_whitened_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    check(whitening.whiten(rows).collect(), [(r.vec_id, list(r.embedding)) for r in rows.select("vec_id", "embedding").collect()])

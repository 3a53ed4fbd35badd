"""Nearest rows by pivots against all pairs, to the last digit and the lowest id."""

import math

import numpy as np
import pytest

from skyfront.operators import near, stats


def frame(spark, ids, v):
    return spark.createDataFrame([(int(i), [float(c) for c in row]) for i, row in zip(ids, v)], "id bigint, x array<double>").repartition(6)


def plain(q, ids, p, names, itself):
    out = {}
    for a, i in zip(q, ids):
        d = [(math.sqrt(((a - b) ** 2).sum()), n) for b, n in zip(p, names) if itself or n != i]
        out[int(i)] = min(d, default=(math.inf, None))[::-1]
    return out


def found(df):
    return {r.id: (r.near, r.d) for r in df.collect()}


def some(kind, n, dim, seed=2):
    rng = np.random.default_rng(seed)
    if kind == "clustered":
        return rng.normal(size=(12, dim))[rng.integers(0, 12, n)] * 30 + rng.normal(size=(n, dim))
    if kind == "copies":  # ties by the lowest id, distances of zero
        return rng.integers(0, 3, (n, dim)).astype(float)
    if kind == "far":  # large numbers, small distances
        return 1e6 + rng.normal(size=(n, dim))
    return rng.random((n, dim))


@pytest.mark.parametrize("itself", [False, True])
@pytest.mark.parametrize("kind", ["any", "clustered", "copies", "far"])
def test_against_all_pairs(spark, kind, itself):
    v, ids = some(kind, 400, 5), np.arange(400)
    df = frame(spark, ids, v)
    asks = df.where("id % 3 = 0")
    got = found(stats.nearest_rows(asks, df, "id", "x", block=16, itself=itself))
    want = plain(v[::3], ids[::3], v, ids, itself)
    assert got.keys() == want.keys()
    for i, (n, d) in want.items():
        assert got[i][0] == n and math.isclose(got[i][1], d, rel_tol=1e-12, abs_tol=1e-12), (i, got[i], (n, d))


def test_clusters_are_met_in_part(spark):
    """On clustered rows an asking row meets few cells; the result stays exact."""
    v, ids = some("clustered", 3000, 8), np.arange(3000)
    df, report = frame(spark, ids, v), {}
    got = found(stats.nearest_rows(df, df, "id", "x", block=50, report=report))
    assert report["asking"] == 3000 and report["cells"] == 60
    assert report["meetings"] < 0.25 * report["asking"] * report["cells"], report
    d = near.distances(v, v)
    np.fill_diagonal(d, np.inf)
    assert all(abs(got[i][1] - d[i].min()) < 1e-6 for i in range(3000))


def test_rows_are_not_copied_for_each_cell(spark, monkeypatch):
    """On rows without clusters nearly every cell is reached; what is written stays in proportion to the rows."""
    made, plainly = {}, near.written

    def counted(df, label):
        df, path = plainly(df, label)
        made[label] = max(made.get(label, 0), df.count())
        return df, path

    monkeypatch.setattr(near, "written", counted)
    v, ids = some("any", 600, 16), np.arange(600)
    df, report = frame(spark, ids, v), {}
    got = found(stats.nearest_rows(df, df, "id", "x", block=20, report=report))
    assert got == {i: (n, pytest.approx(d, rel=1e-12)) for i, (n, d) in plain(v, ids, v, ids, False).items()}
    assert report["meetings"] > 0.5 * 600 * report["cells"] and max(made.values()) <= 600, (report, made)


@pytest.mark.parametrize("itself", [False, True])
@pytest.mark.parametrize("kind", ["any", "clustered", "copies", "far"])
def test_many_small_packs(spark, kind, itself):
    v, ids = some(kind, 300, 5), np.arange(300)
    df = frame(spark, ids, v)
    got = found(stats.nearest_rows(df.where("id % 4 = 0"), df, "id", "x", block=60, itself=itself, pack=24))
    want = plain(v[::4], ids[::4], v, ids, itself)
    assert got == {i: (n, pytest.approx(d, rel=1e-12, abs=1e-12)) for i, (n, d) in want.items()}


def test_edges(spark):
    one = frame(spark, [1], [[0.0, 0.0]])
    none = one.limit(0)
    assert found(stats.nearest_rows(one, one, "id", "x")) == {1: (None, math.inf)}
    assert found(stats.nearest_rows(one, none, "id", "x")) == {1: (None, math.inf)}
    assert found(stats.nearest_rows(none, one, "id", "x")) == {}
    assert found(stats.nearest_rows(one, one, "id", "x", itself=True)) == {1: (1, 0.0)}
    far = frame(spark, [5, 6, 7, 8], [[0.0, 0.0], [0.0, 1.0], [900.0, 0.0], [901.0, 0.0]])
    assert found(stats.nearest_rows(frame(spark, [9], [[5000.0, 0.0]]), far, "id", "x", block=1)) == {9: (8, 4099.0)}
    assert {r.id: r.d for r in stats.nearest_distances(one, "id", "x").collect()} == {1: 0.0}


def test_bounds_never_leave_out_the_nearest():
    rng = np.random.default_rng(0)
    for _ in range(30):
        v = rng.normal(size=(200, 3)) * rng.choice([1e-3, 1, 1e5]) + rng.choice([0, 1e4])
        cells = near.Cells(np.unique(v[:9], axis=0))
        d = np.sqrt(((v[:, None] - cells.pivots[None]) ** 2).sum(2))
        cell = d.argmin(1)
        cells.sizes = np.bincount(cell, minlength=9)
        cells.radius = np.array([d[cell == k, k].max(initial=0) for k in range(9)])
        apart = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
        np.fill_diagonal(apart, np.inf)
        own = np.where(cell[:, None] == cell[None], apart, np.inf).min(1)
        for i, others in enumerate(cells.reached(v, cell, own)):
            assert cell[apart[i].argmin()] in {cell[i], *others.tolist()}

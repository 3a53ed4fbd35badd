"""Skylines and hypervolumes of many objectives, ranges without groups, and histories in one pass."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyfront.operators import pareto, stats


def kept(y):
    return {i for i, a in enumerate(y) if not any(all(p >= q for p, q in zip(b, a)) and any(p > q for p, q in zip(b, a)) for b in y)}


def points(spark, y):
    names = [f"o{k}" for k in range(len(y[0]))]
    return spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(y)], "id bigint, " + ", ".join(f"{n} double" for n in names)).repartition(5), names


def some(m, n, kind, seed=0):
    rng = np.random.default_rng(seed)
    if kind == "whole":  # many ties and copies
        return rng.integers(1, 6, (n, m)).astype(float)
    y = rng.random((n, m)) + 0.01
    return y / y.sum(1, keepdims=True) * (1 + 0.05 * rng.random((n, 1))) if kind == "conflicting" else y


@pytest.mark.parametrize("kind", ["any", "whole", "conflicting"])
@pytest.mark.parametrize("m", [1, 2, 3, 4, 6])
def test_skyline_against_all_pairs(spark, kind, m):
    y = some(m, 300, kind)
    df, names = points(spark, y.tolist())
    report = {}
    found = pareto.skyline_nd(df, names, "id", block=16, cells=81, report=report)
    assert {r.id for r in found.collect()} == kept(y.tolist())
    assert report["rows"] <= 300 and report["pairs"] <= report["blocks"] ** 2


def test_cells_and_blocks_are_left_out(spark):
    """On independent objectives most cells go unread; on conflicting ones not all pairs of blocks meet."""
    for kind in ("any", "conflicting"):
        y = some(3, 4000, kind, 1)
        df, names = points(spark, y.tolist())
        report = {}
        front = pareto.skyline_nd(df, names, "id", block=32, report=report).collect()
        assert {r.id for r in front} == set(pareto._undominated(y).tolist())
        if kind == "any":
            assert report["discarded"] > report["cells"] / 2 and report["rows"] < 1000
        else:
            assert report["blocks"] > 20 and report["pairs"] < 0.4 * report["blocks"] ** 2, report


def test_a_cell_of_very_many_rows_is_split(spark):
    y = np.concatenate((np.full((500, 3), 5.0), some(3, 50, "any")))
    df, names = points(spark, y.tolist())
    report = {}
    found = pareto.skyline_nd(df, names, "id", block=32, report=report)
    assert {r.id for r in found.collect()} == set(range(500)) and report["blocks"] >= 500 // 32


def test_skyline_edges(spark):
    schema = "id bigint, a double, b double, c double"
    assert pareto.skyline_nd(spark.createDataFrame([], schema), ["a", "b", "c"], "id").count() == 0
    df = spark.createDataFrame([(1, 1.0, 1.0, None), (2, 0.0, 0.0, 0.0), (3, 0.0, 0.0, 0.0), (4, -1.0, 0.0, 0.0)], schema)
    assert {r.id for r in pareto.skyline_nd(df, ["a", "b", "c"], "id").collect()} == {2, 3}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 4)] * 3), max_size=40), st.integers(1, 7))
def test_undominated_in_blocks(rows, block):
    y = np.array(rows, float).reshape(-1, 3)
    assert set(pareto._undominated(y, block).tolist()) == kept(rows)
    assert set(pareto._undominated(y[:, :2], block).tolist()) == kept([r[:2] for r in rows])
    lost = pareto.beaten_by(y, y, block)
    assert {i for i in range(len(y)) if not lost[i]} == kept(rows)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.lists(st.tuples(*[st.integers(0, 4)] * 5), max_size=14))
def test_volume_counts_unit_cells(m, rows):
    y = np.array(rows, float).reshape(-1, 5)[:, :m]
    cells = np.stack(np.meshgrid(*[np.arange(4)] * m, indexing="ij"), -1).reshape(-1, m)
    covered = sum(any((p >= c + 1).all() for p in y) for c in cells)
    assert pareto.volume(y, np.zeros(m)) == pytest.approx(covered)
    assert pareto.slices(y, np.zeros(m)) == pytest.approx(covered)


@pytest.mark.parametrize("kind", ["any", "whole", "conflicting"])
@pytest.mark.parametrize("m", [1, 2, 3, 4, 5])
def test_hypervolume_against_slices(spark, kind, m):
    y = some(m, 60, kind, m)
    df, names = points(spark, y.tolist())
    found = pareto.hypervolume_nd(df, names, [0.005] * m, "id", block=7).first().hv
    assert found == pytest.approx(pareto.slices(y, np.full(m, 0.005)), rel=1e-9)


def test_hypervolume_without_points(spark):
    df, names = points(spark, [[1.0] * 4])
    assert pareto.hypervolume_nd(df, names, [2.0] * 4, "id").first().hv == 0.0
    assert pareto.hypervolume_nd(df.limit(0), names, [0.0] * 4, "id").first().hv == 0.0


def test_nothing_crosses_with_broadcasts_off(spark):
    df, names = points(spark, some(4, 200, "conflicting").tolist())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for out in (pareto.hypervolume_nd(df, names, [0.0] * 4, "id"), pareto.hypervolume_nd(df, names[:3], [0.0] * 3, "id"), pareto.skyline_nd(df, names, "id")):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_large_front_is_spread_over_tasks(spark):
    """200,000 points of a falling line: no range holds more than a share of them."""
    n = 200_000
    df = spark.range(n).select(F.col("id").cast("double").alias("a"), (F.lit(float(n)) - F.col("id")).alias("b"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in pareto._ranged_front(df.select(F.col("a").alias("_a"), F.col("b").alias("_b"))).groupBy("_k").count().collect()]
        assert sum(sizes) == n and len(sizes) == 8 and max(sizes) < n / 4
        area = pareto.hypervolume(df, "a", "b", (-1.0, 0.0)).first().hv
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert area == pytest.approx(n * (n + 1) / 2)


def test_ranks_by_ranges(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, 1.0, 1.0, 2.0, 5.0, rng.random()])) for i in range(500)]
    df = spark.createDataFrame(rows, "id bigint, x double").repartition(7)
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0.0, r[0]))
    found = {r.id: r.n for r in stats.ordinal_rank(df, "x", "id", "n").collect()}
    assert found == {i: k + 1 for k, (i, _) in enumerate(order)}
    values = sorted(x for _, x in rows if x is not None)
    wanted = {i: sum(v < x for v in values) + (sum(v == x for v in values) + 1) / 2 for i, x in rows if x is not None}
    for few in (stats.FEW_RANKS, 0):
        stats.FEW_RANKS, old = few, stats.FEW_RANKS
        try:
            assert {r.id: r.n for r in stats.average_rank(df.dropna(), "x", "n").collect()} == wanted
        finally:
            stats.FEW_RANKS = old


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(-1, 6), st.integers(-1, 6)), max_size=25))
def test_staircase_takes_points_one_by_one(rows):
    with_area, plain = pareto.Staircase((0.0, 0.0)), pareto.Staircase()
    for k, (x, y) in enumerate(rows):
        with_area.add(x, y)
        plain.add(x, y)
        so_far = rows[: k + 1]
        assert with_area.area == pytest.approx(pareto.slices(np.array(so_far, float), np.zeros(2)))
        assert list(zip(plain.x, plain.y)) == sorted({so_far[i] for i in kept(so_far)})
        assert with_area.y == sorted(with_area.y, reverse=True)


def test_histories_in_one_pass(spark):
    rng = random.Random(9)
    rows = [(t, k, rng.choice([None, round(rng.random(), 2)]), round(rng.random(), 2)) for t in ("a", "b", None) for k in range(6) for _ in range(rng.randint(1, 12))]
    rows += [("c", 3, None, None), ("c", 5, 0.5, 0.5), ("c", 7, None, 1.0)]
    df = spark.createDataFrame(rows, "team string, rnd int, y1 double, y2 double").repartition(4)
    areas, fronts = {}, set()
    for t in {r[0] for r in rows}:
        for k in {r[1] for r in rows if r[0] == t}:
            own = [r[2:] for r in rows if r[0] == t and r[1] <= k and None not in r[2:]]
            areas[t, k] = pareto.slices(np.array(own, float).reshape(-1, 2), np.zeros(2))
            fronts |= {(t, k, *own[i]) for i in kept(own)}
    got = {(r.team, r.rnd): r.hv for r in pareto.hv_history(df, "team", "rnd", "y1", "y2", (0.0, 0.0)).collect()}
    assert got.keys() == areas.keys() and all(math.isclose(got[k], v, abs_tol=1e-12) for k, v in areas.items() if k[0] is not None)
    some = {tuple(r) for r in pareto.front_history(df.where("team IS NOT NULL"), "team", "rnd", "y1", "y2").collect()}
    assert some == {f for f in fronts if f[0] is not None}

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skyfront.operators import campaign, pareto
from skyfront.operators.cards import _area_gain


def objective_table(spark, rows):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rows)], "id bigint, y1 double, y2 double")


def mask(spark, rows, **options):
    got = pareto.pareto_mask(objective_table(spark, rows), "y1", "y2", "id", **options).collect()
    return [r.on_front for r in sorted(got, key=lambda r: r.id)]


TOY = [(0.2, 0.8), (0.4, 0.6), (0.6, 0.4), (0.8, 0.2), (0.5, 0.5), (0.3, 0.3)]


@pytest.mark.parametrize(
    ("rows", "wanted"),
    [
        (TOY, [True] * 5 + [False]),
        ([(2, 2), (1, 1), (0, 3), (3, 0)], [True, False, True, True]),
        ([(0, 3), (1, 2), (2, 1), (3, 0)], [True] * 4),
        ([(10, 10), (1, 1), (2, 2), (3, 3)], [True, False, False, False]),
        ([(1, 1), (1, 2), (1, 2)], [False, True, True]),
    ],
)
def test_fronts(spark, rows, wanted):
    assert mask(spark, rows, keep_duplicates=True) == wanted


def test_only_the_first_copy_counts_by_default(spark):
    assert mask(spark, [(1, 2), (1, 2), (0, 0)]) == [True, False, False]


def test_nulls_are_on_no_front(spark):
    df = spark.createDataFrame([(0, 1.0, None), (1, None, 9.0), (2, 0.5, 0.5)], "id bigint, y1 double, y2 double")
    assert [r.id for r in pareto.skyline(df, "y1", "y2").collect()] == [2]


def brute(rows):
    return {p for p in rows if not any(q[0] >= p[0] and q[1] >= p[1] and q != p for q in rows)}


def test_fronts_by_group_against_brute_force(spark):
    r = random.Random(1)
    rows = [(i, r.choice("ab"), float(r.randrange(30)), float(r.randrange(30))) for i in range(500)]
    df = spark.createDataFrame(rows, "id bigint, g string, y1 double, y2 double")
    got = {(x.g, x.y1, x.y2) for x in pareto.front_values(df, "y1", "y2", ["g"], salts=7).collect()}
    assert got == {(g, *p) for g in "ab" for p in brute({(a, b) for _, h, a, b in rows if h == g})}


def test_more_objectives_against_brute_force(spark):
    r = np.random.default_rng(2)
    y = r.integers(0, 12, (300, 3)).astype(float)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(y)], "id bigint, a double, b double, c double").repartition(5)
    wanted = {i for i in range(len(y)) if not ((y >= y[i]).all(1) & (y > y[i]).any(1)).any()}
    assert {x.id for x in pareto.skyline_nd(df, ["a", "b", "c"], "id").collect()} == wanted


@pytest.mark.parametrize(
    ("rows", "ref", "hv"),
    [(TOY, (0, 0), 0.41), (TOY, (-0.05, -0.05), 0.4925), ([(2, 3)], (0, 0), 6), ([(2, 3)], (-1, -1), 12), ([(1, 3), (3, 1)], (0, 0), 5), ([(1, 3), (3, 1), (0.5, 0.5)], (0, 0), 5), ([(1, 3), (2, 2), (3, 1)], (0, 0), 6), ([(-1, 5)], (0, 0), 0), ([], (0, 0), 0)],
)
def test_hypervolume(spark, rows, ref, hv):
    assert pareto.hypervolume(objective_table(spark, rows), "y1", "y2", ref).first().hv == pytest.approx(hv)
    assert pareto.slices(np.array(rows, float).reshape(-1, 2), np.array(ref, float)) == pytest.approx(hv)


def test_hypervolume_of_three_objectives(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0, 1.0), (1, 2.0, 0.5, 0.5), (2, 0.1, 0.1, 0.1)], "id bigint, a double, b double, c double")
    assert pareto.hypervolume_nd(df, ["a", "b", "c"], (0, 0, 0), "id").first().hv == pytest.approx(1 + 0.25)


points = st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=12)


@settings(max_examples=60, deadline=None)
@given(points, st.tuples(st.integers(0, 9), st.integers(0, 9)))
def test_area_gain_is_the_difference_of_hypervolumes(rows, new):
    y, ref = np.array(rows, float), (-0.5, -0.5)
    gain = _area_gain(np.array([new], float), y, ref)[0]
    before = campaign.front_area(y, ref)
    after = campaign.front_area(np.concatenate((y, [new])), ref)
    assert gain == pytest.approx(after - before, abs=1e-9)


@settings(max_examples=60, deadline=None)
@given(points)
def test_local_fronts_match_brute_force(rows):
    kept = {tuple(map(int, rows[i])) for i in pareto._undominated(np.array(rows, float))}
    assert kept == brute(set(rows))


def history(spark, values):
    return spark.createDataFrame([("t", i, float(v)) for i, v in enumerate(values)], "team string, rnd int, hv double")


@pytest.mark.parametrize(("values", "wanted"), [([0, 1, 2, 3], 1.5), ([7], 7.0)])
def test_area_under_the_history(spark, values, wanted):
    assert pareto.auc(history(spark, values), "team", "rnd").first().auc_hv == pytest.approx(wanted)
    assert campaign.area_under(values) == pytest.approx(wanted)
    assert campaign.area_under([]) == 0


def test_staircase(spark):
    got = [(r.x, r.y) for r in pareto.staircase(objective_table(spark, [(0.9, 0.5), (0.6, 0.95)]), "y1", "y2").orderBy("step").collect()]
    assert got == [(0.6, 0.95), (0.6, 0.5), (0.9, 0.5)]
    assert [(r.x, r.y) for r in pareto.staircase(objective_table(spark, [(1, 2)]), "y1", "y2").collect()] == [(1.0, 2.0)]
    assert pareto.staircase(objective_table(spark, []), "y1", "y2").count() == 0


def test_cumulative_history_against_brute_force(spark):
    r = random.Random(3)
    rows = [(r.randrange(3), r.randrange(5), r.random(), r.random()) for _ in range(60)]
    df = spark.createDataFrame(rows, "team bigint, rnd int, y1 double, y2 double")
    for x in pareto.hv_history(df, "team", "rnd", "y1", "y2", (0.1, 0.1)).collect():
        y = np.array([p[2:] for p in rows if p[0] == x.team and p[1] <= x.rnd])
        assert x.hv == pytest.approx(campaign.front_area(y, (0.1, 0.1)))


def test_running_front_of_a_stream(spark, tmp_path):
    from skyfront.streaming.front import RunningFront

    r = random.Random(4)
    rows = [(r.choice("ab"), float(r.randrange(50)), float(r.randrange(50))) for _ in range(300)]
    schema = "g string, y1 double, y2 double"
    for k in range(3):
        spark.createDataFrame(rows[k * 100 : (k + 1) * 100], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    front = RunningFront(spark, f"{tmp_path}/state", "y1", "y2", ["g"])
    front.start(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), f"{tmp_path}/progress").awaitTermination()
    assert front.version == 2
    assert {tuple(x) for x in front.current().collect()} == {(g, *p) for g in "ab" for p in brute({(a, b) for h, a, b in rows if h == g})}
    front.merge(spark.createDataFrame([("a", 1e9, 1e9)], schema), 1)
    assert front.current().where("y1 > 1000").count() == 0


def test_running_front_goes_on_after_a_restart(spark, tmp_path):
    from skyfront.streaming.front import RunningFront

    schema = "y1 double, y2 double"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for rows in ([(9.0, 9.0)], [(1.0, 1.0), (2.0, 10.0)], [(3.0, 3.0)]):
        put(rows)
        front = RunningFront(spark, f"{tmp_path}/state", "y1", "y2")  # a new process each time
        front.start(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/progress").awaitTermination()
    assert front.version == 2
    assert {tuple(x) for x in front.current().collect()} == {(9.0, 9.0), (2.0, 10.0)}
    # a version whose writing broke off is not gone on from; versions before the last two are deleted
    import os
    import shutil

    assert sorted(os.listdir(f"{tmp_path}/state")) == ["front-1", "front-2"]
    os.makedirs(f"{tmp_path}/state/front-3")
    assert RunningFront(spark, f"{tmp_path}/state", "y1", "y2").version == 2
    shutil.rmtree(f"{tmp_path}/state")
    assert RunningFront(spark, f"{tmp_path}/state", "y1", "y2").version is None


@pytest.mark.parametrize("m", [3, 4])
def test_front_of_many_blocks_and_its_volume_against_brute_force(spark, m):
    r = random.Random(m)
    rows = [(i, *(float(r.randrange(12)) for _ in range(m))) for i in range(240)]
    names = ["a", "b", "c", "d"][:m]
    df = spark.createDataFrame(rows, "id bigint, " + ", ".join(f"{n} double" for n in names)).repartition(7)
    beats = lambda p, q: all(x >= y for x, y in zip(p[1:], q[1:], strict=True)) and p[1:] != q[1:]
    wanted = {q[0] for q in rows if not any(beats(p, q) for p in rows)}
    for block in (4096, 16):
        assert {x.id for x in pareto.skyline_nd(df, names, "id", block).collect()} == wanted
    # unit cubes below some point: the volume is their number
    cubes = set()
    for p in rows:
        if all(x > 1 for x in p[1:]):
            cubes |= set(itertools.product(*(range(1, int(x)) for x in p[1:])))
    assert pareto.hypervolume_nd(df, names, (1.0,) * m, "id").first().hv == pytest.approx(len(cubes))
    assert pareto.hypervolume_nd(df.limit(0), names, (1.0,) * m, "id").first().hv == 0

"""Sampler, boxes, gradients, and campaigns in lock-step."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skyfront.config import Settings
from skyfront.operators import campaign, cards, pareto, sobol, surrogate
from skyfront.operators.boxes import Boxes
from skyfront.operators.climb import climb
from skyfront.plans import bindings


@pytest.mark.parametrize("k", [0, 1, 4, 7])
def test_every_projection_hits_each_cell_once(k):
    for seed in (0, 123):
        u = sobol.points(1 << k, 70, seed)
        assert ((u > 0) & (u < 1)).all()
        for d in range(70):
            assert sorted((u[:, d] * (1 << k)).astype(int).tolist()) == list(range(1 << k))


def test_points_depend_on_seed_and_dimension_alone():
    a = sobol.points(33, 9, 5)
    assert np.array_equal(a[:, :4], sobol.points(33, 4, 5)) and np.array_equal(a[:20], sobol.points(20, 9, 5))
    assert not np.array_equal(a, sobol.points(33, 9, 6))
    z = cards.base_samples(16, 5, 2, 1)
    assert np.array_equal(z[:, :3], cards.base_samples(16, 3, 2, 1))


def test_two_dimensions_are_even_together():
    u = sobol.points(256, 2, 3)
    assert set(np.bincount((u[:, 0] * 16).astype(int) * 16 + (u[:, 1] * 16).astype(int), minlength=256).tolist()) == {1}


def test_primitive_polynomials_are_as_many_as_there_are():
    """phi(2^d - 1) / d of degree d."""
    for d, n in ((1, 1), (2, 1), (3, 2), (4, 2), (5, 6), (6, 6), (7, 18), (8, 16), (9, 48)):
        assert sum(sobol.is_primitive(p) for p in range(1 << d, 2 << d)) == n


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 4), st.lists(st.tuples(*[st.integers(-1, 5)] * 4), max_size=9), st.lists(st.tuples(*[st.integers(-1, 6)] * 4), min_size=1, max_size=4))
def test_gain_is_the_difference_of_hypervolumes(m, front, new):
    f, y, ref = np.array(front, float).reshape(-1, 4)[:, :m], np.array(new, float)[:, :m], np.zeros(m)
    boxes = Boxes(ref).take(f)
    for row, gain in zip(y, boxes.gain(y)):
        assert gain == pytest.approx(pareto.volume(np.concatenate((f, row[None])), ref) - pareto.volume(f, ref))
    one_by_one = Boxes(ref)
    for p in f:
        one_by_one.add(p)
    assert np.allclose(one_by_one.gain(y), boxes.gain(y))


def test_boxes_are_disjoint():
    rng = np.random.default_rng(1)
    front = rng.random((12, 3))
    boxes = Boxes((0.0, 0.0, 0.0)).take(front)
    z = rng.random((2000, 3)) * 1.2
    inside = ((z[:, None] >= boxes.low) & (z[:, None] < boxes.high)).all(2).sum(1)
    beaten = (z[:, None] < front[None]).all(2).any(1)
    assert (inside[~beaten] == 1).all() and (inside[beaten] == 0).all()


def test_slopes_of_gains():
    rng = np.random.default_rng(2)
    for m in (2, 3, 4):
        boxes, y = Boxes([0.0] * m).take(rng.random((8, m))), rng.random((6, m)) * 1.3
        for k in range(m):
            e = np.eye(m)[k] * 1e-6
            assert np.allclose(boxes.slope(y)[:, k], (boxes.gain(y + e) - boxes.gain(y - e)) / 2e-6, atol=1e-6)


def measured(m, n=14, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.random((n, 4))
    y = np.stack([np.sin(3 * x[:, 0] + k) + x[:, k % 4] ** 2 - 0.4 * x[:, (k + 1) % 4] for k in range(m)], 1) + 0.02 * rng.normal(size=(n, m))
    return x, y


def test_evidence_gradient():
    x, y = measured(1)
    z = (y[:, 0] - y[:, 0].mean()) / y[:, 0].std()
    for fixed in (None, np.full(len(x), 0.01)):
        f = surrogate.posterior_mode(x, z, fixed)
        for h in np.random.default_rng(0).normal(0, 1, (5, 5)):
            slope = f(h)[1]
            for k in range(5):
                e = np.eye(5)[k] * 1e-5
                assert slope[k] == pytest.approx((f(h + e)[0] - f(h - e)[0]) / 2e-5, rel=1e-4, abs=1e-5)


def by_search(f, d, tries=160, seed=0):
    """Seeded tries, then steps along the axes: what the gradient must not fall short of."""
    r = np.random.default_rng(seed)
    trial = np.concatenate((r.uniform(-2, 2.5, (tries, 1)) + r.normal(0, 0.6, (tries, d)), r.uniform(-8, -0.5, (tries, 1))), 1)
    h, best, step = max(trial, key=lambda t: f(t)[0]).copy(), max(f(t)[0] for t in trial), 0.5
    while step > 0.03:
        moved = False
        for k in range(d + 1):
            for s in (step, -step):
                g = h.copy()
                g[k] += s
                if (v := f(g)[0]) > best + 1e-9:
                    h, best, moved = g, v, True
        step = step if moved else step / 2
    return best


@pytest.mark.parametrize("seed", range(6))
def test_fit_reaches_the_searchs_evidence(seed):
    x, y = measured(2, 12 + 4 * seed, seed)
    model = surrogate.fit(x, y)
    for j, p in enumerate(model.parts):
        f = surrogate.posterior_mode(p.x, (y[:, j] - p.mean) / p.scale, None)
        found = f(np.log(np.append(p.length, p.noise[0])))[0]
        assert found >= by_search(f, x.shape[1], seed=j) - 1e-6


def acquisition(name, m, samples=16):
    x, y = measured(m)
    return cards.build(name, surrogate.fit(x, y), x, y, [-1.0] * m, 5, samples=samples)


@pytest.mark.parametrize(("name", "m"), [("nehvi", 2), ("nehvi", 3), ("nehvi", 4), ("parego", 2), ("parego", 3)])
def test_gradient_of_the_sampled_acquisition(name, m):
    acq, rng = acquisition(name, m), np.random.default_rng(8)
    for chosen in (np.empty((0, 4)), rng.random((2, 4))):
        score = acq.scorer(chosen)
        x = rng.random((5, 4))
        value, slope = score.slopes(x)
        assert np.allclose(value, score(x))
        for k in range(4):
            e = np.eye(4)[k] * 1e-6
            assert np.allclose(slope[:, k], (score(x + e) - score(x - e)) / 2e-6, rtol=1e-3, atol=1e-4)


def test_boxes_are_carried_on_with_pending_picks():
    acq, chosen = acquisition("nehvi", 3), np.random.default_rng(4).random((3, 4))
    x = np.random.default_rng(5).random((40, 4))
    for k in range(4):
        carried = acq.scorer(chosen[:k])
        fresh = cards.Scorer(acq, chosen[:k])
        assert np.allclose(carried(x), fresh(x), rtol=1e-6, atol=1e-9)
    assert np.allclose(acq.scorer(chosen[1:2])(x), cards.Scorer(acq, chosen[1:2])(x))


def test_score_is_the_mean_gain_over_samples():
    acq = acquisition("nehvi", 3, samples=8)
    score, x = acq.scorer(np.empty((0, 4))), np.random.default_rng(6).random((4, 4))
    values, _ = score._values(x)
    base, _ = score._values(acq.base_x)  # at the measured rows the samples are the base's own
    for r in range(4):
        gains = [pareto.volume(np.concatenate((base[s], values[s, r][None])), np.full(3, -1.0)) - pareto.volume(base[s], np.full(3, -1.0)) for s in range(8)]
        assert score(x)[r] == pytest.approx(np.mean(gains), rel=0.02, abs=0.01)


@pytest.mark.parametrize("name", ["nehvi", "parego"])
def test_continuous_is_never_below_steps_along_the_axes(spark, name):
    acq, low, high = acquisition(name, 2), np.zeros(4), np.ones(4)
    score = acq.scorer(np.empty((0, 4)))
    starts = np.random.default_rng(1).random((12, 4))
    plain = score(cards._along_axes(score, starts.copy(), low, high))
    points, values = cards.refined(score, starts, low, high)
    assert (values >= plain - 1e-12).all() and (values > plain + 1e-9).any()
    assert ((points >= 0) & (points <= 1)).all() and np.allclose(score(points), values)
    by_tasks = cards._refined_by_tasks(spark, score, starts, low, high)
    assert np.allclose(by_tasks[0], points) and np.allclose(by_tasks[1], values)


def test_climb_in_a_box():
    f = lambda x: (-((x - 2.0) ** 2 * [1, 50, 1]).sum(), -2 * (x - 2.0) * [1, 50, 1])
    x, v = climb(f, np.zeros(3), np.zeros(3), np.array([5.0, 5.0, 1.0]))
    assert np.allclose(x, [2, 2, 1], atol=1e-5) and v == pytest.approx(-1)


def pool_of(spark, n=60):
    rng = np.random.default_rng(0)
    pool = spark.createDataFrame([(i, rng.random(5).tolist()) for i in range(n)], "id bigint, x array<double>").repartition(3)
    return pool, campaign.Oracle(campaign.true_objectives(pool, bindings.LANDSCAPE), (0.05, 0.05), 1)


def test_lock_step_gives_the_runs_of_one_after_another(spark):
    pool, oracle = pool_of(spark)
    few = Settings(n_rounds=2)
    runs = [(name, plans[:2], seed) for name, plans in campaign.default_strategies().items() for seed in (123, 124)]
    together = campaign.run_together(runs, pool, oracle, list(range(8)), few)
    for (name, plans, seed), h in zip(runs, together):
        alone = campaign.run_campaign(name, plans, pool, oracle, list(range(8)), seed, few)
        assert h["selected_ids"] == alone["selected_ids"] and np.allclose(h["hv_history"], alone["hv_history"]) and h["embedding_diversity"] == pytest.approx(alone["embedding_diversity"])


def test_jobs_do_not_grow_with_campaigns(spark):
    pool, oracle = pool_of(spark)
    few, plans = Settings(n_rounds=2), [{"nehvi": 2, "random": 2}] * 2
    tracker, used = spark.sparkContext.statusTracker(), []
    for n in (1, 4):
        spark.sparkContext.setJobGroup(f"lock-step-{n}", "")
        campaign.run_together([("t", plans, seed) for seed in range(n)], pool, oracle, list(range(8)), few)
        used.append(len(tracker.getJobIdsForGroup(f"lock-step-{n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert used[1] <= used[0] + 2, used

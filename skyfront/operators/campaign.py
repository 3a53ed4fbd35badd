"""Campaigns over a finite pool, their scores, sweeps, leaderboards and the final reveal.

The driver owns the loop; its state is a few dozen rows. Executors score pools. Measured values
are a table drawn once, so looking an id up again gives the same value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.vectors import dot, literal, squared_distance
from ..sources.scratch import written
from . import pareto, stats
from .cards import SELECTORS, answered, check_plan, propose, proposing
from .surrogate import fit


def objectives(pool: DataFrame, params: Mapping) -> DataFrame:
    """``pool(id, x)`` to raw (id, y1, y2): a linear trend and Gaussian bumps for each objective."""
    raw = [dot("x", literal(params["a1"])), dot("x", literal(params["a2"]))]
    for bump in params["bumps"]:
        shape = F.lit(float(bump["height"])) * F.exp(-squared_distance("x", literal(bump["center"])) / F.lit(2.0 * bump["width"] ** 2))
        raw = [y + F.lit(float(w)) * shape for y, w in zip(raw, bump["obj"], strict=True)]
    return pool.select("id", raw[0].alias("y1"), raw[1].alias("y2"))


def true_objectives(pool: DataFrame, params: Mapping) -> DataFrame:
    """Objectives scaled to [0, 1] over the pool."""
    return stats.minmax(objectives(pool, params), ["y1", "y2"])


def with_noise(truth: DataFrame, sigma: Sequence[float], seed: int) -> DataFrame:
    """(id, y1, y2) with Gaussian noise, a function of seed and id alone: re-reading a row, on any
    executor and in any order, draws the same value. Two hashes give uniforms, these a normal
    (Box and Muller)."""

    def normal(k: int):
        u = [(F.pmod(F.xxhash64(F.lit(seed), F.lit(2 * k + j), F.col("id")), F.lit(1 << 40)) + 0.5) / F.lit(float(1 << 40)) for j in (0, 1)]
        return F.sqrt(-2.0 * F.log(u[0])) * F.cos(u[1] * (2 * np.pi))

    return truth.select("id", *((F.col(f"y{k + 1}") + F.lit(float(s)) * normal(k)).alias(f"y{k + 1}") for k, s in enumerate(sigma)))


class Oracle:
    """Lookups of measured values; the true ones only where they are allowed."""

    def __init__(self, truth: DataFrame, sigma: Sequence[float] = DEFAULTS.noise_sigma, seed: int = DEFAULTS.seed, allow_true: bool = False):
        self._truth, self._allow = truth, allow_true
        # looked up every round: written once, so that the objectives are not computed again
        self._observed, _ = written(with_noise(truth, sigma, seed), "observed")

    def _rows(self, table: DataFrame, ids: Sequence[int]) -> np.ndarray:
        ids = [int(i) for i in ids]
        found = {r.id: (r.y1, r.y2) for r in table.where(F.col("id").isin(sorted(set(ids)))).collect()}
        if missing := [i for i in ids if i not in found]:
            raise IndexError(f"no rows {missing}")
        return np.array([found[i] for i in ids], float).reshape(len(ids), 2)

    def evaluate(self, ids: Sequence[int]) -> np.ndarray:
        return self._rows(self._observed, ids)

    def evaluate_true(self, ids: Sequence[int]) -> np.ndarray:
        return self._rows(self.true_table(), ids)

    def true_table(self) -> DataFrame:
        if not self._allow:
            raise PermissionError("this oracle does not give true objectives")
        return self._truth


def front_area(y: np.ndarray, ref: Sequence[float]) -> float:
    return float(pareto.slices(np.asarray(y, float), np.asarray(ref, float)))


def front_mask(y: np.ndarray) -> np.ndarray:
    """On the front, of equal points the first."""
    keep, seen = np.zeros(len(y), bool), set()
    for i in pareto._undominated(np.asarray(y, float)).tolist():
        if tuple(y[i]) not in seen:
            seen.add(tuple(y[i]))
            keep[i] = True
    return keep


def area_under(history: Sequence[float]) -> float:
    h = list(history)
    return 0.0 if not h else h[0] if len(h) == 1 else float(sum((a + b) / 2 for a, b in zip(h[:-1], h[1:], strict=True)) / (len(h) - 1))


def diversity(x: np.ndarray) -> float:
    if len(x) < 2:
        return 0.0
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    return float(d[np.triu_indices(len(x), 1)].mean())


class Campaign:
    """One round at a time: validate, fit, propose, measure, record."""

    def __init__(self, team: str, pool: DataFrame, oracle: Oracle, initial: Sequence[int], seed: int = DEFAULTS.seed, settings: Settings = DEFAULTS, optimize: str = "discrete", start: np.ndarray | None = None):
        self.team, self.pool, self.oracle, self.seed, self.settings, self.optimize = team, pool, oracle, seed, settings, optimize
        self.initial = [int(i) for i in initial]
        # start: the initial rows' values, where they are known already
        self.observed, self.y = list(self.initial), oracle.evaluate(initial) if start is None else np.array(start, float)
        self.hv_history, self.rounds, self.selected = [front_area(self.y, settings.ref_point)], [], []
        self._x: dict[int, list[float]] = {}

    @property
    def round_index(self) -> int:
        return len(self.rounds)

    @property
    def rounds_left(self) -> int:
        return self.settings.n_rounds - self.round_index

    @property
    def current_hv(self) -> float:
        return self.hv_history[-1]

    def rows(self, ids: Sequence[int]) -> np.ndarray:
        if new := [i for i in ids if i not in self._x]:
            self._x |= {r.id: list(r.x) for r in self.pool.where(F.col("id").isin(new)).select("id", "x").collect()}
        return np.array([self._x[i] for i in ids], float)

    def _fitted(self, plan: Mapping[str, int]):
        """The measured rows, and a model of them unless no card of the plan needs one, those without
        slots included."""
        if self.rounds_left <= 0:
            raise RuntimeError("all rounds are played; finalize() scores them")
        check_plan(plan, self.settings.batch_size)
        x = self.rows(self.observed)
        return x, fit(x, self.y) if any(name not in SELECTORS or SELECTORS[name].needs_model for name in plan) else None

    def play_round(self, plan: Mapping[str, int]) -> dict:
        x, model = self._fitted(plan)
        ids = propose(plan, model, self.pool, self.observed, x, self.y, self.settings.ref_point, self.seed + self.round_index, self.optimize, self.settings.projection, self.settings.latent_dim)
        return self.record(plan, ids, self.oracle.evaluate(ids))

    def proposing(self, plan: Mapping[str, int]):
        """The round's proposal as a conversation (see :func:`cards.proposing`)."""
        x, model = self._fitted(plan)
        return proposing(plan, model, self.observed, x, self.y, self.settings.ref_point, self.seed + self.round_index)

    def record(self, plan: Mapping[str, int], ids: Sequence[int], y: np.ndarray) -> dict:
        self.observed += ids
        self.selected += ids
        self.y = np.concatenate((self.y, y))
        self.hv_history.append(front_area(self.y, self.settings.ref_point))
        record = {"round": self.round_index, "plan": dict(plan), "ids": list(ids), "Y": y.tolist(), "hv": self.hv_history[-1]}
        self.rounds.append(record)
        return record

    def finalize(self) -> dict:
        if self.rounds_left:
            raise RuntimeError(f"{self.rounds_left} rounds are left to play")
        return {
            "team_name": self.team, "seed": self.seed, "batch_size": self.settings.batch_size, "n_rounds": self.settings.n_rounds, "projection_method": self.settings.projection,
            "strategy": [dict(r["plan"]) for r in self.rounds], "rounds": self.rounds, "hv_history": self.hv_history, "selected_ids": self.selected, "final_Y": self.y.tolist(), "n_initial": len(self.initial),
            "auc_hv": area_under(self.hv_history), "final_hv": self.hv_history[-1], "n_nondominated_selected": int(front_mask(self.y)[len(self.initial) :].sum()), "embedding_diversity": diversity(self.rows(self.selected)),
        }

    # what plots show
    def hv_curve(self) -> list[tuple[int, float]]:
        return list(enumerate(self.hv_history))

    def points(self, spark: SparkSession) -> DataFrame:
        """(pos, round, y1, y2), the initial design as round 0."""
        q, n = self.settings.batch_size, len(self.initial)
        rows = [(i, 0 if i < n else (i - n) // q + 1, float(a), float(b)) for i, (a, b) in enumerate(self.y)]
        return spark.createDataFrame(rows, "pos bigint, round int, y1 double, y2 double")

    def fronts_by_round(self, spark: SparkSession) -> DataFrame:
        p = self.points(spark).withColumn("team", F.lit(self.team))
        return pareto.skyline(pareto.cumulative_rounds(p, "team", "round", "y1", "y2"), "y1", "y2", ["team", "round"]).drop("team")


def _check_strategy(strategy: Sequence[Mapping[str, int]], settings: Settings) -> None:
    if len(strategy) != settings.n_rounds:
        raise ValueError(f"a strategy has {settings.n_rounds} plans, this one {len(strategy)}")
    for plan in strategy:
        check_plan(plan, settings.batch_size)


def run_campaign(team: str, strategy: Sequence[Mapping[str, int]], pool: DataFrame, oracle: Oracle, initial: Sequence[int], seed: int = DEFAULTS.seed, settings: Settings = DEFAULTS) -> dict:
    """All plans are checked before the first round."""
    _check_strategy(strategy, settings)
    c = Campaign(team, pool, oracle, initial, seed, settings)
    for plan in strategy:
        c.play_round(plan)
    return c.finalize()


def run_together(runs: Sequence[tuple[str, Sequence[Mapping[str, int]], int]], pool: DataFrame, oracle: Oracle, initial: Sequence[int], settings: Settings = DEFAULTS) -> list[dict]:
    """Campaigns (team, strategy, seed) from one start, in lock-step, each as :func:`run_campaign` has it.

    In a round all of them propose at once: what their cards ask for next is answered by one pass over
    the pool, which scores every campaign's model, until none asks any more; one lookup then measures
    all picks. So the number of jobs hangs on rounds and slots, not on the number of campaigns.
    """
    for _, strategy, _ in runs:
        _check_strategy(strategy, settings)
    if not runs:
        return []
    first = Campaign(runs[0][0], pool, oracle, initial, runs[0][2], settings)
    known = dict(zip(first.observed, first.rows(first.observed).tolist(), strict=True))
    every = [Campaign(team, pool, oracle, initial, seed, settings, start=first.y) for team, _, seed in runs]
    for k in range(settings.n_rounds):
        plans = [strategy[k] for _, strategy, _ in runs]
        for c in every:
            c._x |= known
        talks = [c.proposing(plan) for c, plan in zip(every, plans, strict=True)]
        picks: dict[int, list[int]] = {}
        replies: dict[int, list | None] = dict.fromkeys(range(len(talks)))
        while replies:
            asks = {}
            for i, reply in replies.items():
                try:
                    asks[i] = talks[i].send(reply)
                except StopIteration as end:
                    picks[i] = end.value
            found = answered(pool, list(asks.values())) if asks else []
            replies = dict(zip(asks, found, strict=True))
            known |= {i: x for rows in found for i, x in rows if x is not None}
        wanted = [i for own in picks.values() for i in own]
        measured = dict(zip(wanted, oracle.evaluate(wanted), strict=True))
        for i, c in enumerate(every):
            c.record(plans[i], picks[i], np.array([measured[j] for j in picks[i]], float).reshape(-1, c.y.shape[1]))
    for c in every:
        c._x |= known
    return [c.finalize() for c in every]


def default_strategies(rounds: int = DEFAULTS.n_rounds) -> dict[str, list[dict[str, int]]]:
    """The seven strategies of a sweep, the last plan repeated to fill the rounds."""
    two = {"scalarized_0.8_0.2": 2, "scalarized_0.2_0.8": 2}
    menu = {
        "all_nehvi": [{"nehvi": 4}],
        "all_parego": [{"parego": 4}],
        "all_scalarized_0.8_0.2": [{"scalarized_0.8_0.2": 4}],
        "scalarization_sweep": [two, two, {"scalarized_0.5_0.5": 4}, {"scalarized_0.5_0.5": 4}, {"nehvi": 4}, {"nehvi": 4}],
        "explore_then_exploit": [{"random": 2, "parego": 2}, {"parego": 4}, {"nehvi": 2, "parego": 2}, {"nehvi": 4}],
        "mixed": [{"nehvi": 2, "parego": 2}, {"nehvi": 3, "random": 1}, two, {"nehvi": 2, "parego": 2}, {"nehvi": 4}],
        "random_baseline": [{"random": 4}],
    }
    return {k: (v + [v[-1]] * rounds)[:rounds] for k, v in menu.items()}


#: The six plans that are compared from one start.
COMPARED = {
    "nehvi": {"nehvi": 4},
    "parego": {"parego": 4},
    "scalarized_0.8_0.2": {"scalarized_0.8_0.2": 4},
    "scalarized_0.2_0.8": {"scalarized_0.2_0.8": 4},
    "nehvi+parego": {"nehvi": 2, "parego": 2},
    "nehvi+random": {"nehvi": 3, "random": 1},
}


def team_metrics(points: DataFrame, team: str, rnd: str, y1: str, y2: str, ref: tuple[float, float]) -> DataFrame:
    """By team, from its points by round: auc_hv, final_hv, mean_gain of a round, angular_spread and
    region_coverage of the points after the first round, and n_nondominated of them."""
    history = pareto.hv_history(points, team, rnd, y1, y2, ref)
    gains = pareto.hv_gain(history, team, rnd).groupBy(team).agg(F.coalesce(F.avg("gain"), F.lit(0.0)).alias("mean_gain"), F.max("hv").alias("final_hv"))
    first = points.groupBy(team).agg(F.min(rnd).alias("_r0"))
    later = points.join(first, team).where(F.col(rnd) > F.col("_r0"))
    front = pareto.skyline(points, y1, y2, [team]).join(first, team).groupBy(team).agg(F.count_if(F.col(rnd) > F.col("_r0")).alias("n_nondominated"))
    out = pareto.auc(history, team, rnd).join(gains, team).join(front, team)
    spread = stats.angular_spread(later, y1, y2, ref, [team]).withColumnRenamed("spread", "angular_spread")
    regions = stats.region_coverage(later, y1, y2, ref, [team]).withColumnRenamed("regions", "region_coverage")
    out = out.join(spread, team, "left").join(regions, team, "left")
    return out.select(team, "auc_hv", "final_hv", "mean_gain", F.coalesce("angular_spread", F.lit(0.0)).alias("angular_spread"), F.coalesce("region_coverage", F.lit(0)).alias("region_coverage"), "n_nondominated")


def sweep_facts(strategies: Mapping[str, Sequence[Mapping[str, int]]], pool: DataFrame, oracle: Oracle, initial: Sequence[int], seeds: Sequence[int], settings: Settings = DEFAULTS) -> DataFrame:
    """One row per strategy and seed with its run's scores; all runs go in lock-step."""
    spark = pool.sparkSession
    rows = []
    runs = [(name, plans, seed) for name, plans in strategies.items() for seed in seeds]
    for (name, _, seed), h in zip(runs, run_together(runs, pool, oracle, initial, settings), strict=True):
        y = np.array(h["final_Y"])[h["n_initial"] :]
        off = np.maximum(y - np.array(settings.ref_point), 1e-9)
        angle = np.arctan2(off[:, 1], off[:, 0])
        bins = np.floor(np.minimum(angle, np.pi / 2 - 1e-9) / (np.pi / 2) * 6)
        rows.append((name, seed, float(h["auc_hv"]), float(h["final_hv"]), float(angle.std(ddof=1)) if len(angle) > 1 else 0.0, len(set(bins.tolist())), h["embedding_diversity"], h["n_nondominated_selected"], [float(v) for v in h["hv_history"]]))
    return spark.createDataFrame(rows, "strategy string, seed int, auc_hv double, final_hv double, angular_spread double, region_coverage int, diversity double, n_nondominated int, hv_history array<double>")


def sweep_curves(facts: DataFrame) -> DataFrame:
    """What a sweep's plots show: by strategy and round the mean hypervolume over seeds, with its
    region coverage and mean AUC beside it."""
    curve = facts.select("strategy", F.posexplode("hv_history").alias("round", "hv")).groupBy("strategy", "round").agg(F.avg("hv").alias("hv_mean"))
    scores = facts.groupBy("strategy").agg(F.avg("region_coverage").alias("region_coverage_mean"), F.avg("auc_hv").alias("auc_hv_mean"))
    return curve.join(scores, "strategy")


def sweep_means(facts: DataFrame) -> DataFrame:
    """Means over seeds by strategy, and the AUCs by seed."""
    names = ("auc_hv", "final_hv", "angular_spread", "region_coverage", "diversity", "n_nondominated")
    by_seed = F.transform(F.array_sort(F.collect_list(F.struct("seed", "auc_hv"))), lambda s: s["auc_hv"])
    return facts.groupBy("strategy").agg(*(F.avg(n).alias(f"{n}_mean") for n in names), by_seed.alias("auc_hv_by_seed"))


def seed_winners(facts: DataFrame, order: str | None = None) -> DataFrame:
    """The best strategy of each seed; equal ones by ``order`` (their insertion), or by name."""
    w = W.partitionBy("seed").orderBy(F.desc("auc_hv"), order or "strategy")
    return facts.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("seed", "strategy", "auc_hv")


def wins_over(facts: DataFrame, base: str) -> DataFrame:
    """For each other strategy the seeds in which its AUC is above that of ``base``."""
    b = facts.where(F.col("strategy") == base).select("seed", F.col("auc_hv").alias("_b"))
    return facts.where(F.col("strategy") != base).join(b, "seed").groupBy("strategy").agg(F.count_if(F.col("auc_hv") > F.col("_b")).alias("wins"), F.count(F.lit(1)).alias("seeds"))


def criteria(facts: DataFrame, deterministic: bool, margin: Mapping[str, float], seconds: float, plots: int, achieved_hv: float, true_hv: float) -> DataFrame:
    """The acceptance list of a sweep: one row per criterion, the last for information."""
    spark = facts.sparkSession
    m = {r.strategy: r for r in sweep_means(facts).collect()}
    wins = {r.strategy: r.wins for r in wins_over(facts, "all_nehvi").collect()}
    winners = {r.strategy for r in seed_winners(facts).collect()}
    top = sorted((r.auc_hv_mean for r in m.values()), reverse=True)
    close = len(top) > 1 and (top[0] - top[1]) / (abs(top[0]) or 1.0) < 0.15
    nehvi, parego, fixed = m["all_nehvi"], m["all_parego"], m["all_scalarized_0.8_0.2"]
    rivals = ("mixed", "scalarization_sweep", "explore_then_exploit", "all_parego")
    rows = [
        ("1", "same seed, same run", deterministic, False),
        ("2", "nehvi beats random", nehvi.auc_hv_mean > m["random_baseline"].auc_hv_mean, False),
        ("3", "another strategy sometimes beats nehvi", any(wins.get(r, 0) for r in rivals), False),
        ("4", "fixed weights touch fewer regions than nehvi", fixed.region_coverage_mean < nehvi.region_coverage_mean, False),
        ("5", "parego touches more regions than fixed weights", parego.region_coverage_mean > fixed.region_coverage_mean, False),
        ("6", "the winner is open", len(winners) >= 2 or close, False),
        ("7", "a campaign takes under 60 s", seconds < 60, False),
        ("8", "plot data written", plots > 0, False),
        ("margin", "the q-th pick is clear", margin["abs_margin"] > 1e-3, False),
        ("9", f"achieved {achieved_hv:.4f} of {true_hv:.4f}", True, True),
    ]
    return spark.createDataFrame([(a, b, bool(c), d) for a, b, c, d in rows], "criterion string, what string, passed boolean, info boolean")


def compare_plans(plans: Mapping[str, Mapping[str, int]], pool: DataFrame, oracle: Oracle, initial: Sequence[int], seed: int = DEFAULTS.seed, settings: Settings = DEFAULTS) -> DataFrame:
    """One round of each plan from the same start: plan, hv_gain and the spread of the values it measured."""
    rows = []
    for name, plan in plans.items():
        c = Campaign(name, pool, oracle, initial, seed, settings)
        before = c.current_hv
        y = np.array(c.play_round(plan)["Y"])
        rows.append((name, float(c.current_hv - before), diversity(y)))
    return pool.sparkSession.createDataFrame(rows, "plan string, hv_gain double, spread double")


def leaderboard(scores: DataFrame) -> DataFrame:
    """rank, team_name, auc_hv, final_hv, n_nondominated_selected, embedding_diversity; all four
    scores descending, equal ones by name."""
    names = ["auc_hv", "final_hv", "n_nondominated_selected", "embedding_diversity"]
    ranked = stats.numbered(scores.select("team_name", *names), [*(F.desc(c) for c in names), "team_name"], "rank")
    return ranked.select(F.col("rank").cast("int").alias("rank"), "team_name", *names).orderBy("rank")


def objective_space(truth: DataFrame, initial: Sequence[int], ref: Sequence[float], bins: int = 40) -> DataFrame:
    """What the joint plot of ``truth(id, y1, y2)`` shows: rows (layer, step, x, y, n). Layers cell, top and
    right are counts by bin (x and y are its numbers); front is the true front's staircase, initial the
    design's rows, reference the point that areas start from, and rho the rank correlation (as x)."""
    spark = truth.sparkSession
    empty = {"step": F.lit(None).cast("int"), "x": F.lit(None).cast("double"), "y": F.lit(None).cast("double"), "n": F.lit(None).cast("bigint")}
    rows = lambda df, layer, **c: df.select(F.lit(layer).alias("layer") if isinstance(layer, str) else layer, *((c.get(k, v)).alias(k) for k, v in empty.items()))
    double = lambda c: F.col(c).cast("double")
    out = rows(stats.joint_plot(truth, "y1", "y2", bins), F.col("layer"), x=double("bx"), y=double("by_"), n=F.col("n"))
    steps = pareto.staircase(pareto.front_values(truth, "y1", "y2"), "y1", "y2")
    design = spark.createDataFrame([(k, int(i)) for k, i in enumerate(initial)], "step int, id bigint")
    shown = [
        rows(steps, "front", step=F.col("step"), x=double("x"), y=double("y")),
        rows(truth.join(F.broadcast(design), "id"), "initial", step=F.col("step"), x=double("y1"), y=double("y2")),
        rows(spark.createDataFrame([tuple(map(float, ref))], "x double, y double"), "reference", x=F.col("x"), y=F.col("y")),
        rows(stats.spearman(truth, "y1", "y2", "id"), "rho", x=F.col("rho")),
    ]
    for one in shown:
        out = out.unionByName(one)
    return out


def reveal(runs: DataFrame, truth: DataFrame, initial: Sequence[int] = ()) -> DataFrame:
    """(layer, x, y, step): the true front's staircase and each team's, over true values of the
    rows it measured."""
    spark = truth.sparkSession
    ids = runs.select("team_name", F.explode("selected_ids").alias("id"))
    if initial:
        start = spark.createDataFrame([(int(i),) for i in initial], "id bigint")
        ids = ids.unionByName(runs.select("team_name").join(F.broadcast(start)))
    points = ids.distinct().join(truth, "id")
    layers = points.select(F.col("team_name").alias("layer"), "y1", "y2").unionByName(truth.select(F.lit("true front").alias("layer"), "y1", "y2"))
    return pareto.staircase(pareto.front_values(layers, "y1", "y2", ["layer"]), "y1", "y2", ["layer"])


def verify_golden(ids: Sequence[int], expected: Sequence[int], y: np.ndarray, expected_y: np.ndarray, hv: tuple[float, float], expected_hv: tuple[float, float]) -> None:
    """Raises at the first of these that does not hold: ids, values, hypervolumes, growth."""
    assert list(ids) == list(expected), f"ids {list(ids)} are not {list(expected)}"
    np.testing.assert_allclose(y, expected_y, rtol=1e-5, atol=1e-6)
    np.testing.assert_allclose(hv, expected_hv, rtol=0, atol=1e-6)
    assert hv[1] >= hv[0], "hypervolume fell"

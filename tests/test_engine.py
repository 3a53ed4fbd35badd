import json
import math
import random

import numpy as np
import pytest

from skyfront.config import Settings
from skyfront.functions import text as fx
from skyfront.operators import campaign, cards, ingest, latents, pareto, select, stats, surrogate
from skyfront.plans.bindings import LANDSCAPE
from skyfront.sources import tables


def pool_of(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(rows)], "id bigint, x array<double>")


SQUARE = [(0, 0), (0, 1), (1, 0), (1, 1), (0.5, 0.5)]


# --- selection ---------------------------------------------------------------------


def test_nearest(spark):
    p = pool_of(spark, SQUARE)
    assert select.nearest([[0.1, 0.1]], p) == [0]
    assert select.nearest([0.1, 0.1], p) == [0]
    assert select.nearest([[0.1, 0.1]], p, {0}) == [4]
    assert select.nearest([[0.1, 0.1], [0.1, 0.1]], p) == [0, 4]
    assert select.nearest(SQUARE, p) == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        select.nearest([[0, 0]], p, range(5))


def test_diverse_nearest(spark):
    p = pool_of(spark, [(0, 0), (0.2, 0), (0, 1)])
    asked = [(0, 0), (0.15, 0.5)]
    assert select.nearest(asked, p) == [0, 1]
    assert select.diverse_nearest(asked, p) == [0, 2]
    with pytest.raises(KeyError):
        select.project(asked, p, method="other")


def test_farthest_points(spark):
    line = pool_of(spark, [(v,) for v in range(5)])
    assert select.farthest_points(line, 2, 0) == [0, 4]
    assert select.farthest_points(line, 3, 0) == [0, 4, 2]
    assert len(select.farthest_points(line, 99, 0)) == 5


def test_available_and_axis(spark):
    p = pool_of(spark, [(v, 0, 0, 0, 0) for v in (0, 0.2, 0.4, 0.6, 0.8, 1.0)])
    assert sorted(r.id for r in select.without(p, {0, 1, 5}).collect()) == [2, 3, 4]
    assert select.project([(0.05, 0, 0, 0, 0), (0.95, 0, 0, 0, 0)], p, {0, 1}, {5}) == [2, 4]


def test_balanced_and_small_clusters(spark):
    df = spark.createDataFrame(list(enumerate([0, 0, 0, 1, 1, 2])), "id bigint, label int")
    assert sorted(r.id for r in select.drop_small(df, "label", 3).collect()) == [0, 1, 2]
    six = spark.createDataFrame(list(enumerate([0, 0, 0, 1, 1, 1])), "id bigint, label int")
    got = [r.label for r in select.balanced(six, "label", "id", 4, seed=1).collect()]
    assert sorted(got) == [0, 0, 1, 1]


def test_curation_drops_a_rare_kind(spark):
    seqs = ["A" * 30 + "C" * i for i in range(10)] + ["K" * 30 + "R" * i for i in range(10)] + ["D" * 30 + "E" * i for i in range(10)] + ["W" * 40]
    rows = [(i, s, "src") for i, s in enumerate(seqs)] + [(99, seqs[0], "src")]
    got = select.curate(spark.createDataFrame(rows, "pos bigint, sequence string, source string"), 12, 1, clusters=4).collect()
    assert len(got) == 12 and len({r.sequence for r in got}) == 12 and not any("W" in r.sequence for r in got)
    assert sorted(r.sequence_id for r in got) == [f"VH-{i:05d}" for i in range(1, 13)]


def test_curation_reads_its_records_once(spark):
    seqs = ["A" * 30 + "C" * (i % 20) for i in range(60)] + ["K" * 30 + "R" * i for i in range(20)]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(i, s, None) for i, s in enumerate(seqs)], "pos bigint, sequence string, source string")
    got = select.curate(rows.mapInArrow(counted, rows.schema), 50, 1, clusters=2).collect()
    assert seen.value == 80
    assert sorted(r.sequence for r in got) == sorted(set(seqs)) and {r.source for r in got} == {"unknown"} and all(r.length == len(r.sequence) for r in got)


# --- statistics ----------------------------------------------------------------------


def test_distances(spark):
    p = pool_of(spark, [(0, 0), (0, 3), (4, 0)])
    d = stats.pair_distances(p, "id", "x").agg({"d": "min"}).first()[0]
    assert d == 3.0
    got = {r.id: r.d for r in stats.nearest_distances(p, "id", "x", block=1).collect()}
    assert got == {0: 3.0, 1: 3.0, 2: 4.0}
    assert stats.nearest_distances(p.where("id = 0"), "id", "x").first().d == 0


def test_ranks_against_numpy(spark):
    r = random.Random(1)
    rows = [(i, float(r.randrange(9)), r.random() + (i % 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double")

    def average(v):
        return np.array([np.mean([k + 1 for k, w in enumerate(sorted(v)) if w == x]) for x in v])

    a, b = ([x[k] for x in rows] for k in (1, 2))
    assert stats.spearman(df, "a", "b", "id").first().rho == pytest.approx(np.corrcoef(average(a), average(b))[0, 1])
    ranks = {x.id: x.n for x in stats.ordinal_rank(df, "a", "id", "n").collect()}
    assert [ranks[i] for _, i in sorted((x[1], x[0]) for x in rows)] == list(range(1, 401))


def test_pca_against_numpy(spark):
    x = np.random.default_rng(2).standard_normal((120, 7)) @ np.diag([5, 4, 3, 2, 1, 0.5, 0.1])
    z, shares = stats.pca(pool_of(spark, x).repartition(3), "id", "x", 3)
    got = np.array([r.z for r in sorted(z.collect(), key=lambda r: r.id)])
    c = x - x.mean(0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    w = vt[:3].T * np.where(vt[:3].T[np.abs(vt[:3].T).argmax(0), range(3)] < 0, -1, 1)
    assert np.allclose(got, c @ w, atol=1e-9)
    assert np.allclose(shares, (s**2 / (s**2).sum())[:3])


def test_scaling_of_constant_columns_and_bins(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert {tuple(r) for r in stats.zscore(df, ["a", "b"]).collect()} == {(-1.0, 0.0), (1.0, 0.0)}
    assert {tuple(r) for r in stats.minmax(df, ["a", "b"]).collect()} == {(0.0, 0.0), (1.0, 0.0)}
    h = {r.bin: r.n for r in stats.histogram(df, "a", 1.0, 3.0, 4).collect()}
    assert h == {0: 1, 3: 1}


def test_quantile_band_relaxes(spark):
    df = spark.createDataFrame([(i, float(i), float(i), i == 9) for i in range(10)], "id bigint, y1 double, y2 double, f boolean")
    size = lambda n: stats.quantile_band(df, "y1", "y2", "f", 0.6, n).count()
    assert (size(3), size(8), size(10)) == (6, 9, 10)


# --- records ---------------------------------------------------------------------------

BASE = {"meta_Species": "human", "meta_Chain": "Heavy", "meta_BSource": " PBMC ", "meta_BType": "Naive-B-Cells", "meta_Isotype": "IGHM", "productive": "T", "vj_in_frame": "true", "stop_codon": "F", "sequence_alignment_aa": "A" * 90 + "..-"}


@pytest.mark.parametrize(
    ("change", "ok"),
    [({}, True)] + [({k: v}, False) for k, v in (("meta_Species", "mouse"), ("meta_Chain", "light"), ("meta_BSource", "spleen"), ("meta_BType", "plasma"), ("meta_Isotype", "IGHE"), ("productive", "F"), ("vj_in_frame", None), ("stop_codon", "T"), ("sequence_alignment_aa", "A" * 89), ("sequence_alignment_aa", "A" * 151), ("sequence_alignment_aa", "X" * 100), ("meta_Species", None))],
)
def test_record_filter(spark, change, ok):
    row = {**BASE, **change}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
    got = ingest.filtered(df).collect()
    assert bool(got) == ok and (not ok or got[0].sequence == "A" * 90)


def test_early_stop_and_first_copies(spark):
    df = spark.createDataFrame(list(enumerate("aabcdaef")), "pos bigint, s string")
    from pyspark.sql import functions as F

    keep = F.col("s") != "b"
    assert [r.s for r in ingest.stop_early(df, "pos", keep, "s", 3).collect()] == ["a", "c", "d"]
    assert [r.s for r in ingest.stop_early(df, "pos", keep, "s", 9, most=4).collect()] == ["a", "c"]
    assert {(r.pos, r.s) for r in ingest.first_copies(df, ["s"], "pos").collect()} >= {(0, "a"), (2, "b")}


def test_shards():
    names = [f"s{i}" for i in range(100)]
    assert ingest.choose_shards(names, 10) == names[::10]
    assert ingest.choose_shards(names, 1000) == ingest.choose_shards(names, 0) == names


def test_model_backed_filter(spark):
    df = spark.createDataFrame([("ab",), ("b",)], "s string")
    assert [r.s for r in ingest.validated(df, "s", lambda texts: [t.startswith("a") for t in texts]).collect()] == ["ab"]


def test_expressions(spark):
    df = spark.createDataFrame([("T", " Ab-C.d ", "77.1%", "Team  One!"), ("no", None, "12", "__"), (None, "x", " 5% ", "")], "b string, s string, p string, n string")
    got = df.select(fx.to_bool("b").alias("b"), fx.clean_sequence("s").alias("s"), fx.percent("p").alias("p"), fx.slug("n").alias("n")).collect()
    assert [tuple(r) for r in got] == [(True, "ABCD", 77.1, "team_one"), (False, "", 12.0, "team"), (False, "X", 5.0, "team")]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cast"):
        spark.createDataFrame([("7x%",)], "p string").select(fx.percent("p")).collect()


def test_features(spark):
    row = spark.createDataFrame([("AACC",)], "s string").select(*fx.descriptors("s")).first()
    assert (row.f_a, row.f_c, row.aromatic, row.scaled_length) == (0.5, 0.5, 0.0, 0.04)
    assert row.hydropathy == pytest.approx((2 * 1.8 + 2 * 2.5) / 4)
    empty = spark.createDataFrame([("",)], "s string").select(*fx.composition("s")).first()
    assert set(empty) == {0.0}


# --- tables -----------------------------------------------------------------------------


def library(path, rows):
    path.write_text("sequence_id,sequence,length,source,cluster_id\n" + "\n".join(rows) + "\n")
    return str(path)


def test_library_contract(spark, tmp_path):
    good = library(tmp_path / "a.csv", ["VH-1,ACD,3,x,0", "VH-2,ACE,3,x,1"])
    assert tables.read_library(spark, good).count() == 2
    for rows, message in ((["VH-1,ACD,3,x,0", "VH-1,ACE,3,x,1"], "repeated"), (["VH-1,AXD,3,x,0"], "X")):
        with pytest.raises(tables.ContractError, match=message):
            tables.read_library(spark, library(tmp_path / "b.csv", rows))
    (tmp_path / "c.csv").write_text("sequence\nACD\n")
    with pytest.raises(tables.ContractError, match="missing"):
        tables.read_library(spark, str(tmp_path / "c.csv"))


def test_measurements(spark, tmp_path):
    heads = '"Sample ID",Seq,Germline,Germline_Identity%,Tm (oC),BV Elisa score,"Affinity, Kd (nM)",Yield (mg per 10 mL culture)'
    (tmp_path / "m.csv").write_text(heads + "\nAB-1, acd ,IGHV1,77.1%,49.5,0.32,37.8,0.24\n")
    row = tables.with_derived(tables.read_measurements(spark, str(tmp_path / "m.csv"), raw=True)).first()
    assert (row.sequence, row.length, row.germline_identity_pct, row.neg_bv) == ("ACD", 3, 77.1, -0.32)
    assert row.pkd == pytest.approx(-math.log10(37.8e-9))


def test_matrices(spark, tmp_path):
    np.save(tmp_path / "x.npy", np.array([[0.0, 1.0], [0.5, 0.5]]))
    df = tables.read_matrix(spark, str(tmp_path / "x.npy"), 2, unit_range=True)
    assert [(r.id, list(r.x)) for r in df.orderBy("id").collect()] == [(0, [0.0, 1.0]), (1, [0.5, 0.5])]
    with pytest.raises(tables.ContractError):
        tables.check_matrix(pool_of(spark, [(0.0, 2.0)]), 2, unit_range=True)


def test_initial_design_and_empty_runs(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({"seed": 123, "initial_ids": [5, 3, 9]}, indent=1))
    assert [(r.pos, r.id) for r in tables.read_initial(spark, str(tmp_path / "i.json")).orderBy("pos").collect()] == [(0, 5), (1, 3), (2, 9)]
    assert tables.read_runs(spark, str(tmp_path / "none")).count() == 0


# --- cards, models, campaigns --------------------------------------------------------------


def test_plans():
    for plan in ({"nehvi": 2, "parego": 2}, {"scalarized_0.7_0.3": 4}, {"nehvi": 4, "random": 0}):
        cards.check_plan(plan, 4)
    for plan in ({"nehvi": 3}, {"teleport": 4}, {}, {"nehvi": -1, "random": 5}, {"nehvi": 4.0}):
        with pytest.raises(ValueError):
            cards.check_plan(plan, 4)
    grid = cards.scalarized_grid()
    assert len(grid) == 19 and all(abs(sum(cards.scalarized_weights(n)) - 1) < 1e-9 for n in grid)
    with pytest.raises(KeyError):
        cards.build("teleport", None, np.empty((0, 2)), np.empty((0, 2)), (0, 0), 1)


def test_surrogate_interpolates_and_is_unsure_elsewhere():
    r = np.random.default_rng(3)
    x = r.random((24, 2))
    y = np.stack((np.sin(3 * x[:, 0]), x.sum(1)), 1)
    model = surrogate.fit(x, y)
    mean, var = model.posterior(x)
    assert np.abs(mean - y).max() < 0.1
    assert model.posterior(np.array([[3.0, -3.0]]))[1].min() > var.max()
    with pytest.raises(ValueError):
        surrogate.fit(x, y[:-1])


@pytest.fixture(scope="module")
def setting(spark):
    r = np.random.default_rng(4)
    pool = pool_of(spark, r.random((80, 5))).repartition(2).cache()
    truth = campaign.true_objectives(pool, LANDSCAPE).cache()
    return pool, truth, campaign.Oracle(truth), list(range(12))


SHORT = Settings(n_rounds=2)


def test_oracle(setting):
    _, truth, oracle, _ = setting
    a = oracle.evaluate([3, 3, 5])
    assert (a[0] == a[1]).all() and (oracle.evaluate([5])[0] == a[2]).all()
    exact = campaign.Oracle(truth, allow_true=True).evaluate_true([3])
    assert 0 < np.abs(exact - a[:1]).max() < 0.25
    with pytest.raises(PermissionError):
        oracle.evaluate_true([1])
    with pytest.raises(IndexError):
        oracle.evaluate([-1])


@pytest.mark.parametrize("plan", [{"nehvi": 2, "parego": 1, "random": 1}, {"scalarized_0.8_0.2": 2, "uncertainty": 2}])
def test_campaign_invariants_and_determinism(setting, plan):
    pool, _, oracle, initial = setting
    runs = [campaign.run_campaign("T", [plan] * 2, pool, oracle, initial, settings=SHORT) for _ in range(2)]
    assert runs[0] == runs[1]
    h = runs[0]
    assert len(set(h["selected_ids"])) == 8 and not {*h["selected_ids"]} & {*initial}
    assert all(b >= a - 1e-9 for a, b in zip(h["hv_history"][:-1], h["hv_history"][1:], strict=True))
    c = campaign.Campaign("T", pool, oracle, initial, settings=SHORT)
    with pytest.raises(RuntimeError):
        c.finalize()
    c.play_round(plan)
    c.play_round(plan)
    assert c.finalize() == h
    with pytest.raises(RuntimeError):
        c.play_round(plan)


def test_model_guided_beats_random(setting):
    pool, _, oracle, initial = setting
    final = {n: campaign.run_campaign(n, [{n: 4}] * 2, pool, oracle, initial, settings=SHORT)["auc_hv"] for n in ("nehvi", "random")}
    assert final["nehvi"] > final["random"]


def test_continuous_points_improve_on_raw_ones(setting):
    pool, _, oracle, initial = setting
    c = campaign.Campaign("T", pool, oracle, initial, settings=SHORT)
    x = c.rows(initial)
    acq = cards.build("nehvi", surrogate.fit(x, c.y), x, c.y, (-0.05, -0.05), 1, samples=16)
    best = cards.optimize_continuous(acq, [(0, 1)] * 5, 2, restarts=3, raw=24)
    assert best.shape == (2, 5) and best.min() >= 0 and best.max() <= 1
    with pytest.raises(TypeError):
        cards.optimize_continuous("random", [(0, 1)] * 5, 1)


def test_runs_on_disk_leaderboard_and_reveal(spark, setting, tmp_path):
    pool, truth, oracle, initial = setting
    for name in ("Team A!", "team b"):
        h = campaign.run_campaign(name, [{"random": 4}] * 2, pool, oracle, initial, seed=len(name), settings=SHORT)
        tables.write_run(h, spark, str(tmp_path))
    runs = tables.read_runs(spark, str(tmp_path))
    assert runs.count() == 2
    board = campaign.leaderboard(runs).collect()
    assert [r["rank"] for r in board] == [1, 2] and board[0].auc_hv >= board[1].auc_hv
    points = tables.run_points(runs.where("team_name = 'team b'"))
    hv = pareto.hv_history(points.withColumnRenamed("team_name", "team"), "team", "round", "y1", "y2", (-0.05, -0.05)).orderBy("round").collect()
    assert [r.hv for r in hv] == pytest.approx(h["hv_history"])
    layers = {r.layer for r in campaign.reveal(runs, truth, initial).collect()}
    assert layers == {"Team A!", "team b", "true front"}


def test_sweep_and_criteria(spark):
    rows = [(s, k, 0.5 + 0.1 * i + 0.01 * k, 1.0, 0.1, 2 + i % 3, 0.3, 2) for i, s in enumerate(campaign.default_strategies()) for k in (1, 2)]
    facts = spark.createDataFrame(rows, "strategy string, seed int, auc_hv double, final_hv double, angular_spread double, region_coverage int, diversity double, n_nondominated int")
    assert campaign.sweep_means(facts).count() == 7
    got = campaign.criteria(facts, True, {"abs_margin": 0.5}, 5.0, 1, 0.9, 1.0).collect()
    assert len(got) == 10 and [r.criterion for r in got if r.info] == ["9"]
    assert {r.criterion: r.passed for r in got}["2"] is False


def test_golden_check():
    y = np.ones((1, 2))
    campaign.verify_golden([1], [1], y, y, (0.1, 0.2), (0.1, 0.2))
    with pytest.raises(AssertionError):
        campaign.verify_golden([2], [1], y, y, (0.1, 0.2), (0.1, 0.2))


def test_latents_span_the_unit_cube(spark):
    seqs = ["ACDE", "FGHI", "KLMN", "PQRS", "TVWY", "AACC", "DDEE", "FFGGHH"]
    df = spark.createDataFrame(list(enumerate(seqs)), "id bigint, sequence string")
    x, shares = latents.build_latents(df, 5)
    m = np.array([r.x for r in x.collect()])
    assert m.shape == (8, 5) and np.allclose(m.min(0), 0) and np.allclose(m.max(0), 1) and shares == sorted(shares, reverse=True)
    assert latents.check_latents(x, 5).count() == 8
    with pytest.raises(KeyError):
        latents.build_latents(df, 5, "other")
    with pytest.raises(RuntimeError):
        latents.build_latents(df, 5, "language_model")
    with pytest.raises(ValueError, match="too close"):
        latents.check_latents(pool_of(spark, [(0, 0), (0, 0), (1, 1)]), 2)


def test_json_round_trips(spark, tmp_path):
    tables.write_initial(spark, [5, 3], 123, f"{tmp_path}/i")
    assert [r.id for r in tables.read_initial(spark, f"{tmp_path}/i").orderBy("pos").collect()] == [5, 3]
    tables.write_params(spark, LANDSCAPE, f"{tmp_path}/p")
    assert tables.read_params(spark, f"{tmp_path}/p") == LANDSCAPE


def test_plans_are_compared_from_one_start(setting):
    pool, _, oracle, initial = setting
    got = {r.plan: r for r in campaign.compare_plans({"a": {"random": 4}, "b": {"uncertainty": 4}}, pool, oracle, initial, settings=SHORT).collect()}
    assert set(got) == {"a", "b"} and all(r.hv_gain >= 0 for r in got.values())


def test_first_copies_never_mix_rows(spark):
    rows = [("k", 1, "a", 2.0), ("k", 1, "b", 1.0), ("k", 1, None, 9.0), ("n", None, "x", 1.0), ("n", None, "w", 5.0), ("n", 7, "z", 0.0)]
    df = spark.createDataFrame(rows, "key string, pos int, s string, v double")
    for parts in (1, 3, 6):
        got = {r.key: tuple(r) for r in ingest.first_copies(df.repartition(parts), ["key"], "pos").collect()}
        assert got == {"k": ("k", 1, None, 9.0), "n": ("n", 7, "z", 0.0)}


def test_exact_quantiles_without_one_buffer(spark, monkeypatch):
    r = random.Random(2)
    values = [r.choice((3.5, 3.5, 7.0, float(r.randrange(400)), r.gauss(0, 50))) for _ in range(3000)] + [None] * 20
    df = spark.createDataFrame([(v,) for v in values], "v double")
    some = np.array([v for v in values if v is not None])
    qs = [0.0, 0.25, 0.5, 0.6, 0.999, 1.0]
    for few in (50_000, 60):
        monkeypatch.setattr(stats, "FEW", few)
        assert np.allclose(stats.exact_quantiles(df, "v", qs), np.quantile(some, qs))
    assert stats.exact_quantiles(df.limit(0), "v", [0.5]) == [None]
    assert stats.exact_quantiles(df.where("v = 3.5"), "v", [0.1, 0.5]) == [3.5, 3.5]


def test_correlations_rank_full_columns_once_and_others_by_pair(spark):
    import pandas as pd

    r = np.random.default_rng(1)
    x = r.integers(0, 9, (300, 3)).astype(float)
    x[:, 2] += x[:, 0]
    frame = pd.DataFrame(x, columns=["a", "b", "c"])
    frame.loc[::7, "b"] = np.nan
    rows = [(i, *(None if np.isnan(v) else float(v) for v in row)) for i, row in enumerate(frame.to_numpy())]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, c double")
    wanted = frame.corr(method=lambda p, q: pd.Series(p).rank().corr(pd.Series(q).rank()))
    got = {(x.a, x.b): x.rho for x in stats.correlation_matrix(df, ["a", "b", "c"], "id").collect()}
    assert got.keys() == {("a", "b"), ("a", "c"), ("b", "c")}
    assert all(v == pytest.approx(wanted.loc[k]) for k, v in got.items())


def test_nearest_mean_by_broadcast_and_by_blocks(spark):
    r = np.random.default_rng(5)
    rows = [(i, i % 6, (r.random(3) + i % 6 * r.random()).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "id bigint, label bigint, x array<double>")
    means = np.array([np.mean([x for _, k, x in rows if k == g], axis=0) for g in range(6)])
    wanted = {i: int(((means - x) ** 2).sum(1).argmin()) for i, _, x in rows}
    for most in (4096, 2):
        assert {x.id: x.centroid for x in stats.nearest_mean(df, "id", "label", "x", most).collect()} == wanted


def test_shard_loop_keeps_its_share_and_counts(spark, tmp_path):
    from pyspark.sql import functions as F

    texts = [["a", "b", "a", "c", "d"], ["b", "x", "e", "f"], ["g", "h", "i", "j"]]
    shards = []
    for k, t in enumerate(texts):
        shards.append(f"{tmp_path}/s{k}")
        spark.createDataFrame([(s, f"run{k}") for s in t], "s string, run string").coalesce(1).write.parquet(shards[-1])
    records, counters, manifest = ingest.collect_shards(spark, shards, 6, F.col("s") != "x", F.upper("s"), {"source": F.col("run")}, most=4)
    assert sorted(map(tuple, records.collect())) == [("A", "run0"), ("B", "run0"), ("E", "run1"), ("F", "run1"), ("G", "run2"), ("H", "run2")]
    assert [(m.kept, m.scanned) for m in manifest.orderBy("shard").collect()] == [(2, 2), (2, 4), (2, 2)]
    assert counters == {"scanned": 8, "cheap_kept": 6, "shards_used": 3, "distinct_sources": 3}
    with pytest.raises(FileNotFoundError):
        ingest.collect_shards(spark, [], 6, F.lit(True), F.col("s"), {})


def test_own_selectors_and_quasi_random_samples(spark):
    from skyfront.operators import cards

    class Last(cards.PoolSelector):
        def select(self, pool, model, q, seed):
            return [r.id for r in pool.orderBy("id", ascending=False).limit(q).collect()]

    pool = spark.createDataFrame([(i, [0.1 * i]) for i in range(6)], "id bigint, x array<double>")
    cards.SELECTORS["last"] = Last()
    try:
        assert cards.propose({"last": 2, "random": 1}, None, pool, [5], np.zeros((1, 1)), np.zeros((1, 2)))[:2] == [4, 3]
    finally:
        del cards.SELECTORS["last"]
    with pytest.raises(NotImplementedError):
        cards.PoolSelector().select(pool, None, 1, 0)
    z = cards.base_samples(256, 3, 2, 7)
    assert z.shape == (256, 3, 2) and np.array_equal(z, cards.base_samples(256, 3, 2, 7)) and not np.array_equal(z, cards.base_samples(256, 3, 2, 8))
    # closer to the normal's moments than independent draws would be
    assert np.abs(z.mean(0)).max() < 0.03 and np.abs(z.std(0) - 1).max() < 0.05


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from skyfront.sources.scratch import scratch_root

    named = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=SimpleNamespace(master="local-cluster[3,2,1024]"))
    with pytest.raises(ValueError):
        scratch_root(named)
    named.sparkContext.master = "local[2]"
    assert scratch_root(named).startswith("file:") and scratch_root(named) == scratch_root(named)


def test_seeding():
    from skyfront.config import seed_everything

    a = (seed_everything(5).random(), random.random(), np.random.random())
    assert a == (seed_everything(5).random(), random.random(), np.random.random())


def test_diversity_in_blocks_and_the_front_s_diameter(spark):
    r = np.random.default_rng(6)
    rows = [(i, "a" if i < 50 else "b" if i < 59 else "c", r.random(3).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, label string, x array<double>")
    pairs = lambda v: [np.linalg.norm(p - q) for k, p in enumerate(v) for q in v[:k]] or [0.0]
    wanted = {k: np.mean(pairs([np.array(x) for _, g, x in rows if g == k])) for k in "abc"}
    for block in (1024, 7):
        got = {x.label: x.diversity for x in stats.diversity_by(df, "label", "id", "x", block).collect()}
        assert got == pytest.approx(wanted)
    points = [(i, float(x), float(20 - x * x / 20 - (i % 3 == 0))) for i, x in enumerate(r.integers(0, 20, 200))]
    table = spark.createDataFrame(points, "id bigint, y1 double, y2 double")
    front = [tuple(x) for x in pareto.skyline(table, "y1", "y2").select("y1", "y2").distinct().collect()]
    assert len(front) > 8 and pareto.front_diameter(table, "y1", "y2").first().diameter == pytest.approx(max(pairs(np.array(front))))
    assert pareto.front_diameter(table.limit(0), "y1", "y2").first().diameter == 0

"""Registered queries of the decision engine and their SQL, by name.

A key begins with the id of the main operator that it runs. Doubles are rounded in both, as
sums may run in any order. Queries without SQL are greedy, iterative or model-based; the tests
hold them against brute force or against their invariants.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ALPHABET
from ..functions import text as fx
from ..operators import campaign, cards, ingest, latents, pareto, select, stats, surrogate
from ..sources import tables
from ..sources.scratch import scratch_path, written
from ..streaming.front import RunningFront
from . import bindings as b
from .registry import ORACLE_SQL, QUERIES, query, r

__all__ = ["ORACLE_SQL", "QUERIES", "entry"]

# Common table expressions of the SQL.
PARTS = "p AS (SELECT p_partkey AS id, p_brand AS grp, p_retailprice AS y1, CAST(p_size AS DOUBLE) AS y2 FROM part)"
TEAMS = "t AS (SELECT event_id AS id, user_id AS team, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS rnd, value AS y1, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y2 FROM events)"
_WIDE = ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS x{k}" for k in range(5))
_UNIT = ", ".join(f"(x{k} - min(x{k}) OVER ()) / (max(x{k}) OVER () - min(x{k}) OVER ()) AS x{k}" for k in range(5))
LATENTS = f"e AS (SELECT vec_id AS id, {_WIDE} FROM embeddings), x AS (SELECT id, {_UNIT} FROM e)"


def front_sql(rows: str, keys: tuple[str, ...] = ()) -> str:
    """Rows of ``rows`` that no row of the same keys dominates."""
    same = "".join(f"b.{k} = a.{k} AND " for k in keys)
    return f"SELECT a.* FROM {rows} a WHERE NOT EXISTS (SELECT 1 FROM {rows} b WHERE {same}b.y1 >= a.y1 AND b.y2 >= a.y2 AND (b.y1 > a.y1 OR b.y2 > a.y2))"


def hv_sql(rows: str, keys: tuple[str, ...], ref: tuple[float, float]) -> str:
    """Hypervolume of each key's points beyond ``ref``, for keys that have some."""
    over = f"PARTITION BY {', '.join(keys)} " if keys else ""
    by = f" GROUP BY {', '.join(keys)}" if keys else ""
    head = "".join(f"{k}, " for k in keys)
    return (
        f"SELECT {head}sum((y1 - {ref[0]}) * greatest(y2 - coalesce(m, {ref[1]}), 0)) AS hv FROM (SELECT *, max(y2) OVER ({over}ORDER BY y1 DESC, y2 DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m "
        f"FROM {rows} WHERE y1 > {ref[0]} AND y2 > {ref[1]}){by}"
    )


# --- fronts, hypervolume, histories ------------------------------------------------------


@query("a1_pareto_front", f"WITH {PARTS} SELECT id, y1, y2 FROM ({front_sql('p')})")
def a1_pareto_front(spark, sf_dir):
    return pareto.skyline(b.parts(spark, sf_dir), "y1", "y2").select("id", "y1", "y2")


@query("a1_pareto_front_by_group", f"WITH {PARTS} {front_sql('p', ('grp',))}")
def a1_pareto_front_by_group(spark, sf_dir):
    return pareto.skyline(b.parts(spark, sf_dir), "y1", "y2", ["grp"]).select("id", "grp", "y1", "y2")


@query("a1_pareto_mask_first_copy", "WITH l AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_returnflag AS grp, l_quantity AS y1, l_discount AS y2 FROM lineitem), f AS (" + front_sql("l", ("grp",)) + ") SELECT grp, y1, y2, count(*) AS copies FROM f GROUP BY ALL")
def a1_pareto_mask_first_copy(spark, sf_dir):
    """The first-copy mask keeps one row of each front point; copies counts all that were there."""
    rows = b.table(spark, sf_dir, "lineitem").select(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.col("l_returnflag").alias("grp"), F.col("l_quantity").alias("y1"), F.col("l_discount").alias("y2"))
    one = pareto.pareto_mask(rows, "y1", "y2", "id", ["grp"]).where("on_front").select("grp", "y1", "y2")
    every = pareto.skyline(rows, "y1", "y2", ["grp"]).groupBy("grp", "y1", "y2").agg(F.count(F.lit(1)).alias("copies"))
    return one.distinct().join(every, ["grp", "y1", "y2"])


@query("a1_pareto_front_3d", "WITH p AS (SELECT p_partkey AS id, p_retailprice AS a, CAST(p_size AS DOUBLE) AS b, CAST(length(p_name) AS DOUBLE) AS c FROM part) SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.a >= p.a AND q.b >= p.b AND q.c >= p.c AND (q.a > p.a OR q.b > p.b OR q.c > p.c))")
def a1_pareto_front_3d(spark, sf_dir):
    rows = b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("a"), F.col("p_size").cast("double").alias("b"), F.length("p_name").cast("double").alias("c"))
    return pareto.skyline_nd(rows, ["a", "b", "c"], "id")


@query("w1_pareto_large", "WITH l AS (SELECT l_extendedprice AS y1, l_discount AS y2 FROM lineitem), m AS (SELECT y1, max(y2) AS y2 FROM l GROUP BY y1) SELECT y1, y2 FROM (SELECT *, max(y2) OVER (ORDER BY y1 DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM m) WHERE k IS NULL OR y2 > k")
def w1_pareto_large(spark, sf_dir):
    return pareto.front_values(b.table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("y1"), F.col("l_discount").alias("y2")), "y1", "y2")


@query("a30_true_front", f"WITH {PARTS} SELECT row_number() OVER (ORDER BY y1, y2 DESC, id) AS pos, id, y1, y2 FROM ({front_sql('p')})")
def a30_true_front(spark, sf_dir):
    front = pareto.skyline(b.parts(spark, sf_dir), "y1", "y2")
    return stats.numbered(front.select("id", "y1", "y2"), ["y1", F.desc("y2"), "id"], "pos").select("pos", "id", "y1", "y2")


@query("a3_hypervolume_by_group", f"WITH {PARTS} SELECT grp, round(hv, 4) AS hv FROM ({hv_sql('p', ('grp',), (0.0, 0.0))})")
def a3_hypervolume_by_group(spark, sf_dir):
    return pareto.hypervolume(b.parts(spark, sf_dir), "y1", "y2", (0.0, 0.0), ["grp"]).select("grp", r("hv", 4).alias("hv"))


@query("a3_hypervolume_ref_sensitivity", f"WITH {PARTS} " + " UNION ALL ".join(f"SELECT CAST({x} AS DOUBLE) AS r1, CAST({y} AS DOUBLE) AS r2, round(coalesce((SELECT hv FROM ({hv_sql('p', (), (x, y))})), 0), 4) AS hv" for x, y in ((0.0, 0.0), (950.0, 10.0), (1000.0, 40.0), (1e6, 1e6))))
def a3_hypervolume_ref_sensitivity(spark, sf_dir):
    p, out = b.parts(spark, sf_dir), None
    for x, y in ((0.0, 0.0), (950.0, 10.0), (1000.0, 40.0), (1e6, 1e6)):
        one = pareto.hypervolume(p, "y1", "y2", (x, y)).select(F.lit(x).alias("r1"), F.lit(y).alias("r2"), r("hv", 4).alias("hv"))
        out = one if out is None else out.unionByName(one)
    return out


_SLABS = "p AS (SELECT p_retailprice AS a, CAST(p_size AS DOUBLE) AS b, CAST(length(p_name) AS DOUBLE) AS c FROM part), k AS (SELECT c, c - lag(c, 1, 0) OVER (ORDER BY c) AS depth FROM (SELECT DISTINCT c FROM p WHERE c > 0)), x AS (SELECT k.c AS level, p.a AS y1, p.b AS y2 FROM k JOIN p ON p.c >= k.c)"


@query("a3_hypervolume_3d", f"WITH {_SLABS}, h AS ({hv_sql('x', ('level',), (0.0, 0.0))}) SELECT round(sum(hv * depth), 2) AS hv FROM h JOIN k ON h.level = k.c")
def a3_hypervolume_3d(spark, sf_dir):
    rows = b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("a"), F.col("p_size").cast("double").alias("b"), F.length("p_name").cast("double").alias("c"))
    return pareto.hypervolume_nd(rows, ["a", "b", "c"], (0.0, 0.0, 0.0), "id").select(r("hv", 2).alias("hv"))


_SLABS_4D = (
    "p AS (SELECT l_extendedprice AS y1, l_quantity AS y2, l_discount AS c, l_tax AS d FROM lineitem), "
    "kc AS (SELECT c, c - lag(c, 1, 0) OVER (ORDER BY c) AS dc FROM (SELECT DISTINCT c FROM p WHERE c > 0)), kd AS (SELECT d, d - lag(d, 1, 0) OVER (ORDER BY d) AS dd FROM (SELECT DISTINCT d FROM p WHERE d > 0)), "
    "x AS (SELECT kc.c AS level, kd.d AS below, dc * dd AS depth, y1, y2 FROM p JOIN kc ON p.c >= kc.c JOIN kd ON p.d >= kd.d)"
)


@query("a3_hypervolume_4d", f"WITH {_SLABS_4D}, h AS ({hv_sql('x', ('level', 'below', 'depth'), (0.0, 0.0))}) SELECT round(sum(hv * depth), 2) AS hv FROM h")
def a3_hypervolume_4d(spark, sf_dir):
    rows = _line_values(spark, sf_dir)
    return pareto.hypervolume_nd(rows, ["a", "b", "c", "d"], (0.0, 0.0, 0.0, 0.0), "id").select(r("hv", 2).alias("hv"))


def _line_values(spark, sf_dir):
    """Four objectives of order lines, with a number for each line."""
    return b.table(spark, sf_dir, "lineitem").select(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.col("l_extendedprice").alias("a"), F.col("l_quantity").alias("b"), F.col("l_discount").alias("c"), F.col("l_tax").alias("d"))


@query("a1_pareto_front_4d", "WITH p AS (SELECT DISTINCT l_extendedprice AS a, l_quantity AS b, l_discount AS c, l_tax AS d FROM lineitem) SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.a >= p.a AND q.b >= p.b AND q.c >= p.c AND q.d >= p.d AND (q.a > p.a OR q.b > p.b OR q.c > p.c OR q.d > p.d))")
def a1_pareto_front_4d(spark, sf_dir):
    return pareto.skyline_nd(_line_values(spark, sf_dir), ["a", "b", "c", "d"], "id").select("a", "b", "c", "d").distinct()


_HISTORY = f"{TEAMS}, k AS (SELECT DISTINCT team, rnd FROM t), c AS (SELECT k.team, k.rnd, t.y1, t.y2 FROM k JOIN t ON k.team = t.team AND t.rnd <= k.rnd), h AS ({hv_sql('c', ('team', 'rnd'), (0.0, 0.0))}), hist AS (SELECT k.team, k.rnd, coalesce(hv, 0) AS hv FROM k LEFT JOIN h ON k.team = h.team AND k.rnd = h.rnd)"


def _history(spark, sf_dir):
    return pareto.hv_history(b.teams(spark, sf_dir), "team", "rnd", "y1", "y2", (0.0, 0.0))


@query("j12_hv_history", f"WITH {_HISTORY} SELECT team, rnd, round(hv, 4) AS hv FROM hist")
def j12_hv_history(spark, sf_dir):
    return _history(spark, sf_dir).select("team", "rnd", r("hv", 4).alias("hv"))


@query("w4_hv_gain", f"WITH {_HISTORY} SELECT team, rnd, round(hv - lag(hv) OVER (PARTITION BY team ORDER BY rnd), 4) + 0.0 AS gain FROM hist")
def w4_hv_gain(spark, sf_dir):
    return pareto.hv_gain(_history(spark, sf_dir), "team", "rnd").select("team", "rnd", (r("gain", 4) + 0.0).alias("gain"))


@query("a4_auc_hv", f"WITH {_HISTORY} SELECT team, round(coalesce(avg(m), max(hv)), 4) AS auc_hv FROM (SELECT team, hv, (hv + lead(hv) OVER (PARTITION BY team ORDER BY rnd)) / 2 AS m FROM hist) GROUP BY team")
def a4_auc_hv(spark, sf_dir):
    return pareto.auc(_history(spark, sf_dir), "team", "rnd").select("team", r("auc_hv", 4).alias("auc_hv"))


@query("w2_staircase", f"WITH {PARTS}, f AS (SELECT DISTINCT grp, y1, y2 FROM ({front_sql('p', ('grp',))})), s AS (SELECT *, row_number() OVER w AS n, lag(y1) OVER w AS q FROM f WINDOW w AS (PARTITION BY grp ORDER BY y1)) SELECT grp, CAST(2 * n - 1 AS INTEGER) AS step, y1 AS x, y2 AS y FROM s UNION ALL SELECT grp, CAST(2 * n - 2 AS INTEGER), q, y2 FROM s WHERE q IS NOT NULL")
def w2_staircase(spark, sf_dir):
    front = pareto.front_values(b.parts(spark, sf_dir), "y1", "y2", ["grp"])
    return pareto.staircase(front, "y1", "y2", ["grp"])


@query("w5_fronts_by_round", f"WITH {TEAMS}, k AS (SELECT DISTINCT team, rnd FROM t), c AS (SELECT DISTINCT k.team, k.rnd, t.y1, t.y2 FROM k JOIN t ON k.team = t.team AND t.rnd <= k.rnd) {front_sql('c', ('team', 'rnd'))}")
def w5_fronts_by_round(spark, sf_dir):
    return pareto.front_history(b.teams(spark, sf_dir), "team", "rnd", "y1", "y2")


@query("v2_front_plot", f"WITH {PARTS}, f AS ({front_sql('p', ('grp',))}) SELECT p.id, p.grp, p.y1, p.y2, CASE WHEN f.id IS NOT NULL THEN 'front' WHEN p.y2 >= 25 THEN 'large' ELSE 'dominated' END AS class FROM p LEFT JOIN f ON p.id = f.id")
def v2_front_plot(spark, sf_dir):
    p = b.parts(spark, sf_dir)
    marked = pareto.pareto_mask(p, "y1", "y2", "id", ["grp"], keep_duplicates=True)
    kind = F.when(F.col("on_front"), "front").when(F.col("y2") >= 25, "large").otherwise("dominated")
    return marked.select("id", "grp", "y1", "y2", kind.alias("class"))


_SCORES = f"{_HISTORY}, auc AS (SELECT team, coalesce(avg(m), max(hv)) AS auc FROM (SELECT team, hv, (hv + lead(hv) OVER (PARTITION BY team ORDER BY rnd)) / 2 AS m FROM hist) GROUP BY team), fin AS (SELECT team, max(hv) AS hv FROM hist GROUP BY team), lo AS (SELECT team, min(rnd) AS r0 FROM t GROUP BY team), fr AS (SELECT f.team, count(*) FILTER (WHERE f.rnd > lo.r0) AS n FROM ({front_sql('t', ('team',))}) f JOIN lo ON f.team = lo.team GROUP BY f.team), dv AS (SELECT team, stddev_pop(y1) AS d FROM t GROUP BY team)"


@query("o9_leaderboard", f"WITH {_SCORES}, s AS (SELECT CAST(auc.team AS VARCHAR) AS team_name, round(auc, 4) AS auc_hv, round(fin.hv, 4) AS final_hv, n AS n_nondominated_selected, round(d, 4) AS embedding_diversity FROM auc JOIN fin ON auc.team = fin.team JOIN fr ON auc.team = fr.team JOIN dv ON auc.team = dv.team) SELECT CAST(row_number() OVER (ORDER BY auc_hv DESC, final_hv DESC, n_nondominated_selected DESC, embedding_diversity DESC, team_name) AS INTEGER) AS rank, * FROM s")
def o9_leaderboard(spark, sf_dir):
    t, h = b.teams(spark, sf_dir), _history(spark, sf_dir)
    first = t.groupBy("team").agg(F.min("rnd").alias("r0"))
    front = pareto.skyline(t, "y1", "y2", ["team"]).join(first, "team").groupBy("team").agg(F.count_if(F.col("rnd") > F.col("r0")).alias("n"))
    spread = t.groupBy("team").agg(F.stddev_pop("y1").alias("d"))
    scores = pareto.auc(h, "team", "rnd").join(h.groupBy("team").agg(F.max("hv").alias("f")), "team").join(front, "team").join(spread, "team")
    return campaign.leaderboard(scores.select(F.col("team").cast("string").alias("team_name"), r("auc_hv", 4).alias("auc_hv"), r("f", 4).alias("final_hv"), F.col("n").alias("n_nondominated_selected"), r("d", 4).alias("embedding_diversity")))


@query("a19_n_nondominated", f"WITH {_SCORES} SELECT team, n FROM fr")
def a19_n_nondominated(spark, sf_dir):
    t = b.teams(spark, sf_dir)
    first = t.groupBy("team").agg(F.min("rnd").alias("r0"))
    return pareto.skyline(t, "y1", "y2", ["team"]).join(first, "team").groupBy("team").agg(F.count_if(F.col("rnd") > F.col("r0")).alias("n"))


@query("streaming_front", f"WITH {PARTS} SELECT DISTINCT grp, y1, y2 FROM ({front_sql('p', ('grp',))})")
def streaming_front(spark, sf_dir):
    """The table as a stream of files, merged batch by batch into a running front."""
    folder = scratch_path(spark, "front")
    schema = spark.read.parquet(f"{sf_dir}/part.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{sf_dir}/part.parquet*")
    rows = stream.select(F.col("p_brand").alias("grp"), F.col("p_retailprice").alias("y1"), F.col("p_size").cast("double").alias("y2"))
    front = RunningFront(spark, folder, "y1", "y2", ["grp"])
    front.start(rows, f"{folder}/progress").awaitTermination()
    return front.current()


# --- joins, sets -----------------------------------------------------------------------


@query("j4_available_ids", "SELECT vec_id AS id FROM embeddings WHERE label NOT IN (3, 7)")
def j4_available_ids(spark, sf_dir):
    p = b.points(spark, sf_dir)
    return select.available(p, p.where("label IN (3, 7)").select("id")).select("id")


@query("j2_lookup_observed", "SELECT o_orderkey AS pos, p_partkey AS id, p_retailprice AS y1, CAST(p_size AS DOUBLE) AS y2 FROM orders JOIN part ON o_custkey = p_partkey")
def j2_lookup_observed(spark, sf_dir):
    """An order- and duplicate-preserving lookup: ids repeat, each keeps its place."""
    ids = b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("id"))
    return select.lookup(ids, b.parts(spark, sf_dir).drop("grp"))


_ASKED = (5, 3, 5, 9, 17)
_ASKED_SQL = "SELECT CAST(pos AS BIGINT) AS pos, p_partkey AS id, p_retailprice AS y1, CAST(p_size AS DOUBLE) AS y2 FROM (VALUES " + ", ".join(f"({k}, {i})" for k, i in enumerate(_ASKED)) + ") v(pos, i) JOIN part ON p_partkey = i"


def _answers(spark, y):
    return spark.createDataFrame([(k, i, float(u), float(v)) for k, (i, (u, v)) in enumerate(zip(_ASKED, y, strict=True))], "pos bigint, id bigint, y1 double, y2 double")


@query("j2_oracle_evaluate", _ASKED_SQL)
def j2_oracle_evaluate(spark, sf_dir):
    """Measured values of asked ids, in their order, repeats included; without noise here."""
    return _answers(spark, campaign.Oracle(b.parts(spark, sf_dir).select("id", "y1", "y2"), (0.0, 0.0)).evaluate(_ASKED))


@query("j3_true_objectives", _ASKED_SQL)
def j3_true_objectives(spark, sf_dir):
    """True values, from an oracle that may give them, whatever its noise."""
    return _answers(spark, campaign.Oracle(b.parts(spark, sf_dir).select("id", "y1", "y2"), (0.05, 0.05), allow_true=True).evaluate_true(_ASKED))


@query("j9_overlap_check", "SELECT count(*) AS overlap FROM (SELECT DISTINCT o_custkey AS k FROM orders) JOIN (SELECT c_custkey AS k FROM customer WHERE c_acctbal < 0) USING (k)")
def j9_overlap_check(spark, sf_dir):
    a = b.table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("k"))
    return a.join(b.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k", "left_semi").agg(F.count(F.lit(1)).alias("overlap"))


@query("e1_union_all", "SELECT 0 AS part, p_partkey AS id FROM part UNION ALL SELECT 1, s_suppkey FROM supplier")
def e1_union_all(spark, sf_dir):
    a = b.table(spark, sf_dir, "part").select(F.lit(0).alias("part"), F.col("p_partkey").alias("id"))
    return a.unionByName(b.table(spark, sf_dir, "supplier").select(F.lit(1).alias("part"), F.col("s_suppkey").alias("id")))


@query("e2_forbidden_ids", "SELECT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R' UNION SELECT p_partkey FROM part WHERE p_size > 40")
def e2_forbidden_ids(spark, sf_dir):
    a = b.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("id"))
    return a.union(b.table(spark, sf_dir, "part").where("p_size > 40").select("p_partkey")).distinct()


@query("e3_pool_minus_forbidden", "SELECT p_partkey AS id FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 47")
def e3_pool_minus_forbidden(spark, sf_dir):
    pool = b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    return select.available(pool, b.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity > 47").select(F.col("l_partkey").alias("id")))


@query("j11_team_truth", f"WITH {TEAMS}, s AS (SELECT t.team, p_retailprice AS y1, CAST(p_size AS DOUBLE) AS y2 FROM t JOIN part ON p_partkey = CAST(t.y2 AS BIGINT)) SELECT DISTINCT team, y1, y2 FROM ({front_sql('s', ('team',))})")
def j11_team_truth(spark, sf_dir):
    chosen = b.teams(spark, sf_dir).select("team", F.col("y2").cast("bigint").alias("id"))
    return pareto.front_values(chosen.join(b.parts(spark, sf_dir).drop("grp"), "id"), "y1", "y2", ["team"])


# --- distances, projection, selection ----------------------------------------------------

_DIST = "sqrt(list_sum(list_transform(range(1, 65), lambda i: (CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)) ** 2)))"


@query("g1_nearest_projection", f"SELECT c, id, d FROM (SELECT a.vec_id AS c, b.vec_id AS id, round({_DIST}, 6) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DIST}, b.vec_id) AS n FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) WHERE n = 1")
def g1_nearest_projection(spark, sf_dir):
    """Each query row's nearest other row; every 20th row asks, against all rows."""
    p = b.points(spark, sf_dir).select("id", "x")
    return stats.nearest_rows(p.where("id % 20 = 0"), p, "id", "x").select(F.col("id").alias("c"), F.col("near").alias("id"), r("d").alias("d"))


def _candidates(spark, sf_dir):
    return [list(x.x) for x in b.points(spark, sf_dir).where("id IN (0, 1, 2, 3)").orderBy("id").collect()]


def _greedy_sql() -> str:
    """Candidates 0 to 3 in turn: of each one's four closest rows the first that is not taken."""
    steps = []
    for k in range(4):
        free = " AND ".join(["true", *(f"x <> s{j}.id" for j in range(k))])
        steps.append(f"s{k} AS (SELECT list_filter(l.ids, lambda x: {free})[1] AS id FROM l{''.join(f', s{j}' for j in range(k))} WHERE c = {k})")
    near = f"d AS (SELECT a.vec_id AS c, b.vec_id AS id, {_DIST} AS d FROM embeddings a JOIN embeddings b ON a.vec_id < 4 AND b.vec_id > 3), l AS (SELECT c, list(id ORDER BY d, id) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY d, id) AS n FROM d) WHERE n <= 4 GROUP BY c)"
    return f"WITH {near}, {', '.join(steps)} " + " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS pos, id FROM s{k}" for k in range(4))


def _diverse_sql() -> str:
    """Like that, each distance less the one to the closest row taken before."""
    dist = lambda x, y: _DIST.replace("b.embedding", f"{y}.e").replace("a.embedding", f"{x}.e")
    steps = []
    for k in range(4):
        near = ", ".join(dist("b", f"s{j}") for j in range(k))
        score = dist("a", "b") + (f" - least({near})" if k > 1 else f" - {near}" if k else "")
        free = "".join(f" AND b.vec_id <> s{j}.id" for j in range(k))
        steps.append(f"s{k} AS (SELECT b.vec_id AS id, b.e FROM v b, (SELECT e FROM v WHERE vec_id = {k}) a{''.join(f', s{j}' for j in range(k))} WHERE b.vec_id > 3{free} ORDER BY {score}, b.vec_id LIMIT 1)")
    return f"WITH v AS (SELECT vec_id, embedding AS e FROM embeddings), {', '.join(steps)} " + " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS pos, id FROM s{k}" for k in range(4))


def _farthest_sql(k: int, start: int) -> str:
    """From ``start`` on, the row farthest from all rows taken before."""
    gap = lambda j: " + ".join(f"(b.x{i} - s{j}.x{i}) ** 2" for i in range(5))
    steps = [f"s0 AS (SELECT * FROM x WHERE id = {start})"]
    for n in range(1, k):
        gaps = ", ".join(gap(j) for j in range(n))
        steps.append(f"s{n} AS (SELECT b.* FROM x b{''.join(f', s{j}' for j in range(n))} WHERE {' AND '.join(f'b.id <> s{j}.id' for j in range(n))} ORDER BY {f'least({gaps})' if n > 1 else gaps} DESC, b.id LIMIT 1)")
    return f"WITH {LATENTS}, {', '.join(steps)} " + " UNION ALL ".join(f"SELECT CAST({n} AS INTEGER) AS pos, id FROM s{n}" for n in range(k))


@query("g1_nearest_greedy", _greedy_sql())
def g1_nearest_greedy(spark, sf_dir):
    p = b.points(spark, sf_dir).select("id", "x")
    ids = select.nearest(_candidates(spark, sf_dir), p, [0, 1, 2, 3])
    return spark.createDataFrame(list(enumerate(ids)), "pos int, id bigint")


@query("g2_diverse_nearest", _diverse_sql())
def g2_diverse_nearest(spark, sf_dir):
    p = b.points(spark, sf_dir).select("id", "x")
    ids = select.diverse_nearest(_candidates(spark, sf_dir), p, [0, 1, 2, 3])
    return spark.createDataFrame(list(enumerate(ids)), "pos int, id bigint")


@query("a7_nn_distance", f"SELECT a.vec_id AS id, round(min({_DIST}), 6) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY a.vec_id")
def a7_nn_distance(spark, sf_dir):
    return stats.nearest_distances(b.points(spark, sf_dir), "id", "x").select("id", r("d").alias("d"))


@query("a6_closest_pair", f"SELECT round({_DIST}, 6) AS d, a.vec_id AS i, b.vec_id AS j FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id ORDER BY {_DIST}, i, j LIMIT 1")
def a6_closest_pair(spark, sf_dir):
    p = b.points(spark, sf_dir)
    pairs = stats.nearest_rows(p, p, "id", "x").select("d", F.least("id", "near").alias("i"), F.greatest("id", "near").alias("j"))
    return pairs.agg(F.min(F.struct("d", "i", "j")).alias("m")).select(r("m.d").alias("d"), "m.i", "m.j")


@query("a5_diversity", f"SELECT a.label, round(avg({_DIST}), 6) AS diversity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label = b.label GROUP BY a.label")
def a5_diversity(spark, sf_dir):
    return stats.diversity_by(b.points(spark, sf_dir), "label", "id", "x").select("label", r("diversity").alias("diversity"))


@query("a8_front_diameter", f"WITH {PARTS}, f AS ({front_sql('p')}) SELECT round(max(sqrt((a.y1 - b.y1) ** 2 + (a.y2 - b.y2) ** 2)), 6) AS diameter FROM f a, f b")
def a8_front_diameter(spark, sf_dir):
    return pareto.front_diameter(b.parts(spark, sf_dir), "y1", "y2").select(r("diameter").alias("diameter"))


@query("g4_farthest_points", _farthest_sql(12, 0))
def g4_farthest_points(spark, sf_dir):
    ids = select.farthest_points(b.latents(spark, sf_dir), 12, 0)
    return spark.createDataFrame(list(enumerate(ids)), "pos int, id bigint")


@query("g5_initial_design")
def g5_initial_design(spark, sf_dir):
    pool = b.latents(spark, sf_dir)
    y = pareto.pareto_mask(campaign.true_objectives(pool, b.LANDSCAPE), "y1", "y2", "id")
    band = stats.quantile_band(y, "y1", "y2", "on_front", 0.6, 12).select("id", F.lit(True).alias("candidate"))
    ids = select.initial_ids(pool.join(band, "id", "left").withColumn("candidate", F.coalesce("candidate", F.lit(False))), 12, 5)
    return spark.createDataFrame([(i,) for i in ids], "id bigint")


@query("p16_quantile_band", f"WITH {PARTS}, f AS ({front_sql('p')}), q AS (SELECT quantile_cont(y1, 0.6) AS a, quantile_cont(y2, 0.6) AS b FROM p) SELECT p.id FROM p, q WHERE y1 <= a AND y2 <= b AND id NOT IN (SELECT id FROM f)")
def p16_quantile_band(spark, sf_dir):
    p = pareto.pareto_mask(b.parts(spark, sf_dir), "y1", "y2", "id", keep_duplicates=True)
    return stats.quantile_band(p, "y1", "y2", "on_front", 0.6, 12).select("id")


@query("w6_balanced_sample", "SELECT id, label, turn FROM (SELECT vec_id AS id, label, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS INTEGER) AS turn FROM embeddings) ORDER BY turn, label LIMIT 64")
def w6_balanced_sample(spark, sf_dir):
    return select.balanced(b.points(spark, sf_dir).select("id", "label"), "label", "id", 64)


@query("g7_drop_small", "SELECT vec_id AS id, label FROM embeddings WHERE label IN (SELECT label FROM embeddings GROUP BY label HAVING count(*) >= 50)")
def g7_drop_small(spark, sf_dir):
    return select.drop_small(b.points(spark, sf_dir).select("id", "label"), "label", 50)


@query("g9_curate")
def g9_curate(spark, sf_dir):
    docs = b.table(spark, sf_dir, "documents", "doc_id", "text", "source")
    docs = docs.where(F.upper("text").rlike(f"[{ALPHABET}]"))  # others have an empty sequence
    seq = F.regexp_replace(F.upper("text"), f"[^{ALPHABET}]+", "")
    return select.curate(docs.select(F.col("doc_id").alias("pos"), seq.alias("sequence"), "source"), 256, 123, clusters=12)


# --- scaling, statistics -------------------------------------------------------------------

_LONG = "l AS (" + " UNION ALL ".join(f"SELECT id, {k} AS dim, x{k} AS value FROM x" for k in range(5)) + ")"


@query("a10_minmax", f"WITH {LATENTS}, {_LONG} SELECT id, CAST(dim AS INTEGER) AS dim, round(value, 6) AS value FROM l")
def a10_minmax(spark, sf_dir):
    return stats.dimensions(b.latents(spark, sf_dir), "id", "x").select("id", "dim", r("value").alias("value"))


@query("a9_zscore", "SELECT s_suppkey AS id, round((s_acctbal - avg(s_acctbal) OVER ()) / stddev_pop(s_acctbal) OVER (), 6) AS z FROM supplier")
def a9_zscore(spark, sf_dir):
    s = b.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("z"))
    return stats.zscore(s, ["z"]).select("id", r("z").alias("z"))


@query("a22_latent_summary", f"WITH {LATENTS}, {_LONG} SELECT CAST(dim AS INTEGER) AS dim, round(min(value), 6) AS lo, round(max(value), 6) AS hi, round(stddev_pop(value), 6) AS spread FROM l GROUP BY dim")
def a22_latent_summary(spark, sf_dir):
    v = stats.dimensions(b.latents(spark, sf_dir), "id", "x")
    return v.groupBy("dim").agg(r(F.min("value")).alias("lo"), r(F.max("value")).alias("hi"), r(F.stddev_pop("value")).alias("spread"))


def _bump_sql(k: dict) -> str:
    d = " + ".join(f"(x{i} - {c}) ** 2" for i, c in enumerate(k["center"]))
    return f"{k['height']} * exp(-({d}) / {2 * k['width'] ** 2})"


_RAW = ", ".join(" + ".join([*(f"{w} * x{i}" for i, w in enumerate(b.LANDSCAPE[a])), *(f"{k['obj'][j]} * {_bump_sql(k)}" for k in b.LANDSCAPE["bumps"])]) + f" AS g{j + 1}" for j, a in enumerate(("a1", "a2")))


@query("f4_synthetic_objectives", f"WITH {LATENTS}, g AS (SELECT id, {_RAW} FROM x) SELECT id, round((g1 - min(g1) OVER ()) / (max(g1) OVER () - min(g1) OVER ()), 6) AS y1, round((g2 - min(g2) OVER ()) / (max(g2) OVER () - min(g2) OVER ()), 6) AS y2 FROM g")
def f4_synthetic_objectives(spark, sf_dir):
    return campaign.true_objectives(b.latents(spark, sf_dir), b.LANDSCAPE).select("id", r("y1").alias("y1"), r("y2").alias("y2"))


@query("f5_observed_table")
def f5_observed_table(spark, sf_dir):
    return campaign.with_noise(campaign.true_objectives(b.latents(spark, sf_dir), b.LANDSCAPE), (0.05, 0.05), 123)


@query("a11_pca_latents")
def a11_pca_latents(spark, sf_dir):
    return stats.pca(b.points(spark, sf_dir), "id", "x", 5)[0]


@query("a13_spearman_average", "SELECT round(corr(a, b), 6) AS rho FROM (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part)")
def a13_spearman_average(spark, sf_dir):
    return stats.spearman(b.parts(spark, sf_dir), "y1", "y2", "id").select(r("rho").alias("rho"))


@query("a12_spearman_ordinal", "SELECT round(corr(a, b), 6) AS rho FROM (SELECT row_number() OVER (ORDER BY p_size, p_partkey) AS a, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS b FROM part)")
def a12_spearman_ordinal(spark, sf_dir):
    return stats.spearman(b.parts(spark, sf_dir), "y1", "y2", "id", ties="ordinal").select(r("rho").alias("rho"))


_MEASURES = ("l_quantity", "l_extendedprice", "l_discount")


_BINNED = "b AS (SELECT CAST(least(floor((y1 - min(y1) OVER ()) / (max(y1) OVER () - min(y1) OVER ()) * 40), 39) AS INTEGER) AS bx, CAST(least(floor((y2 - min(y2) OVER ()) / (max(y2) OVER () - min(y2) OVER ()) * 40), 39) AS INTEGER) AS by_ FROM p)"
_RHO = "SELECT 'rho', NULL, round(corr(x, y), 6), NULL, NULL FROM (SELECT rank() OVER (ORDER BY y1) + (count(*) OVER (PARTITION BY y1) - 1) / 2.0 AS x, rank() OVER (ORDER BY y2) + (count(*) OVER (PARTITION BY y2) - 1) / 2.0 AS y FROM p)"


@query("v8_objective_space", f"WITH {PARTS}, {_BINNED}, f AS (SELECT DISTINCT y1, y2 FROM ({front_sql('p')})), s AS (SELECT *, row_number() OVER w AS n, lag(y1) OVER w AS q FROM f WINDOW w AS (ORDER BY y1)) SELECT 'cell' AS layer, CAST(NULL AS INTEGER) AS step, CAST(bx AS DOUBLE) AS x, CAST(by_ AS DOUBLE) AS y, count(*) AS n FROM b GROUP BY bx, by_ UNION ALL SELECT 'top', NULL, bx, NULL, count(*) FROM b GROUP BY bx UNION ALL SELECT 'right', NULL, NULL, by_, count(*) FROM b GROUP BY by_ UNION ALL SELECT 'front', CAST(2 * n - 1 AS INTEGER), y1, y2, NULL FROM s UNION ALL SELECT 'front', CAST(2 * n - 2 AS INTEGER), q, y2, NULL FROM s WHERE q IS NOT NULL UNION ALL SELECT 'initial', CAST(id - 1 AS INTEGER), y1, y2, NULL FROM p WHERE id BETWEEN 1 AND 12 UNION ALL SELECT 'reference', NULL, 900.0, 0.0, NULL UNION ALL {_RHO}")
def v8_objective_space(spark, sf_dir):
    """The joint plot of the objective space, as data."""
    truth = b.parts(spark, sf_dir).select("id", "y1", "y2")
    out = campaign.objective_space(truth, range(1, 13), (900.0, 0.0))
    return out.withColumn("x", F.when(F.col("layer") == "rho", r("x")).otherwise(F.col("x")))


@query("v7_correlations", " UNION ALL ".join(f"SELECT '{p}' AS a, '{q}' AS b, round(corr(x, y), 6) AS rho FROM (SELECT rank() OVER (ORDER BY {p}) + (count(*) OVER (PARTITION BY {p}) - 1) / 2.0 AS x, rank() OVER (ORDER BY {q}) + (count(*) OVER (PARTITION BY {q}) - 1) / 2.0 AS y FROM lineitem)" for i, p in enumerate(_MEASURES) for q in _MEASURES[i + 1 :]))
def v7_correlations(spark, sf_dir):
    rows = b.table(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey"))
    return stats.correlation_matrix(rows, _MEASURES, "id").select("a", "b", r("rho").alias("rho"))


@query("a14_quantile", "SELECT round(quantile_cont(l_extendedprice, 0.6), 6) AS l_extendedprice, round(quantile_cont(l_quantity, 0.6), 6) AS l_quantity FROM lineitem")
def a14_quantile(spark, sf_dir):
    q = stats.quantile(b.table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity"], 0.6)
    return q.select(r("l_extendedprice").alias("l_extendedprice"), r("l_quantity").alias("l_quantity"))


_ANGLE = "atan2(greatest(y2 - 0, 1e-9), greatest(y1 - 900, 1e-9))"


@query("a15_angular_spread", f"WITH {PARTS} SELECT grp, round(coalesce(stddev_samp({_ANGLE}), 0), 6) AS spread FROM p GROUP BY grp")
def a15_angular_spread(spark, sf_dir):
    return stats.angular_spread(b.parts(spark, sf_dir), "y1", "y2", (900.0, 0.0), ["grp"]).select("grp", r("spread").alias("spread"))


@query("a16_region_coverage", f"WITH {PARTS} SELECT grp, count(DISTINCT floor(least({_ANGLE}, pi() / 2 - 1e-9) / (pi() / 2) * 6)) AS regions FROM p GROUP BY grp")
def a16_region_coverage(spark, sf_dir):
    return stats.region_coverage(b.parts(spark, sf_dir), "y1", "y2", (900.0, 0.0), ["grp"])


@query("a20_lean", f"WITH {TEAMS} SELECT team, round(avg(y1 - y2), 6) AS lean FROM t GROUP BY team")
def a20_lean(spark, sf_dir):
    return stats.lean(b.teams(spark, sf_dir), "y1", "y2", ["team"]).select("team", r("lean").alias("lean"))


@query("a25_histogram", "SELECT CAST(least(floor((l_quantity - 1) / 49 * 25), 24) AS INTEGER) AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 1 AND 50 GROUP BY 1")
def a25_histogram(spark, sf_dir):
    return stats.histogram(b.table(spark, sf_dir, "lineitem"), "l_quantity", 1.0, 50.0, 25)


@query("a25_log_histogram", "SELECT CAST(least(floor((log10(o_totalprice) - 2) / 4 * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM orders WHERE log10(o_totalprice) BETWEEN 2 AND 6 GROUP BY 1")
def a25_log_histogram(spark, sf_dir):
    o = b.table(spark, sf_dir, "orders").select(F.log10("o_totalprice").alias("v"))
    return stats.histogram(o, "v", 2.0, 6.0, 20)


@query("a26_histogram_2d", f"WITH {LATENTS} SELECT CAST(least(floor(x0 * 30), 29) AS INTEGER) AS bx, CAST(least(floor(x1 * 30), 29) AS INTEGER) AS by_, count(*) AS n FROM x GROUP BY 1, 2")
def a26_histogram_2d(spark, sf_dir):
    x = b.latents(spark, sf_dir).select(F.get("x", F.lit(0)).alias("x0"), F.get("x", F.lit(1)).alias("x1"))
    return stats.histogram_2d(x, "x0", "x1", (0.0, 1.0), 30)


@query("a26_all_pairs", f"WITH {LATENTS} " + " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS dx, CAST({j} AS INTEGER) AS dy, CAST(least(floor(x{i} * 30), 29) AS INTEGER) AS bx, CAST(least(floor(x{j} * 30), 29) AS INTEGER) AS by_, count(*) AS n FROM x GROUP BY ALL" for i in range(5) for j in range(i + 1, 5)))
def a26_all_pairs(spark, sf_dir):
    """The histograms of all ten pairs of latent dimensions."""
    x = b.latents(spark, sf_dir).select(*(F.get("x", F.lit(k)).alias(f"x{k}") for k in range(5)))
    return stats.histogram_pairs(x, [f"x{k}" for k in range(5)], (0.0, 1.0), 30)


@query("a23_top_values", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 12")
def a23_top_values(spark, sf_dir):
    return stats.top_values(b.table(spark, sf_dir, "documents", "source"), "source", 12)


@query("a21_summary", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, count(DISTINCT {c}) AS n_distinct, CAST(min({c}) AS DOUBLE) AS min, round(CAST(quantile_cont({c}, 0.5) AS DOUBLE), 6) AS median, CAST(max({c}) AS DOUBLE) AS max FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")))
def a21_summary(spark, sf_dir):
    return stats.summary(b.table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"]).withColumn("median", r("median"))


@query("a27_cluster_sizes", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def a27_cluster_sizes(spark, sf_dir):
    return stats.group_sizes(b.points(spark, sf_dir), "label")


@query("a31_centroids", "SELECT label, CAST(i - 1 AS INTEGER) AS dim, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS c FROM embeddings, range(1, 65) t(i) GROUP BY label, i")
def a31_centroids(spark, sf_dir):
    return stats.group_means(b.points(spark, sf_dir), "label", "x").select("label", "dim", r("c").alias("c"))


@query("j10_nearest_centroid", "WITH m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS v FROM embeddings, range(1, 65) t(i) GROUP BY label, i), d AS (SELECT e.vec_id AS id, m.label, sum((CAST(e.embedding[m.i] AS DOUBLE) - m.v) ** 2) AS d FROM embeddings e, m GROUP BY e.vec_id, m.label) SELECT id, label AS centroid FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, label) AS n FROM d) WHERE n = 1")
def j10_nearest_centroid(spark, sf_dir):
    return stats.nearest_mean(b.points(spark, sf_dir), "id", "label", "x")


# --- expressions -----------------------------------------------------------------------------

_SEQ = "upper(regexp_replace(text, '[^A-Za-z]', '', 'g'))"


def _sequences(spark, sf_dir):
    return b.table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("s"))


def _share(letter: str) -> str:
    return f"(length(s) - length(replace(s, '{letter}', ''))) / CAST(greatest(length(s), 1) AS DOUBLE)"


@query("f2_composition", f"WITH q AS (SELECT doc_id, {_SEQ} AS s FROM documents) SELECT doc_id, " + ", ".join(f"round({_share(a)}, 6) AS f_{a.lower()}" for a in ALPHABET) + ", CAST(length(s) AS DOUBLE) AS f_len FROM q")
def f2_composition(spark, sf_dir):
    shaped = _sequences(spark, sf_dir).select("doc_id", *fx.composition("s"))
    return shaped.select("doc_id", *(r(c).alias(c) for c in shaped.columns[1:-1]), "f_len")


def _weighed(scale: dict[str, float]) -> str:
    return "round(" + " + ".join(f"{w} * {_share(a)}" for a, w in scale.items()) + ", 6)"


@query("f1_descriptors", f"WITH q AS (SELECT doc_id, {_SEQ} AS s FROM documents) SELECT doc_id, {_weighed(fx.HYDROPATHY)} AS hydropathy, {_weighed(fx.CHARGE)} AS charge, {_weighed(dict.fromkeys(fx.AROMATIC, 1.0))} AS aromatic, round(length(s) / 100.0, 6) AS scaled_length FROM q")
def f1_descriptors(spark, sf_dir):
    d = _sequences(spark, sf_dir).select("doc_id", *fx.descriptors("s"))
    return d.select("doc_id", *(r(c).alias(c) for c in ("hydropathy", "charge", "aromatic", "scaled_length")))


@query("a24_residue_frequency", f"WITH q AS (SELECT {_SEQ} AS s FROM documents), c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS residue, sum(length(s) - length(replace(s, '{a}', ''))) AS n FROM q" for a in ALPHABET) + ") SELECT residue, CAST(n AS BIGINT) AS n, round(100.0 * n / (SELECT sum(length(s)) FROM q), 6) AS pct FROM c")
def a24_residue_frequency(spark, sf_dir):
    """Letter counts are one aggregate row; no text is exploded into letters."""
    s = _sequences(spark, sf_dir)
    one = s.agg(F.sum(F.length("s")).alias("total"), *(F.sum(F.length("s") - F.length(F.replace("s", F.lit(a)))).alias(a) for a in ALPHABET))
    rows = ", ".join(f"'{a}', {a}" for a in ALPHABET)
    return one.selectExpr("total", f"stack({len(ALPHABET)}, {rows}) AS (residue, n)").select("residue", "n", r(100.0 * F.col("n") / F.col("total")).alias("pct"))


_PASS = "lower(trim(coalesce(lang, 'none'))) IN ('en', 'fr') AND lower(trim(coalesce(source, 'none'))) IN ('src0', 'src1', 'src2', 'src3') AND coalesce(quality, 0) = 1 AND coalesce(toxic, 0) <> 1 AND n_chars BETWEEN 90 AND 5000"
_RULES = {"lang": ("en", "fr"), "source": ("src0", "src1", "src2", "src3")}


def _accepted():
    return fx.first_rejection(_RULES).isNull() & fx.to_bool("quality") & ~fx.to_bool("toxic") & F.col("n_chars").between(90, 5000)


_CLEAN = f"upper(regexp_replace(text, '[^{ALPHABET}{ALPHABET.lower()}]', '', 'g')) || CASE WHEN doc_id % 10 = 0 THEN 'X' ELSE '' END"


@query("p6_ingest_filter", f"WITH q AS (SELECT doc_id, lang, source, quality, toxic, {_CLEAN} AS s FROM documents LEFT JOIN labels USING (doc_id)) SELECT doc_id, s AS sequence, length(s) AS n FROM q WHERE lang IN ('en', 'fr') AND source IN ('src0', 'src1', 'src2', 'src3') AND coalesce(quality, 0) = 1 AND coalesce(toxic, 0) <> 1 AND length(s) BETWEEN 90 AND 2000 AND doc_id % 10 <> 0")
def p6_ingest_filter(spark, sf_dir):
    """Documents as raw repertoire records, through the intake's own rule, at a length that texts have."""
    kept = ingest.filtered(b.repertoire(spark, sf_dir), low=90, high=2000)
    return kept.select("doc_id", "sequence", F.length("sequence").cast("bigint").alias("n"))


@query("p2_rejection_reason", "SELECT doc_id, CASE WHEN lower(trim(lang)) NOT IN ('en', 'fr') THEN 'lang' WHEN lower(trim(source)) NOT IN ('src0', 'src1', 'src2', 'src3') THEN 'source' END AS reason FROM documents")
def p2_rejection_reason(spark, sf_dir):
    return b.table(spark, sf_dir, "documents", "doc_id", "lang", "source").select("doc_id", fx.first_rejection(_RULES).alias("reason"))


@query("a28_first_copies", "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def a28_first_copies(spark, sf_dir):
    docs = b.table(spark, sf_dir, "documents", "doc_id", "text", "source")
    keyed = docs.select("doc_id", "source", F.sha2("text", 256).alias("k"))
    return ingest.first_copies(keyed, ["k"], "doc_id").select("doc_id", "source")


@query("a29_funnel", f"WITH q AS (SELECT coalesce({_PASS}, false) AS k, source FROM documents LEFT JOIN labels USING (doc_id)) SELECT count(*) AS scanned, count(*) FILTER (WHERE k) AS kept, round(count(*) FILTER (WHERE k) / CAST(count(*) AS DOUBLE), 6) AS pass_rate, count(DISTINCT CASE WHEN k THEN source END) AS distinct_sources FROM q")
def a29_funnel(spark, sf_dir):
    return ingest.funnel(b.records(spark, sf_dir), _accepted(), "source").withColumn("pass_rate", r("pass_rate"))


@query("s9_shard_cap", "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 5")
def s9_shard_cap(spark, sf_dir):
    return ingest.per_shard(b.table(spark, sf_dir, "documents", "doc_id", "source"), "source", "doc_id", 5)


@query("t5_early_stop", "WITH s AS (SELECT * FROM documents ORDER BY doc_id LIMIT 400) SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM s WHERE lang = 'en') WHERE n = 1 ORDER BY doc_id LIMIT 100")
def t5_early_stop(spark, sf_dir):
    docs = b.table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return ingest.stop_early(docs, "doc_id", F.col("lang") == "en", "text", 100, 400).select("doc_id")


@query("p18_slug", "SELECT c_custkey, coalesce(nullif(lower(trim(regexp_replace(trim(c_name), '[^0-9a-zA-Z]+', '_', 'g'), '_')), ''), 'team') AS slug FROM customer")
def p18_slug(spark, sf_dir):
    return b.table(spark, sf_dir, "customer").select("c_custkey", fx.slug("c_name").alias("slug"))


@query("p10_percent", "SELECT l_orderkey, l_linenumber, round(l_discount * 100, 6) AS pct FROM lineitem")
def p10_percent(spark, sf_dir):
    t = b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit(" "), (F.col("l_discount") * 100).cast("string"), F.lit("% ")).alias("p"))
    return t.select("l_orderkey", "l_linenumber", r(fx.percent("p")).alias("pct"))


@query("p4_to_bool", "SELECT l_orderkey, l_linenumber, l_returnflag IN ('Y', 'T') OR l_linestatus IN ('T', '1') OR l_linenumber = 1 AS flag FROM lineitem")
def p4_to_bool(spark, sf_dir):
    t = b.table(spark, sf_dir, "lineitem")
    return t.select("l_orderkey", "l_linenumber", (fx.to_bool("l_returnflag") | fx.to_bool("l_linestatus") | fx.to_bool("l_linenumber")).alias("flag"))


@query("p3_clean_sequence", r"SELECT c_custkey, upper(regexp_replace(c_name, '[.\-\s]', '', 'g')) AS s FROM customer")
def p3_clean_sequence(spark, sf_dir):
    return b.table(spark, sf_dir, "customer").select("c_custkey", fx.clean_sequence("c_name").alias("s"))


@query("p5_offending_residues", f"SELECT p_partkey, list_sort(list_distinct(string_split(regexp_replace(upper(replace(p_name, ' ', '')), '[{ALPHABET}]', '', 'g'), ''))) AS residues FROM part WHERE regexp_matches(upper(replace(p_name, ' ', '')), '[^{ALPHABET}]')")
def p5_offending_residues(spark, sf_dir):
    s = b.table(spark, sf_dir, "part").select("p_partkey", F.upper(F.replace("p_name", F.lit(" "))).alias("s"))
    return s.where(~fx.is_standard("s")).select("p_partkey", fx.offending_residues("s").alias("residues"))


@query("p12_derived", "SELECT o_orderkey, round(-log10(o_totalprice * 1e-9), 6) AS pkd, -o_shippriority - 1.5 AS neg_bv FROM (SELECT *, o_custkey % 7 AS o_shippriority FROM orders)")
def p12_derived(spark, sf_dir):
    o = b.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("affinity_kd_nm"), (F.col("o_custkey") % 7 + 1.5).alias("bv_elisa_score"))
    return tables.with_derived(o).select("o_orderkey", r("pkd").alias("pkd"), "neg_bv")


@query("p13_first_filled", "SELECT doc_id, coalesce(nullif(CASE WHEN lang = 'de' THEN '' ELSE lang END, ''), nullif(source, ''), '') AS origin FROM documents")
def p13_first_filled(spark, sf_dir):
    d = b.table(spark, sf_dir, "documents", "doc_id", "lang", "source").withColumn("run", F.when(F.col("lang") == "de", "").otherwise(F.col("lang")))
    return d.select("doc_id", fx.first_filled("run", "source").alias("origin"))


@query("p14_sequential_ids", "SELECT printf('VH-%05d', row_number() OVER (ORDER BY s_suppkey)) AS sequence_id, s_suppkey FROM supplier")
def p14_sequential_ids(spark, sf_dir):
    s = stats.ordinal_rank(b.table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey", "s_suppkey", "n")
    return s.select(F.format_string("VH-%05d", "n").alias("sequence_id"), "s_suppkey")


_CARD = "'scalarized_' || printf('%.2f', l_discount) || '_' || printf('%.2f', l_tax)"


@query("p21_card_grid", f"SELECT DISTINCT {_CARD} AS name, round(l_discount, 2) AS w1, round(l_tax, 2) AS w2, true AS known FROM lineitem UNION ALL SELECT DISTINCT lower(o_orderpriority), NULL, NULL, false FROM orders")
def p21_card_grid(spark, sf_dir):
    """Names of cards as two tables have them: weights that lines' rates make, and names that are none."""
    two = lambda c: F.format_string("%.2f", F.col(c).cast("double"))
    lines = b.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("scalarized_"), two("l_discount"), F.lit("_"), two("l_tax")).alias("name"))
    names = lines.union(b.table(spark, sf_dir, "orders").select(F.lower("o_orderpriority"))).distinct()
    w = fx.scalarized_weights("name")
    return names.select("name", r(F.get(w, F.lit(0)), 2).alias("w1"), r(F.get(w, F.lit(1)), 2).alias("w2"), fx.is_known_card("name").alias("known"))


@query("g11_build_latents")
def g11_build_latents(spark, sf_dir):
    return latents.build_latents(_sequences(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("s").alias("sequence")))[0]


@query("o10_compare_plans")
def o10_compare_plans(spark, sf_dir):
    pool, oracle, start = _setting(spark, sf_dir)
    return campaign.compare_plans(campaign.COMPARED, pool, oracle, start)


# --- cards, campaigns, sweeps -----------------------------------------------------------------


def _facts(spark, sf_dir):
    """Sweep facts from events: strategy = event type, seed = day of the month, auc = mean value."""
    t = b.table(spark, sf_dir, "events").select(F.col("event_type").alias("strategy"), F.dayofmonth("ts").alias("seed"), "value")
    return t.groupBy("strategy", "seed").agg(r(F.avg("value"), 9).alias("auc_hv"))


_FACTS = "f AS (SELECT event_type AS strategy, CAST(day(ts) AS INTEGER) AS seed, round(avg(value), 9) AS auc_hv, max(value) AS final_hv, count(DISTINCT user_id) AS n FROM events GROUP BY 1, 2)"


@query("a18_sweep_means", f"WITH {_FACTS} SELECT strategy, round(avg(auc_hv), 6) AS auc_hv_mean, round(avg(final_hv), 6) AS final_hv_mean, round(avg(n), 6) AS n_nondominated_mean, list(round(auc_hv, 6) ORDER BY seed) AS auc_hv_by_seed FROM f GROUP BY strategy")
def a18_sweep_means(spark, sf_dir):
    """Means over seeds by the sweep's own operator; measures that events lack are constants."""
    t = b.table(spark, sf_dir, "events").select(F.col("event_type").alias("strategy"), F.dayofmonth("ts").alias("seed"), "value", "user_id")
    facts = t.groupBy("strategy", "seed").agg(r(F.avg("value"), 9).alias("auc_hv"), F.max("value").alias("final_hv"), F.count_distinct("user_id").alias("n_nondominated"))
    facts = facts.select("*", *(F.lit(0.0).alias(c) for c in ("angular_spread", "region_coverage", "diversity")))
    m = campaign.sweep_means(facts)
    return m.select("strategy", *(r(c).alias(c) for c in ("auc_hv_mean", "final_hv_mean", "n_nondominated_mean")), F.transform("auc_hv_by_seed", lambda v: F.round(v, 6)).alias("auc_hv_by_seed"))


_ANGLE_T = "atan2(greatest(y2, 1e-9), greatest(y1, 1e-9))"


@query("a17_campaign_metrics", f"WITH {_SCORES}, g AS (SELECT team, coalesce(avg(gain), 0) AS mean_gain FROM (SELECT team, hv - lag(hv) OVER (PARTITION BY team ORDER BY rnd) AS gain FROM hist) GROUP BY team), la AS (SELECT t.* FROM t JOIN lo ON t.team = lo.team WHERE t.rnd > lo.r0), an AS (SELECT team, coalesce(stddev_samp({_ANGLE_T}), 0) AS spread, count(DISTINCT floor(least({_ANGLE_T}, pi() / 2 - 1e-9) / (pi() / 2) * 6)) AS regions FROM la GROUP BY team) SELECT auc.team, round(auc, 4) AS auc_hv, round(fin.hv, 4) AS final_hv, round(mean_gain, 4) AS mean_gain, round(coalesce(spread, 0), 6) AS angular_spread, coalesce(regions, 0) AS region_coverage, n AS n_nondominated FROM auc JOIN fin ON auc.team = fin.team JOIN fr ON auc.team = fr.team JOIN g ON auc.team = g.team LEFT JOIN an ON auc.team = an.team")
def a17_campaign_metrics(spark, sf_dir):
    m = campaign.team_metrics(b.teams(spark, sf_dir), "team", "rnd", "y1", "y2", (0.0, 0.0))
    return m.select("team", *(r(c, 4).alias(c) for c in ("auc_hv", "final_hv", "mean_gain")), r("angular_spread").alias("angular_spread"), "region_coverage", "n_nondominated")


@query("a33_seed_winners", f"WITH {_FACTS} SELECT seed, strategy, round(auc_hv, 6) AS auc_hv FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY auc_hv DESC, strategy) AS k FROM f) WHERE k = 1")
def a33_seed_winners(spark, sf_dir):
    return campaign.seed_winners(_facts(spark, sf_dir)).withColumn("auc_hv", r("auc_hv"))


@query("a34_wins_over", f"WITH {_FACTS} SELECT a.strategy, count(*) FILTER (WHERE a.auc_hv > c.auc_hv) AS wins, count(*) AS seeds FROM f a JOIN f c ON a.seed = c.seed AND c.strategy = 'click' AND a.strategy <> 'click' GROUP BY a.strategy")
def a34_wins_over(spark, sf_dir):
    return campaign.wins_over(_facts(spark, sf_dir), "click")


@query("a32_acq_margin", "WITH s AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice DESC) AS n FROM orders), w AS (SELECT max(v) - min(v) AS d FROM s) SELECT a.v AS qth_value, b.v AS next_value, round(a.v - b.v, 6) AS abs_margin, round((a.v - b.v) / d, 9) AS rel_margin FROM s a, s b, w WHERE a.n = 4 AND b.n = 5")
def a32_acq_margin(spark, sf_dir):
    m = cards.margin(b.table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("score")), 4)
    return m.select("qth_value", "next_value", r("abs_margin").alias("abs_margin"), r("rel_margin", 9).alias("rel_margin"))


def _setting(spark, sf_dir):
    """Pool, oracle and initial ids of a small campaign. The pool is read many times, so it is written once."""
    pool, _ = written(b.latents(spark, sf_dir), "pool")
    oracle = campaign.Oracle(campaign.true_objectives(pool, b.LANDSCAPE), (0.05, 0.05), 123)
    return pool, oracle, [int(x.id) for x in pool.select("id").orderBy("id").limit(12).collect()]


@query("c3_random_card")
def c3_random_card(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(cards.pick_random(b.latents(spark, sf_dir), 4, 123))), "pos int, id bigint")


@query("c4_uncertainty_card")
def c4_uncertainty_card(spark, sf_dir):
    pool, oracle, start = _setting(spark, sf_dir)
    c = campaign.Campaign("team", pool, oracle, start)
    model = surrogate.fit(c.rows(start), c.y)
    return spark.createDataFrame(list(enumerate(cards.pick_uncertain(select.without(pool, start), model, 4))), "pos int, id bigint")


@query("m2_posterior")
def m2_posterior(spark, sf_dir):
    pool, oracle, start = _setting(spark, sf_dir)
    c = campaign.Campaign("team", pool, oracle, start)
    return surrogate.posterior(pool, surrogate.fit(c.rows(start), c.y))


@query("o4_campaign")
def o4_campaign(spark, sf_dir):
    pool, oracle, start = _setting(spark, sf_dir)
    h = campaign.run_campaign("team", campaign.default_strategies()["mixed"], pool, oracle, start)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(h["hv_history"])], "round int, hv double")


@query("c5_nehvi_scores")
def c5_nehvi_scores(spark, sf_dir):
    """Every embedding's expected improvement on the first twelve, in three objectives: the two of the
    landscape, and how even the latent coordinates are."""
    pool, oracle, start = _setting(spark, sf_dir)
    c = campaign.Campaign("team", pool, oracle, start)
    x = c.rows(start)
    y = np.column_stack((c.y, 1 - x.std(1)))
    card = cards.build("nehvi", surrogate.fit(x, y), x, y, (-0.05, -0.05, 0.0), campaign.DEFAULTS.seed)
    return cards.score_pool(pool, card, np.empty((0, 5))).select("id", "score")


@query("o2_continuous_batch")
def o2_continuous_batch(spark, sf_dir):
    """A batch found in the box by gradient, a start to a task, and projected onto the pool."""
    pool, oracle, start = _setting(spark, sf_dir)
    c = campaign.Campaign("team", pool, oracle, start)
    x = c.rows(start)
    ids = cards.propose({"nehvi": 2, "parego": 2}, surrogate.fit(x, c.y), pool, start, x, c.y, optimize="continuous")
    return spark.createDataFrame(list(enumerate(ids)), "pos int, id bigint")


_BY_HOUR = "h AS (SELECT event_type AS strategy, CAST(day(ts) AS INTEGER) AS seed, hour(ts) AS k, max(value) AS hv, count(*) AS n FROM events GROUP BY ALL), f AS (SELECT strategy, seed, hv, row_number() OVER (PARTITION BY strategy, seed ORDER BY k) - 1 AS round FROM h), g AS (SELECT strategy, seed, count(*) AS regions, avg(hv) AS auc FROM h GROUP BY ALL), c AS (SELECT strategy, avg(regions) AS regions, avg(auc) AS auc FROM g GROUP BY strategy)"


@query("v9_sweep_curves", f"WITH {_BY_HOUR} SELECT f.strategy, CAST(round AS INTEGER) AS round, round(avg(hv), 6) AS hv_mean, round(any_value(c.regions), 6) AS region_coverage_mean, round(any_value(c.auc), 6) AS auc_hv_mean FROM f JOIN c ON f.strategy = c.strategy GROUP BY ALL")
def v9_sweep_curves(spark, sf_dir):
    """Curves of a sweep's plot: an event type is a strategy, a day a seed, an hour a round."""
    t = b.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("strategy"), F.dayofmonth("ts").alias("seed"), F.hour("ts").alias("k")).agg(F.max("value").alias("hv"))
    rows = F.array_sort(F.collect_list(F.struct("k", "hv")))  # at most 24
    facts = t.groupBy("strategy", "seed").agg(F.transform(rows, lambda x: x["hv"]).alias("hv_history"), F.count(F.lit(1)).alias("region_coverage"), F.avg("hv").alias("auc_hv"))
    curves = campaign.sweep_curves(facts)
    return curves.select("strategy", "round", *(r(c).alias(c) for c in ("hv_mean", "region_coverage_mean", "auc_hv_mean")))


_NAMES = list(campaign.default_strategies())
_RIVALS = "('mixed', 'scalarization_sweep', 'explore_then_exploit', 'all_parego')"
_CRITERIA = (
    f"f AS (SELECT list_value({', '.join(repr(n) for n in _NAMES)})[CAST(user_id % 7 AS INTEGER) + 1] AS strategy, user_id // 7 % 3 AS seed, round(avg(value), 9) AS auc, count(DISTINCT user_id) AS regions FROM events GROUP BY ALL), "
    "m AS (SELECT strategy, avg(auc) AS auc, avg(regions) AS regions FROM f GROUP BY strategy), "
    "o AS (SELECT max(auc) FILTER (strategy = 'all_nehvi') AS nehvi, max(auc) FILTER (strategy = 'random_baseline') AS random, max(regions) FILTER (strategy = 'all_nehvi') AS rn, max(regions) FILTER (strategy = 'all_parego') AS rp, max(regions) FILTER (strategy = 'all_scalarized_0.8_0.2') AS rs FROM m), "
    f"w AS (SELECT count(*) AS n FROM f a JOIN f c ON a.seed = c.seed AND c.strategy = 'all_nehvi' AND a.strategy IN {_RIVALS} AND a.auc > c.auc), "
    "s AS (SELECT count(DISTINCT strategy) AS n FROM (SELECT strategy, row_number() OVER (PARTITION BY seed ORDER BY auc DESC, strategy) AS k FROM f) WHERE k = 1), "
    "t AS (SELECT max(auc) AS a, max(auc) FILTER (k = 2) AS b FROM (SELECT auc, row_number() OVER (ORDER BY auc DESC) AS k FROM m))"
)


@query("o7_acceptance", f"WITH {_CRITERIA}, l(criterion, passed) AS (SELECT '1', true UNION ALL SELECT '2', nehvi > random FROM o UNION ALL SELECT '3', n > 0 FROM w UNION ALL SELECT '4', rs < rn FROM o UNION ALL SELECT '5', rp > rs FROM o UNION ALL SELECT '6', s.n >= 2 OR (a - b) / abs(a) < 0.15 FROM s, t UNION ALL SELECT '7', true UNION ALL SELECT '8', true UNION ALL SELECT 'margin', true UNION ALL SELECT '9', true) SELECT criterion, passed, criterion = '9' AS info FROM l")
def o7_acceptance(spark, sf_dir):
    """The acceptance list over facts that events make: users are dealt to the seven strategies and three seeds."""
    t = b.table(spark, sf_dir, "events")
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("user_id") % 7).cast("int") + 1)
    facts = t.groupBy(name.alias("strategy"), (F.floor(F.col("user_id") / 7) % 3).alias("seed")).agg(r(F.avg("value"), 9).alias("auc_hv"), F.count_distinct("user_id").alias("region_coverage"))
    facts = facts.select("*", *(F.lit(0.0).alias(c) for c in ("final_hv", "angular_spread", "diversity", "n_nondominated")))
    return campaign.criteria(facts, True, {"abs_margin": 0.5}, 10.0, 3, 0.9, 1.0).select("criterion", "passed", "info")


#: Three seeds from the default one on, as the reference's sweep has.
SWEEP_SEEDS = [123, 124, 125]


@query("o6_sweep")
def o6_sweep(spark, sf_dir):
    pool, oracle, start = _setting(spark, sf_dir)
    return campaign.sweep_means(campaign.sweep_facts(campaign.default_strategies(), pool, oracle, start, SWEEP_SEEDS))


from . import files  # noqa: E402,F401 adds the queries of sources and sinks

# read back from files, these are the rows of the queries that they were written from
ORACLE_SQL["s3_load_latents"] = f"WITH {LATENTS} SELECT id, {', '.join(f'round(x{k}, 6) AS x{k}' for k in range(5))} FROM x"
ORACLE_SQL["s5_load_true_objectives"] = ORACLE_SQL["f4_synthetic_objectives"]
ORACLE_SQL["s13_pool_from_files"] = f"WITH {LATENTS} SELECT id, round(x0, 6) AS x0, round(x4, 6) AS x4, 'QVQL' || substr('{ALPHABET}', CAST(label + 1 AS INTEGER), 1) AS sequence FROM x JOIN embeddings ON id = vec_id"
ORACLE_SQL["k2_leaderboard_csv"] = ORACLE_SQL["o9_leaderboard"]
ORACLE_SQL["k7_intake_stats"] = ORACLE_SQL["a29_funnel"]


def entry(spark: SparkSession) -> DataFrame:
    return a3_hypervolume_by_group(spark, "/root/testdata/sf0.001")

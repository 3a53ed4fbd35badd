"""Queries of sources and sinks: each writes a file with the library's writer and reads it back
with the library's reader, so that a row of either that is wrong shows in the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import ALPHABET
from ..operators import campaign, cards, ingest, pareto
from ..sources import arrays, tables
from ..sources.scratch import scratch_path
from ..sources.workbook import write_workbook
from . import bindings as b
from .catalogue import _accepted as accepted
from .registry import QUERIES, query, r

_SEQ = f"'QVQL' || regexp_replace(upper(p_name), '[^{ALPHABET}]', '', 'g')"
_LIBRARY = f"lib AS (SELECT printf('VH-%05d', row_number() OVER (ORDER BY p_partkey)) AS sequence_id, {_SEQ} AS sequence, CAST(length({_SEQ}) AS INTEGER) AS length, p_brand AS source, CAST(p_size AS INTEGER) AS cluster_id, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part)"


def _library_file(spark, sf_dir) -> str:
    """A library CSV from parts; their keys count from 0."""
    seq = F.concat(F.lit("QVQL"), F.regexp_replace(F.upper("p_name"), f"[^{ALPHABET}]", ""))
    p = b.table(spark, sf_dir, "part").select(F.format_string("VH-%05d", F.col("p_partkey") + 1).alias("sequence_id"), seq.alias("sequence"), F.length(seq).alias("length"), F.col("p_brand").alias("source"), F.col("p_size").alias("cluster_id"))
    path = scratch_path(spark, "library")
    tables.write_csv(p, path)
    return path


@query("s1_load_library", f"WITH {_LIBRARY} SELECT sequence_id, sequence, length, source, cluster_id FROM lib")
def s1_load_library(spark, sf_dir):
    return tables.read_library(spark, _library_file(spark, sf_dir))


@query("s2_load_sequences", f"WITH {_LIBRARY} SELECT pos, sequence FROM lib")
def s2_load_sequences(spark, sf_dir):
    return tables.read_sequences(spark, _library_file(spark, sf_dir))


@query("s11_reservoir", f"WITH {_LIBRARY} SELECT sequence, source, 'IGHG' AS isotype FROM lib")
def s11_reservoir(spark, sf_dir):
    path = scratch_path(spark, "reservoir")
    tables.write_csv(tables.read_library(spark, _library_file(spark, sf_dir)).select("sequence", "source", F.lit("IGHG").alias("isotype")), path, gzip=True)
    return tables.read_reservoir(spark, path)


def _latents_file(spark, sf_dir) -> str:
    path = scratch_path(spark, "latents")
    tables.write_matrix(b.latents(spark, sf_dir), path)
    return path


@query("s3_load_latents", None)
def s3_load_latents(spark, sf_dir):
    x = tables.read_matrix(spark, _latents_file(spark, sf_dir), 5, unit_range=True)
    return x.select("id", *(r(F.get("x", F.lit(k))).alias(f"x{k}") for k in range(5)))


@query("s3_embeddings_npy", "SELECT vec_id AS id, round(CAST(embedding[1] AS DOUBLE), 6) AS first, round(CAST(embedding[64] AS DOUBLE), 6) AS last, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings")
def s3_embeddings_npy(spark, sf_dir):
    """Whole embeddings as array files, a range of rows to a file, and back in ranges of rows."""
    path = f"{scratch_path(spark, 'embeddings')}/embeddings.npy"
    arrays.write_array(b.points(spark, sf_dir), path)
    x = tables.read_matrix(spark, path, 64)
    return x.select("id", r(F.get("x", F.lit(0))).alias("first"), r(F.get("x", F.lit(63))).alias("last"), r(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


@query("s5_load_true_objectives", None)
def s5_load_true_objectives(spark, sf_dir):
    path = scratch_path(spark, "objectives")
    tables.write_matrix(campaign.true_objectives(b.latents(spark, sf_dir), b.LANDSCAPE).select("id", F.array("y1", "y2").alias("x")), path)
    return tables.objectives_from_file(spark, path).select("id", r("y1").alias("y1"), r("y2").alias("y2"))


@query("s13_pool_from_files", None)
def s13_pool_from_files(spark, sf_dir):
    """Sequences and latents that were written apart meet by their place."""
    letter = F.substring(F.lit(ALPHABET), (F.col("label") + 1).cast("int"), F.lit(1))
    seq = F.concat(F.lit("QVQL"), letter)
    path = scratch_path(spark, "library")
    tables.write_csv(b.points(spark, sf_dir).select(F.format_string("VH-%05d", F.col("id") + 1).alias("sequence_id"), seq.alias("sequence"), F.length(seq).alias("length"), F.lit("s").alias("source"), F.col("label").alias("cluster_id")), path)
    pool = tables.pool_from_files(spark, path, _latents_file(spark, sf_dir))
    return pool.select("id", r(F.get("x", F.lit(0))).alias("x0"), r(F.get("x", F.lit(4))).alias("x4"), "sequence")


@query("s4_initial_ids", "SELECT CAST(n AS INTEGER) AS pos, p_partkey AS id FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS n FROM part) WHERE n < 12")
def s4_initial_ids(spark, sf_dir):
    ids = [x.id for x in b.parts(spark, sf_dir).orderBy("y1", "id").limit(12).collect()]
    path = scratch_path(spark, "initial")
    tables.write_initial(spark, ids, 123, path)
    return tables.read_initial(spark, path)


@query("s14_params", "SELECT n_nationkey AS bump, round(0.2::DOUBLE + 0.01::DOUBLE * n_regionkey, 6) AS width, round(n_nationkey / 50.0::DOUBLE - 0.25::DOUBLE, 6) AS height, round(n_nationkey / 25.0::DOUBLE, 6) AS c0, CAST(n_regionkey AS DOUBLE) AS o1 FROM nation")
def s14_params(spark, sf_dir):
    """A landscape with a bump for each nation, written and read back."""
    at = F.col("n_nationkey") / 25.0
    rows = b.table(spark, sf_dir, "nation").select("n_nationkey", F.array(*[at] * 5).alias("center"), (0.2 + 0.01 * F.col("n_regionkey")).alias("width"), (F.col("n_nationkey") / 50.0 - 0.25).alias("height"), F.array(F.lit(1.0), F.col("n_regionkey").cast("double")).alias("obj"))
    bumps = [x.asDict() for x in rows.orderBy("n_nationkey").drop("n_nationkey").collect()]  # a landscape's few bumps
    path = scratch_path(spark, "params")
    tables.write_params(spark, {"a1": b.LANDSCAPE["a1"], "a2": b.LANDSCAPE["a2"], "bumps": bumps}, path)
    got = tables.read_params(spark, path)["bumps"]
    return spark.createDataFrame([(i, *(round(v, 6) for v in (k["width"], k["height"], k["center"][0])), k["obj"][1]) for i, k in enumerate(got)], "bump bigint, width double, height double, c0 double, o1 double")


_SHEET = f"SELECT 'S' || s_suppkey AS sample_id, 'QVQL' || substr('{ALPHABET}', CAST(s_suppkey % 20 + 1 AS INTEGER), 1) AS sequence, 5 AS length, 'IGHV' || s_nationkey AS germline, CAST(70 + s_suppkey % 30 AS DOUBLE) + 0.5 AS germline_identity_pct, s_acctbal AS tm_celsius, CAST(s_suppkey AS DOUBLE) AS bv_elisa_score, CAST(s_nationkey + 1 AS DOUBLE) AS affinity_kd_nm, CAST(2 AS DOUBLE) AS yield_mg_per_10ml FROM supplier"


def _sheet_file(spark, sf_dir) -> str:
    """A raw measurement sheet: its own headers, blanks, lower case, percent signs."""
    s = b.table(spark, sf_dir, "supplier")
    seq = F.concat(F.lit(" qvql"), F.lower(F.substring(F.lit(ALPHABET), (F.col("s_suppkey") % 20 + 1).cast("int"), F.lit(1))), F.lit(" "))
    raw = {
        "Sample ID": F.concat(F.lit(" S"), "s_suppkey", F.lit(" ")),
        "Seq": seq,
        "Germline": F.concat(F.lit("IGHV"), "s_nationkey"),
        "Germline_Identity%": F.concat((F.col("s_suppkey") % 30 + 70).cast("string"), F.lit(".5%")),
        "Tm (oC)": F.col("s_acctbal"),
        "BV Elisa score": F.col("s_suppkey").cast("double"),
        "Affinity, Kd (nM)": (F.col("s_nationkey") + 1).cast("double"),
        "Yield (mg per 10 mL culture)": F.lit(2.0),
    }
    path = scratch_path(spark, "sheet")
    tables.write_csv(s.select(*(c.alias(n) for n, c in raw.items())), path)
    return path


@query("s6_parse_measurements", _SHEET)
def s6_parse_measurements(spark, sf_dir):
    return tables.read_measurements(spark, _sheet_file(spark, sf_dir), raw=True)


@query("s6_workbook", _SHEET)
def s6_workbook(spark, sf_dir):
    """The same sheet as a workbook."""
    raw = spark.read.option("header", True).csv(_sheet_file(spark, sf_dir))
    path = f"{scratch_path(spark, 'workbook')}/sheet.xlsx"
    write_workbook(raw.withColumn("Tm (oC)", F.col("`Tm (oC)`").cast("double")), path)
    return tables.read_measurements(spark, path)


@query("s7_load_table", _SHEET)
def s7_load_table(spark, sf_dir):
    """A parsed table and a raw sheet give the same rows; the header tells which it is."""
    path = scratch_path(spark, "parsed")
    tables.write_csv(tables.read_measurements(spark, _sheet_file(spark, sf_dir)), path)
    return tables.read_measurements(spark, path)


@query("s8_record_stream", "SELECT doc_id, source FROM documents")
def s8_record_stream(spark, sf_dir):
    return ingest.record_stream(spark, f"{sf_dir}/documents.parquet", ["doc_id", "source"], seed=7, key="doc_id")


def _shards_sql(shards: int, share: int, most: int) -> str:
    """Shard by shard: rows in order, first copies, less what earlier shards gave, up to the share."""
    steps = [f"q AS (SELECT doc_id % {shards} AS shard, row_number() OVER (PARTITION BY doc_id % {shards} ORDER BY doc_id) - 1 AS pos, doc_id, upper(source) || lang AS sequence, source FROM documents), c AS (SELECT * FROM q WHERE pos < {most} AND doc_id % 3 <> 0)"]
    for k in range(shards):
        seen = "".join(f" AND sequence NOT IN (SELECT sequence FROM s{j})" for j in range(k))
        steps.append(f"s{k} AS (SELECT sequence, source, pos FROM (SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY pos) AS n FROM c WHERE shard = {k}{seen}) WHERE n = 1 ORDER BY pos LIMIT {share})")
    return f"WITH {', '.join(steps)} " + " UNION ALL ".join(f"SELECT sequence, source FROM s{k}" for k in range(shards))


@query("s9_collect_shards", _shards_sql(4, 10, 150))
def s9_collect_shards(spark, sf_dir):
    docs, root = b.table(spark, sf_dir, "documents", "doc_id", "source", "lang"), scratch_path(spark, "shards")
    shards = [f"{root}/shard-{k}" for k in range(4)]
    for k, path in enumerate(shards):
        docs.where(F.col("doc_id") % 4 == k).coalesce(1).sortWithinPartitions("doc_id").write.parquet(path)
    return ingest.collect_shards(spark, shards, 40, F.col("doc_id") % 3 != 0, F.concat(F.upper("source"), "lang"), {"source": F.col("source")}, most=150)[0]


@query("s10_choose_shards", f"SELECT doc_id, source FROM documents WHERE doc_id % 20 IN ({', '.join(str(k * 20 // 7) for k in range(7))})")
def s10_choose_shards(spark, sf_dir):
    """A table's shards as files; 7 of the 20 are chosen at even strides and read."""
    root = scratch_path(spark, "shards")
    docs = b.table(spark, sf_dir, "documents", "doc_id", "source")
    docs.withColumn("shard", F.format_string("%02d", F.col("doc_id") % 20)).write.mode("overwrite").partitionBy("shard").parquet(root)
    return spark.read.parquet(*ingest.choose_shards(ingest.shards_of(spark, root), 7))


_TEAM_RUNS = "t AS (SELECT user_id, event_id, value AS y1, coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS y2, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events)"


@query("k1_team_runs", f"WITH {_TEAM_RUNS} SELECT 'Team ' || user_id AS team_name, CAST(pos AS INTEGER) AS pos, CAST(CASE WHEN pos < 2 THEN 0 ELSE floor((pos - 2) / 4) + 1 END AS INTEGER) AS round, y1, y2 FROM t")
def k1_team_runs(spark, sf_dir):
    """Every user's events as a run: two initial rows, then four to a round. Runs are written under their
    teams' slugs and found again by their folder."""
    t, folder = b.teams(spark, sf_dir), scratch_path(spark, "runs")
    rows = F.array_sort(F.collect_list(F.struct("id", F.array("y1", F.coalesce("y2", F.lit(0.0))).alias("y"))))
    own = t.groupBy("team").agg(rows.alias("rows")).select(F.concat(F.lit("Team "), "team").alias("team_name"), F.transform("rows", lambda x: x["y"]).alias("final_Y"))
    known = {"seed": F.lit(123), "batch_size": F.lit(4), "n_initial": F.lit(2), "projection_method": F.lit("nearest")}
    tables.write_runs(own.select("team_name", "final_Y", *(c.alias(n) for n, c in known.items()), *(F.lit(None).cast(k).alias(n) for n, k in tables.RUN if n not in ("team_name", "final_Y", *known))), folder)
    return tables.run_points(tables.read_runs(spark, folder))


@query("k2_leaderboard_csv", None)
def k2_leaderboard_csv(spark, sf_dir):
    board, path = QUERIES["o9_leaderboard"](spark, sf_dir), scratch_path(spark, "leaderboard")
    tables.write_csv(board, path)
    return spark.read.schema(board.schema).option("header", True).csv(path)


@query("k7_intake_stats", None)
def k7_intake_stats(spark, sf_dir):
    """The reservoir and its counters are written by one reading of the records."""
    _, counters = ingest.intake(b.records(spark, sf_dir), accepted(), "source", scratch_path(spark, "reservoir"))
    path = scratch_path(spark, "stats")
    tables.write_stats(spark, {**counters, "pass_rate": round(counters["pass_rate"], 6)}, path)
    return spark.read.schema("scanned bigint, kept bigint, pass_rate double, distinct_sources bigint").json(path)


@query("p7_valid_heavy", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber <> 1 AND CASE WHEN l_linenumber = 2 THEN 0 ELSE l_quantity END >= 10")
def p7_valid_heavy(spark, sf_dir):
    score = F.when(F.col("l_linenumber") != 2, F.col("l_quantity").cast("double"))
    result = F.struct(F.when(F.col("l_returnflag") == "R", "H").otherwise("L").alias("chain"), F.when(F.col("l_linenumber") == 1, "failed").alias("error"), score.alias("score"))
    return b.table(spark, sf_dir, "lineitem").withColumn("result", result).where(ingest.valid_heavy("result", 10.0)).select("l_orderkey", "l_linenumber")


@query("p8_validated", "SELECT c_custkey, c_name FROM customer WHERE length(c_name) % 2 = 0 OR c_custkey % 2 = 0 AND right(c_name, 1) = '4'")
def p8_validated(spark, sf_dir):
    """An external model's answers, in order, at most 64 texts at a time."""
    accept = lambda texts: [len(t) % 2 == 0 or t.endswith("4") for t in texts]
    return ingest.validated(b.table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", accept)


@query("p22_check_plan", "SELECT l_orderkey, l_linenumber, l_linenumber - 1 + CAST(l_quantity AS INTEGER) % 6 - 1 = 4 AND CAST(l_quantity AS INTEGER) % 6 >= 1 AND l_returnflag <> 'R' AS ok FROM lineitem")
def p22_check_plan(spark, sf_dir):
    """Plans as order lines make them: slots below zero, too many or too few, and names of no card."""
    other = F.when(F.col("l_returnflag") == "R", F.lower("l_returnflag")).otherwise(F.lit("scalarized_0.5_0.5"))
    plan = F.create_map(F.lit("nehvi"), F.col("l_linenumber").cast("int") - 1, other, F.col("l_quantity").cast("int") % 6 - 1)
    return b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cards.valid_plan(plan, 4).alias("ok"))


_LAYERS = "y AS (SELECT 'true front' AS layer, p_retailprice AS y1, CAST(p_size AS DOUBLE) AS y2 FROM part UNION SELECT 'T' || (p_partkey % 3), p_retailprice, CAST(p_size AS DOUBLE) FROM part WHERE p_partkey % 5 = 0 UNION SELECT 'T' || k, p_retailprice, CAST(p_size AS DOUBLE) FROM part, range(3) t(k) WHERE p_partkey IN (1, 2))"


@query("o8_reveal", f"WITH {_LAYERS}, f AS (SELECT a.* FROM y a WHERE NOT EXISTS (SELECT 1 FROM y b WHERE b.layer = a.layer AND b.y1 >= a.y1 AND b.y2 >= a.y2 AND (b.y1 > a.y1 OR b.y2 > a.y2))), s AS (SELECT *, row_number() OVER w AS n, lag(y1) OVER w AS q FROM f WINDOW w AS (PARTITION BY layer ORDER BY y1)) SELECT layer, CAST(2 * n - 1 AS INTEGER) AS step, y1 AS x, y2 AS y FROM s UNION ALL SELECT layer, CAST(2 * n - 2 AS INTEGER), q, y2 FROM s WHERE q IS NOT NULL")
def o8_reveal(spark, sf_dir):
    """The true front and each team's, over what it selected and the initial ids 1 and 2."""
    truth = b.parts(spark, sf_dir).select("id", "y1", "y2")
    runs = truth.where("id % 5 = 0").groupBy(F.concat(F.lit("T"), F.col("id") % 3).alias("team_name")).agg(F.collect_list("id").alias("selected_ids"))
    return campaign.reveal(runs, truth, (1, 2)).select("layer", "step", "x", "y")


@query("w1_front_of_fronts", "SELECT DISTINCT y1, y2 FROM (SELECT p_retailprice AS y1, CAST(p_size AS DOUBLE) AS y2 FROM part) a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_retailprice >= a.y1 AND b.p_size >= a.y2 AND (b.p_retailprice > a.y1 OR b.p_size > a.y2))")
def w1_front_of_fronts(spark, sf_dir):
    """The front of the brands' fronts is the front."""
    return pareto.front_values(pareto.front_values(b.parts(spark, sf_dir), "y1", "y2", ["grp"]), "y1", "y2")

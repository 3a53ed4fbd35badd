"""Readers and writers with fixed schemas and checked contracts.

Checks are one aggregate per table; a broken contract raises with up to three examples.
"""

from __future__ import annotations

import io
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_sequence, is_standard, offending_residues, percent
from . import arrays
from .workbook import read_workbook

# Schemas as (name, type) pairs; :func:`ddl` is what Spark's readers take.
LIBRARY = (("sequence_id", "string"), ("sequence", "string"), ("length", "int"), ("source", "string"), ("cluster_id", "int"))
RESERVOIR = (("sequence", "string"), ("source", "string"), ("isotype", "string"))
MEASUREMENTS = (("sample_id", "string"), ("sequence", "string"), ("length", "int"), ("germline", "string"), *((n, "double") for n in ("germline_identity_pct", "tm_celsius", "bv_elisa_score", "affinity_kd_nm", "yield_mg_per_10ml")))
INITIAL = (("seed", "int"), ("initial_ids", "array<int>"))
PARAMS = (("a1", "array<double>"), ("a2", "array<double>"), ("bumps", "array<struct<center:array<double>,width:double,height:double,obj:array<double>>>"))
RUN = (
    ("team_name", "string"),
    ("seed", "int"),
    ("batch_size", "int"),
    ("n_rounds", "int"),
    ("projection_method", "string"),
    ("strategy", "array<map<string,int>>"),
    ("rounds", "array<struct<round:int,plan:map<string,int>,ids:array<bigint>,Y:array<array<double>>,hv:double>>"),
    ("hv_history", "array<double>"),
    ("selected_ids", "array<bigint>"),
    ("final_Y", "array<array<double>>"),
    ("n_initial", "int"),
    ("auc_hv", "double"),
    ("final_hv", "double"),
    ("n_nondominated_selected", "int"),
    ("embedding_diversity", "double"),
)


def ddl(schema) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in schema)


def typed(df: DataFrame, schema) -> DataFrame:
    """The schema's columns, cast, in its order; raises where one is missing."""
    require_columns(df, [n for n, _ in schema])
    return df.select(*(F.col(n).cast(t).alias(n) for n, t in schema))


#: Headers of the raw measurement sheet.
RAW_HEADERS = {
    "Sample ID": "sample_id",
    "Seq": "sequence",
    "Germline": "germline",
    "Germline_Identity%": "germline_identity_pct",
    "Tm (oC)": "tm_celsius",
    "BV Elisa score": "bv_elisa_score",
    "Affinity, Kd (nM)": "affinity_kd_nm",
    "Yield (mg per 10 mL culture)": "yield_mg_per_10ml",
}


class ContractError(ValueError):
    """A table does not have the rows or columns that its readers rely on."""


def require_columns(df: DataFrame, columns) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"missing columns {missing}; there are {df.columns}")
    return df


def check_sequences(df: DataFrame, key: str | None, column: str = "sequence") -> DataFrame:
    """Raises unless keys are unique and every sequence is of the standard alphabet."""
    bad = df.agg(F.count_if(~F.coalesce(is_standard(column), F.lit(False))).alias("bad"), *([F.count(key).alias("n"), F.count_distinct(key).alias("d")] if key else [])).first()
    if key and bad.n != bad.d:
        raise ContractError(f"{bad.n - bad.d} repeated values of {key}")
    if bad.bad:
        rows = df.where(~F.coalesce(is_standard(column), F.lit(False))).select(column, offending_residues(F.coalesce(column, F.lit(""))).alias("residues")).limit(3).collect()
        raise ContractError(f"{bad.bad} sequences with other residues, as {[(r[0], list(r.residues)) for r in rows]}")
    return df


def read_library(spark: SparkSession, path: str) -> DataFrame:
    """A library CSV; checked for columns, unique ids and the alphabet."""
    header = spark.read.option("header", True).csv(path)
    return check_sequences(typed(header, LIBRARY), "sequence_id")


def read_reservoir(spark: SparkSession, path: str) -> DataFrame:
    """A reservoir CSV, gzipped or not (a gzipped file is one task; prefer several)."""
    return spark.read.schema(ddl(RESERVOIR)).option("header", True).csv(path)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(pos, sequence) of a library, in the order of its ids."""
    ids = F.regexp_extract("sequence_id", "([0-9]+)$", 1).cast("bigint")
    return read_library(spark, path).select((ids - 1).alias("pos"), "sequence")


def read_measurements(spark: SparkSession, path: str, raw: bool | None = None) -> DataFrame:
    """The measurement table as a workbook's first sheet or as CSV, parsed before or with the sheet's
    own headers; these are told by the header row unless ``raw`` says so."""
    df = read_workbook(spark, path) if path.endswith(".xlsx") else spark.read.option("header", True).csv(path)
    if raw is None:
        raw = "sample_id" not in df.columns
    if raw:
        df = parse_measurements(df)
    return check_sequences(typed(df, MEASUREMENTS), "sample_id")


def parse_measurements(df: DataFrame) -> DataFrame:
    """Renames, trims, parses percentages (anything else raises) and derives the length."""
    require_columns(df, RAW_HEADERS)
    named = df.select(*(F.col(f"`{old}`").alias(new) for old, new in RAW_HEADERS.items()))
    named = named.withColumn("sample_id", F.trim("sample_id")).withColumn("sequence", F.upper(F.trim("sequence"))).withColumn("germline", F.trim("germline")).withColumn("germline_identity_pct", percent("germline_identity_pct"))
    return typed(named.withColumn("length", F.length("sequence")), MEASUREMENTS)


def with_derived(df: DataFrame) -> DataFrame:
    """pkd (of an affinity in nM) and the negated binding score."""
    return df.withColumn("pkd", -F.log10(F.col("affinity_kd_nm") * 1e-9)).withColumn("neg_bv", -F.col("bv_elisa_score"))


def read_matrix(spark: SparkSession, path: str, width: int, unit_range: bool = False) -> DataFrame:
    """A matrix as (id, x): Parquet, or .npy (a file, or a folder of that name with parts). Array files
    are read in ranges of rows; where only Spark reaches them, each whole by one task."""
    if not path.rstrip("/").endswith(".npy"):
        return check_matrix(spark.read.parquet(path), width, unit_range)
    try:
        arrays.opened(path)
    except pa.ArrowInvalid:
        return check_matrix(_whole_arrays(spark, path, width), width, unit_range)
    return check_matrix(arrays.read_array(spark, path), width, unit_range)


def _whole_arrays(spark: SparkSession, path: str, width: int) -> DataFrame:
    content = spark.read.format("binaryFile").load(path).select("content")

    def rows(batches):
        import pandas as pd

        for pdf in batches:
            for raw in pdf["content"]:
                m = np.load(io.BytesIO(raw), allow_pickle=False).astype(float)
                if m.ndim != 2 or m.shape[1] != width:
                    raise ValueError(f"expected [N, {width}], got {m.shape}")
                yield pd.DataFrame({"id": np.arange(len(m)), "x": list(m)})

    return content.mapInPandas(rows, "id bigint, x array<double>")


def check_matrix(df: DataFrame, width: int, unit_range: bool = False) -> DataFrame:
    outside = F.exists("x", lambda v: (v < 0) | (v > 1) | F.isnan(v)) if unit_range else F.lit(False)
    r = df.agg(F.count_if(F.size("x") != width).alias("shape"), F.count_if(outside).alias("range")).first()
    if r.shape or r.range:
        raise ContractError(f"{r.shape} rows that are not {width} wide, {r.range} rows outside [0, 1]")
    return df


def write_matrix(df: DataFrame, path: str) -> None:
    """(id, x) of latents or objectives, which :func:`read_matrix` reads again."""
    df.select(F.col("id").cast("bigint").alias("id"), F.col("x").cast("array<double>").alias("x")).write.mode("overwrite").parquet(path)


def pool_from_files(spark: SparkSession, library: str, latents: str, dim: int = 5) -> DataFrame:
    """(id, x, sequence): a library's sequences with their latent coordinates, which must be as many."""
    names, x = read_sequences(spark, library), read_matrix(spark, latents, dim, unit_range=True)
    pool = x.join(names.select(F.col("pos").alias("id"), "sequence"), "id")
    sizes = [df.count() for df in (names, x, pool)]
    if len(set(sizes)) != 1:
        raise ContractError(f"{sizes[0]} sequences and {sizes[1]} latent rows, of which {sizes[2]} meet")
    return pool.select("id", "x", "sequence")


def objectives_from_file(spark: SparkSession, path: str) -> DataFrame:
    """(id, y1, y2) of a written objective matrix."""
    return read_matrix(spark, path, 2).select("id", F.get("x", F.lit(0)).alias("y1"), F.get("x", F.lit(1)).alias("y2"))


def read_initial(spark: SparkSession, path: str) -> DataFrame:
    """(pos, id) of an initial design."""
    return spark.read.schema(ddl(INITIAL)).option("multiLine", True).json(path).select(F.posexplode("initial_ids").alias("pos", "id")).select("pos", F.col("id").cast("bigint").alias("id"))


def read_params(spark: SparkSession, path: str) -> dict:
    row = spark.read.schema(ddl(PARAMS)).option("multiLine", True).json(path).first()
    return json.loads(json.dumps(row.asDict(recursive=True)))


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """All ``*_run.json`` of a folder by path; an empty frame where there is none."""
    jvm = spark.sparkContext._jvm
    glob = jvm.org.apache.hadoop.fs.Path(f"{folder}/*_run.json")
    found = glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(glob)
    if not found:
        return spark.createDataFrame([], ddl(RUN)).withColumn("path", F.lit(None).cast("string"))
    return spark.read.schema(ddl(RUN)).option("multiLine", True).json(f"{folder}/*_run.json").withColumn("path", F.input_file_name())


def run_points(runs: DataFrame) -> DataFrame:
    """(team_name, pos, round, y1, y2) of runs; the initial design is round 0."""
    size = F.col("batch_size")
    return runs.select("team_name", "n_initial", "batch_size", F.posexplode("final_Y").alias("pos", "y")).select(
        "team_name", "pos", F.when(F.col("pos") < F.col("n_initial"), 0).otherwise(F.floor((F.col("pos") - F.col("n_initial")) / size) + 1).cast("int").alias("round"), F.get("y", F.lit(0)).alias("y1"), F.get("y", F.lit(1)).alias("y2"))


def write_run(history: dict, spark: SparkSession, folder: str) -> str:
    """A run's JSON and its rounds as CSV under the team's slug; the latest run of a slug wins."""
    from ..functions.text import slug

    name = spark.range(1).select(slug(F.lit(history["team_name"]))).first()[0]
    df = spark.createDataFrame([_plain(history)], ddl(RUN))
    df.coalesce(1).write.mode("overwrite").json(f"{folder}/{name}_run.json")
    rounds = df.select(F.explode("rounds").alias("r")).select("r.round", F.to_json("r.plan").alias("plan"), F.array_join("r.ids", " ").alias("ids"), "r.hv")
    rounds.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}_rounds.csv")
    return name


def _plain(history: dict) -> dict:
    return {**history, "rounds": [{k: r[k] for k in ("round", "plan", "ids", "Y", "hv")} for r in history["rounds"]]}


def write_runs(runs: DataFrame, folder: str) -> None:
    """Runs (the columns of RUN) as JSON under their teams' slugs, all by one job, for :func:`read_runs`."""
    from ..functions.text import slug

    typed(runs, RUN).withColumn("slug", F.concat(slug("team_name"), F.lit("_run.json"))).write.mode("overwrite").partitionBy("slug").json(folder)


def write_initial(spark: SparkSession, ids, seed: int, path: str) -> None:
    """An initial design as one JSON record."""
    spark.createDataFrame([(seed, [int(i) for i in ids])], ddl(INITIAL)).coalesce(1).write.mode("overwrite").json(path)


def write_params(spark: SparkSession, params: dict, path: str) -> None:
    spark.createDataFrame([params], ddl(PARAMS)).coalesce(1).write.mode("overwrite").json(path)


def write_stats(spark: SparkSession, stats: dict, path: str) -> None:
    """Counters of an intake as one JSON record."""
    kinds = {int: "bigint", float: "double", bool: "boolean", str: "string"}
    schema = ", ".join(f"`{k}` {kinds[type(v)]}" for k, v in stats.items())
    spark.createDataFrame([tuple(stats.values())], schema).coalesce(1).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, gzip: bool = False) -> None:
    w = df.write.mode("overwrite").option("header", True)
    (w.option("compression", "gzip") if gzip else w).csv(path)


def cleaned(df: DataFrame, column: str = "sequence") -> DataFrame:
    return df.withColumn(column, clean_sequence(column))

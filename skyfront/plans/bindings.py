"""How the engine's inputs are bound to the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ALPHABET
from ..operators import stats

#: The default landscape of two objectives over five latent dimensions.
LANDSCAPE = {
    "a1": [1.6, 0.0, 1.1, 0.0, 0.0],
    "a2": [0.0, 1.6, 0.0, 1.1, 0.0],
    "bumps": [
        {"center": [0.7, 0.3, 0.65, 0.3, 0.5], "width": 0.22, "height": 0.55, "obj": [1.0, 0.0]},
        {"center": [0.3, 0.7, 0.3, 0.65, 0.5], "width": 0.22, "height": 0.55, "obj": [0.0, 1.0]},
        {"center": [0.5, 0.5, 0.48, 0.48, 0.5], "width": 0.26, "height": -0.55, "obj": [1.0, 1.0]},
    ],
}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objectives by brand: id, grp, y1 (price), y2 (size)."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("grp"), F.col("p_retailprice").alias("y1"), F.col("p_size").cast("double").alias("y2"))


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements of teams: id, team, rnd (day), y1, y2."""
    y2 = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("team"), F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date")).alias("rnd"), F.col("value").alias("y1"), y2.alias("y2"))


def latents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x): the first five elements of each embedding, min-max scaled over the table."""
    wide = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *(F.get("embedding", F.lit(k)).cast("double").alias(f"x{k}") for k in range(5)))
    return stats.minmax(wide, [f"x{k}" for k in range(5)]).select("id", F.array(*(f"x{k}" for k in range(5))).alias("x"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, label): whole embeddings as doubles."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw records with flags from their labels (null where there is none)."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars")
    return docs.join(table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"), "doc_id", "left")


def repertoire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw repertoire records: metadata in the spellings that real ones have, flags
    from labels, and a gapped sequence of the text's standard letters."""
    d = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source").join(table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"), "doc_id", "left")
    letters = F.regexp_replace("text", f"[^{ALPHABET}{ALPHABET.lower()}]", "")
    return d.select(
        "doc_id",
        F.when(F.col("lang") == "en", " Human ").when(F.col("lang") == "fr", "HUMAN").otherwise(F.col("lang")).alias("meta_Species"),
        F.lit("Heavy").alias("meta_Chain"),
        F.when(F.col("source").isin("src0", "src1", "src2", "src3"), "PBMC").otherwise("spleen").alias("meta_BSource"),
        F.lit("Naive-B-Cells").alias("meta_BType"),
        F.lit("IGHG").alias("meta_Isotype"),
        F.col("quality").cast("string").alias("productive"),
        F.lit("T").alias("vj_in_frame"),
        F.col("toxic").cast("string").alias("stop_codon"),
        F.concat(F.lit(".- "), F.lower(letters), F.when(F.col("doc_id") % 10 == 0, "X").otherwise("")).alias("sequence_alignment_aa"),
    )

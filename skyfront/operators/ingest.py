"""Record intake: acceptance, cleaning, first copies, stopping, shard choice, counters."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clean_sequence, first_rejection, is_standard, to_bool
from ..sources.scratch import written

#: The metadata that a raw repertoire record must have.
ACCEPTED = {
    "meta_Species": ("human",),
    "meta_Chain": ("heavy",),
    "meta_BSource": ("pbmc", "leukopak"),
    "meta_BType": ("unsorted-b-cells", "naive-b-cells", "memory-b-cells"),
    "meta_Isotype": ("bulk", "ighm", "ighd", "ighg", "igha"),
}
SEQUENCE = "sequence_alignment_aa"


def record_passes(rules: dict[str, tuple[str, ...]] = ACCEPTED, low: int = 90, high: int = 150) -> Column:
    """Whether a raw record is accepted: metadata, flags, length and alphabet."""
    clean = clean_sequence(SEQUENCE)
    return first_rejection(rules).isNull() & to_bool("productive") & to_bool("vj_in_frame") & ~to_bool("stop_codon") & F.length(clean).between(low, high) & is_standard(clean)


def filtered(records: DataFrame, **options) -> DataFrame:
    """Accepted records with their cleaned ``sequence``."""
    return records.where(record_passes(**options)).withColumn("sequence", clean_sequence(SEQUENCE))


def first_copies(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Of rows with equal keys the one with the lowest ``order`` (nulls last), of those with equal
    order the lowest in its other columns: always a whole row that is there. A grouped minimum,
    combined on the map side, finds it: a key that a third of all rows share costs one row per
    task. Columns must be of types that can be ordered."""
    values = [c for c in df.columns if c not in (*keys, order)]
    row = F.struct(F.col(order).isNull().alias("_n"), F.col(order).alias("_o"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(values)))
    low = df.groupBy(*keys).agg(F.min(row).alias("_row"))
    found = {order: F.col("_row._o"), **{c: F.col(f"_row._{i}") for i, c in enumerate(values)}}
    return low.select(*(found[c].alias(c) if c in found else F.col(c) for c in df.columns))


def stop_early(df: DataFrame, order: str, keep: Column, key: str, target: int, most: int | None = None) -> DataFrame:
    """Rows in order that pass ``keep``, first copies by ``key``, up to ``target`` of them from at
    most ``most`` scanned rows."""
    scanned = df.orderBy(order).limit(most) if most is not None else df
    return first_copies(scanned.where(keep), [key], order).orderBy(order).limit(target)


def per_shard(df: DataFrame, shard: str, order: str, most: int) -> DataFrame:
    """The first ``most`` rows of each shard."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(shard).orderBy(order))).where(F.col("_n") <= most).drop("_n")


def record_stream(spark: SparkSession, path: str, columns: Sequence[str], seed: int | None = None, key: str = SEQUENCE) -> DataFrame:
    """Raw records of a Parquet folder of any file system that Spark reads, projected to
    ``columns`` at the scan; with a ``seed`` in a shuffled order that is the same at every run."""
    records = spark.read.parquet(path).select(*columns)
    return records if seed is None else records.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)


def collect_shards(spark: SparkSession, shards: Sequence[str], target: int, passes: Column, cleaned: Column, kept: dict[str, Column], n_shards: int = 100, most: int = 50_000) -> tuple[DataFrame, dict, DataFrame]:
    """A bounded sample of accepted records over evenly chosen shards: the records (``sequence`` and
    ``kept`` columns), counters, and a manifest with a row per shard read.

    Of every shard at most ``most`` rows are scanned, in the file's order, until it has given its
    share of ``target``; a sequence counts once, at its first record that was kept. Reading ends
    with the shard that reaches the target. What a shard gives is written and joined with what the
    others gave before it; the driver sees counts only.
    """
    chosen = choose_shards(sorted(shards), n_shards)
    if not chosen:
        raise FileNotFoundError("there are no shards")
    share, records, n, manifest = max(1, target // len(chosen)), None, 0, []
    names = ["sequence", *kept]
    for shard in chosen:
        rows = spark.read.parquet(shard).withColumn("_row", F.col("_metadata.row_index")).where(F.col("_row") < most)
        fresh = rows.where(passes).select(cleaned.alias("sequence"), *(c.cast("string").alias(n) for n, c in kept.items()), "_row")
        if records is not None:
            fresh = fresh.join(records.select("sequence"), "sequence", "left_anti")
        got, _ = written(first_copies(fresh, ["sequence"], "_row").orderBy("_row").limit(share), "shard")
        one = got.agg(F.count(F.lit(1)).alias("n"), F.max("_row").alias("last")).first()
        manifest.append((shard.rsplit("/", 1)[-1], one.n, one.last + 1 if one.n == share else rows.count()))
        records, n = got.select(names) if records is None else records.unionByName(got.select(names)), n + one.n
        if n >= target:
            break
    sources = records.agg(F.count_distinct("source")).first()[0] if "source" in names else 0
    stats = {"scanned": sum(m[2] for m in manifest), "cheap_kept": n, "shards_used": len(manifest), "distinct_sources": sources}
    return records, stats, spark.createDataFrame(manifest, "shard string, kept bigint, scanned bigint")


def shards_of(spark: SparkSession, folder: str) -> list[str]:
    """The paths of a folder's files and subfolders, by name; hidden ones are left out."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return sorted(str(f.getPath()) for f in found if not str(f.getPath().getName()).startswith(("_", ".")))


def choose_shards(shards: Sequence[str], n: int) -> list[str]:
    """n shards at even strides; all for n < 1 or n beyond their number."""
    return list(shards) if n < 1 or n >= len(shards) else [shards[k * len(shards) // n] for k in range(n)]


def funnel(records: DataFrame, keep: Column, source: str) -> DataFrame:
    """scanned, kept, pass_rate (0 without rows) and distinct_sources, in one pass."""
    marked = records.select(keep.alias("_k"), F.col(source).alias("_s"))
    scanned, kept = F.count(F.lit(1)), F.count_if("_k")
    return marked.agg(scanned.alias("scanned"), kept.alias("kept"), F.when(scanned > 0, kept.cast("double") / scanned.cast("double")).otherwise(0.0).alias("pass_rate"), F.count_distinct(F.when(F.col("_k"), F.col("_s"))).alias("distinct_sources"))


def intake(records: DataFrame, keep: Column, source: str, path: str) -> tuple[DataFrame, dict]:
    """Writes the records that pass as Parquet to ``path``, and the counters of :func:`funnel`. Rows are
    counted as they pass by, in the job that writes them, so the input is read once; sources are then
    counted among what was kept."""
    seen = Observation("intake")
    marked = records.withColumn("_k", F.coalesce(keep, F.lit(False)))
    marked.observe(seen, F.count(F.lit(1)).alias("scanned"), F.count_if("_k").alias("kept")).where("_k").drop("_k").write.mode("overwrite").parquet(path)
    kept = records.sparkSession.read.schema(records.schema).parquet(path)
    counts = seen.get
    return kept, {**counts, "pass_rate": counts["kept"] / counts["scanned"] if counts["scanned"] else 0.0, "distinct_sources": kept.agg(F.count_distinct(source)).first()[0]}


def validated(df: DataFrame, column: str, accept: Callable[[list[str]], list[bool]], batch: int = 64) -> DataFrame:
    """Rows whose text an external model accepts; the model sees at most ``batch`` texts at once."""

    def run(batches):
        for b in batches:
            marks: list[bool] = []
            texts = b.column(column).to_pylist()
            for i in range(0, len(texts), batch):
                got = list(accept(texts[i : i + batch]))
                if len(got) != len(texts[i : i + batch]):
                    raise ValueError("the model must answer for every text")
                marks += [bool(x) for x in got]
            yield b.filter(pa.array(marks, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def valid_heavy(result: str, least: float) -> Column:
    """Whether a numbering result struct(chain, error, score) is a heavy chain of enough score."""
    r = F.col(result)
    return F.coalesce((r["chain"] == "H") & r["error"].isNull() & (F.coalesce(r["score"], F.lit(0.0)) >= least), F.lit(False))

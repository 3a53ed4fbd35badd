"""What the operators of this subpackage share: table access, Arrow helpers, bounded samples.

Scratch tables go to the folder that the session names in ``spark.checkpoint.dir``, see
:mod:`skyfront.sources.scratch`.
"""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import dropped, scratch_root, written  # noqa: F401 used by the operators

#: Bytes of one Arrow batch handed to a Python worker, the same for all operators. Bounds the
#: worker's memory whatever the length of the documents (a longer document is a batch alone).
ARROW_BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> None:
    """What every operator's Python stages need, once for a session: the package's source on the
    executors, and Arrow batches of ``ARROW_BATCH_BYTES``. A later setting of the user's stays."""
    ship(spark)
    if not getattr(spark, "_skyfront_prepared", False):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
        spark._skyfront_prepared = True


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one table; reads through Spark only, so any file system works."""
    prepare(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def ship(spark: SparkSession) -> None:
    """Gives the executors this package's source, once per context, as Spark ships any file."""
    context = spark.sparkContext
    if getattr(context, "_skyfront_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="ship-")) / "skyfront.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(target))
    context._skyfront_shipped = True


def remainder(column: Column, modulus: int) -> Column:
    """crc32(column as text) mod ``modulus``; -1 for null, which is in no fold."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % modulus, F.lit(-1))


def mapped(df: DataFrame, schema: str, rows: Callable[[pa.RecordBatch], dict | None]) -> DataFrame:
    """``df`` through ``rows``, batch for batch: it gets an Arrow batch and returns columns by name."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := rows(batch)) is not None:
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (out[n] for n in names)], names)

    return df.mapInArrow(run, schema)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def in_parts(texts: list[bytes], size: int = 2 << 20) -> Iterator[list[bytes]]:
    """The texts in order, in parts of about ``size`` bytes: bounds what is held for a part."""
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t)
        if held > size:
            yield part
            part, held = [], 0
    if part:
        yield part


def bounded_sample(df: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """At most ``rows`` rows, by the smallest seeded hash of ``key``: the same at every run.

    For fitting models only; a documented bound on what the driver gets.
    """
    return df.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key))).orderBy("_h", key).limit(rows).drop("_h")

"""Greedy selection over pools: projection to rows, farthest points, clusters, balance.

A pool is ``(id, x array<double>)``. Ties always go to the lowest id. Loops run on the driver,
one small job a step; only winners come to it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import composition
from ..functions.vectors import distance, literal, squared_distance
from ..sources.scratch import dropped, written


def available(pool: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Pool rows whose id is not forbidden."""
    return pool.join(forbidden.select("id"), "id", "left_anti")


def lookup(ids: DataFrame, table: DataFrame) -> DataFrame:
    """``ids(pos, id)`` with the table's columns; duplicates and their pos are kept. Unknown
    and negative ids find nothing: compare counts where all must exist."""
    return ids.join(table, "id")


def without(pool: DataFrame, ids: Iterable[int]) -> DataFrame:
    ids = sorted({int(i) for i in ids})
    return pool.where(~F.col("id").isin(ids)) if ids else pool


def nearest(candidates: Sequence[Sequence[float]], pool: DataFrame, forbidden: Iterable[int] = ()) -> list[int]:
    """For each candidate in turn the closest row that is neither forbidden nor taken.

    At most q - 1 rows can be taken before a candidate's turn, so the q closest rows of each
    are enough: q * q rows reach the driver, whatever the pool's size.
    """
    rows = np.atleast_2d(np.asarray(candidates, float))
    q = len(rows)
    open_rows = without(pool, forbidden)
    spark = pool.sparkSession
    asked = F.broadcast(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "c int, v array<double>"))
    best = open_rows.join(asked).select("c", "id", distance("x", "v").alias("d"))
    best = best.withColumn("_n", F.row_number().over(W.partitionBy("c").orderBy("d", "id"))).where(F.col("_n") <= q)
    found: dict[int, list[int]] = {}
    for r in best.orderBy("c", "_n").collect():
        found.setdefault(r.c, []).append(r.id)
    out: list[int] = []
    for c in range(q):
        pick = next((i for i in found.get(c, []) if i not in out), None)
        if pick is None:
            raise ValueError("no row is left to take")
        out.append(pick)
    return out


def diverse_nearest(candidates: Sequence[Sequence[float]], pool: DataFrame, forbidden: Iterable[int] = (), weight: float = 1.0) -> list[int]:
    """Like :func:`nearest`, each distance less ``weight`` times that to the closest row taken before."""
    rows = np.atleast_2d(np.asarray(candidates, float))
    open_rows = without(pool, forbidden)
    taken: list[tuple[int, list[float]]] = []
    for r in rows:
        score = distance("x", literal(r))
        if taken:
            near = [distance("x", literal(v)) for _, v in taken]
            score = score - weight * (F.least(*near) if len(near) > 1 else near[0])
        row = without(open_rows, [i for i, _ in taken]).select("id", "x", score.alias("s")).orderBy("s", "id").first()
        if row is None:
            raise ValueError("no row is left to take")
        taken.append((row.id, list(row.x)))
    return [i for i, _ in taken]


METHODS: dict[str, Callable[..., list[int]]] = {"nearest": nearest, "diverse_nearest": diverse_nearest}


def project(candidates, pool: DataFrame, observed: Iterable[int] = (), pending: Iterable[int] = (), method: str = "nearest") -> list[int]:
    """Rows for candidate points among those neither observed nor pending."""
    if method not in METHODS:
        raise KeyError(f"unknown projection {method!r}; there are {sorted(METHODS)}")
    return METHODS[method](candidates, pool, {*observed, *pending})


def farthest_points(pool: DataFrame, k: int, start: int) -> list[int]:
    """Greedy max-min selection by squared distance, from ``start`` on; stops when rows run out.

    The distance to the nearest chosen row is one expression over a literal array of those
    chosen so far: no lineage grows, and nothing but each winner leaves the executors. The pool
    is kept in memory and on disk over the k passes.
    """
    rows = pool.select("id", "x").persist()
    try:
        first = rows.where(F.col("id") == start).first()
        if first is None:
            raise ValueError(f"no row {start}")
        chosen = [(first.id, list(first.x))]
        while len(chosen) < k:
            centres = F.array(*(literal(v) for _, v in chosen))
            d = F.array_min(F.transform(centres, lambda v: squared_distance("x", v)))
            row = without(rows, [i for i, _ in chosen]).select("id", "x", d.alias("d")).orderBy(F.desc("d"), "id").first()
            if row is None:
                break
            chosen.append((row.id, list(row.x)))
        return [i for i, _ in chosen]
    finally:
        rows.unpersist()


def initial_ids(pool: DataFrame, k: int, dim: int) -> list[int]:
    """Farthest points of the rows marked ``candidate``, from that one of them which is farthest
    from the whole pool's centroid; sorted."""
    kept = pool.select("id", "x", "candidate").persist()
    try:
        means = kept.agg(*(F.avg(F.get("x", F.lit(i))).alias(f"m{i}") for i in range(dim))).first()
        candidates = kept.where("candidate").select("id", "x")
        start = candidates.select("id", squared_distance("x", literal(means)).alias("d")).orderBy(F.desc("d"), "id").first()
        return sorted(farthest_points(candidates, k, start.id))
    finally:
        kept.unpersist()


def drop_small(df: DataFrame, label: str, least: int) -> DataFrame:
    """Rows whose label has at least ``least`` rows."""
    kept = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(label)
    return df.join(kept, label, "left_semi")


def balanced(df: DataFrame, label: str, id_col: str, size: int, seed: int | None = None) -> DataFrame:
    """Round-robin over labels: their first rows, then their second ones, up to ``size``; adds
    ``turn``. The order within a label is by a seeded hash, or by id without a seed. No label
    gives more than ``size`` rows, so rows beyond that never reach the final sort."""
    key = [id_col] if seed is None else [F.xxhash64(F.lit(seed), F.col(id_col)), F.col(id_col)]
    turn = F.row_number().over(W.partitionBy(label).orderBy(*key))
    return df.withColumn("turn", turn).where(F.col("turn") <= size).orderBy("turn", label).limit(size)


def kmeans_labels(df: DataFrame, columns: Sequence[str], k: int, seed: int) -> DataFrame:
    """``df`` with ``cluster_id`` from distributed k-means over the columns."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    ready = VectorAssembler(inputCols=list(columns), outputCol="features").transform(df)
    return KMeans(k=k, seed=seed).fit(ready).transform(ready).withColumnRenamed("prediction", "cluster_id").drop("features")


def curate(records: DataFrame, size: int, seed: int, clusters: int | None = None, least: int = 3) -> DataFrame:
    """A library from ``records(pos, sequence, source)``: first copies, clusters of standardised
    composition, rare clusters dropped (unless all are rare), a balanced sample, and ids.

    Sequences are read and described once and written beside their numbers; first copies, by a digest,
    clusters and the sample go over the numbers only, and the chosen rows meet their sequences at last."""
    from .ingest import first_copies
    from .stats import zscore

    spark = records.sparkSession
    features = [f"_f{i}" for i in range(21)]
    shares = (c.alias(f) for c, f in zip(composition("sequence"), features, strict=True))
    whole, _ = written(records.select("pos", "sequence", "source", F.sha2("sequence", 256).alias("_digest"), F.monotonically_increasing_id().alias("_row"), *shares), "described")
    distinct, path = written(first_copies(whole.select("pos", "source", "_row", "_digest", *features), ["_digest"], "pos").drop("_digest"), "first-copies")
    k = clusters or max(2, round(distinct.count() ** 0.5))
    labelled, labels = written(kmeans_labels(zscore(distinct, features), features, k, seed).select("pos", "_row", "cluster_id"), "labelled")
    kept = drop_small(labelled, "cluster_id", least)
    if kept.isEmpty():
        kept = labelled
    number = F.row_number().over(W.orderBy("turn", "cluster_id"))
    chosen, _ = written(balanced(kept, "cluster_id", "pos", size, seed).select("_row", "cluster_id", F.format_string("VH-%05d", number).alias("sequence_id")), "chosen")
    dropped(spark, path, labels)
    found = whole.select("_row", "sequence", "source").join(F.broadcast(chosen), "_row")
    return found.select("sequence_id", "sequence", F.length("sequence").alias("length"), F.coalesce("source", F.lit("unknown")).alias("source"), "cluster_id").orderBy("sequence_id")

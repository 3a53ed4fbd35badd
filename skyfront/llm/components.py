"""Connected components of a distributed edge list, by alternating large and small stars.

Each round is two grouped minima and two joins, written to the shared folder; edges never
come to the driver, only their number and a checksum do. Rounds grow with the logarithm of
the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` to ``(node, root)``, root being the smallest node reachable.

    Nodes without an edge to another node, and null ends, are left out: they are their own
    roots. Repeated and self edges do no harm.
    """
    spark = edges.sparkSession
    cur = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    cur, path = written(cur, "edges")
    state = _state(cur)
    while state[0]:
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large, path_large = written(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        cur, path_small = written(small, "small")
        dropped(spark, path, path_large)
        path, old, state = path_small, state, _state(cur)
        if state == old:
            break
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root"))

"""Exact nearest rows by pivots and the triangle inequality.

Rows are dealt to the cell of their nearest pivot. A row that asks first meets its own cell, which
bounds how far its nearest row can be; it then meets only those cells that this bound reaches: a
cell's rows are no nearer than the pivot's distance less the cell's radius, nor than half a plane
between two pivots allows. Rows of some cells are a pack, and a large cell is several; pairs of packs meet, so
a task holds two packs whatever the data, and no row is copied for a cell that it reaches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import dropped, written

#: Pivots at most. They are sent to all tasks (some 2 MB by 64 dimensions), with their distances.
PIVOTS = 1024
#: Slack of squared distances, for each dimension and of squared lengths: keeps rows that rounding alone would rule out.
SLACK = 1e-12
#: Bytes of the vectors of a pack, and of the pairs of packs that a Python worker gets at a time.
PACK_BYTES, PAIR_BYTES = 4 << 20, 16 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Stands for no row: greater than any id.
NONE = (1 << 63) - 1


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances by one matrix product: fast, but not to the last digit."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def nearest_in(a: np.ndarray, ids: np.ndarray, b: np.ndarray, names: np.ndarray, itself: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``a`` the least distance to a row of ``b`` and the place of that row, the
    first of equal ones; inf where there is none. A matrix product picks the rows that may be nearest,
    their distances are then taken from the differences."""
    best, place = np.full(len(a), np.inf), np.zeros(len(a), np.int64)
    if not len(b):
        return best, place
    size = (b * b).sum(1).max()
    wide = np.concatenate((-2 * b.T, (b * b).sum(1)[None]))
    order = np.argsort(names, kind="stable")
    low, high = (np.searchsorted(names[order], ids, side) for side in ("left", "right"))
    for i in range(0, len(a), 64):
        part = a[i : i + 64]
        # squared distances less the asking row's own square
        d2 = np.concatenate((part, np.ones((len(part), 1))), axis=1) @ wide
        if not itself:
            for k in np.flatnonzero(low[i : i + 64] < high[i : i + 64]).tolist():
                d2[k, order[low[i + k] : high[i + k]]] = np.inf
        slack = SLACK * (1 + part.shape[1]) * ((part * part).sum(1) + size)
        row, col = np.nonzero(d2 <= (d2.min(1) + 2 * slack)[:, None])
        ok = np.isfinite(d2[row, col])
        row, col = row[ok], col[ok]
        d = np.sqrt(((part[row] - b[col]) ** 2).sum(1))
        by = np.lexsort((col, d, row))
        first = by[np.flatnonzero(np.diff(row[by], prepend=-1))]
        best[i + row[first]], place[i + row[first]] = d[first], col[first]
    return best, place


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


class Cells:
    """Pivots, the distances between them, and each cell's size and radius."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        self.apart = distances(pivots, pivots)
        self.sizes: np.ndarray = np.zeros(len(pivots), np.int64)
        self.radius: np.ndarray = np.zeros(len(pivots))

    @classmethod
    def of(cls, rows: DataFrame, block: int, most: int) -> tuple[Cells, int]:
        """By a sample of ``rows(id, v)`` in the order of a hash, one for each block, ``most`` at most."""
        n = rows.count()
        want = max(1, min(most, -(-n // block)))
        sample = rows.orderBy(F.xxhash64(F.lit(7), F.col("id")), "id").select("v").limit(want).collect()
        return cls(np.unique(np.array([r.v for r in sample], float), axis=0) if sample else np.empty((0, 1))), n

    def dealt(self, rows: DataFrame) -> DataFrame:
        """``rows(id, v)`` with cell and r, the distance to its pivot."""
        sent = rows.sparkSession.sparkContext.broadcast(self.pivots)

        def run(batches):
            for batch in batches:
                v = _matrix(batch.column("v"))
                if not len(v):
                    continue
                d = distances(v, sent.value)
                cell = d.argmin(1)
                exact = np.sqrt(((v - sent.value[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cell.astype(np.int32)), pa.array(exact)], ["id", "v", "cell", "r"])

        return rows.mapInArrow(run, "id bigint, v array<double>, cell int, r double")

    def measured(self, pool: DataFrame) -> Cells:
        """Takes the sizes and radii of a dealt pool: one row for each pivot."""
        for r in pool.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("r")).collect():
            self.sizes[r.cell], self.radius[r.cell] = r.n, r.r
        return self

    def within(self, v: np.ndarray, cell: np.ndarray, bound: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Whether each row's bound reaches each of the cells ``which``, other than its own."""
        pivots, bound = self.pivots[which], np.minimum(bound, 1e300)
        d, own = distances(v, pivots), np.sqrt(((v - self.pivots[cell]) ** 2).sum(1))
        slack = SLACK * (1 + v.shape[1]) * ((v * v).sum(1)[:, None] + (pivots * pivots).sum(1)[None])
        near = (d - self.radius[None, which] <= bound[:, None] + np.sqrt(slack)) & (self.sizes[None, which] > 0)
        near &= d * d - (own * own)[:, None] <= 2 * self.apart[np.ix_(cell, which)] * bound[:, None] + slack
        return near & (cell[:, None] != which[None])

    def reached(self, v: np.ndarray, cell: np.ndarray, bound: np.ndarray) -> Iterator[np.ndarray]:
        """For each row the other cells that may hold a row within its bound."""
        return (np.flatnonzero(x) for x in self.within(v, cell, bound, np.arange(len(self.pivots))))

    def chain(self) -> list[int]:
        """All cells, each followed by the nearest one that is left."""
        left, out = np.ones(len(self.pivots), bool), [0]
        left[0] = False
        while left.any():
            out.append(int(np.where(left, self.apart[out[-1]], np.inf).argmin()) if np.isfinite(self.apart[out[-1]][left]).any() else int(left.argmax()))
            left[out[-1]] = False
        return out

    def packed(self, rows: DataFrame, most: int) -> tuple[DataFrame, int]:
        """``rows(id, v, cell, near, d)`` as packs of about ``most`` rows, a row each, and their number: cells
        that are near each other share a pack, one of many rows is several. With the cells that
        its rows have and those that they reach within d, and how often."""
        sizes = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}  # a row for each pivot
        parts, at, held = [], 0, 0
        for k in self.chain():
            n = sizes.get(k, 0)
            if not n:
                continue
            if held and held + n > most:
                at, held = at + 1, 0
            slices = -(-n // most)
            parts.append((k, at, slices))
            at, held = (at + slices, 0) if slices > 1 else (at, held + n)
        spark = rows.sparkSession
        sent = spark.sparkContext.broadcast(self)
        dealt = F.broadcast(spark.createDataFrame(parts, "cell int, _first int, _slices int"))
        number = F.col("_first") + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_slices")).cast("int")

        def pack(table: pa.Table) -> pa.Table:
            table = table.sort_by([("cell", "ascending"), ("id", "ascending")]).combine_chunks()
            v, cells, every = _matrix(table.column("v").combine_chunks()), sent.value, np.arange(len(sent.value.pivots))
            cell, d = table.column("cell").to_numpy(), table.column("d").to_numpy()
            reach, met = np.zeros(len(every), bool), 0
            if np.isfinite(d).any() or table.column("near").null_count < len(d):
                for i in range(0, len(v), 256):
                    some = cells.within(v[i : i + 256], cell[i : i + 256], d[i : i + 256], every)
                    reach |= some.any(0)
                    met += int(some.sum())
            else:  # nothing is known yet
                reach[:], met = True, len(v) * (len(every) - 1)
            blob = lambda x: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())
            near = table.column("near").fill_null(NONE).to_numpy()
            return pa.table({"cells": pa.array([np.unique(cell)], pa.list_(pa.int32())), "reach": pa.array([np.flatnonzero(reach)], pa.list_(pa.int32())), "met": [met], "n": [len(v)], "id": blob(table.column("id").to_numpy()), "v": blob(v), "cell": blob(cell), "near": blob(near), "d": blob(d)})

        made = rows.join(dealt, "cell").select("id", "v", "cell", "near", "d", number.alias("pack"))
        packs = made.groupBy("pack").applyInArrow(pack, "cells array<int>, reach array<int>, met bigint, n bigint, id binary, v binary, cell binary, near binary, d binary")
        return written(packs, "packs")[0], at + (held > 0)


def _met(cells: Cells, asks: tuple[DataFrame, int], pool: tuple[DataFrame, int], itself: bool, home: bool) -> DataFrame:
    """(id, near, d) of packs of rows that ask, where a pack of the pool has a row in their own cell (``home``)
    or in the others within their bounds that is nearer than what they have. Pairs of packs are
    rows that stream through a task: none is shuffled, and one pair is in memory at a time."""
    spark = pool[0].sparkSession
    if int(spark.conf.get(BATCH_BYTES).rstrip("b")) > PAIR_BYTES:
        spark.conf.set(BATCH_BYTES, str(PAIR_BYTES))
    sent = spark.sparkContext.broadcast(cells)
    few = lambda n: min(n, max(-(-n // 8), 8))  # noqa: E731 some packs a partition
    left = asks[0].drop("reach" if home else "cells", "met").withColumnRenamed("cells" if home else "reach", "want").repartition(few(asks[1]))
    right = pool[0].select("cells", *(F.col(c).alias(f"_{c}") for c in ("id", "v", "cell"))).repartition(few(pool[1]))
    pairs = left.join(right, F.arrays_overlap("want", "cells")).drop("want", "cells")

    def nearest(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                at = lambda c, kind: np.frombuffer(batch.column(c)[i].as_buffer(), kind)  # noqa: B023, E731
                ids, cell, near, d, names, other = at("id", np.int64), at("cell", np.int32), at("near", np.int64).copy(), at("d", np.float64).copy(), at("_id", np.int64), at("_cell", np.int32)
                a, b = at("v", np.float64).reshape(len(ids), -1), at("_v", np.float64).reshape(len(names), -1)
                which, first = np.unique(other, return_index=True)
                own = cell[:, None] == which[None] if home else sent.value.within(a, cell, d, which)
                better = np.zeros(len(ids), bool)
                for k, (x, y) in enumerate(zip(first, [*first[1:], len(other)], strict=True)):
                    rows = np.flatnonzero(own[:, k])
                    if not len(rows):
                        continue
                    found, place = nearest_in(a[rows], ids[rows], b[x:y], names[x:y], itself)
                    name = names[x:y][place]
                    less = np.isfinite(found) & ((found < d[rows]) | (found == d[rows]) & (name < near[rows]))
                    rows = rows[less]
                    d[rows], near[rows], better[rows] = found[less], name[less], True
                yield pa.RecordBatch.from_arrays([pa.array(ids[better]), pa.array(near[better]), pa.array(d[better])], ["id", "near", "d"])

    return pairs.mapInArrow(nearest, "id bigint, near bigint, d double")


def nearest_rows(queries: DataFrame, pool: DataFrame, id_col: str, vector: str, block: int = 2048, itself: bool = False, pivots: int = PIVOTS, report: dict | None = None, pack: int | None = None) -> DataFrame:
    """id, near and d: each query's nearest row of the pool, other than the one with its id unless
    ``itself``, ties to the lowest id; near is null (and d infinite) where there is none. ``report``
    gets the numbers of cells, of rows that ask and of their meetings with a cell. ``pack`` rows
    meet as many others at a time, by default what :data:`PACK_BYTES` hold."""
    plain = lambda df: df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    asking, rows = plain(queries), plain(pool)
    cells, n = Cells.of(rows, block, pivots)
    if not n:
        return asking.select("id", F.lit(None).cast("bigint").alias("near"), F.lit(float("inf")).alias("d"))
    most = pack or max(1, PACK_BYTES // (8 * cells.pivots.shape[1]))
    fresh = (F.lit(None).cast("bigint").alias("near"), F.lit(float("inf")).alias("d"))
    pool_cells, pool_path = written(cells.dealt(rows), "pool-cells")
    cells.measured(pool_cells)
    packs = cells.packed(pool_cells.select("id", "v", "cell", *fresh), most)
    dropped(asking.sparkSession, pool_path)
    mine, path = written(cells.dealt(asking), "asks")
    if mine.isEmpty():
        return asking.select("id", *fresh)
    best = lambda df: df.groupBy("id").agg(F.min(F.struct("d", F.coalesce("near", F.lit(NONE)).alias("near"))).alias("m")).select("id", F.nullif("m.near", F.lit(NONE)).alias("near"), "m.d")
    every = mine.select("id", *fresh)
    asks = cells.packed(mine.select("id", "v", "cell", *fresh), most)
    home, _ = written(best(every.unionByName(_met(cells, asks, packs, itself, True))), "home")
    if len(cells.pivots) == 1:
        dropped(asking.sparkSession, path)
        if report is not None:
            report |= {"cells": 1, "asking": n, "meetings": n}
        return home
    bound = mine.select("id", "v", "cell").distinct().join(home, "id")
    asks = cells.packed(bound, most)
    dropped(asking.sparkSession, path)
    if report is not None:
        r = asks[0].agg(F.sum("n").alias("n"), F.sum("met").alias("met")).first()
        report |= {"cells": len(cells.pivots), "asking": r.n, "meetings": r.n + r.met}
    return best(home.unionByName(_met(cells, asks, packs, itself, False)))

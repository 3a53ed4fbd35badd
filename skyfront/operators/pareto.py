"""Skylines, hypervolume and what is built on them. All objectives are maximised.

The two-objective skyline is a running maximum over a descending sort. Every task first leaves only
rows that are undominated among its own. By group, a salted pass follows, so the final window sees
the salts' fronts and no more. Without groups, ranges of the first objective take the place of salts:
a row is on the front if it is on its range's front and above the best of all higher ranges, so no
task ever holds the whole front; its area is added up range by range too.

For more objectives a grid of quantile cells discards whole cells before rows meet
(:func:`skyline_nd`), and the hypervolume is a sum of independent contributions
(:func:`hypervolume_nd`). Histories are one pass over each team's rounds (:func:`hv_history`).
Rows with a null objective belong to no front and dominate nothing.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written
from .stats import _at_most, ranged

SALTS = 64


def _best_before(keys: Sequence) -> Column:
    w = W.partitionBy(*keys).orderBy(F.desc("_a")).rowsBetween(W.unboundedPreceding, -1)
    return F.max("_b").over(w)


def _task_fronts(points: DataFrame) -> DataFrame:
    """``points(_a, _b)`` less those that another one of the same task dominates; holds a task's front."""

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [held, batch])
            table = table.take(pc.sort_indices(table, [("_a", "descending"), ("_b", "descending")])).combine_chunks()
            b = table.column("_b").to_numpy()
            if len(b):
                top = np.maximum.accumulate(b)
                table = table.filter(pa.array(np.concatenate(([True], b[1:] > top[:-1])).astype(bool)))
            held = table.to_batches()[0] if table.num_rows else None
        if held is not None:
            yield held

    return points.mapInArrow(run, points.schema)


def _ranged_front(points: DataFrame) -> DataFrame:
    """The front of ``points(_a, _b)`` by ranges of _a: _k (the range), _a, _b, and _h, the best _b of
    all higher ranges."""
    best = ranged(_task_fronts(points).groupBy("_a").agg(F.max("_b").alias("_b")), "_a")
    # one row for each range
    higher = F.max("_t").over(W.orderBy(F.desc("_k")).rowsBetween(W.unboundedPreceding, -1))
    top = F.broadcast(best.groupBy("_k").agg(F.max("_b").alias("_t")).select("_k", higher.alias("_h")))
    return best.withColumn("_m", _best_before(["_k"])).where("_m IS NULL OR _b > _m").join(top, "_k").where("_h IS NULL OR _b > _h").drop("_m")


def _points(df: DataFrame, y1: str, y2: str, by: Sequence[str]) -> DataFrame:
    return df.where(F.col(y1).isNotNull() & F.col(y2).isNotNull()).select(*by, F.col(y1).alias("_a"), F.col(y2).alias("_b"))


def front_values(df: DataFrame, y1: str, y2: str, by: Sequence[str] = (), salts: int = SALTS) -> DataFrame:
    """The distinct (y1, y2) of each group's front, with the columns of ``by``."""
    points = _points(df, y1, y2, by)
    if not by:
        return _ranged_front(points).select(F.col("_a").alias(y1), F.col("_b").alias(y2))
    # best y2 of each y1 first: combined on the map side, it removes most rows before any sort
    best = points.groupBy(*by, "_a").agg(F.max("_b").alias("_b"))
    best = best.withColumn("_s", F.pmod(F.xxhash64("_a"), F.lit(salts)))
    for keys in ([*by, "_s"], list(by)):
        best = best.withColumn("_m", _best_before(keys)).where("_m IS NULL OR _b > _m").drop("_m")
    return best.select(*by, F.col("_a").alias(y1), F.col("_b").alias(y2))


def front_diameter(df: DataFrame, y1: str, y2: str) -> DataFrame:
    """The greatest distance between two points of the front, as ``diameter``. Along a front one
    objective rises as the other falls, so its two ends are farthest apart; 0 without points."""
    front = front_values(df, y1, y2)
    spans = [F.max(y) - F.min(y) for y in (y1, y2)]
    return front.agg(F.coalesce(F.sqrt(spans[0] * spans[0] + spans[1] * spans[1]), F.lit(0.0)).alias("diameter"))


def skyline(df: DataFrame, y1: str, y2: str, by: Sequence[str] = (), keep_duplicates: bool = True, id_col: str | None = None) -> DataFrame:
    """The rows on each group's front. Copies of a front point are all kept, or with
    ``keep_duplicates=False`` the one with the lowest ``id_col``."""
    rows = df.join(front_values(df, y1, y2, by), [*by, y1, y2], "left_semi")
    if keep_duplicates:
        return rows
    if id_col is None:
        raise ValueError("keeping one copy of each point needs id_col")
    lowest = rows.groupBy(*by, y1, y2).agg(F.min(id_col).alias(id_col))
    return rows.join(lowest, [*by, y1, y2, id_col], "left_semi")


def pareto_mask(df: DataFrame, y1: str, y2: str, id_col: str, by: Sequence[str] = (), keep_duplicates: bool = False) -> DataFrame:
    """All rows with ``on_front``."""
    front = skyline(df, y1, y2, by, keep_duplicates, id_col).select(*by, id_col).withColumn("_f", F.lit(True)).distinct()
    return df.join(front, [*by, id_col], "left").withColumn("on_front", F.coalesce("_f", F.lit(False))).drop("_f")


#: Cells of the grid that prunes a skyline, and objectives that it is made of; both bound what the driver gets.
CELLS, GRID_OBJECTIVES = 4096, 12
#: Rows of a block, and blocks at most: larger sets have larger blocks.
BLOCK, BLOCKS = 4096, 2000
#: Local survivors that a task holds before it passes them on, and points of the grid that all rows are compared with.
HELD, REPRESENTATIVES = 20_000, 512


class Grid:
    """Quantile cells of the objectives. A cell with an occupied one above it in every objective holds
    no undominated row, whatever its rows are."""

    def __init__(self, points: DataFrame, objectives: Sequence[str], cells: int = CELLS):
        self.objectives = list(objectives)[:GRID_OBJECTIVES]
        m = len(self.objectives)
        side = max(2, int(cells ** (1 / m) + 1e-9))
        at = [k / side for k in range(1, side)]
        double = [F.col(c).cast("double") for c in self.objectives]
        aggs = [x for i, c in enumerate(double) for x in (F.percentile_approx(c, at, 1000).alias(f"q{i}"), F.min(c).alias(f"a{i}"), F.max(c).alias(f"z{i}"))]
        one = points.agg(*aggs).first()
        self.cuts = [sorted(set(one[f"q{i}"] or [])) for i in range(m)]
        self.shape = tuple(len(c) + 1 for c in self.cuts)
        # a row of each cell that lies high in all objectives: what it dominates need not meet any other
        height = sum((c / F.lit((one[f"z{i}"] - one[f"a{i}"]) or 1.0) for i, c in enumerate(double)), F.lit(0.0)) if one["a0"] is not None else F.lit(0.0)
        tops = points.groupBy(self.cell().alias("_cell")).agg(F.max_by(F.array(*(F.col(c).cast("double") for c in objectives)), height).alias("y")).collect()
        occupied = np.zeros(self.shape, bool)
        occupied.ravel()[[r["_cell"] for r in tops]] = True
        above = occupied
        for axis in range(m):  # any cell at or above this one
            above = np.flip(np.maximum.accumulate(np.flip(above, axis), axis), axis)
        beaten = np.zeros(self.shape, bool)
        beaten[tuple(slice(0, -1) for _ in range(m))] = above[tuple(slice(1, None) for _ in range(m))]
        self.alive = ~beaten
        self.occupied, self.discarded = int(occupied.sum()), int((occupied & beaten).sum())
        y = np.array([r["y"] for r in tops if self.alive.ravel()[r["_cell"]]], float).reshape(-1, len(objectives))
        y = y[_undominated(y)] if len(y) else y
        self.tops = y[np.argsort(-y.sum(1), kind="stable")][:REPRESENTATIVES]

    def cell(self) -> Column:
        out = F.lit(0)
        for c, cuts, n in zip(self.objectives, self.cuts, self.shape, strict=True):
            out = out * n + (_at_most(cuts, F.col(c).cast("double")) if cuts else F.lit(0))
        return out.cast("int")

    def cells_of(self, y: np.ndarray) -> np.ndarray:
        """The same in numpy."""
        out = np.zeros(len(y), np.int64)
        for k, (cuts, n) in enumerate(zip(self.cuts, self.shape, strict=True)):
            out = out * n + np.searchsorted(np.array(cuts), y[:, k], "right")
        return out

    def pruned(self, points: DataFrame, objectives: Sequence[str]) -> DataFrame:
        """The rows that may be undominated, with _cell: those of dominated cells go, those below a
        cell's top, and those that another one of the same task dominates."""
        sent = points.sparkSession.sparkContext.broadcast((self.cuts, self.shape, self.alive.ravel(), self.tops))
        names = list(objectives)

        def run(batches):
            grid = object.__new__(Grid)
            grid.cuts, grid.shape, alive, tops = sent.value
            held, y_held = None, np.empty((0, len(names)))
            for batch in batches:
                y = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names], axis=1)
                cell = grid.cells_of(y)
                own = np.flatnonzero(alive[cell])
                own = own[~beaten_by(y[own], tops)]
                own = own[_undominated(y[own])]
                own = own[~beaten_by(y[own], y_held)]
                new = batch.append_column("_cell", pa.array(cell.astype(np.int32))).take(pa.array(own))
                keep = np.flatnonzero(~beaten_by(y_held, y[own]))
                held = new if held is None else pa.concat_batches([held.take(pa.array(keep)), new])
                y_held = np.concatenate((y_held[keep], y[own]))
                if len(y_held) > HELD:
                    yield held
                    held, y_held = None, np.empty((0, len(names)))
            if held is not None:
                yield held

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
        return points.mapInArrow(run, f"{kinds}, _cell int")

    def blocks(self, sizes: dict[int, int], block: int) -> tuple[list[tuple[int, int, int]], list[list[int]]]:
        """Cells dealt to blocks in Z-order: (cell, first block, number of blocks), and for each block the
        ones that may hold a row above one of its own."""
        order = sorted(sizes, key=self._z)
        block = max(block, -(-sum(sizes.values()) // BLOCKS))
        dealt, corners, held = [], [], 0
        for c in order:
            at = np.array(np.unravel_index(c, self.shape))
            n = -(-sizes[c] // block)
            if n > 1 or held + sizes[c] > block or not corners:
                dealt.append((c, len(corners), n))
                corners += [(at, at)] * n
                held = sizes[c] if n == 1 else block
            else:
                dealt.append((c, len(corners) - 1, 1))
                corners[-1] = (np.minimum(corners[-1][0], at), np.maximum(corners[-1][1], at))
                held += sizes[c]
        low, high = (np.array([x[i] for x in corners]) for i in (0, 1))
        return dealt, [np.flatnonzero((high >= x).all(1)).tolist() for x in low]

    def _z(self, cell: int) -> int:
        at = np.unravel_index(cell, self.shape)
        return sum((int(x) >> bit & 1) << (bit * len(at) + k) for k, x in enumerate(at) for bit in range(12))


def skyline_nd(df: DataFrame, objectives: Sequence[str], id_col: str, block: int = BLOCK, cells: int = CELLS, report: dict | None = None) -> DataFrame:
    """Front of any number of objectives. A grid of quantile cells discards whole cells and every task
    what its own rows dominate; the survivors, written once, meet in pairs of blocks, but only blocks
    whose cells reach above the other's. No side is broadcast, and no task holds more than two
    blocks. ``report`` gets the numbers of cells, blocks and pairs of blocks."""
    objectives = list(objectives)
    points = df.select(id_col, *objectives).dropna()
    grid = Grid(points, objectives, cells)
    survivors, _ = written(grid.pruned(points, objectives), "survivors")
    sizes = {r["_cell"]: r["count"] for r in survivors.groupBy("_cell").count().collect()}
    if not sizes:
        return points.limit(0)
    dealt, meets = grid.blocks(sizes, block)
    if report is not None:
        report |= {"cells": grid.occupied, "discarded": grid.discarded, "rows": sum(sizes.values()), "blocks": len(meets), "pairs": sum(map(len, meets))}
    spark = df.sparkSession
    # a row for each cell, and one for each block
    of_cell = F.broadcast(spark.createDataFrame(dealt, "_cell int, _first int, _n int"))
    asked = [[] for _ in meets]
    for mine, others in enumerate(meets):
        for other in others:
            asked[other].append(mine)
    rows = survivors.join(of_cell, "_cell").withColumn("_own", (F.col("_first") + F.pmod(F.xxhash64(id_col), F.col("_n"))).cast("int")).drop("_cell", "_first", "_n")
    partners = F.broadcast(spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(meets, asked, strict=True))], "_own int, _above array<int>, _below array<int>"))
    rows = rows.join(partners, "_own")
    left = rows.select(id_col, *objectives, F.col("_own").alias("_l"), F.explode("_above").alias("_r"), F.lit(True).alias("_asks"))
    right = rows.select(id_col, *objectives, F.explode("_below").alias("_l"), F.col("_own").alias("_r"), F.lit(False).alias("_asks"))

    def beaten(pdf):
        ask, other = pdf[pdf["_asks"]], pdf[~pdf["_asks"]]
        return ask.loc[beaten_by(ask[objectives].to_numpy(float), other[objectives].to_numpy(float)), [id_col]]

    gone = left.unionByName(right).groupBy("_l", "_r").applyInPandas(beaten, f"`{id_col}` {points.schema[id_col].dataType.simpleString()}")
    return survivors.drop("_cell").join(gone.distinct(), id_col, "left_anti")


def beaten_by(y: np.ndarray, by: np.ndarray, block: int = 256) -> np.ndarray:
    """Which rows of ``y`` a row of ``by`` dominates; compared block by block."""
    lost = np.zeros(len(y), bool)
    if not len(by) or not len(y):
        return lost
    for j in range(0, len(by), block):
        part = by[j : j + block]
        left = np.flatnonzero(~lost & (y <= part.max(0)).all(1))
        for i in range(0, len(left), block):
            own = left[i : i + block]
            a, b = y[own][:, None], part[None]
            lost[own] = ((b >= a).all(2) & (b > a).any(2)).any(1)
    return lost


def _undominated(y: np.ndarray, block: int = 256) -> np.ndarray:
    """Indices of undominated rows. In the order of falling sums (equal ones by their values) a row
    is dominated by none after it, so blocks meet what is kept so far and themselves."""
    if not len(y):
        return np.zeros(0, np.int64)
    if y.shape[1] == 2:
        order = np.lexsort((-y[:, 1], -y[:, 0]))
        a, b = y[order, 0], y[order, 1]
        first = np.concatenate(([True], a[1:] != a[:-1]))
        best = np.maximum.accumulate(b)
        higher = np.concatenate(([-np.inf], best[:-1]))[np.flatnonzero(first)][np.cumsum(first) - 1]  # of larger first values
        return np.sort(order[(b > higher) & (b == b[np.flatnonzero(first)][np.cumsum(first) - 1])])
    order = np.lexsort((*(-y[:, k] for k in range(y.shape[1])), -y.sum(1)))
    kept = np.empty((0, y.shape[1]))
    out: list[np.ndarray] = []
    for i in range(0, len(order), block):
        own = order[i : i + block]
        own = own[~beaten_by(y[own], kept)]
        own = own[~beaten_by(y[own], y[own])]
        kept = np.concatenate((kept, y[own]))
        out.append(own)
    return np.sort(np.concatenate(out)).astype(np.int64)


def hypervolume(df: DataFrame, y1: str, y2: str, ref: tuple[float, float] | tuple[Column, Column], by: Sequence[str] = (), name: str = "hv") -> DataFrame:
    """Area that each group's points dominate beyond ``ref``; a group without such points has 0.
    Without groups, strips are added up in ranges, whose tasks need the best of the higher ones only."""
    r1, r2 = (r if isinstance(r, Column) else F.lit(float(r)) for r in ref)
    above = df.where((F.col(y1) > r1) & (F.col(y2) > r2))
    if not by:
        front = _ranged_front(_points(above, y1, y2, ())).withColumn("_m", F.coalesce(F.greatest(_best_before(["_k"]), "_h"), r2))
        return front.agg(F.coalesce(F.sum((F.col("_a") - r1) * (F.col("_b") - F.col("_m"))), F.lit(0.0)).alias(name))
    front = front_values(above, y1, y2, by)
    w = W.partitionBy(*by).orderBy(F.desc(y1))
    strip = (F.col(y1) - r1) * (F.col(y2) - F.coalesce(F.max(y2).over(w.rowsBetween(W.unboundedPreceding, -1)), r2))
    area = front.withColumn("_v", strip).groupBy(*by).agg(F.coalesce(F.sum("_v"), F.lit(0.0)).alias(name))
    return df.select(*by).distinct().join(area, list(by), "left").select(*by, F.coalesce(name, F.lit(0.0)).alias(name))


def hypervolume_nd(df: DataFrame, objectives: Sequence[str], ref: Sequence[float], id_col: str, block: int = 1024) -> DataFrame:
    """Hypervolume of any number of objectives: the sum of what each front point adds to those that
    come after it, by rising last objective.

    What comes after a point reaches as high as it does in the last objective, so the point adds a
    prism: its height there, times the volume in the other objectives that is its own and not
    below any later point. For that a point needs the *limit set*: the later points cut down to its
    own corner, of which only the undominated ones count. Blocks of the front meet in pairs and
    leave each point's limit set among a block; these are united by point, so a task holds two blocks,
    or a limit set, but never the front.
    """
    objectives = list(objectives)
    m = len(objectives)
    if m < 3:
        rows = df.select(*(F.col(c) for c in objectives))
        if m == 2:
            return hypervolume(rows, *objectives, tuple(ref))
        return rows.agg(F.greatest(F.coalesce(F.max(objectives[0]) - float(ref[0]), F.lit(0.0)), F.lit(0.0)).alias("hv"))
    above = df
    for n, r in zip(objectives, ref, strict=True):
        above = above.where(F.col(n) > F.lit(float(r)))
    front = skyline_nd(above, objectives, id_col).select(*(F.col(c).cast("double").alias(f"y{k}") for k, c in enumerate(objectives))).distinct()
    front, _ = written(front, "front")
    blocks = min(BLOCKS, max(1, -(-front.count() // block)))
    last_first = [f"y{m - 1}", *(f"y{k}" for k in range(m - 1))]
    points = ranged(front, *last_first, ranges=blocks, also={"_p": F.monotonically_increasing_id()})
    y = F.array(*(f"y{k}" for k in range(m))).alias("y")
    top = points.agg(F.max("_k").alias("k")).first().k
    if top is None:
        return points.agg(F.lit(0.0).alias("hv"))
    left = points.select("_p", y, F.col("_k").alias("_l"), F.explode(F.sequence(F.col("_k"), F.lit(top))).alias("_r"), F.lit(True).alias("_asks"))
    right = points.select("_p", y, F.explode(F.sequence(F.lit(0), F.col("_k"))).alias("_l"), F.col("_k").alias("_r"), F.lit(False).alias("_asks"))

    def limited(key, pdf):
        import pandas as pd

        ask, other = pdf[pdf["_asks"]], pdf[~pdf["_asks"]]
        mine, theirs = (np.stack(x["y"].to_numpy()) if len(x) else np.empty((0, m)) for x in (ask, other))
        sets = []
        for p in mine:
            later = theirs if key[0] < key[1] else theirs[_after(theirs, p)]
            cut = np.minimum(later[:, :-1], p[:-1])
            sets.append(cut[_undominated(cut)].ravel())
        return pd.DataFrame({"_p": ask["_p"], "y": ask["y"], "cut": sets})

    sets = left.unionByName(right).groupBy("_l", "_r").applyInPandas(limited, "_p bigint, y array<double>, cut array<double>")
    low = np.array(ref, float)

    def added(batches):
        rows = ((r["_p"], r["y"], r["cut"]) for b in batches for r in b.to_pylist())
        total = 0.0
        for _, own in groupby(rows, key=lambda r: r[0]):
            p, cut = None, np.empty((0, m - 1))
            for _, p, more in own:
                cut = np.concatenate((cut, np.array(more, float).reshape(-1, m - 1)))
                cut = cut[_undominated(cut)]
            p = np.array(p, float)
            total += (p[-1] - low[-1]) * (float(np.prod(p[:-1] - low[:-1])) - volume(cut, low[:-1]))
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["hv"])

    parts = sets.repartition("_p").sortWithinPartitions("_p").mapInArrow(added, "hv double")
    return parts.agg(F.coalesce(F.sum("hv"), F.lit(0.0)).alias("hv"))


def _after(y: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Which rows come after ``p`` by the last value, then by the others in turn."""
    out, same = y[:, -1] > p[-1], y[:, -1] == p[-1]
    for k in range(y.shape[1] - 1):
        out |= same & (y[:, k] > p[k])
        same &= y[:, k] == p[k]
    return out


def volume(y: np.ndarray, ref: np.ndarray) -> float:
    """Exact hypervolume of one set in numpy, by the same sum of what each point adds."""
    y = y[(y > ref).all(1)]
    if not len(y):
        return 0.0
    if y.shape[1] == 1:
        return float(y.max() - ref[0])
    if y.shape[1] == 2:
        y = y[np.lexsort((-y[:, 1], -y[:, 0]))]
        top = np.concatenate(([ref[1]], np.maximum.accumulate(y[:, 1])[:-1]))
        return float(((y[:, 0] - ref[0]) * np.maximum(y[:, 1] - top, 0)).sum())
    y = np.unique(y[_undominated(y)], axis=0)
    y = y[np.argsort(y[:, -1], kind="stable")]
    total = 0.0
    for i, p in enumerate(y):
        own = float(np.prod(p[:-1] - ref[:-1])) - volume(np.minimum(y[i + 1 :, :-1], p[:-1]), ref[:-1])
        total += (p[-1] - ref[-1]) * own
    return total


def slices(y: np.ndarray, ref: np.ndarray) -> float:
    """Exact hypervolume by slicing along the last objective."""
    y = y[(y > ref).all(1)]
    if not len(y):
        return 0.0
    if y.shape[1] == 1:
        return float(y.max() - ref[0])
    order = np.argsort(-y[:, -1], kind="stable")
    y, total = y[order], 0.0
    for i in range(len(y)):
        low = y[i + 1, -1] if i + 1 < len(y) else ref[-1]
        if y[i, -1] > low:
            total += (y[i, -1] - low) * slices(y[: i + 1, :-1], ref[:-1])
    return total


def cumulative_rounds(df: DataFrame, team: str, rnd: str, y1: str, y2: str) -> DataFrame:
    """The points that all rounds up to each one have, as team, rnd, y1, y2. Each round's
    points are first reduced to its own front, so the range join multiplies fronts only."""
    fronts = front_values(df, y1, y2, [team, rnd])
    rounds = df.select(team, F.col(rnd).alias("_k")).distinct()
    joined = rounds.join(fronts, team).where(F.col(rnd) <= F.col("_k"))
    return joined.select(team, F.col("_k").alias(rnd), y1, y2)


class Staircase:
    """An ordered front of two objectives that takes points one by one, and its area beyond ``ref``.
    Points by rising first objective, and so by falling second one."""

    def __init__(self, ref: tuple[float, float] | None = None):
        self.x: list = []
        self.y: list = []
        self.ref, self.area = ref, 0.0

    def add(self, x, y) -> None:
        """Takes a point; the ones that it dominates go. A point that is there already changes nothing."""
        if self.ref and not (x > self.ref[0] and y > self.ref[1]):
            return
        at = bisect_left(self.x, x)
        if at < len(self.x) and self.y[at] >= y:
            return
        end = at + (at < len(self.x) and self.x[at] == x)
        low = at
        while low and self.y[low - 1] <= y:
            low -= 1
        if self.ref:
            # strips from the point to the left, down to the next higher point
            floor, right = self.y[at] if at < len(self.y) else self.ref[1], x
            for k in range(at - 1, low - 1, -1):
                self.area += (right - self.x[k]) * (y - floor)
                right, floor = self.x[k], self.y[k]
            left = self.x[low - 1] if low else self.ref[0]
            self.area += (right - left) * (y - floor)
        self.x[low:end], self.y[low:end] = [x], [y]


def _round_by_round(df: DataFrame, team: str, rnd: str, y1: str, y2: str) -> DataFrame:
    """Each round's own front, and a row without a point that ends the round; by team in their order."""
    ends = df.select(F.col(team).alias("_team"), F.col(rnd).alias("_rnd")).distinct().withColumn("_end", F.lit(True))
    fronts = front_values(df, y1, y2, [team, rnd]).select(F.col(team).alias("_team"), F.col(rnd).alias("_rnd"), F.col(y1).cast("double").alias("_x"), F.col(y2).cast("double").alias("_y"), F.lit(False).alias("_end"))
    both = fronts.unionByName(ends, allowMissingColumns=True)
    return both.repartition("_team").sortWithinPartitions("_team", "_rnd", "_end")


def _histories(batches, ref: tuple[float, float] | None) -> Iterator[tuple]:
    """(team, round, staircase) at the end of each round; one team's front is held."""
    rows = ((r["_team"], r["_rnd"], r["_x"], r["_y"], r["_end"]) for b in batches for r in b.to_pylist())
    for team, own in groupby(rows, key=lambda r: r[0]):
        steps = Staircase(ref)
        for _, rnd, x, y, end in own:
            if end:
                yield team, rnd, steps
            else:
                steps.add(x, y)


def _by_rows(found: Iterator[tuple], schema: pa.Schema, size: int = 5000) -> Iterator[pa.RecordBatch]:
    from itertools import islice

    while rows := list(islice(found, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def hv_history(df: DataFrame, team: str, rnd: str, y1: str, y2: str, ref: tuple[float, float]) -> DataFrame:
    """Hypervolume after each round of each team. A team's rounds pass once, in their order, through a
    sorted front, whose area grows by what a point adds: one row goes in for each point of a round's
    own front, whatever the number of rounds."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = _round_by_round(df, team, rnd, y1, y2)
    out = df.select(team, rnd).withColumn("hv", F.lit(0.0)).schema
    schema, low = to_arrow_schema(out), tuple(float(x) for x in ref)
    return rows.mapInArrow(lambda batches: _by_rows(((t, k, s.area) for t, k, s in _histories(batches, low)), schema), out)


def front_history(df: DataFrame, team: str, rnd: str, y1: str, y2: str) -> DataFrame:
    """The distinct points (as doubles) of the front after each round of each team, in one such pass."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = _round_by_round(df, team, rnd, y1, y2)
    out = df.select(team, rnd, F.col(y1).cast("double").alias(y1), F.col(y2).cast("double").alias(y2)).schema
    schema = to_arrow_schema(out)
    return rows.mapInArrow(lambda batches: _by_rows(((t, k, x, y) for t, k, s in _histories(batches, None) for x, y in zip(s.x, s.y, strict=True)), schema), out)


def hv_gain(history: DataFrame, team: str, rnd: str, hv: str = "hv") -> DataFrame:
    return history.withColumn("gain", F.col(hv) - F.lag(hv).over(W.partitionBy(team).orderBy(rnd)))


def auc(history: DataFrame, team: str, rnd: str, hv: str = "hv") -> DataFrame:
    """Mean height of the trapezoids between rounds; a single round's value stands for itself."""
    w = W.partitionBy(team).orderBy(rnd)
    pairs = history.withColumn("_t", (F.col(hv) + F.lead(hv).over(w)) / 2)
    return pairs.groupBy(team).agg(F.coalesce(F.avg("_t"), F.max(hv), F.lit(0.0)).alias("auc_hv"))


def staircase(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Step line through points by rising x: for each point but the first (previous x, y), then (x, y)."""
    keys = list(by) or [F.lit(0)]
    w = W.partitionBy(*keys).orderBy(x, F.desc(y))
    steps = df.select(*by, x, y).withColumn("_n", F.row_number().over(w)).withColumn("_p", F.lag(x).over(w))
    both = steps.select(*by, F.posexplode(F.array(F.struct(F.col("_p").alias("x"), F.col(y).alias("y"), F.col("_n").alias("n")), F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.col("_n").alias("n")))))
    return both.where("col.x IS NOT NULL").select(*by, (F.col("col.n") * 2 + F.col("pos") - 2).cast("int").alias("step"), F.col("col.x").alias("x"), F.col("col.y").alias("y"))

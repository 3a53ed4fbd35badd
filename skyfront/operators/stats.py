"""Scaling, ranks, correlations, quantiles, histograms and summaries."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import distance
from ..sources.scratch import written
from .near import nearest_rows


def zscore(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(x - mean) / population standard deviation; a constant column gives 0."""
    return _scaled(df, columns, by, lambda c: (F.avg(c), F.stddev_pop(c)))


def minmax(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(x - min) / (max - min); a constant column gives 0."""
    return _scaled(df, columns, by, lambda c: (F.min(c), F.max(c) - F.min(c)))


def _scaled(df: DataFrame, columns: Sequence[str], by: Sequence[str], of) -> DataFrame:
    # one row of bounds per group: aggregated with map-side combine, then joined
    parts = []
    for i, c in enumerate(columns):
        low, span = of(c)
        parts += [low.alias(f"_l{i}"), span.alias(f"_s{i}")]
    bounds = df.groupBy(*by).agg(*parts)
    joined = df.join(bounds, list(by)) if by else df.join(F.broadcast(bounds))
    for i, c in enumerate(columns):
        joined = joined.withColumn(c, (F.col(c) - F.col(f"_l{i}")) / F.when(F.col(f"_s{i}") == 0, 1.0).otherwise(F.col(f"_s{i}")))
    return joined.drop(*(f"_{k}{i}" for k in "ls" for i in range(len(columns))))


def dimensions(df: DataFrame, id_col: str, vector: str, first: int | None = None) -> DataFrame:
    """id, dim (from 0) and value of a vector column; only the first dimensions if asked."""
    v = F.slice(vector, 1, first) if first else F.col(vector)
    return df.select(id_col, F.posexplode(v.cast("array<double>")).alias("dim", "value"))


def _at_most(cuts: Sequence[float], x: Column) -> Column:
    """How many of the sorted ``cuts`` are at most ``x``, by halving: seven comparisons for 128 ranges."""

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(x < F.lit(cuts[middle]), between(low, middle)).otherwise(between(middle + 1, high))

    return F.when(x.isNull(), 0).otherwise(between(0, len(cuts)))


def ranged(df: DataFrame, *columns: str, ranges: int | None = None, also: Mapping[str, Column] | None = None) -> DataFrame:
    """``df`` dealt to ranges of ``columns`` that are ordered like their values, as _k, with the columns
    ``also`` made there. Spark samples where ranges end: as many as shuffles have partitions, fewer
    for few rows, or ``ranges``. Written, so that every reading finds a row in the same range."""
    dealt = df.repartitionByRange(ranges, *columns) if ranges else df.repartitionByRange(*columns)
    return written(dealt.withColumns({"_k": F.spark_partition_id(), **(also or {})}), "ranges")[0]


def _offsets(df: DataFrame, n: Column) -> DataFrame:
    """For each _k the sum of n in the ranges before it; a row for each range."""
    sums = df.groupBy("_k").agg(F.sum(n).alias("_t"))
    return F.broadcast(sums.select("_k", (F.sum("_t").over(W.orderBy("_k")) - F.col("_t")).alias("_o")))


def numbered(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """``df`` with the 1-based place by ``order``, which must leave no ties. Rows are dealt to ranges and
    sorted there once; a row's place in its range is in the number that Spark gives it, so no
    window shuffles them again, and no task sorts all."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = written(dealt, "ranks")[0].withColumns({"_k": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    return rows.join(_offsets(rows, F.lit(1)), "_k").withColumn(name, F.col("_at") + F.col("_o") + 1).drop("_k", "_at", "_o")


def ordinal_rank(df: DataFrame, column: str, tie: str, name: str) -> DataFrame:
    """``df`` with the 1-based rank by (column, tie)."""
    return numbered(df, [column, tie], name)


#: Distinct values whose ranks may be broadcast.
FEW_RANKS = 100_000


def average_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with the average rank of its ties. Distinct values are ranked, not rows, so a value
    that many rows share costs one row; the ranks of few values are broadcast."""
    keyed = ranged(df.groupBy(column).agg(F.count(F.lit(1)).alias("_n")), column)
    below = F.sum("_n").over(W.partitionBy("_k").orderBy(column)) - F.col("_n")
    ranked = keyed.withColumn("_b", below).join(_offsets(keyed, F.col("_n")), "_k")
    ranks = ranked.select(column, (F.col("_o") + F.col("_b") + (F.col("_n") + 1) / 2).alias(name))
    return df.join(F.broadcast(ranks) if keyed.count() <= FEW_RANKS else ranks, column)


def spearman(df: DataFrame, a: str, b: str, id_col: str, ties: str = "average") -> DataFrame:
    """Rank correlation: average ranks of ties, or ordinal ranks with ties by ``id_col``."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(id_col, a, b)
    if ties == "ordinal":
        ranked = ordinal_rank(ordinal_rank(rows, a, id_col, "_x"), b, id_col, "_y")
    else:
        ranked = average_rank(average_rank(rows, a, "_x"), b, "_y")
    return ranked.agg(F.coalesce(F.corr("_x", "_y"), F.lit(0.0)).alias("rho"))


def correlation_matrix(df: DataFrame, columns: Sequence[str], id_col: str) -> DataFrame:
    """Spearman's rho (average ranks) for each pair of columns, over the rows where both are
    there. Columns without nulls are ranked once, whatever the number of pairs."""
    columns = list(columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    some = df.agg(*(F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns))).first()
    full = [c for i, c in enumerate(columns) if not some[i]]
    ranked = df.select(*full)
    for i, c in enumerate(full):
        ranked = average_rank(ranked, c, f"_r{i}")
    out = None
    whole = [(a, b) for a, b in pairs if a in full and b in full]
    if whole:
        place = {c: i for i, c in enumerate(full)}
        one = ranked.agg(*(F.coalesce(F.corr(f"_r{place[a]}", f"_r{place[b]}"), F.lit(0.0)).alias(f"_c{k}") for k, (a, b) in enumerate(whole)))
        rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_c{k}").alias("rho")) for k, (a, b) in enumerate(whole)))
        out = one.select(F.explode(rows).alias("x")).select("x.*")
    for a, b in pairs:
        if (a, b) not in whole:
            part = spearman(df, a, b, id_col).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "rho")
            out = part if out is None else out.unionByName(part)
    return out


#: Distinct values of one range that are counted at once when an exact quantile is looked for.
FEW = 50_000


def _kth(df: DataFrame, ranks: Sequence[int]) -> dict[int, float]:
    """The values at these places (from 0) of ``df(x double)``, sorted and without nulls. Each round
    counts the rows in 128 ranges and goes on in those that hold a place, so that no task ever
    gathers or sorts the whole column."""
    out: dict[int, float] = {}
    todo = [(None, None, 0, sorted(set(ranks)))]  # open range, rows before it, places in it
    while todo:
        low, high, before, places = todo.pop()
        if not places:
            continue
        rows = df
        if low is not None:
            rows = rows.where(F.col("x") > low)
        if high is not None:
            rows = rows.where(F.col("x") < high)
        r = rows.agg(F.approx_count_distinct("x").alias("n"), F.percentile_approx("x", [k / 128 for k in range(1, 128)], 1000).alias("q")).first()
        if r.n <= FEW // 2:
            at = before
            for v in rows.groupBy("x").agg(F.count(F.lit(1)).alias("n")).orderBy("x").toLocalIterator():
                while places and places[0] < at + v.n:
                    out[places.pop(0)] = v.x
                at += v.n
            continue
        cuts = sorted(set(r.q))
        bin_ = 2 * _at_most(cuts, F.col("x")) - F.col("x").isin(*cuts).cast("int")
        at = before
        for v in rows.groupBy(bin_.alias("k")).agg(F.count(F.lit(1)).alias("n")).orderBy("k").collect():
            own = [p for p in places if at <= p < at + v.n]
            if v.k % 2:  # a cut itself
                out |= {p: cuts[v.k // 2] for p in own}
            else:
                todo.append((cuts[v.k // 2 - 1] if v.k else low, cuts[v.k // 2] if v.k // 2 < len(cuts) else high, at, own))
            at += v.n
    return out


def exact_quantiles(df: DataFrame, column: str, qs: Sequence[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation; None for a column without values."""
    x = df.select(F.col(column).cast("double").alias("x")).where("x IS NOT NULL")
    n = x.count()
    if not n:
        return [None] * len(qs)
    at = [(n - 1) * q for q in qs]
    found = _kth(x, [k for p in at for k in (math.floor(p), math.ceil(p))])
    return [found[math.floor(p)] + (found[math.ceil(p)] - found[math.floor(p)]) * (p - math.floor(p)) for p in at]


def quantile(df: DataFrame, columns: Sequence[str], q: float) -> DataFrame:
    """One row with the exact quantile (linear interpolation) of each column."""
    values = [exact_quantiles(df, c, [q])[0] for c in columns]
    return df.sparkSession.createDataFrame([tuple(values)], ", ".join(f"`{c}` double" for c in columns))


def quantile_band(df: DataFrame, y1: str, y2: str, on_front: str, q: float, at_least: int) -> DataFrame:
    """Rows off the front with both objectives at or below their quantile; if these are fewer
    than ``at_least``, all rows off the front; if these are too, all rows."""
    q1, q2 = (exact_quantiles(df, y, [q])[0] for y in (y1, y2))
    off = ~F.col(on_front)
    band = off & (F.col(y1) <= F.lit(q1)) & (F.col(y2) <= F.lit(q2))
    n = df.agg(F.count_if(band).alias("band"), F.count_if(off).alias("off")).first()
    return df.where(band) if n.band >= at_least else df.where(off) if n.off >= at_least else df


def angle(y1: str, y2: str, ref: tuple[float, float]) -> Column:
    """Direction of a point from ``ref``, its offsets kept above zero."""
    return F.atan2(F.greatest(F.col(y2) - ref[1], F.lit(1e-9)), F.greatest(F.col(y1) - ref[0], F.lit(1e-9)))


def angular_spread(df: DataFrame, y1: str, y2: str, ref: tuple[float, float], by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.coalesce(F.stddev_samp(angle(y1, y2, ref)), F.lit(0.0)).alias("spread"))


def region_coverage(df: DataFrame, y1: str, y2: str, ref: tuple[float, float], by: Sequence[str], bins: int = 6) -> DataFrame:
    bin_ = F.floor(F.least(angle(y1, y2, ref), F.lit(math.pi / 2 - 1e-9)) / (math.pi / 2) * bins)
    return df.groupBy(*by).agg(F.count_distinct(bin_).alias("regions"))


def bin_of(column: Column | str, low: float, high: float, bins: int) -> Column:
    """Bin from 0; the top edge belongs to the last bin, values outside to none (null)."""
    c = F.col(column) if isinstance(column, str) else column
    k = F.floor((c - low) / (high - low) * bins).cast("int")
    return F.when((c >= low) & (c <= high), F.least(k, F.lit(bins - 1)))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """bin and n; empty bins are left out, as are values outside the range."""
    return df.select(bin_of(column, low, high, bins).alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def histogram_2d(df: DataFrame, x: str, y: str, bounds: tuple[float, float], bins: int) -> DataFrame:
    cells = df.select(bin_of(x, *bounds, bins).alias("bx"), bin_of(y, *bounds, bins).alias("by_"))
    return cells.where("bx IS NOT NULL AND by_ IS NOT NULL").groupBy("bx", "by_").agg(F.count(F.lit(1)).alias("n"))


def histogram_pairs(df: DataFrame, columns: Sequence[str], bounds: tuple[float, float], bins: int) -> DataFrame:
    """:func:`histogram_2d` of every pair of columns, in one pass: dx and dy (places of the columns),
    bx, by_ and n."""
    cells = [F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy"), bin_of(a, *bounds, bins).alias("bx"), bin_of(b, *bounds, bins).alias("by_")) for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j]
    each = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("bx IS NOT NULL AND by_ IS NOT NULL")
    return each.groupBy("dx", "dy", "bx", "by_").agg(F.count(F.lit(1)).alias("n"))


def joint_plot(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """What a joint plot shows, in one pass: layer (cell, top or right), bx, by_ and n; bins go from each
    column's least to its greatest value."""
    unit = minmax(df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna(), ["_x", "_y"])
    cells = unit.select(bin_of("_x", 0.0, 1.0, bins).alias("bx"), bin_of("_y", 0.0, 1.0, bins).alias("by_"))
    sums = cells.groupingSets([["bx", "by_"], ["bx"], ["by_"]], "bx", "by_").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
    layer = F.when(F.col("_g") == 0, "cell").when(F.col("_g") == 1, "top").otherwise("right")
    return sums.select(layer.alias("layer"), "bx", "by_", "n")


def group_sizes(df: DataFrame, label: str) -> DataFrame:
    """label and n."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def lean(df: DataFrame, y1: str, y2: str, by: Sequence[str]) -> DataFrame:
    """By group the mean of y1 less y2: towards which objective its rows lean."""
    return df.groupBy(*by).agg(F.avg(F.col(y1) - F.col(y2)).alias("lean"))


def group_means(df: DataFrame, label: str, vector: str) -> DataFrame:
    """label, dim (from 0) and c: each label's mean vector, a row per dimension."""
    v = df.select(label, F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "value"))
    return v.groupBy(label, "dim").agg(F.avg("value").alias("c"))


#: Labels whose mean vectors may be broadcast.
LABELS = 4096


def nearest_mean(df: DataFrame, id_col: str, label: str, vector: str, most: int = LABELS) -> DataFrame:
    """id and centroid: the label whose mean vector is nearest, ties to the lowest. At most ``most``
    means are broadcast; more meet the rows in blocks."""
    means = group_means(df, label, vector).groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "c"))), lambda s: s["c"]).alias("m"))
    points = df.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("x"))
    if df.select(label).distinct().limit(most + 1).count() > most:
        return nearest_rows(points, means.select(F.col(label).alias("id"), F.col("m").alias("x")), "id", "x", itself=True).select("id", F.col("near").alias("centroid"))
    d = points.join(F.broadcast(means)).select("id", F.col(label).alias("l"), distance("x", "m").alias("d"))
    return d.groupBy("id").agg(F.min(F.struct("d", "l")).alias("m")).select("id", F.col("m.l").alias("centroid"))


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """The most frequent values; equal counts by value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(n)


def summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per numeric column: n, n_distinct, min, median, max. The exact medians come from
    counts by range, not from one task's buffer."""
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.count_distinct(x).alias(f"d{i}"), F.min(x).alias(f"a{i}"), F.max(x).alias(f"z{i}")]
    medians = [exact_quantiles(df, c, [0.5])[0] for c in columns]
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"d{i}").alias("n_distinct"), F.col(f"a{i}").alias("min"), F.lit(medians[i]).cast("double").alias("median"), F.col(f"z{i}").alias("max")) for i, c in enumerate(columns)]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def pair_distances(df: DataFrame, id_col: str, vector: str, ordered: bool = True) -> DataFrame:
    """i, j and d for all pairs of a small set (i < j if ``ordered``, else i <> j). A pool's
    blocks of rows should come from a selection; it is quadratic by definition."""
    a = df.select(F.col(id_col).alias("i"), F.col(vector).cast("array<double>").alias("u"))
    b = df.select(F.col(id_col).alias("j"), F.col(vector).cast("array<double>").alias("v"))
    on = F.col("i") < F.col("j") if ordered else F.col("i") != F.col("j")
    return a.join(b, on).select("i", "j", distance("u", "v").alias("d"))


def diversity_by(df: DataFrame, label: str, id_col: str, vector: str, block: int = 1024) -> DataFrame:
    """label and diversity: the mean distance of all pairs of a label's rows, 0 for a single row. A
    large label is split into blocks that meet in pairs, a group each; one sum leaves a group."""
    sizes = df.groupBy(label).agg(F.ceil(F.count(F.lit(1)) / block).alias("_n"))
    own = F.pmod(F.xxhash64(id_col), F.col("_n"))
    meets = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1), lambda j: F.struct(F.least(j, F.col("_own")).alias("l"), F.greatest(j, F.col("_own")).alias("r")))
    rows = df.join(sizes, label).withColumn("_own", own).select(F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"), "_own", F.explode(meets).alias("m")).select("label", "v", "_own", "m.l", "m.r")

    def summed(key, pdf):
        import pandas as pd

        left = np.stack(pdf["v"].to_numpy())
        within = key[1] == key[2]
        mine = pdf["_own"].to_numpy() == key[1]
        a, b = (left, left) if within else (left[mine], left[~mine])
        total = sum(float(np.sqrt(((x - b) ** 2).sum(1)).sum()) for x in a)
        n = len(a) * (len(a) - 1) // 2 if within else len(a) * len(b)
        return pd.DataFrame({"label": [key[0]], "s": [total / 2 if within else total], "n": [n]})

    kind = df.schema[label].dataType.simpleString()
    parts = rows.groupBy("label", "l", "r").applyInPandas(summed, f"label {kind}, s double, n bigint")
    return parts.groupBy(F.col("label").alias(label)).agg(F.coalesce(F.sum("s") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("diversity"))


def nearest_distances(df: DataFrame, id_col: str, vector: str, block: int = 2048) -> DataFrame:
    """Each row's distance to its nearest other row; 0 for a row alone."""
    return nearest_rows(df, df, id_col, vector, block).select("id", F.when(F.col("near").isNull(), 0.0).otherwise(F.col("d")).alias("d"))


def pca(df: DataFrame, id_col: str, vector: str, k: int) -> tuple[DataFrame, list[float]]:
    """Exact principal components: id, z (array of k scores), and the explained shares.

    The covariance matrix is one distributed aggregate of dimension d x d; the driver only
    decomposes that. Each component's largest loading is positive; missing ones are zero.
    """
    spark = df.sparkSession
    plain = df.select(id_col, F.col(vector).cast("array<double>").alias("_v"))

    def moments(batches):
        import pandas as pd

        n, s, xx = 0, None, None
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["_v"].to_numpy())
            n, s, xx = n + len(x), x.sum(0) + (0 if s is None else s), x.T @ x + (0 if xx is None else xx)
        if n:
            yield pd.DataFrame({"n": [n], "s": [s], "xx": [xx.ravel()]})

    parts = plain.select("_v").mapInPandas(moments, "n bigint, s array<double>, xx array<double>")
    dims = plain.select(F.size("_v").alias("d")).first()
    if dims is None:
        return plain.select(id_col, F.array().cast("array<double>").alias("z")), [0.0] * k
    sums = parts.select(F.col("n"), F.posexplode(F.concat("s", "xx")).alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("at").collect()
    d, n = dims.d, sums[0].n
    flat = np.array([r.x for r in sums])
    mean = flat[:d] / n
    values, loadings = np.linalg.eigh(flat[d:].reshape(d, d) / n - np.outer(mean, mean))
    order = np.argsort(-values)[:k]
    loadings = loadings[:, order]
    loadings = loadings * np.where(loadings[np.abs(loadings).argmax(0), np.arange(loadings.shape[1])] < 0, -1, 1)
    shares = (np.maximum(values[order], 0) / max(values.sum(), 1e-300)).tolist() + [0.0] * max(0, k - d)
    sent = spark.sparkContext.broadcast((mean, loadings))

    def project(batches):
        for pdf in batches:
            if len(pdf):
                m, w = sent.value
                z = (np.stack(pdf["_v"].to_numpy()) - m) @ w
                z = np.pad(z, ((0, 0), (0, max(0, k - z.shape[1]))))
                yield pdf[[id_col]].assign(z=list(z))

    kind = df.schema[id_col].dataType.simpleString()
    return plain.mapInPandas(project, f"{id_col} {kind}, z array<double>"), shares

"""SimHash near-duplicates, found through Golay-code fuzzy keys.

A 64-bit fingerprint is three segments of 22, 21 and 21 bits. If two fingerprints differ in
at most 3 bits, then either some two segments differ in at most one bit together (one of
them not at all), or each of the three differs in exactly one. So two fingerprints that
link share a key of one of these kinds:

* one segment as it is, with a codeword near another segment (six ordered pairs);
* codewords near each of the three segments.

Codewords come from :mod:`.golay`, which gives one or six to a segment. Keys are dealt out,
sorted, and fingerprints that share one are compared in full. What leaves a partition is a
spanning forest of its links, not all pairs, so a large group of near copies stays linear;
components of those forests are the components of the links.

A key that very many fingerprints share is split into blocks: each pair of blocks meets in
a task of its own, so no task holds more than two blocks. Which keys to split is estimated
from a hash sample and only affects balance, never the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, dropped, mapped, written
from .components import components
from .golay import fuzzy_keys

SEGMENTS = (22, 21, 21)
MAX_BITS = 3
SEED = 42
#: Fingerprints that may meet under one key in one task; one in SAMPLE is counted beforehand.
BLOCK, SAMPLE = 4096, 16


def shingles(text: bytes, words: int) -> list[bytes]:
    w = text.lower().split()
    if len(w) <= words:
        return [b" ".join(w)] if w else []
    line = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    return [line[a:b] for a, b in zip(begins[: len(w) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]


def fingerprint(text: bytes, words: int, seeds: tuple[int, ...] = (SEED,), distinct: bool = False) -> list[int]:
    """For each seed: bit b is 1 if it is set in over half of the shingles' XXH64; 0 for a
    text without words. ``distinct`` counts each shingle once."""
    found = shingles(text, words)
    if distinct:
        found = list(dict.fromkeys(found))
    if not found:
        return [0] * len(seeds)
    digest, out = xxhash.xxh64_intdigest, []
    for seed in seeds:
        h = np.fromiter((digest(s, seed) for s in found), np.uint64, len(found))
        ones = np.zeros(64, np.int64)
        for part in np.array_split(h, max(1, len(h) // 4096)):
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0]))
    return out


def fingerprints(documents: DataFrame, words: int, seeds: tuple[int, ...] = (SEED,), distinct: bool = False) -> DataFrame:
    """``documents(doc_id, text)`` to doc_id and fp (array of signed 64-bit, one per seed).

    Other columns are left out; a null text is an empty one.
    """

    def rows(batch):
        out = [fingerprint(t, words, seeds, distinct) for t in as_bytes(batch.column("text"))]
        flat = np.array(out, np.uint64).astype(np.int64).ravel()
        return {"doc_id": batch.column("doc_id"), "fp": pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, len(seeds)).astype(np.int32), flat)}

    return mapped(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id bigint, fp array<bigint>", rows)


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of unsigned fingerprints, and the row that each belongs to."""
    seg, at = [], 0
    for n in SEGMENTS:
        seg.append((fp >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64))
        at += n
    near = [fuzzy_keys(s) for s in seg]
    row = np.arange(len(fp))
    keys, rows = [], []
    kind = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                k, use = near[j]
                keys.append((kind << 40 | seg[i][:, None] << 12 | k)[use])
                rows.append(np.broadcast_to(row[:, None], use.shape)[use])
                kind += 1
    (a, use_a), (b, use_b), (c, use_c) = near
    use = use_a[:, :, None, None] & use_b[:, None, :, None] & use_c[:, None, None, :]
    keys.append((kind << 40 | a[:, :, None, None] << 24 | b[:, None, :, None] << 12 | c[:, None, None, :])[use])
    rows.append(np.broadcast_to(row[:, None, None, None], use.shape)[use])
    return np.concatenate(keys), np.concatenate(rows)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A minimum spanning forest of links between fingerprints, by differing bits: rounds in
    which every tree takes its closest link to another one."""
    order = np.argsort(np.bitwise_count(a ^ b), kind="stable")
    a, b = a[order], b[order]
    nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root, taken = np.arange(len(nodes)), np.zeros(len(a), bool)
    while len(e := np.flatnonzero(root[x] != root[y])):
        best = np.full(len(nodes), len(a))
        np.minimum.at(best, root[x[e]], e)
        np.minimum.at(best, root[y[e]], e)
        best = np.unique(best[best < len(a)])
        taken[best] = True
        u, v = x[best], y[best]
        while (root[u] != root[v]).any():
            low = np.minimum(root[u], root[v])
            new = root.copy()
            np.minimum.at(new, root[u], low)
            np.minimum.at(new, root[v], low)
            while (new[new] != new).any():
                new = new[new]
            root = new[root]
    return a[taken], b[taken]


def links_in(key: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among sorted rows that share a key."""
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.concatenate((start, [len(key)])))
    a, b = [], []
    for at, n in zip(start[size > 64].tolist(), size[size > 64].tolist(), strict=True):
        own = fp[at : at + n]
        for i in range(0, n, 512):
            x, y = np.nonzero(np.bitwise_count(own[i : i + 512, None] ^ own[None, i:]) <= max_bits)
            u, v = own[i + x], own[i + y]
            u, v = forest(u[u != v], v[u != v])
            a.append(u)
            b.append(v)
    keep = np.repeat(size <= 64, size)
    key, fp = key[keep], fp[keep]
    for shift in range(1, 64):
        same = np.flatnonzero(key[shift:] == key[:-shift])
        if not len(same):
            break
        hit = same[np.bitwise_count(fp[same] ^ fp[same + shift]) <= max_bits]
        a.append(fp[hit])
        b.append(fp[hit + shift])
    if not a:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    a, b = np.concatenate(a), np.concatenate(b)
    other = a != b
    return forest(a[other], b[other])


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``distinct(fp bigint)``, without repeats, to ``(a, b)``: a spanning forest of all links."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the keys are made for at most 3 differing bits")

    def explode(batch):
        fp = batch.column("fp").to_numpy(zero_copy_only=False)
        key, row = keys_of(fp.view(np.uint64))
        return {"key": key, "fp": fp[row]}

    keyed = mapped(distinct.select("fp").where("fp IS NOT NULL"), "key bigint, fp bigint", explode)
    hot = mapped(distinct.select("fp").where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLE)) == 0), "key bigint, fp bigint", explode)
    hot = hot.groupBy("key").count().where(F.col("count") * SAMPLE > BLOCK).select("key", F.ceil(F.col("count") * SAMPLE / BLOCK).cast("bigint").alias("blocks"))
    hot, _ = written(hot, "hot-keys")
    if n_hot := hot.count():
        keyed = keyed.join(F.broadcast(hot) if n_hot <= 10_000 else hot, "key", "left")
        block = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks"))
        pairs = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda j: F.least(j, block) * (1 << 31) + F.greatest(j, block))
        keyed = keyed.select("key", "fp", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(pairs)).alias("part"))
    else:
        keyed = keyed.withColumn("part", F.lit(0).cast("bigint"))

    def compare(batches):
        tail = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
        for batch in batches:
            key, part, fp = (np.concatenate((t, batch.column(n).to_numpy(zero_copy_only=False))) for t, n in zip(tail, ("key", "part", "fp"), strict=True))
            last = np.flatnonzero((key != key[-1]) | (part != part[-1])) if len(key) else []
            cut = int(last[-1]) + 1 if len(last) else 0
            tail = (key[cut:], part[cut:], fp[cut:])
            if cut:
                yield found(key[:cut], part[:cut], fp[:cut])
        yield found(*tail)

    def found(key, part, fp):
        run = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (part[1:] != part[:-1])))) if len(key) else key
        a, b = links_in(run, fp.view(np.uint64), max_bits)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return keyed.repartition("key", "part").sortWithinPartitions("key", "part").select("key", "part", "fp").mapInArrow(compare, "a bigint, b bigint")


def near_duplicates(documents: DataFrame, words: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """``documents(doc_id, text)`` to doc_id, fp, component_id (smallest doc_id reachable).

    Fingerprints link at ``max_bits`` or fewer differing bits. Equal texts are one
    fingerprint and cost one; a null or word-less text has fingerprint zero and links like any
    other. Rows with a null doc_id get a row with their fingerprint's component.
    """
    docs, _ = written(fingerprints(documents, words).select("doc_id", F.col("fp")[0].alias("fp")), "fingerprints")
    distinct, _ = written(docs.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    tree = components(links(distinct, max_bits))
    rooted = distinct.join(tree.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    low = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return docs.join(rooted.join(low, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


#: The pipeline's near duplicates: words of a shingle, and the similarity of two shingle sets.
STAGE_WORDS, SIMILARITY = 5, 0.8
#: Shingles that come last in the order of prefixes: at most so many, each in so many sampled texts.
HOT, HOT_TEXTS = 200_000, 3
#: Texts under one key whose pairs are all compared at once; more are joined in two steps.
AT_ONCE = 16


def jaccard(a: bytes, b: bytes, words: int) -> float:
    x, y = set(shingles(a, words)), set(shingles(b, words))
    return len(x & y) / len(x | y) if x or y else 1.0


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """64-bit hashes of the distinct shingles, sorted."""
    w = text.lower().split()
    if len(w) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), words)] if w else [], np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    h = np.zeros(len(w) - words + 1, np.uint64)
    for k in range(words):
        h = h * np.uint64(0x9E3779B97F4A7C15) + each[k : k + len(h)]
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(h ^ h >> np.uint64(32))


def least_whole(x):
    """The next whole number, whatever the last bits of a product."""
    return np.ceil(x - 1e-9).astype(np.int64)


def prefix(h: np.ndarray, hot: np.ndarray, rank: np.ndarray, similarity: float) -> np.ndarray:
    """The first of a text's shingles, by rank (``hot`` is sorted; 0 for others), then hash: two
    sets with that Jaccard similarity share one of these at least. A set without shingles has
    the key 0."""
    if not len(h):
        return np.zeros(1, np.uint64)
    at = np.minimum(np.searchsorted(hot, h), max(len(hot) - 1, 0))
    place = np.where(hot[at] == h, rank[at], 0) if len(hot) else np.zeros(len(h), np.int64)
    return h[np.lexsort((h, place))][: len(h) - int(least_whole(similarity * len(h))) + 1]


def alike(na, pa_, nb, pb, similarity: float) -> np.ndarray:
    """Whether sets of these sizes, whose first common shingle is at these places, can be similar."""
    sizes = np.minimum(na, nb) >= least_whole(similarity * np.maximum(na, nb))
    return sizes & (1 + np.minimum(na - pa_, nb - pb) - 1 >= least_whole(similarity / (1 + similarity) * (na + nb)))


def pairs_in(key: np.ndarray, node: np.ndarray, n: np.ndarray, pos: np.ndarray, root: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs among sorted rows that share a key, have different roots and can be similar."""
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.concatenate((start, [len(key)])))
    for at, m in zip(start[size > 64].tolist(), size[size > 64].tolist(), strict=True):
        own = slice(at, at + m)
        for i in range(at, at + m, 512):
            row = slice(i, min(i + 512, at + m))
            x, y = np.nonzero(alike(n[row, None], pos[row, None], n[None, own], pos[None, own], similarity) & (node[row, None] < node[None, own]) & (root[row, None] != root[None, own]))
            a.append(node[i + x])
            b.append(node[at + y])
    keep = np.repeat(size <= 64, size)
    key, node, n, pos, root = key[keep], node[keep], n[keep], pos[keep], root[keep]
    for shift in range(1, 64):
        same = np.flatnonzero(key[shift:] == key[:-shift])
        if not len(same):
            break
        same = same[root[same] != root[same + shift]]
        hit = same[alike(n[same], pos[same], n[same + shift], pos[same + shift], similarity)]
        a.append(np.minimum(node[hit], node[hit + shift]))
        b.append(np.maximum(node[hit], node[hit + shift]))
    a, b = np.concatenate(a), np.concatenate(b)
    if not len(a):
        return a, b
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) & (a != b)
    return a[new], b[new]


def first_pairs(key: np.ndarray, node: np.ndarray, n: np.ndarray, pos: np.ndarray, similarity: float) -> tuple[np.ndarray, ...]:
    """Of small groups all pairs; of each larger one a number in proportion to its size (by
    size next to each other, and each with the smallest node), and its rows as they are,
    held for :func:`pairs_in`. Columns a (or node), b, n, pos, key, held."""
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.concatenate((start, [len(key)])))
    many = np.repeat(size > AT_ONCE, size)
    a, b = pairs_in(key[~many], node[~many], n[~many], pos[~many], node[~many], similarity)
    key, node, n, pos = key[many], node[many], n[many], pos[many]
    order = np.lexsort((node, n, key))
    x, y = order[:-1], order[1:]
    size = size[size > AT_ONCE]
    lowest = np.lexsort((node, key))[np.cumsum(size) - size]
    x, y = np.concatenate((x, np.repeat(lowest, size))), np.concatenate((y, np.arange(len(key))))
    use = (key[x] == key[y]) & (node[x] != node[y]) & alike(n[x], pos[x], n[y], pos[y], similarity)
    x, y = node[x[use]], node[y[use]]
    both = np.unique(np.stack((np.concatenate((a, np.minimum(x, y))), np.concatenate((b, np.maximum(x, y))))), axis=1)
    pad, k = np.zeros(both.shape[1], np.int32), len(key)
    return np.concatenate((both[0], node)), np.concatenate((both[1], np.full(k, -1))), np.concatenate((pad, n)), np.concatenate((pad, pos)), np.concatenate((pad.astype(np.int64), key)), np.concatenate((pad != 0, np.ones(k, bool)))


def hot_shingles(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of a sample of ``texts(doc_id, text)`` have, sorted, and each one's rank
    from 1, the most frequent last. The order decides how many texts meet under a key, never
    which pairs are found."""

    def explode(batch):
        return {"key": np.concatenate([np.empty(0, np.uint64)] + [shingle_hashes(t, words) for t in as_bytes(batch.column("text"))]).view(np.int64)}

    counted = mapped(texts.where(F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(SAMPLE)) == 0).select("text"), "key bigint", explode).groupBy("key").count()
    rows = counted.where(F.col("count") >= HOT_TEXTS).orderBy(F.desc("count"), "key").limit(HOT).select("key").toArrow()
    hot = rows.column("key").to_numpy().view(np.uint64)
    order = np.argsort(hot)
    return hot[order], (len(hot) - np.arange(len(hot)))[order]


def prefixes(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """``texts(doc_id, text)`` to doc_id, n (distinct shingles) and keys (the prefix in order)."""
    sent = texts.sparkSession.sparkContext.broadcast(hot_shingles(texts, words))

    def rows(batch):
        hashes = [shingle_hashes(t, words) for t in as_bytes(batch.column("text"))]
        keys = [prefix(h, *sent.value, similarity) for h in hashes]
        offsets = np.cumsum([0] + [len(k) for k in keys]).astype(np.int32)
        return {"doc_id": batch.column("doc_id"), "n": np.array([len(h) for h in hashes], np.int32), "keys": pa.ListArray.from_arrays(offsets, np.concatenate(keys).view(np.int64))}

    return mapped(texts.select("doc_id", "text"), "doc_id bigint, n int, keys array<bigint>", rows)


def grouped(keyed: DataFrame, rows, schema: str) -> DataFrame:
    """Sorted rows of whole keys, as arrays by column, through ``rows``."""
    names = keyed.columns
    made = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        tail = None
        for batch in batches:
            own = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
            own = own if tail is None else [np.concatenate(x) for x in zip(tail, own, strict=True)]
            last = np.flatnonzero(own[0] != own[0][-1]) if len(own[0]) else []
            cut = int(last[-1]) + 1 if len(last) else 0
            tail = [x[cut:] for x in own]
            if cut:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows(*(x[:cut] for x in own))], made)
        if tail is not None and len(tail[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows(*tail)], made)

    return keyed.repartition(names[0]).sortWithinPartitions(names[0]).mapInArrow(run, schema)


def verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose texts have the similarity."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("s")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("t")), "b")

    def rows(batch):
        s, t = as_bytes(batch.column("s")), as_bytes(batch.column("t"))
        like = np.array([jaccard(x, y, words) >= similarity for x, y in zip(s, t, strict=True)])
        return {n: batch.column(n).filter(pa.array(like)) for n in ("a", "b")}

    return mapped(both.select("a", "b", "s", "t"), "a bigint, b bigint", rows)


def deduplicated(documents: DataFrame, words: int = STAGE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``documents`` with one document, the smallest doc_id, of each near-duplicate group.

    Equal texts are one group. Different texts link if the sets of their ``words``-word shingles
    have that Jaccard similarity. All such pairs are found: under one order of all shingles, two
    similar sets share one among the first few of each (a prefix), which are the keys under
    which texts meet. Groups are the components of the links that hold. Under a key of many
    texts a few pairs are checked first; then all pairs of texts that are not yet in one
    component, so a failed check never stands for another pair.

    Rows with a null doc_id are kept; rows that share a doc_id are one document and are kept or
    dropped alike; texts without words are one group. All columns are kept.
    """
    text = F.col("text").cast("string")
    keyed = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    # a row's text key is a function of the row
    texts = keyed.select(F.col("doc_id"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    paths: list[str] = []

    def kept(df, label):
        df, path = written(df, label)
        paths.append(path)
        return df

    # written, so that texts are dealt out anew to meet their group and a large one can be split
    groups = kept(texts.groupBy("t1", "t2").agg(F.min("doc_id").alias("node")), "text-groups")
    member = kept(texts.join(groups, ["t1", "t2"]).select("doc_id", "node").distinct(), "members")
    own = member.where("doc_id = node").select("node")
    nodes = prefixes(keyed, words, similarity).join(own, F.col("doc_id") == F.col("node"), "left_semi")
    nodes = nodes.select(F.posexplode("keys").alias("pos", "key"), F.col("doc_id").alias("node"), "n").select("key", "node", "n", "pos")

    def linked(pairs, label):
        pairs = kept(pairs.distinct(), label)
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        wanted = kept(keyed.withColumnRenamed("doc_id", "node").join(ends, "node", "left_semi").distinct(), "wanted")
        return verified(pairs, wanted, words, similarity)

    first = kept(grouped(nodes, lambda *x: first_pairs(*x, similarity), "a bigint, b bigint, n int, pos int, key bigint, held boolean"), "first-pairs")
    tree = components(linked(first.where("NOT held").select("a", "b"), "candidates"))
    held = first.where("held").select("key", F.col("a").alias("node"), "n", "pos").join(tree, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_keys = held.groupBy("key").agg(F.count(F.lit(1)).alias("count"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    open_keys = kept(open_keys.select("key", F.ceil(F.col("count") / BLOCK).cast("bigint").alias("blocks")), "open-keys")
    if open_keys.count():
        # pairs of blocks, so that no task holds more than two blocks of a key
        block = F.pmod(F.xxhash64("node"), F.col("blocks"))
        parts = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda j: F.least(j, block) * (1 << 31) + F.greatest(j, block))
        rest = held.join(open_keys, "key").withColumn("part", F.explode(parts)).select(F.xxhash64("key", "part").alias("key"), "node", "n", "pos", "root")
        more = linked(grouped(rest, lambda *x: pairs_in(*x, similarity), "a bigint, b bigint"), "more-candidates")
        tree = components(more.union(tree.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    gone = member.join(tree, "node", "left").select("doc_id", F.coalesce("root", "node").alias("keeper")).where("doc_id <> keeper")
    gone, _ = written(gone.select("doc_id").distinct(), "dropped-ids")
    dropped(documents.sparkSession, *paths)
    return documents.join(gone, "doc_id", "left_anti").select(*documents.columns)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

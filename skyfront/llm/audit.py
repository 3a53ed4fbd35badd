"""Filter interaction audit: what five quality filters remove, alone, together and in every order.

A document's failures are a mask of five bits; whatever is asked of an order of filters depends
on the masks alone, so texts are read once, and the orders are counted over at most 32 masks a part.

Exact duplicates (filter E) are found by partition refinement:

1. documents are split by their number of code points;
2. classes are split by the hash of one block of the text after another (the blocks' ends are
   ``BLOCKS``), and after each split the classes of a single document are dropped;
3. the full texts of what survives are compared, and every document with a text whose least id
   is smaller than its own is marked. Hashes only spare work: should two texts of a class differ,
   its documents are marked by their texts.

Block hashes are taken in the one scan that measures the texts, as a second scan would cost more
than hashing; the rounds then work on a few numbers for each document. Only texts of surviving
classes are shuffled, combined on the map side, so a text that a third of all rows share costs one
row for each task.

Defined results: a null text is empty, a null part the empty string. A null doc_id is neither
smaller nor larger than another, so its rows never fail E nor make others fail it; rows that share
a doc_id are documents of their own, and not copies of one another. A document is good (toxic) if
one of its label rows says 1. Other columns are left out. No documents, no rows.
"""

from __future__ import annotations

from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, dropped, mapped, written

#: Fixed value: the filters, in the order of their bits.
FILTERS = "ABCDE"
#: Fixed value: characters that fail filter D.
MARKS = b"#$%&*|"
UPPER = bytes(range(0x41, 0x5B))
#: Code points at which hashed blocks end; the last block is what lies beyond.
BLOCKS = (64, 1024, 16384)
#: Surviving classes (8 bytes each) that may be broadcast; more of them are joined by a shuffle.
BROADCAST = 1_000_000
#: Words that are held at once while a text's distinct ones are counted.
STEP = 200_000


def _hash(*columns: Column | str) -> Column:
    return F.xxhash64(*columns)


def words(text: bytes) -> tuple[int, int]:
    """Number of words and of distinct ones. ``bytes.split`` splits at 0x20 and 0x09 to 0x0D."""
    n, seen = 0, set()
    while text:
        part = text.split(None, STEP)
        text = part.pop() if len(part) > STEP else b""
        n += len(part)
        seen.update(part)
    return n, len(seen)


def failures(text: bytes, n_chars: int) -> int:
    """The mask of filters A to D."""
    n, distinct = words(text)
    upper = len(text) - len(text.translate(None, UPPER))
    return (n < 100) + 2 * (100 * distinct < 80 * n) + 4 * (100 * upper > 10 * n_chars) + 8 * (len(text.translate(None, MARKS)) < len(text))


def _rows(documents: DataFrame, part: str) -> DataFrame:
    """doc_id, part, text, n_chars and the hashes of the text's blocks."""
    plain = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ends = [0, *BLOCKS, (1 << 31) - 1]
    blocks = F.array(*(_hash(F.substring("text", a + 1, b - a)) for a, b in zip(ends[:-1], ends[1:], strict=True)))
    return plain.select("*", F.length("text").alias("n_chars"), blocks.alias("blocks"))


def _class(blocks: int) -> Column:
    """A document's class after the split by length and ``blocks`` splits by blocks."""
    out = _hash(F.col("n_chars"))
    for k in range(blocks):
        out = _hash(out, F.get("blocks", F.lit(k)))
    return out


def _measured(rows: DataFrame, *also: str) -> DataFrame:
    """``rows`` with ``fails`` in place of the text, and the columns ``also``."""
    kinds = {"text": "string", "class": "bigint"}
    kept = ["doc_id", "part", "n_chars", "blocks", *also]

    def run(batch: pa.RecordBatch) -> dict:
        masks = [failures(t, n) for t, n in zip(as_bytes(batch.column("text")), batch.column("n_chars").to_pylist(), strict=True)]
        return {"fails": pa.array(masks, pa.int32()), **{c: batch.column(c) for c in kept}}

    more = "".join(f", {c} {kinds[c]}" for c in also)
    return mapped(rows, f"doc_id bigint, part string, n_chars int, blocks array<bigint>{more}, fails int", run)


def _repeated_classes(measured: DataFrame) -> tuple[DataFrame, list[str]]:
    """The classes (column ``class``) of two documents or more after all splits, and scratch paths."""
    alive, path, paths = measured.where("doc_id IS NOT NULL").select("n_chars", "blocks"), None, []
    for k in range(len(BLOCKS) + 2):
        alive = alive.withColumn("class", _class(k))
        many, path_many = written(alive.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("class"), "classes")
        if k > len(BLOCKS):
            return many, [*([path] if path else []), path_many]
        # both sides are read anew, so that a class of very many documents is split
        alive, new = written(alive.join(many, "class", "left_semi").drop("class"), "alive")
        dropped(measured.sparkSession, path_many, *([path] if path else []))
        path = new
    raise AssertionError


def _of_classes(rows: DataFrame, classes: DataFrame, broadcast: int) -> DataFrame:
    """``rows`` with their full class, those of ``classes`` only; texts move if there are very many of these."""
    few = classes.limit(broadcast + 1).count() <= broadcast
    return rows.withColumn("class", _class(len(BLOCKS) + 1)).join(F.broadcast(classes) if few else classes, "class")


def marked(documents: DataFrame, part: str = "lang", broadcast: int = BROADCAST) -> DataFrame:
    """doc_id, part and ``fails`` (the mask of all five filters), a row for each document."""
    rows = _rows(documents, part)
    measured, path = written(_measured(rows), "measured")
    classes, paths = _repeated_classes(measured)
    texts = _of_classes(rows.where("doc_id IS NOT NULL"), classes, broadcast).groupBy("class", "text").agg(F.min("doc_id").alias("least"))
    found, path_found = written(texts.groupBy("class").agg(F.count(F.lit(1)).alias("texts"), F.min("least").alias("least")), "least")
    dropped(documents.sparkSession, *paths)
    fails = F.when(F.col("doc_id") > F.col("least"), F.col("fails") + 16).otherwise(F.col("fails")).alias("fails")
    known = measured.withColumn("class", _class(len(BLOCKS) + 1)).join(found, "class", "left")
    out = known.where("texts IS NULL OR texts = 1").select("doc_id", "part", fails)
    mixed = found.where("texts > 1").select("class")
    if mixed.limit(1).count():  # different texts of equal hashes: by the texts themselves
        own = _of_classes(rows, mixed, broadcast)
        least = own.groupBy("class", "text").agg(F.min("doc_id").alias("least"))
        out = out.unionByName(_measured(own, "class", "text").join(least, ["class", "text"]).select("doc_id", "part", fails))
    return out


def tallied(fails: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails, n, good, toxic: at most 32 rows for each part."""
    one = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    return fails.join(said, "doc_id", "left").groupBy("part", "fails").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def steps() -> list[tuple[str, int, int, int]]:
    """filter_order, step, the step's bit, and the bits before it, of all orders."""
    out = []
    for order in permutations(range(len(FILTERS))):
        name = "".join(FILTERS[f] for f in order)
        out += [(name, k + 1, 1 << f, sum(1 << x for x in order[:k])) for k, f in enumerate(order)]
    return out


def audit(documents: DataFrame, labels: DataFrame, part: str = "lang", broadcast: int = BROADCAST) -> DataFrame:
    """Part, filter order and step with the counts that the module's text describes."""
    table = steps()

    def counts(pdf):
        import numpy as np
        import pandas as pd

        mask, n, good, toxic = (pdf[c].to_numpy(np.int64) for c in ("fails", "n", "good", "toxic"))
        out = []
        for name, step, bit, before in table:
            fails, earlier = mask & bit != 0, mask & before != 0
            gone = fails & ~earlier
            out.append((pdf["part"].iat[0], name, step, n[~fails & ~earlier].sum(), n[gone].sum(), n[fails & earlier].sum(), n[mask == bit].sum(), good[gone].sum(), toxic[gone].sum()))
        out = pd.DataFrame(out, columns=["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"])
        letter = [name[step - 1] for name, step, _, _ in table]
        return out.assign(shapley=out["removed"].groupby(letter).transform("sum").to_numpy())

    tally = tallied(marked(documents, part, broadcast), labels)
    return tally.groupBy("part").applyInPandas(counts, "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint")


ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
m AS (SELECT doc_id, part, CAST(len(ws) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 80 * len(ws) AS INT)
    + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
    + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INT) AS fails FROM w),
l AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INT)) AS good, max(CAST(coalesce(toxic = 1, false) AS INT)) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l ON m.doc_id = l.doc_id GROUP BY part, fails),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
p AS (SELECT v.letter || w.letter || x.letter || y.letter || z.letter AS filter_order, [v.bit, w.bit, x.bit, y.bit, z.bit] AS bits FROM f v, f w, f x, f y, f z WHERE v.bit + w.bit + x.bit + y.bit + z.bit = 31 AND len(list_distinct([v.bit, w.bit, x.bit, y.bit, z.bit])) = 5),
s AS (SELECT filter_order, CAST(i AS INT) AS step, bits[i] AS bit, coalesce(list_sum(bits[1:i - 1]), 0)::INT AS before FROM p, range(1, 6) r(i)),
o AS (SELECT part, filter_order, step, any_value(bit) AS bit,
    sum(CASE WHEN fails & (bit | before) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails & bit <> 0 AND fails & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails & bit <> 0 AND fails & before <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails & bit <> 0 AND fails & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails & bit <> 0 AND fails & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM c, s GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
    good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM o
"""

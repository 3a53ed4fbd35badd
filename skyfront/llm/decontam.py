"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows.

Normalisation keeps bytes in place (lower-case A-Z, every ASCII byte that is no letter or
digit becomes a space), so offsets map back to the original text. Each item's words make
windows of ``window`` consecutive words (an item of fewer words, but not none, is one
window). All windows go into one automaton, whose symbols are words: numbers of the
benchmark's words, and 0 for any other. Each text runs through it once.

A worker process builds the automaton once, from the broadcast item texts, and keeps it from task
to task. Items are broadcast only up to ``max_broadcast`` bytes (about 150 bytes of automaton for
each): a larger benchmark is split by item into blocks of that size. Texts are then numbered and
written once; one block after another is collected, broadcast and let go, and passes over them; it
leaves the numbers of the texts that it hits, with places and items, which meet the texts at last.

Defined results: a null text has no words and no hits; items with null or word-less text
never occur; repeated items and repeated rows count each; an item with a null id marks
words but is not listed; an empty benchmark hits nothing; other columns of the documents
are left out.
"""

from __future__ import annotations

import hashlib
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, written

WINDOW = 10
MAX_BROADCAST = 2 << 20

_UPPER = range(0x41, 0x5B)
_KEPT = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: Byte to byte, so that offsets stay.
NORMAL = bytes(b + 32 if b in _UPPER else b if b in _KEPT else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def windows_of(words: list, window: int) -> list[tuple]:
    if not words:
        return []
    return [tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


class Numbers(dict):
    """Numbers of words from 1; 0 for a word that is not there."""

    def __missing__(self, word: bytes) -> int:
        return 0


class Machine:
    """The automaton of ``items(id, text)``; each window has its items."""

    def __init__(self, items: list[tuple[object, str]], window: int):
        self.numbers, owners = Numbers(), {}
        for item, text in items:
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of((text or "").encode())]
            for w in windows_of(words, window):
                owners.setdefault(w, set()).add(item)
        self.found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE) if owners else None
        for w, of in owners.items():
            self.found.add_word(w, (len(w), tuple(of)))
        if owners:
            self.found.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set]:
        """Number of words, hit word ranges (first, end) and the items that occur."""
        words = words_of(text)
        if self.found is None or not words:
            return len(words), [], set()
        found, items = [], set()
        for last, (n, of) in self.found.iter(tuple(map(self.numbers.__getitem__, words))):
            found.append((last + 1 - n, last + 1))
            items.update(of)
        return len(words), merged(found), items


#: The worker process's one automaton, by the name of its block of items.
_MACHINES: dict[str, Machine] = {}


def machine_of(name: str, sent, window: int) -> Machine:
    if name not in _MACHINES:
        _MACHINES.clear()
        _MACHINES[name] = Machine(sent.value, window)
    return _MACHINES[name]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def original_spans(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as code-point offsets (start, end) in the original text."""
    if not ranges:
        return []
    inside = np.frombuffer(text.translate(NORMAL), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    begin, end = edge[::2], edge[1::2]
    points = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return [(int(points[begin[a]]), int(points[end[b - 1]])) for a, b in ranges]


_PAIR = "array<struct<first:int,end:int>>"
_PAIRS = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))


def _items(benchmark: DataFrame, max_broadcast: int) -> tuple[DataFrame, int]:
    """Items as text, and the number of blocks that they make."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return items, max(1, -(-int(total) // max_broadcast))


def _sent(items: DataFrame, window: int) -> tuple:
    """What :func:`machine_of` takes."""
    return uuid.uuid4().hex, items.sparkSession.sparkContext.broadcast([(r.item_id, r.text) for r in items.toLocalIterator()]), window


def _numbered(documents: DataFrame, number: str) -> DataFrame:
    return written(documents.withColumn(number, F.monotonically_increasing_id()), "numbered")[0]


def _block_hits(rows: DataFrame, number: str, items: DataFrame, blocks: int, window: int) -> DataFrame:
    """(row, words, items): each block's hits in each row, of rows with some; only one block is out at a time."""
    names, out = ["row", "words", "items"], None

    def pairs(ranges):
        return [{"first": a, "end": b} for a, b in ranges]

    for k in range(blocks):
        sent = _sent(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k), window)

        def run(batches, sent=sent):
            for batch in batches:
                found = [(row, *machine_of(*sent).scan(t)[1:]) for row, t in zip(batch.column("row").to_pylist(), as_bytes(batch.column("text")), strict=True)]
                found = [x for x in found if x[1]]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([pairs(x[1]) for x in found], _PAIRS), pa.array([sorted(x[2] - {None}) for x in found], pa.list_(pa.string()))], names)

        hit, _ = written(rows.select(F.col(number).alias("row"), "text").mapInArrow(run, f"row bigint, words {_PAIR}, items array<string>"), "block-hits")
        sent[1].destroy()
        out = hit if out is None else out.unionByName(hit)
    return out


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_broadcast: int = MAX_BROADCAST, texts: bool = True) -> DataFrame:
    """Per row of ``documents(doc_id, text)``: doc_id, text (unless ``texts`` is false), n_words,
    hit_words (merged word ranges), hit_spans (the same as code points of the original text), item_ids."""
    kept = ["doc_id", *(["text"] if texts else [])]
    names = [*kept, "n_words", "hit_words", "hit_spans", "item_ids"]
    schema = f"doc_id bigint, {'text string, ' if texts else ''}n_words bigint, hit_words {_PAIR}, hit_spans {_PAIR}, item_ids array<string>"
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def result(batch, found):
        """``found``: for each row the number of words, hit ranges and items."""
        pairs = lambda ranges: [{"first": a, "end": b} for a, b in ranges]
        spans = [original_spans(t, x[1]) for t, x in zip(as_bytes(batch.column("text")), found, strict=True)]
        columns = (pa.array([x[0] for x in found], pa.int64()), pa.array([pairs(x[1]) for x in found], _PAIRS), pa.array([pairs(x) for x in spans], _PAIRS), pa.array([sorted(x[2]) for x in found], pa.list_(pa.string())))
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *columns], names)

    items, blocks = _items(benchmark, max_broadcast)
    if blocks == 1:
        sent = _sent(items, window)

        def run(batches):
            for batch in batches:
                machine = machine_of(*sent)
                found = [machine.scan(t) for t in as_bytes(batch.column("text"))]
                yield result(batch, [(n, ranges, of - {None}) for n, ranges, of in found])

        return docs.mapInArrow(run, schema)

    def meet(batches):
        for batch in batches:
            hit = zip(as_bytes(batch.column("text")), batch.column("words").to_pylist(), batch.column("items").to_pylist(), strict=True)
            yield result(batch, [(len(words_of(t)), merged([(x["first"], x["end"]) for x in words or []]), {*(of or [])}) for t, words, of in hit])

    rows = _numbered(docs, "row")
    each = _block_hits(rows, "row", items, blocks, window).groupBy("row").agg(F.flatten(F.collect_list("words")).alias("words"), F.flatten(F.collect_list("items")).alias("items"))
    return rows.join(each, "row", "left").select("doc_id", "text", "words", "items").mapInArrow(meet, schema)


def uncontaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``documents`` without the rows that hold a window of the benchmark; all columns are kept."""
    items, blocks = _items(benchmark, max_broadcast)
    if blocks == 1:
        sent = _sent(items, window)

        def run(batches):
            for batch in batches:
                machine = machine_of(*sent)
                yield batch.filter(pa.array([not machine.scan(t)[1] for t in as_bytes(batch.column("text"))], pa.bool_()))

        return documents.mapInArrow(run, documents.schema)
    number = f"_row_{uuid.uuid4().hex}"
    rows = _numbered(documents, number)
    hit = _block_hits(rows.withColumn("text", F.col("text").cast("string")), number, items, blocks, window).select(F.col("row").alias(number)).distinct()
    return rows.join(hit, number, "left_anti").drop(number)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from what :func:`decontaminate` returns."""
    n_hit = F.aggregate("hit_words", F.lit(0).cast("bigint"), lambda n, x: n + (x["end"] - x["first"]).cast("bigint"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

#: The same over DuckDB's views; windows that several items share mark words once.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+'), []) AS w FROM documents),
b AS (SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+'), []) AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i + 1, i + n), ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i + 1, i + n), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT DISTINCT doc_id, i, n FROM dw JOIN (SELECT DISTINCT n, g FROM bw) USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM dw JOIN bw USING (n, g)) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

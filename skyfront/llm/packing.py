"""Best-fit packing by patterns fitted with non-negative least squares.

Texts become token ids and one end id 0; only longer ones are cut, the first piece taking
the remainder so that all others fill a sequence. Packing then needs only the histogram of
piece lengths, which has at most ``size`` entries whatever the corpus:

1. enumerate patterns of two to four lengths that fill a sequence exactly;
2. fit how often to repeat each, by non-negative least squares against the histogram
   (cyclic coordinate descent), and round down to what the histogram allows;
3. pack what is left by best fit decreasing, run on counts of equal lengths and equal bins;
4. number the pieces of each length, and look up their sequence and offset in the plan.

The plan has a bounded number of entries (``max_patterns`` plus a few per length), so it is
safe to broadcast; pieces are numbered in salted groups, so a length that a third of all
rows share is spread over many tasks. Tokens never leave the workers, only their length
and checksum do.

Defined results: a null or empty text is the end id alone; rows with a null doc_id and
repeated rows are packed like any other; other columns are left out.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

SIZE = 2048
END = 0
MAX_PATTERNS = 3000
#: Words in each of a memo's two generations, and the longest word that it holds: bounds its bytes.
MEMO, MEMO_WORD = 200_000, 64

#: Fixed value: the printable characters that stand for a byte-level vocabulary's bytes, in order of bytes.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_UNPRINTABLE = sorted(set(range(256)) - set(_PRINTABLE))
_BYTE_CHARS = {**{b: chr(b) for b in _PRINTABLE}, **{b: chr(256 + i) for i, b in enumerate(_UNPRINTABLE)}}


class Memo(dict):
    """Token ids of words, packed. When a generation is full, it becomes the older one, and the
    one before it goes; words that are still met move on to the new one."""

    def __init__(self, model, room: int = MEMO):
        self.model, self.room, self.older = model, room, {}

    def __missing__(self, word: str) -> bytes:
        out = self.older.get(word)
        if out is None:
            seen = word.replace(" ", _BYTE_CHARS[0x20]) if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(_BYTE_CHARS)
            ids = [t.id for t in self.model.tokenize(seen)]
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= MEMO_WORD:
            if len(self) >= self.room:
                self.older = dict(self)
                self.clear()
            self[word] = out
        return out


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes, word for word with a bounded memo.

    Equal to ``Tokenizer.encode(text, add_special_tokens=False)``: a byte-level vocabulary's
    pre-tokeniser splits a text into words that its model merges one by one, so a word can be
    looked up. Texts of plain Latin letters are split by :mod:`re`; any other text, one
    with a special token's string, and every text of another kind of vocabulary goes through
    the tokenizer as a whole.
    """

    #: Fixed value: the byte-level pattern, for letters A-Z, a-z and Latin-1 only.
    _SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+")
    _OTHER = re.compile(r"[^\t\n\x0b\x0c\r\x20-\x7eÀ-ÖØ-öø-ÿ]")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        made = json.loads(Path(path).read_text(encoding="utf-8"))
        split = made["pre_tokenizer"] or {}
        self.by_word = not made["normalizer"] and split.get("type") == "ByteLevel" and not split["add_prefix_space"] and split.get("use_regex", True)
        self.memo = Memo(self.tokenizer.model)

    def __call__(self, text: str) -> bytes:
        if not self.by_word or self._OTHER.search(text) or any(s in text for s in self.special):
            ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.memo.__getitem__, self._SPLIT.findall(text)))


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The worker process's one encoder: kept from task to task, with its memo."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces_of(ids: bytes, size: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of one text's ids and its end id."""
    ids += struct.pack("<I", END)
    n = len(ids) // 4
    cuts = [0, *range((n - 1) % size + 1, n + 1, size)]
    return [(k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]


def pieces(documents: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """``documents(doc_id, text)`` to doc_id, piece, start, length, ids_crc32."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        encoder = encoder_of(tokenizer)
        for batch in batches:
            out, ids = [], batch.column("doc_id").to_pylist()
            for doc_id, text in zip(ids, batch.column("text"), strict=True):
                out += [(doc_id, *p) for p in pieces_of(encoder(text.as_py() or ""), size)]
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names)

    plain = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def patterns(histogram: dict[int, int], size: int, most: int) -> list[tuple[int, ...]]:
    """Multisets of 2 to 4 lengths that add up to ``size``, those with the most pieces first."""
    n = np.zeros(size + 1, np.int64)
    for length, count in histogram.items():
        n[length] = count
    out: list[tuple[int, tuple[int, ...]]] = []
    common = np.argsort(-n[:size], kind="stable")
    for parts, width in ((1, size), (2, min(size, 600)), (3, 64)):
        pool = np.sort(common[:width][n[common[:width]] > 0])
        grids = [g.ravel() for g in np.meshgrid(*[pool] * parts, indexing="ij")] if len(pool) else []
        if not grids:
            continue
        rest = size - sum(grids)
        ok = rest >= grids[-1]
        for x, y in zip(grids[:-1], grids[1:], strict=True):
            ok &= x <= y
        ok[ok] &= n[rest[ok]] > 0
        rows = np.stack([*(g[ok] for g in grids), rest[ok]], axis=1)
        score = n[rows].min(axis=1)
        for k in np.argsort(-score, kind="stable")[:most].tolist():
            out.append((int(score[k]), tuple(map(int, rows[k]))))
    out.sort(key=lambda x: (-x[0], x[1]))
    return [p for _, p in out[:most]]


def fitted(histogram: dict[int, int], found: list[tuple[int, ...]], sweeps: int = 40) -> list[float]:
    """Non-negative least squares: how often to repeat each pattern, so that the lengths they
    use come to the histogram. Cyclic coordinate descent with projection."""
    residual = defaultdict(float, {k: float(v) for k, v in histogram.items()})
    uses = [[(length, p.count(length)) for length in sorted(set(p))] for p in found]
    norm = [sum(m * m for _, m in u) for u in uses]
    x = [0.0] * len(found)
    for _ in range(sweeps):
        moved = 0.0
        for j, u in enumerate(uses):
            step = max(-x[j], sum(m * residual[length] for length, m in u) / norm[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for length, m in u:
                    residual[length] -= m * step
        if moved < 0.05:
            break
    return x


def best_fit(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing on counts: (lengths, number of bins packed like that)."""
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by free space

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            free = next((f for f in range(length, size) if bins.get(f)), size)
            have, count = bins[free].pop() if free < size else ((), left)
            fit = free // length
            full = min(count, left // fit)
            if full:
                bins[free - fit * length].append((have + (length,) * fit, full))
                left -= full * fit
            elif left:
                bins[free - left * length].append((have + (length,) * left, 1))
                full, left = 1, 0
            if free < size and count > full:
                bins[free].append((have, count - full))
    return [x for f in sorted(bins) for x in bins[f] if x[0]]


def plan(histogram: dict[int, int], size: int = SIZE, most: int = MAX_PATTERNS) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how many sequences follow each; uses every piece of the histogram once."""
    left = dict(histogram)
    out = []
    if left.get(size):
        out.append(((size,), left.pop(size)))
    found = patterns(left, size, most)
    order = sorted(zip(fitted(left, found), found, strict=True), key=lambda x: (-x[0], x[1]))
    for times, p in order:
        k = min(int(times), *(left[length] // p.count(length) for length in set(p)))
        if k > 0:
            out.append((p, k))
            for length in p:
                left[length] -= k
    return out + best_fit({k: v for k, v in left.items() if v}, size)


def places(planned: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, sequence of that rank, and offset, for ranges of ranks."""
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for p, k in planned:
        at = 0
        for length in p:
            out[length].append((used[length], sequence, at))
            used[length] += k
            at += length
        sequence += k
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in out.items()}


def pack(documents: DataFrame, tokenizer: str, size: int = SIZE, most: int = MAX_PATTERNS) -> DataFrame:
    """Pieces with sequence_id and offset; see the module's text."""
    spark = documents.sparkSession
    cut, _ = written(pieces(documents, tokenizer, size), "pieces")
    salts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    counts, _ = written(salted.groupBy("length", "_salt").count(), "lengths")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    sent = spark.sparkContext.broadcast(places(plan(histogram, size, most)))
    before = counts.select("length", "_salt", (F.sum("count").over(W.partitionBy("length").orderBy("_salt")) - F.col("count")).alias("_before"))
    rank = F.row_number().over(W.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("_rank", rank.cast("bigint")).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before") - 1)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def place(batches):
        at = sent.value
        for batch in batches:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "_rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            values, first = np.unique(length[order], return_index=True)
            for v, rows in zip(values.tolist(), np.split(order, first[1:]), strict=True):
                low, base, off = at[v]
                k = np.searchsorted(low, rank[rows], "right") - 1
                sequence[rows], offset[rows] = base[k] + rank[rows] - low[k], off[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names[:5]), pa.array(sequence), pa.array(offset)], names)

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank").mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")

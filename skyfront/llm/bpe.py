"""Encoding and decoding with a byte-pair vocabulary; long texts by tree concatenation.

A text of more than ``leaf`` code points is halved until its parts are no longer than that. The
parts are rows of their own, dealt over all tasks and encoded there. They meet again by text, and
neighbours are joined, in rounds of a tree. At a join both sides are wrong near the cut and right
away from it; so a window around the cut is encoded, and grows until it agrees with the left side
before the cut and with the right side after it. Then the left tokens up to the agreement, the
window's between the two, and the right ones from there on are the tokens of both together.

Why one token that agrees on each side is enough:

* Within a word, tokens are those of the merges if and only if every two neighbours are what the
  merges make of them. All neighbours in the joined list stand next to each other in a list that
  the merges made: the left one, the window's or the right one.
* Words and added tokens are found from left to right, with no look behind and a look ahead of less
  than ``MARGIN`` characters. Two scans that both are inside a run of letters (or of other marks)
  end it at the same place, and from there on are the same. Agreement counts ``MARGIN`` away
  from the cut and from the window's ends only.
* Normal forms don't reach over a character that composes with nothing before it (:func:`firm`), and
  only tokens between two such characters count. A window that never agrees grows until it is the
  whole of both sides.

Defined results: a null or empty text has no tokens and decodes to the empty string; repeated rows and
rows with a null doc_id are encoded like any other; other columns are left out.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import unicodedata
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .packing import _BYTE_CHARS

#: Code points of a part at most; a text of no more is encoded where it is.
LEAF = 1 << 14
#: Code points on each side of a cut that a window starts with.
WINDOW = 256
#: Code points next to a cut or a window's end where agreement doesn't count: more than an added token
#: or a contraction has.
MARGIN = 32
#: Words in each of a memo's two generations, and the longest that it holds: bounds its bytes.
MEMO, MEMO_WORD = 200_000, 48
#: White space that no token holds and at which all scans start anew.
_BLANK = re.compile("[ \t\n\r]+")
_UNBROKEN = re.compile("[^ \t\n\r]+")
#: Characters that have no normal form but themselves and one lower-case letter at most. In texts of
#: these alone, words are found in Python (the pattern is the vocabulary's own, a fixed value).
_OTHER = re.compile("[^\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]|<\\|")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+")

#: Fixed value: the split of a vocabulary to which _PIECES belongs.
_SPLIT = '{"Regex": "\'s|\'t|\'re|\'ve|\'m|\'ll|\'d|[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+"}'


class Memo(dict):
    """What ``make`` gives for a word. When a generation is full it becomes the older one, and the
    one before it goes; words that are still met move on to the new one."""

    def __init__(self, make: Callable, room: int = MEMO, longest: int = MEMO_WORD):
        self.make, self.room, self.longest, self.older = make, room, longest, {}

    def __missing__(self, word):
        out = self.older.get(word)
        if out is None:
            out = self.make(word)
        if len(word) <= self.longest:
            if len(self) >= self.room:
                self.older = dict(self)
                self.clear()
            self[word] = out
        return out


@dataclass
class Tokens:
    """Ids of a stretch of a text, with the code points where each token starts and ends."""

    start: int
    end: int
    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def packed(self) -> bytes:
        """Small: starts as gaps, ends as lengths."""
        rows = (self.ids, np.diff(self.starts, prepend=self.start), self.ends - self.starts)
        return zlib.compress(np.stack(rows).astype("<i4").tobytes(), 1)

    @classmethod
    def unpacked(cls, packed: bytes, start: int, end: int) -> Tokens:
        ids, gaps, lengths = np.frombuffer(zlib.decompress(packed), "<i4").reshape(3, -1).astype(np.int64)
        starts = np.cumsum(gaps) + start
        return cls(start, end, ids, starts, starts + lengths)


class Encoder:
    """The tokenizer of a file, without truncation, padding or special tokens added."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
        from tokenizers import Tokenizer

        made = json.loads(Path(path).read_text(encoding="utf-8"))
        if made["model"]["type"] != "BPE" or '"Removed"' not in json.dumps(made["pre_tokenizer"]) or made["decoder"]:
            raise ValueError("a vocabulary of merges is needed, whose words leave out white space, without a decoder")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.names = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())]
        split = json.dumps(made["pre_tokenizer"]["pretokenizers"][0]["pattern"], ensure_ascii=False) if made["pre_tokenizer"]["type"] == "Sequence" else ""
        self.by_pieces = split == _SPLIT and [x["type"] for x in (made["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self.pieces, self.words = Memo(self._piece), Memo(self._word)
        self.piece_spans, self.word_spans = Memo(self._spans, MEMO // 2), Memo(self._spans, MEMO // 2)

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def decoded(self, ids) -> str:
        return " ".join(map(self.names.__getitem__, ids))

    def _packed(self, ids: list[int]) -> tuple[bytes, str]:
        return struct.pack(f"<{len(ids)}i", *ids), self.decoded(ids)

    def _piece(self, piece: str) -> tuple[bytes, str]:
        """One piece of _PIECES, which the vocabulary's model merges on its own."""
        return self._packed([t.id for t in self.model.tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTE_CHARS))])

    def _word(self, word: str) -> tuple[bytes, str]:
        return self._packed(self.ids(word) if word else [])

    def _spans(self, word: str) -> tuple[bytes, bytes]:
        made = self.tokenizer.encode(word, add_special_tokens=False)
        return np.array(made.ids, "<i4").tobytes(), np.array(made.offsets, "<i4").tobytes()

    def _is_plain(self, text: str) -> bool:
        return self.by_pieces and not _OTHER.search(text)

    def plain(self, text: str) -> tuple[bytes, str]:
        """Ids (four bytes each) and decoded text of a text that is encoded in one go, word by word."""
        if self._is_plain(text):
            found = list(map(self.pieces.__getitem__, _PIECES.findall(text.lower())))
        else:
            found = [x for x in map(self.words.__getitem__, _BLANK.split(text)) if x[0]]
        return b"".join([x[0] for x in found]), " ".join([x[1] for x in found])

    def spans(self, text: str, start: int = 0) -> Tokens:
        """The tokens of a stretch that stands at ``start``, as if it were a text of its own."""
        # a lower-case letter of these texts is one character, as the letter was
        words = _PIECES.finditer(text.lower()) if self._is_plain(text) else _UNBROKEN.finditer(text)
        memo = self.piece_spans if self._is_plain(text) else self.word_spans
        at, found = [], []
        for w in words:
            at.append(w.start())
            found.append(memo[w[0]])
        ids = np.frombuffer(b"".join([x[0] for x in found]), "<i4").astype(np.int64)
        ends = np.frombuffer(b"".join([x[1] for x in found]), "<i4").reshape(-1, 2) + np.repeat(np.array(at, np.int64) + start, [len(x[0]) // 4 for x in found])[:, None]
        return Tokens(start, start + len(text), ids, ends[:, 0], ends[:, 1])


@cache
def _composing() -> frozenset[str]:
    """Characters that normal forms may compose with one before them, by the data base's pairs."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(sys.maxunicode + 1))
    return frozenset(chr(int(p[1], 16)) for p in pairs if len(p) == 2 and p[0][0] != "<") | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}


def firm(char: str) -> bool:
    """Whether what stands before this character has no part in its normal form."""
    return char < "\u0300" or not unicodedata.combining(char) and char not in _composing()


def _agreed(tokens: Tokens, low: int, high: int, text: str) -> dict[tuple[int, int, int], int]:
    """(start, end, id) to place of the tokens within [low, high] that agreement may rest on."""
    out = {}
    for i in range(int(np.searchsorted(tokens.starts, low)), len(tokens.ids)):
        a, b = int(tokens.starts[i]), int(tokens.ends[i])
        if a > high:
            break
        apart = (not i or tokens.ends[i - 1] <= a) and (i + 1 == len(tokens.ids) or tokens.starts[i + 1] >= b)
        if a < b <= high and apart and firm(text[a]) and (b == len(text) or firm(text[b])):
            out[a, b, int(tokens.ids[i])] = i
    return out


def join(text: str, left: Tokens, right: Tokens, spans: Callable[[str, int], Tokens], window: int = WINDOW, margin: int = MARGIN) -> Tokens:
    """The tokens of two neighbouring stretches as one."""
    cut = left.end
    while True:
        s, e = max(left.start, cut - window), min(right.end, cut + window)
        middle = spans(text[s:e], s)
        before, after = (0, 0), (len(right.ids), len(middle.ids))
        if s > left.start:
            mine, theirs = (_agreed(t, s + margin, cut - margin, text) for t in (left, middle))
            shared = max(mine.keys() & theirs.keys(), default=None)
            before = (mine[shared] + 1, theirs[shared] + 1) if shared else None
        if e < right.end:
            mine, theirs = (_agreed(t, cut + margin, e - margin, text) for t in (right, middle))
            shared = min(mine.keys() & theirs.keys(), default=None)
            after = (mine[shared], theirs[shared]) if shared else None
        if before and after:
            parts = [(getattr(left, n)[: before[0]], getattr(middle, n)[before[1] : after[1]], getattr(right, n)[after[0] :]) for n in ("ids", "starts", "ends")]
            return Tokens(left.start, right.end, *map(np.concatenate, parts))
        window *= 4


def tree(text: str, leaves: list[Tokens], spans: Callable[[str, int], Tokens], **how) -> Tokens:
    """All leaves of a text, joined two by two in rounds."""
    while len(leaves) > 1:
        leaves = [join(text, *leaves[k : k + 2], spans, **how) if k + 1 < len(leaves) else leaves[k] for k in range(0, len(leaves), 2)]
    return leaves[0]


def halves(n: int, leaf: int) -> list[int]:
    """Where the parts of a text of ``n`` code points start, and its end: halved until none is over ``leaf``."""
    parts = 1
    while -(-n // parts) > leaf:
        parts *= 2
    return [n * k // parts for k in range(parts + 1)]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """The worker process's own, kept from task to task with its memo."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _result(doc_ids: pa.Array, ids: list[bytes], decoded: list[str]) -> pa.RecordBatch:
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
    values = pa.array(np.frombuffer(b"".join(ids), "<i4").astype(np.int32))
    return pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])


_SCHEMA = "doc_id bigint, ids array<int>, decoded string"


def encoded(documents: DataFrame, tokenizer: str, leaf: int = LEAF, window: int = WINDOW) -> DataFrame:
    """doc_id, ids and the text that the ids decode to, a row for each row of ``documents(doc_id, text)``."""
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def whole(batches):
        encoder = _encoder(tokenizer)
        for batch in batches:
            found = [encoder.plain(t.as_py()) for t in batch.column("text")]
            yield _result(batch.column("doc_id"), [x[0] for x in found], [x[1] for x in found])

    def parted(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                cuts = halves(len(text), leaf)
                n = len(cuts) - 1
                row += 1
                yield pa.RecordBatch.from_arrays([pa.array([row] * n), pa.array([doc_id] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(cuts[:-1]), pa.array([text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])], ["row", "doc_id", "part", "start", "text"])

    def leaves(batches):
        encoder = _encoder(tokenizer)
        for batch in batches:
            tokens = [encoder.spans(t.as_py(), a).packed() for t, a in zip(batch.column("text"), batch.column("start").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens, pa.binary())], [*batch.schema.names, "tokens"])

    def joined(table: pa.Table) -> pa.Table:
        encoder, order = _encoder(tokenizer), table.sort_by("part")
        texts, starts = order.column("text").to_pylist(), order.column("start").to_pylist()
        parts = [Tokens.unpacked(p, a, a + len(t)) for p, a, t in zip(order.column("tokens").to_pylist(), starts, texts, strict=True)]
        ids = tree("".join(texts), parts, encoder.spans, window=window).ids
        return pa.Table.from_batches([_result(order.column("doc_id").slice(0, 1).combine_chunks(), [ids.astype("<i4").tobytes()], [encoder.decoded(ids.tolist())])])

    # written, so that the numbers of rows hold whatever is run again
    cut, _ = written(rows.where(F.length("text") > leaf).mapInArrow(parted, "row bigint, doc_id bigint, part int, start bigint, text string"), "parts")
    made = cut.repartition("row", "part").mapInArrow(leaves, "row bigint, doc_id bigint, part int, start bigint, text string, tokens binary")
    return rows.where(F.length("text") <= leaf).mapInArrow(whole, _SCHEMA).unionByName(made.groupBy("row").applyInArrow(joined, _SCHEMA))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_tokens and checksums of ids and decoded text."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), sha(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256"))

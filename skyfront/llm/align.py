"""Which tokens of two vocabularies stand for the same bytes, counted over all documents.

Both vocabularies encode a text; the byte offsets at which tokens of both end cut it into groups,
and within a group every token of the one is linked with every token of the other. A pair's count
is the number of documents that hold it linked; a link is a best one if no pair of its first id
counts more.

* Texts are read once. A word (see :class:`Aligner`) is aligned once for each worker and
  remembered. Documents go in parts of some megabytes; a part's links are sorted and leave as one row
  for each stripe: its distinct pairs, how many documents hold each, and which ones, how often.
* Ids of the first side are dealt over ``stripes`` by their remainder. A stripe's counts are a dense
  matrix of its ids by all ids of the other side, into which the parts' counts are added with
  ``np.add.at``; row maxima are the best counts. Its size hangs on the vocabularies only (100 MB by
  128 stripes). Parts are counted before anything moves, so a frequent pair costs a part one number.
* The links of a stripe are dealt to the tasks that hold its matrix, which leave sums for each
  document of a part; these meet the document's own figures by part.
* A stripe with more than ``slice_bytes`` of links or counts (a frequent token's) is dealt over
  as many tasks as that takes: partial matrices are added up, links get a copy of the matrix.

No task holds more than a part, a matrix, and the distinct links of one document.

Defined results: null and empty texts, and those whose bytes a vocabulary doesn't give back, have no tokens
and an empty ``groups_sha256``; every row is a document, those that share a doc_id too, and rows with a
null doc_id; other columns are left out.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Memo
from .common import written
from .packing import _BYTE_CHARS, Encoder
from .packing import Memo as WordIds

STRIPES = 128
#: Bytes of text and rows of a part. Its documents are numbered with 16 bits.
PART_BYTES, PART_ROWS = 8 << 20, 60_000
#: Packed bytes of a stripe that one task gets.
SLICE_BYTES = 128 << 20
#: Words in each of a memo's two generations, and characters of the longest that it holds.
MEMO, LONGEST = 300_000, 48
#: Links of a group from which its distinct ids are multiplied instead: more than a remembered word has.
HEAVY = (4 * LONGEST) ** 2 + 1
#: Words of any text: one starts at a space that doesn't follow white space.
_WORD = re.compile(r" (?:[^ ]+|(?<=\s) )*")
#: Words of texts without _OTHER characters: white space and then letters, digits or marks; short
#: forms take the letters after them along. The classes are a fixed value, the byte-level pattern's.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_UNIT = re.compile(rf"\s*(?:'(?:s|t|re|ve|m|ll|d)[{_LETTERS}]*|[{_LETTERS}]+|[0-9]+|[^\s{_LETTERS}0-9]+)|\s+")
_OTHER = re.compile(rf"[^\t\n\x20-\x7e{_LETTERS}]")

_LINKS = "batch bigint, stripe int, ids_a binary, ids_b binary, n binary, docs binary, times binary, facts binary"


def _packed(x: np.ndarray, kind: str) -> bytes:
    return zstandard.compress(x.astype(kind).tobytes(), 1)


def _unpacked(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), kind).astype(np.int64)


class Aligner:
    """Aligns words. Both encode " " + text: the first as it is, the second puts the space there itself.

    A text is cut where neither vocabulary has a token that reaches over. The first one's words
    begin with a space, are white space alone, or change with the kind of character; the second one can
    only merge across two characters that stand next to each other in one of its pieces, and no piece
    holds its sign for a space after another character, nor two kinds of characters (of those that
    _UNIT tells apart; where a vocabulary has such pieces, _WORD alone is used). So words are encoded
    one by one, and remembered.
    """

    def __init__(self, path_a: str, path_b: str, stripes: int = STRIPES):
        import sentencepiece

        self.a = Encoder(path_a)
        self.a.tokenizer.encode_special_tokens = True  # their strings in a text are plain text
        self.a.memo = WordIds(self.a.tokenizer.model, 1000)  # the aligned words are remembered here
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        # a line feed is no piece: after it a word is encoded as it is within a text
        self.line = self.b.encode("\n")
        lone = [self.b.piece_to_id("▁"), self.b.piece_to_id("<0x0A>")]
        if not self.a.by_word or self.line != lone or any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a byte-level vocabulary and one of pieces that start with their spaces are needed")
        plain = [p for i, p in enumerate(pieces) if not self.b.is_byte(i) and not self.b.is_control(i) and not self.b.is_unknown(i)]
        kind = {c: "white" if c.isspace() else "letter" if c.isalpha() else "digit" if c.isdigit() else "mark" for c in map(chr, range(9, 256)) if not _OTHER.match(c)}
        # white space goes with what follows it, so it may merge with that
        self.by_units = not any(x in kind and y in kind and kind[x] not in ("white", kind[y]) for p in plain for x, y in zip(p[:-1], p[1:], strict=True))
        of_char = {ord(c): b for b, c in _BYTE_CHARS.items()}
        names = self.a.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.bytes_a[i] = bytes(of_char[ord(c)] for c in name) if all(ord(c) in of_char for c in name) else name.encode()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.stripes, self.width = stripes, len(pieces)
        self.height = -(-len(self.bytes_a) // stripes)
        if stripes * self.height * self.width >= 1 << 32:
            raise ValueError("pairs of ids need to fit into 32 bits")
        if {bytes([b]) for b in range(256)} - set(self.bytes_a):
            raise ValueError("the first vocabulary needs a token for every byte")
        # where an id of the first side has its row of counts: stripe by stripe
        self.rows = [(i % stripes * self.height + i // stripes) * self.width for i in range(len(self.bytes_a))]
        self.size_a, self.size_b = (list(map(len, x)) for x in (self.bytes_a, self.bytes_b))
        self.model, self.memo = self.a.tokenizer.model, Memo(self._word, MEMO, LONGEST)
        #: Links of words with very large groups, as (codes, times) of each such group.
        self.heavy: dict[str, list] = {}

    def _ids_a(self, word: str) -> list[int]:
        if (word[1:] if word[0] == " " else word).isalpha():  # one word of the vocabulary's split
            seen = word.replace(" ", _BYTE_CHARS[0x20]) if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_CHARS)
            return [t.id for t in self.model.tokenize(seen)]
        raw = self.a(word)
        return list(struct.unpack(f"<{len(raw) // 4}I", raw))

    def _word(self, word: str) -> tuple[bytes, bytes, str] | None:
        """Numbers of tokens of both sides; links as codes; groups as text. None if the second side's
        bytes aren't the word's (the first side's always are)."""
        a, b = self._ids_a(word), self.b.encode("\n" + word)[2:]
        if b"".join([self.bytes_b[i] for i in b]) != word.encode():
            return None
        rows, size_a, size_b = self.rows, self.size_a, self.size_b
        groups, codes, heavy = [], [], []
        i = j = first_a = first_b = at_a = at_b = 0
        while i < len(a):
            at_a += size_a[a[i]]
            i += 1
            while at_b < at_a:
                at_b += size_b[b[j]]
                j += 1
            if at_a != at_b:
                continue
            if i - first_a == 1 == j - first_b:
                groups.append(f"{a[first_a]}|{b[first_b]}")
                codes.append(rows[a[first_a]] + b[first_b])
            else:
                own_a, own_b = a[first_a:i], b[first_b:j]
                groups.append(",".join(map(str, own_a)) + "|" + ",".join(map(str, own_b)))
                if len(own_a) * len(own_b) < HEAVY:
                    codes += [rows[x] + y for x in own_a for y in own_b]
                else:
                    heavy.append(self._multiplied(own_a, own_b))
            first_a, first_b = i, j
        if heavy:
            self.heavy[word] = heavy
        return struct.pack("<2I", len(a), len(b)), struct.pack(f"<{len(codes)}I", *codes), ";".join(groups)

    def _multiplied(self, own_a: list[int], own_b: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """A group of very many links by its distinct ids."""
        (ua, ca), (ub, cb) = (np.unique(x, return_counts=True) for x in (own_a, own_b))
        first = np.array([self.rows[x] for x in ua.tolist()], np.uint64)
        return (first[:, None] + ub.astype(np.uint64)).ravel(), (ca[:, None] * cb).ravel()

    def words(self, text: str) -> list[str]:
        """The words of " " + text."""
        return (_UNIT if self.by_units and not _OTHER.search(text) else _WORD).findall(" " + text)

    def groups(self, words: list[str]) -> list | None:
        """What :meth:`_word` gives for a text's words; None for a text without tokens."""
        found = list(map(self.memo.__getitem__, words))
        return None if None in found or not found else found

    def part(self, batch: int, doc_ids: list, texts: list) -> Iterator[dict]:
        """A part's rows: one for each stripe, and one with the documents' own figures."""
        numbers, shas, codes, keys, times = [], [], [], [], []
        for k, text in enumerate(texts):
            words = self.words(text) if text else []
            self.heavy.clear()
            found = self.groups(words)
            if found is None:
                numbers.append((0, 0, 0, 0))
                shas.append("")
                codes.append(b"")
                continue
            text = ";".join([x[2] for x in found])
            codes.append(b"".join([x[1] for x in found]))
            links = len(codes[-1]) // 4
            for c, t in (h for w in (words if self.heavy else ()) for h in self.heavy.get(w, ())):
                links += int(t.sum())
                keys.append(c << np.uint64(16) | np.uint64(k))
                times.append(t)
            numbers.append((*np.frombuffer(b"".join([x[0] for x in found]), "<u4").reshape(-1, 2).sum(0, dtype=np.int64), text.count(";") + 1, links))
            shas.append(hashlib.sha256(text.encode()).hexdigest())
        docs = np.repeat(np.arange(len(texts), dtype=np.uint64), [len(c) // 4 for c in codes])
        plain = np.frombuffer(b"".join(codes), "<u4").astype(np.uint64) << np.uint64(16) | docs
        if keys:
            every, weight = np.concatenate([plain, *keys]), np.concatenate([np.ones(len(plain), np.int64), *times])
            order = np.argsort(every, kind="stable")
            every = every[order]
            first = np.flatnonzero(np.diff(every, prepend=~every[:1]))
            often = np.add.reduceat(weight[order], first)
        else:
            every = np.sort(plain)
            first = np.flatnonzero(np.diff(every, prepend=~every[:1])) if len(every) else np.zeros(0, np.int64)
            often = np.diff(first, append=len(every))
        every = every[first]
        code, docs = (every >> np.uint64(16)).astype(np.int64), (every & np.uint64(0xFFFF)).astype(np.int64)
        starts = np.flatnonzero(np.diff(code, prepend=-1))  # of the pairs
        pairs, n = code[starts], np.diff(starts, append=len(code))
        gaps = np.diff(docs, prepend=0)
        gaps[starts] = docs[starts]
        size = self.height * self.width
        edges = np.searchsorted(pairs, np.arange(self.stripes + 1) * size)
        links = np.append(starts, len(code))
        for s in np.flatnonzero(np.diff(edges)).tolist():
            p, e = slice(edges[s], edges[s + 1]), slice(links[edges[s]], links[edges[s + 1]])
            own = pairs[p] - s * size
            yield {"batch": batch, "stripe": s, "ids_a": _packed(own // self.width, "<u4"), "ids_b": _packed(own % self.width, "<u4"), "n": _packed(n[p], "<u4"), "docs": _packed(gaps[e], "<u2"), "times": _packed(often[e], "<u4")}
        table = pa.table({"doc_id": pa.array(doc_ids, pa.int64()), **{name: pa.array([int(x[i]) for x in numbers], pa.int64()) for i, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))}, "groups_sha256": pa.array(shas, pa.string())})
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        yield {"batch": batch, "stripe": -1, "facts": zstandard.compress(sink.getvalue(), 1)}


_ALIGNERS: dict[tuple, Aligner] = {}


def _aligner(*key) -> Aligner:
    """The worker process's own, kept from task to task with its memo."""
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(*key)
    return _ALIGNERS[key]


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    names = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[k]) for n, k in names], [n for n, _ in names])


def linked(documents: DataFrame, path_a: str, path_b: str, stripes: int = STRIPES, part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows of parts and stripes with links, and one row for each part (stripe -1) with its documents."""

    def run(batches):
        aligner, batch = _aligner(path_a, path_b, stripes), TaskContext.get().partitionId() << 40
        ids, texts, held = [], [], 0
        for got in batches:
            for doc_id, text in zip(got.column("doc_id").to_pylist(), got.column("text"), strict=True):
                texts.append(text.as_py())
                ids.append(doc_id)
                held += len(texts[-1] or "")
                if held >= part_bytes or len(ids) >= PART_ROWS:
                    yield from (_batch([r], _LINKS) for r in aligner.part(batch, ids, texts))
                    ids, texts, held, batch = [], [], 0, batch + 1
        if ids:
            yield from (_batch([r], _LINKS) for r in aligner.part(batch, ids, texts))

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _LINKS)


def _dealt(df: DataFrame, size, slice_bytes: int) -> list[int]:
    """How many tasks each stripe needs."""
    rows = df.groupBy("stripe").agg(F.sum(size).alias("size")).collect()  # one row for each stripe
    return [max(1, -(-dict(rows).get(s, 0) // slice_bytes)) for s in range(max([0, *(r.stripe for r in rows)]) + 1)]


def _by_stripe(batches, *keys: str) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Runs of rows with the same keys, as they stand; a row at a time is held."""
    rows = ({n: batch.column(n)[i].as_py() for n in batch.schema.names} for batch in batches for i in range(batch.num_rows))
    return groupby(rows, key=lambda r: tuple(r[k] for k in keys))


_COUNTS = "stripe int, ids_a binary, ids_b binary, n binary"


def _summed(rows: DataFrame, dealt: list[int], height: int, width: int) -> DataFrame:
    """Counts of a stripe's rows added up, a matrix for each of the tasks that a stripe is dealt over."""

    def run(batches):
        for (stripe, _), own in _by_stripe(batches, "stripe", "slot"):
            matrix = np.zeros(height * width, np.int64)
            for r in own:
                np.add.at(matrix, _unpacked(r["ids_a"], "<u4") * width + _unpacked(r["ids_b"], "<u4"), _unpacked(r["n"], "<u8" if r["wide"] else "<u4"))
            for a in range(0, height, 64):  # rows of some ids each
                at = np.flatnonzero(matrix[a * width : (a + 64) * width]) + a * width
                if len(at):
                    yield _batch([{"stripe": stripe, "ids_a": _packed(at // width, "<u4"), "ids_b": _packed(at % width, "<u4"), "n": _packed(matrix[at], "<u8")}], _COUNTS)

    slot = F.pmod(F.xxhash64("ids_a", "ids_b", "n"), F.get(F.array(*map(F.lit, dealt)), F.col("stripe")))
    return rows.withColumn("slot", slot.cast("int")).repartition("stripe", "slot").sortWithinPartitions("stripe", "slot").mapInArrow(run, _COUNTS)


def counted(links: DataFrame, height: int, width: int, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The count matrices' entries over zero, in rows of some ids of a stripe, from all parts' rows."""
    own = links.where("stripe >= 0").select("stripe", "ids_a", "ids_b", "n", F.lit(False).alias("wide"))
    size = F.length("ids_a") + F.length("ids_b") + F.length("n")
    dealt = _dealt(own, size, slice_bytes)
    out = _summed(own, dealt, height, width)
    return out if max(dealt) == 1 else _summed(out.withColumn("wide", F.lit(True)), [1] * len(dealt), height, width)


_SUMS = "batch bigint, docs binary, best binary, sums binary, facts binary"
_RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def aligned(documents: DataFrame, path_a: str, path_b: str, stripes: int = STRIPES, part_bytes: int = PART_BYTES, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """A row for each document; see the module's text."""
    shape = Aligner(path_a, path_b, stripes)
    height, width = shape.height, shape.width
    links, _ = written(linked(documents, path_a, path_b, stripes, part_bytes), "links")
    counts, _ = written(counted(links, height, width, slice_bytes), "pair-counts")

    def score(batches):
        for (_, _), own in _by_stripe(batches, "stripe", "slot"):
            matrix, top = np.zeros(height * width, np.int64), None
            for r in own:
                a, b = _unpacked(r["ids_a"], "<u4"), _unpacked(r["ids_b"], "<u4")
                if r["batch"] is None:  # counts come first
                    matrix[a * width + b] = _unpacked(r["n"], "<u8")
                    continue
                if top is None:
                    top = matrix.reshape(height, width).max(1)
                n, gaps, times = _unpacked(r["n"], "<u4"), _unpacked(r["docs"], "<u2"), _unpacked(r["times"], "<u4")
                starts, total = np.cumsum(n) - n, np.cumsum(gaps)
                docs = total - np.repeat(total[starts] - gaps[starts], n)
                count = matrix[a * width + b]
                best, sums = np.zeros(docs.max() + 1, np.int64), np.zeros(docs.max() + 1, np.int64)
                np.add.at(best, docs, times * np.repeat(count == top[a], n))
                np.add.at(sums, docs, times * np.repeat(count, n))
                some = np.flatnonzero(sums)
                yield _batch([{"batch": r["batch"], "docs": _packed(some, "<u2"), "best": _packed(best[some], "<u4"), "sums": _packed(sums[some], "<u8")}], _SUMS)

    def gather(batches):
        for _, own in _by_stripe(batches, "batch"):
            table = None
            for r in own:
                if table is None:  # the documents come first
                    table = pa.ipc.open_stream(zstandard.decompress(r["facts"])).read_all()
                    best, sums = np.zeros(table.num_rows, np.int64), np.zeros(table.num_rows, np.int64)
                    continue
                docs = _unpacked(r["docs"], "<u2")
                best[docs] += _unpacked(r["best"], "<u4")
                sums[docs] += _unpacked(r["sums"], "<u8")
            out = table.append_column("n_best", pa.array(best)).append_column("count_sum", pa.array(sums))
            yield from out.select([x.split()[0] for x in _RESULT.split(", ")]).to_batches(max_chunksize=10_000)

    own = links.where("stripe >= 0").drop("facts")
    dealt = _dealt(own, F.length("docs") + F.length("times"), slice_bytes)
    of = F.get(F.array(*map(F.lit, dealt)), F.col("stripe"))
    mine = own.withColumn("slot", F.pmod(F.xxhash64("batch"), of).cast("int"))
    copies = counts.withColumn("slot", F.explode(F.sequence(F.lit(0), of - 1)))
    both = copies.unionByName(mine, allowMissingColumns=True).repartition("stripe", "slot").sortWithinPartitions("stripe", "slot", F.asc_nulls_first("batch"))
    sums = both.mapInArrow(score, _SUMS)
    facts = links.where("stripe < 0").select("batch", "facts")
    met = facts.unionByName(sums, allowMissingColumns=True).select(*(x.split()[0] for x in _SUMS.split(", ")))
    return met.repartition("batch").sortWithinPartitions("batch", F.desc_nulls_last("facts")).mapInArrow(gather, _RESULT)


def pair_counts(documents: DataFrame, path_a: str, path_b: str, stripes: int = STRIPES, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """id_a, id_b, n and best: every pair's count, and whether it is its first id's highest."""
    shape = Aligner(path_a, path_b, stripes)

    def plain(batches):
        for batch in batches:
            for r in batch.to_pylist():
                a, b, n = _unpacked(r["ids_a"], "<u4"), _unpacked(r["ids_b"], "<u4"), _unpacked(r["n"], "<u8")
                top = np.zeros(a.max() + 1, np.int64)
                np.maximum.at(top, a, n)
                yield pa.RecordBatch.from_arrays([pa.array(a * stripes + r["stripe"]), pa.array(b), pa.array(n), pa.array(n == top[a])], ["id_a", "id_b", "n", "best"])

    links, _ = written(linked(documents, path_a, path_b, stripes), "links")
    return counted(links, shape.height, shape.width, slice_bytes).mapInArrow(plain, "id_a bigint, id_b bigint, n bigint, best boolean")

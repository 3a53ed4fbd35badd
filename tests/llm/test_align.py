"""Cross-tokenizer alignment against the two libraries on whole texts."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from skyfront.llm import align
from skyfront.llm.common import read

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Plain:
    """The contract, by its words."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.of = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(keep)))}

    def sides(self, text):
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        bytes_a = [bytes(self.of[c] for c in self.a.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in b]
        return a, b, bytes_a, bytes_b

    def groups(self, text):
        if not text:
            return []
        a, b, bytes_a, bytes_b = self.sides(text)
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            return []

        def ends(parts):
            out = [0]
            for p in parts:
                out.append(out[-1] + len(p))
            return out[1:]

        ends_a, ends_b = ends(bytes_a), ends(bytes_b)
        cuts = sorted(set(ends_a) & set(ends_b))
        out, low = [], 0
        for c in cuts:
            out.append(([i for i, e in zip(a, ends_a) if low < e <= c], [i for i, e in zip(b, ends_b) if low < e <= c]))
            low = c
        return out

    def rows(self, docs):
        each = [[(x, y) for ga, gb in gs for x in ga for y in gb] for gs in (self.groups(t) for _, t in docs)]
        count = Counter(p for links in each for p in set(links))
        top = defaultdict(int)
        for (x, _), n in count.items():
            top[x] = max(top[x], n)
        out = []
        for (doc_id, text), links in zip(docs, each):
            gs = self.groups(text)
            said = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in gs)
            out.append((doc_id, sum(len(g[0]) for g in gs), sum(len(g[1]) for g in gs), len(gs), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if gs else ""))
        return sorted(out, key=repr), {(x, y): (n, n == top[x]) for (x, y), n in count.items()}


@pytest.fixture(scope="module")
def plain():
    return Plain()


def documents():
    rng = random.Random(13)
    bits = ["the", " and", "  ", " ", "\n", "\n ", " \n", "\t", "ing", "Ünï", "漢字", "😀", "é", "'ll", "...", "!!", "12", "3", "<s>", "<|endoftext|>", "</s>", "<0x41>", "　", "\xa0", "\x1c", "\x85", "don't", "ation"]
    texts = ["", " ", "  ", "a", " a", "a ", "a  ", "\n", " \n ", "a\n b", "a \n b", "\x00", "ﬁ", "▁", "a ▁b", "x" * 300, "ha" * 500, "é" * 200, "word " * 400, "<|endoftext|>", "qzx" * 100]
    texts += ["".join(rng.choice(bits) for _ in range(rng.choice((2, 5, 20, 100)))) for _ in range(150)]
    texts += ["".join(chr(rng.choice((rng.randrange(32, 127), rng.randrange(160, 0x500), rng.randrange(0x4E00, 0x5000), rng.randrange(0x1F300, 0x1F600)))) for _ in range(40)) for _ in range(60)]
    rows = list(enumerate(texts)) + [(3, None), (5, "the same id"), (5, "the same id"), (None, "no id"), (None, None)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], "doc_id bigint, text string, batch string, stripe string, n string").repartition(5)


def rows_of(df):
    names = [x.split()[0] for x in align._RESULT.split(", ")]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize("how", [{}, {"part_bytes": 500}, {"stripes": 7, "part_bytes": 2000, "slice_bytes": 600}])
def test_against_whole_texts(spark, plain, how):
    """In small parts; and with stripes that are dealt over several tasks."""
    docs = documents()
    assert rows_of(align.aligned(frame(spark, docs), A, B, **how)) == plain.rows(docs)[0]


def test_pair_counts(spark, plain):
    docs = documents()
    for slice_bytes in (align.SLICE_BYTES, 400):
        found = align.pair_counts(frame(spark, docs), A, B, slice_bytes=slice_bytes).collect()
        assert {(r.id_a, r.id_b): (r.n, r.best) for r in found} == plain.rows(docs)[1] and len(found) == len(plain.rows(docs)[1])


def test_groups_of_very_many_links(plain, monkeypatch):
    """Their distinct ids are multiplied; the part's rows don't change."""
    docs = [(k, t) for k, (_, t) in enumerate(documents())]
    usual = list(align.Aligner(A, B).part(0, *map(list, zip(*docs))))
    monkeypatch.setattr(align, "HEAVY", 2)
    monkeypatch.setattr(align, "LONGEST", -1)  # such words are too long to be remembered
    assert list(align.Aligner(A, B).part(0, *map(list, zip(*docs)))) == usual


def test_words_cover_a_text():
    aligner = align.Aligner(A, B)
    assert aligner.by_units
    for _, t in documents():
        assert "".join(aligner.words(t or "")) == " " + (t or "")


def test_words_of_plain_texts(plain):
    """Short forms, marks, digits and white space next to each other, in every order."""
    rng, aligner = random.Random(5), align.Aligner(A, B)
    bits = ["'", "'s", "'ll", "'re", "st", "don", "É", "ß", "?", "%%%", "###", ".", "12", "7", " ", "  ", "\n", "\t", "\r\n", "_", "-", "s", "d", "'d", "l"]
    for _ in range(1500):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 12)))
        wanted = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in plain.groups(text))
        found = aligner.groups(aligner.words(text))
        assert (";".join(x[2] for x in found) if found else "") == wanted, text


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_query_against_whole_texts(spark, plain):
    docs = read(spark, "/root/testdata/sf0.001", "documents", "doc_id", "text")
    assert rows_of(align.aligned(docs, A, B)) == plain.rows([tuple(r) for r in docs.collect()])[0]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert align.aligned(docs, A, B).count() == 0 and align.pair_counts(docs, A, B).count() == 0


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        align.Aligner(public_tokenizers.path("word_bpe_49k.json"), B)

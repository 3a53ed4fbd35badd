"""Encoding in parts against the library on whole texts."""

import hashlib
import os
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from skyfront.llm import bpe
from skyfront.llm.common import read

PATH = public_tokenizers.path("word_bpe_49k.json")
#: Alphabets that are hard to cut: no blanks, contractions, marks that compose, added tokens, digits.
ALPHABETS = [
    ["a", "b", "the", "ing", "er"],
    ["'", "s", "ll", "re", "!", "?", "a", "don't", "''", "'S"],
    ["e", "́", "̧", "ä", "ᄀ", "ᅡ", "ᆨ", "̈́", "ে", "া", "İ", "ﬁ"],
    ["<|endoftext|>", "<|startoftext|>", "<|", "|>", "endoftext", "<", "x", "!!", " "],
    ["1", "23", "٣", "½", "a", ".", ",", "$", "\x00", "\x1c", "\x85", "　", " "],
    ["漢", "字", "かな", "ёж", "Ω", "😀", "👩‍👧", "ß", "a"],
    [" ", "\n", "\t", "word", "Wörter", "hello", "  ", "\r\n"],
    ["a"],
    ["!"],
    ["́"],
]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(PATH)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return lambda text: t.encode(text, add_special_tokens=False).ids, lambda ids: t.decode(ids, skip_special_tokens=False)


def texts():
    rng = random.Random(12)
    for k, alphabet in enumerate(ALPHABETS):
        for n in (1, 30, 200, 900):
            yield "".join(rng.choice(alphabet) for _ in range(n))
        yield "".join(rng.choice(alphabet + ALPHABETS[(k + 1) % len(ALPHABETS)]) for _ in range(1200))
        yield "".join(rng.choice(alphabet) * rng.choice((1, 1, 40)) for _ in range(120))


def in_parts(encoder, text, leaf, window):
    cuts = bpe.halves(len(text), leaf)
    leaves = [bpe.Tokens.unpacked(encoder.spans(text[a:b], a).packed(), a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return bpe.tree(text, leaves, encoder.spans, window=window).ids.tolist()


@pytest.mark.parametrize("leaf", [7, 64, 300])
def test_tree_gives_the_whole_texts_ids(encoder, library, leaf):
    for text in texts():
        for window in (40, 80):
            assert in_parts(encoder, text, leaf, window) == library[0](text), text[:80]


def test_plain_path_gives_the_whole_texts_ids(encoder, library):
    import numpy as np

    for text in ["", " ", *texts()]:
        ids, decoded = encoder.plain(text)
        wanted = library[0](text)
        assert np.frombuffer(ids, "<i4").tolist() == wanted and decoded == library[1](wanted)


def test_windows_stay_small_where_sides_agree(encoder):
    asked = []

    def spans(text, start=0):
        asked.append(len(text))
        return encoder.spans(text, start)

    rng = random.Random(1)
    text = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) for _ in range(20_000))
    cuts = bpe.halves(len(text), 4096)
    bpe.tree(text, [encoder.spans(text[a:b], a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], spans)
    assert len(asked) == len(cuts) - 2 and max(asked) <= 2 * bpe.WINDOW


def test_a_window_grows_until_it_agrees(encoder, library):
    """Marks without a base compose with nothing firm, so nothing agrees before the whole is encoded."""
    text = "a" + "̧́" * 400 + "b"
    assert in_parts(encoder, text, 100, 40) == library[0](text)


def test_halves():
    assert bpe.halves(0, 5) == [0, 0] and bpe.halves(5, 5) == [0, 5] and bpe.halves(6, 5) == [0, 3, 6]
    cuts = bpe.halves(1001, 10)
    assert max(b - a for a, b in zip(cuts[:-1], cuts[1:], strict=True)) <= 10


def rows_of(df):
    return sorted(map(tuple, bpe.digest(df).collect()), key=repr)


def wanted(library, rows):
    out = []
    for doc_id, text in rows:
        ids = library[0](text or "")
        out.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library[1](ids).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_operator_against_the_library(spark, library):
    rows = [(k, t) for k, t in enumerate(texts())] + [(3, None), (4, ""), (4, ""), (None, "no id " * 300), (None, None), (7, "twice " * 200), (7, "twice " * 200)]
    docs = spark.createDataFrame([(*r, "x", "x") for r in rows], "doc_id bigint, text string, ids string, row string").repartition(6)
    assert rows_of(bpe.encoded(docs, PATH, leaf=256, window=64)) == wanted(library, rows)
    assert bpe.encoded(docs.limit(0), PATH).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_query_against_the_library(spark, library):
    docs = read(spark, "/root/testdata/sf0.001", "documents", "doc_id", "text")
    assert docs.where(F.length("text") > bpe.LEAF).count() > 0
    assert rows_of(bpe.encoded(docs, PATH)) == wanted(library, [tuple(r) for r in docs.collect()])


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))

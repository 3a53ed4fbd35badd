"""Filter interaction audit against a plain count, also where all hashes are equal."""

import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from skyfront.llm import audit

SCHEMA = "doc_id bigint, text string, lang string, class string, fails string, n_chars string, part string"


def plain(rows, labels):
    """The contract, by its words."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    docs = []
    for i, text, lang in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        mask = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        docs.append((lang or "", {k for k, v in mask.items() if v}, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                out[part, order, k + 1] = [len(left), len(gone), sum(f in d[1] for d in own) - len(gone), sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(shapley[order[k - 1]])
    return out


def some_rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeF") for _ in range(rng.randint(1, 4)))
    texts = [" ".join(word() for _ in range(rng.choice((3, 40, 99, 100, 101, 150)))) for _ in range(25)]
    texts += ["", "   ", "x" * 64, "x" * 65, "x" * 1024, "x" * 1024 + "y", "x" * 20_000 + "y", "x" * 20_000 + "z", "a # b", "ÄÖ ß\x00 ç", "a\x1cb\x85c", "A" * 10, "word " * 120]
    rows = [(i, rng.choice(texts), rng.choice(("en", "de", None, ""))) for i in range(160)]
    rows += [(5, "x" * 65, "en"), (5, "x" * 65, "en"), (7, None, "en"), (None, "x" * 65, "de"), (None, None, None)]
    rng.shuffle(rows)
    labels = [(rng.randint(0, 170), rng.choice((0, 1, None)), rng.choice((0, 1, None))) for _ in range(120)] + [(None, 1, 1)]
    return rows, labels


def audited(spark, rows, labels, **more):
    docs = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(5)
    out = audit.audit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), **more).collect()
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in out}


@pytest.mark.parametrize("broadcast", [audit.BROADCAST, 0])
def test_counts_against_brute_force(spark, broadcast):
    rows, labels = some_rows()
    assert audited(spark, rows, labels, broadcast=broadcast) == plain(rows, labels)


def test_texts_decide_where_hashes_are_equal(spark, monkeypatch):
    """With one hash for everything, all documents stay in one class to the end."""
    monkeypatch.setattr(audit, "_hash", lambda *c: F.lit(0).cast("bigint"))
    rows, labels = some_rows()
    assert audited(spark, rows, labels) == plain(rows, labels)


def test_splits_drop_single_documents(spark):
    """Texts that differ in one block only are told apart by that block's split."""
    long = ["q" * 17_000, "q" * 16_999 + "r", "q" * 500 + "r" + "q" * 16_499, "r" + "q" * 16_999, "q" * 17_001]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(long)] + [(9, long[0], "en")], "doc_id bigint, text string, lang string")
    many, _ = audit._repeated_classes(audit._measured(audit._rows(docs, "lang")))
    assert many.count() == 1
    assert {r.doc_id for r in audit.marked(docs).collect() if r.fails & 16} == {9}


def test_words_in_steps(monkeypatch):
    text = b" a b\ta\x0b\x0cc\r\na  d \x1c " * 3
    whole = audit.words(text)
    monkeypatch.setattr(audit, "STEP", 2)
    assert audit.words(text) == whole == (21, 5)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert audit.audit(docs, labels).count() == 0
    assert len(audited(spark, [(1, None, None)], [(1, 1, 1)])) == 600

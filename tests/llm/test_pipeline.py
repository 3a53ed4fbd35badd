"""The pipeline over planted cases: every stage's decisions take effect, clean documents stay."""

import random

import pytest

import corpus_pipeline
from skyfront.llm import packing
from skyfront.llm.common import written
from skyfront.llm.queries import _tokenizer

from .test_operators import brute_lines, rich

BAD = ["vilewort", "scumbell", "trashkin", "idiotry"]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    pytest.importorskip("public_tokenizers")
    r = random.Random(20)
    prose = lambda n: ". ".join(rich(r, 12) for _ in range(n // 12)) + ". "
    docs, labels, kind = {}, [], {}
    for i in range(300):
        toxic = i % 6 == 0
        words = rich(r, 120).split()
        for _ in range(4 * toxic):
            words.insert(r.randrange(len(words)), r.choice(BAD))
        docs[i] = " ".join(words) + "."
        labels.append((i, 1, int(toxic)))
        kind[i] = "toxic" if toxic else "clean"
    passage = prose(96)
    for i in range(300, 306):
        docs[i], kind[i] = rich(r, 60) + ". " + passage + rich(r, 60) + ".", "passage"
    for i in range(310, 320, 2):
        words = [f"w{r.randrange(10**5)}" for _ in range(14)]  # a single line that is not cut, so that line dedup leaves it alone
        docs[i], kind[i] = " ".join(words), "first"
        words[-1] = "changed"
        docs[i + 1], kind[i + 1] = " ".join(words), "near"
    items = [rich(r, 40) for _ in range(4)]  # one each: line dedup would cut a passage that several share
    for i in range(330, 334):
        docs[i], kind[i] = rich(r, 50) + " " + items[i - 330].upper() + " " + rich(r, 50), "benchmark"
    path = tmp_path_factory.mktemp("planted")
    rows = [(i, t, "en", "src0", len(t)) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), docs, kind


def test_stages_and_their_union(spark, planted):
    path, docs, kind = planted
    of = lambda *kinds: {i for i, k in kind.items() if k in kinds}
    frame = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        frame, _ = written(stage(spark, frame, path), name)
        seen[name] = {r.doc_id: r for r in frame.collect()} if name != "packing" else frame.collect()

    kept = set(seen["toxicity"])
    assert len(kept & of("toxic")) <= 0.05 * len(of("toxic")) and len(kept - of("toxic")) >= 0.99 * len(docs.keys() - of("toxic"))

    assert {i: r.text for i, r in seen["line_dedup"].items()} == brute_lines([(i, docs[i]) for i in kept])
    assert all(r.n_chars == len(r.text) for r in seen["line_dedup"].values())
    assert all(len(seen["line_dedup"][i].text) < len(docs[i]) - 400 for i in sorted(kept & of("passage"))[1:])

    near = set(seen["near_dedup"])
    assert near == kept - of("near")

    assert set(seen["decontamination"]) == near - of("benchmark")

    encode = packing.Encoder(_tokenizer())
    wanted = {i: len(encode(r.text)) // 4 + 1 for i, r in seen["decontamination"].items()}
    got, used = {}, {}
    for r in seen["packing"]:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert got == wanted and max(used.values()) <= packing.SIZE
    assert len(used) <= 1.1 * sum(wanted.values()) / packing.SIZE + 1
    assert sorted(map(tuple, corpus_pipeline.run(spark, path).select("doc_id", "piece", "length").collect())) == sorted((r.doc_id, r.piece, r.length) for r in seen["packing"])

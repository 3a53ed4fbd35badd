"""Nulls, empty and long texts, repeats, empty tables and clashing names, for every operator and stage."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from skyfront.llm import align, audit, bpe, chat, decontam, lines, lm, packing, pii, quality, simhash, tiff, toxicity
from skyfront.llm.queries import _tokenizer

NAMES = ["_id", "_key", "_row", "_h", "_at", "fp", "node", "key", "part", "row", "word", "n_words", "score", "page", "pixels", "n_lines", "c", "a"]
LONG = "word " * 60_000


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(1, "one two three four\nfive six seven\neight nine ten\neleven twelve"), (1, "one two three four\nfive six seven\neight nine ten\neleven twelve"), (2, "one two three four\nfive six seven\neight nine ten\neleven twelve"), (3, ""), (4, None), (None, "text without id"), (None, None), (5, LONG), (6, "\n\n\n\n"), (7, "é \x00 ퟿")]
    extra = ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame([(*r, None, "src", None, *["x"] * len(NAMES)) for r in rows], f"doc_id bigint, text string, lang string, source string, n_chars bigint, {extra}")


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (1, 0, 1), (2, None, None), (None, 1, 1), (5, 1, 1), (77, 0, 0)]
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, quality int, toxic int, score string")


def benchmark(spark, rows=((1, "one two three four five"), (None, "four"), (3, None), (3, ""))):
    return spark.createDataFrame(list(rows), "item_id bigint, text string")


OPERATORS = {
    "lm": lambda s, d, lab: lm.lm_scores(d, texts=5),
    "decontam": lambda s, d, lab: decontam.digest(decontam.decontaminate(d, benchmark(s))),
    "decontam_empty": lambda s, d, lab: decontam.digest(decontam.decontaminate(d, benchmark(s, ()))),
    "simhash": lambda s, d, lab: simhash.digest(simhash.near_duplicates(d)),
    "quality": lambda s, d, lab: quality.scored(d, quality.fit(d, lab)),
    "tiff": lambda s, d, lab: tiff.digest(d),
    "lines": lambda s, d, lab: lines.line_dedup(d),
    "lines_all_columns": lambda s, d, lab: lines.without_repeats(d),
    "toxicity": lambda s, d, lab: toxicity.scored(d, toxicity.fit(d, lab)),
    "pii": lambda s, d, lab: pii.personal_data(d, pii.Tagger.new()),
    "bpe": lambda s, d, lab: bpe.digest(bpe.encoded(d, _tokenizer("word_bpe_49k.json"))),
    "bpe_in_parts": lambda s, d, lab: bpe.encoded(d, _tokenizer("word_bpe_49k.json"), leaf=20),
    "align": lambda s, d, lab: align.aligned(d, _tokenizer(), _tokenizer("piece_bpe_32k.model"), stripes=4),
    "audit": lambda s, d, lab: audit.marked(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(spark, documents, labels, name):
    assert OPERATORS[name](spark, documents, labels).count() == documents.count()
    assert OPERATORS[name](spark, documents.limit(0), labels.limit(0)).count() == 0


def test_defined_results(spark, documents, labels):
    by = lambda df, c: {(r.doc_id): r[c] for r in df.collect()}
    cut = by(lines.line_dedup(documents), "text")
    assert cut[1].startswith("one") and cut[2] == "" and cut[4] is None and cut[6] == "\n\n\n\n" and cut[5] == LONG
    near = by(simhash.near_duplicates(documents), "component_id")
    assert near[1] == near[2] == 1 and near[3] == near[4] == near[6]
    hits = by(decontam.digest(decontam.decontaminate(documents, benchmark(spark))), "contaminated")
    assert hits[1] and hits[2] and not hits[5] and not hits[4]
    n = by(lm.lm_scores(documents, texts=5), "n_tokens")
    assert n[3] == n[4] == 1 and n[5] == 60_001
    assert by(pii.personal_data(documents, pii.Tagger.new()), "spans")[4] == ""


def test_packing_of_edges(spark, documents):
    pytest.importorskip("public_tokenizers")
    rows = packing.pack(documents, _tokenizer()).collect()
    assert {r.length for r in rows if r.doc_id in (3, 4)} == {1}
    assert sum(r.length for r in rows if r.doc_id == 5) > 60_000
    assert packing.pack(documents.limit(0), _tokenizer()).count() == 0


def test_conversation_edges(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 1, "assistant", None), (2, None, None, "b"), (None, 0, "user", "x"), (4, 0, "assistant", LONG)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, prompt string")
    got = {r.conv_id: r for r in chat.preference_rows(chat.swapped_pairs(df)).collect()}
    assert set(got) == {1, 2, 4} and not got[2].usable and got[4].chosen.count("word") == 60_000
    assert chat.preference_rows(chat.swapped_pairs(df.limit(0))).count() == 0


def test_stages_on_edges(spark, documents, labels, tmp_path):
    pytest.importorskip("public_tokenizers")
    for name, df in (("labels", labels), ("benchmark", benchmark(spark)), ("documents", documents)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for docs in (documents, documents.limit(0)):
            out = stage(spark, docs, str(tmp_path))
            if name != "packing":
                assert out.columns == docs.columns and out.schema["text"].dataType == docs.schema["text"].dataType
            assert out.count() == 0 if docs.isEmpty() else out.count() > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_registered_queries():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)}
    assert "pipeline" in names and [s for s, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]

"""The pipeline on planted documents: each stage's decisions, and that clean documents stay."""

import random

import pytest

import corpus_pipeline
from larkspur.llm import quality_rules, unigram
from larkspur.llm.queries import vocabulary


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    random.seed(21)
    syllables = ["ba", "ko", "ri", "tu", "ne", "sol", "mag", "len", "fi", "dor"]
    word = lambda: random.choice(["the", "of", "and", "to", "in"]) if random.random() < 0.35 else "".join(random.choices(syllables, k=random.randint(2, 4)))
    prose = lambda n: "\n".join(" ".join(word() for _ in range(15)) + "." for _ in range(n // 15))
    rows = {i: prose(180) for i in range(120)}
    junk = {200 + i: " ".join(f"{word().upper()}!!" if i % 2 else f"{word()}*** |" for _ in range(120)) for i in range(6)}
    passage = prose(75)
    shared = {300 + i: prose(150) + "\n" + passage + "\n" + prose(60) for i in range(5)}
    copies = {400: rows[3], 401: rows[3]}
    items = [(k, " ".join(word() for _ in range(40))) for k in range(8)]
    leaks = {500 + k: prose(120) + "\n" + text + "\n" + prose(60) for k, text in items[:4]}
    all_rows = rows | junk | shared | copies | leaks
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in all_rows.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, all_rows, junk, shared, copies, leaks, passage


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash", "decontamination", "sentencepiece"]


def test_each_stage(spark, planted, tmp_path):
    folder, rows, junk, shared, copies, leaks, passage = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, at = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        at[name] = {r.doc_id: r for r in docs.collect()}
        assert name == "sentencepiece" or docs.columns == columns
    clean = set(rows) - set(junk)
    assert set(at["quality_rules"]) == clean
    texts = {i: r.text for i, r in at["line_dedup"].items()}
    assert set(texts) == clean
    assert [i for i in shared if passage in texts[i]] == [300]
    assert all(texts[i] == rows[i] for i in range(120)) and texts[400] == texts[401] == ""
    assert all(r.n_chars == len(r.text) for r in at["line_dedup"].values())
    # the two emptied copies have fingerprint zero and are one group
    assert set(at["simhash"]) == clean - {401}
    assert set(at["decontamination"]) == clean - {401} - set(leaks)
    model = unigram.Unigram(unigram.Vocabulary.load(vocabulary("piece_bpe_32k.model")))
    assert {i: list(r.token_ids) for i, r in at["sentencepiece"].items()} == {i: model.encode(r.text).tolist() for i, r in at["decontamination"].items()}


def test_run_is_the_last_stage(spark, planted):
    folder, rows, junk, _, _, leaks, _ = planted
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "lang", "source", "token_ids"]
    assert {r.doc_id for r in got.collect()} == set(rows) - set(junk) - set(leaks) - {401}


def test_stages_of_no_documents(spark, planted):
    folder = planted[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_extra_columns_and_nulls(spark, planted):
    folder = planted[0]
    docs = spark.createDataFrame([(1, None, None, None, None, 1), (None, "a " * 60, "en", "s", 3, 2), (2, "", "en", None, 0, 3)], "doc_id long, text string, lang string, source string, n_chars long, kept int")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        assert {r.doc_id for r in out.collect()} <= {1, 2, None}
    assert quality_rules.keep_good(docs).count() == 0

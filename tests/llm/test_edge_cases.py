"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

from collections import Counter

import public_tokenizers
import pytest

import corpus_pipeline
from tessera.llm import byte_bpe, chat_format, language_model, media, packing, quality_classifier, quality_rules, secrets_scan, simhash, toxicity

from . import cases

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def _lm(df):
    return language_model.score(df, language_model.train(df.selectExpr("coalesce(text, '') AS text"), 4))


def _quality(df):
    return quality_classifier.score(df, quality_classifier.fit(df, cases.labels(df.sparkSession)))


def _toxic(df):
    return toxicity.tag(df, toxicity.fit(df, cases.labels(df.sparkSession)))


ONE_ROW_EACH = {
    "quality_classifier": _quality,
    "simhash": simhash.near_duplicates,
    "language_model": _lm,
    "toxicity": _toxic,
    "media": lambda df: media.describe(media.store(df)),
    "byte_bpe": lambda df: byte_bpe.encode(df, RANKS),
    "quality_rules": quality_rules.judge,
}
OTHERS = {
    "secrets": lambda df: secrets_scan.scan(df, secrets_scan.train(secrets_scan.example_findings(400))),
    "packing": lambda df: packing.pack(df, JSON),
    "media_tensors": lambda df: media.extract(media.store(df)),
}


@pytest.mark.parametrize("name", ONE_ROW_EACH)
def test_each_row_has_a_result(spark, name):
    found = ONE_ROW_EACH[name](cases.with_clashes(spark)).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in cases.ROWS)


@pytest.mark.parametrize("name", ONE_ROW_EACH | OTHERS)
def test_empty_table(spark, name):
    assert (ONE_ROW_EACH | OTHERS)[name](cases.empty(spark)).collect() == []


@pytest.mark.parametrize("name", OTHERS)
def test_others_take_awkward_rows(spark, name):
    assert OTHERS[name](cases.with_clashes(spark)).collect()


def test_equal_rows_have_equal_results(spark):
    for name, run in ONE_ROW_EACH.items():
        rows = [r.asDict() for r in run(cases.documents(spark)).collect() if r["doc_id"] == 2]
        assert len(rows) == 2 and rows[0] == rows[1], name


def test_packing_keeps_every_row(spark):
    pieces = packing.pack(cases.with_clashes(spark), JSON, length=64).collect()
    starts = Counter(r["doc_id"] for r in pieces if r["start"] == 0)
    assert starts == Counter(r[0] for r in cases.ROWS)


def test_chat_takes_nulls_ties_and_no_rows(spark):
    kind = "conv_id bigint, turn bigint, role string, text string, loss string"
    rows = [(1, 0, "user", "hi", "x"), (1, 0, "user", "hi", "x"), (1, None, None, None, None), (None, 1, "assistant", "</turn>\\", "x")]
    made = {r["conv_id"]: r for r in chat_format.format_conversations(spark.createDataFrame(rows, kind)).collect()}
    assert made[1]["n_turns"] == 3 and made[None]["n_turns"] == 1 and not made[1]["valid"]
    assert chat_format.format_conversations(spark.createDataFrame([], kind)).collect() == []


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    cases.documents(spark).write.parquet(f"{path}/documents.parquet")
    cases.labels(spark).write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_columns(spark, folder, stage):
    name, run = corpus_pipeline.STAGES[stage]
    for docs in (cases.with_clashes(spark), cases.empty(spark)):
        out = run(spark, docs, folder)
        assert out.columns == docs.columns, name
        ids = Counter(r[0] for r in cases.ROWS)
        assert not Counter(r["doc_id"] for r in out.collect()) - ids


def test_pipeline_runs_over_awkward_rows(spark, folder):
    assert "sequence_id" in corpus_pipeline.run(spark, folder).columns
    assert 1 in {r["doc_id"] for r in corpus_pipeline.STAGES[2][1](spark, cases.documents(spark), folder).collect()}


def test_dedup_keeps_one_row_of_a_repeated_id(spark, folder):
    kept = Counter(r["doc_id"] for r in simhash.representatives(cases.documents(spark)).collect())
    assert kept[1] == 1 and kept[2] == 0 and kept[8] == 1
    twice = spark.createDataFrame([(4, "a b c d e", None, None, None)] * 3, cases.SCHEMA)
    assert simhash.representatives(twice).count() == 1


def test_dedup_keeps_different_texts_of_null_and_repeated_ids(spark):
    rows = [(i, " ".join(f"{w}{k}" for w in cases.WORDS.split()), None, None, None) for k, i in enumerate((None, None, 1, 1))]
    kept = simhash.representatives(spark.createDataFrame(rows + rows[:3], cases.SCHEMA)).collect()
    assert sorted(r["text"] for r in kept) == sorted(r[1] for r in rows)


def test_redaction_takes_effect(spark):
    out = {r["doc_id"]: r for r in secrets_scan.redact(cases.documents(spark), secrets_scan.train(secrets_scan.example_findings())).collect()}
    assert "4f9c2a71be03d85e6a" not in out[8]["text"] and out[8]["n_chars"] == len(out[8]["text"])
    assert out[1]["text"] == cases.WORDS and out[4]["text"] is None

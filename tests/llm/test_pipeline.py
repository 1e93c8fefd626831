"""Stages of the pipeline against plain versions of their decisions."""

import hashlib

import corpus_pipeline as pipeline
import pytest
from awkward import SMALL, prose

from riskloom.llm import bpe
from riskloom.llm.queries import tokenizer


@pytest.fixture(scope="module")
def docs(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet").first()["text"]
    rows = [(9001, prose(200, 1), "en", "s", 1), (9002, prose(200, 1), "en", "s", 1), (9003, prose(60, 2) + " " + bench, "en", "s", 1),
            (9004, "write to a.b@c.de or 1.2.3.4", "en", "s", 1), (9005, None, None, None, None), (9006, "", "en", "s", 0)]
    return table.unionByName(spark.createDataFrame(rows, table.schema))


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_stages_in_order():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "benchmark_decontamination", "pii", "byte_bpe"]


def test_filters(spark, docs):
    clean = pipeline.drop_toxic(spark, docs, SMALL)
    assert clean.columns == docs.columns and {9001, 9005, 9006} <= ids(clean)
    kept = pipeline.drop_near_duplicates(spark, docs, SMALL)
    assert kept.columns == docs.columns and 9001 in ids(kept) and 9002 not in ids(kept) and {9005, 9006} <= ids(kept)
    free = pipeline.drop_contaminated(spark, docs, SMALL)
    assert free.columns == docs.columns and 9003 not in ids(free) and {9001, 9002, 9005, 9006} <= ids(free)


def test_redaction_and_tokens(spark, docs):
    rows = {r["doc_id"]: r for r in pipeline.redact_personal_data(spark, docs, SMALL).collect()}
    assert len(rows) == docs.count() and rows[9004]["text"] == "write to [EMAIL] or [IP]"
    assert rows[9004]["n_chars"] == 24 and rows[9005]["text"] is None
    coded = {r["doc_id"]: r for r in pipeline.encode(spark, docs, SMALL).collect()}
    encoder = bpe.Encoder(bpe.Ranks(tokenizer()[0]), tokenizer()[1])
    for i in (9001, 9004, 9005, 9006):
        text = next(r["text"] for r in docs.filter(f"doc_id = {i}").collect()) or ""
        assert coded[i]["ids"] == encoder([text])[0].tolist()
        assert coded[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_run(spark):
    rows = pipeline.run(spark, SMALL)
    whole = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert 0.5 * whole < rows.count() < whole and rows.count() == len(ids(rows))

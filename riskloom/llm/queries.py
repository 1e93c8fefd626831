"""Registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import (ann, bpe, decontaminate, html_text, kdtree, langid, licenses, neardup, negatives, oracles, pii, substrings, toxicity,
                          trie)
from riskloom.llm.common import held_out, table
from riskloom.session import cut_lineage

RANK_FILE = "byte_bpe_multi_50k.tiktoken"


def tokenizer() -> tuple[list[bytes], str]:
    """Lines of the public rank file and the pattern that splits text before its merges."""
    public = importlib.import_module("public_tokenizers")
    return bpe.read_ranks(public.path(RANK_FILE)), public.PATTERN


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", every=20, k=20)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = langid.prototypes(docs.filter(~held_out("doc_id")), "text", "lang")
    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return langid.identify(rows, "text", profiles).drop("text")


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    name = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 30))  # noqa: E731  names have no order: a hash spreads them
    shards = kdtree.assign(docs, "doc_id", "text", {
        "size": F.log2(F.coalesce(F.octet_length("text"), F.lit(0)) + 1), "id": F.col("doc_id"), "source": name("source"),
        "lang": name("lang")}, shards=8)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), "doc_id", "text", *tokenizer())


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Model:
    """Fitted on labelled documents, except those held out."""
    labels = table(spark, sf_dir, "labels").filter(~held_out("doc_id"))
    return toxicity.fit(docs, "doc_id", "text", labels, "doc_id", "toxic")


def op4_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated(table(spark, sf_dir, "documents"), "doc_id", "text")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.report(docs, "doc_id", "text", pii.fit(docs, "text"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(
        table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_model(spark, sf_dir, docs)
    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return toxicity.score(rows, "text", model).drop("text").withColumn(
        "predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", words=2)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.page_texts(table(spark, sf_dir, "pages"), "page_id", "url", "html")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.select("vec_id", label.alias("label"), "embedding"), "vec_id", "label", "embedding", every=100)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut_lineage(trie.turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text"))
    length = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    return trie.prefix_trie(*trie.with_prefix_of(rows, F.col("conv") - F.col("conv") % 20, length))


def op13_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {
    "op1_nearest": op1_nearest,
    "op2_language_id": op2_language_id,
    "op3_shards": op3_shards,
    "op4_repeated_substrings": op4_repeated_substrings,
    "op5_pii": op5_pii,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_decontamination": op7_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_html_text": op10_html_text,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_license_notices": op13_license_notices,
}
ORACLES = {"op4_repeated_substrings": oracles.REPEATED_SUBSTRINGS, "op9_near_duplicates": oracles.NEAR_DUPLICATES,
           "op11_hard_negatives": oracles.HARD_NEGATIVES, "op12_prefix_trie": oracles.PREFIX_TRIE,
           "op13_license_notices": oracles.license_notices(licenses.TEMPLATES, licenses.PHRASES, licenses.CONTAINMENT, licenses.STEP)}

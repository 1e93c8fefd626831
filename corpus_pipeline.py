"""A training-data pipeline: toxic documents out, one document of each near-duplicate group, no benchmark passages,
personal data redacted, then token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of ``documents``; rows with a null id or text pass the filters. Stages are written as Parquet and reread.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import bpe, decontaminate, neardup, pii, toxicity
from riskloom.llm.common import table
from riskloom.llm.queries import tokenizer, toxicity_model
from riskloom.session import cut_lineage, ensure_checkpoint_dir

#: Score from which a document is rejected as toxic.
REJECT = 0.5
#: Ids to drop are broadcast up to this number (8 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below REJECT. The model learns from labels that are not held out."""
    scored = toxicity.score(docs, "text", toxicity_model(spark, sf_dir, docs), "__score")
    return scored.filter(F.col("__score") < REJECT).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 or more, the document of smallest id."""
    groups = neardup.near_duplicates(docs, "doc_id", "text")
    dropped = cut_lineage(groups.filter(~F.col("kept")).select(F.col("doc_id").alias("__dropped")).distinct())
    gone = F.broadcast(dropped) if dropped.count() <= BROADCAST_IDS else dropped
    return docs.join(gone, F.col("doc_id") == F.col("__dropped"), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    found = decontaminate.with_items(docs, "text", table(spark, sf_dir, "benchmark"), "item_id", "text", out="__items")
    return found.filter(F.size("__items") == 0).select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind; n_chars follows the new text."""
    found = pii.spans(docs, "text", pii.fit(docs, "text"), "__spans")
    return pii.redact(found, "text", "__spans").withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and digests of the ids and of the bytes they decode to."""
    lines, pattern = tokenizer()
    return bpe.encode_and_decode(docs.select("doc_id", "text"), "text", lines, pattern).select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("byte_bpe", encode),
]

#: Classifiers, a similarity join and a tokenizer have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is stored in the checkpoint folder for the next."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

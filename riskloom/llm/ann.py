"""Nearest neighbours by inner product over randomly rotated one-bit codes.

A vector is divided by its norm, padded with zeros to ``BITS`` dimensions and rotated by a fixed random rotation; the
signs are its code, packed into bytes. Two scalars correct the code: the norm, and the inner product of the
rotated unit vector with its own code. From packed bits and scalars a query estimates each inner product, with an
error that is at most ``norm * |query| * sqrt((1 - own^2) / own^2) * EPSILON / sqrt(BITS - 1)`` but for a small
probability. Only vectors whose upper bound reaches the query's k-th best exact score so far are reranked, in double precision.

Every valid row is in the index. The queries are a stated set; they go to all tasks in blocks of bounded size
(``QUERY_BLOCK`` vectors), and each block is one pass over the codes, so neither the driver nor a task holds more than a
block. Each task returns its k best of each query; a second step keeps the k best of all.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do those whose length is
not the most common one (the smaller, if two are as common). Ties go to the smaller id. A row never finds rows of its own id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, FloatType, LongType, StructField, StructType

from riskloom.session import cut_lineage

BITS = 256
EPSILON = 4.0
SEED = 5
QUERY_BLOCK = 16_384
_CELLS = 4_000_000


def rotation(dimensions: int, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """The first ``dimensions`` rows of a random rotation of ``bits`` dimensions: what padding with zeros leaves of it."""
    bits = max(bits, -(-dimensions // 8) * 8)
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:dimensions]


def valid(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part."""
    rows = df.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.coalesce(sound & F.exists("vector", lambda x: x != 0), F.lit(False)))
    size = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("vector") == (size["d"] if size else 0))


def _matrix(column) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def build(rows: DataFrame, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """The index: vec_id, code (packed bits), norm, own, and the original vector for reranking."""
    schema = StructType([StructField("vec_id", LongType()), StructField("code", BinaryType()), StructField("norm", FloatType()),
                         StructField("own", FloatType()), rows.schema["vector"]])

    def run(batches):
        turn = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            if turn is None or turn.shape[0] != x.shape[1]:
                turn = rotation(x.shape[1], bits, seed)
            norm = np.linalg.norm(x, axis=1)
            turned = (x / norm[:, None]) @ turn
            own = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
            code = np.packbits(turned > 0, axis=1)
            width = code.shape[1]
            ends = np.arange(0, (len(code) + 1) * width, width, dtype=np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(code), [None, pa.py_buffer(ends), pa.py_buffer(code.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), packed, pa.array(norm, pa.float32()), pa.array(own, pa.float32()), batch.column(1)],
                names=["vec_id", "code", "norm", "own", "vector"])

    return rows.mapInArrow(run, schema)


class Best:
    """The k best exact scores of each query so far; ties go to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), -np.inf)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate((self.score[q], score)), np.concatenate((self.ids[q], ids))
        order = np.lexsort((ids, -score))[: self.k]
        self.score[q], self.ids[q] = score[order], ids[order]


def scan(batch: pa.RecordBatch, ids: np.ndarray, queries: np.ndarray, turned: np.ndarray, best: Best) -> None:
    """One batch of the index against all queries of a block."""
    own_ids = batch.column(0).to_numpy()
    exact = _matrix(batch.column(4))
    norm, own = batch.column(2).to_numpy().astype(np.float32), batch.column(3).to_numpy().astype(np.float32)
    bits = turned.shape[1]
    code = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(len(own_ids), -1)
    signs = (np.unpackbits(code, axis=1)[:, :bits].astype(np.float32) * 2 - 1) / np.float32(np.sqrt(bits))
    scale = norm / own
    error = norm * np.sqrt(np.maximum(1 - own * own, 0)) / own * np.float32(EPSILON / np.sqrt(bits - 1))
    length = np.linalg.norm(queries, axis=1).astype(np.float32)
    step = max(1, _CELLS // max(1, len(own_ids)))
    for start in range(0, len(ids), step):
        stop = min(len(ids), start + step)
        upper = turned[start:stop] @ signs.T
        upper *= scale
        upper += length[start:stop, None] * error
        least = best.score[start:stop, -1]
        # A first pass of the task has no exact scores to hold against: the best estimates open them.
        for q in np.flatnonzero(np.isneginf(least)).tolist():
            k = min(best.k + 1, upper.shape[1])
            opening = np.argpartition(-upper[q], k - 1)[:k]
            opening = opening[own_ids[opening] != ids[start + q]]
            exact_scores = (exact[opening] * queries[start + q]).sum(axis=1)
            if len(exact_scores) >= best.k:
                least[q] = np.partition(exact_scores, -best.k)[-best.k]
        row, col = np.nonzero(upper >= (least - 1e-6 * np.abs(np.where(np.isfinite(least), least, 0)))[:, None])
        keep = own_ids[col] != ids[start + row]
        row, col = row[keep], col[keep]
        score = np.empty(len(row))
        for a in range(0, len(row), 65_536):
            part = slice(a, a + 65_536)
            score[part] = (exact[col[part]] * queries[start + row[part]]).sum(axis=1)
        good = score >= least[row]
        row, col, score = row[good], col[good], score[good]
        cuts = np.searchsorted(row, np.arange(stop - start + 1))
        for q in np.flatnonzero(np.diff(cuts)).tolist():
            part = slice(cuts[q], cuts[q + 1])
            best.add(start + q, score[part], own_ids[col[part]])


def search(index: DataFrame, queries: DataFrame, k: int, bits: int = BITS, seed: int = SEED, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query, among rows of other ids.

    ``queries`` has vec_id and vector. Its rows reach the driver a block at a time, chosen by hash of the id.
    """
    spark = index.sparkSession
    n_blocks = -(-queries.count() // block)
    found = None
    schema = StructType([StructField("query_id", LongType()), StructField("vec_id", LongType()), StructField("score", DoubleType())])

    def scanner(held):
        def run(batches):
            ids, vectors = held.value
            turned = (vectors @ rotation(vectors.shape[1], bits, seed)).astype(np.float32)
            best = Best(len(ids), k)
            for batch in batches:
                if batch.num_rows:
                    scan(batch, ids, vectors, turned, best)
            q, at = np.nonzero(np.isfinite(best.score))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[q]), pa.array(best.ids[q, at]), pa.array(best.score[q, at])], names=["query_id", "vec_id", "score"])

        return run

    for b in range(n_blocks):
        part = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == b).select("vec_id", "vector").toArrow()
        if not part.num_rows:
            continue
        part = part.combine_chunks().to_batches()[0]
        held = spark.sparkContext.broadcast((part.column(0).to_numpy(), _matrix(part.column(1))))
        own = index.mapInArrow(scanner(held), schema)
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = index.sparkSession.createDataFrame([], schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def nearest(df: DataFrame, id_column: str, vector: str, every: int, k: int) -> DataFrame:
    """Index all valid rows and search with those whose id is divisible by ``every``."""
    index = cut_lineage(build(valid(df, id_column, vector)))
    return search(index, index.filter(F.col("vec_id") % every == 0), k)

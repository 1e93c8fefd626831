"""Helpers shared by the operators: table reading, bounded text blocks, and Arrow column plumbing.

Column conventions of all operators: they read the columns named in their arguments and return the columns
their docstring lists. Further input columns, whatever their names, are ignored, except where a docstring says
that rows pass through whole; there a new column replaces an input column of the same name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows per Arrow batch sent to a worker, and bytes of text a worker treats at once. One text longer than the
#: block forms a block of its own; texts are never cut.
BATCH_ROWS = 1000
BLOCK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_sample(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """The ``n`` rows with the smallest hash of ``columns`` (all rows, if fewer).

    A count sets a bound on the hash that about 1.25 n rows pass, so that only these are sorted, however many rows there are.
    """
    rows = df.withColumn("__hash", F.pmod(F.xxhash64(*columns), F.lit(1 << 40)))
    total = df.count()
    if total > 2 * n:
        rows = rows.filter(F.col("__hash") < int((1.25 * n + 100) / total * (1 << 40)))
    return rows.orderBy("__hash", *columns).limit(n).drop("__hash")


def held_out(id_column: str):
    """Row is held out: crc32 of the id as text, modulo 4, is 2. A null id counts as held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def blocks(sizes: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Cut rows into runs of about ``limit`` bytes; a longer row is a run of its own."""
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def byte_sizes(column: pa.Array) -> np.ndarray:
    """Bytes of each string; null counts 0."""
    import pyarrow.compute as pc

    return np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)


def append_columns(df: DataFrame, text: str, added: StructType,
                   make: Callable[[], Callable[[list], list[pa.Array]]], limit: int = BLOCK_BYTES) -> DataFrame:
    """Add columns computed from a text column, in bounded blocks; rows pass through whole.

    ``make`` runs once per task and returns a function from the list of texts (None for null) to one Arrow array
    per added column. ``limit`` is the bytes of text of a block.
    """
    kept = [c for c in df.columns if c.lower() not in {n.lower() for n in added.names}]
    schema = StructType([*df.select(*[F.col(f"`{c}`") for c in kept]).schema.fields, *added.fields])
    whole = df if text in kept else df.withColumn("__text", F.col(text))
    source = text if text in kept else "__text"
    names = list(added.names)

    def run(batches):
        work = make()
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(source))
            for start, stop in blocks(byte_sizes(column), limit):
                part = batch.slice(start, stop - start)
                arrays = work(column.slice(start, stop - start).to_pylist())
                keep = [part.column(part.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*keep, *arrays], names=[*kept, *names])

    return whole.mapInArrow(run, schema)


def ragged(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array from flat values and row lengths."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def spans_of(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions start, start+1, ... of the given runs, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)

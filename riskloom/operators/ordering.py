"""Global order without a single-task sort: positions, running sums, dense ids, row cut-offs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskloom.session import cut_lineage

RANGE_BUCKETS = 1024


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Inclusive running sums over the total order ``order`` (which must be unique per row).

    Rows are range-partitioned, so each task holds a bounded, contiguous piece however skewed the
    leading sort column is. The pieces are written to the checkpoint folder (their borders must not
    move between the two uses), their totals -- one row per partition -- are prefix-summed and
    broadcast back.
    """
    spark = df.sparkSession
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(
        df.select("*", *[expr.alias(f"_part_{name}") for name, expr in sums.items()])
        .repartitionByRange(pieces, *order).withColumn("_piece", F.spark_partition_id())
    )
    totals = ranged.groupBy("_piece").agg(*[F.sum(f"_part_{n}").alias(f"_total_{n}") for n in sums])
    before = W.orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)  # one row per piece
    offsets = totals.select(
        "_piece", *[F.coalesce(F.sum(f"_total_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in sums])
    inside = W.partitionBy("_piece").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = ranged.join(F.broadcast(offsets), "_piece")
    return out.select(
        *df.columns,
        *[(F.col(f"_before_{n}") + F.sum(f"_part_{n}").over(inside)).alias(n) for n in sums],
    )


def dense_ids(df: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """1-based ids without gaps, in the given order."""
    return running_sums(df, order, {name: F.lit(1).cast("long")})


def row_at(df: DataFrame, position: int, ts: str = "ts_us", tie: str = "transaction_id",
           direct_rows: int = 1_000_000) -> tuple[int, int]:
    """(ts, tie) of the row at 0-based ``position`` in (ts, tie) order.

    Narrows the time and then the tie column by their own ranges: a pass counts ``RANGE_BUCKETS`` equal parts of the
    range, and the part that holds the position is the next range. So ids may be as sparse as they like, and the
    driver sees one count per part. Once the remaining piece is small it is ranked directly.
    """
    piece, offset = df.select(ts, tie), position
    rows = None
    for column in (ts, tie):
        value = F.col(column).cast("long")
        low, high = piece.agg(F.min(value), F.max(value)).first()
        while low < high and (rows is None or rows > direct_rows):
            width = -(-(high - low + 1) // RANGE_BUCKETS)
            part = F.expr(f"cast((cast(`{column}` as decimal(20,0)) - {low}) div {width} as int)")
            counts = sorted(piece.groupBy(part.alias("part")).count().collect())
            for number, rows in counts:  # noqa: B007  rows is that of the part
                if offset < rows:
                    break
                offset -= rows
            low, high = low + number * width, min(high, low + (number + 1) * width - 1)
            piece = piece.filter(value.between(low, high))
        if rows is not None and rows <= direct_rows:
            break
    rank = F.row_number().over(W.orderBy(ts, tie))
    found = piece.withColumn("_rank", rank).filter(F.col("_rank") == offset + 1).first()
    return found[ts], found[tie]


def chronological_split(
    df: DataFrame, train_frac: float = 0.70, val_frac: float = 0.15, ts: str = "ts_us",
    tie: str = "transaction_id", keys: DataFrame | None = None,
) -> DataFrame:
    """Adds ``split`` by row position in time order: train, validation, test.

    ``keys``: the (ts, tie) columns of the same rows from a cheaper source, so that a wide ``df`` is not computed here.
    """
    rows = df if keys is None else keys
    total = rows.count()
    train_end = int(total * train_frac)
    val_end = train_end + int(total * val_frac)
    here = F.struct(F.col(ts), F.col(tie).cast("long"))

    def before(position: int) -> Column:
        if position >= total:
            return F.lit(True)
        cut_ts, cut_tie = row_at(rows, position, ts, tie)
        return here < F.struct(F.lit(cut_ts).cast("long"), F.lit(cut_tie).cast("long"))

    return df.withColumn(
        "split",
        F.when(before(train_end), "train").when(before(val_end), "validation").otherwise("test"),
    )

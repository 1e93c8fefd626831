"""Streams in several micro-batches give what the batch plans give."""

import pytest
from pyspark.sql import functions as F

from riskloom.plans.features import micro_windows, transaction_features
from riskloom.plans.rules import apply_rules
from riskloom.operators.slices import US_PER_DAY, plan_slices
from riskloom.operators.timeline import entity_timeline
from riskloom.streaming.counters import by_slice, velocity_counts
from riskloom.streaming.scorer import start_scoring
from riskloom.streaming.sessions import alert_sessions


@pytest.fixture(scope="module")
def arriving(spark, small, tmp_path_factory):
    """Four files in time order, one per micro-batch."""
    folder = tmp_path_factory.mktemp("stream") / "in"
    for day in (8, 15, 22, 31):
        part = small.txn.filter((F.dayofmonth("day") <= day) & (F.dayofmonth("day") > day - 9 if day == 31 else F.dayofmonth("day") > day - (8 if day == 8 else 7)))
        part.coalesce(1).write.mode("append").parquet(str(folder))
    return lambda: spark.readStream.schema(small.txn.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


COLS = ["transaction_id", "rule_id", "severity", "evidence"]


def test_rule_stream_equals_batch(spark, small, arriving, tmp_path):
    query = start_scoring(arriving(), small, f"{tmp_path}/f", f"{tmp_path}/c")
    query.awaitTermination()
    assert query.lastProgress["batchId"] >= 3
    streamed = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/f").select(COLS).collect()))
    batch = sorted(map(tuple, apply_rules(transaction_features(small)).select(COLS).collect()))
    assert streamed == batch


def test_rule_stream_from_stored_rows(spark, small, tmp_path):
    """Stored rows become the state of the first micro-batch: what arrives then is scored as if all had streamed."""
    stored, new = small.txn.filter(F.dayofmonth("day") <= 15), small.txn.filter(F.dayofmonth("day") > 15)
    new.coalesce(1).write.parquet(f"{tmp_path}/in")
    arriving = spark.readStream.schema(small.txn.schema).parquet(f"{tmp_path}/in")
    query = start_scoring(arriving, small, f"{tmp_path}/f", f"{tmp_path}/c", start=stored)
    query.awaitTermination()
    plan = query._jsq.lastProgress().toString()
    assert "numRowsTotal" in plan
    streamed = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/f").select(COLS).collect()))
    batch = apply_rules(transaction_features(small)).join(new.select("transaction_id"), "transaction_id")
    assert streamed == sorted(map(tuple, batch.select(COLS).collect()))


def test_customers_share_state(spark, small, arriving, tmp_path, monkeypatch):
    """Many customers in two groups, one call and one state value each: the firings are those of the batch."""
    from riskloom.streaming import history

    monkeypatch.setattr(history, "SHARES", 2)
    unknown = history.dealt(spark.createDataFrame([(None,), (7,)], "customer_id long")).collect()
    assert [r.customer_id for r in unknown] == [history.NO_ITEM, 7]
    query = start_scoring(arriving(), small, f"{tmp_path}/f", f"{tmp_path}/c")
    query.awaitTermination()
    customers = query.lastProgress["stateOperators"][0]
    assert small.txn.select("customer_id").distinct().count() > customers["numRowsTotal"]  # values, timers and their index
    streamed = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/f").select(COLS).collect()))
    assert streamed == sorted(map(tuple, apply_rules(transaction_features(small)).select(COLS).collect()))


def test_counter_stream_equals_batch(spark, small, arriving, tmp_path):
    hours = (24 * 60, 72 * 60, 36 * 60)
    query = (velocity_counts(arriving(), "5 days", *hours).writeStream.format("parquet").option("path", f"{tmp_path}/o")
             .option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start())
    query.awaitTermination()
    cols = ["transaction_id", *micro_windows()]
    line = entity_timeline(small.txn, plan_slices(small.txn, "customer_id", US_PER_DAY, whole=True), micro_windows(*hours))
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/o").select(cols).collect())) == sorted(
        map(tuple, line.select(cols).collect()))


def test_hot_customer_spreads_over_slices(spark, tmp_path):
    """Nine tenths of the rows are one customer's: they are dealt to many groups, and the counts are those of the whole line."""
    rows = spark.range(2000).select(
        F.col("id").alias("transaction_id"), F.when(F.col("id") % 10 > 0, 1).otherwise(F.col("id")).alias("customer_id"),
        (F.lit(1_700_000_000_000_000) + F.pmod(F.xxhash64("id"), F.lit(200 * 3_600_000_000))).alias("ts_us"),
        F.when(F.col("id") % 3 == 0, "FAILED").otherwise("APPROVED").alias("status")).withColumn("transaction_ts", F.timestamp_micros("ts_us"))
    groups = by_slice(rows, 3_600_000_000).filter("customer_id = 1").groupBy("slice_no").count().collect()
    assert len(groups) >= 200 and max(g["count"] for g in groups) < 2000 / 20
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    query = (velocity_counts(stream).writeStream.format("parquet").option("path", f"{tmp_path}/o")
             .option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start())
    query.awaitTermination()
    told = rows.collect()
    want = []
    for r in told:
        def count(minutes, failed=False):
            return sum(o.customer_id == r.customer_id and r.ts_us - minutes * 60_000_000 <= o.ts_us < r.ts_us and (not failed or o.status == "FAILED") for o in told)
        want.append((r.transaction_id, count(10), count(60), count(15, True)))
    cols = ["transaction_id", *micro_windows()]
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/o").select(cols).collect())) == sorted(want)


def test_customers_share_groups(spark, tmp_path):
    """Customers of a slice are dealt to a set number of groups, which tell them apart; unknown ones count together."""
    rows = spark.range(600).select(
        F.col("id").alias("transaction_id"), F.when(F.col("id") % 200 > 0, F.col("id") % 200).alias("customer_id"),
        (F.lit(1_700_000_000_000_000) + F.col("id") * 10_000_000).alias("ts_us"), F.lit("FAILED").alias("status")).withColumn(
        "transaction_ts", F.timestamp_micros("ts_us"))
    assert by_slice(rows, 3_600_000_000, 4).groupBy("slice_no", "share").count().count() <= 4 * 4
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    query = (velocity_counts(stream).writeStream.format("parquet").option("path", f"{tmp_path}/o")
             .option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start())
    query.awaitTermination()
    # A customer comes every 2,000 seconds: once in an hour before, never in 10 or 15 minutes.
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/o").select("transaction_id", "customer_id", *micro_windows()).collect()))
    assert got == [(i, i % 200 or None, 0, int(i >= 200), 0) for i in range(600)]


def test_session_of_exactly_the_gap_stays_together(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 01:00:00"), (1, "2024-01-01 02:00:01"), (2, "2024-01-09 00:00:00")]
    df = spark.createDataFrame(rows, "customer_id long, t string").select(
        "customer_id", F.col("t").cast("timestamp").alias("created_at"), F.lit(0.5).alias("combined_score"),
        F.lit(1.0).alias("financial_exposure"))
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    query = (alert_sessions(stream, "1 hour").writeStream.format("parquet").option("path", f"{tmp_path}/o")
             .option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start())
    query.awaitTermination()
    got = sorted((r.customer_id, r.alerts) for r in spark.read.parquet(f"{tmp_path}/o").collect())
    assert got == [(1, 1), (1, 2)]  # customer 2's session is still open

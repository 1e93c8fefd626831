"""Daily baselines and the as-of join against recomputation from strictly earlier rows."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from riskloom.operators.asof import asof_previous_day
from riskloom.operators.baselines import customer_daily, merchant_daily


def test_customer_daily_equals_recomputation(spark, small):
    got = customer_daily(small.txn, 9, 3).toPandas()
    rows = small.txn.toPandas()
    rows["amount"] = rows["amount"].astype(float)
    rows["day"] = pd.to_datetime(rows["day"])
    for r in got.sample(60, random_state=1).itertuples():
        day = pd.Timestamp(r.metric_date)
        own = rows[(rows.customer_id == r.customer_id) & (rows.day <= day)]
        w9, w3 = own[own.day >= day - pd.Timedelta(days=9)], own[own.day >= day - pd.Timedelta(days=3)]
        assert r.txn_count == (own.day == day).sum()
        assert abs(float(r.txn_amount_avg_90d) - w9.amount.mean()) < 0.0051
        if len(w9) > 1:
            assert abs(float(r.txn_amount_stddev_90d) - w9.amount.std()) < 0.0051
        else:
            assert r.txn_amount_stddev_90d is None or np.isnan(float(r.txn_amount_stddev_90d))
        assert r.distinct_merchants_30d == w3.merchant_id.nunique()
        assert r.distinct_devices_30d == w3.device_id.nunique()


def test_merchant_rate_leaves_the_day_out(spark, small):
    got = merchant_daily(small.txn, small.labels).toPandas()
    first = got.sort_values("metric_date").groupby("merchant_id").head(1)
    assert first["avg_txn_amount_90d"].isna().all() and first["chargeback_rate_90d"].isna().all()
    flipped = small.labels.withColumn("is_fraud", ~F.col("is_fraud"))
    last_day = got["metric_date"].max()
    today = merchant_daily(small.txn.filter(F.col("day") == F.lit(last_day)), flipped).toPandas()
    assert today["chargeback_rate_90d"].isna().all()


def test_constant_amounts_have_zero_deviation(spark):
    rows = [(i, 1, 1, 1, dt.date(2024, 1, 1 + i % 5), 49.99) for i in range(20)]
    txn = spark.createDataFrame(rows, "transaction_id long, customer_id long, merchant_id long, device_id long, day date, amount double")
    out = customer_daily(txn.withColumn("amount", F.col("amount").cast("decimal(14,2)"))).toPandas()
    assert {float(v) for v in out["txn_amount_stddev_90d"].dropna()} == {0.0}


def test_asof_takes_latest_earlier_day(spark):
    day = lambda d: dt.date(2024, 1, d)
    daily = spark.createDataFrame([(1, day(1), 10), (1, day(5), 50), (2, day(3), 30)], "k long, day date, v int")
    spine = spark.createDataFrame([(1, day(1)), (1, day(2)), (1, day(5)), (1, day(9)), (2, day(3)), (3, day(4))], "k long, day date")
    got = {(r.k, r.day.day): (r.v, r.matched) for r in asof_previous_day(spine, daily, "k", "day", ["v"]).collect()}
    assert got == {(1, 1): (None, False), (1, 2): (10, True), (1, 5): (10, True), (1, 9): (50, True),
                   (2, 3): (None, False), (3, 4): (None, False)}


def test_changed_windows_are_spans_and_join_without_a_broadcast(spark):
    """A row per key, whatever the length of its windows; a row per key and day would have been broadcast while it compresses well."""
    from riskloom.operators.spans import in_spans, window_spans

    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    changed = spark.createDataFrame([(1, day(0)), (1, day(0)), (1, day(5)), (1, day(6)), (1, day(40)), (2, day(3)), (None, day(1)), (3, None)], "k long, day date")
    spans = window_spans(changed, "k", 2, 3)
    first = (dt.date(2024, 1, 1) - dt.date(1970, 1, 1)).days
    assert {r.k: [(s["first"] - first, s["last"] - first) for s in r.spans] for r in spans.collect()} == {1: [(-2, 9), (38, 43)], 2: [(1, 6)]}
    rows = spark.createDataFrame([(k, day(n)) for k in (1, 2, 4, None) for n in range(50)] + [(1, None)], "k long, d date")
    want = {(1, day(n)) for n in [*range(10), *range(38, 44)]} | {(2, day(n)) for n in range(1, 7)}
    inside = in_spans(rows, spans, "k", "d")
    assert sorted(map(tuple, inside.collect())) == sorted(want)
    assert inside.count() + in_spans(rows, spans, "k", "d", inside=False).count() == rows.count()
    assert "BroadcastHashJoin" not in inside._jdf.queryExecution().executedPlan().toString()

"""Sliced timelines and quantiles against brute force, whole and with hot entities split."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators.quantiles import _standing_counts, affordable, trailing_quantiles_asof
from riskloom.operators.slices import US_PER_DAY, US_PER_HOUR, US_PER_MINUTE, plan_slices
from riskloom.operators.timeline import Trailing, entity_timeline
from riskloom.plans.features import FIRST_OF
from riskloom.sources.star import with_time_parts

WINDOWS = {
    "n10m": Trailing(10 * US_PER_MINUTE), "n60m": Trailing(60 * US_PER_MINUTE), "n2d": Trailing(2 * US_PER_DAY),
    "failed": Trailing(6 * US_PER_HOUR, "status = 'FAILED'"),
}


def hot_rows(n=600, seed=1):
    """One customer and merchant with two thirds of the rows, bursts, gaps, and tied times."""
    rng, rows, at = random.Random(seed), [], 1_704_060_000
    for i in range(n):
        at += rng.choice([0, 0, 1, 30, 400, 4_000, 40_000 if i % 40 == 0 else 5])
        hot = rng.random() < 0.66
        rows.append((i, 1 if hot else rng.randint(2, 6), 1 if hot else rng.randint(2, 4), rng.randint(1, 5), rng.randint(1, 4),
                     dt.datetime.fromtimestamp(at, dt.UTC), rng.randint(1, 30_000) / 100,
                     rng.choice(["FAILED", "APPROVED"])))
    return rows


@pytest.fixture(scope="module")
def txn(spark):
    df = spark.createDataFrame(hot_rows(), (
        "transaction_id long, customer_id long, merchant_id long, device_id long, location_id long, "
        "transaction_ts timestamp, amount double, status string"))
    return with_time_parts(df.withColumn("amount", F.col("amount").cast("decimal(14,2)")))


def brute(rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for r in rows.itertuples():
        own = rows[rows.customer_id == r.customer_id]
        before = own[(own.ts_us < r.ts_us) | ((own.ts_us == r.ts_us) & (own.transaction_id < r.transaction_id))]
        strict = own[own.ts_us < r.ts_us]
        today = strict[strict.day == r.day]

        def trailing(width, part=strict):
            return int((part.ts_us >= r.ts_us - width).sum())

        out.append({
            "transaction_id": r.transaction_id, "prior_count": len(before), "hour_count": int((before.hour == r.hour).sum()),
            "prev_us": before.sort_values(["ts_us", "transaction_id"]).ts_us.iloc[-1] if len(before) else None,
            "first_us": own.ts_us.min() if len(before) else None,
            "today_count": len(today), "today_last_us": today.ts_us.max() if len(today) else None,
            "today_merchants": today.merchant_id.nunique(),
            "n10m": trailing(10 * US_PER_MINUTE), "n60m": trailing(60 * US_PER_MINUTE), "n2d": trailing(2 * US_PER_DAY),
            "failed": trailing(6 * US_PER_HOUR, strict[strict.status == "FAILED"]),
            "first_device": r.device_id not in set(before.device_id),
            "first_location": r.location_id not in set(before.location_id),
            "first_merchant": r.merchant_id not in set(before.merchant_id)})
    return pd.DataFrame(out).sort_values("transaction_id").reset_index(drop=True)


@pytest.mark.parametrize("years_back", [0, 60])  # the second set lies before 1970
@pytest.mark.parametrize("max_rows", [2_000_000, 100, 40, 3])  # nobody, only the hot one, most, all are cut
def test_timeline_equals_brute_force(spark, txn, max_rows, years_back):
    txn = with_time_parts(txn.drop("ts_us", "day", "hour").withColumn(
        "transaction_ts", F.expr(f"transaction_ts - interval {years_back * 365} days")))
    slicing = plan_slices(txn, "customer_id", US_PER_DAY, max_rows, whole=True)
    assert (slicing.splits is None) == (max_rows > 1000)
    got = entity_timeline(txn, slicing, WINDOWS, first_of=FIRST_OF, hours=True).toPandas()
    want = brute(txn.toPandas())
    got = got.sort_values("transaction_id").reset_index(drop=True)[want.columns]
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


@pytest.mark.parametrize("key", ["customer_id", "merchant_id"])
@pytest.mark.parametrize("max_rows", [2_000_000, 50, 5])
def test_trailing_quantiles_equal_brute_force(spark, txn, key, max_rows):
    width = 2 * US_PER_DAY
    slicing = plan_slices(txn, key, width, max_rows)
    got = trailing_quantiles_asof(txn, slicing).toPandas().set_index("transaction_id").sort_index()
    rows, want = txn.toPandas(), {}
    rows["amount"] = rows["amount"].astype(float)
    for _, part in rows.groupby(key):
        part = part.sort_values(["ts_us", "transaction_id"]).reset_index(drop=True)
        for i in range(1, len(part)):
            last = part.ts_us[i - 1]
            window = part.amount[:i][part.ts_us[:i] > last - width]
            want[part.transaction_id[i]] = (*np.quantile(window, [0.25, 0.5, 0.75]), len(window))
    want = pd.DataFrame.from_dict(want, orient="index", columns=["q1", "median", "q3", "prior_count"]).sort_index()
    assert list(got.index) == list(want.index)
    np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(float), atol=1e-9)


def test_future_rows_do_not_change_past_features(spark, txn):
    cut = txn.agg(F.percentile_approx("ts_us", 0.6)).first()[0]
    run = lambda df: entity_timeline(
        df, plan_slices(df, "customer_id", US_PER_DAY, 40, whole=True), WINDOWS, first_of=FIRST_OF, hours=True)
    past = run(txn.filter(F.col("ts_us") < cut)).orderBy("transaction_id").toPandas()
    both = run(txn).filter(F.col("ts_us") < cut).orderBy("transaction_id").toPandas()
    pd.testing.assert_frame_equal(past, both)


def test_standing_values_stay_a_multiple_of_the_rows(spark):
    """Distinct amounts: cut to 20 rows, each of 256 chunks would hold a copy of all 4,000 values. Repeated ones are still cut finely."""
    minute = F.col("id") % 4000
    rows = spark.range(8000).select(
        F.col("id").alias("transaction_id"), F.floor(F.col("id") / 4000).alias("customer_id"), (minute * US_PER_MINUTE).alias("ts_us"),
        F.when(F.col("id") < 4000, minute).otherwise(minute % 10).alias("cents"))
    slicing = affordable(rows, plan_slices(rows, "customer_id", 4 * US_PER_DAY, max_rows=20))
    standing = dict(_standing_counts(slicing.add(rows), "customer_id").groupBy("customer_id").count().collect())
    assert 0 < standing[0] <= 4 * 4000 and 0 < standing[1] <= 4 * 4000
    splits = dict(slicing.splits.select("customer_id", "split").collect())
    assert splits == {0: 2, 1: 256}

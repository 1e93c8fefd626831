"""Shapes of the physical plans: what is read, pushed down, limited, and what must not appear."""

import re

from pyspark.sql import functions as F

from riskloom.operators.baselines import customer_daily, merchant_daily
from riskloom.operators.slices import US_PER_DAY, plan_slices
from riskloom.plans.cases import customer_timeline
from riskloom.plans.features import transaction_features
from riskloom.plans.rules import apply_rules
from riskloom.plans.search import list_transactions
from riskloom.schema import TABLES


def plan_of(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_baseline_scan_is_pruned(small):
    plan = plan_of(customer_daily(small.txn))
    for schema in re.findall(r"ReadSchema: (struct<[^\n]*>)", plan):
        assert "event_type" not in schema
    assert "Python" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_features_and_rules_stay_in_the_jvm_without_pair_joins(small):
    for slicing in (None, plan_slices(small.txn, "customer_id", US_PER_DAY, max_rows=2, whole=True)):
        plan = plan_of(apply_rules(transaction_features(small, slicing=slicing)))
        assert "Python" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_timeline_windows_share_one_exchange(small):
    daily = customer_daily(small.txn), merchant_daily(small.txn, small.labels)
    plan = plan_of(transaction_features(small, customers=daily[0], merchants=daily[1]))
    keyed = re.findall(r"hashpartitioning\(customer_id#\d+L, \d+\)", plan)
    assert plan.count("Window") >= 6 and len(keyed) <= 4  # facts once, the daily tables' windows


def test_search_filter_reaches_the_scan(spark, small, tmp_path):
    path = f"{tmp_path}/t"
    small.txn.write.parquet(path)
    scores = spark.createDataFrame([], TABLES["risk_scores"])
    plan = plan_of(list_transactions(spark.read.parquet(path), scores, customer_id=3, min_amount=20).items)
    assert "EqualTo(customer_id,3)" in plan and "GreaterThanOrEqual(amount" in plan and "TakeOrderedAndProject" in plan


def test_newest_rows_per_customer_are_limited_before_the_shuffle(small):
    scores = small.txn.select("transaction_id", F.lit("LOW").alias("risk_tier"), F.lit(0.0).alias("combined_score"))
    plan = plan_of(customer_timeline(small.txn, scores, small.labels))
    assert plan.count("WindowGroupLimit") >= 2

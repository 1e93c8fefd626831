"""Alerts, cases, the action log and case metrics."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from riskloom.plans import alerts as A, cases as C, search as P
from riskloom.schema import CASE_STATUSES

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
hours = lambda h: T0 + dt.timedelta(hours=h)


@pytest.fixture(scope="module")
def alerts(spark):
    txn = spark.createDataFrame(
        [(1, 7, hours(0), 10.0), (2, 7, hours(0.5), 20.0), (3, 7, hours(3), 30.0), (4, 8, hours(1), 5.0), (5, 8, hours(1), 5.0)],
        "transaction_id long, customer_id long, transaction_ts timestamp, amount double").withColumn(
        "ts_us", F.unix_micros("transaction_ts"))
    scores = spark.createDataFrame(
        [(1, "HIGH", .6), (2, "CRITICAL", .9), (3, "HIGH", .7), (4, "LOW", .1), (5, "HIGH", .5)],
        "transaction_id long, risk_tier string, combined_score double")
    return A.generate_alerts(scores, txn).cache()


def test_alert_groups_and_ids(alerts):
    rows = sorted(alerts.collect(), key=lambda r: r.alert_id)
    assert [r.transaction_id for r in rows] == [1, 2, 5, 3] and [r.alert_id for r in rows] == [1, 2, 3, 4]
    group = {r.transaction_id: r.dedup_group_id for r in rows}
    assert group[1] == group[2] != group[3] and len(set(group.values())) == 3
    assert all(g.startswith("DEDUP-") and len(g) == 18 for g in group.values())


@pytest.mark.parametrize("dense", [True, False])
def test_cases(alerts, dense):
    cases = {r.alert_id: r for r in A.generate_cases(alerts, dense).collect()}
    assert {a: c.status for a, c in cases.items()} == {1: "OPEN", 2: "ESCALATED", 3: "OPEN", 4: "OPEN"}
    assert cases[2].sla_deadline - cases[2].created_at == dt.timedelta(hours=4)
    assert cases[1].sla_deadline - cases[1].created_at == dt.timedelta(hours=24)
    assert sorted(c.case_id for c in cases.values()) == [1, 2, 3, 4]


def test_every_transition(spark):
    pairs = [(s, a) for s in CASE_STATUSES for a in [*C.TRANSITIONS, "ASSIGN", "NONSENSE"]]
    df = spark.createDataFrame(pairs, "s string, a string").withColumn("to", C.next_status(F.col("s"), F.col("a")))
    for r in df.collect():
        assert r["to"] == C.TRANSITIONS.get(r["a"], {}).get(r["s"])


def test_valid_actions(spark):
    df = C.with_valid_actions(spark.createDataFrame([(s,) for s in CASE_STATUSES], "status string"))
    got = {r.status: r.valid_next_actions for r in df.collect()}
    assert got["CLOSED"] == [] and got["CONFIRMED_FRAUD"] == ["CLOSE"]
    assert got["OPEN"] == ["INVESTIGATE", "ESCALATE"]


LOG = [  # case, seq, action; seq decides even where the clock runs backwards
    (1, 1, "ASSIGN"), (1, 2, "INVESTIGATE"), (1, 3, "CLOSE"), (1, 4, "CONFIRM_FRAUD"), (1, 5, "ASSIGN"), (1, 6, "CLOSE"),
    (1, 7, "ESCALATE"), (2, 1, "CONFIRM_FRAUD"), (2, 2, "REOPEN"), (2, 3, "INVESTIGATE"), (99, 1, "INVESTIGATE")]


@pytest.mark.parametrize("block", [1000, 2, 1])
def test_replay(spark, block):
    cases = spark.createDataFrame(
        [(1, "OPEN", None, None, None), (2, "OPEN", None, None, None), (3, "ESCALATED", None, None, None)],
        "case_id long, status string, assigned_investigator string, resolution string, resolved_at timestamp")
    log = spark.createDataFrame(
        [(c, s, a, "me", f"inv{s}" if a == "ASSIGN" else None, None, hours(20 - s)) for c, s, a in LOG],
        "case_id long, seq long, action_type string, performed_by string, investigator string, notes string, performed_at timestamp")
    replayed = C.replay(cases, log, block)
    rejected = {(r.case_id, r.seq): r.reason for r in C.rejected_actions(replayed).collect()}
    assert rejected == {(1, 3): "not valid from status", (1, 7): "not valid from status", (2, 1): "not valid from status",
                        (2, 2): "unknown action", (99, 1): "case not found"}
    state = {r.case_id: r for r in C.case_state(cases, replayed).collect()}
    assert (state[1].status, state[1].resolution, state[1].assigned_investigator) == ("CLOSED", "CONFIRMED_FRAUD", "inv5")
    assert state[1].resolved_at == hours(14).replace(tzinfo=None)
    assert (state[2].status, state[2].resolution) == ("IN_REVIEW", None) and state[3].status == "ESCALATED"
    assert C.audit_rows(replayed).count() == 6


def _cases(spark, rows):
    return spark.createDataFrame(rows, (
        "status string, resolution string, created_at timestamp, resolved_at timestamp, sla_deadline timestamp, "
        "assigned_investigator string, risk_tier string"))


def test_case_metrics(spark):
    df = _cases(spark, [
        ("CLOSED", "CONFIRMED_FRAUD", hours(0), hours(2), hours(4), "a", "CRITICAL"),
        ("CLOSED", "FALSE_POSITIVE", hours(0), hours(30), hours(24), "b", "HIGH"),
        ("OPEN", None, hours(0), None, hours(4), None, "CRITICAL"),
        ("IN_REVIEW", None, hours(0), None, hours(100), "a", "HIGH")])
    rows = {r.risk_tier: r for r in C.case_metrics(df, F.lit(hours(48))).collect()}
    m = rows["ALL"]
    assert (m.total_cases, m.open_cases, m.resolved_cases, m.resolved_cases_breached_sla) == (4, 2, 2, 1)
    assert (m.sla_compliance_rate, m.fraud_confirmation_rate, m.open_cases_already_past_sla) == (0.5, 0.5, 1)
    assert (m.avg_resolution_hours, m.median_resolution_hours) == (16.0, 16.0)
    assert rows["HIGH"].sla_compliance_rate == 0.0 and rows["CRITICAL"].median_resolution_hours == 2.0
    assert {r.assigned_investigator: r.cases for r in C.investigator_workload(df).collect()} == {"a": 2, "b": 1}


def test_case_metrics_with_nothing_resolved(spark):
    df = _cases(spark, [("OPEN", None, hours(0), None, hours(4), None, "HIGH")])
    m = {r.risk_tier: r for r in C.case_metrics(df, F.lit(hours(1))).collect()}["ALL"]
    assert m.sla_compliance_rate is None and m.avg_resolution_hours is None and m.median_resolution_hours is None


def test_sla_flag(spark):
    df = _cases(spark, [
        ("OPEN", None, hours(0), None, hours(4), None, "HIGH"), ("OPEN", None, hours(0), None, hours(9), None, "HIGH"),
        ("CLOSED", None, hours(0), hours(5), hours(4), None, "HIGH"), ("CONFIRMED_FRAUD", None, hours(0), None, hours(1), None, "HIGH")])
    assert [r.b for r in df.select(C.sla_breached(F.lit(hours(5))).alias("b")).collect()] == [True, False, True, False]


def test_pages_and_totals(spark, alerts):
    cases = A.generate_cases(alerts)
    page = P.list_alerts(alerts, cases, risk_tier="HIGH", limit=2, offset=1)
    assert [r.alert_id for r in page.items.collect()] == [1, 3] and page.total.first().total == 3
    assert P.list_cases(cases, alerts, status="ESCALATED").total.first().total == 1
    assert [r.combined_score for r in P.case_queue(cases, alerts).items.collect()] == [.9, .7, .6, .5]


def test_replay_of_one_long_case_is_a_parallel_scan(spark):
    """Thousands of actions of one case, in blocks of 20: the same statuses as one walk over them, also in two runs."""
    rng = random.Random(3)
    names = [*C.TRANSITIONS, C.ASSIGN, "REOPEN"]
    actions = [(1, i, rng.choice(names)) for i in range(3000)] + [(2, 5, "INVESTIGATE"), (2, 9, "CLOSE"), (3, 1, "ESCALATE"), (9, 1, "ESCALATE")]
    log = spark.createDataFrame(actions, "case_id long, seq long, action_type string").select(
        "*", F.lit("x").alias("performed_by"), F.lit("i").alias("investigator"), F.lit("n").alias("notes"),
        F.timestamp_seconds("seq").alias("performed_at")).repartition(6)
    cases = spark.createDataFrame([(1, "OPEN"), (2, "OPEN"), (3, "ESCALATED"), (4, "OPEN")], "case_id long, status string").select(
        "*", F.lit(None).cast("string").alias("assigned_investigator"), F.lit(None).cast("string").alias("resolution"),
        F.lit(None).cast("timestamp").alias("resolved_at"), F.lit(None).cast("long").alias("last_seq"))
    status, want = {1: "OPEN", 2: "OPEN", 3: "ESCALATED", 4: "OPEN"}, {}
    for case, seq, action in sorted(actions):
        before = status.get(case)
        after = before if action == C.ASSIGN and before else C.TRANSITIONS.get(action, {}).get(before)
        want[case, seq] = (before, after)
        if before and after:
            status[case] = after
    got = {(r.case_id, r.seq): (r.previous_status, r.new_status) for r in C.replay(cases, log, block_actions=20).collect()}
    assert got == want
    first, _ = C.advance(cases, log.filter("seq < 1700"), block_actions=20)
    second, again = C.advance(first, log, block_actions=20)
    assert {r.seq for r in again.filter("case_id = 1").collect()} == set(range(1700, 3000))
    assert {r.case_id: r.status for r in second.collect()} == status and second.filter("case_id = 1").first().last_seq == 2999

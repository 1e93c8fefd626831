"""Filtered, ordered, paged lists: transactions, alerts, cases, work queue."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Page:
    """A lazily evaluated page and the count of everything its filters match."""

    items: DataFrame
    total: DataFrame


def _page(matching: DataFrame, order: list[Column], limit: int, offset: int) -> Page:
    items = matching.orderBy(*order)
    if offset:
        items = items.offset(offset)
    return Page(items.limit(limit), matching.agg(F.count("*").alias("total")))


def _where(df: DataFrame, equal: dict[str, object], at_least: dict[str, float] | None = None) -> DataFrame:
    for name, value in equal.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    for name, value in (at_least or {}).items():
        if value is not None:
            df = df.filter(F.col(name) >= value)
    return df


def list_transactions(
    txn: DataFrame, scores: DataFrame, *, customer_id: int | None = None, merchant_id: int | None = None,
    risk_tier: str | None = None, channel: str | None = None, min_amount: float | None = None,
    limit: int = 50, offset: int = 0,
) -> Page:
    """Newest first. Filters on the fact reach its scan; a tier filter makes the outer join inner."""
    facts = _where(txn, {"customer_id": customer_id, "merchant_id": merchant_id, "channel": channel},
                   {"amount": min_amount})
    joined = facts.select(
        "transaction_id", "transaction_uid", "transaction_ts", "customer_id", "merchant_id", "amount", "currency",
        "channel", "status",
    ).join(scores.select("transaction_id", "risk_tier", "combined_score", "ml_component", "rules_component",
                         "behavioral_component"), "transaction_id", "left")
    return _page(_where(joined, {"risk_tier": risk_tier}),
                 [F.col("transaction_ts").desc(), F.col("transaction_id").desc()], limit, offset)


def list_alerts(
    alerts: DataFrame, cases: DataFrame, *, risk_tier: str | None = None, dedup_group_id: str | None = None,
    case_status: str | None = None, limit: int = 50, offset: int = 0,
) -> Page:
    """Highest score first, then newest."""
    picked = _where(alerts, {"risk_tier": risk_tier, "dedup_group_id": dedup_group_id}).select(
        "alert_id", "transaction_id", "customer_id", "risk_tier", "combined_score", "financial_exposure",
        "dedup_group_id", "created_at")
    joined = picked.join(cases.select("alert_id", "case_id", F.col("status").alias("case_status")), "alert_id", "left")
    return _page(_where(joined, {"case_status": case_status}),
                 [F.col("combined_score").desc(), F.col("created_at").desc(), F.col("alert_id").desc()], limit, offset)


def _case_rows(cases: DataFrame, alerts: DataFrame, status, risk_tier, investigator) -> DataFrame:
    alert = _where(alerts, {"risk_tier": risk_tier}).select(
        "alert_id", "risk_tier", "combined_score", "financial_exposure", "transaction_id")
    picked = _where(cases.drop("risk_tier"), {"status": status, "assigned_investigator": investigator})
    return picked.join(alert, "alert_id")


def list_cases(
    cases: DataFrame, alerts: DataFrame, *, status: str | None = None, risk_tier: str | None = None,
    assigned_investigator: str | None = None, limit: int = 50, offset: int = 0,
) -> Page:
    """Newest first."""
    rows = _case_rows(cases, alerts, status, risk_tier, assigned_investigator)
    return _page(rows, [F.col("created_at").desc(), F.col("case_id").desc()], limit, offset)


def case_queue(
    cases: DataFrame, alerts: DataFrame, *, status: str | None = None, risk_tier: str | None = None,
    investigator: str | None = None, limit: int = 200,
) -> Page:
    """Highest score first."""
    rows = _case_rows(cases, alerts, status, risk_tier, investigator)
    return _page(rows, [F.col("combined_score").desc(), F.col("case_id")], limit, 0)


def investigators(cases: DataFrame) -> DataFrame:
    return cases.select("assigned_investigator").filter("assigned_investigator is not null").distinct().orderBy(
        "assigned_investigator")


def risk_detail(scores: DataFrame, firings: DataFrame) -> DataFrame:
    """Score breakdown with nested rule evidence, for every scored transaction."""
    nested = firings.groupBy("transaction_id").agg(F.array_sort(F.collect_list(F.struct(
        "rule_id", "rule_description", "severity", "evidence"))).alias("rules_triggered"))
    return scores.join(nested, "transaction_id", "left")


def transaction_rules(firings: DataFrame, transaction_id: int) -> DataFrame:
    return firings.filter(F.col("transaction_id") == transaction_id).orderBy("rule_id")

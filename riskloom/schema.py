"""Declared schemas of the star model and the closed vocabularies used by the plans."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(14, 2)
SCORE = T.DecimalType(6, 5)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


_L, _S, _D, _TS, _B, _I = (
    T.LongType(), T.StringType(), T.DateType(), T.TimestampType(), T.BooleanType(), T.IntegerType(),
)

TABLES: dict[str, T.StructType] = {
    "dim_customer": _struct(
        customer_id=_L, customer_uid=_S, signup_date=_D, home_country=_S, home_city=_S,
        risk_segment=_S, is_synthetic=_B),
    "dim_merchant": _struct(
        merchant_id=_L, merchant_uid=_S, merchant_name=_S, mcc_code=_S, mcc_description=_S,
        merchant_country=_S, risk_category=_S, is_synthetic=_B),
    "dim_device": _struct(device_id=_L, device_uid=_S, device_type=_S, os=_S),
    "dim_location": _struct(
        location_id=_L, city=_S, country=_S, latitude=T.DecimalType(9, 6), longitude=T.DecimalType(9, 6)),
    "fact_transactions": _struct(
        transaction_id=_L, transaction_uid=_S, customer_id=_L, merchant_id=_L, device_id=_L, location_id=_L,
        transaction_ts=_TS, amount=MONEY, currency=_S, channel=_S, payment_instrument_last4=_S, status=_S),
    "ground_truth_fraud": _struct(
        transaction_id=_L, is_fraud=_B, fraud_typology=_S, is_synthetic_label=_B),
    "fact_customer_daily_metrics": _struct(
        customer_id=_L, metric_date=_D, txn_count=_I, txn_amount_sum=MONEY, txn_amount_avg_90d=MONEY,
        txn_amount_stddev_90d=MONEY, distinct_merchants_30d=_I, distinct_devices_30d=_I),
    "fact_merchant_daily_metrics": _struct(
        merchant_id=_L, metric_date=_D, txn_count=_I, txn_amount_sum=MONEY, avg_txn_amount_90d=MONEY,
        chargeback_rate_90d=T.DecimalType(6, 4)),
    "rules_triggered": _struct(
        transaction_id=_L, rule_id=_S, rule_description=_S, severity=_S, evidence=_S),
    "risk_scores": _struct(
        transaction_id=_L, ml_component=SCORE, rules_component=SCORE, behavioral_component=SCORE,
        exposure_component=SCORE, combined_score=SCORE, risk_tier=_S),
    "fraud_alerts": _struct(
        alert_id=_L, transaction_id=_L, customer_id=_L, risk_tier=_S, combined_score=SCORE,
        financial_exposure=MONEY, dedup_group_id=_S, created_at=_TS),
    "investigation_cases": _struct(
        case_id=_L, alert_id=_L, customer_id=_L, status=_S, assigned_investigator=_S, sla_deadline=_TS,
        resolution=_S, created_at=_TS, resolved_at=_TS),
    "investigation_actions": _struct(
        case_id=_L, seq=_L, action_type=_S, performed_by=_S, notes=_S, performed_at=_TS),
    "model_predictions": _struct(
        transaction_id=_L, model_name=_S, model_version=_S, fraud_probability=SCORE, top_features=_S),
    "model_monitoring_metrics": _struct(
        model_name=_S, model_version=_S, period_start=_D, period_end=_D, precision_at_k=SCORE,
        recall_at_fpr=SCORE, pr_auc=SCORE, psi_score=SCORE, fraud_rate=SCORE),
    "audit_log": _struct(
        entity_type=_S, entity_id=_S, event_type=_S, event_payload=_S, performed_by=_S, performed_at=_TS, case_id=_L, seq=_L),
}

# Closed vocabularies.
CHANNELS = ["CARD_PRESENT", "ECOM", "POS", "ATM", "WALLET"]
STATUSES = ["APPROVED", "DECLINED", "FAILED"]
SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
TIERS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
CASE_STATUSES = ["OPEN", "IN_REVIEW", "ESCALATED", "CONFIRMED_FRAUD", "FALSE_POSITIVE", "CLOSED"]
OPEN_STATUSES = ["OPEN", "IN_REVIEW", "ESCALATED"]
RULE_IDS = [
    "R1_VELOCITY", "R2_AMOUNT_SPIKE", "R3_GEO_IMPOSSIBLE", "R4_FAILED_THEN_LARGE",
    "R5_NEW_DEVICE_NEW_LOCATION", "R6_MERCHANT_DEVIATION", "R7_OFF_HOURS",
]

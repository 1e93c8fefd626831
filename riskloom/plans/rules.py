"""The seven transaction rules as one declarative list of column expressions.

A rule yields a nullable struct; all of them sit in one array column that is filtered and exploded,
so any number of rules costs a single pass. The same list serves batch and streaming. To add a rule,
append a ``Rule`` to the list.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions import haversine_km, severity_for_ratio
from riskloom.functions.scores import severity_ordinal
from riskloom.schema import RULE_IDS

# Default thresholds and descriptions.
VELOCITY_10MIN_TRIGGER = 3
VELOCITY_60MIN_TRIGGER = 6
AMOUNT_ZSCORE_TRIGGER = 4.0
AMOUNT_FALLBACK_MULTIPLIER = 6.0
GEO_MIN_DISTANCE_KM = 800
GEO_MAX_PLAUSIBLE_SPEED_KMH = 900
FAILED_MIN_COUNT = 2
FAILED_AMOUNT_MULTIPLIER = 4.0
MERCHANT_DEVIATION_MULTIPLIER = 3.0
OFF_HOURS_MIN_PRIOR = 10
DESCRIPTIONS = {
    "R1_VELOCITY": "High transaction velocity in a short window",
    "R2_AMOUNT_SPIKE": "Transaction amount is a statistical outlier vs. customer baseline",
    "R2_FALLBACK":
        "Transaction amount is far above customer's limited baseline (insufficient history for z-score)",
    "R3_GEO_IMPOSSIBLE": "Implied travel speed between consecutive transactions exceeds plausible limits",
    "R4_FAILED_THEN_LARGE": "Approved large transaction preceded by repeated failed attempts",
    "R5_NEW_DEVICE_NEW_LOCATION":
        "Transaction from a device and location never seen before for this customer",
    "R6_MERCHANT_DEVIATION": "Transaction amount is far above this merchant's own typical transaction size",
    "R7_OFF_HOURS": "Transaction occurs at an hour of day this customer has never transacted at before",
}


@dataclass(frozen=True)
class Rule:
    """``measure`` is the value the severity is scaled from; evidence columns become typed JSON."""

    rule_id: str
    description: str
    when: Column
    severity: Column
    measure: Column
    evidence: dict[str, Column] = field(default_factory=dict)

    def firing(self) -> Column:
        evidence = F.struct(*[value.alias(name) for name, value in self.evidence.items()])
        return F.when(self.when, F.struct(
            F.lit(self.rule_id).alias("rule_id"),
            F.lit(self.description).alias("rule_description"),
            self.severity.alias("severity"),
            self.measure.cast("double").alias("measure"),
            F.to_json(evidence, {"ignoreNullFields": "false"}).alias("evidence"),
        ))


def _col(name: str) -> Column:
    return F.col(name)


def velocity_rules(short: int = VELOCITY_10MIN_TRIGGER, long: int = VELOCITY_60MIN_TRIGGER) -> list[Rule]:
    n10, n60 = _col("txn_count_last_10min"), _col("txn_count_last_60min")

    def rule(when: Column, count: Column, threshold: int, name: str) -> Rule:
        return Rule("R1_VELOCITY", DESCRIPTIONS["R1_VELOCITY"], when, severity_for_ratio(count, threshold), count,
                    {name: count, "threshold": F.lit(threshold)})

    return [rule(n10 >= short, n10, short, "txn_count_10min"),
            rule((n10 < short) & (n60 >= long), n60, long, "txn_count_60min")]


def amount_rules() -> list[Rule]:
    amount, mean, z = _col("amount"), _col("customer_baseline_avg_90d"), _col("amount_zscore")
    times = amount / mean
    return [
        Rule("R2_AMOUNT_SPIKE", DESCRIPTIONS["R2_AMOUNT_SPIKE"], F.abs(z) >= AMOUNT_ZSCORE_TRIGGER,
             severity_for_ratio(F.abs(z), AMOUNT_ZSCORE_TRIGGER), F.abs(z),
             {"amount": amount, "customer_avg_90d": mean, "zscore": F.bround(z, 2),
              "threshold_zscore": F.lit(AMOUNT_ZSCORE_TRIGGER)}),
        Rule("R2_AMOUNT_SPIKE", DESCRIPTIONS["R2_FALLBACK"],
             z.isNull() & F.when(mean > 0, times >= AMOUNT_FALLBACK_MULTIPLIER).otherwise(False),
             severity_for_ratio(times, AMOUNT_FALLBACK_MULTIPLIER), times,
             {"amount": amount, "customer_avg_90d": mean, "multiplier": F.bround(times, 2),
              "threshold_multiplier": F.lit(AMOUNT_FALLBACK_MULTIPLIER)}),
    ]


def geo_rule() -> Rule:
    hours = (_col("ts_us") - _col("prev_us")) / 3_600_000_000
    km = haversine_km(_col("last_location_lat"), _col("last_location_lon"),
                      _col("current_location_lat"), _col("current_location_lon"))
    speed = km / hours
    # The inner test keeps the division away from rows with no elapsed time.
    moved = F.when((hours > 0) & (km >= GEO_MIN_DISTANCE_KM), speed >= GEO_MAX_PLAUSIBLE_SPEED_KMH).otherwise(False)
    return Rule(
        "R3_GEO_IMPOSSIBLE", DESCRIPTIONS["R3_GEO_IMPOSSIBLE"], moved,
        severity_for_ratio(speed, GEO_MAX_PLAUSIBLE_SPEED_KMH), speed,
        {"distance_km": F.bround(km, 1), "hours_between_txns": F.bround(hours, 2),
         "implied_speed_kmh": F.bround(speed, 1), "threshold_kmh": F.lit(GEO_MAX_PLAUSIBLE_SPEED_KMH)})


def failed_then_large_rule() -> Rule:
    amount, mean, failed = _col("amount"), _col("customer_baseline_avg_90d"), _col("recent_failed_count_15min")
    times = amount / mean
    large = F.when(mean > 0, times >= FAILED_AMOUNT_MULTIPLIER).otherwise(False)
    return Rule(
        "R4_FAILED_THEN_LARGE", DESCRIPTIONS["R4_FAILED_THEN_LARGE"],
        (_col("status") == "APPROVED") & (failed >= FAILED_MIN_COUNT) & large,
        severity_for_ratio(failed, FAILED_MIN_COUNT), failed,
        {"recent_failed_count_15min": failed, "amount": amount, "customer_avg_90d": mean,
         "multiplier": F.bround(times, 2)})


def new_device_location_rule() -> Rule:
    both = _col("is_new_device") & _col("is_new_location")
    return Rule("R5_NEW_DEVICE_NEW_LOCATION", DESCRIPTIONS["R5_NEW_DEVICE_NEW_LOCATION"], both, F.lit("HIGH"),
                F.lit(1.0), {"is_new_device": F.lit(True), "is_new_location": F.lit(True)})


def merchant_rule() -> Rule:
    amount, mean = _col("amount"), _col("merchant_avg_amount_90d")
    times = amount / mean
    return Rule(
        "R6_MERCHANT_DEVIATION", DESCRIPTIONS["R6_MERCHANT_DEVIATION"],
        F.when(mean > 0, times >= MERCHANT_DEVIATION_MULTIPLIER).otherwise(False),
        severity_for_ratio(times, MERCHANT_DEVIATION_MULTIPLIER), times,
        {"amount": amount, "merchant_avg_90d": mean, "multiplier": F.bround(times, 2)})


def off_hours_rule() -> Rule:
    prior, here = _col("total_prior_txns"), _col("txns_at_this_hour")
    return Rule(
        "R7_OFF_HOURS", DESCRIPTIONS["R7_OFF_HOURS"], (prior >= OFF_HOURS_MIN_PRIOR) & (here == 0),
        F.lit("MEDIUM"), prior,
        {"transaction_hour": _col("hour"), "txns_at_this_hour_historically": F.lit(0),
         "total_prior_transactions": prior})


def default_rules(**velocity: int) -> list[Rule]:
    return [*velocity_rules(**velocity), *amount_rules(), geo_rule(), failed_then_large_rule(),
            new_device_location_rule(), merchant_rule(), off_hours_rule()]


def with_firings(features: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Adds ``firings``: the array of rule structs that fired, in rule order."""
    rules = rules if rules is not None else default_rules()
    return features.withColumn("firings", F.array_compact(F.array(*[r.firing() for r in rules])))


def apply_rules(features: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Long frame of firings: transaction_id, rule_id, rule_description, severity, measure, evidence."""
    return with_firings(features, rules).select("transaction_id", F.inline("firings"))


# Keys every rule's evidence may carry; decoding yields null for the keys a rule does not use.
EVIDENCE_SCHEMA = """
    amount double, customer_avg_90d double, zscore double, threshold_zscore double, multiplier double,
    threshold_multiplier double, distance_km double, hours_between_txns double, implied_speed_kmh double,
    threshold_kmh double, recent_failed_count_15min long, is_new_device boolean, is_new_location boolean,
    merchant_avg_90d double, transaction_hour long, txns_at_this_hour_historically long,
    total_prior_transactions long, txn_count_10min long, txn_count_60min long, threshold long
"""


def decode_evidence(firings: DataFrame) -> DataFrame:
    """Evidence JSON back to typed columns; an already parsed struct is left alone."""
    if firings.schema["evidence"].dataType.typeName() == "string":
        firings = firings.withColumn("evidence", F.from_json("evidence", EVIDENCE_SCHEMA))
    return firings


def firing_aggregates(firings: Column, rule_ids: list[str] | None = None) -> list[Column]:
    """Per-transaction columns from the ``firings`` array: count, max severity, one flag per rule."""
    ids = rule_ids or RULE_IDS
    ordinals = F.transform(firings, lambda f: severity_ordinal(f["severity"]))
    fired = F.transform(firings, lambda f: f["rule_id"])
    return [
        F.size(firings).cast("long").alias("rules_fired_count"),
        F.coalesce(F.array_max(ordinals), F.lit(-1)).cast("long").alias("max_rule_severity"),
        *[F.array_contains(fired, rid).alias(f"rule_fired_{rid}") for rid in ids],
    ]


def firing_aggregates_of_table(firings: DataFrame) -> DataFrame:
    """The same from a stored long table of firings: one grouped pass, rule ids are fixed."""
    return firings.groupBy("transaction_id").agg(
        F.count("*").alias("rules_fired_count"),
        F.max(severity_ordinal(F.col("severity"))).cast("long").alias("max_rule_severity"),
        *[F.max(F.col("rule_id") == rid).alias(f"rule_fired_{rid}") for rid in RULE_IDS],
    )


def run_summary(firings: DataFrame, txn: DataFrame) -> DataFrame:
    """Firings per rule with the number and share of flagged transactions overall."""
    flagged = firings.groupBy("transaction_id").agg(F.count("*").alias("n"))
    totals = flagged.agg(F.count("*").alias("flagged_transactions")).crossJoin(
        txn.agg(F.count("*").alias("transactions")))
    return firings.groupBy("rule_id").agg(F.count("*").alias("firings")).crossJoin(F.broadcast(totals)).withColumn(
        "flagged_share", F.try_divide("flagged_transactions", "transactions"))


def label_quality(firings: DataFrame, labelled_txn: DataFrame) -> DataFrame:
    """Recall and precision against labels, per rule and overall (rule_id ALL)."""
    flags = labelled_txn.select("transaction_id", "is_fraud")
    hits = firings.select("transaction_id", "rule_id").distinct()
    hits = hits.unionByName(hits.select("transaction_id").distinct().withColumn("rule_id", F.lit("ALL")))
    per_rule = hits.join(flags, "transaction_id").groupBy("rule_id").agg(
        F.count("*").alias("flagged"), F.count_if("is_fraud").alias("caught"))
    positives = flags.agg(F.count_if("is_fraud").alias("positives"))
    return per_rule.crossJoin(F.broadcast(positives)).select(
        "rule_id", "flagged", "caught", F.try_divide("caught", "positives").alias("recall"),
        F.try_divide("caught", "flagged").alias("precision"))

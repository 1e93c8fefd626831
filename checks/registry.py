"""Registered queries with their DuckDB oracles.

Rounding: doubles to 4 digits (money 2) on both sides; times as text in UTC.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from checks import sql_blocks as S
from checks.fixtures import Workbench, workbench
from riskloom.functions import haversine_km, implied_speed_kmh
from riskloom.operators.asof import asof_previous_day
from riskloom.operators.baselines import customer_daily, merchant_daily
from riskloom.operators.ordering import chronological_split
from riskloom.operators.slices import US_PER_DAY, plan_slices
from riskloom.plans import alerts as A, cases as C, evaluation as E, exposure as X, quality as Q, reports as R, rules as U, search as P
from riskloom.plans.anomaly import AnomalySlices, frequency_windows, statistical_features
from riskloom.plans.features import micro_windows, transaction_features
from riskloom.plans.matrix import BOOLEAN, CATEGORICAL, NUMERIC
from riskloom.plans.scoring import tier_fraud_check
from riskloom.schema import RULE_IDS
from riskloom.sources import driver_view
from riskloom.sources.star import location_scan_report

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, ctes: str = "", sql: str | None = None):
    """Registers fn(workbench) under ``name``; ``sql`` follows the shared CTEs."""
    def register(fn: Callable[[Workbench], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(workbench(spark, sf_dir))
        if sql is not None:
            # DuckDB's count_if is a HUGEINT, count is a BIGINT like Spark's.
            text = (f"WITH {ctes} " if ctes else "") + sql
            ORACLES[name] = text.replace("count_if(", "count(*) FILTER (WHERE ")
        return fn
    return register


def r4(col: Column | str, name: str | None = None, digits: int = 4) -> Column:
    out = F.round(F.col(col).cast("double") if isinstance(col, str) else col.cast("double"), digits)
    # Rounding a tiny negative gives -0.0, which hashes apart from 0.0.
    out = out + F.lit(0.0)
    return out.alias(name or col) if (name or isinstance(col, str)) else out


def ts_text(col: Column | str, name: str) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)


def d4(expr: str, name: str, digits: int = 4) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {name}"


def t6(expr: str, name: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f') AS {name}"


# ---------------------------------------------------------------- scans, sources, sinks
@query("transaction_scan", S.TXN, f"""
    SELECT transaction_id, customer_id, merchant_id, device_id, location_id, {t6('ts', 'transaction_ts')},
           {d4('amount', 'amount', 2)}, channel, status, hour, strftime(day, '%Y-%m-%d') AS day,
           {d4('lat', 'current_lat')}, {d4('lon', 'current_lon')} FROM txn""")
def transaction_scan(b):
    from riskloom.sources.star import located
    return located(b.star).select(
        "transaction_id", "customer_id", "merchant_id", "device_id", "location_id",
        ts_text("transaction_ts", "transaction_ts"), r4("amount", digits=2), "channel", "status", "hour",
        F.date_format("day", "yyyy-MM-dd").alias("day"), r4("current_location_lat", "current_lat"),
        r4("current_location_lon", "current_lon"))


@query("location_scan_report", S.TXN, """
    SELECT count(*) AS rows_read, count(n_nationkey) AS rows_kept, count(*) - count(n_nationkey) AS rows_dropped
    FROM txn LEFT JOIN nation ON n_nationkey = location_id""")
def _location_scan(b):
    return location_scan_report(b.star)


@query("labels_outer_join", S.TXN, """
    SELECT is_fraud, fraud_typology, count(*) AS n FROM txn GROUP BY ALL""")
def _labels(b):
    both = b.labelled.join(b.star.labels.select("transaction_id", "fraud_typology"), "transaction_id", "left")
    return both.groupBy("is_fraud", "fraud_typology").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- daily baselines
def _cd_out(df):
    return df.select(
        "customer_id", F.date_format("metric_date", "yyyy-MM-dd").alias("metric_date"),
        F.col("txn_count").cast("long").alias("txn_count"), r4("txn_amount_sum", digits=2),
        r4("txn_amount_avg_90d", digits=2), r4("txn_amount_stddev_90d", digits=2),
        F.col("distinct_merchants_30d").cast("long").alias("distinct_merchants_30d"),
        F.col("distinct_devices_30d").cast("long").alias("distinct_devices_30d"))


_CD_SQL = f"""
    SELECT customer_id, strftime(metric_date, '%Y-%m-%d') AS metric_date, txn_count,
           {d4('sum_cents / 100', 'txn_amount_sum', 2)}, {d4('avg90', 'txn_amount_avg_90d', 2)},
           {d4('std90', 'txn_amount_stddev_90d', 2)}, dm30 AS distinct_merchants_30d, dd30 AS distinct_devices_30d
    FROM cd"""


@query("customer_daily_metrics", S.TXN + "," + S.customer_daily(), _CD_SQL)
def _customer_daily(b):
    return _cd_out(customer_daily(b.star.txn))


@query("customer_daily_metrics_stored_twice", S.TXN + "," + S.customer_daily(), _CD_SQL)
def _customer_daily_stored(b):
    """Written by day twice and read back: a day is replaced, never doubled."""
    from riskloom.sources import sinks
    path = f"{b.run_folder('daily')}/fact_customer_daily_metrics"
    for _ in range(2):
        sinks.upsert_days(customer_daily(b.star.txn), path)
    return _cd_out(b.spark.read.parquet(path))


@query("facts_stored_clustered", S.TXN, f"""
    SELECT transaction_id, customer_id, merchant_id, {t6('ts', 'transaction_ts')}, {d4('amount', 'amount', 2)}, channel, status FROM txn""")
def _facts_clustered(b):
    """Stored by a space-filling key of customer and time, with bloom filters on ids, and read back whole."""
    from riskloom.sources import sinks
    path = f"{b.run_folder('facts')}/fact_transactions"
    known = b.star.txn.select("transaction_id", "customer_id", "merchant_id", "transaction_ts", "amount", "channel", "status")
    sinks.clustered_refresh(known, path, ["customer_id", "transaction_ts"], ["transaction_id", "merchant_id"])
    return b.spark.read.schema(known.schema).parquet(path).withColumns({"transaction_ts": ts_text("transaction_ts", "t"), "amount": r4("amount", digits=2)})


@query("baseline_refresh_report", S.TXN, """
    SELECT count(DISTINCT (customer_id, day)) AS customer_rows, count(DISTINCT (merchant_id, day)) AS merchant_rows FROM txn""")
def _refresh_report(b):
    from riskloom.sources import sinks
    return sinks.refresh_baselines(b.spark, lambda: customer_daily(b.star.txn), lambda: merchant_daily(b.star.txn, b.star.labels),
                                   b.run_folder("refresh")).drop("elapsed_seconds")


def _changed_days(b, table):
    """Stored without every 97th transaction, which then comes late: only the days that it touches are computed anew."""
    from riskloom import jobs
    from riskloom.sources import sinks
    late, root = F.col("transaction_id") % 97 == 5, b.run_folder("changed")
    early = b.star.txn.filter(~late)
    sinks.refresh_baselines(b.spark, lambda: customer_daily(early), lambda: merchant_daily(early, b.star.labels), root)
    jobs.refresh_changed_days(b.spark, b.star, b.star.txn.filter(late), root)
    return b.spark.read.parquet(f"{root}/fact_{table}_daily_metrics")


@query("customer_daily_metrics_changed_days", S.TXN + "," + S.customer_daily(), _CD_SQL)
def _customer_daily_changed(b):
    return _cd_out(_changed_days(b, "customer"))


@query("customer_daily_metrics_9d_3d", S.TXN + "," + S.customer_daily(amount_days=9, distinct_days=3), _CD_SQL)
def _customer_daily_short(b):
    return _cd_out(customer_daily(b.star.txn, 9, 3))


ORDERS = """
ord AS (
  SELECT o_orderkey AS transaction_id, o_custkey AS customer_id, o_orderkey % 50 AS merchant_id,
         o_custkey * 4 + o_orderkey % 3 AS device_id, o_orderdate AS ts, CAST(o_orderdate AS DATE) AS day,
         CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)"""


@query("customer_daily_metrics_orders", ORDERS + "," + S.customer_daily("ord"), _CD_SQL)
def _customer_daily_orders(b):
    """Sparse series over years: most 90-day windows start inside the data."""
    return _cd_out(customer_daily(driver_view.order_series(b.spark, b.sf_dir)))


_MD_SQL = f"""
    SELECT merchant_id, strftime(metric_date, '%Y-%m-%d') AS metric_date, txn_count,
           {d4('sum_cents / 100', 'txn_amount_sum', 2)}, {d4('avg90', 'avg_txn_amount_90d', 2)},
           {d4('rate90', 'chargeback_rate_90d')} FROM md"""


def _md_out(df):
    return df.select(
        "merchant_id", F.date_format("metric_date", "yyyy-MM-dd").alias("metric_date"),
        F.col("txn_count").cast("long").alias("txn_count"), r4("txn_amount_sum", digits=2),
        r4("avg_txn_amount_90d", digits=2), r4("chargeback_rate_90d"))


LARGE = """
ord AS (
  SELECT o_orderkey AS transaction_id, o_custkey AS customer_id, o_orderkey % 50 AS merchant_id,
         o_custkey * 4 + o_orderkey % 3 AS device_id, o_orderdate AS ts, CAST(o_orderdate AS DATE) AS day,
         CAST(1234567891 + CASE WHEN o_custkey % 2 = 0 THEN 0 ELSE o_orderkey % 3 END AS BIGINT) AS cents FROM orders)"""


@query("customer_daily_metrics_large_amounts", LARGE + "," + S.customer_daily("ord"), _CD_SQL)
def _customer_daily_large(b):
    """Payments of 12,345,678.91, equal for even customers and up to two cents apart for odd ones."""
    orders = driver_view.order_series(b.spark, b.sf_dir)
    apart = F.when(F.col("customer_id") % 2 == 0, 0).otherwise(F.col("transaction_id") % 3)
    return _cd_out(customer_daily(orders.withColumn("amount", ((F.lit(1234567891) + apart) / 100).cast("decimal(14,2)"))))


@query("quantiles_of_numbers_only", "", """
    WITH v AS (SELECT CAST(o_totalprice AS DOUBLE) AS x FROM orders WHERE o_orderkey % 7 > 2)
    SELECT CAST(0.25 AS DOUBLE) AS q, round(quantile_cont(x, 0.25), 4) AS value FROM v UNION ALL
    SELECT 0.5, round(quantile_cont(x, 0.5), 4) FROM v UNION ALL SELECT 0.99, round(quantile_cont(x, 0.99), 4) FROM v""")
def _quantiles_finite(b):
    """Column with nulls, NaN and infinities, by histogram narrowing."""
    from riskloom.operators.quantile_cut import exact_quantiles
    price, kind = F.col("amount").cast("double"), F.col("transaction_id") % 7
    odd = F.when(kind == 0, float("nan")).when(kind == 1, float("inf")).when(kind == 2, None).otherwise(price)
    qs = [0.25, 0.5, 0.99]
    values = exact_quantiles(driver_view.order_series(b.spark, b.sf_dir).select(odd.alias("x")), ["x"], qs, direct_rows=0)["x"]
    return b.spark.createDataFrame([(q, round(v, 4)) for q, v in zip(qs, values)], "q double, value double")


@query("merchant_daily_metrics", S.TXN + "," + S.merchant_daily(), _MD_SQL)
def _merchant_daily(b):
    return _md_out(merchant_daily(b.star.txn, b.star.labels))


@query("merchant_daily_metrics_9d", S.TXN + "," + S.merchant_daily(9), _MD_SQL)
def _merchant_daily_short(b):
    return _md_out(merchant_daily(b.star.txn, b.star.labels, 9))


@query("customer_baseline_asof_orders", ORDERS + "," + S.customer_daily("ord"), f"""
    SELECT o.transaction_id, o.customer_id, {d4('c.avg90', 'avg_90d', 2)}, {d4('c.std90', 'stddev_90d', 2)},
           c.metric_date IS NOT NULL AS matched
    FROM ord o ASOF LEFT JOIN cd c ON o.customer_id = c.customer_id AND o.day > c.metric_date""")
def _asof_orders(b):
    txn = driver_view.order_series(b.spark, b.sf_dir)
    daily = customer_daily(txn).withColumnRenamed("metric_date", "day")
    base = asof_previous_day(txn, daily, "customer_id", "day", ["txn_amount_avg_90d", "txn_amount_stddev_90d"])
    return txn.join(base, ["customer_id", "day"], "left").select(
        "transaction_id", "customer_id", r4("txn_amount_avg_90d", "avg_90d", 2),
        r4("txn_amount_stddev_90d", "stddev_90d", 2), "matched")


@query("merchant_baseline_asof", S.TXN + "," + S.merchant_daily(), f"""
    SELECT t.transaction_id, t.merchant_id, {d4('m.avg90', 'merchant_avg_90d', 2)}, {d4('m.rate90', 'merchant_rate_90d')},
           m.metric_date IS NOT NULL AS matched
    FROM txn t ASOF LEFT JOIN md m ON t.merchant_id = m.merchant_id AND t.day > m.metric_date""")
def _asof_merchant(b):
    daily = merchant_daily(b.star.txn, b.star.labels).withColumnRenamed("metric_date", "day")
    base = asof_previous_day(b.star.txn, daily, "merchant_id", "day", ["avg_txn_amount_90d", "chargeback_rate_90d"])
    return b.star.txn.join(base, ["merchant_id", "day"], "left").select(
        "transaction_id", "merchant_id", r4("avg_txn_amount_90d", "merchant_avg_90d", 2),
        r4("chargeback_rate_90d", "merchant_rate_90d"), "matched")


# ---------------------------------------------------------------- point-in-time features
_FEATURES_SQL = (S.FEATURES + """,
    today AS (
      SELECT t.transaction_id, count(DISTINCT u.merchant_id) AS today_m
      FROM txn t LEFT JOIN txn u ON u.customer_id = t.customer_id AND u.day = t.day AND u.ts_us < t.ts_us
      GROUP BY 1)""", f"""
    SELECT transaction_id, {d4('avg90', 'customer_baseline_avg_90d', 2)}, {d4('std90', 'customer_baseline_stddev_90d', 2)},
      dm30 AS customer_distinct_merchants_30d, dd30 AS customer_distinct_devices_30d, {d4('z', 'amount_zscore')},
      {d4('m_avg90', 'merchant_avg_amount_90d', 2)}, {d4('m_rate90', 'merchant_chargeback_rate_90d')},
      today_n AS txn_count_today_so_far, today_m AS distinct_merchants_today, {d4('since_s', 'seconds_since_last_txn', 6)},
      n10 AS txn_count_last_10min, n60 AS txn_count_last_60min, f15 AS recent_failed_count_15min,
      new_device AS is_new_device, new_location AS is_new_location, new_merchant AS is_first_time_at_merchant,
      last_location AS last_location_id, {d4('last_lat', 'last_location_lat')}, {d4('last_lon', 'last_location_lon')},
      {t6('make_timestamp(last_us)', 'last_txn_ts_any')}, {d4('lat', 'current_location_lat')},
      {d4('lon', 'current_location_lon')}, hour_prior AS txns_at_this_hour, prior AS total_prior_txns,
      has_history AS has_sufficient_history
    FROM feat JOIN today USING (transaction_id)""")


@query("point_in_time_features", *_FEATURES_SQL)
def _features(b):
    return _features_out(b.features)


@query("point_in_time_features_split_slices", *_FEATURES_SQL)
def _features_split(b):
    """Every customer with more than two rows on a day counts as hot: slices shorter than a day."""
    hot = plan_slices(b.star.txn, "customer_id", US_PER_DAY, max_rows=2, whole=True)
    return _features_out(transaction_features(b.star, slicing=hot))


def _features_out(df):
    rounded = {"customer_baseline_avg_90d": 2, "customer_baseline_stddev_90d": 2, "merchant_avg_amount_90d": 2,
               "amount_zscore": 4, "merchant_chargeback_rate_90d": 4, "seconds_since_last_txn": 6,
               "last_location_lat": 4, "last_location_lon": 4, "current_location_lat": 4, "current_location_lon": 4}
    from riskloom.plans.features import FEATURES
    return df.select("transaction_id", *[
        r4(f, digits=rounded[f]) if f in rounded else ts_text(f, f) if f == "last_txn_ts_any" else F.col(f)
        for f in FEATURES])


_WIDE = micro_windows(24 * 60, 3 * 24 * 60, 24 * 60)


@query("trailing_counts_wide", S.TXN + "," + S.customer_daily() + "," + S.merchant_daily() + "," + S.features(1440, 4320, 1440), """
    SELECT transaction_id, n10 AS count_24h, n60 AS count_72h, f15 AS failed_24h FROM feat""")
def _wide_counts(b):
    """Windows longer than a slice, so the carries between slices do the work; customers with few rows stay whole."""
    from riskloom.operators.timeline import entity_timeline
    from riskloom.sources.star import located
    sliced = plan_slices(b.star.txn, "customer_id", US_PER_DAY, max_rows=5, whole=True)
    line = entity_timeline(located(b.star), sliced, _WIDE)
    return line.select("transaction_id", F.col("txn_count_last_10min").alias("count_24h"),
                       F.col("txn_count_last_60min").alias("count_72h"),
                       F.col("recent_failed_count_15min").alias("failed_24h"))


# ---------------------------------------------------------------- rules
@query("rule_firings", S.FIRED, f"""
    SELECT transaction_id, rule_id, severity, {d4('measure', 'measure')} FROM fired""")
def _firings(b):
    return b.firings.select("transaction_id", "rule_id", "severity", r4("measure"))


@query("trailing_counts_before_1970", S.TXN + "," + S.customer_daily() + "," + S.merchant_daily() + "," + S.features(1440, 4320, 1440), """
    SELECT transaction_id, n10 AS count_24h, n60 AS count_72h, f15 AS failed_24h, hour_prior AS hour_count, prior AS prior_count FROM feat""")
def _early_counts(b):
    """The same times 25,000 days earlier: counts do not depend on the epoch. Customers above 40 rows are cut."""
    from riskloom.operators.timeline import entity_timeline
    from riskloom.sources.star import located, with_time_parts
    early = located(b.star).drop("ts_us", "day", "hour").withColumn("transaction_ts", F.expr("transaction_ts - interval 25000 days"))
    txn = with_time_parts(early)
    line = entity_timeline(txn, plan_slices(txn, "customer_id", US_PER_DAY, max_rows=40, whole=True), _WIDE, hours=True)
    return line.select("transaction_id", F.col("txn_count_last_10min").alias("count_24h"),
                       F.col("txn_count_last_60min").alias("count_72h"), F.col("recent_failed_count_15min").alias("failed_24h"),
                       "hour_count", "prior_count")


@query("rule_firings_velocity_24h", S.TXN + "," + S.customer_daily() + "," + S.merchant_daily() + ","
       + S.features(1440, 4320, 1440) + "," + S.firings(6, 12), f"""
    SELECT transaction_id, rule_id, severity, {d4('measure', 'measure')} FROM fired
    WHERE rule_id IN ('R1_VELOCITY', 'R4_FAILED_THEN_LARGE')""")
def _firings_wide(b):
    """Velocity and failed-then-large with day-long windows: with minutes they never fire here."""
    feats = transaction_features(b.star, slicing=b.slices.customer_days, windows=_WIDE)
    rules = [*U.velocity_rules(6, 12), U.failed_then_large_rule()]
    return U.apply_rules(feats, rules).select("transaction_id", "rule_id", "severity", r4("measure"))


@query("rule_evidence_decoded", S.FIRED, f"""
    SELECT f.transaction_id, f.rule_id,
      CASE WHEN f.rule_id IN ('R2_AMOUNT_SPIKE', 'R4_FAILED_THEN_LARGE', 'R6_MERCHANT_DEVIATION') THEN amount END AS amount,
      CASE WHEN f.rule_id IN ('R2_AMOUNT_SPIKE', 'R4_FAILED_THEN_LARGE') THEN round(avg90, 2) + 0.0 END AS customer_avg_90d,
      CASE WHEN f.rule_id = 'R6_MERCHANT_DEVIATION' THEN round(m_avg90, 2) + 0.0 END AS merchant_avg_90d,
      CASE WHEN f.rule_id = 'R7_OFF_HOURS' THEN hour END AS transaction_hour,
      CASE WHEN f.rule_id = 'R7_OFF_HOURS' THEN prior END AS total_prior_transactions,
      CASE WHEN f.rule_id = 'R5_NEW_DEVICE_NEW_LOCATION' THEN true END AS is_new_device,
      CASE WHEN f.rule_id = 'R3_GEO_IMPOSSIBLE' THEN 900.0 END AS threshold_kmh
    FROM fired f JOIN geo USING (transaction_id)""")
def _evidence(b):
    e = U.decode_evidence(b.firings)
    return e.select("transaction_id", "rule_id", "evidence.amount", r4("evidence.customer_avg_90d", "customer_avg_90d", 2),
                    r4("evidence.merchant_avg_90d", "merchant_avg_90d", 2), "evidence.transaction_hour",
                    "evidence.total_prior_transactions", "evidence.is_new_device", "evidence.threshold_kmh")


_FLAGS_SQL = ", ".join(f"bool_or(rule_id = '{r}') AS rule_fired_{r}" for r in RULE_IDS)


@query("rule_firing_aggregates", S.FIRED, f"""
    SELECT transaction_id, count(*) AS rules_fired_count,
      max(CASE severity WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HIGH' THEN 2 ELSE 3 END)::BIGINT AS max_rule_severity,
      {_FLAGS_SQL} FROM fired GROUP BY 1""")
def _firing_aggregates(b):
    return U.firing_aggregates_of_table(b.firings)


@query("rule_run_summary", S.FIRED, f"""
    SELECT rule_id, count(*) AS firings, any_value(x) AS flagged_transactions, any_value(n) AS transactions,
           {d4('any_value(x) / any_value(n)', 'flagged_share')}
    FROM fired, (SELECT count(DISTINCT transaction_id) AS x FROM fired), (SELECT count(*) AS n FROM txn) GROUP BY 1""")
def _rule_summary(b):
    return U.run_summary(b.firings, b.star.txn).withColumn("flagged_share", r4("flagged_share"))


@query("rule_label_quality", S.FIRED, f"""
    SELECT rule_id, count(*) AS flagged, count_if(is_fraud) AS caught,
      {d4('count_if(is_fraud) / any_value(p)', 'recall')}, {d4('count_if(is_fraud) / count(*)', 'precision')}
    FROM (SELECT DISTINCT transaction_id, rule_id FROM fired UNION SELECT transaction_id, 'ALL' FROM fired)
    JOIN txn USING (transaction_id), (SELECT count_if(is_fraud) AS p FROM txn) GROUP BY 1""")
def _label_quality(b):
    return U.label_quality(b.firings, b.labelled).select("rule_id", "flagged", "caught", r4("recall"), r4("precision"))


# ---------------------------------------------------------------- statistics
_STAT_SQL = f"""
    SELECT transaction_id, n7 AS count_7d_prior, n90 AS count_90d_prior, {d4('customer_q1', 'customer_q1')},
      {d4('customer_median', 'customer_median')}, {d4('customer_q3', 'customer_q3')}, customer_n AS customer_prior_count,
      {d4('merchant_q1', 'merchant_q1')}, {d4('merchant_median', 'merchant_median')}, {d4('merchant_q3', 'merchant_q3')},
      merchant_n AS merchant_prior_count, {d4('customer_iqr', 'customer_amount_iqr_score')},
      {d4('merchant_iqr', 'merchant_amount_iqr_score')}, {d4('freq_z', 'frequency_deviation_zscore')},
      {d4('behavioral', 'behavioral_anomaly_score')} FROM stat"""


def _stat_out(df):
    doubles = ["customer_q1", "customer_median", "customer_q3", "merchant_q1", "merchant_median", "merchant_q3",
               "customer_amount_iqr_score", "merchant_amount_iqr_score", "frequency_deviation_zscore",
               "behavioral_anomaly_score"]
    return df.select("transaction_id", "count_7d_prior", "count_90d_prior", "customer_prior_count",
                     "merchant_prior_count", *[r4(c) for c in doubles])


@query("statistical_features", S.TXN + "," + S.stats(), _STAT_SQL)
def _stats(b):
    return _stat_out(statistical_features(b.star, slices=b.slices))


@query("statistical_features_9d_3d", S.TXN + "," + S.stats(9, 3), _STAT_SQL)
def _stats_short(b):
    """Windows of 9 and 3 days, so rows leave the windows all the time."""
    return _stat_out(statistical_features(
        b.star, slices=AnomalySlices.plan(b.star, window_days=9), windows=frequency_windows(3, 9)))


@query("statistical_features_9d_3d_split_chunks", S.TXN + "," + S.stats(9, 3), _STAT_SQL)
def _stats_split(b):
    """Customers and merchants with more than 20 rows in a window are cut into shorter chunks."""
    slices = AnomalySlices.plan(b.star, window_days=9, max_rows=20)
    return _stat_out(statistical_features(b.star, slices=slices, windows=frequency_windows(3, 9)))


# ---------------------------------------------------------------- matrix and scores
@query("feature_matrix", S.SCORES, f"""
    SELECT b.transaction_id, b.is_fraud, b.fraud_typology, {d4('b.amount', 'amount', 2)}, {d4('b.z', 'amount_zscore')},
      b.dm30 AS distinct_merchants_30d, b.dd30 AS distinct_devices_30d, {d4('b.customer_iqr', 'customer_amount_iqr_score')},
      {d4('b.merchant_iqr', 'merchant_amount_iqr_score')}, {d4('b.freq_z', 'frequency_deviation_zscore')}, b.hour,
      b.fired_n AS rules_fired_count, CAST(b.max_sev AS BIGINT) AS max_rule_severity, b.new_device AS is_new_device,
      b.new_location AS is_new_location, b.new_merchant AS is_first_time_at_merchant, b.channel, b.status,
      CASE WHEN b.customer_id % 20 = 0 THEN 'WATCHLIST' WHEN b.customer_id % 20 = 1 THEN 'VIP' ELSE 'STANDARD' END
        AS customer_risk_segment,
      CASE WHEN b.merchant_id % 12 = 0 THEN 'HIGH_RISK' ELSE 'STANDARD' END AS merchant_risk_category, b.split
    FROM base b""")
def _matrix(b):
    return b.matrix.select(
        "transaction_id", "is_fraud", "fraud_typology", r4("amount", digits=2), r4("amount_zscore"),
        "distinct_merchants_30d", "distinct_devices_30d", r4("customer_amount_iqr_score"),
        r4("merchant_amount_iqr_score"), r4("frequency_deviation_zscore"), "hour", "rules_fired_count",
        "max_rule_severity", "is_new_device", "is_new_location", "is_first_time_at_merchant", *CATEGORICAL, "split")


@query("chronological_split", S.TXN + """,
    placed AS (SELECT *, row_number() OVER (ORDER BY ts_us, transaction_id) - 1 AS pos, count(*) OVER () AS total FROM txn)""", """
    SELECT transaction_id, CASE WHEN pos < CAST(floor(total * 0.70) AS BIGINT) THEN 'train'
      WHEN pos < CAST(floor(total * 0.70) AS BIGINT) + CAST(floor(total * 0.15) AS BIGINT) THEN 'validation'
      ELSE 'test' END AS split FROM placed""")
def _split(b):
    return chronological_split(b.star.txn).select("transaction_id", "split")


@query("split_summary", S.SCORES, f"""
    SELECT split, count(*) AS rows, min(ts_us) AS start_us, max(ts_us) AS end_us, any_value(n) AS total_rows,
      {d4('count(*) / any_value(n)', 'share')} FROM base, (SELECT count(*) AS n FROM base) GROUP BY 1""")
def _split_summary(b):
    return E.split_summary(b.matrix).withColumn("share", r4("share"))


@query("train_statistics", S.SCORES, f"""
    SELECT {d4('quantile_cont(amount, 0.95)', 'amount_p95')}, {d4('quantile_cont(amount, 0.5)', 'amount_median')},
      {d4('quantile_cont(z, 0.5)', 'zscore_median')}, {d4('quantile_cont(freq_z, 0.5)', 'frequency_median')},
      {d4('avg(amount)', 'amount_mean')}, {d4('stddev_pop(amount)', 'amount_std')},
      count(*) AS rows, count_if(is_fraud) AS positives FROM base WHERE split = 'train'""")
def _train_statistics(b):
    from riskloom.operators.quantile_cut import exact_quantiles
    train = b.matrix.filter("split = 'train'")
    cuts = exact_quantiles(train, ["amount", "amount_zscore", "frequency_deviation_zscore"], [0.5, 0.95])
    return train.agg(
        r4(F.lit(cuts["amount"][1]), "amount_p95"), r4(F.lit(cuts["amount"][0]), "amount_median"),
        r4(F.lit(cuts["amount_zscore"][0]), "zscore_median"),
        r4(F.lit(cuts["frequency_deviation_zscore"][0]), "frequency_median"),
        r4(F.avg("amount"), "amount_mean"), r4(F.stddev_pop("amount"), "amount_std"),
        F.count("*").alias("rows"), F.count_if("is_fraud").alias("positives"))


@query("risk_scores", S.SCORES, """
    SELECT transaction_id, round_even(ml, 5) AS ml_component, round_even(rules_c, 5) AS rules_component,
      round_even(behav_c, 5) AS behavioral_component, round_even(expo_c, 5) AS exposure_component,
      score AS combined_score, risk_tier, split = 'train' AS ml_in_sample FROM scored""")
def _risk_scores(b):
    parts = ["ml_component", "rules_component", "behavioral_component", "exposure_component", "combined_score"]
    return b.scored.select("transaction_id", *[r4(p, digits=5) for p in parts], "risk_tier", "ml_in_sample")


@query("tier_cutpoints", S.SCORES, f"""
    SELECT {d4('c99', 'critical')}, {d4('c95', 'high')}, {d4('c80', 'medium')}, {d4('cap', 'exposure_cap')} FROM cuts, cap""")
def _cutpoints(b):
    c = b.constants
    n = b.scored.agg(F.count("*").alias("n"))
    return n.select(r4(F.lit(c.tier_cutpoints["CRITICAL"]), "critical"), r4(F.lit(c.tier_cutpoints["HIGH"]), "high"),
                    r4(F.lit(c.tier_cutpoints["MEDIUM"]), "medium"), r4(F.lit(c.exposure_cap), "exposure_cap"))


@query("tier_fraud_check", S.SCORES, f"""
    SELECT risk_tier, {d4('avg(CASE WHEN is_fraud THEN 1 ELSE 0 END)', 'fraud_rate')}, count(*) AS n FROM scored GROUP BY 1""")
def _tier_check(b):
    return tier_fraud_check(b.scored).withColumn("fraud_rate", r4("fraud_rate"))


_IMPACT = """
    SELECT {threshold} AS threshold, n AS n_alerts, {rate}, tp AS true_positives, n - tp AS false_positives,
      p - tp AS false_negatives, {precision}, {recall}, {cost}, {prevented}, {unprevented}, {net}
    FROM ({inner})"""


def _impact_sql(inner: str) -> str:
    return _IMPACT.format(
        threshold="round(t, 4) + 0.0", inner=inner, rate=d4("n / total", "alert_rate"),
        precision=d4("CASE WHEN n > 0 THEN tp / n ELSE 0 END", "precision"),
        recall=d4("CASE WHEN p > 0 THEN tp / p ELSE 0 END", "recall"),
        cost=d4("12.0 * n", "total_investigation_cost_usd", 2), prevented=d4("0.8 * tpa", "estimated_loss_prevented_usd", 2),
        unprevented=d4("pa - tpa", "unprevented_loss_usd", 2),
        net=d4("0.8 * tpa - 12.0 * n - (pa - tpa)", "net_expected_impact_usd", 2))


_PER_T = """SELECT t, count(*) FILTER (WHERE raw_score >= t) AS n, count(*) AS total,
    count(*) FILTER (WHERE raw_score >= t AND is_fraud) AS tp, count(*) FILTER (WHERE is_fraud) AS p,
    coalesce(sum(cents) FILTER (WHERE raw_score >= t AND is_fraud), 0) / 100 AS tpa,
    coalesce(sum(cents) FILTER (WHERE is_fraud), 0) / 100 AS pa
    FROM scored, {ts} {where} GROUP BY t"""


def _impact_out(df):
    digits = {"threshold": 4, "alert_rate": 4, "precision": 4, "recall": 4, "total_investigation_cost_usd": 2,
              "estimated_loss_prevented_usd": 2, "unprevented_loss_usd": 2, "net_expected_impact_usd": 2}
    return df.select(*[r4(c, digits=digits[c]) if c in digits else F.col(c) for c in df.columns])


@query("portfolio_impact_at_threshold", S.SCORES, _impact_sql(_PER_T.format(ts="(SELECT 0.5 AS t)", where="")))
def _impact(b):
    return _impact_out(X.impact_at_thresholds(b.scored, [0.5], "raw_score"))


_STEPS = ("(SELECT DISTINCT unnest(quantile_cont(raw_score, [{steps}])) AS t FROM scored {where})")


def _steps(n):
    return ", ".join(repr((1 + 98 * i / (n - 1)) / 100) for i in range(n))


@query("threshold_sweep_validation", S.SCORES, _impact_sql(_PER_T.format(
    ts=_STEPS.format(steps=_steps(20), where="WHERE split = 'validation'"), where="WHERE split = 'validation'")))
def _sweep(b):
    return _impact_out(X.threshold_sweep(b.scored.filter("split = 'validation'"), "raw_score"))


@query("threshold_sweep_all_15", S.SCORES, _impact_sql(_PER_T.format(ts=_STEPS.format(steps=_steps(15), where=""), where="")))
def _sweep15(b):
    return _impact_out(X.threshold_sweep(b.scored, "raw_score", 15))


@query("best_threshold_on_test", S.SCORES + ", sweep AS (" + _PER_T.format(
    ts=_STEPS.format(steps=_steps(20), where="WHERE split = 'validation'"), where="WHERE split = 'validation'") + """),
    best AS (SELECT t FROM sweep ORDER BY round(0.8 * tpa - 12.0 * n - (pa - tpa), 2) DESC, t DESC LIMIT 1)""",
    _impact_sql(_PER_T.format(ts="best", where="WHERE split = 'test'")))
def _best_on_test(b):
    """Threshold chosen on validation, looked at once on test."""
    best = X.best_threshold(X.threshold_sweep(b.scored.filter("split = 'validation'"), "raw_score")).first()["threshold"]
    return _impact_out(X.impact_at_thresholds(b.scored.filter("split = 'test'"), [best], "raw_score"))


# ---------------------------------------------------------------- evaluation
_EVAL = S.SCORES + """,
  grp AS (SELECT score, count(*) AS n, count_if(is_fraud) AS pos FROM scored GROUP BY 1),
  curve AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp FROM grp WINDOW w AS (ORDER BY score DESC)),
  tot AS (SELECT count(*) AS rows, count_if(is_fraud) AS p FROM scored)"""


@query("score_curve", _EVAL, f"""
    SELECT {d4('score', 'score', 5)}, n, pos, CAST(cn AS BIGINT) AS cum_n, CAST(cp AS BIGINT) AS cum_pos FROM curve""")
def _curve(b):
    return E.score_curve(b.scored, "combined_score").withColumn("score", r4("score", digits=5))


@query("ranking_summary", _EVAL, f"""
    SELECT any_value(rows) AS rows, any_value(p) AS positives, {d4('sum(pos * cp / cn) / any_value(p)', 'pr_auc')},
      {d4('sum((n - pos) * (cp - pos / 2)) / (any_value(p) * (any_value(rows) - any_value(p)))', 'roc_auc')}
    FROM curve, tot""")
def _ranking(b):
    return E.ranking_summary(E.score_curve(b.scored, "combined_score")).select(
        "rows", "positives", r4("pr_auc"), r4("roc_auc"))


@query("recall_at_fixed_fpr", _EVAL, f"""
    SELECT 0.01 AS target_fpr, {d4('max(fpr)', 'actual_fpr')}, {d4('max(rec)', 'recall')}, {d4('min(score)', 'threshold')}
    FROM (SELECT score, (cn - cp) / (rows - p) AS fpr, cp / p AS rec FROM curve, tot) WHERE fpr <= 0.01""")
def _fpr(b):
    return E.recall_at_fixed_fpr(E.score_curve(b.scored, "combined_score")).select(
        "target_fpr", r4("actual_fpr"), r4("recall"), r4("threshold"))


@query("precision_recall_at_top_k", _EVAL, f"""
    SELECT 0.02 AS k_frac, k, {d4('count_if(is_fraud AND rn <= k) / k', 'precision')},
      {d4('count_if(is_fraud AND rn <= k) / any_value(p)', 'recall')}
    FROM (SELECT *, row_number() OVER (ORDER BY score DESC, transaction_id) AS rn FROM scored),
         (SELECT greatest(1, CAST(floor(rows * 0.02) AS BIGINT)) AS k, p FROM tot) GROUP BY k""")
def _top_k(b):
    curve = E.score_curve(b.scored, "combined_score")
    return E.precision_recall_at_top_k(b.scored, curve, 0.02, "combined_score").select(
        "k_frac", "k", r4("precision"), r4("recall"))


@query("top_k_threshold", _EVAL, f"""
    SELECT {d4('score', 'threshold')} FROM scored ORDER BY score DESC
    LIMIT 1 OFFSET (SELECT greatest(1, CAST(floor(count(*) * 0.02) AS BIGINT)) - 1 FROM scored)""")
def _top_k_threshold(b):
    cut = E.top_k_threshold(E.score_curve(b.scored, "combined_score"))
    return b.scored.agg(F.count("*").alias("n")).select(r4(F.lit(cut), "threshold"))


@query("metrics_at_threshold", _EVAL, f"""
    SELECT 0.4 AS threshold, tn, fp, fn, tp, {d4('tp / (tp + fp)', 'precision')}, {d4('tp / (tp + fn)', 'recall')},
      {d4('2 * tp / (2 * tp + fp + fn)', 'f1')}
    FROM (SELECT count_if(score < 0.4 AND NOT is_fraud) AS tn, count_if(score >= 0.4 AND NOT is_fraud) AS fp,
                 count_if(score < 0.4 AND is_fraud) AS fn, count_if(score >= 0.4 AND is_fraud) AS tp FROM scored)""")
def _at_threshold(b):
    return E.metrics_at_threshold(b.scored, 0.4, "combined_score").select(
        "threshold", "tn", "fp", "fn", "tp", r4("precision"), r4("recall"), r4("f1"))


@query("score_distribution", _EVAL, f"""
    SELECT is_fraud, count(*) AS count, {d4('avg(score)', 'mean')}, {d4('stddev_samp(score)', 'std')},
      {d4('min(score)', 'min')}, {", ".join(d4(f'quantile_cont(score, {q})', f'p{int(q * 100)}') for q in E.QUANTILES)},
      {d4('max(score)', 'max')} FROM scored GROUP BY 1""")
def _distribution(b):
    out = E.score_distribution(b.scored, "combined_score")
    return out.select("is_fraud", "count", *[r4(c) for c in out.columns if c not in ("is_fraud", "count")])


@query("score_histogram", _EVAL, """
    SELECT is_fraud, CAST(least(floor(score * 40), 39) AS BIGINT) AS bin, count(*) AS n FROM scored GROUP BY ALL""")
def _histogram(b):
    return E.score_histogram(b.scored, "combined_score")


@query("unsupervised_evaluation", S.SCORES + """,
  bs AS (SELECT *, round_even(behavioral, 6) AS bsc FROM base),
  grp AS (SELECT bsc AS score, count(*) AS n, count_if(is_fraud) AS pos FROM bs GROUP BY 1),
  curve AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp FROM grp WINDOW w AS (ORDER BY score DESC)),
  tot AS (SELECT count(*) AS rows, count_if(is_fraud) AS p FROM bs),
  kk AS (SELECT greatest(1, CAST(floor(rows * 0.02) AS BIGINT)) AS k FROM tot),
  top AS (SELECT count_if(is_fraud) AS hit FROM (
    SELECT *, row_number() OVER (ORDER BY bsc DESC, transaction_id) AS rn FROM bs), kk WHERE rn <= k)""", f"""
    SELECT 'behavioral' AS score_name,
      {d4('sum((n - pos) * (cp - pos / 2)) / (any_value(p) * (any_value(rows) - any_value(p)))', 'auc')},
      {d4('any_value(hit) / any_value(k)', 'precision_at_top2pct')}, {d4('any_value(hit) / any_value(p)', 'recall_at_top2pct')}
    FROM curve, tot, kk, top""")
def _unsupervised(b):
    df = b.matrix.withColumn("behavioral", F.bround("behavioral_anomaly_score", 6))
    return E.unsupervised_evaluation(df, "behavioral").select(
        "score_name", r4("auc"), r4("precision_at_top2pct"), r4("recall_at_top2pct"))


_SEG = """SELECT '{s}' AS segment, {v} AS value, count_if(is_fraud AND score >= 0.4) AS tp,
    count_if(is_fraud AND score < 0.4) AS fn, count_if(NOT is_fraud AND score >= 0.4) AS fp,
    count_if(NOT is_fraud AND score < 0.4) AS tn FROM seg {w} GROUP BY 2"""
_SEG_CTE = S.SCORES + """, seg AS (SELECT *,
  CASE WHEN customer_id % 20 = 0 THEN 'WATCHLIST' WHEN customer_id % 20 = 1 THEN 'VIP' ELSE 'STANDARD' END AS customer_risk_segment,
  CASE WHEN merchant_id % 12 = 0 THEN 'HIGH_RISK' ELSE 'STANDARD' END AS merchant_risk_category FROM scored)"""
SEGMENTS = ["channel", "customer_risk_segment", "merchant_risk_category", "fraud_typology"]


@query("error_analysis", _SEG_CTE, "SELECT segment, value, tp, fn, fp, tn, "
       + d4("CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END", "recall") + ", "
       + d4("CASE WHEN tp + fp > 0 THEN fp / (tp + fp) END", "fp_rate_of_flagged") + " FROM ("
       + _SEG.format(s="ALL", v="CAST(NULL AS VARCHAR)", w="") + " UNION ALL "
       + " UNION ALL ".join(_SEG.format(s=s, v=s, w=f"WHERE {s} IS NOT NULL") for s in SEGMENTS) + ")")
def _errors(b):
    return E.error_analysis(b.scored, 0.4, SEGMENTS, "combined_score").select(
        "segment", "value", "tp", "fn", "fp", "tn", r4("recall"), r4("fp_rate_of_flagged"))


@query("segment_performance", _SEG_CTE, f"""
    SELECT channel, count(*) AS n, count_if(is_fraud) AS fraud_count,
      {d4('avg(CASE WHEN score >= 0.4 THEN 1 ELSE 0 END) FILTER (WHERE is_fraud)', 'recall')},
      {d4('avg(CASE WHEN is_fraud THEN 1 ELSE 0 END) FILTER (WHERE score >= 0.4)', 'precision')} FROM seg GROUP BY 1""")
def _segment(b):
    return E.segment_performance(b.scored, "channel", 0.4, "combined_score").select(
        "channel", "n", "fraud_count", r4("recall"), r4("precision"))


@query("full_evaluation", _EVAL, f"""
    SELECT {d4('sum(pos * cp / cn) / any_value(p)', 'pr_auc')}, any_value(p) AS positives,
      {d4('max(CASE WHEN (cn - cp) / (rows - p) <= 0.01 THEN cp / p END)', 'recall_at_fpr')} FROM curve, tot""")
def _full(b):
    return E.full_evaluation(b.scored, 0.4, score="combined_score").select(
        r4("pr_auc"), "positives", r4("recall_at_fpr"))


# ---------------------------------------------------------------- alerts and cases
@query("alerts", S.CASES, f"""
    SELECT alert_id, transaction_id, customer_id, risk_tier, {d4('combined_score', 'combined_score', 5)},
      {d4('financial_exposure', 'financial_exposure', 2)}, dedup_group_id, {t6('created_at', 'created_at')} FROM alerts""")
def _alerts(b):
    return b.alerts.select("alert_id", "transaction_id", "customer_id", "risk_tier", r4("combined_score", digits=5),
                           r4("financial_exposure", digits=2), "dedup_group_id", ts_text("created_at", "created_at"))


@query("alert_volume", S.CASES, f"""
    SELECT count(*) AS alerts, count(DISTINCT dedup_group_id) AS dedup_groups, count_if(risk_tier = 'CRITICAL') AS critical_alerts,
      count_if(risk_tier = 'HIGH') AS high_alerts, {d4('avg(CASE WHEN is_fraud THEN 1 ELSE 0 END)', 'alerted_fraud_rate')},
      count(*) - count(DISTINCT dedup_group_id) AS absorbed FROM alerts""")
def _volume(b):
    return A.alert_volume(b.alerts, b.star.labels).withColumn("alerted_fraud_rate", r4("alerted_fraud_rate"))


@query("cases_opened", S.CASES, f"""
    SELECT case_id, alert_id, customer_id, CASE risk_tier WHEN 'CRITICAL' THEN 'ESCALATED' ELSE 'OPEN' END AS status,
      {t6('sla_deadline', 'sla_deadline')}, {t6('created_at', 'created_at')}, risk_tier FROM cases""")
def _opened(b):
    return b.opened.select("case_id", "alert_id", "customer_id", "status", ts_text("sla_deadline", "sla_deadline"),
                           ts_text("created_at", "created_at"), "risk_tier")


def _metrics_sql(key: str, group: str) -> str:
    return f"""
    SELECT {key} AS risk_tier, count(*) AS total_cases, count_if(o) AS open_cases, count_if(c) AS resolved_cases,
      count_if(o) AS queue_backlog, {d4('1 - count_if(late) / count_if(c)', 'sla_compliance_rate')},
      count_if(late) AS resolved_cases_breached_sla, count_if(o AND sla_deadline < now) AS open_cases_already_past_sla,
      {d4('avg(h)', 'avg_resolution_hours', 2)}, {d4('quantile_cont(h, 0.5)', 'median_resolution_hours', 2)},
      {d4("count_if(resolution = 'CONFIRMED_FRAUD') / count_if(c)", 'fraud_confirmation_rate')},
      {d4("count_if(resolution = 'FALSE_POSITIVE') / count_if(c)", 'false_positive_rate')},
      1.0 :: DOUBLE AS alert_to_case_conversion_rate FROM m {group}"""


@query("case_metrics", S.CASES + """,
  m AS (SELECT *, status = 'CLOSED' AS c, status <> 'CLOSED' AS o, status = 'CLOSED' AND resolved_at > sla_deadline AS late,
        (epoch_us(resolved_at) - epoch_us(created_at)) / 3.6e9 AS h FROM cases, nowts)""",
       _metrics_sql("'ALL'", "") + " UNION ALL " + _metrics_sql("risk_tier", "GROUP BY risk_tier"))
def _metrics(b):
    out = C.case_metrics(b.cases, F.lit(b.now))
    return out.select(*[r4(c, digits=2 if "hours" in c else 4) if dict(out.dtypes)[c] == "double" else F.col(c)
                        for c in out.columns])


@query("investigator_workload", S.CASES, "SELECT assigned_investigator, count(*) AS cases FROM cases GROUP BY 1")
def _workload(b):
    return C.investigator_workload(b.cases)


@query("investigators", S.CASES, "SELECT DISTINCT assigned_investigator FROM cases")
def _investigators(b):
    return P.investigators(b.cases)


@query("sla_breach_flags", S.CASES, """
    SELECT case_id, (status <> 'CLOSED' AND sla_deadline < now) OR (status = 'CLOSED' AND resolved_at > sla_deadline) AS sla_breached
    FROM cases, nowts""")
def _sla(b):
    return b.cases.select("case_id", C.sla_breached(F.lit(b.now)).alias("sla_breached"))


_STATE = f"""
    SELECT case_id, status, assigned_investigator, resolution, {t6('resolved_at', 'resolved_at')} FROM cases"""


@query("case_state_from_log", S.CASES, _STATE)
def _state(b):
    """Folding the log over the opened cases must give the worked cases back."""
    state = C.case_state(b.opened, C.replay(b.opened, b.log))
    return state.select("case_id", "status", "assigned_investigator", "resolution", ts_text("resolved_at", "resolved_at"))


@query("case_state_in_two_runs", S.CASES, _STATE)
def _state_two_runs(b):
    """The state after the first actions is stored; a second run reads it and only replays what came since."""
    path = b.run_folder("state")
    first, _ = C.advance(b.opened.withColumn("last_seq", F.lit(None).cast("long")), b.log.filter("seq <= 2"))
    first.write.parquet(path)
    state, _ = C.advance(b.spark.read.parquet(path), b.log)
    return state.select("case_id", "status", "assigned_investigator", "resolution", ts_text("resolved_at", "resolved_at"))


@query("rejected_case_actions", S.CASES, """
    SELECT case_id, CASE WHEN status = 'CLOSED' THEN 'ESCALATE' ELSE 'REOPEN' END AS action_type, status AS previous_status,
      CASE WHEN status = 'CLOSED' THEN 'not valid from status' ELSE 'unknown action' END AS reason
    FROM cases WHERE case_id % 17 = 0""")
def _rejected(b):
    return C.rejected_actions(C.replay(b.opened, b.log)).select("case_id", "action_type", "previous_status", "reason")


@query("audit_log_rows", S.CASES, """
    SELECT entity_type, event_type, count(*) AS n FROM (
      SELECT 'case' AS entity_type, unnest(list_filter([
        'ASSIGN', 'INVESTIGATE', CASE WHEN risk_tier = 'CRITICAL' THEN 'ESCALATE' END,
        CASE resolution WHEN 'CONFIRMED_FRAUD' THEN 'CONFIRM_FRAUD' WHEN 'FALSE_POSITIVE' THEN 'MARK_FALSE_POSITIVE' END,
        CASE WHEN status = 'CLOSED' THEN 'CLOSE' END], lambda x: x IS NOT NULL)) AS event_type FROM cases) GROUP BY ALL""")
def _audit(b):
    return C.audit_rows(C.replay(b.opened, b.log)).groupBy("entity_type", "event_type").agg(F.count("*").alias("n"))


@query("case_actions_stored_twice", S.CASES, """
    SELECT case_id, CAST(seq AS BIGINT) AS seq, action_type FROM (
      SELECT case_id, 1 AS seq, 'ASSIGN' AS action_type FROM cases UNION ALL SELECT case_id, 2, 'INVESTIGATE' FROM cases
      UNION ALL SELECT case_id, 3, 'ESCALATE' FROM cases WHERE risk_tier = 'CRITICAL'
      UNION ALL SELECT case_id, 4, CASE resolution WHEN 'CONFIRMED_FRAUD' THEN 'CONFIRM_FRAUD' ELSE 'MARK_FALSE_POSITIVE' END
        FROM cases WHERE status = 'CLOSED'
      UNION ALL SELECT case_id, 5, 'CLOSE' FROM cases WHERE status = 'CLOSED')""")
def _actions_twice(b):
    """Accepted actions written by two runs of the replay: the second adds nothing."""
    from riskloom.sources import sinks
    path = f"{b.run_folder('actions')}/investigation_actions"
    for run in range(2):
        rows = C.accepted_actions(C.replay(b.opened, b.log))
        sinks.append_new(rows, b.spark.read.parquet(path) if run else None, path, ["case_id", "seq"])
    return b.spark.read.parquet(path).select("case_id", "seq", "action_type")


@query("valid_next_actions", S.CASES, """
    SELECT case_id, CASE status WHEN 'IN_REVIEW' THEN 'ESCALATE,CONFIRM_FRAUD,MARK_FALSE_POSITIVE'
      WHEN 'ESCALATED' THEN 'INVESTIGATE,CONFIRM_FRAUD,MARK_FALSE_POSITIVE' ELSE '' END AS actions FROM cases""")
def _valid(b):
    return C.with_valid_actions(b.cases).select("case_id", F.concat_ws(",", "valid_next_actions").alias("actions"))


@query("case_detail", S.CASES + """,
  rules AS (SELECT transaction_id, count(*) AS n_rules, string_agg(rule_id, ',' ORDER BY rule_id) AS rule_ids FROM fired GROUP BY 1),
  newest AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY ts_us DESC, transaction_id DESC) AS rk FROM scored),
  timeline AS (SELECT customer_id, string_agg(CAST(transaction_id AS VARCHAR), ',' ORDER BY rk) AS last_30 FROM newest WHERE rk <= 30 GROUP BY 1),
  others AS (
    SELECT a.case_id, string_agg(CAST(o.alert_id AS VARCHAR), ',' ORDER BY o.created_at DESC, o.alert_id DESC) AS previous_alerts
    FROM (SELECT a.case_id, o.alert_id, o.created_at, row_number() OVER (
            PARTITION BY a.case_id ORDER BY o.created_at DESC, o.alert_id DESC) AS rk
          FROM cases a JOIN cases o ON a.customer_id = o.customer_id AND a.case_id <> o.case_id) o
    JOIN cases a ON a.case_id = o.case_id WHERE o.rk <= 10 GROUP BY 1)""", f"""
    SELECT c.case_id, c.status, s.transaction_id, s.risk_tier AS score_tier, {d4('s.amount', 'amount', 2)}, s.channel,
      CASE WHEN c.customer_id % 20 = 0 THEN 'WATCHLIST' WHEN c.customer_id % 20 = 1 THEN 'VIP' ELSE 'STANDARD' END AS customer_risk_segment,
      coalesce(n_rules, 0) AS n_rules, coalesce(rule_ids, '') AS rule_ids, t.last_30, coalesce(o.previous_alerts, '') AS previous_alerts,
      2 + CAST(c.risk_tier = 'CRITICAL' AS INT) + 2 * CAST(c.status = 'CLOSED' AS INT) AS n_actions,
      c.status <> 'CLOSED' AND s.score >= 0.8 AS recommend_action
    FROM cases c JOIN alerts a ON a.alert_id = c.alert_id JOIN scored s ON s.transaction_id = a.transaction_id
    LEFT JOIN rules r ON r.transaction_id = s.transaction_id LEFT JOIN timeline t ON t.customer_id = c.customer_id
    LEFT JOIN others o ON o.case_id = c.case_id""")
def _detail(b):
    full = C.case_detail(b.cases, b.alerts, b.star.txn, b.star.customer, b.star.merchant, b.scored, b.firings,
                         C.accepted_actions(C.replay(b.opened, b.log)), b.star.labels)
    ids = lambda col, field: F.concat_ws(",", F.transform(col, lambda x: x[field].cast("string")))
    return full.select(
        "case_id", "status", "transaction_id", F.col("risk_score.risk_tier").alias("score_tier"), r4("amount", digits=2),
        "channel", "customer_risk_segment",
        F.coalesce(F.size("rules_triggered"), F.lit(0)).cast("long").alias("n_rules"),
        F.coalesce(ids("rules_triggered", "rule_id"), F.lit("")).alias("rule_ids"),
        ids("customer_timeline", "transaction_id").alias("last_30"),
        F.coalesce(ids("previous_alerts", "alert_id"), F.lit("")).alias("previous_alerts"),
        F.size("action_history").alias("n_actions"), "recommend_action")


# ---------------------------------------------------------------- lists and reports
_PAGE_TXN = f"""{t6('ts', 'transaction_ts')}, customer_id, merchant_id, {d4('amount', 'amount', 2)}, channel, status, risk_tier,
    {d4('score', 'combined_score', 5)}"""


def _txn_page(page):
    return page.items.select("transaction_id", ts_text("transaction_ts", "transaction_ts"), "customer_id", "merchant_id",
                             r4("amount", digits=2), "channel", "status", "risk_tier", r4("combined_score", digits=5))


@query("transaction_search", S.SCORES, f"""
    SELECT transaction_id, {_PAGE_TXN} FROM scored WHERE risk_tier = 'MEDIUM' AND amount >= 20
    ORDER BY ts DESC, transaction_id DESC LIMIT 50 OFFSET 10""")
def _search(b):
    return _txn_page(P.list_transactions(b.star.txn, b.scored, risk_tier="MEDIUM", min_amount=20, limit=50, offset=10))


@query("transaction_search_total", S.SCORES, """
    SELECT count(*) AS total FROM scored WHERE risk_tier = 'MEDIUM' AND amount >= 20""")
def _search_total(b):
    return P.list_transactions(b.star.txn, b.scored, risk_tier="MEDIUM", min_amount=20).total


@query("transaction_page_by_channel", S.SCORES, f"""
    SELECT transaction_id, {_PAGE_TXN} FROM scored WHERE channel = 'ATM' ORDER BY ts DESC, transaction_id DESC LIMIT 50""")
def _page_channel(b):
    return _txn_page(P.list_transactions(b.star.txn, b.scored, channel="ATM"))


@query("alert_list", S.CASES, f"""
    SELECT a.alert_id, a.transaction_id, a.risk_tier, {d4('combined_score', 'combined_score', 5)}, dedup_group_id,
      case_id, c.status AS case_status FROM alerts a LEFT JOIN cases c ON c.alert_id = a.alert_id
    WHERE a.risk_tier = 'HIGH' AND c.status = 'CLOSED' ORDER BY combined_score DESC, a.created_at DESC, a.alert_id DESC LIMIT 50""")
def _alert_list(b):
    return P.list_alerts(b.alerts, b.cases, risk_tier="HIGH", case_status="CLOSED").items.select(
        "alert_id", "transaction_id", "risk_tier", r4("combined_score", digits=5), "dedup_group_id", "case_id", "case_status")


@query("alert_list_total", S.CASES, "SELECT count(*) AS total FROM alerts JOIN cases c USING (alert_id) WHERE c.status = 'CLOSED'")
def _alert_total(b):
    return P.list_alerts(b.alerts, b.cases, case_status="CLOSED").total


_CASE_SQL = f"""SELECT c.case_id, c.alert_id, c.status, c.assigned_investigator, {t6('c.sla_deadline', 'sla_deadline')}, c.resolution,
    {t6('c.created_at', 'created_at')}, c.risk_tier, {d4('a.financial_exposure', 'financial_exposure', 2)}
    FROM cases c JOIN alerts a ON a.alert_id = c.alert_id"""


def _case_page(page):
    return page.items.select("case_id", "alert_id", "status", "assigned_investigator", ts_text("sla_deadline", "sla_deadline"),
                             "resolution", ts_text("created_at", "created_at"), "risk_tier", r4("financial_exposure", digits=2))


@query("case_list", S.CASES, _CASE_SQL + """ WHERE c.status = 'CLOSED' AND c.risk_tier = 'HIGH' AND assigned_investigator = 'inv_3'
    ORDER BY c.created_at DESC, c.case_id DESC LIMIT 50""")
def _case_list(b):
    return _case_page(P.list_cases(b.cases, b.alerts, status="CLOSED", risk_tier="HIGH", assigned_investigator="inv_3"))


@query("case_list_total", S.CASES, """
    SELECT count(*) AS total FROM cases WHERE status = 'CLOSED' AND risk_tier = 'HIGH' AND assigned_investigator = 'inv_3'""")
def _case_list_total(b):
    return P.list_cases(b.cases, b.alerts, status="CLOSED", risk_tier="HIGH", assigned_investigator="inv_3").total


@query("case_queue", S.CASES, _CASE_SQL + " WHERE c.status = 'IN_REVIEW' ORDER BY a.combined_score DESC, c.case_id LIMIT 200")
def _queue(b):
    return _case_page(P.case_queue(b.cases, b.alerts, status="IN_REVIEW"))


@query("transaction_rules_lookup", S.FIRED, """
    SELECT transaction_id, rule_id, severity FROM fired WHERE transaction_id = (SELECT max(transaction_id) FROM fired)""")
def _transaction_rules(b):
    newest = b.firings.agg(F.max("transaction_id")).first()[0]
    return P.transaction_rules(b.firings, newest).select("transaction_id", "rule_id", "severity")


@query("risk_detail_with_rules", S.SCORES, f"""
    SELECT s.transaction_id, {d4('raw_score', 'combined_score')}, risk_tier, coalesce(string_agg(rule_id || ':' || severity, ','
      ORDER BY rule_id, severity), '') AS rules FROM scored s LEFT JOIN fired f ON f.transaction_id = s.transaction_id GROUP BY s.transaction_id, raw_score, risk_tier""")
def _risk_detail(b):
    out = P.risk_detail(b.scored, b.firings)
    return out.select("transaction_id", r4("raw_score", "combined_score"), "risk_tier", F.coalesce(F.concat_ws(
        ",", F.transform("rules_triggered", lambda r: F.concat_ws(":", r["rule_id"], r["severity"]))), F.lit("")).alias("rules"))


@query("executive_kpis", S.CASES, f"""
    SELECT (SELECT count(*) FROM txn) AS total_transactions, {d4('(SELECT sum(cents) / 100 FROM txn)', 'total_amount', 2)},
      (SELECT count(*) FROM alerts) AS total_alerts, count_if(resolution = 'CONFIRMED_FRAUD') AS confirmed_fraud,
      {d4('(SELECT count_if(is_fraud) / count(*) FROM txn)', 'true_fraud_rate')},
      {d4('(SELECT sum(financial_exposure) FROM alerts)', 'total_financial_exposure', 2)},
      {d4("0.8 * (SELECT sum(financial_exposure) FROM alerts JOIN cases x USING (alert_id) WHERE x.resolution = 'CONFIRMED_FRAUD')",
          'estimated_loss_prevented', 2)},
      {d4("count_if(resolution = 'FALSE_POSITIVE') / count_if(status = 'CLOSED')", 'false_positive_rate')},
      count_if(status <> 'CLOSED') AS open_investigations,
      {d4("count_if(status = 'CLOSED' AND resolved_at <= sla_deadline) / count_if(status = 'CLOSED')", 'sla_compliance_rate')}
    FROM cases""")
def _kpis(b):
    out = R.executive_kpis(b.star.txn, b.star.labels, b.alerts, b.cases)
    money = ("total_amount", "total_financial_exposure", "estimated_loss_prevented")
    return out.select(*[r4(c, digits=2 if c in money else 4) if t == "double" else F.col(c) for c, t in out.dtypes])


@query("daily_volume_and_fraud", S.TXN, f"""
    SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS txn_count, count_if(is_fraud) AS fraud_count,
      {d4('sum(cents) / 100', 'total_amount', 2)} FROM txn GROUP BY day""")
def _daily(b):
    return R.daily_volume_and_fraud(b.labelled).select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "txn_count", "fraud_count", r4("total_amount", digits=2))


@query("risk_tier_distribution", S.SCORES, "SELECT risk_tier, count(*) AS n FROM scored GROUP BY 1")
def _tiers(b):
    return R.tier_distribution(b.scored)


@query("portfolio_snapshot", S.CASES, f"""
    SELECT (SELECT count(*) FROM txn) AS total_transactions, (SELECT count(*) FROM alerts) AS total_alerts,
      count(*) AS total_cases, count_if(status <> 'CLOSED') AS open_cases, count_if(status = 'CLOSED') AS resolved_cases,
      {d4("1 - count_if(status = 'CLOSED' AND resolved_at > sla_deadline) / count_if(status = 'CLOSED')", 'sla_compliance_rate')},
      (SELECT count(*) FROM scored WHERE risk_tier = 'LOW') AS low_tier FROM cases""")
def _snapshot(b):
    return R.portfolio_snapshot(b.star.txn, b.alerts, b.scored, b.cases, F.lit(b.now)).select(
        "total_transactions", "total_alerts", "total_cases", "open_cases", "resolved_cases", r4("sla_compliance_rate"),
        F.col("risk_tier_distribution")["LOW"].alias("low_tier"))


# ---------------------------------------------------------------- quality
@query("quality_checks", S.TXN, """
    SELECT 'duplicate_ids' AS check_name, (count(*) - count(DISTINCT transaction_id))::BIGINT AS violations FROM txn
    UNION ALL SELECT 'gaps_in_ids', (max(transaction_id) - min(transaction_id) + 1 - count(DISTINCT transaction_id))::BIGINT FROM txn
    UNION ALL SELECT 'last4_length', 0::BIGINT
    UNION ALL SELECT 'amount_not_positive', count_if(amount <= 0) FROM txn
    UNION ALL SELECT 'amount_out_of_bounds', count_if(amount >= 100000) FROM txn
    UNION ALL SELECT 'typology_without_fraud', count_if(NOT is_fraud AND fraud_typology IS NOT NULL) FROM txn
    UNION ALL SELECT 'label_not_synthetic', 0::BIGINT
    UNION ALL SELECT 'unknown_customer', count(*) FROM txn ANTI JOIN customer ON c_custkey = customer_id
    UNION ALL SELECT 'unknown_merchant', count(*) FROM txn ANTI JOIN part ON p_partkey = merchant_id
    UNION ALL SELECT 'unknown_device', 0::BIGINT
    UNION ALL SELECT 'unknown_location', count(*) FROM txn ANTI JOIN nation ON n_nationkey = location_id""")
def _quality(b):
    return Q.quality_checks(b.star)


@query("dataset_profile", S.TXN, f"""
    SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM part) AS merchants,
      count(DISTINCT device_id) AS devices, (SELECT count(*) FROM nation) AS locations, count(*) AS transactions,
      min(ts_us) AS first_us, max(ts_us) AS last_us, count_if(is_fraud) AS fraud_transactions,
      {d4('count_if(is_fraud) / count(*)', 'fraud_rate')} FROM txn""")
def _profile(b):
    return Q.dataset_profile(b.star).withColumn("fraud_rate", r4("fraud_rate"))


@query("typology_counts", S.TXN, "SELECT fraud_typology, count(*) AS n FROM txn WHERE is_fraud GROUP BY 1")
def _typologies(b):
    return Q.typology_counts(b.star)


@query("travel_between_transactions", S.FEATURES, f"""
    SELECT transaction_id, {d4('km', 'distance_km')},
      {d4("CASE WHEN hrs <= 0 THEN 1e308 * 10 ELSE km / hrs END", 'implied_speed_kmh')} FROM geo WHERE last_us IS NOT NULL""")
def _travel(b):
    f = b.features.filter("prev_us is not null")
    here = [F.col(c) for c in ("last_location_lat", "last_location_lon", "current_location_lat", "current_location_lon")]
    hours = (F.col("ts_us") - F.col("prev_us")) / 3_600_000_000
    return f.select("transaction_id", r4(haversine_km(*here), "distance_km"), r4(implied_speed_kmh(*here, hours), "implied_speed_kmh"))


# ---------------------------------------------------------------- monitoring per model and period
_MONITOR_SQL = """
  SELECT s.*, model, date_trunc('week', ts) AS week, CASE model WHEN 'amount' THEN s.ml ELSE s.forest END AS x
  FROM parts s, (VALUES ('amount'), ('id_share')) m(model)"""


@query("model_monitoring", S.SCORES + f""",
    mon_rows AS ({_MONITOR_SQL}),
    mon_cuts AS (SELECT model, list_sort(list_distinct(quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS c FROM mon_rows
      WHERE split = 'train' GROUP BY 1),
    mon_binned AS (SELECT s.*, len(list_filter(c, lambda v: v <= x)) AS bin FROM mon_rows s JOIN mon_cuts USING (model)),
    mon_bins AS (SELECT model, unnest(range(0, len(c) + 1)) AS bin FROM mon_cuts),
    mon_ref AS (SELECT b.model, b.bin, greatest(0.0001, count(x) FILTER (WHERE split = 'train') / (SELECT count(*) FROM parts WHERE split = 'train')) AS r
      FROM mon_bins b LEFT JOIN mon_binned x ON x.model = b.model AND x.bin = b.bin GROUP BY 1, 2),
    mon_per AS (SELECT model, week, count(*) AS n, count_if(is_fraud) AS p, greatest(1, floor(count(*) * 0.02)) AS k FROM mon_rows GROUP BY 1, 2),
    mon_psi AS (SELECT p.model, p.week, sum((s - r) * (ln(s) - ln(r))) AS psi FROM
      (SELECT p.model, p.week, ref.bin, r, greatest(0.0001, (SELECT count(*) FROM mon_binned b WHERE b.model = p.model AND b.week = p.week AND b.bin = ref.bin) / n) AS s
       FROM mon_per p JOIN mon_ref ref USING (model)) p GROUP BY 1, 2),
    mon_ordered AS (SELECT s.model, s.week, s.is_fraud, p, n, k,
        row_number() OVER (PARTITION BY s.model, s.week ORDER BY x DESC, transaction_id) AS place,
        count(*) OVER w AS cum_n, sum(CAST(is_fraud AS INT)) OVER w AS cum_pos
      FROM mon_rows s JOIN mon_per per USING (model, week) WINDOW w AS (PARTITION BY s.model, s.week ORDER BY x DESC))
    """, f"""
    SELECT model AS model_name, 'v1' AS model_version, strftime(week, '%Y-%m-%d') AS period_start, strftime(week + INTERVAL 6 DAY, '%Y-%m-%d') AS period_end,
      {d4('count(*) FILTER (WHERE is_fraud AND place <= k) / any_value(k)', 'precision_at_k', 5)},
      {d4('coalesce(max(cum_pos) FILTER (WHERE (cum_n - cum_pos) / (n - p) <= 0.01), 0) / nullif(any_value(p), 0)', 'recall_at_fpr', 5)},
      {d4('sum(CASE WHEN is_fraud THEN cum_pos / cum_n ELSE 0 END) / nullif(any_value(p), 0)', 'pr_auc', 5)},
      {d4('any_value(psi)', 'psi_score', 5)}, {d4('any_value(p) / any_value(n)', 'fraud_rate', 5)}
    FROM mon_ordered JOIN mon_psi USING (model, week) GROUP BY model, week""")
def _monitoring(b):
    from riskloom.plans.monitoring import FrozenBins, monitor
    rows = b.scored.select("transaction_id", "transaction_ts", "split", "is_fraud", F.least(F.lit(1.0), F.col("amount") / 500).alias("amount"),
                           ((F.col("transaction_id") % 100) / 100.0).alias("id_share"))
    out = None
    for model in ("amount", "id_share"):
        bins = FrozenBins.of(rows.filter("split = 'train'"), model)
        one = monitor(rows, bins, F.date_trunc("week", "transaction_ts"), F.date_add(F.to_date("period_start"), 6), model, "v1", score=model)
        out = one if out is None else out.unionByName(one)
    return out.select("model_name", "model_version", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("period_start", "period_end")],
                      *[r4(c, digits=5) for c in ("precision_at_k", "recall_at_fpr", "pr_auc", "psi_score", "fraud_rate")])


# A literal model of three leaves paths: (value, [(feature, low, high, share of cover)]), over amount, hour and prior rows.
_INF = float("inf")
_LITERAL_LEAVES = [
    (1.5, [(0, -_INF, 60.0, 0.5), (1, -_INF, 11.0, 0.4)]), (-0.5, [(0, -_INF, 60.0, 0.5), (1, 11.0, _INF, 0.6)]),
    (2.0, [(0, 60.0, _INF, 0.5), (2, -_INF, 20.0, 0.7), (1, -_INF, 17.0, 0.75)]),
    (0.25, [(0, 60.0, _INF, 0.5), (2, -_INF, 20.0, 0.7), (1, 17.0, _INF, 0.25)]), (3.0, [(0, 60.0, _INF, 0.5), (2, 20.0, _INF, 0.3)])]


def _literal_attribution() -> str:
    """Shapley values of the literal model written out: for two and three conditions the sums over subsets are short."""
    names = ["amount", "hour", "prior"]
    total = ["0.0"] * 3
    for value, path in _LITERAL_LEAVES:
        o = [f"(CASE WHEN {names[f]} > {lo if lo > -_INF else '-1e300'} AND {names[f]} <= {hi if hi < _INF else '1e300'} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
             for f, lo, hi, _ in path]
        z = [f"{share}::DOUBLE" for *_, share in path]
        for i, (f, *_) in enumerate(path):
            j, *k = [x for x in range(len(path)) if x != i]
            rest = f"({z[j]} + {o[j]}) / 2"
            if k:
                rest = f"(2 * {z[j]} * {z[k[0]]} + {z[j]} * {o[k[0]]} + {o[j]} * {z[k[0]]} + 2 * {o[j]} * {o[k[0]]}) / 6"
            total[f] += f" + {value}::DOUBLE * ({o[i]} - {z[i]}) * {rest}"
    return ", ".join(d4(t, f"of_{n}", 6) for t, n in zip(total, names))


@query("tree_attribution_literal_model", S.FEATURES, f"""
    SELECT transaction_id, {_literal_attribution()} FROM geo""")
def _literal_tree(b):
    from riskloom.plans.attribution import path_contributions
    rows = b.features.select("transaction_id", F.array(*[F.col(c).cast("double") for c in ("amount", "hour", "total_prior_txns")]).alias("x"))
    told = path_contributions(rows, _LITERAL_LEAVES, "x", 3)
    return told.select("transaction_id", *[r4(F.col("contributions")[i], f"of_{n}", 6) for i, n in enumerate(("amount", "hour", "prior"))])


# ---------------------------------------------------------------- models (no SQL form: rows only)


@query("isolation_forest_scores")
def _forest(b):
    from riskloom.plans.forest import with_whole_data_score
    return with_whole_data_score(b.matrix).select("transaction_id", "isolation_forest_score")


@query("isolation_forest_train_only_scores")
def _forest_train(b):
    return b.prepared.rows.select("transaction_id", "split", "isolation_forest_score")


@query("isolation_forest_evaluation")
def _forest_eval(b):
    return E.unsupervised_evaluation(b.prepared.rows, "isolation_forest_score")


@query("encoded_features")
def _encoded(b):
    from pyspark.ml.functions import vector_to_array
    return b.prepared.rows.select("transaction_id", vector_to_array("plain").alias("plain"), vector_to_array("scaled").alias("scaled"))


@query("logistic_regression_evaluation")
def _logistic(b):
    from riskloom.plans.models import evaluate_model
    return evaluate_model(b.prepared, b.logistic, "logistic")


@query("boosted_trees_selection")
def _boosted_trials(b):
    return b.boosted.trials


@query("boosted_trees_evaluation")
def _boosted(b):
    from riskloom.plans.models import evaluate_model
    return evaluate_model(b.prepared, b.boosted.model, "boosted")


@query("linear_attribution_global")
def _linear_global(b):
    from riskloom.plans.attribution import global_importance, linear_contributions
    return global_importance(linear_contributions(b.prepared, b.logistic), b.prepared.preprocessor.names)


@query("tree_attribution_global")
def _tree_global(b):
    """Over every held-out row."""
    from riskloom.plans.attribution import global_importance, tree_contributions
    held_out = b.prepared.rows.filter("split = 'test'")
    return global_importance(tree_contributions(held_out, b.boosted.model), b.prepared.preprocessor.names)


@query("tree_attribution_rows")
def _tree_rows(b):
    """Every held-out row, not a sample."""
    from riskloom.plans.attribution import top_contributors, tree_contributions
    held_out = b.prepared.rows.filter("split = 'test'")
    return top_contributors(tree_contributions(held_out, b.boosted.model), b.prepared.preprocessor.names, 8)


@query("risk_scores_reloaded", S.TXN, "SELECT CAST(0 AS BIGINT) AS differing, count(*) AS n_rows FROM txn")
def _reloaded(b):
    """Scores of the matrix by models written to a folder and read back, against those of the session's models."""
    from riskloom.plans.model_store import FittedModels
    from riskloom.plans.models import with_probability
    from riskloom.plans.scoring import risk_scores, score_transactions
    rows = with_probability(b.prepared.rows, b.boosted.model, "ml_probability")
    own, constants = score_transactions(rows, F.col("ml_probability"), F.col("isolation_forest_score"))
    folder = b.run_folder("models")
    FittedModels.of(b.prepared, b.boosted.model, constants).save(b.spark, folder)
    again = FittedModels.load(b.spark, folder).score(b.matrix.drop("split"))
    columns = [c for c in again.columns if c != "transaction_id"]
    both = risk_scores(own).select("transaction_id", F.struct(*columns).alias("x")).join(
        again.select("transaction_id", F.struct(*columns).alias("y")), "transaction_id", "full")
    return both.agg(F.count_if(~F.col("x").eqNullSafe(F.col("y"))).alias("differing"), F.count("*").alias("n_rows"))


@query("risk_scores_with_models")
def _model_scores(b):
    from riskloom.plans.models import with_probability
    from riskloom.plans.scoring import risk_scores, score_transactions
    rows = with_probability(b.prepared.rows, b.boosted.model, "ml_probability")
    return risk_scores(score_transactions(rows, F.col("ml_probability"), F.col("isolation_forest_score"))[0])


# ---------------------------------------------------------------- streaming
@query("stream_rule_firings", S.FIRED, f"""
    SELECT transaction_id, rule_id, severity, {d4('measure', 'measure')} FROM fired""")
def _stream_rules(b):
    from riskloom.streaming.scorer import start_scoring
    run = b.run_folder("scorer")
    start_scoring(b.arriving, b.star, f"{run}/firings", f"{run}/progress").awaitTermination()
    return b.spark.read.parquet(f"{run}/firings").select("transaction_id", "rule_id", "severity", r4("measure"))


@query("stream_velocity_counts", S.FEATURES, """
    SELECT transaction_id, n10 AS txn_count_last_10min, n60 AS txn_count_last_60min, f15 AS recent_failed_count_15min FROM feat""")
def _stream_velocity(b):
    from riskloom.streaming.counters import velocity_counts
    return b.finish(velocity_counts(b.arriving), "counters").drop("customer_id")


@query("stream_baseline_enrichment", S.FEATURES, f"""
    SELECT transaction_id, {d4('avg90', 'customer_avg', 2)}, {d4('std90', 'customer_std', 2)}, {d4('m_avg90', 'merchant_avg', 2)},
      {d4('m_rate90', 'merchant_rate')} FROM feat""")
def _stream_enrich(b):
    from riskloom.streaming.enrich import with_baselines
    out = with_baselines(b.arriving, customer_daily(b.star.txn), merchant_daily(b.star.txn, b.star.labels))
    return b.finish(out, "enrich").select(
        "transaction_id", r4("txn_amount_avg_90d", "customer_avg", 2), r4("txn_amount_stddev_90d", "customer_std", 2),
        r4("avg_txn_amount_90d", "merchant_avg", 2), r4("chargeback_rate_90d", "merchant_rate"))


@query("stream_alert_sessions", S.CASES, f"""
    SELECT customer_id, count(*) AS alerts, {d4('max(combined_score)', 'top_score', 5)}, {d4('sum(financial_exposure)', 'exposure', 2)},
      {t6('min(created_at)', 'first_at')}, {t6('max(created_at)', 'last_at')} FROM alerts
    GROUP BY customer_id, dedup_group_id
    HAVING max(created_at) + INTERVAL 60 MINUTE <= (SELECT date_trunc('millisecond', max(created_at)) - INTERVAL 1 DAY FROM alerts)""")
def _stream_sessions(b):
    from riskloom.streaming.sessions import alert_sessions
    folder = b.run_folder("alerts")
    b.alerts.repartition(4).write.parquet(f"{folder}/in")
    arriving = b.spark.readStream.schema(b.alerts.schema).parquet(f"{folder}/in")
    return b.finish(alert_sessions(arriving), "sessions").select(
        "customer_id", "alerts", r4("top_score", digits=5), r4("exposure", digits=2), ts_text("first_at", "first_at"),
        ts_text("last_at", "last_at"))

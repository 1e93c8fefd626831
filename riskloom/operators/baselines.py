"""Daily rolling baselines per customer and per merchant.

Transactions are summed to (entity, day) first -- map-side, so a hot entity shuffles one row per
task and day -- and every rolling value is then a window over at most one row per calendar day.
Money is counted in whole cents, which keeps the sums exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskloom.operators.spans import in_spans, window_spans
from riskloom.sources.star import labelled


def _cents() -> Column:
    return (F.col("amount") * 100).cast("long")


def _exact(whole: Column) -> Column:
    return whole.cast("decimal(19,0)")


def _money(cents: Column) -> Column:
    """Half-up to whole cents, as stored."""
    return (F.round(cents) / 100).cast("decimal(14,2)")


def mean_and_deviation() -> tuple[Column, Column]:
    """Mean and sample deviation, as stored, from the columns wn, ws, wq: number, sum and sum of squares of cents.

    Squares are about the whole cent m next below the mean, in decimals: q - 2ms + nm^2 loses nothing, where a
    difference of large doubles would. The rest of the mean is less than a cent.
    """
    n, s = F.col("wn"), F.col("ws")
    m = F.expr("ws div wn")
    about = F.col("wq") - 2 * _exact(m) * _exact(s) + _exact(n) * (_exact(m) * _exact(m))
    rest = (s - n * m).cast("double")
    spread = F.greatest(about.cast("double") - rest * rest / n, F.lit(0.0))
    return _money(s / n), F.when(n > 1, _money(F.sqrt(spread / (n - 1))))


def _day_no() -> Column:
    return F.unix_date("day")


def distinct_events(txn: DataFrame, key: str, items: list[str], back_days: int) -> DataFrame:
    """Day-stamped +1/-1 changes of "distinct items seen in the last ``back_days`` days".

    An item seen on day d counts on d..d+back_days, or until it is seen again. Its sorted set of
    days is bounded by the calendar, so no row-level set is ever collected.
    """
    seen = (
        txn.select(key, _day_no().alias("day_no"), F.explode(F.array(*[
            F.struct(F.lit(item).alias("item"), F.col(item).cast("long").alias("value")) for item in items
        ])).alias("i"))
        .filter("i.value is not null")
        .groupBy(key, "i.item", "i.value").agg(F.array_sort(F.collect_set("day_no")).alias("days"))
    )
    expiry = F.transform("days", lambda d, i: F.struct(
        d.alias("day_no"),
        F.least(d + back_days + 1, F.coalesce(F.try_element_at("days", i + 2), d + back_days + 1)).alias("until"),
    ))
    spans = seen.select(key, "item", F.explode(expiry).alias("s"))
    changes = F.explode(F.array(
        F.struct(F.col("s.day_no").alias("day_no"), F.lit(1).alias("change")),
        F.struct(F.col("s.until").alias("day_no"), F.lit(-1).alias("change")),
    ))
    return spans.select(key, "item", changes.alias("c")).select(key, "item", "c.day_no", "c.change")


def customer_daily(
    txn: DataFrame, amount_days: int = 90, distinct_days: int = 30,
) -> DataFrame:
    """One row per customer and active day, as of the close of that day (the day included)."""
    cents = _cents()
    facts = txn.groupBy("customer_id", _day_no().alias("day_no")).agg(
        F.count("*").alias("n"), F.sum(cents).alias("s"), F.sum(_exact(cents) * _exact(cents)).alias("q"))
    changes = distinct_events(txn, "customer_id", ["merchant_id", "device_id"], distinct_days)
    changes = changes.groupBy("customer_id", "day_no").agg(
        F.sum(F.when(F.col("item") == "merchant_id", F.col("change"))).alias("dm"),
        F.sum(F.when(F.col("item") == "device_id", F.col("change"))).alias("dd"))
    days = (
        facts.unionByName(changes, allowMissingColumns=True)
        .groupBy("customer_id", "day_no").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q", "dm", "dd")])
    )
    by_day = W.partitionBy("customer_id").orderBy("day_no")
    rolling = by_day.rangeBetween(-amount_days, 0)
    sofar = by_day.rangeBetween(W.unboundedPreceding, 0)
    n, s, q = (F.sum(c).over(rolling) for c in ("n", "s", "q"))
    days = days.select(
        "*", n.alias("wn"), s.alias("ws"), q.alias("wq"),
        F.sum("dm").over(sofar).alias("merchants"), F.sum("dd").over(sofar).alias("devices"),
    ).filter(F.col("n").isNotNull())
    mean, deviation = mean_and_deviation()
    return days.select(
        "customer_id",
        F.date_from_unix_date("day_no").alias("metric_date"),
        F.col("n").cast("int").alias("txn_count"),
        (F.col("s") / 100).cast("decimal(14,2)").alias("txn_amount_sum"),
        mean.alias("txn_amount_avg_90d"),
        deviation.alias("txn_amount_stddev_90d"),
        F.coalesce("merchants", F.lit(0)).cast("int").alias("distinct_merchants_30d"),
        F.coalesce("devices", F.lit(0)).cast("int").alias("distinct_devices_30d"),
    )


def merchant_daily(txn: DataFrame, labels: DataFrame, days_back: int = 90) -> DataFrame:
    """One row per merchant and active day; rolling values leave the day itself out."""
    cents = _cents()
    flagged = labelled(txn.select("transaction_id", "merchant_id", "day", "amount"), labels)
    days = flagged.groupBy("merchant_id", _day_no().alias("day_no")).agg(
        F.count("*").alias("n"), F.sum(cents).alias("s"), F.count_if("is_fraud").alias("f"))
    before = W.partitionBy("merchant_id").orderBy("day_no").rangeBetween(-days_back, -1)
    days = days.select("*", *[F.sum(c).over(before).alias(f"w{c}") for c in ("n", "s", "f")])
    return days.select(
        "merchant_id",
        F.date_from_unix_date("day_no").alias("metric_date"),
        F.col("n").cast("int").alias("txn_count"),
        (F.col("s") / 100).cast("decimal(14,2)").alias("txn_amount_sum"),
        mean_and_deviation()[0].alias("avg_txn_amount_90d"),
        (F.col("wf") / F.col("wn")).cast("decimal(6,4)").alias("chargeback_rate_90d"),
    )


def changed_daily(txn: DataFrame, changed: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame],
                  days_back: int = 90) -> tuple[DataFrame, DataFrame]:
    """Daily rows that changed transactions touch, computed anew, and the spans of days (key, spans) that they replace.

    ``changed``: key and day of transactions that came, went or were altered since the table was stored. A row's windows
    reach ``days_back`` days back, so a change touches the ``days_back`` days behind it, and these need the transactions of as
    many days before it. Only those are read; what the rows of other keys and days hold stays as it is.
    """
    touched = window_spans(changed, key, 0, days_back)
    rows = compute(in_spans(txn, window_spans(changed, key, days_back, days_back), key, "day"))
    return in_spans(rows, touched, key, "metric_date"), touched

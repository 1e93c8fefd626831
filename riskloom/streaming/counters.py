"""Velocity and failed-attempt counters as state by share of the customers and slice of time.

A slice is as long as the longest window, so a count looks into a row's own slice and the one before. Each arriving row goes
to its own slice, which answers it, and is handed to the next one, where it only stands for later rows to be counted. So
one customer's rows spread over as many groups as slices arrive, a group never holds more than two
slices, and its state is dropped when the watermark has passed its end.

Customers share a group by hash: a call and a state entry per customer and slice would cost more than their few rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riskloom.operators.slices import US_PER_MINUTE, floor_div
from riskloom.plans.features import FAILED_WINDOW_MIN, VELOCITY_LONG_MIN, VELOCITY_SHORT_MIN

#: Shares that the customers are dealt to. More of them make smaller groups and more calls.
SHARES = 16

_OUT = ("customer_id long, transaction_id long, txn_count_last_10min long, txn_count_last_60min long, "
        "recent_failed_count_15min long")
_STATE = "customers array<bigint>, times array<bigint>, failed array<boolean>"
#: Stands for an unknown customer, whose rows count together.
NO_CUSTOMER = -(1 << 63)


def _count_before(times: np.ndarray, at: np.ndarray, width_us: int) -> np.ndarray:
    """Sorted ``times`` inside [at - width, at)."""
    return np.searchsorted(times, at, "left") - np.searchsorted(times, at - width_us, "left")


def by_slice(arriving: DataFrame, width_us: int, shares: int = SHARES) -> DataFrame:
    """Each row under its customer's share and its own slice, and handed over to the next slice."""
    own = floor_div(F.col("ts_us"), width_us)
    return arriving.select(
        F.coalesce(F.col("customer_id").cast("long"), F.lit(NO_CUSTOMER)).alias("customer_id"),
        F.pmod(F.xxhash64("customer_id"), F.lit(shares)).alias("share"),
        "transaction_id", "transaction_ts", "ts_us", (F.col("status") == "FAILED").alias("failed"),
        F.inline(F.array(F.struct(own.alias("slice_no"), F.lit(False).alias("handed")),
                         F.struct((own + 1).alias("slice_no"), F.lit(True).alias("handed")))))


def velocity_counts(arriving: DataFrame, late: str = "1 day", short_min: int = VELOCITY_SHORT_MIN,
                    long_min: int = VELOCITY_LONG_MIN, failed_min: int = FAILED_WINDOW_MIN) -> DataFrame:
    """Counts of strictly earlier rows per arriving row. Rows later than ``late`` are discarded by the watermark."""
    longest = max(short_min, long_min, failed_min) * US_PER_MINUTE

    def update(key: tuple, pages: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        page = pd.concat(list(pages))
        old = state.get if state.exists else ([], [], [])
        who = np.concatenate([np.array(old[0], np.int64), page["customer_id"].to_numpy(np.int64)])
        at = np.concatenate([np.array(old[1], np.int64), page["ts_us"].to_numpy(np.int64)])
        failing = np.concatenate([np.array(old[2], bool), page["failed"].fillna(False).to_numpy(bool)])
        # All customers on one line, so far apart that no window reaches from one to the next; a group spans two slices.
        place = np.unique(who, return_inverse=True)[1] * (4 * longest) + (at - (int(key[1]) - 1) * longest)
        times, failed = np.sort(place), np.sort(place[failing])
        own = ~page["handed"].to_numpy(bool)
        asked = place[len(old[0]):][own]
        answered = page["customer_id"][own]
        yield pd.DataFrame({
            "customer_id": answered.astype("Int64").mask(answered == NO_CUSTOMER), "transaction_id": page["transaction_id"][own],
            "txn_count_last_10min": _count_before(times, asked, short_min * US_PER_MINUTE),
            "txn_count_last_60min": _count_before(times, asked, long_min * US_PER_MINUTE),
            "recent_failed_count_15min": _count_before(failed, asked, failed_min * US_PER_MINUTE)})
        state.update((who.tolist(), at.tolist(), failing.tolist()))
        end = (int(key[1]) + 1) * longest
        state.setTimeoutTimestamp(max(end // 1000, state.getCurrentWatermarkMs()) + 1)

    return (
        by_slice(arriving.withWatermark("transaction_ts", late), longest).groupBy("share", "slice_no")
        .applyInPandasWithState(update, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )

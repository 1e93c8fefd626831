"""What the rules must know of a customer's and a merchant's past, as typed state of a stream.

Both processors keep sums by day, as baselines are defined on closed days. A customer also has the rows that a later or
late arrival may still look back on, counts by hour of all older ones, the last of these, and the first time of each
device, location and merchant. Rows go from the first to the second kind of state when the watermark has left them behind by
the longest window; a timer does that for customers from whom nothing more arrives. Customers share a
group by hash, whose state a micro-batch reads and writes once. So the state of a customer grows with days and distinct
items, not with rows, and a micro-batch reads no earlier rows.

Rows are told from each other by (time, id), as in the batch plans. A late row is placed at its own time; rows that were
answered before it are not revised. Rows later than the watermark are dropped by Spark.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Iterator
from decimal import Decimal
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from riskloom.operators.slices import US_PER_DAY, US_PER_MINUTE, floor_sql

BASELINE_DAYS = 90
KINDS = ("device", "location", "merchant")
#: Stands for an unknown item, which counts as an item of its own.
NO_ITEM = -(1 << 63)

ARRIVAL = ("customer_id long, merchant_id long, transaction_id long, transaction_ts timestamp, ts_us long, hour long, status string, "
           "cents long, device_id long, location_id long, lat double, lon double")
_moment = itemgetter(0, 1)

#: After the merchant's history, and after the customer's.
MERCHANT_OUT = ARRIVAL + ", merchant_n long, merchant_s long"
CUSTOMER_OUT = ("customer_id long, merchant_id long, transaction_id long, transaction_ts timestamp, ts_us long, hour long, status string, "
                "cents long, lat double, lon double, merchant_n long, merchant_s long, short_count long, long_count long, "
                "failed_count long, new_device boolean, new_location boolean, prev_us long, prev_lat double, prev_lon double, "
                "prior_count long, hour_count long, wn long, ws long, wq decimal(38,0)")
START = "entity long, kind string, a long, b long, c long, q decimal(38,0), hour long, failed boolean, lat double, lon double"

#: Shares that the customers are dealt to. A call, a timer and a batch for each customer would cost more than its few rows.
SHARES = 1024


class DaySums:
    """Number, sum and sum of squares by day, sorted by day."""

    def __init__(self, stored: tuple | None):
        day, n, s, q = stored or ((), (), (), ())
        self.sums = {int(d): (int(a), int(b), int(c)) for d, a, b, c in zip(day, n, s, q)}

    def add(self, day: int, n: int, s: int, q: int) -> None:
        a, b, c = self.sums.get(day, (0, 0, 0))
        self.sums[day] = (a + n, b + s, c + q)

    def add_rows(self, days: np.ndarray, cents: np.ndarray) -> None:
        for d in np.unique(days).tolist():
            own = cents[days == d].tolist()
            self.add(d, len(own), sum(own), sum(c * c for c in own))

    def before(self, day: int, with_last: bool) -> tuple[int | None, int | None, int | None]:
        """Sums over the window of the last active day before ``day``: that day and the BASELINE_DAYS before it.

        Without that day itself, if ``with_last`` is not set. None where there is no such day.
        """
        earlier = [d for d in self.sums if d < day]
        if not earlier:
            return None, None, None
        last = max(earlier)
        own = [v for d, v in self.sums.items() if last - BASELINE_DAYS <= d and (d <= last if with_last else d < last)]
        return tuple(sum(v[i] for v in own) for i in range(3)) if own else (None, None, None)

    def stored(self, watermark_day: int) -> tuple:
        """What a row of ``watermark_day`` or later can still need."""
        earlier = [d for d in self.sums if d < watermark_day]
        least = max(earlier) - BASELINE_DAYS if earlier else min(self.sums)
        kept = sorted((d, *v) for d, v in self.sums.items() if d >= least)
        return [r[0] for r in kept], [r[1] for r in kept], [r[2] for r in kept], [Decimal(r[3]) for r in kept]


_DAYS = "day array<int>, n array<bigint>, s array<bigint>, q array<decimal(38,0)>"


def _baselines(sums: DaySums, days: np.ndarray, with_last: bool) -> list[tuple]:
    of_day = {d: sums.before(d, with_last) for d in np.unique(days).tolist()}
    return [of_day[d] for d in days.tolist()]


#: Place of the recent rows' times in a stored past.
TIMES = 9


class Past:
    """What is known of one customer; ``recent`` has (time, id, failed, hour, lat, lon), ``seen`` the first (time, id) by kind and item."""

    def __init__(self, stored: tuple | None):
        if stored is None:
            self.days, self.hours, self.last, self.recent, self.seen = DaySums(None), [0] * 24, None, [], {}
            return
        self.days, self.hours = DaySums(tuple(stored[:4])), list(stored[4])
        self.last = None if stored[5] is None else tuple(stored[5:9])
        self.recent = list(zip(*stored[9:15]))
        self.seen = dict(zip(zip(stored[15], stored[16]), zip(stored[17], stored[18])))

    def stored(self, watermark_day: int | None) -> tuple:
        """As kept in the state; without a watermark all days are kept."""
        days = self.days.stored(min(self.days.sums) if watermark_day is None else watermark_day) if self.days.sums else ([], [], [], [])
        columns = [list(c) for c in zip(*self.recent)] or [[] for _ in range(6)]
        seen = [(*item, *first) for item, first in self.seen.items()]
        firsts = [list(c) for c in zip(*seen)] or [[] for _ in range(4)]
        return (*days[:3], [int(q) for q in days[3]], self.hours, *(self.last or (None,) * 4), *columns, *firsts)

    def retire(self, until_us: int) -> None:
        """Recent rows before ``until_us``, on which no row to come can look back, are counted by hour."""
        gone = bisect_left(self.recent, (until_us,))
        for r in self.recent[:gone]:
            self.hours[r[3]] += 1
        if gone:
            r = self.recent[gone - 1]
            self.last = (r[0], r[1], r[4], r[5])
        self.recent = self.recent[gone:]

    def first(self, kind: int, items: list, at: list[tuple]) -> list[bool]:
        """Which of the rows (sorted by time) are the first of their item."""
        out, met = [False] * len(items), set()
        for i, (item, here) in enumerate(zip(items, at)):
            if item in met:
                continue
            met.add(item)
            known = self.seen.get((kind, item))
            if known is None or here < known:
                out[i] = True
                self.seen[kind, item] = here
        return out


class CustomerHistory(StatefulProcessor):
    """Adds to each arriving row of a share what its customer did before it."""

    def __init__(self, short_min: int, long_min: int, failed_min: int):
        self.short, self.long, self.failed = (m * US_PER_MINUTE for m in (short_min, long_min, failed_min))
        self.longest = max(self.short, self.long, self.failed)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # A call of the state costs more than a customer's rows: a share has one value, its customers' pasts packed.
        self.share = handle.getValueState("share", "pasts binary, timer bigint")

    def _load(self) -> tuple[dict[int, tuple], int]:
        """The stored pasts by customer, and the time of the share's timer (0: none is set)."""
        packed, timer = self.share.get() or (None, 0)
        return (pickle.loads(bytes(packed)) if packed else {}), timer

    def _store(self, pasts: dict[int, tuple], timer: int) -> None:
        """Sets the timer, unless it is set, to when the last recent row can retire."""
        newest = max((p[TIMES][-1] for p in pasts.values() if p[TIMES]), default=None)
        if newest is not None and not timer:
            timer = (newest + self.longest) // 1000 + 1
            self.handle.registerTimer(timer)
        self.share.update((pickle.dumps(pasts, pickle.HIGHEST_PROTOCOL), timer))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N803  names of the interface
        """Takes the rows of ``customer_start``; a share and a customer may come in several pages."""
        stored, timer = self._load()
        pasts: dict[int, Past] = {}
        for r in initialState.itertuples(index=False):
            who = int(r.customer_id)
            if who not in pasts:
                pasts[who] = Past(stored.get(who))
            past = pasts[who]
            if r.kind == "day":
                past.days.add(int(r.a), int(r.b), int(r.c), int(r.q))
            elif r.kind == "hour":
                past.hours[int(r.a)] += int(r.b)
            elif r.kind == "last":
                past.last = (int(r.a), int(r.b), r.lat, r.lon)
            elif r.kind == "recent":
                past.recent.append((int(r.a), int(r.b), bool(r.failed), int(r.hour), r.lat, r.lon))
            else:
                past.seen[KINDS.index(r.kind), int(r.a)] = (int(r.b), int(r.c))
        for who, past in pasts.items():
            past.recent.sort(key=_moment)
            stored[who] = past.stored(None)
        self._store(stored, timer)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        page = pd.concat(list(rows)).sort_values(["customer_id", "ts_us", "transaction_id"], kind="stable").reset_index(drop=True)
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        who, ts = page["customer_id"].to_numpy(np.int64), page["ts_us"].to_numpy(np.int64)
        cents, day = page["cents"].to_numpy(np.int64), ts // US_PER_DAY
        # The timeline has rows of a known location only; the others count for the sums.
        located = page["lat"].notna().to_numpy()
        line = list(zip(ts.tolist(), page["transaction_id"].to_numpy(np.int64).tolist(), (page["status"] == "FAILED").tolist(),
                        page["hour"].where(located, 0).astype(int).tolist(), page["lat"].tolist(), page["lon"].tolist()))
        items = [page[f"{kind}_id"].fillna(NO_ITEM).astype("int64").to_numpy() for kind in KINDS]
        answers, (pasts, timer) = [], self._load()
        cuts = [*np.flatnonzero(np.diff(who, prepend=who[0] - 1 if who[0] > NO_ITEM else who[0] + 1)).tolist(), len(who)]
        for start, end in zip(cuts[:-1], cuts[1:]):
            customer = int(who[start])
            past = Past(pasts.get(customer))
            past.days.add_rows(day[start:end], cents[start:end])
            at = start + np.flatnonzero(located[start:end])
            if len(at):
                answers += self._answers(past, [line[i] for i in at.tolist()], day[at], [c[at].tolist() for c in items])
                past.retire(watermark - self.longest)
            pasts[customer] = past.stored(watermark // US_PER_DAY)
        self._store(pasts, timer)
        if answers:
            page = page[located].reset_index(drop=True)
            told = dict(zip(("short_count", "long_count", "failed_count", "new_device", "new_location", "prev_us", "prev_lat",
                             "prev_lon", "prior_count", "hour_count", "wn", "ws", "wq"), zip(*answers)))
            optional = ("prev_us", "prev_lat", "prev_lon", "wn", "ws", "wq")
            yield page[["customer_id", "merchant_id", "transaction_id", "transaction_ts", "ts_us", "hour", "status", "cents", "lat", "lon",
                        "merchant_n", "merchant_s"]].assign(
                customer_id=page["customer_id"].astype("Int64").mask(page["customer_id"] == NO_ITEM),
                **{name: pd.Series(values, dtype=object) if name in optional else list(values) for name, values in told.items()})

    def _answers(self, past: Past, own: list[tuple], day: np.ndarray, items: list[list]) -> list[tuple]:
        """For one customer's rows, sorted by time, what the rules must know; they become recent rows."""
        past.recent = line = sorted([*past.recent, *own], key=_moment)
        times, failed = [r[0] for r in line], [r[0] for r in line if r[2]]
        place = {r[:2]: i for i, r in enumerate(line)}
        in_hour, by_hour = [], list(past.hours)
        for r in line:
            in_hour.append(by_hour[r[3]])
            by_hour[r[3]] += 1
        older, moments = sum(past.hours), [r[:2] for r in own]
        fresh = [past.first(kind, of, moments) for kind, of in enumerate(items)]
        count = lambda times, t, width: bisect_left(times, t) - bisect_left(times, t - width)
        out = []
        for k, (moment, baseline) in enumerate(zip(moments, _baselines(past.days, day, True))):
            i, t = place[moment], moment[0]
            before = (line[i - 1][0], *line[i - 1][4:]) if i else (past.last[0], *past.last[2:]) if past.last else (None, None, None)
            out.append((count(times, t, self.short), count(times, t, self.long), count(failed, t, self.failed), fresh[0][k], fresh[1][k],
                        *before, older + i, in_hour[i], *baseline[:2], None if baseline[2] is None else Decimal(baseline[2])))
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        watermark, (pasts, _) = timerValues.getCurrentWatermarkInMs() * 1000, self._load()
        for customer, stored in pasts.items():
            if stored[TIMES] and stored[TIMES][0] < watermark - self.longest:
                past = Past(stored)
                past.retire(watermark - self.longest)
                pasts[customer] = past.stored(None)
        self._store(pasts, 0)
        return iter([])

    def close(self) -> None:
        pass


class MerchantHistory(StatefulProcessor):
    """Adds to each arriving row the sums of its merchant's last closed window."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.days = handle.getValueState("days", _DAYS)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N803
        days = DaySums(self.days.get())
        for r in initialState.itertuples(index=False):
            days.add(int(r.a), int(r.b), int(r.c), 0)
        if days.sums:
            self.days.update(days.stored(min(days.sums)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        page = pd.concat(list(rows))
        day = page["ts_us"].to_numpy(np.int64) // US_PER_DAY
        sums = DaySums(self.days.get())
        for d in np.unique(day).tolist():
            own = page["cents"].to_numpy(np.int64)[day == d]
            sums.add(d, len(own), int(own.sum()), 0)
        self.days.update(sums.stored(timerValues.getCurrentWatermarkInMs() * 1000 // US_PER_DAY))
        baseline = _baselines(sums, day, False)
        yield page.assign(merchant_n=pd.Series([b[0] for b in baseline], dtype=object, index=page.index),
                          merchant_s=pd.Series([b[1] for b in baseline], dtype=object, index=page.index))

    def close(self) -> None:
        pass


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` with their customer's ``share``; NO_ITEM stands for an unknown customer."""
    who = F.coalesce(F.col("customer_id").cast("long"), F.lit(NO_ITEM))
    return rows.withColumns({"customer_id": who, "share": F.pmod(F.xxhash64(who), F.lit(SHARES))})


def _start(df: DataFrame, entity: str, kind: str, **columns: str) -> DataFrame:
    """Rows of the start state: the named columns as given, the others null."""
    fields = [f.split() for f in START.split(", ")][2:]
    return df.select(F.col(entity).cast("long").alias("entity"), F.lit(kind).alias("kind"),
                     *[F.expr(columns.get(name, "null")).cast(of_type).alias(name) for name, of_type in fields])


def customer_start(arrived: DataFrame, late_us: int, longest_us: int) -> DataFrame:
    """State after the stored rows ``arrived`` (columns of ARRIVAL), as rows for ``handleInitialState``.

    All of it is counted by Spark before anything is dealt to state: one row for each day, hour and distinct item.
    """
    newest = arrived.agg(F.max("ts_us")).first()[0] or 0
    line = arrived.filter("lat is not null").withColumn("recent", F.col("ts_us") >= newest - late_us - longest_us)
    older, by = line.filter("not recent"), "customer_id"
    parts = [
        _start(arrived.groupBy(by, F.expr(floor_sql("ts_us", US_PER_DAY)).alias("day")).agg(
            F.count("*").alias("n"), F.sum("cents").alias("s"), F.sum(F.expr("cast(cents as decimal(19,0)) * cents")).alias("q")),
            by, "day", a="day", b="n", c="s", q="q"),
        _start(older.groupBy(by, "hour").count(), by, "hour", a="hour", b="count"),
        _start(older.groupBy(by).agg(F.max(F.struct("ts_us", "transaction_id", "location_id", "lat", "lon")).alias("r")), by, "last",
               a="r.ts_us", b="r.transaction_id", lat="r.lat", lon="r.lon"),
        _start(line.filter("recent"), by, "recent", a="ts_us", b="transaction_id", c="location_id", hour="hour",
               failed="coalesce(status = 'FAILED', false)", lat="lat", lon="lon"),
        *[_start(line.groupBy(by, f"{kind}_id").agg(F.min(F.struct("ts_us", "transaction_id")).alias("f")), by, kind,
                 a=f"coalesce({kind}_id, {NO_ITEM})", b="f.ts_us", c="f.transaction_id") for kind in KINDS]]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def merchant_start(arrived: DataFrame) -> DataFrame:
    days = arrived.groupBy("merchant_id", F.expr(floor_sql("ts_us", US_PER_DAY)).alias("day")).agg(F.count("*").alias("n"), F.sum("cents").alias("s"))
    return _start(days, "merchant_id", "day", a="day", b="n", c="s")

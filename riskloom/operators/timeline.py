"""Per-entity timelines: trailing counts, running counts, previous row, first occurrences.

One exchange brings everything a slice needs into one window partition of (entity, slice):

* the transactions themselves;
* *expiries*: a transaction counted in a trailing window of width w adds +1 at its own time and -1
  at time + w, so a trailing count is a running sum of changes -- linear, where a sliding frame
  would rescan the window for every row;
* *marks*: the first occurrence of a (entity, item) pair, from a pre-aggregated minimum;
* one *carry* per (entity, slice): everything the earlier slices add up to, from a prefix window
  over per-slice totals.

Only entities above ``max_rows`` of the slicing are cut; every other one is a single slice and needs no carry.

Counts are of rows strictly earlier in time, [t - w, t); "previous row" and first occurrences break
equal times by ``transaction_id``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskloom.operators.slices import US_PER_DAY, US_PER_HOUR, Slicing, floor_div, floor_sql


@dataclass(frozen=True)
class Trailing:
    """A trailing count over [t - width_us, t), optionally of rows matching a SQL condition only."""

    width_us: int
    where: str | None = None


def _no_long() -> Column:
    return F.lit(None).cast("long")


def _events(txn: DataFrame, key: str, trailing: dict[str, Trailing]) -> DataFrame:
    """The transactions and their expiries: (key, at, id, rec, d_<name>...)."""
    payload = [c for c in txn.columns if c != key]
    rec = F.struct(*payload)
    rec_type = txn.select(rec.alias("r")).schema["r"].dataType

    def event(at: Column, row_id: Column, body: Column, changes: dict[str, Column]) -> Column:
        return F.struct(
            at.alias("at"), row_id.alias("id"), body.alias("rec"),
            *[changes.get(n, F.lit(0)).cast("int").alias(f"d_{n}") for n in trailing],
        )

    matched = {n: F.lit(True) if t.where is None else F.coalesce(F.expr(t.where), F.lit(False)) for n, t in trailing.items()}
    ts = F.col("ts_us")
    parts = [event(ts, F.col("transaction_id"), rec, {n: m.cast("int") for n, m in matched.items()})]
    for name, spec in trailing.items():
        leave = event(ts + spec.width_us, _no_long(), F.lit(None).cast(rec_type), {name: F.lit(-1)})
        parts.append(leave if spec.where is None else F.when(matched[name], leave))
    return txn.select(key, F.inline(F.array_compact(F.array(*parts))))


def first_occurrences(txn: DataFrame, key: str, items: dict[str, list[str]], slicing: Slicing) -> DataFrame:
    """One mark per (entity, item value) at its first row. ``items``: mark name -> key columns.

    All marks come from one grouped minimum over an exploded scan, combined map-side.
    """
    pairs = F.explode(F.array(*[
        F.struct(F.lit(name).alias("mark"),
                 *[(F.unix_date(cols[i]) if cols[i] == "day" else F.col(cols[i]).cast("long")).alias(f"k{i}")
                   if i < len(cols) else _no_long().alias(f"k{i}") for i in range(2)])
        for name, cols in items.items()
    ]))
    first = F.min(F.struct(F.col("ts_us").alias("at"), F.col("transaction_id").alias("id")))
    firsts = (
        txn.select(key, "ts_us", "transaction_id", pairs.alias("p"))
        .groupBy(key, "p.mark", "p.k0", "p.k1").agg(first.alias("f"))
        .select(key, "mark", "f.at", "f.id")
    )
    flags = [F.max(F.when(F.col("mark") == name, 1)).cast("int").alias(f"m_{name}") for name in items]
    return slicing.add(firsts.groupBy(key, "at", "id").agg(*flags), "at")


def _slice_totals(txn: DataFrame, slicing: Slicing, trailing: dict[str, Trailing], hours: bool) -> DataFrame:
    """Per (entity, slice): row count, first time, last row, hour counts, net change of each count.

    A row whose expiry falls into its own slice nets to zero there, so only crossings are expanded.
    """
    key = slicing.key
    rows = slicing.add(txn).filter("split is not null")
    stay = ["1 as n", "ts_us as first_at",
            "struct(ts_us as at, transaction_id as id, where_at) as last", "hour",
            *[f"{_crossing(n, t, 1)} as t_{n}" for n, t in trailing.items()]]
    if any(t.where is not None for t in trailing.values()):
        rows = rows.select("*", *[
            F.coalesce(F.expr(t.where), F.lit(False)).alias(f"w_{n}") for n, t in trailing.items() if t.where is not None])
    last_type = rows.selectExpr(f"{stay[2]}").schema["last"].dataType.simpleString()
    leave = [
        f"case when {_crossing(n, t, 1)} = 1 then struct({floor_sql(f'ts_us + {t.width_us}', 'slice_us')} as slice_no, 0 as n, "
        f"cast(null as bigint) as first_at, cast(null as {last_type}) as last, cast(null as bigint) as hour, "
        + ", ".join(f"{-1 if m == n else 0} as t_{m}" for m in trailing) + ") end"
        for n, t in trailing.items()
    ]
    changes = ", ".join([f"struct(slice_no, {', '.join(stay)})", *leave])
    rows = rows.selectExpr(key, "slice_us", f"inline(array_compact(array({changes})))")
    aggs = ["sum(n) as n", "min(first_at) as first_at", "max(last) as last", *[f"sum(t_{n}) as t_{n}" for n in trailing]]
    if hours:
        aggs += [f"count_if(hour = {h}) as h{h}" for h in range(24)]
    return rows.groupBy(key, "slice_no", "slice_us").agg(*[F.expr(a) for a in aggs])


def _crossing(name: str, spec: Trailing, change: int) -> str:
    """SQL: ``change`` if the row counts and leaves its window in a later slice, else 0."""
    counted = "true" if spec.where is None else f"w_{name}"
    return f"case when {counted} and {floor_sql(f'ts_us + {spec.width_us}', 'slice_us')} <> slice_no then {change} else 0 end"


def _carries(totals: DataFrame, key: str, trailing: dict[str, Trailing], hours: bool) -> DataFrame:
    """What every slice with transactions has to know about earlier slices."""
    earlier = f"over (partition by {key} order by slice_no rows between unbounded preceding and 1 preceding)"
    columns = [
        f"coalesce(sum(n) {earlier}, 0) as c_n",
        f"min(first_at) {earlier} as c_first",
        f"max(last) {earlier} as c_last",
        *[f"coalesce(sum(t_{n}) {earlier}, 0) as c_{n}" for n in trailing],
    ]
    if hours:
        columns.append("array(" + ", ".join(f"coalesce(sum(h{h}) {earlier}, 0)" for h in range(24)) + ") as c_hours")
    today = earlier.replace(f"by {key}", f"by {key}, _day", 1)
    today = f"coalesce(sum(n) {today}, 0L)"
    return (
        totals.withColumn("_day", F.expr(floor_sql("slice_no * slice_us", US_PER_DAY)))
        .selectExpr(key, "slice_no", "n", "slice_no * slice_us - 1 as at", "true as carry", *columns, f"{today} as c_today")
        .filter("n > 0").drop("n")
    )


def entity_timeline(
    txn: DataFrame, slicing: Slicing, trailing: dict[str, Trailing], *,
    first_of: dict[str, list[str]] | None = None, hours: bool = False,
) -> DataFrame:
    """Adds point-in-time columns to ``txn``.

    ``prior_count``, ``prev_us``, ``prev_where`` (the previous row's ``where_at`` column, if given),
    ``first_us`` (entity's first time, null on its first row), ``today_count``, ``today_last_us``;
    per trailing spec its count; with ``hours`` ``hour_count``; per ``first_of`` name a boolean, and
    for the name ``merchant_today`` the number of distinct values seen earlier that day.
    """
    first_of = first_of or {}
    if slicing.width_us != US_PER_DAY:
        raise ValueError("timelines are cut by day")
    if "where_at" not in txn.columns:
        txn = txn.withColumn("where_at", _no_long())
    if not slicing.whole:
        raise ValueError("timelines need a slicing that leaves entities whole where it can")
    key, cut = slicing.key, slicing.splits is not None
    parts = slicing.add(_events(txn, key, trailing), "at").drop("split", "slice_us")
    if first_of:
        marks = first_occurrences(txn, key, first_of, slicing)
        parts = parts.unionByName(marks.drop("split", "slice_us"), allowMissingColumns=True)
    if cut:
        totals = _slice_totals(txn, slicing, trailing, hours)
        parts = parts.unionByName(_carries(totals, key, trailing, hours), allowMissingColumns=True)
        if "merchant_today" in first_of:
            parts = parts.unionByName(_today_carry(totals, marks.filter("split is not null"), key), allowMissingColumns=True)

    # The carry sits one microsecond before its slice, so every frame that looks back includes it. It counts
    # for the slice's own day.
    cell = f"partition by {key}, slice_no order by at"
    rows_before = f"over ({cell}, id rows between unbounded preceding and 1 preceding)"
    peers = f"over ({cell}, id range between current row and current row)"
    strictly_before = f"over ({cell} range between unbounded preceding and 1 preceding)"
    today = f"over (partition by {key}, slice_no, _day order by at range between unbounded preceding and 1 preceding)"
    this_hour = f"over (partition by {key}, slice_no, _hour order by at, id rows between unbounded preceding and 1 preceding)"
    flags = [n for n in first_of if n != "merchant_today"]
    def carry(name: str, own: str) -> str:
        return f"coalesce(c_{name}, {own})" if cut else own

    real = "case when rec is not null then struct(at, id, rec.where_at as where_at) end"
    parts = parts.selectExpr(
        "*", "rec is not null as _real", f"pmod(at, {US_PER_DAY}) div {US_PER_HOUR} as _hour",
        f"{floor_sql('at + int(coalesce(carry, false))' if cut else 'at', US_PER_DAY)} as _day",
        f"coalesce({real}, c_last) as _here" if cut else f"{real} as _here",
    ).selectExpr(
        "*",
        f"coalesce(sum({carry('n', 'int(_real)')}) {rows_before}, 0) as _n",
        f"last(_here, true) {rows_before} as _prev",
        f"min({carry('first', 'case when _real then at end')}) {rows_before} as _first",
        *[f"max(m_{name}) {peers} as _first_{name}" for name in flags],
        f"max(_here.at) {strictly_before} as _last_us",
        *[f"coalesce(sum(coalesce(d_{n}, {f'c_{n}, ' if cut else ''}0)) {strictly_before}, 0) as _w_{n}" for n in trailing],
        *([f"last(c_hours, true) {rows_before} as _c_hours"] if hours and cut else []),
    ).selectExpr(
        "*", f"coalesce(sum({carry('today', 'int(_real)')}) {today}, 0) as _today_n",
        *([f"coalesce(sum(m_merchant_today) {today}, 0) as _today_merchants"] if "merchant_today" in first_of else []))
    if hours:
        earlier = "coalesce(_c_hours[cast(_hour as int)], 0) + " if cut else ""
        parts = parts.selectExpr("*", f"{earlier}coalesce(sum(int(_real)) {this_hour}, 0) as _hour_n")
    out = [
        "_n as prior_count", "_prev.at as prev_us", "_prev.where_at as prev_where", "_first as first_us",
        "_today_n as today_count",
        f"case when {floor_sql('_last_us', US_PER_DAY)} = _day then _last_us end as today_last_us",
        *[f"_w_{n} as {n}" for n in trailing],
        *[f"coalesce(_first_{name} = 1, false) as first_{name}" for name in flags],
        *(["_hour_n as hour_count"] if hours else []),
        *(["_today_merchants as today_merchants"] if "merchant_today" in first_of else []),
    ]
    return parts.filter("_real").selectExpr(key, "rec.*", *out).drop("where_at")


def _today_carry(totals: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """For split days: distinct merchants of the same day in earlier slices, just before each slice."""
    start = F.col("slice_no") * F.col("slice_us")
    cells = (
        totals.filter("n > 0").select(key, "slice_no", "slice_us", F.lit(0).cast("long").alias("m"))
        .unionByName(marks.filter("m_merchant_today is not null").select(
            key, "slice_no", "slice_us", F.lit(1).cast("long").alias("m")))
        .groupBy(key, "slice_no", "slice_us").agg(F.sum("m").alias("m"))
        .withColumn("_day", floor_div(start, US_PER_DAY))
    )
    same_day = W.partitionBy(key, "_day").orderBy("slice_no").rowsBetween(W.unboundedPreceding, -1)
    return cells.select(
        key, "slice_no", (start - 1).alias("at"), F.lit(True).alias("carry"),
        F.sum("m").over(same_day).cast("int").alias("m_merchant_today"),
    ).filter("m_merchant_today > 0")

"""Sinks and the stored-table jobs end to end on the small tables."""

import datetime as dt

from pyspark.sql import functions as F

from riskloom import jobs
from riskloom.operators.baselines import customer_daily, merchant_daily
from riskloom.plans.quality import quality_checks
from riskloom.plans.search import transaction_rules
from riskloom.sources import read_star, read_table, sinks


def test_upsert_replaces_named_days_only(spark, tmp_path):
    path = f"{tmp_path}/daily"
    day = lambda d: dt.date(2024, 1, d)
    sinks.upsert_days(spark.createDataFrame([(1, day(1), 1), (1, day(2), 1)], "k long, metric_date date, v int"), path)
    change = spark.createDataFrame([(1, day(2), 9), (2, day(2), 9), (1, day(3), 9)], "k long, metric_date date, v int")
    sinks.upsert_days(change, path)
    sinks.upsert_days(change, path)
    got = sorted((r.k, r.metric_date.day, r.v) for r in spark.read.parquet(path).collect())
    assert got == [(1, 1, 1), (1, 2, 9), (1, 3, 9), (2, 2, 9)]


def test_keyed_upsert_frame(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert sorted(map(tuple, sinks.upsert_rows(now, new, ["k"]).collect())) == [(1, "a"), (2, "B"), (3, "C")]


def test_log_rows_are_appended_once(spark, tmp_path):
    path, rows = f"{tmp_path}/log", spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "case_id long, seq long, note string")
    sinks.append_new(rows, None, path, ["case_id", "seq"])
    more = rows.unionByName(spark.createDataFrame([(2, 1, "c")], rows.schema))
    for _ in range(2):
        sinks.append_new(more, spark.read.parquet(path), path, ["case_id", "seq"])
    assert sorted(r.note for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]


def test_a_day_has_few_files(spark, tmp_path):
    rows = spark.range(4000).selectExpr("id as k", "date_add(date'2024-01-01', int(id % 10)) as metric_date", "1 as v").repartition(16)
    sinks.upsert_days(rows, f"{tmp_path}/d")
    files = list(tmp_path.glob("d/metric_date=*/*.parquet"))
    assert 10 <= len(files) <= 20


def test_jobs_on_stored_tables(spark, small, tmp_path):
    root = str(tmp_path)
    jobs.load_star(small, root, files=2)
    star = read_star(spark, root)
    assert star.txn.count() == small.txn.count()
    checks = {r.check_name: r.violations for r in quality_checks(star).collect()}
    assert checks["duplicate_ids"] == checks["unknown_customer"] == checks["unknown_location"] == 0

    report = jobs.run_baselines(spark, root).first()
    assert report.customer_rows == read_table(spark, root, "fact_customer_daily_metrics").count() > 0
    jobs.run_rules(spark, root)
    firings = read_table(spark, root, "rules_triggered")
    some = firings.first().transaction_id
    assert [r.rule_id for r in transaction_rules(firings, some).collect()] == sorted(
        r.rule_id for r in firings.filter(F.col("transaction_id") == some).collect())

    grid = [{"maxDepth": 2, "maxIter": 2, "stepSize": 0.1}]
    jobs.run_scoring(spark, root, grid).collect()
    scores = read_table(spark, root, "risk_scores")
    assert scores.count() == star.txn.count() and scores.filter("combined_score not between 0 and 1").count() == 0
    metrics = {r.risk_tier: r for r in jobs.run_investigation(spark, root).collect()}
    alerts = read_table(spark, root, "fraud_alerts")
    assert metrics["ALL"].total_cases == alerts.count() == scores.filter("risk_tier in ('HIGH', 'CRITICAL')").count()


def test_a_late_transaction_rewrites_the_days_it_touches(spark, small, tmp_path):
    """Equal to a full run; partitions of days before it stay as they are."""
    late = small.txn.filter("transaction_id % 97 = 5 and dayofmonth(day) >= 20").orderBy("transaction_id").limit(3)
    ids = [r.transaction_id for r in late.collect()]
    early, root = small.txn.filter(~F.col("transaction_id").isin(ids)), str(tmp_path)
    sinks.refresh_baselines(spark, lambda: customer_daily(early), lambda: merchant_daily(early, small.labels), root)
    tables = {"customer": lambda: customer_daily(small.txn), "merchant": lambda: merchant_daily(small.txn, small.labels)}
    files = lambda name: {f: f.stat().st_mtime_ns for f in (tmp_path / f"fact_{name}_daily_metrics").rglob("*.parquet")}
    before = {name: files(name) for name in tables}
    changed = small.txn.filter(F.col("transaction_id").isin(ids))
    report = jobs.refresh_changed_days(spark, small, changed, root).first()
    for name, full in tables.items():
        kept = {f for f, at in files(name).items() if before[name].get(f) == at}
        key = f"{name}_id"
        touched = full().join(changed.groupBy(key).agg(F.min("day").alias("since")), key).filter("metric_date >= since")
        days = {f"metric_date={r.metric_date}" for r in touched.collect()}
        assert kept == {f for f in before[name] if f.parent.name not in days} and kept
        stored = spark.read.parquet(f"{root}/fact_{name}_daily_metrics")
        assert sorted(map(tuple, stored.select(full().columns).collect())) == sorted(map(tuple, full().collect()))
        assert 0 < report[f"{name}_rows"] < full().count()
    assert jobs.refresh_changed_days(spark, small, changed.limit(0), root).first().customer_days == 0


def test_clustered_facts_are_pruned_by_customer_time_and_id(spark, tmp_path):
    """Files tell customers and times apart, row groups' bloom filters tell ids apart; the rows are the same."""
    import pyarrow.parquet as pq

    rows = spark.range(40_000).select(
        F.xxhash64("id").alias("transaction_id"), F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(500)).alias("customer_id"),
        F.timestamp_seconds(1_700_000_000 + F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(5_000_000))).alias("transaction_ts"),
        F.lit("x" * 20).alias("note")).repartition(3)
    path = f"{tmp_path}/facts"
    sinks.clustered_refresh(rows, path, ["customer_id", "transaction_ts"], ["transaction_id"], files=16)
    stored = spark.read.parquet(path)
    assert stored.exceptAll(rows).count() == rows.exceptAll(stored).count() == 0
    ranges = {"customer_id": [], "transaction_ts": []}
    for f in (tmp_path / "facts").glob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        at = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
        table = pq.read_table(f)
        for c in ranges:
            ranges[c].append((min(table[c].to_pylist()), max(table[c].to_pylist())))
        assert {"customer_id", "transaction_id"} <= set(at)
    for c in ranges:
        probe = stored.select(c).orderBy("transaction_id").first()[0]
        hit = sum(low <= (probe if c == "customer_id" else probe.replace(tzinfo=low.tzinfo)) <= high for low, high in ranges[c])
        assert hit <= 16 / 2

    def scanned(df):
        df.collect()
        node = df._jdf.queryExecution().executedPlan()
        while not node.nodeName().startswith("Scan"):
            node = node.children().apply(0)
        return node.metrics().apply("numOutputRows").value()

    some = stored.orderBy("transaction_id").first().transaction_id
    assert scanned(stored.filter(F.col("transaction_id") == some)) <= 40_000 / 4
    assert scanned(stored.filter(F.col("customer_id") == 7)) <= 40_000 / 2


def test_shuffles_grow_with_the_facts(spark):
    """A task's share of the facts is bounded, whatever number of partitions is set; a larger set number stays."""
    from riskloom.session import ROWS_PER_TASK, size_tasks
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = {name: spark.conf.get(name) for name in names}
    try:
        size_tasks(spark, 10)
        assert spark.conf.get(names[0]) == before[names[0]]
        size_tasks(spark, 30 * ROWS_PER_TASK + 1)
        assert spark.conf.get(names[0]) == "31"
        size_tasks(spark, 10)
        assert spark.conf.get(names[0]) == "31"
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)

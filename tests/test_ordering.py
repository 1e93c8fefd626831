"""Global order, quantile narrowing and sessions, with ties and hot keys."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import quantile_cut
from riskloom.operators.ordering import chronological_split, dense_ids, row_at, running_sums
from riskloom.operators.quantile_cut import exact_quantiles
from riskloom.operators.sessions import gap_sessions
from riskloom.operators.slices import US_PER_DAY, plan_slices


@pytest.fixture(scope="module")
def tied(spark):
    rng = random.Random(3)
    rows = [(i, 1_704_067_200_000_000 if rng.random() < 0.5 else rng.randint(0, 10**6) * 10**9, rng.random()) for i in range(500)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "transaction_id long, ts_us long, x double").cache()


def test_dense_ids(tied):
    got = dense_ids(tied, "n", [F.col("ts_us"), F.col("transaction_id")]).toPandas().sort_values(["ts_us", "transaction_id"])
    assert got["n"].tolist() == list(range(1, 501))


def test_running_sums_descending(tied):
    got = running_sums(tied, [F.col("x").desc()], {"s": F.col("transaction_id")}).toPandas().sort_values("x", ascending=False)
    assert got["s"].tolist() == got["transaction_id"].cumsum().tolist()


@pytest.mark.parametrize("direct_rows", [1_000_000, 1])
def test_row_at(tied, direct_rows):
    rows = sorted((r.ts_us, r.transaction_id) for r in tied.collect())
    for position in (0, 1, 250, 499):
        assert row_at(tied, position, direct_rows=direct_rows) == rows[position]


def test_split_is_exact_in_rows(tied):
    counts = {r["split"]: r["count"] for r in chronological_split(tied).groupBy("split").count().collect()}
    assert counts == {"train": 350, "validation": 75, "test": 75}


@pytest.mark.parametrize("direct_rows", [1_000_000, 10])
def test_exact_quantiles(spark, direct_rows):
    rng = np.random.default_rng(5)
    values = np.concatenate([np.zeros(2000), rng.lognormal(size=3000), [1e9]])
    df = spark.createDataFrame(pd.DataFrame({"a": values, "b": rng.normal(size=len(values))}))
    qs = [0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]
    got = exact_quantiles(df.withColumn("c", F.lit(None).cast("double")), ["a", "b", "c"], qs, direct_rows)
    pdf = df.toPandas()
    for c in "ab":
        np.testing.assert_allclose(got[c], np.quantile(pdf[c], qs), rtol=1e-12)
    assert got["c"] is None or got["c"] == [None] * len(qs)


@pytest.mark.parametrize("max_rows", [2_000_000, 10])
def test_gap_sessions(spark, max_rows):
    rng, rows, at = random.Random(9), [], 0
    for i in range(300):
        at += rng.choice([10, 3_600, 3_601, 50_000, 200_000])
        rows.append((i, 1 if rng.random() < 0.7 else 2, at * 1_000_000))
    df = spark.createDataFrame(rows, "transaction_id long, customer_id long, ts_us long")
    got = gap_sessions(df, plan_slices(df, "customer_id", US_PER_DAY, max_rows), 3_600_000_000).toPandas()
    got["start"] = [s["id"] for s in got["session_start"]]
    pdf = df.toPandas().sort_values(["customer_id", "ts_us"])
    new = pdf.groupby("customer_id")["ts_us"].diff().gt(3_600_000_000) | ~pdf["customer_id"].duplicated()
    pdf["start"] = pdf["transaction_id"].where(new).ffill().astype(int)
    want = dict(zip(pdf.transaction_id, pdf.start))
    assert dict(zip(got.transaction_id, got.start)) == want


@pytest.mark.parametrize("direct_rows", [0, 1_000_000])
def test_quantiles_rank_finite_numbers_only(spark, direct_rows):
    values = [float(v) for v in range(3000)] + [float("nan"), float("inf"), float("-inf"), None, 1e308, -1e308] + [7.0] * 2000
    df = spark.createDataFrame([(v,) for v in values], "x double")
    finite = sorted(v for v in values if v is not None and abs(v) < float("inf"))
    got = exact_quantiles(df, ["x"], [0.0, 0.5, 0.9, 1.0], direct_rows)["x"]
    assert got == pytest.approx([float(np.quantile(finite, q)) for q in (0.0, 0.5, 0.9, 1.0)])


def test_row_at_sparse_ids(spark):
    ids = sorted((i * 7_919_191_919_191 + i * i) % (1 << 62) - (1 << 61) for i in range(500))
    df = spark.createDataFrame([(0, i) for i in ids], "ts_us long, transaction_id long")
    for position in (0, 1, 250, 499):
        assert row_at(df, position, direct_rows=3) == (0, ids[position])


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_grouped_quantiles_are_exact(spark, accuracy):
    """Groups of one row to thousands, ties, nulls and numbers that cannot be ranked; a coarse sketch gives narrow ranges."""
    import numpy as np
    from riskloom.operators.quantile_cut import grouped_quantiles

    rng = np.random.default_rng(2)
    rows = [("one", 5.0), ("two", 1.0), ("two", 2.0), ("none", None), ("none", float("nan"))]
    rows += [("ties", float(v)) for v in rng.integers(0, 4, 3000)] + [("wide", float(v)) for v in rng.standard_normal(4000) * 1e6]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    qs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {r.g: r.quantiles for r in grouped_quantiles(df, "g", "v", qs, accuracy).collect()}
    assert set(got) == {"one", "two", "ties", "wide"}
    for g, found in got.items():
        assert found == pytest.approx(np.quantile([v for k, v in rows if k == g], qs), rel=1e-12, abs=1e-9)


def test_ranks_in_one_range_share_its_histogram(spark, monkeypatch):
    """A pass makes a row per range of a value, not one per wanted rank, and few jobs resolve all ranks."""
    df = spark.range(40_000).select(F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double").alias("x"))
    qs = [(1 + 98 * i / 19) / 100 for i in range(20)]
    exploded, array = [], F.array
    monkeypatch.setattr(quantile_cut.F, "array", lambda *c: (exploded.append(len(c)), array(*c))[1])
    got = exact_quantiles(df, ["x"], qs, 1_000)["x"]
    monkeypatch.undo()
    assert got == pytest.approx(df.agg(F.percentile("x", qs)).first()[0])
    assert exploded[0] == 1
    assert len(exploded) <= 2 * 3

"""What the registered queries store of the facts."""

import pathlib

from checks.fixtures import Workbench


def test_wide_rows_are_stored_once_and_as_columns(spark, tmp_path):
    """Matrix with its split, and scores: one stored copy, smaller than the rows as checkpoints hold them."""
    from riskloom.session import cut_lineage

    before = spark.sparkContext.getCheckpointDir()
    size = lambda f: sum(p.stat().st_size for p in f.rglob("*") if p.is_file())
    spark.sparkContext.setCheckpointDir(f"{tmp_path}/shared")
    try:
        bench = Workbench(spark, "/root/testdata/sf0.001")
        folder = pathlib.Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
        rows = bench.scored
        stored = size(folder)
        assert rows.count() == bench.star.txn.count() and bench.features.count() == rows.count()
        spark.sparkContext.setCheckpointDir(f"{tmp_path}/one")
        cut_lineage(bench.matrix)
        assert stored < size(pathlib.Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")))
    finally:
        if before:
            spark.sparkContext.setCheckpointDir(before)

"""The driver contract, and every SQL-checked query on the small tables."""

import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT / "tools"))

from check_oracles import compare, oracle_connection  # noqa: E402
from conftest import SMALL  # noqa: E402

import __spark_entry__ as entry_module  # noqa: E402

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


def test_contract(spark):
    assert set(ORACLES) <= set(QUERIES) and len(ORACLES) >= 70
    assert entry_module.entry(spark).count() > 0


@pytest.fixture(scope="module")
def duck():
    return oracle_connection(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    assert compare(got, duck.execute(ORACLES[name]).df()) == ""

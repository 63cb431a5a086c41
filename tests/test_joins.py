"""IN over rows of the program and over tables: plans and rows."""

import pytest

from logspark import Engine
from logspark import queries as core

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "where",
    [
        "Int(l_returnflag) IN (SELECT Int(anon) AS y FROM ('7', 'none'))",
        "NOT Int(l_returnflag) IN (SELECT Int(a.anon) AS y FROM ('7', 'none') AS a WHERE a.anon != 'x')",
        "l_linenumber IN (SELECT anon FROM (6) UNION ALL SELECT anon FROM (7)) OR l_linenumber > 6",
        "l_linenumber IN (SELECT MAX(l_linenumber) AS most FROM $lineitem)",
    ],
)
def test_short_match(spark, where):
    """Few rows known from the program go to all tasks; the other side isn't dealt out by a key that all its rows may share."""
    text = plan(core.engine(spark, SF).sql(f"SELECT l_orderkey FROM $lineitem WHERE {where}"))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "Exchange hashpartitioning(coalesce(__k" not in text


def test_long_match(spark):
    """Nothing is forced on a match whose size follows a table, joins of literals to one included."""
    assert "ResolvedHint" not in core.engine(spark, SF).sql("SELECT c_name FROM $customer WHERE c_custkey IN (SELECT o_custkey FROM $orders)")._jdf.queryExecution().analyzed().toString()
    both = "SELECT c_name FROM $customer WHERE c_custkey IN (SELECT o.o_custkey FROM (1, 2) AS l LEFT JOIN $orders AS o ON l.anon = o.o_orderkey)"
    assert "ResolvedHint" not in core.engine(spark, SF).sql(both)._jdf.queryExecution().analyzed().toString()


def test_anti_null_safe(spark):
    assert "Exchange" not in plan(core.queries()["anti_null_safe"](spark, SF)).split("BroadcastExchange")[0]

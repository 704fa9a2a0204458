"""Release files of lines that come again in an order, and what a selection shuffles."""

import datetime as dt

import duckdb
from oracle import compare

from tidemark.plans import registry
from tidemark.session import scratch


def _lines(spark):
    root, day = scratch(spark, "lines"), dt.datetime(2024, 1, 1)
    # two lines of one number and part, of other price: two files of one name, not one file twice
    rows = [(1, 5, 1, 2, 3.0, p, 0.0, 0.0, "N", "F", day) for p in (10.0, 11.0)] + [(5, 5, 1, 1, 3.0, 9.0, 0.0, 0.0, "N", "F", day), (2, 5, 1, 3, 3.0, 9.0, 0.0, 0.0, "N", "F", day)]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{root}/lineitem.parquet/*.parquet'")
    return root, con


def test_line_numbers_that_come_again(spark):
    root, con = _lines(spark)
    for name in ("t9_release_candidates", "t9_sdist_selection"):
        problem, _, _ = compare(spark, con, root, registry.queries()[name], registry.oracle_sql()[name])
        assert problem is None, problem


def test_selection_shuffles_only_what_is_asked_for(spark):
    root, _ = _lines(spark)
    plan = registry.queries()["t9_sdist_selection"](spark, root)._jdf.queryExecution().optimizedPlan().toString()
    assert "min(CASE" in plan and "struct(" not in plan

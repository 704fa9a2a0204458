"""A strict parser runs once for each text, in as many tasks as the session has, a bounded number of texts at a time."""

import json

import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.functions import documents
from tidemark.plans import drift_queries
from tidemark.sources import lines


def _observation(target, tools=()):
    inventory = {"inventory_version": 1, "server": {"downstream_executable": "x"}, "tools": [{"name": t} for t in tools]}
    return json.dumps(
        {
            "observation_version": 1,
            "observed_at": "2026-07-24T20:15:30Z",
            "target_id": target,
            "source_type": "table",
            "sensor": {"name": "s", "version": "1"},
            "configuration_profile": "default",
            "inventory": inventory,
        }
    )


def _parsers(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")


def test_limited_scan_parses_a_line_once(spark, tmp_path):
    (tmp_path / "log").write_text("\n".join(_observation(f"t{k % 3}") for k in range(6)) + "\n")
    path = f"file://{tmp_path}/log"
    assert _parsers(lines.read_observations(spark, path)) == 1
    limited = lines.read_observations(spark, path, max_records=6, max_targets=3)
    assert _parsers(limited) == 0  # parsed rows are read back for the counts and for the result
    assert sorted(r.target_id for r in limited.collect()) == ["t0", "t0", "t1", "t1", "t2", "t2"]


def test_lines_of_one_split_are_dealt_out(spark):
    task = spark.conf.get("spark.tidemark.tasks")
    spark.conf.unset("spark.tidemark.tasks")
    try:
        one = spark.range(0, 100, 1, 1).select(F.lit(_observation("t")).alias("value"), F.col("id").alias("seq"))
        parsed = lines.parse_observations(one)
        assert parsed.rdd.getNumPartitions() == 3 * spark.sparkContext.defaultParallelism
        assert parsed.filter("error IS NULL").count() == 100
    finally:
        spark.conf.set("spark.tidemark.tasks", task)


def test_inventories_are_parsed_once(spark, sf):
    assert _parsers(drift_queries.inventory_documents(spark, sf)) == 1


def test_texts_become_objects_a_few_at_a_time():
    udf = documents.strict_inventory().func
    text = '{"inventory_version": 1, "server": {"downstream_executable": "x"}, "tools": [{"name":"a"}]}'
    pieces = list(udf(iter([pa.array([text] * (documents.ROWS_AT_ONCE + 1) + [None, "{"])])))
    assert [len(p) for p in pieces] == [documents.ROWS_AT_ONCE, 3]
    rows = pieces[1].to_pylist()
    assert rows[0] == {"error": None, "executable": "x", "tools": [{"name": "a", "definition": '{"name":"a"}'}]}
    assert rows[1]["error"] == "missing text" and rows[2]["tools"] is None and rows[2]["error"]

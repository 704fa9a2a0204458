"""Fingerprints of tables: what they must tell apart, and that differences are found where they are."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import fingerprints, snapshots
from tidemark.session import scratch
from tidemark.sinks import publish

SCHEMA = "id long, a string, b string, n double"


def same(left, right):
    return fingerprints.fingerprint(left).first() == fingerprints.fingerprint(right).first()


def test_order_and_columns_do_not_matter_but_copies_and_nulls_do(spark):
    rows = [(1, "x", None, 1.0), (2, None, "x", 2.0), (2, None, "x", 2.0), (3, "", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert same(df, spark.createDataFrame(rows[::-1], SCHEMA).repartition(3).select("n", "b", "a", "id"))
    assert not same(df, df.distinct())
    for k, changed in ((0, (1, None, "x", 1.0)), (3, (3, None, "", None)), (3, (3, None, None, None)), (1, (2, "x", None, 2.0))):
        assert not same(df, spark.createDataFrame([*rows[:k], changed, *rows[k + 1 :]], SCHEMA))
    # two rows that swap a value keep every column's sum
    assert not same(spark.createDataFrame([(1, "p", "q", 0.0), (2, "r", "s", 0.0)], SCHEMA), spark.createDataFrame([(1, "r", "q", 0.0), (2, "p", "s", 0.0)], SCHEMA))


@pytest.mark.parametrize("seed", range(4))
def test_differences_are_those_of_a_full_comparison(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(500), rng.choice("abc"), rng.choice([None, "z"]), 0.5) for _ in range(2000)]
    other = [r for r in rows if rng.random() > 0.002 * seed] + [(rng.randrange(600), "new", None, None) for _ in range(3 * seed)]
    left, right = spark.createDataFrame(rows, SCHEMA).cache(), spark.createDataFrame(other, SCHEMA).cache()
    got = fingerprints.difference(left, right, ["id"])
    want = snapshots.table_difference(left, right)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    first = fingerprints.differing_ranges(left, right, ["id"])
    second = fingerprints.differing_ranges(left, right, ["id"], 2, first)
    changed = {r.id for r in want.select("id").collect()}
    assert first.count() <= second.count() <= len(changed) and (seed == 0) == (second.count() == 0)


def test_missing_tables_and_sizes(spark):
    df = spark.createDataFrame([(1, "a", "b", 0.0)] * 100, SCHEMA)
    rows = {r.table_name: tuple(r)[1:] for r in fingerprints.verify_rows({"x": df, "y": df, "e": df.limit(0)}, {"x": df, "z": df, "e": df.limit(0)}).collect()}
    assert rows == {"x": (100, 100, True, True), "y": (100, None, False, False), "z": (None, 100, False, False), "e": (0, 0, True, True)}
    one, two = scratch(spark, "one"), scratch(spark, "two")
    publish.publish_generation({"x": df, "y": df.withColumn("r", F.rand(1))}, one, "g")
    publish.publish_generation({"x": df}, two, "g")
    row = fingerprints.size_ratio(spark, f"{one}/g", f"{two}/g").first()
    assert 0 < row.hot_bytes < row.history_bytes and row.size_ratio == round(row.hot_bytes / row.history_bytes, 4)
    with pytest.raises(ValueError):
        fingerprints.difference(df, df.drop("n"), ["id"])

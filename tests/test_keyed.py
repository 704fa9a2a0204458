"""Keyed tables: changes rewrite the files of their keys, and give what a whole rewrite gives."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.session import scratch
from tidemark.sinks import keyed, publish

SCHEMA = "a long, b string, v string"
KEYS = ["a", "b"]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def table(spark, n=2000, low=0):
    return spark.createDataFrame([(k, f"x{k % 3}", f"v{k}") for k in range(low, low + n)], SCHEMA)


@pytest.fixture()
def root(spark):
    path = scratch(spark, "keyed")
    keyed.create(table(spark), KEYS, path, "g1", file_rows=50)
    return path


def test_a_small_change_rewrites_few_files(spark, root):
    before = rows(keyed.read(spark, root))
    files = keyed._files(spark, f"{root}/g1")
    assert len(files) >= 40 and before == rows(table(spark)) and sum(f.rows for f in files) == 2000
    delta = spark.createDataFrame([(k, f"x{k % 3}", "new") for k in range(700, 720)] + [(705, "y", "inserted"), (-5, "", "first"), (9999, "z", "last")], SCHEMA)
    change = keyed.upsert(delta, KEYS, root, "g2", file_rows=50)
    assert change.rewritten <= 4 and change.kept == len(files) - change.rewritten and change.rows_read <= 200
    assert rows(keyed.read(spark, root)) == rows(publish.upserted(table(spark), delta, KEYS))
    stored = {f.path for f in keyed._files(spark, f"{root}/g2")}
    assert len(stored & {f.path for f in files}) == change.kept  # the others are the same files
    assert rows(keyed._read(spark, f"{root}/g1", files)) == before  # and the older generation is as it was


def test_any_changes_are_those_of_a_whole_rewrite(spark):
    rng = random.Random(3)
    root = scratch(spark, "keyed")
    now = spark.createDataFrame([], SCHEMA)
    keyed.create(now, KEYS, root, "g00", file_rows=7)
    for step in range(1, 5):
        keys = {(rng.randint(-60, 60), rng.choice(["", "a", "a\x00", "a\x00b", "a\x01", "é", "日", "🙂"])) for _ in range(40)}
        delta = spark.createDataFrame([(a, b, f"{step}") for a, b in keys], SCHEMA)
        want = rows(publish.upserted(now, delta, KEYS))
        keyed.upsert(delta, KEYS, root, f"g{step:02d}", file_rows=7)
        assert rows(keyed.read(spark, root)) == want
        files = keyed._files(spark, f"{root}/g{step:02d}")
        key = keyed.range_key(keyed.read(spark, root).schema, KEYS)
        ranges = keyed.read(spark, root).groupBy(F.col("_metadata.file_path").alias("p")).agg(F.min(key).alias("low"), F.max(key).alias("high")).orderBy("low").collect()
        assert [f.path for f in files] == [r.p for r in ranges] and all(x.high < y.low for x, y in zip(ranges, ranges[1:]))
        now = spark.createDataFrame(want, SCHEMA)


def test_keys_order_as_tuples(spark):
    values = [(a, b, c) for a in (-(1 << 63), -2, 0, 3, (1 << 63) - 1) for b in ("", "a", "a\x00", "ab") for c in (dt.date(1969, 1, 2), dt.date(2024, 5, 6))]
    df = spark.createDataFrame(values, "a long, b string, c date")
    got = [tuple(r)[:3] for r in df.withColumn("k", keyed.range_key(df.schema, ["a", "b", "c"])).orderBy("k").collect()]
    assert got == sorted(values)


def test_sync_adds_what_lacks_and_refuses_what_differs(spark, root):
    source = table(spark, 100, 1950)  # half is stored
    outcomes = {(r.a, r.outcome) for r in keyed.compare(source, KEYS, root).collect()}
    assert outcomes == {(k, "validated" if k < 2000 else "insert") for k in range(1950, 2050)}
    change = keyed.sync(source, KEYS, root, "g2", file_rows=50)
    assert change.rewritten == 1 and keyed.read(spark, root).count() == 2050
    assert rows(keyed.read(spark, root)) == rows(table(spark, 2050))
    changed = source.withColumn("v", F.when(F.col("a") == 1999, "other").otherwise(F.col("v")))
    with pytest.raises(ValueError, match="immutable row differs: 1999 x1"):
        keyed.sync(changed, KEYS, root, "g3")
    assert publish.current_generation(spark, root).endswith("g2")
    again = keyed.sync(source, KEYS, root, "g3", file_rows=50)
    assert (again.rewritten, again.written) == (0, 0) and keyed.read(spark, root).count() == 2050


def test_wrong_changes(spark, root):
    for wrong in ([(1, "x1", "a"), (1, "x1", "b")], [(None, "x", "v")]):
        with pytest.raises(ValueError):
            keyed.upsert(spark.createDataFrame(wrong, SCHEMA), KEYS, root, "g2")
    with pytest.raises(ValueError):
        keyed.upsert(table(spark).drop("v"), KEYS, root, "g2")
    with pytest.raises(TypeError):
        keyed.create(spark.createDataFrame([(1.5,)], "a double"), ["a"], scratch(spark, "keyed"), "g1")
    with pytest.raises(FileExistsError):
        keyed.create(table(spark), KEYS, root, "g1")
    with pytest.raises(FileNotFoundError):
        keyed.read(spark, scratch(spark, "keyed"))


def test_only_files_that_are_hit_are_scanned(spark, root, monkeypatch):
    read = []
    inner = keyed._read
    monkeypatch.setattr(keyed, "_read", lambda spark, generation, files: read.append(len(files)) or inner(spark, generation, files))
    keyed.upsert(table(spark, 3, 100), KEYS, root, "g2", file_rows=50)
    assert max(read) == 1

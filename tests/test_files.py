"""Digests of files by ranges, and line numbers of files that are read in many splits."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import validation
from tidemark.sources import files, lines


def test_digests_by_ranges_are_those_of_whole_files(spark, tmp_path):
    rng = random.Random(1)
    want = {}
    for k, n in enumerate([1, 99, 100, 101, 5000]):
        folder = tmp_path / f"d {k % 2}é"
        folder.mkdir(exist_ok=True)
        data = rng.randbytes(n)
        (folder / f"f%20{k}.bin").write_bytes(data)
        want[f"f%20{k}.bin"] = (n, hashlib.sha256(data).hexdigest())
    for whole, size in ((1 << 20, 10), (100, 7), (-1, 100), (-1, 1 << 20)):
        got = {r.path.rsplit("/", 1)[1]: (r.size, r.sha256) for r in files.file_digests(spark, f"file://{tmp_path}", whole, size).collect()}
        assert got == want


def test_a_file_beyond_two_gib(spark, tmp_path):
    size = (2 << 30) + 4097
    with open(tmp_path / "large.bin", "wb") as f:  # sparse: takes no room
        f.truncate(size - 3)
        f.seek(size - 3)
        f.write(b"end")
    digest = hashlib.sha256()
    block = bytes(1 << 20)
    for _ in range((size - 3) >> 20):
        digest.update(block)
    digest.update(bytes((size - 3) & ((1 << 20) - 1)) + b"end")
    row = files.file_digests(spark, f"file://{tmp_path}").first()
    assert (row.size, row.sha256) == (size, digest.hexdigest())


@pytest.mark.parametrize("names", [["canonical/servers.jsonl"], [f"canonical/servers.jsonl/part-{k:03d}" for k in range(40)], []])
def test_digest_of_parts_in_order(spark, names):
    rows = [(n, 1, hashlib.sha256(n.encode()).hexdigest()) for n in names] + [("raw/page=1", 1, "x")]
    random.Random(2).shuffle(rows)
    got = validation.snapshot_digest(spark.createDataFrame(rows, "path string, size long, sha256 string").repartition(5)).first()
    parts = [hashlib.sha256(n.encode()).hexdigest() for n in names]
    assert got is not None and got.digest == (parts[0] if len(names) == 1 else hashlib.sha256("\n".join(parts).encode()).hexdigest())


def test_lines_of_one_file_in_many_splits(spark, tmp_path):
    rng = random.Random(3)
    texts = ["x" * rng.choice([0, 3, 40, 900]) + str(k) for k in range(4000)]
    (tmp_path / "one.txt").write_text("\n".join(texts) + "\n")
    (tmp_path / "two.txt").write_text("\n".join(texts[:10]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        numbered = lines.number_lines(lines.read_lines(spark, f"file://{tmp_path}"))
        assert numbered.select("seq.block").distinct().count() > 40
        got = {(r.file.rsplit("/", 1)[1], r.line_no): r.value for r in numbered.collect()}
        plan = numbered._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {("one.txt", k + 1): t for k, t in enumerate(texts)} | {("two.txt", k + 1): t for k, t in enumerate(texts[:10])}
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    texts_travel = [line for line in plan.splitlines() if "Exchange" in line and "value#" in line]
    assert not texts_travel

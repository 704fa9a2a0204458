"""Raw pages are one file each in one folder, written by the tasks; narrow entries are dealt out before records are built."""

import hashlib
from pathlib import Path

from tidemark.plans.bundle_fixture import write_pages
from tidemark.session import dealt, scratch
from tidemark.sources import bundles, files


def test_pages_are_files_of_one_folder(spark):
    root = scratch(spark, "pages")
    entries = spark.createDataFrame([(1 + i // 3, i, f'{{"n":{i}}}') for i in range(7)], "page bigint, position bigint, entry string")
    write_pages(entries, root)
    raw = Path(root) / "raw"
    assert sorted(p.name for p in raw.iterdir()) == ["page=1", "page=2", "page=3"] and all(p.is_file() for p in raw.iterdir())
    (raw / "pages.jsonl").mkdir()
    (raw / "pages.jsonl" / "part-0.json").write_text('{"page_number":1}\n')
    (raw / "page-000004.json").write_text('{"servers":[{"n":7}],"metadata":{}}')
    (Path(root) / "canonical").mkdir()
    (Path(root) / "canonical" / "servers.jsonl").write_text("x\n")
    found = bundles.page_entries(bundles.read_pages(spark, root)).collect()
    assert sorted((r.page, r.entry) for r in found) == [(1 + i // 3, f'{{"n":{i}}}') for i in range(7)] + [(4, '{"n":7}')]
    got = {r.path: (r.size, r.sha256) for r in bundles.read_artifacts(spark, root).collect()}
    assert set(got) == {"raw/page=1", "raw/page=2", "raw/page=3", "raw/page-000004.json", "canonical/servers.jsonl"}
    body = (raw / "page=2").read_bytes()
    assert got["raw/page=2"] == (len(body), hashlib.sha256(body).hexdigest())


def test_files_hold_their_bodies(spark, tmp_path):
    rows = [(f"f{i}", "ä" * i + "\n") for i in range(1, 20)]
    files.write_files(spark.createDataFrame(rows, "name string, body string").repartition(4), f"file://{tmp_path}/out")
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == dict(rows)


def test_one_split_is_dealt_out(spark):
    task = spark.conf.get("spark.tidemark.tasks")
    spark.conf.unset("spark.tidemark.tasks")
    try:
        one = spark.range(0, 100, 1, 1)
        assert dealt(one).rdd.getNumPartitions() == 3 * spark.sparkContext.defaultParallelism
        built = bundles.build_records(one.selectExpr("cast(id as string) entry"))
        assert built.rdd.getNumPartitions() == 3 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.tidemark.tasks", task)

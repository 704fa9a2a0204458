"""Counters kept by four streams equal the batch form, whatever the order, replays and compactions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import summaries
from tidemark.session import scratch
from tidemark.streaming import counters

FINDING = "analysis_run_id long, severity string, disposition string"
FILE = "analysis_run_id long, byte_size long, executable boolean, native_binary boolean, generated boolean, minified boolean"
SCHEMAS = {"runs": "id long", "findings": FINDING, "files": FILE, "dependencies": "analysis_run_id long, dependency_name string"}


def made(kind, n, seed):
    rng = random.Random(f"{kind}{seed}")
    run = lambda: rng.randrange(12)
    if kind == "runs":
        return [{"id": seed * 4 + k} for k in range(4)]  # run 12 and more never get details
    if kind == "findings":
        return [{"analysis_run_id": run(), "severity": rng.choice(["low", "high", "critical"]), "disposition": rng.choice(["unreviewed", "suspicious"])} for _ in range(n)]
    if kind == "files":
        return [{"analysis_run_id": run(), "byte_size": rng.randrange(99), "executable": rng.random() < 0.5, "native_binary": False, "generated": True, "minified": None} for _ in range(n)]
    return [{"analysis_run_id": run(), "dependency_name": f"d{k}"} for k in range(n)]


def rows(df):
    return sorted(tuple(r) for r in df.select("analysis_run_id", *summaries.COUNTERS).collect())


class Arrivals:
    """Folders of JSON files that grow, and the batch answer over what has arrived."""

    def __init__(self, spark, tmp_path):
        self.spark, self.path, self.log = spark, tmp_path, scratch(spark, "log")
        self.states = {k: scratch(spark, f"state-{k}") for k in SCHEMAS}
        self.held = {k: [] for k in SCHEMAS}
        for k in SCHEMAS:
            (tmp_path / k).mkdir()

    def arrive(self, kind, seed):
        new = made(kind, 30, seed)
        (self.path / kind / f"{seed}.json").write_text("".join(json.dumps(r) + "\n" for r in new))
        self.held[kind] += new

    def run(self, kind):
        stream = self.spark.readStream.schema(SCHEMAS[kind]).option("maxFilesPerTrigger", 1).json(f"file://{self.path}/{kind}")
        counters.keep_counters(kind, stream, self.log, self.states[kind])

    def expected(self):
        frames = {k: self.spark.createDataFrame(r, SCHEMAS[k]) for k, r in self.held.items()}
        return rows(summaries.run_summaries(frames["runs"], frames["findings"], frames["files"], frames["dependencies"]))


def test_any_order_replays_and_compactions_give_the_batch_answer(spark, tmp_path):
    a = Arrivals(spark, tmp_path)
    with pytest.raises(FileNotFoundError):
        counters.counters(spark, a.log)
    for kind in ("findings", "files"):
        for seed in range(3):
            a.arrive(kind, seed)
        a.run(kind)
    assert rows(counters.counters(spark, a.log)) == []  # no run is known yet
    for seed in range(4):
        a.arrive("runs", seed)
    a.run("runs")
    assert rows(counters.counters(spark, a.log)) == a.expected()
    assert counters.compact(spark, a.log) == 2 + 2 + 3
    assert rows(counters.counters(spark, a.log)) == a.expected()
    for seed in range(2):
        a.arrive("dependencies", seed)  # a stream that comes late
    a.arrive("findings", 7)
    a.run("dependencies")
    a.run("findings")
    assert rows(counters.counters(spark, a.log)) == a.expected()
    # a batch that a compaction holds is replayed: its folder is there again and is left out
    counters.increments("findings", spark.createDataFrame(made("findings", 30, 0), FINDING)).write.parquet(f"{a.log}/findings/batch=0")
    # one that none holds is replayed: it replaces itself
    counters.increments("findings", spark.createDataFrame(made("findings", 30, 7), FINDING)).write.mode("overwrite").parquet(f"{a.log}/findings/batch=3")
    assert rows(counters.counters(spark, a.log)) == a.expected()
    assert counters.compact(spark, a.log) == 2 and counters.compact(spark, a.log) == 0
    assert rows(counters.counters(spark, a.log)) == a.expected()
    a.run("runs")  # nothing new
    assert rows(counters.counters(spark, a.log)) == a.expected()


def test_unfinished_folders_and_unknown_streams(spark, tmp_path):
    a = Arrivals(spark, tmp_path)
    a.arrive("runs", 0)
    a.run("runs")
    counters.increments("files", spark.createDataFrame(made("files", 5, 0), FILE)).write.parquet(f"{a.log}/files/batch=0")
    from tidemark.sinks.publish import _path

    marker, fs = _path(spark, f"{a.log}/files/batch=0/_SUCCESS")
    fs.delete(marker, False)
    assert counters.counters(spark, a.log).agg(F.sum("file_count")).first()[0] == 0
    with pytest.raises(ValueError):
        counters.increments("others", spark.createDataFrame([], FILE))

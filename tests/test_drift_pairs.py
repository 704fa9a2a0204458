"""Consecutive comparisons and previous runs against plain loops, with hot keys and chunk borders."""

import random

from pyspark.sql import functions as F

from tidemark.operators import drift


def test_consecutive_diffs_are_pairwise_comparisons(spark):
    rng = random.Random(4)
    observations = {}  # (target, time) -> {name: definition}
    for k in range(300):
        target = "hot" if k % 2 else f"t{rng.randrange(20)}"
        time = f"2024-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}"
        observations[target, time] = {f"n{x}": str(rng.randrange(2)) for x in rng.sample(range(5), rng.randrange(4))}
    want = []
    for target in {t for t, _ in observations}:
        times = sorted(at for t, at in observations if t == target)
        for before, after in zip(times, times[1:]):
            old, new = observations[target, before], observations[target, after]
            for name in old.keys() | new.keys():
                change = "added" if name not in old else "removed" if name not in new else "unchanged" if old[name] == new[name] else "modified"
                want.append((target, after, name, change))
    times = spark.createDataFrame(list(observations), "target_id string, observed_at string")
    tools = spark.createDataFrame([(*key, n, d) for key, held in observations.items() for n, d in held.items()], "target_id string, observed_at string, name string, definition string")
    for width in (4, 7, 10):  # a year, a month, a day to a chunk
        found = drift.consecutive_diffs(tools.repartition(4), times, "target_id", "observed_at", F.substring("observed_at", 1, width))
        assert sorted(map(tuple, found.select("target_id", "observed_at", "name", "change").collect())) == sorted(want)
    plan = drift.consecutive_diffs(tools, times, "target_id", "observed_at", F.substring("observed_at", 1, 7))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= 5


def test_previous_runs_of_few_large_groups(spark, monkeypatch):
    monkeypatch.setattr(drift, "PARTS", 3)
    rng = random.Random(5)
    runs = []
    for k in range(600):
        group = ("p", "s", "x") if k % 3 else ("p", f"s{rng.randrange(60)}", rng.choice(["x", "y"]))
        runs.append((*group, rng.randrange(9), k, f"2024-01-{rng.randrange(1, 5):02d}"))
    runs.append(("p", None, "x", 1, 1000, "2024-01-01"))
    want = []
    for *group, version, run, _ in runs:
        others = [(at, r) for *g, v, r, at in runs if g == group and v != version and None not in g]
        want.append((*group, version, run, max(others)[1] if others else None))
    schema = "profile_key string, server_identifier string, package_identifier string, server_version_id long, run_id long, recency string"
    found = drift.previous_compatible_runs(spark.createDataFrame(runs, schema).repartition(5))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)

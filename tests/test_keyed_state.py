"""Keyed stream state against the batch forms, for several ways to split and order the input."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import drift
from tidemark.session import scratch
from tidemark.streaming import jobs, keyed_state

SCHEMA = "target_id string, observed_at string, seq bigint, inventory string"


def observations(seed=5):
    rng = random.Random(seed)
    out = []
    for seq in range(120):
        target = "hot" if rng.random() < 0.5 else f"t{rng.randrange(9)}"
        tools = [{"name": f"tool{k}", "definition": rng.choice(["1.0", "1.00", '{"a": [1, 2]}', '{"a":[1,2]}', '"é x"'])} for k in sorted(rng.sample(range(4), rng.randrange(4)))]
        text = "[" + ",".join(f'{{"name":"{t["name"]}","definition":{t["definition"]}}}' for t in tools) + "]"
        out.append((target, f"2024-01-{rng.randrange(1, 9):02d}T00:00:00Z", seq, rng.choice([text, text, text, None]) if not tools else text))
    return out


def batch_answer(spark, rows):
    """Newest two per target and their comparison, by the batch operators."""
    df = spark.createDataFrame(rows, SCHEMA)
    two = drift.latest_two(df).select("target_id", "rank", "observed_at", "seq", "inventory").collect()
    out = {}
    for r in two:
        out.setdefault(r.target_id, {})[r.rank] = r
    want = []
    for target, ranks in out.items():
        new, old = ranks[1], ranks.get(2)
        if old is None:
            want.append((target, new.observed_at, new.seq, None, None, None, None, None, None))
            continue
        a, b = (json.loads(keyed_state.tool_digests(x.inventory)) for x in (new, old))
        same = sum(a[k] == b[k] for k in a.keys() & b.keys())
        want.append((target, new.observed_at, new.seq, old.observed_at, old.seq, len(a.keys() - b.keys()), len(b.keys() - a.keys()), len(a.keys() & b.keys()) - same, same))
    return sorted(want, key=repr)


@pytest.mark.parametrize(("files", "order"), [(1, "given"), (6, "given"), (4, "reversed"), (5, "mixed")])
def test_any_split_of_the_input_gives_the_batch_answer(spark, tmp_path, files, order):
    rows = observations()
    dealt = {"given": rows, "reversed": rows[::-1], "mixed": random.Random(1).sample(rows, len(rows))}[order]
    size = -(-len(dealt) // files)
    for k in range(files):  # file by file, in the order of their times
        part = dealt[k * size : (k + 1) * size]
        path = tmp_path / f"{k}.json"
        path.write_text("".join(json.dumps(dict(zip(("target_id", "observed_at", "seq", "inventory"), r))) + "\n" for r in part))
    out, state = scratch(spark, "out"), scratch(spark, "state")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    keyed_state.run(keyed_state.newest_two(stream), out, state)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    assert spark.read.parquet(out).select("batch").distinct().count() <= files
    found = jobs.newest_states(spark, out)
    assert sorted((tuple(r) for r in found.select(*keyed_state.CHANGES.names).collect()), key=repr) == batch_answer(spark, rows)
    # one more, older than all: nothing changes, although the stream goes on from its checkpoint
    (tmp_path / "late.json").write_text(json.dumps(dict(zip(("target_id", "observed_at", "seq", "inventory"), ("hot", "2023-01-01T00:00:00Z", 999, "[]")))) + "\n")
    keyed_state.run(keyed_state.newest_two(stream), out, state)
    assert jobs.newest_states(spark, out).exceptAll(found).count() == 0


def test_states_hold_digests_only(spark):
    text = '[{"name":"a","definition":{"x": [1.0,  2]}},{"name":"b"}]'
    held = json.loads(keyed_state.tool_digests(text))
    assert held.keys() == {"a", "b"} and all(len(d) == 32 for d in held.values())
    assert held == json.loads(keyed_state.tool_digests(text.replace(" ", "")))
    assert held["a"] != json.loads(keyed_state.tool_digests(text.replace("1.0", "1.00")))["a"]
    assert keyed_state.tool_digests(None) == keyed_state.tool_digests("[]") == "{}"
    df = spark.createDataFrame(observations(), SCHEMA)
    combined = df.mapInPandas(keyed_state._combined, keyed_state._ENTRY)
    assert combined.groupBy("target_id").agg(F.count("*").alias("n")).where(F.col("n") > 2 * df.rdd.getNumPartitions()).count() == 0

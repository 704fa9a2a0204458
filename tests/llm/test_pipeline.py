"""The registered queries against their SQL, and the pipeline stage by stage."""

import pytest
from cases import DOCUMENTS, frame, near_groups, repeats
from oracle import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import contamination, quality
from tidemark.llm.queries import ORACLES, QUERIES, table


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, name):
    problem, _, _ = compare(spark, connect(sf), sf, QUERIES[name], ORACLES[name])
    assert problem is None, problem


def test_operators_and_the_pipeline_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {f"op{n}_" for n in range(1, 14)} <= {x.split("_")[0] + "_" for x in names}


#: Names that the operators give to columns of their own, and some that they might.
WORKING = """
_id _tag _kept _tokens _rate _domain _membership _draws _text _file _run _key tag twin copies spans marks hits row rows id none each nth
stays own name hit items pass round block limit score score_ label high predicted held_out hi lo n a b c rep comp component component_id
n_shingles tokens_ size token blocks sets with other second root node low u v words buckets k weight power loss p0 s0 e0 z0 earlier
text_tag added doc found place digest keep_id keep_place known historical shard shards part whole string runs at removed n_bytes
""".split()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_carry_columns_of_any_name(spark, sf, name):
    given = [r for r in DOCUMENTS if r[0] is not None and r[0] != 19]
    docs = frame(spark, given).drop("score", "tokens", "tag", "comp")
    for column in WORKING:
        docs = docs.withColumn(column, F.concat(F.lit(f"{column} of "), F.col("doc_id").cast("string")))
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, sf)
    assert out.columns[: len(docs.columns)] == docs.columns
    kept = out.collect()
    assert kept and len({r.doc_id for r in kept}) == len(kept)
    assert all(r[c] == f"{c} of {r.doc_id}" for r in kept for c in WORKING)


def test_stages_of_the_pipeline(spark, sf):
    docs = table(spark, sf, "documents")
    columns, out = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.staged(stage(spark, out[-1], sf), name))
    assert all(x.columns == columns for x in out[:-1])
    raw, good, single, cut, clean, mixed = out
    scores = {r.doc_id: r.predicted for r in quality.quality_scores(raw, table(spark, sf, "labels")).collect()}
    assert {r.doc_id for r in good.collect()} == {i for i, p in scores.items() if p == 1}
    before = [(r.doc_id, r.text, None) for r in good.collect()]
    assert {r.doc_id for r in single.collect()} == {c for _, _, c in near_groups(before)}
    held = [(r.doc_id, r.text, None) for r in single.collect()]
    removed = {i: n for i, _, n, _, _ in repeats(held)}
    lengths = {i: len(t.encode()) for i, t, _ in held}
    after = {r.doc_id: r for r in cut.collect()}
    assert set(after) == set(lengths)
    assert all(lengths[i] - removed[i] - 6 * 3 <= len(r.text.encode()) <= lengths[i] - removed[i] and r.n_chars == len(r.text) for i, r in after.items())
    assert contamination.contamination(clean, table(spark, sf, "benchmark")).where("contaminated").count() == 0
    assert {r.doc_id for r in clean.collect()} == set(after) == {r.doc_id for r in mixed.collect()}

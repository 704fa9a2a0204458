"""Histories, imports, queues, summaries, reviews, streams: golden cases and invariances."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import drift, explore, imports, ordering, reviews, snapshots, summaries, textindex, validation, workqueue
from tidemark.session import scratch
from tidemark.sinks import publish
from tidemark.plans.bundle_fixture import write_bundle
from tidemark.sources import bundles, lines, releases
from tidemark.streaming import jobs


def observation(at, target="t", tools=(), executable="npx"):
    body = {"inventory_version": 1, "server": {"downstream_executable": executable}, "tools": [{"name": n, "d": d} for n, d in tools]}
    return json.dumps(
        {
            "observation_version": 1,
            "observed_at": at,
            "target_id": target,
            "source_type": "s",
            "sensor": {"name": "n", "version": "1"},
            "configuration_profile": "p",
            "inventory": body,
        }
    )


def log(tmp_path, *rows):
    path = tmp_path / "log.jsonl"
    path.write_text("\n".join(rows) + "\n")
    return f"file://{path}"


def test_history_golden(spark, tmp_path):
    path = log(
        tmp_path,
        observation("2026-07-24T20:15:30Z", "fs", [("read_file", 1), ("search", 1)]),
        "",
        observation("2026-07-25T20:15:30Z", "fs", [("execute_command", 1), ("read_file", 2)]),
        observation("2026-07-25T08:00:00Z", "memory"),
    )
    rows = lines.read_observations(spark, path)
    s = drift.history_summary(rows).first()
    assert tuple(s) == (3, 2, "2026-07-24T20:15:30Z", "2026-07-25T20:15:30Z")
    changes = {(r.name, r.change) for r in drift.latest_drift(rows).collect()}
    assert changes == {("execute_command", "added"), ("search", "removed"), ("read_file", "modified")}
    v = drift.latest_verdicts(rows).first()
    assert (v.target_id, v.executable_changed, v.verdict) == ("fs", False, "material_drift")


def test_order_and_ties(spark, tmp_path):
    path = log(tmp_path, *[observation(f"2026-07-{d}T00:00:00Z", executable=e) for d, e in (("25", "a"), ("23", "b"), ("24", "c"), ("25", "d"))])
    two = {r.rank: (r.observed_at[8:10], r.executable) for r in drift.latest_two(lines.read_observations(spark, path)).collect()}
    assert two == {1: ("25", "d"), 2: ("25", "a")}


def test_limits_stop_a_strict_scan(spark, tmp_path):
    path = log(tmp_path, *[observation(f"2026-07-2{k}T00:00:00Z", f"t{k % 3}") for k in range(6)])
    assert lines.read_observations(spark, path, max_records=6, max_targets=3).count() == 6
    for limits, message in (({"max_records": 5}, "record limit"), ({"max_targets": 2}, "target limit"), ({"max_records": 5, "max_targets": 2}, "record limit")):
        with pytest.raises(Exception, match=message):
            lines.read_observations(spark, path, **limits).collect()
        assert lines.read_observations(spark, path, strict=False, **limits).count() == 6


def test_strict_scan_fails_and_lenient_scan_drops(spark, tmp_path):
    path = log(tmp_path, observation("2026-07-24T20:15:30Z"), "not json")
    with pytest.raises(Exception, match="invalid line"):
        lines.read_observations(spark, path).collect()
    assert lines.read_observations(spark, path, strict=False).count() == 1


def test_line_numbers_over_many_splits(spark, tmp_path):
    path = tmp_path / "long.txt"
    path.write_text("\n".join(str(i) for i in range(1, 20001)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        numbered = lines.number_lines(lines.read_lines(spark, f"file://{path}"))
        assert numbered.filter(F.col("value").cast("bigint") != F.col("line_no")).count() == 0
        assert numbered.count() == 20000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_identical_executables_without_tools(spark, tmp_path):
    path = log(tmp_path, observation("2026-07-24T00:00:00Z"), observation("2026-07-25T00:00:00Z"), observation("2026-07-25T00:00:00Z", "x"))
    rows = drift.latest_verdicts(lines.read_observations(spark, path)).collect()
    assert [(r.target_id, r.verdict, r.added) for r in rows] == [("t", "identical", 0)]


def test_hot_key_neighbours(spark):
    """One key owns nearly all rows: chunked neighbours and positions equal the plain answer."""
    rows = spark.range(5000).select(F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("k"), "id")
    got = ordering.previous_in_key(rows, ["k"], ["id"], ["id"], F.floor(F.col("id") / 37), "p").select("k", "id", F.col("p.id").alias("p"))
    wrong = got.filter(
        F.when(F.col("k") == "b", F.col("p") != F.col("id") - 10).otherwise(
            F.col("p") != F.col("id") - F.when(F.col("id") % 10 == 1, 2).otherwise(1)
        )
    )
    assert wrong.count() == 0 and got.filter("p IS NULL").count() == 2
    placed = ordering.global_position(rows, [F.desc("id")], F.floor(F.col("id") / 100), True, "n")
    assert placed.filter(F.col("n") + F.col("id") != 5000).count() == 0


def test_top_two_is_limited_before_the_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    plan = ordering.newest_per_key(rows, ["k"], [F.desc("id")], 2)._jdf.queryExecution().executedPlan().toString()
    partial = plan.rfind("WindowGroupLimit")
    assert plan.count("WindowGroupLimit") == 2 and partial > plan.find("Exchange")


def test_removals_need_full_snapshots(spark):
    links = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c")], "snapshot_id long, m string")
    snaps = spark.createDataFrame(
        [(1, "2024-01-01T00:00:00Z", "full"), (2, "2024-01-02T00:00:00Z", "incremental")], "id long, completed_at string, collection_mode string"
    )
    marked = snapshots.presence(links, snapshots.snapshot_pair(snaps), ["m"])
    assert [r.m for r in snapshots.additions(marked).collect()] == ["c"]
    assert snapshots.removals(marked).count() == 0
    assert [r.m for r in snapshots.removals(marked, raw=True).collect()] == ["a"]
    alone = snapshots.presence(links, snapshots.snapshot_pair(snaps.filter("id = 1")), ["m"])
    assert snapshots.additions(alone).count() == 0


def test_snapshot_order_breaks_time_ties_by_id(spark):
    snaps = spark.createDataFrame([(1, "2024-01-02"), (3, "2024-01-02"), (2, "2023-12-01")], "id long, completed_at string")
    assert {r.id: r.ordinal for r in snapshots.order_snapshots(snaps).collect()} == {3: 1, 1: 2, 2: 3}
    assert snapshots.select_snapshot(snaps).first().id == 3


# --- bundles ---------------------------------------------------------------------------------


def entry(name, version, status="active", **server):
    meta = {"io.modelcontextprotocol.registry/official": {"status": status, "publishedAt": "2024-01-01T00:00:00Z"}}
    return json.dumps({"server": {"name": name, "version": version, **server}, "_meta": meta})


def package(kind, identifier, transport, arguments=(), environment=()):
    return {
        "registryType": kind,
        "identifier": identifier,
        "version": "1.0.0",
        "transport": {"type": transport},
        "packageArguments": list(arguments),
        "environmentVariables": list(environment),
    }


def three(description="first"):
    arguments = [{"type": "positional", "value": "serve"}, {"type": "named", "value": "--safe"}, {"type": "x", "valueHint": "y"}]
    return [
        entry(
            "io.example/alpha", "1.0.0", description=description, repository={"source": "github", "url": "https://GitHub.com/example/alpha.git"},
            packages=[package("npm", "@example/alpha", "stdio", arguments, [{"name": "TOKEN", "isRequired": True}])],
        ),
        entry(
            "io.example/alpha", "2.0.0", "deprecated", description="second", packages=[package("pypi", "alpha", "stdio")],
            remotes=[{"url": "https://one.example/mcp", "type": "streamable-http"}, {"url": "https://Two.example:8443/x", "type": "sse"}],
        ),
        entry("io.example/beta", "9", remotes=[{"url": "https://remote.example/sse", "type": "sse"}]),
    ]


def bundle(spark, folder, name, entries, at):
    rows = [(1 + i // 2, i, e) for i, e in enumerate(entries)]
    df = spark.createDataFrame(rows, "page bigint, position bigint, entry string")
    return write_bundle(df, f"{folder}/{name}", "https://registry.example", at)


@pytest.fixture(scope="module")
def catalog(spark):
    folder, root = scratch(spark, "arrive"), scratch(spark, "cat")
    stats = [imports.import_bundle(spark, bundle(spark, folder, "a", three(), "2024-01-01T00:00:00Z"), root, "2024-02-01T00:00:00Z")]
    second = bundle(spark, folder, "b", three("changed"), "2024-01-02T00:00:00Z")
    stats.append(imports.import_bundle(spark, second, root, "2024-02-02T00:00:00Z"))
    stats.append(imports.import_bundle(spark, second, root, "2024-02-03T00:00:00Z"))
    t = imports.read_catalog(spark, root)
    cat = explore.Catalog(
        t["snapshots"], t["server_versions"], t["snapshot_server_versions"], t["repositories"], t["packages"], t["remotes"], t["package_environment"]
    )
    return cat, t, stats, folder, root


def test_import_statistics_and_idempotence(catalog):
    _, t, stats, _, _ = catalog
    assert (stats[0]["inserted_records"], stats[0]["reused_records"], stats[0]["changed_identity_records"]) == (3, 0, 0)
    assert (stats[1]["inserted_records"], stats[1]["reused_records"], stats[1]["changed_identity_records"]) == (1, 2, 1)
    assert stats[2] is None
    assert t["server_versions"].count() == 4 and t["snapshots"].count() == 2 and t["packages"].count() == 3
    assert [r.argument_value for r in t["package_arguments"].orderBy("position").select("position", "argument_value").distinct().orderBy("position").collect()] == ["serve", "--safe", None]


def test_imports_write_their_part_of_the_text_index(spark, catalog):
    cat, t, _, _, root = catalog
    index = imports.read_index(spark, root)
    assert index.names.count() == t["server_versions"].count() == index.totals().first().n
    texts = bundles.parse_canonical(t["server_versions"].select(F.col("canonical_json").alias("value")))
    docs = explore.search_documents(texts).select("record.*", *explore.SEARCH_FIELDS[2:])
    for query in ("github", "example", "changed", "no such word"):
        want = explore.search_ranked(docs, query, explore.SEARCH_FIELDS).collect()
        got = textindex.search_index(index, query).collect()
        assert [(r.server_identifier, r.server_version, round(r.score, 9)) for r in got] == [(r.server_identifier, r.server_version, round(r.score, 9)) for r in want]


def test_summary_golden(catalog):
    cat = catalog[0]
    members = snapshots.snapshot_members(cat.links, snapshots.select_snapshot(cat.snapshots, 1), cat.versions)
    s = explore.summary_counts(explore.versions_with_facts(cat, members, explore.child_facts(cat, environment=True))).first()
    want = dict(records=3, unique_server_names=2, with_repository=1, package_only=1, remote_only=1, package_and_remote=1, declared_environment_variables=1)
    assert {k: s[k] for k in want} == want
    links = snapshots.snapshot_members(cat.links, snapshots.select_snapshot(cat.snapshots, 1))
    groups = {(r.dimension, r.value): r["count"] for r in explore.grouped_counts(cat, links).collect()}
    assert groups[("status", "active")] == 2 and groups[("status", "deprecated")] == 1 and groups[("repository_host", "github.com")] == 1


@pytest.mark.parametrize(
    ("filters", "want"),
    [
        (explore.Filters(status="deprecated"), [("alpha", "2.0.0")]),
        (explore.Filters(transport="sse"), [("alpha", "2.0.0"), ("beta", "9")]),
        (explore.Filters(package_registry="pypi"), [("alpha", "2.0.0")]),
        (explore.Filters(repository_host="GITHUB.com"), [("alpha", "1.0.0")]),
        (explore.Filters(remote_host="remote.example"), [("beta", "9")]),
        (explore.Filters(without_repository=True), [("alpha", "2.0.0"), ("beta", "9")]),
    ],
)
def test_list_filters(catalog, filters, want):
    cat = catalog[0]
    members = snapshots.snapshot_members(cat.links, snapshots.select_snapshot(cat.snapshots, 1), cat.versions)
    rows = explore.list_versions(cat, members, filters).collect()
    assert [(r.server_identifier.split("/")[1], r.server_version) for r in rows] == want


def test_search_and_show(catalog):
    cat = catalog[0]
    members = snapshots.snapshot_members(cat.links, snapshots.select_snapshot(cat.snapshots), cat.versions)
    filters = explore.Filters(status="deprecated", transport="streamable-http", package_registry="pypi")
    assert [r.server_version for r in explore.search_contains(cat, members, "ALPHA", filters).collect()] == ["2.0.0"]
    shown = explore.show_versions(cat.versions, "io.example/alpha").collect()
    assert [r.server_version for r in shown] == ["1.0.0", "1.0.0", "2.0.0"]
    assert [m.url for m in shown[2].remotes] == ["https://one.example/mcp", "https://Two.example:8443/x"]
    with pytest.raises(ValueError):
        explore.list_versions(cat, members, explore.Filters(has_repository=True, without_repository=True))
    with pytest.raises(ValueError):
        explore.search_contains(cat, members, "")
    with pytest.raises(ValueError):
        explore.list_versions(cat, members, limit=1001)


def test_removed_marker_and_changed_page_are_found(spark, catalog, tmp_path):
    good = bundle(spark, scratch(spark, "x"), "a", three(), "2024-01-05T00:00:00Z")
    target, fs = publish._path(spark, f"{good}/_SUCCESS")
    fs.delete(target, False)
    with pytest.raises(imports.InvalidBundle):
        imports.import_bundle(spark, good, catalog[4], "2024-02-02T00:00:00Z")
    spark.createDataFrame([('{"servers":[]}',)], "value string").coalesce(1).write.mode("overwrite").text(f"{good}/raw/page=1")
    checks = {r.check for r in imports.check_bundle(spark, good).collect()}
    assert {"artifact", "page"} <= checks


@pytest.mark.parametrize(
    ("line", "reason"),
    [
        ("", "canonical record is empty"),
        ("nonsense", "canonical record must be an object"),
        ('{"canonical_sha256":"x","packages":"x","server_identifier":"a/b","server_version":"1"}', "canonical record must be an object"),
        ('{"server_identifier":"bad","server_version":"1","canonical_sha256":"x"}', "invalid canonical identity"),
        ('{"canonical_sha256":"x","server_identifier":"a/b","server_version":"1"}', "canonical record digest mismatch"),
        ('{"server_identifier":"a/b","server_version":"1","canonical_sha256":"x"}', "canonical record is not canonical JSON"),
    ],
)
def test_bad_canonical_lines(spark, line, reason):
    parsed = bundles.parse_canonical(spark.createDataFrame([(line,)], "value string"))
    assert validation.record_problems(parsed).first().problem == reason


def test_duplicates_collapse_and_conflicts_fail(spark):
    def unique(*entries):
        df = spark.createDataFrame([(e,) for e in entries], "entry string")
        return bundles.unique_records(bundles.build_records(df))

    assert unique(three()[0], three()[0]).count() == 1
    with pytest.raises(Exception, match="conflicting duplicate"):
        unique(three("a")[0], three("b")[0]).collect()


@pytest.mark.parametrize(
    ("rows", "valid"),
    [
        ([(1, None, "a"), (2, "a", "b"), (3, "b", None)], True),
        ([(1, None, "a"), (3, "a", None)], False),
        ([(1, None, "a"), (2, "x", None)], False),
        ([(1, None, "a"), (2, "a", "a"), (3, "a", None)], False),
        ([(1, None, None), (2, None, None)], False),
        ([(2, None, None)], False),
    ],
)
def test_page_chain(spark, rows, valid):
    df = spark.createDataFrame([("b", *r) for r in rows], "b string, p int, i string, o string")
    assert validation.page_chain(df, "b", "p", "i", "o").first().valid is valid


def test_streamed_arrivals(spark, catalog):
    folder, root = catalog[3], scratch(spark, "streamed")
    jobs.import_stream(spark, folder, root, scratch(spark, "ck"), "2024-03-01T00:00:00Z")
    assert imports.read_catalog(spark, root)["snapshots"].count() == 2


def test_a_batch_looks_at_its_own_bundles(spark, monkeypatch):
    folder, root, state = scratch(spark, "arrive"), scratch(spark, "cat"), scratch(spark, "ck")
    looked, taken = [], []
    completed, imported = jobs.is_completed, jobs.import_bundle
    monkeypatch.setattr(jobs, "is_completed", lambda spark, b: looked.append(b.rsplit("/", 1)[1]) or completed(spark, b))
    monkeypatch.setattr(jobs, "import_bundle", lambda spark, b, *a: taken.append(b.rsplit("/", 1)[1]) or imported(spark, b, *a))
    bundle(spark, folder, "a", three(), "2024-01-01T00:00:00Z")
    late = bundle(spark, folder, "b", three("changed"), "2024-01-02T00:00:00Z")
    marker, fs = publish._path(spark, f"{late}/_SUCCESS")
    fs.delete(marker, False)
    jobs.import_stream(spark, folder, root, state, "2024-03-01T00:00:00Z")
    assert taken == ["a"] and looked == ["a", "b", "b"]  # b once more at the end
    bundle(spark, folder, "c", three(), "2024-01-01T00:00:00Z")  # the snapshot of a, in another folder
    looked.clear()
    jobs.import_stream(spark, folder, root, state, "2024-03-02T00:00:00Z")
    assert "a" not in looked and taken == ["a"]  # a known bundle is not looked at, a known snapshot not imported
    fs.create(marker, True).close()
    bundle(spark, folder, "d", three("more"), "2024-01-04T00:00:00Z")
    jobs.import_stream(spark, folder, root, state, "2024-03-03T00:00:00Z")
    assert taken == ["a", "b", "d"]
    snapshots_ = imports.read_catalog(spark, root)["snapshots"]
    assert sorted(r.id for r in snapshots_.collect()) == [1, 2, 3]


def test_increments_need_their_base(spark):
    folder, root = scratch(spark, "arrive"), scratch(spark, "cat")
    with pytest.raises(imports.InvalidBundle, match="no snapshot to start from"):
        imports.baseline(spark, root)
    entries = spark.createDataFrame([(1, i, e) for i, e in enumerate(three("changed"))], "page bigint, position bigint, entry string")
    increment = lambda name, since, digest: write_bundle(entries, f"{folder}/{name}", "https://registry.example", "2024-01-05T00:00:00Z", since, digest)
    with pytest.raises(imports.InvalidBundle, match="not in the catalog"):
        imports.import_bundle(spark, increment("a", "2024-01-01T00:00:00Z", "0" * 64), root, "2024-02-01T00:00:00Z", check=False)
    imports.import_bundle(spark, bundle(spark, folder, "full", three(), "2024-01-02T00:00:00Z"), root, "2024-02-01T00:00:00Z", check=False)
    base = imports.baseline(spark, root)
    assert base.updated_since == "2024-01-02T00:00:00Z"
    with pytest.raises(imports.InvalidBundle, match="in no snapshot"):
        imports.import_bundle(spark, increment("b", "2024-01-03T00:00:00Z", base.base_snapshot_sha256), root, "2024-02-01T00:00:00Z", check=False)
    with pytest.raises(imports.InvalidBundle, match="without its base"):
        imports.import_bundle(spark, increment("c", "2024-01-01T00:00:00Z", None), root, "2024-02-01T00:00:00Z", check=False)
    assert imports.read_catalog(spark, root)["snapshots"].count() == 1


def test_numbers_are_claimed_once(spark):
    root = scratch(spark, "cat")
    assert [imports.claim_number(spark, root, d) for d in ("x", "y", "x", "z", "y")] == [1, 2, 1, 3, 2]
    assert imports.claim_number(spark, root, "x", 2) == 4


# --- summaries, queue, reviews ---------------------------------------------------------------


def test_run_summary_golden(spark):
    runs = spark.createDataFrame([(1,), (2,)], "id long")
    found = spark.createDataFrame([(1, "medium", "unreviewed")] * 2, "analysis_run_id long, severity string, disposition string")
    files = spark.createDataFrame([(1, 100, True, False, True, False)], "analysis_run_id long, byte_size long, executable boolean, native_binary boolean, generated boolean, minified boolean")
    deps = spark.createDataFrame([(1,)], "analysis_run_id long")
    rows = {r.analysis_run_id: r for r in summaries.run_summaries(runs, found, files, deps).collect()}
    one = rows[1]
    assert (one.file_count, one.total_file_bytes, one.dependency_count, one.finding_count, one.medium_count, one.unreviewed_count, one.executable_count) == (1, 100, 1, 2, 2, 2, 1)
    assert rows[2].finding_count == 0


def test_rule_metadata_must_not_change(spark):
    found = spark.createDataFrame([(1, "r", "c", "low", "t", "e"), (1, "r", "c", "high", "t", "e")], "analysis_run_id long, rule_id string, category string, severity string, title string, explanation string")
    runs = spark.createDataFrame([(1, "v")], "id long, ruleset_version string")
    with pytest.raises(Exception, match="rule metadata changed"):
        summaries.rule_definitions(found, runs).collect()


def test_shared_run_counts_once(spark):
    queue = spark.createDataFrame(
        [("p", 1, "completed", 100, "x", 1), ("p", 2, "completed", 100, "x", 1), ("p", 3, "failed", None, None, 1), ("p", 4, "unsupported", None, None, 0)],
        "profile_key string, package_id long, state string, analysis_run_id long, artifact_sha256 string, attempt_count int",
    )
    severity = [s for s, n in zip(("info", "low", "medium", "high"), (1, 2, 3, 7)) for _ in range(n)]
    found = spark.createDataFrame([(100, s, "unreviewed") for s in severity], "analysis_run_id long, severity string, disposition string")
    rows = summaries.run_summaries(spark.createDataFrame([(100,)], "id long"), found)
    once = summaries.coverage_by_run(queue, rows).first()
    twice = summaries.coverage_by_package(queue, rows).first()
    assert (once.completed_package_records, once.unique_artifacts_analyzed, once.distinct_completed_runs, once.high_findings) == (2, 1, 1, 7)
    assert sum(once[f"{s}_findings"] for s in ("info", "low", "medium", "high", "critical")) == 13
    assert twice.high_findings == 14


def test_review_queue_order(spark):
    rows = [(1, 1, "high", "expected"), (2, 9, "medium", "unreviewed"), (3, 1, "critical", "unreviewed"), (5, 2, "high", "unreviewed"), (2, 2, "high", "unreviewed")]
    df = spark.createDataFrame(rows, "id long, analysis_run_id long, severity string, disposition string")
    assert [r.id for r in reviews.review_queue(df).collect()] == [3, 5, 2]


def test_stale_review_conflicts(spark):
    found = spark.createDataFrame([(1, "unreviewed")], "id long, disposition string")
    requests = spark.createDataFrame(
        [(1, 1, "unreviewed", "suspicious", "r"), (2, 1, "unreviewed", "mitigated", "r"), (3, 1, "expected", "mitigated", "r"), (4, 9, "unreviewed", "mitigated", "r"), (5, 1, "unreviewed", "unreviewed", "r")],
        "seq long, finding_id long, expected_disposition string, disposition string, reviewer string",
    )
    got = {r.seq: r.outcome for r in reviews.judge_reviews(requests, found).collect()}
    assert got == {1: "accepted", 2: "conflict", 3: "conflict", 4: "not_found", 5: "invalid"}


PROFILE = {"analysis_type": "a", "analyzer_name": "n", "analyzer_version": "1", "ruleset_version": "r"}
QUEUE = (
    "profile_key string, package_id long, state string, reason_code string, reason_message string, attempt_count int, analysis_run_id long, "
    "artifact_sha256 string, reused_existing boolean, discovered_at string, last_attempt_at string, updated_at string"
)
RUNS = "id long, package_id long, status string, analysis_type string, analyzer_name string, analyzer_version string, ruleset_version string, artifact_sha256 string"


def test_synchronization_golden(spark):
    packages = spark.createDataFrame(
        [(1, "npm", "a", "1"), (2, "pypi", "b", "1"), (3, "oci", "c", "1"), (4, "npm", "d", None), (5, "npm", "e", "1")],
        "id long, registry_type string, identifier string, version string",
    )
    runs = spark.createDataFrame([(7, 5, "completed", "a", "n", "1", "r", "x"), (8, 5, "completed", "a", "n", "2", "r", "y")], RUNS)
    first = workqueue.synchronize_static(packages, spark.createDataFrame([], QUEUE), runs, PROFILE, "k", "2024-01-01 00:00:00", 60)
    states = {r.package_id: (r.state, r.analysis_run_id) for r in first.collect()}
    assert states == {1: ("eligible", None), 2: ("eligible", None), 3: ("unsupported", None), 4: ("unresolvable", None), 5: ("completed", 7)}
    again = workqueue.synchronize_static(packages, first, runs, PROFILE, "k", "2024-01-09 00:00:00", 60)
    assert snapshots.table_difference(first, again).count() == 0
    events = spark.createDataFrame(
        [("k", 1, 1, "claim", "2024-01-02 00:00:00", None, None, None, None, None, None), ("k", 2, 2, "claim", "2024-01-02 00:00:00", None, None, None, None, None, None),
         ("k", 2, 3, "result", "2024-01-02 00:01:00", "failed", "analysis_failed", "boom", None, None, False)],
        "profile_key string, package_id long, seq long, kind string, at string, state string, reason_code string, reason_message string, analysis_run_id long, artifact_sha256 string, reused_existing boolean",
    )
    worked = workqueue.apply_transitions(first, events)
    rows = {r.package_id: (r.state, r.attempt_count, r.reason_code) for r in worked.collect()}
    assert rows[1] == ("running", 1, None) and rows[2] == ("failed", 1, "analysis_failed")
    late = {r.package_id: r.reason_code for r in workqueue.synchronize_static(packages, worked, runs, PROFILE, "k", "2024-01-03 00:00:00", 60).collect()}
    assert late[1] == "interrupted" and late[2] == "analysis_failed"
    s = summaries.static_queue_summary(worked).first()
    assert (s.total_package_records, s.successfully_analyzed, s.unsupported_or_unresolvable, s.never_attempted) == (5, 1, 2, 0)


def test_new_profile_is_added_once(spark):
    empty = spark.createDataFrame([], "profile_key string, analyzer_name string, created_at string, selected_at string")
    one = workqueue.register_profile(empty, "k", {"analyzer_name": "n"}, "2024-01-01")
    two = workqueue.register_profile(one, "k", {"analyzer_name": "n"}, "2024-01-02").first()
    assert (two.created_at, two.selected_at) == ("2024-01-01", "2024-01-02")


def test_previous_compatible_run(spark):
    rows = spark.createDataFrame(
        [("k", 101, 1, "s", "p", "2024-01-01"), ("k", 102, 2, "s", "p", "2024-01-02"), ("k", 103, 2, "s", "p", "2024-01-03"), ("z", 104, 3, "s", "p", "2024-01-09")],
        "profile_key string, run_id long, server_version_id long, server_identifier string, package_identifier string, recency string",
    )
    got = {r.run_id: r.previous_run_id for r in drift.previous_compatible_runs(rows).collect()}
    assert got == {101: 103, 102: 101, 103: 101, 104: None}


@pytest.mark.parametrize(
    ("packages", "status", "position"),
    [
        ([("x", 1, 0, "npm", "1"), ("y", 1, 1, "npm", "1")], "resolved", "x"),
        ([("x", 1, 0, "npm", "1"), ("y", 1, 1, "npm", "2")], "ambiguous_package", None),
        ([("x", 1, 0, "npm", None)], "missing_version", None),
        ([("x", 1, 0, "oci", "1")], "unsupported_registry", None),
        ([("x", 2, 0, "npm", "1")], "package_not_found", None),
    ],
)
def test_package_resolution(spark, packages, status, position):
    versions = spark.createDataFrame([(1, "s", "1"), (2, "other", "1")], "id long, server_identifier string, server_version string")
    df = spark.createDataFrame([(i, v, p, r, "pkg", n) for i, v, p, r, n in packages], "id string, server_version_id long, position int, registry_type string, identifier string, version string")
    ask = spark.createDataFrame([("s", "1", "pkg")], "server_identifier string, server_version string, package_identifier string")
    row = workqueue.resolve_packages(ask, df, versions).first()
    assert (row.status, row.package_id) == (status, position)


def test_sync_rejects_a_changed_row(spark):
    source = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    target = spark.createDataFrame([(1, "a"), (3, None)], "id long, v string")
    assert {r.id for r in snapshots.synced(source, target, ["id"]).collect()} == {1, 2, 3}
    changed = spark.createDataFrame([(1, "z")], "id long, v string")
    with pytest.raises(Exception, match="immutable row differs"):
        snapshots.synced(source, changed, ["id"]).collect()


def test_upsert_and_generations(spark):
    target = spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")
    source = spark.createDataFrame([(2, "z"), (3, None)], "id long, v string")
    assert {tuple(r) for r in publish.upserted(target, source, ["id"]).collect()} == {(1, "a"), (2, "z"), (3, None)}
    with pytest.raises(ValueError):
        publish.upserted(target, source.withColumnRenamed("v", "w"), ["id"])
    root = scratch(spark, "gen")
    with pytest.raises(FileNotFoundError):
        publish.read_generation(spark, root, "t")
    target.write.parquet(f"{root}/g9/t")  # no marker: not visible
    publish.publish_generation({"t": source}, root, "g1")
    assert publish.read_generation(spark, root, "t").count() == 2


def test_release_documents(spark):
    files = [
        {"filename": "d-1.0.tar.gz", "packagetype": "sdist", "url": "https://f.example/d-1.0.tar.gz", "size": 5, "digests": {"sha256": "a" * 64}, "yanked": False},
        {"filename": "d-1.0.whl", "packagetype": "bdist_wheel", "url": "https://f.example/d.whl", "size": 5, "digests": {"sha256": "b" * 64}, "yanked": False},
        {"filename": "d-1.0.zip", "packagetype": "sdist", "url": "https://f.example/d.zip", "size": 5, "digests": {"sha256": "c" * 64}, "yanked": True},
    ]
    body = json.dumps({"info": {"name": "Demo.D", "version": "1.0b0"}, "urls": files})
    df = spark.createDataFrame([(1, body, "demo-d", "1.0-beta"), (2, body, "demo-d", "1.0"), (3, "{}", "demo-d", "1.0")], "id int, body string, expected_name string, expected_version string")
    rows = releases.pypi_files(df)
    assert {r.id: r.error for r in rows.select("id", "error").distinct().collect()} == {1: None, 2: "PyPI release metadata identity mismatch", 3: "PyPI release metadata requires info and urls"}
    good = rows.filter("error IS NULL")
    picked = releases.select_sdist(good, ["id", "expected_name", "expected_version"], "expected_name", "expected_version").first()
    assert (picked.error, picked.filename) == (None, "d-1.0.tar.gz")
    named = ["id", "expected_name", "expected_version"]
    ranked = lambda files: releases.pypi_candidates(files, named, "expected_name", "expected_version")
    assert [r.filename for r in ranked(good.where("id = 1")).orderBy("format_order", "filename").collect()] == ["d-1.0.tar.gz", "d-1.0.whl"]
    twice = ranked(good.where("id = 1").unionByName(good.where("id = 1"))).collect()
    assert [(r.error, r.filename) for r in twice] == [("duplicate PyPI release artifact identity", None)]


# --- streams ---------------------------------------------------------------------------------


def test_stream_of_any_order_equals_batch(spark):
    rows = [("t", f"2024-01-{d:02d}T00:00:00Z", i, json.dumps([{"name": n}])) for i, (d, n) in enumerate([(5, "a"), (1, "b"), (9, "c"), (9, "d"), (7, "e")])]
    source, out = scratch(spark, "in"), scratch(spark, "out")
    ddl = "target_id string, observed_at string, seq bigint, inventory string"
    spark.createDataFrame(rows, ddl).repartition(5).write.parquet(source)
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(source)
    jobs.run_to_end(jobs.latest_two_stream(stream), out, scratch(spark, "ck"), "update")
    row = jobs.newest_states(spark, out).first()
    assert (row.latest_seq, row.previous_seq, row.added, row.removed) == (3, 2, 1, 1)
    assert jobs.drift_alerts(jobs.newest_states(spark, out)).count() == 1


def test_streamed_counters_survive_a_replay(spark):
    source, out = scratch(spark, "in"), scratch(spark, "out")
    ddl = "analysis_run_id long, severity string, disposition string"
    spark.createDataFrame([(i % 3, "high", "unreviewed") for i in range(30)], ddl).repartition(4).write.parquet(source)
    for _ in range(2):  # a new checkpoint replays every batch into the same folders
        stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(source)
        jobs.summarize_stream(stream, out, scratch(spark, "ck"))
    assert {r.analysis_run_id: r.unreviewed_high_count for r in jobs.streamed_counters(spark, out).collect()} == {0: 10, 1: 10, 2: 10}
